import hashlib

import pytest

from cauce.llm import line_chunks


def brute(rows):
    """The chunkings and removals over (doc_id, text) with distinct ids, in plain Python."""
    found = {}
    for doc_id, text in rows:
        if text is None:
            continue
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        spans = set()
        for window, modulus, seed in line_chunks.CHUNKINGS:
            a = 0
            for i in range(len(lines)):
                back = (h[i - 1] if i else 0) * 17 if window > 1 else 0
                if i == len(lines) - 1 or ((h[i] * 31 + back + seed) // 7) % modulus == 0:
                    spans.add((a, i))
                    a = i + 1
        for a, b in spans:
            if b - a + 1 >= 2 and sum(len(x.strip(" ")) for x in lines[a:b + 1]) >= line_chunks.MIN_CHARS:
                found.setdefault("\n".join(lines[a:b + 1]), []).append((float("inf") if doc_id is None else doc_id, a, b))
    gone = {}
    for places in found.values():
        for doc_id, a, b in sorted(places)[1:]:
            gone.setdefault(doc_id, set()).update(range(a, b + 1))
    out = {}
    for doc_id, text in rows:
        cut = gone.get(float("inf") if doc_id is None else doc_id, set())
        lines = [] if text is None else text.split("\n")
        new = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in cut)
        out[doc_id] = (new, len(lines), len(cut))
    return out


PASSAGE = "\n".join(f"this is line {i} of a passage that documents share" for i in range(9))


def rows():
    out = [(i, f"own start {i}\nmore of it {i * 7}\n{PASSAGE}\nown end {i}\nlast {i}") for i in range(60)]
    out += [(100 + i, "\n".join(f"doc {i} line {j} with its own words" for j in range(12))) for i in range(30)]
    out += [(200, None), (201, ""), (202, "\n" * 60), (203, "\n" * 60), (204, PASSAGE), (205, f"{PASSAGE}\n{PASSAGE}\n{PASSAGE}"),
            (206, "é ü ñ is a longer line of text\nß second line of the text"), (207, "é ü ñ is a longer line of text\nß second line of the text"),
            (None, PASSAGE)]
    return out


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(5)
    out = line_chunks.remove_repeated_chunks(docs).collect()
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out}
    assert len(out) == len(rows()) and got == brute(rows())
    assert all(got[100 + i][2] == 0 for i in range(30))  # clean documents stay as they are
    assert sum(got[i][2] >= 5 for i in range(1, 60)) > 50  # most of the passage goes, wherever it stands
    assert got[0][2] == 0  # but not from its first holder


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_chunks.remove_repeated_chunks(empty).count() == 0
    docs = spark.createDataFrame([(1, "a\nb", 7, "k"), (1, "a\nb", 8, "k"), (2, PASSAGE, None, "z"), (2, PASSAGE, 1, "z"), (3, PASSAGE, 2, None)],
                                 "doc_id long, text string, n_lines int, _key string")
    out = line_chunks.remove_repeated_chunks(docs)
    assert out.columns == ["doc_id", "text", "_key", "n_lines", "n_removed"]
    got = [(r["doc_id"], r["n_removed"]) for r in out.collect()]
    assert sorted(got)[:4] == [(1, 0), (1, 0), (2, 0), (2, 0)] and dict(got)[3] >= 5


@pytest.mark.parametrize("at", [0, 3, 8])
def test_boundaries_move_with_the_content(spark, at):
    """A line inserted before the passage leaves its chunks the same."""
    other = "\n".join(["inserted"] * (at + 1)) + "\n" + PASSAGE
    docs = spark.createDataFrame([(1, PASSAGE + "\nend"), (2, other + "\nother end")], "doc_id long, text string")
    out = {r["doc_id"]: r["n_removed"] for r in line_chunks.remove_repeated_chunks(docs).collect()}
    assert out[1] == 0 and out[2] >= 5


def test_chunks_that_share_a_hash_are_judged_apart(spark):
    """Two lines with equal 32-bit hashes beside the same partner line: each chunk's copies go."""
    one, two = (f"paragraph number {n} with some more words so that it is long enough" for n in (85473, 90931))
    assert len({hashlib.md5(x.encode()).hexdigest()[:8] for x in (one, two)}) == 1
    data = [(1, f"{one}\n"), (2, f"{one}\n"), (3, f"{two}\n"), (4, f"{one}\nlicence"), (5, f"{two}\nlicence"), (6, f"{two}\nlicence")]
    out = line_chunks.remove_repeated_chunks(spark.createDataFrame(data, "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out}
    assert got == brute(data)
    assert [got[i][2] for i in range(1, 7)] == [0, 2, 0, 0, 0, 2]
