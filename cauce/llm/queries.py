"""Registered queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce.llm import (
    bpe,
    exact_dedup,
    html_extract,
    langid,
    lbl,
    lexical_search,
    line_chunks,
    minhash,
    mixing,
    quality,
    token_cache,
    warc,
    whitening,
)
from cauce.llm.common import materialise, table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --------------------------------------------------------------- exact dedup
@register("op8_exact_dedup", """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS nth,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256
FROM g""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# ------------------------------------------------------------------------ BPE
def token_digests(encoded: DataFrame, *carry: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, from :func:`bpe.encode_documents`, then columns ``carry``."""
    ids = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
                          F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *carry)


def public_vocabulary(name: str) -> str:
    """Path of a public tokenizer file; it is installed alike on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(bpe.encode_documents(docs, public_vocabulary("word_bpe_49k.json")))


# --------------------------------------------------------------- language ID
@register("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


# ------------------------------------------------------------- quality rules
@register("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.apply_rules(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "quality_prob")


# ---------------------------------------------------------------------- WARC
@register("op4_warc", """
WITH t AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (
  SELECT page_id, strlen(html) AS n, sha1(html) AS digest,
         max(page_id) OVER (PARTITION BY html) AS top
  FROM t)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM s""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_pages(table(spark, sf_dir, "pages"))
    records = materialise(warc.read_records(spark, path, payload=False), "warc-records")
    captures = warc.assemble(records)
    return captures.select(
        warc.field("metadata", "page-id").cast("bigint").alias("page_id"), "payload_bytes",
        F.col("payload_sha1").alias("payload_digest"), "record_type",
        F.when(F.col("record_type") == "revisit", warc.field("original_metadata", "page-id").cast("bigint")).alias("refers_to"))


# -------------------------------------------------------------------- mixing
@register("op2_mixing", """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
n AS (SELECT source, cast(floor(sqrt(cast(count(*) AS double)) * 1000) AS bigint) AS r FROM d GROUP BY source),
w AS (SELECT source, greatest(1, (1000 * r) // (sum(r) OVER ())::bigint)::bigint AS share FROM n),
p AS (SELECT sum(share)::bigint AS period FROM w),
edf AS (
  SELECT 0::bigint AS t, source, share, period, 0::bigint AS done FROM w, p
  UNION ALL
  SELECT t + 1, source, share, period,
         done + CASE WHEN row_number() OVER (ORDER BY (done * period) // share <= t DESC,
                                             ((done + 1) * period + share - 1) // share, source) = 1 THEN 1 ELSE 0 END
  FROM edf WHERE t < period),
s AS (
  SELECT a.source, a.share, a.period, a.done + 1 AS nth, a.t AS slot
  FROM edf a JOIN edf b ON a.source = b.source AND b.t = a.t + 1 AND b.done = a.done + 1),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS source_rank FROM d),
b AS (SELECT *, (source_rank - 1) // 8 + 1 AS block FROM r)
SELECT b.doc_id, b.source, b.source_rank, b.block,
       ((b.block - 1) * s.period) // s.share AS release,
       (b.block * s.period + s.share - 1) // s.share AS deadline,
       ((b.block - 1) // s.share) * s.period + s.slot AS slot
FROM b JOIN s ON b.source = s.source AND s.nth = (b.block - 1) % s.share + 1""")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return mixing.mix(docs)


# --------------------------------------------------------- MinHash near-dedup
@register("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


# ----------------------------------------------------------- HTML extraction
@register("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_main(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


# ---------------------------------------------------------------- LM scoring
@register("op6_lm_score")
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


# ---------------------------------------------------------------- line dedup
def _line_dedup_sql() -> str:
    """The chunkings of :mod:`line_chunks` over one row per line."""
    cuts, runs = [], []
    for k, (window, modulus, seed) in enumerate(line_chunks.CHUNKINGS):
        back = "coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 17" if window > 1 else "0"
        cuts.append(f"CASE WHEN ((h * 31 + {back} + {seed}) // 7) % {modulus} = 0 THEN 1 ELSE 0 END AS cut{k}")
        runs.append(f"""SELECT doc_id, min(i) AS a, max(i) AS b, string_agg(line, chr(10) ORDER BY i) AS chunk,
            sum(length(trim(line))) AS chars
          FROM (SELECT *, coalesce(sum(cut{k}) OVER (PARTITION BY doc_id ORDER BY i
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM c) GROUP BY doc_id, run""")
    return f"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM s),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::bigint AS h FROM l),
c AS (SELECT doc_id, i, line, {', '.join(cuts)} FROM h),
k AS (SELECT DISTINCT doc_id, a, b, chunk FROM ({' UNION ALL '.join(runs)})
      WHERE b - a + 1 >= {line_chunks.MIN_LINES} AND chars >= {line_chunks.MIN_CHARS}),
g AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) AS nth FROM k),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN g ON l.doc_id = g.doc_id AND l.i BETWEEN g.a AND g.b WHERE g.nth > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
         FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id),
n AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(n.n_lines, 0) AS n_lines, coalesce(n.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


@register("op5_line_dedup", _line_dedup_sql())
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.remove_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


# ------------------------------------------------------------- lexical search
@register("op11_lexical_search", """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, len(terms)::bigint AS n FROM d WHERE len(terms) > 0),
tot AS (SELECT count(*)::bigint AS n_docs, sum(n)::bigint AS n_terms FROM n),
i AS (
  SELECT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
q AS (SELECT item_id, term, count(*)::bigint AS q FROM i GROUP BY ALL),
f AS (
  SELECT r, term, count(*)::bigint AS tf
  FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint AS w
  FROM (SELECT term, count(*)::bigint AS df FROM f GROUP BY term), tot),
s AS (
  SELECT q.item_id, n.r, n.doc_id,
         sum(q.q * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (100 - 25 + (25 * n.n * tot.n_docs) // tot.n_terms))))::bigint AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN n ON n.r = f.r, tot
  GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::integer AS rank, doc_id, score FROM k WHERE rank <= 20""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 table(spark, sf_dir, "benchmark").select("item_id", "text"))


# ---------------------------------------------------------------- token counts
#: Texts of more tokens are over the limit.
TOKEN_LIMIT = 4096


@register("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call starts with an empty cache, so its cost is that of every distinct text."""
    counted = token_cache.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                       public_vocabulary("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


# -------------------------------------------------------------------- whitening
@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
