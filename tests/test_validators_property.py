"""Validators agree with Python's float() / strict ISO dates on random text,
except the documented deviations (nan, inf and digit underscores are rejected)."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from cauce.functions import rules as R

TOKENS = ["1", "12", "0", "-3", "+5", ".5", "5.", "1e3", "2E-2", "1_000", "nan", "inf", "abc", "1d", "",
          " ", "\t", "0x10", "1.2.3", "-", "e5", "7 ", " 8", "٣"]
DATES = ["2024-01-01", "2024-1-1", "2024/01/01", "2024-02-30", "2023-02-29", "2024-02-29", "01-01-2024",
         " 2024-01-01", "2024-01-01 ", "20240101", "2024-13-01", ""]


def _py_float(s):
    if any(x in s.lower() for x in ("nan", "inf", "_")):
        return None  # documented deviation
    try:
        return float(s)
    except ValueError:
        return None


def _py_date(s):
    if not (len(s) == 10 and s[4] == "-" and s[7] == "-" and s.replace("-", "").isdigit()):
        return None
    try:
        return dt.datetime.strptime(s, "%Y-%m-%d").date()
    except ValueError:
        return None


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(TOKENS), st.sampled_from(TOKENS)), min_size=5, max_size=40))
def test_numeric_text_matches_python(spark, pairs):
    vals = [a + b for a, b in pairs]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r[0] for r in df.select(R.to_double("x")).collect()]
    for v, g in zip(vals, got):
        exp = _py_float(v)
        assert (g is None and exp is None) or (g is not None and exp is not None and abs(g - exp) < 1e-12), v


def test_iso_dates_match_strptime(spark):
    df = spark.createDataFrame([(v,) for v in DATES], "x string")
    got = [r[0] for r in df.select(R.to_iso_date("x")).collect()]
    assert got == [_py_date(v) for v in DATES]
