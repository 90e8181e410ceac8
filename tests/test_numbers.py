from decimal import Decimal, InvalidOperation

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.numbers import finite_double, is_finite, whole_number

CASES = {
    "0": 0, "1250": 1250, "1250.0": 1250, " 42 ": 42, "+9100": 9100, "-7": -7, "1.25e3": 1250, "12500e-1": 1250, "6.025000000000e+04": 60250,
    ".5e1": 5, "5.": 5, "0e999999999999": 0, "-0": 0, "000000000000000000000012": 12, "9223372036854775807": 2**63 - 1, "-9223372036854775808": -(2**63),
    "9223372036854775808": None, "1.5": None, "1.0000000000000000000000000001": None, "": None, " ": None, ".": None, "e5": None, "1e": None, "12OO": None,
    "1_000": None, "1,000": None, "0x10": None, "nan": None, "inf": None, "1e40": None, "1e-3": None, "1e99999999999": None, "٣": None, "1 2": None, None: None,
}


def test_whole_number(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "t string").select("t", whole_number(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == CASES


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"[+-]?[0-9]{0,22}\.?[0-9]{0,22}([eE][+-]?[0-9]{1,3})?", fullmatch=True), min_size=40, max_size=40))
def test_whole_number_is_exact(spark, texts):
    def exact(t):
        try:
            d = Decimal(t)
        except InvalidOperation:
            return None
        return int(d) if abs(d.adjusted()) < 60 and d == d.to_integral_value() and -(2**63) <= d < 2**63 else (0 if d == 0 else None)

    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", whole_number(F.col("t")).alias("v")).collect()}
    for t in texts:
        if not t.rstrip("eE+-0123456789").endswith(".") or t.strip("+-.eE"):
            assert got[t] == (exact(t) if any(c.isdigit() for c in t.lower().split("e")[0]) else None), t


@pytest.mark.parametrize(("text", "value"), [("1e400", None), ("Infinity", None), ("-0.5", -0.5), ("4e18", 4e18), ("1d", None), ("", None), (None, None)])
def test_finite_double(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(finite_double(F.col("t"))).first()[0] == value


def test_is_finite_is_never_null(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert [r[0] for r in df.select(is_finite(F.col("v"))).collect()] == [False, False, False, True]
