"""Exact, JVM-side readings of numbers written as text.

A number is written in ASCII digits with an optional sign, decimal point and
exponent. Casting text through ``DOUBLE`` loses digits beyond 2**53 and casting
through ``DECIMAL`` rounds long fractions, so whole numbers are read from
the digits themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^([+-]?)(?=\.?[0-9])([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$"
#: Blanks and line ends around a value.
BLANKS = " \t\r\n\f\u000b "
_FAR = 1_000_000_000


def strip_blanks(text: Column) -> Column:
    """``text`` without outer blanks and line ends; NULL stays NULL."""
    return F.trim(text, F.lit(BLANKS))


def is_number(text: Column) -> Column:
    """Whether ``text`` (outer blanks removed) is written as a number; NULL gives NULL."""
    return text.rlike(NUMBER)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole_number(text: Column) -> Column:
    """The BIGINT that ``text`` stands for, NULL unless it is whole and fits.

    ``"1250.0"``, ``"1.25e3"`` and ``"12500e-1"`` give 1250; ``"1.5"``, ``""``,
    ``"12OO"`` and ``"9223372036854775808"`` give NULL. Outer blanks are not
    counted. No digit is lost at any magnitude.
    """
    nothing = F.lit(None).cast("bigint")

    def parts(t: Column) -> Column:
        # named_struct: aliases inside an expression are dropped where a generator stands beside it
        return F.named_struct(*[x for k, n in enumerate(("sign", "whole", "fraction", "power"), 1) for x in (F.lit(n), F.regexp_extract(t, NUMBER, k))])

    def sized(p: Column) -> Column:
        exponent = F.coalesce(
            F.when(p["power"] == "", F.lit(0)).otherwise(p["power"].try_cast("int")).cast("bigint"),
            F.when(p["power"].startswith("-"), F.lit(-_FAR)).otherwise(F.lit(_FAR)).cast("bigint"),
        )
        digits = F.concat(p["whole"], p["fraction"])
        kept = F.rtrim(digits, F.lit("0"))
        # zeros to append to the significant digits; negative means a fraction remains
        zeros = F.length(digits) - F.length(kept) - F.length(p["fraction"]) + exponent
        return F.named_struct(F.lit("sign"), p["sign"], F.lit("lead"), F.ltrim(kept, F.lit("0")), F.lit("zeros"), zeros)

    def value(n: Column) -> Column:
        size = F.length(n["lead"]) + n["zeros"]
        magnitude = F.rpad(n["lead"], F.greatest(F.lit(0), F.least(size, F.lit(19))).cast("int"), F.lit("0"))
        return (
            F.when(n["lead"] == "", F.lit(0).cast("bigint"))
            .when((n["zeros"] < 0) | (size > 19), nothing)
            .otherwise(F.concat(n["sign"], magnitude).try_cast("bigint"))
        )

    # Plain digits, nearly all values, stay in generated code; the rest is read part by part.
    plain = strip_blanks(text)
    return F.when(plain.rlike("^[0-9]{1,18}$"), plain.try_cast("bigint")).when(is_number(plain), let(plain, lambda t: let(parts(t), lambda p: let(sized(p), value))))


def finite_double(text: Column) -> Column:
    """The finite DOUBLE that ``text`` stands for, else NULL (``1e400``, ``inf``, ``x``)."""
    plain = strip_blanks(text)
    value = F.when(is_number(plain), plain.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def present(value: Column) -> Column:
    """A DOUBLE with NaN turned into NULL."""
    return F.when(~F.isnan(value), value)


def is_finite(value: Column) -> Column:
    """True for a DOUBLE that is neither NULL, NaN nor infinite; never NULL."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def micros(column: str, kind: str) -> Column:
    """Microseconds of a time column of type ``kind`` (``timestamp_ntz``, ``timestamp`` or text), whatever the session's zone."""
    c = F.col(column)
    if kind == "timestamp":
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.try_cast("timestamp_ntz"))
