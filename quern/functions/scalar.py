"""Scalar building blocks as Column to Column functions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import ship_package

INFINITE = float("inf")


def off_schedule(actual: Column, expected: Column, absolute: float = 1e-6, relative: float = 1e-12) -> Column:
    """Whether a value misses its expectation by more than the larger tolerance."""
    return F.abs(actual - expected) > F.greatest(F.lit(absolute), F.lit(relative) * F.abs(expected))


def close_to(actual: Column, expected: Column, relative: float = 1e-5, absolute: float = 1e-8, equal_nan: bool = True) -> Column:
    """Whether two values agree within the sum of both tolerances; missing agrees with missing if ``equal_nan``."""
    a, b = F.when(~F.isnan(actual), actual), F.when(~F.isnan(expected), expected)
    near = F.coalesce((a == b) | (F.abs(a - b) <= absolute + relative * F.abs(b)), F.lit(False))
    return near | (a.isNull() & b.isNull()) if equal_nan else near


def directed_sign(left: Column, right: Column, higher_is_better: bool = True) -> Column:
    """1, 0 or -1: which of two scores is better."""
    return F.signum(left - right if higher_is_better else right - left)


def round_to_multiple(value: Column, multiple: int) -> Column:
    """Nearest multiple, halves to the even quotient."""
    return (F.bround(value / multiple) * multiple).cast("bigint")


def finite_metric(text: Column) -> Column:
    """A double from text; NaN becomes NULL, infinities stay, booleans are NULL."""
    value = F.when(~F.lower(F.trim(text)).isin("true", "false"), F.trim(text).try_cast("double"))
    return F.when(~F.isnan(value), value)


def size_number(size: Column) -> Column:
    """``"150M"`` gives 1.5e8, ``"1B"`` 1e9, plain numbers themselves, else NULL."""
    head = F.substring(size, F.lit(1), F.length(size) - 1).try_cast("double")
    return F.when(size.endswith("M"), head * 1e6).when(size.endswith("B"), head * 1e9).otherwise(size.try_cast("double"))


def size_rank(size: Column) -> Column:
    """Numeric sort key in millions: 60 for 60M, 1000 for 1B."""
    return size_number(size) / 1e6


def mapped(value: Column, mapping: Mapping[object, object], otherwise: Column | None = None) -> Column:
    """CASE value WHEN key THEN value, NULL (or ``otherwise``) for the rest."""
    pairs = list(mapping.items())
    case = F.when(value == F.lit(pairs[0][0]), F.lit(pairs[0][1]))
    for key, result in pairs[1:]:
        case = case.when(value == F.lit(key), F.lit(result))
    return case if otherwise is None else case.otherwise(otherwise)


def by_policy(task: Column, columns: Mapping[str, Column], prefix: str, prefix_metric: str, policy: Mapping[str, str]) -> Column:
    """The metric a policy names for a task: a name prefix decides first, then the task; NULL for unknown tasks."""
    case = F.when(task.startswith(prefix), columns[prefix_metric])
    for name, metric in policy.items():
        case = case.when(task == name, columns[metric])
    return case


def text_sizes(text: Column) -> Column:
    """struct(chars, bytes): code points and UTF-8 bytes."""
    return F.struct(F.char_length(text).alias("chars"), F.octet_length(text).alias("bytes"))


def text_slice(line: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a line, counted from 0."""
    return F.substring(line, start + 1, end - start)


def tidy(text: Column) -> Column:
    """Whether a text is not blank and has no outer whitespace; NULL is not tidy."""
    return F.coalesce((F.trim(text) != "") & ~text.rlike(r"^\s|\s$"), F.lit(False))


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def answer_index(key: Column, letters: str = "ABCDE", digits: str = "12345") -> Column:
    """0-based index of a letter or number answer key, NULL for unknown keys."""
    found = F.greatest(F.instr(F.lit(letters), key), F.instr(F.lit(digits), key))
    return F.when((F.length(key) == 1) & (found > 0), found - 1)


# -- display -----------------------------------------------------------------


def short_number(value: Column) -> Column:
    """``1234`` as ``1.2k``, ``3.4e9`` as ``3.4B``; small numbers with two decimals."""
    size = F.abs(value)
    part = lambda by, mark: F.concat(F.format_string("%.1f", value / by), F.lit(mark))
    return F.when(size >= 1e9, part(1e9, "B")).when(size >= 1e6, part(1e6, "M")).when(size >= 1e3, part(1e3, "k")).otherwise(F.format_string("%.2f", value))


# -- JSON ----------------------------------------------------------------------


def _refuse(name: str) -> None:
    raise ValueError(name)


def _strict(text: str | None) -> tuple[bool, object]:
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False, None


#: First byte of a JSON text to its kind; what is not here begins a number.
_JSON_KINDS = {b"{": "object", b"[": "array", b'"': "string", b"t": "boolean", b"f": "boolean", b"n": "null"}


@F.pandas_udf(T.StringType())
def _json_kind(text: pd.Series) -> pd.Series:
    from quern.operators.nested import StructuralIndex

    present = text.dropna()
    raw = [t.encode("utf-8", "surrogatepass") for t in present]
    valid = StructuralIndex(raw).valid
    kinds = [_JSON_KINDS.get(t.lstrip()[:1], "number") if v else None for t, v in zip(raw, valid.tolist(), strict=True)]
    return pd.Series(kinds, present.index, dtype=object).reindex(text.index)


@F.pandas_udf(T.StringType())
def _canonical_json(text: pd.Series) -> pd.Series:
    def canonical(t: str | None) -> str | None:
        fine, value = _strict(t)
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if fine else None

    return text.map(canonical)


def json_kind(text: Column) -> Column:
    """object, array, string, number, boolean or null; NULL for text that strict JSON rejects.

    Built-in parsers take trailing junk or NaN; the texts of a batch are judged at once by their structural index.
    """
    ship_package(SparkSession.getActiveSession())
    return _json_kind(text)


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys; NULL for text that strict JSON rejects."""
    ship_package(SparkSession.getActiveSession())
    return _canonical_json(text)


_VARIANT_KINDS = {"string": ("STRING",), "int64": ("BIGINT", "DECIMAL", "DOUBLE"), "float64": ("BIGINT", "DECIMAL", "DOUBLE"), "bool": ("BOOLEAN",)}


def json_leaf(text: Column, path: str, kind: str) -> Column:
    """struct(value, valid): the typed leaf at ``path``.

    ``valid`` is false when the leaf has another JSON type, or is a number that
    is not whole (int64) or not finite (float64). A missing leaf or JSON null is
    valid and NULL.
    """
    leaf = F.try_variant_get(F.try_parse_json(text), path, "variant")
    shape = F.regexp_extract(F.schema_of_variant(leaf), r"^[A-Z]+", 0)
    absent = leaf.isNull() | (shape == "VOID")
    raw = F.try_variant_get(leaf, "$", "string")
    right = shape.isin(*_VARIANT_KINDS[kind])
    if kind == "int64":
        number = raw.try_cast("decimal(38,18)")
        value = F.when(right & (number == F.floor(number)), number.try_cast("bigint"))
    elif kind == "float64":
        number = raw.try_cast("double")
        value = F.when(right & (F.abs(number) < INFINITE), number)
    elif kind == "bool":
        value = F.when(right, raw.try_cast("boolean"))
    else:
        value = F.when(right, raw)
    return F.struct(value.alias("value"), (absent | value.isNotNull()).alias("valid"))


def json_id(text: Column, path: str = "$") -> Column:
    """struct(kind, value): string, integer or null id, its value as text; other kinds are invalid."""
    leaf = F.try_variant_get(F.try_parse_json(text), path, "variant")
    shape = F.regexp_extract(F.schema_of_variant(leaf), r"^[A-Z]+", 0)
    kind = F.when(leaf.isNull() | (shape == "VOID"), "null").when(shape == "STRING", "string").when(shape == "BIGINT", "integer").otherwise("invalid")
    return F.struct(kind.alias("kind"), F.when(kind.isin("string", "integer"), F.try_variant_get(leaf, "$", "string")).alias("value"))


# -- choice scores ---------------------------------------------------------------

RULES = ("raw", "per_token", "per_char", "per_byte", "pmi")


def rule_value(rule: str, log_likelihood: Column, tokens: Column, chars: Column, octets: Column, unconditional: Column) -> Column:
    """The score of a choice under a decision rule; NULL where its divisor is 0 or its part is missing."""
    match rule:
        case "raw":
            return log_likelihood.cast("double")
        case "per_token":
            return F.try_divide(log_likelihood, tokens)
        case "per_char":
            return F.try_divide(log_likelihood, chars)
        case "per_byte":
            return F.try_divide(log_likelihood, octets)
        case "pmi":
            return log_likelihood - unconditional
    raise ValueError(f"unknown rule {rule!r}; one of {', '.join(RULES)}")


def first_largest(values: Column) -> Column:
    """0-based index of the largest element of an array; the first of equal ones, NULL if there is none."""
    indexed = F.filter(F.transform(values, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))), lambda s: s["v"].isNotNull())
    return F.array_min(indexed)["i"]


def first_smallest(values: Column) -> Column:
    return first_largest(F.transform(values, lambda v: -v))


# -- prompts -----------------------------------------------------------------------


# The parts of a prompt.
QUESTION_PREFIX, ANSWER_PREFIX, CONTINUATION_PREFIX, SHOT_SEPARATOR = "Question: ", "Answer:", " ", "\n\n"


def query_text(question: Column, question_prefix: str = QUESTION_PREFIX, answer_prefix: str = ANSWER_PREFIX) -> Column:
    return F.concat(F.lit(question_prefix), question, F.lit("\n" + answer_prefix))


def few_shot_prefix(shots: Sequence[tuple[str, str]], continuation_prefix: str = CONTINUATION_PREFIX, separator: str = SHOT_SEPARATOR) -> str:
    """Text of worked (question, answer) examples before a query."""
    texts = [f"{QUESTION_PREFIX}{q}\n{ANSWER_PREFIX}{continuation_prefix}{a}" for q, a in shots]
    return separator.join(texts) + separator if texts else ""


def continuations(choices: Column, continuation_prefix: str = CONTINUATION_PREFIX) -> Column:
    return F.transform(choices, lambda c: F.concat(F.lit(continuation_prefix), c))


def file_sha256(path: str | Path) -> str:
    """Hex SHA-256 of a file, read in blocks."""
    with Path(path).open("rb") as source:
        return hashlib.file_digest(source, "sha256").hexdigest()
