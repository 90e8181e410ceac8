"""Row validation: violations come out as rows; raising is a separate action.

Rules are judged in order and a row reports the first that it breaks. Reports are
lazy, so they combine with other work; ``raise_first`` runs the smallest plan
(a top-1 by ordinal) and raises with the row's context.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.contracts import TableContract


class ViolationError(ValueError):
    """A table breaks a rule; the message names the first offending row."""


@dataclass(frozen=True)
class Rule:
    """``broken`` is true for an offending row; NULL counts as not broken."""

    kind: str
    broken: Column
    value: Column | None = None


def outside_domain(column: str, allowed: Sequence[str]) -> Rule:
    """NULL or not one of the allowed values."""
    c = F.col(column)
    return Rule(column, c.isNull() | ~c.isin(*allowed), c.cast("string"))


def missing(column: str) -> Rule:
    return Rule(column, F.col(column).isNull())


def violations(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """Offending rows: ``keep`` columns, ``kind``, ``value`` and the rule's position ``rule_no``."""
    case, value = None, None
    for k, rule in enumerate(rules):
        hit, shown = F.coalesce(rule.broken, F.lit(False)), rule.value if rule.value is not None else F.lit(None).cast("string")
        entry = F.struct(F.lit(k).alias("rule_no"), F.lit(rule.kind).alias("kind"), shown.cast("string").alias("value"))
        case = F.when(hit, entry) if case is None else case.when(hit, entry)
    # exploded, so that the long case is one expression and not one for each of its fields
    return df.select(*keep, F.explode(F.array(case)).alias("_v")).where("_v IS NOT NULL").select(*keep, "_v.kind", "_v.value", "_v.rule_no")


def sound_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that ``violations`` does not report."""
    return df.where(~F.greatest(*[F.coalesce(r.broken, F.lit(False)) for r in rules], F.lit(False)))


def first_violation(df: DataFrame, rules: Sequence[Rule], ordinal: Sequence[str]) -> DataFrame:
    """At most one row: the first offender by ordinal, then rule order."""
    return violations(df, rules, ordinal).orderBy(*ordinal, "rule_no").limit(1)


def raise_first(df: DataFrame, rules: Sequence[Rule], ordinal: Sequence[str], table: str = "table") -> None:
    found = first_violation(df, rules, ordinal).collect()
    if found:
        row = found[0]
        place = ", ".join(f"{c}={row[c]}" for c in ordinal)
        raise ViolationError(f"invalid {row['kind']} in {table} at {place}: {row['value']!r}")


def repeated_rows(df: DataFrame, key: Sequence[str], ordinal: Sequence[str]) -> DataFrame:
    """All but the first row of each key, in ordinal order, with ``copy_no`` from 2."""
    order = Window.partitionBy(*key).orderBy(*ordinal)
    return df.select(*key, *[c for c in ordinal if c not in key], F.row_number().over(order).alias("copy_no")).where("copy_no > 1")


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def conflicts(df: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys whose rows disagree on a field: more than one distinct non-NULL value."""
    counted = df.groupBy(*key).agg(*[F.count_distinct(f).alias(f) for f in fields])
    found = F.filter(F.array(*[F.when(F.col(f) > 1, F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    return counted.select(*key, found.alias("fields")).where(F.size("fields") > 0)


def order_breaks(df: DataFrame, parts: str, ordinal: str, key: Sequence[str]) -> DataFrame:
    """Places where a physically ordered table is out of key order.

    ``parts`` names the file of a row and ``ordinal`` its place in the file. Rows are
    compared with their predecessor within a file, and file ends with the next
    file's start, so no window spans the whole table. One row per break.
    """
    keys = F.struct(*key)
    inside = Window.partitionBy(parts).orderBy(ordinal)
    rows = df.select(F.col(parts).alias("part"), F.col(ordinal).alias("place"), keys.alias("k"), F.lag(keys).over(inside).alias("before"))
    within = rows.where("before > k").select("part", "place")
    ends = rows.groupBy("part").agg(F.min_by("k", "place").alias("first_k"), F.max_by("k", "place").alias("last_k"), F.min("place").alias("place"))
    chain = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per file
    between = ends.select("part", "place", "first_k", F.lag("last_k").over(chain).alias("before")).where("before > first_k").select("part", "place")
    return within.unionByName(between)


def table_report(df: DataFrame, contract: TableContract) -> DataFrame:
    """One row: row count, NULLs in required columns, and keys that are not unique."""
    required = [c.name for c in contract.columns if not c.nullable]
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required])
    if not contract.key:
        return counts
    repeated = repeated_keys(df, contract.key).agg(F.count(F.lit(1)).alias("repeated_keys"))
    return counts.crossJoin(repeated)  # one row each


def check_table(df: DataFrame, contract: TableContract) -> int:
    """Raise unless the frame meets its contract; gives the row count."""
    faults = contract.schema_faults(df)
    if faults:
        raise ViolationError(f"{contract.name}: {'; '.join(faults)}")
    row = table_report(df, contract).first().asDict()
    bad = {k: v for k, v in row.items() if k != "n_rows" and v}
    if bad:
        raise ViolationError(f"{contract.name}: {bad}")
    return row["n_rows"]
