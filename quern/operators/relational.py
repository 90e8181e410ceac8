"""Joins and set operations with the exact matching rules the analyses need."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.validate import ViolationError, repeated_keys
from quern.session import checked_broadcast, stable_checkpoint


def require_unique(df: DataFrame, key: Sequence[str], what: str = "right side") -> DataFrame:
    """The frame itself, after checking that its key is unique (runs a query)."""
    found = repeated_keys(df, key).limit(1).collect()
    if found:
        raise ViolationError(f"{what} has several rows for {found[0].asDict()}")
    return df


def many_to_one(left: DataFrame, right: DataFrame, key: Sequence[str], matched: str = "matched") -> DataFrame:
    """Left join that tells whether a right row was found; right rows are unique by key."""
    return left.join(right.withColumn(matched, F.lit(True)), list(key), "left").withColumn(matched, F.coalesce(matched, F.lit(False)))


#: Rows of a key, both sides together, beyond which an as-of join cuts it into stretches.
STRETCH = 1_000_000
_STRETCHES = 64


def latest_at_or_before(left: DataFrame, right: DataFrame, by: Sequence[str], limit: Column, at: Column, value: Column, tolerance: float | None = None, stretch: int = STRETCH) -> DataFrame:
    """As-of join: for each left row the right row with the greatest ``at`` <= ``limit``.

    Both sides are merged in one sort by ``by`` and position; a running ``last``
    carries the match, so no pairs are formed and left rows without a match keep
    NULL. Of equal ``at`` the greatest ``value`` is taken. With ``tolerance`` a
    match that undershoots ``limit`` by a larger share is no match. Right rows
    with a NULL or non-positive ``at`` never match. Adds ``match_at``, ``match_value``.

    A key with more than ``stretch`` rows (counted by one query) is cut at quantiles of the
    position; each stretch is sorted by itself and takes up the last match of those before it.
    """
    kept = [c for c in left.columns if c not in by]
    a = left.select(*by, limit.cast("double").alias("_p"), F.lit(1).alias("_side"), F.struct(*kept).alias("_left"), F.lit(None).cast("double").alias("_at"), F.lit(None).cast("bigint").alias("_value"))
    b = right.select(*by, at.cast("double").alias("_p"), F.lit(0).alias("_side"), F.lit(None).alias("_left"), at.cast("double").alias("_at"), value.cast("bigint").alias("_value")).where("_p > 0")
    merged = a.unionByName(b)
    cuts = _cuts(merged, by, stretch)
    if cuts is None:
        merged = merged.withColumn("_s", F.lit(0))
    else:
        same = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in by]
        part = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda m: m <= F.col("_p"))))
        merged = merged.join(checked_broadcast(cuts), reduce(Column.__and__, same), "left").select(*merged.columns, F.coalesce(part, F.lit(0)).alias("_s"))
    key = [*by, "_s"]
    order = Window.partitionBy(*key).orderBy("_p", "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(F.when(F.col("_side") == 0, F.struct("_at", "_value")), ignorenulls=True)
    matched = merged.withColumn("_m", found.over(order)).where("_side = 1")
    if cuts is not None:
        # the last right row of each stretch, carried over the stretches of its key
        ends = merged.groupBy(*key).agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_value"))).alias("_end"))
        earlier = F.max("_end").over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
        carried = ends.select(*[F.col(c).alias(f"_c_{c}") for c in key], earlier.alias("_earlier")).where("_earlier IS NOT NULL")
        on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in key])
        matched = matched.join(checked_broadcast(carried), on, "left").withColumn("_m", F.coalesce("_m", "_earlier"))
    near = F.col("_m").isNotNull() & F.col("_p").isNotNull()
    if tolerance is not None:
        near &= (F.col("_p") - F.col("_m._at")) / F.col("_p") <= tolerance
    return matched.select(*by, "_left.*", F.when(near, F.col("_m._at")).alias("match_at"), F.when(near, F.col("_m._value")).alias("match_value"))


def _cuts(merged: DataFrame, by: Sequence[str], stretch: int) -> DataFrame | None:
    """Positions at which keys of more than ``stretch`` rows are cut, in ``_c_`` columns; None if there are none."""
    largest = merged.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= stretch:
        return None
    marks = F.percentile_approx("_p", [k / _STRETCHES for k in range(1, _STRETCHES)])
    cut = merged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), marks.alias("_cuts")).where(F.col("n") > stretch)
    # written down, so that every use of the plan cuts alike
    return stable_checkpoint(cut.select(*[F.col(c).alias(f"_c_{c}") for c in by], F.array_distinct("_cuts").alias("_cuts")))


def nearest_name(df: DataFrame, value: Column, names: Mapping[str, float], out: str) -> DataFrame:
    """The name whose number is nearest; the first in mapping order on ties, NULL for NULL."""
    table = F.array(*[F.struct(F.abs(value - F.lit(float(n))).alias("gap"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, n) in enumerate(names.items())])
    return df.withColumn(out, F.when(value.isNotNull(), F.array_min(table)["name"]))


def full_outer_runs(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full outer join on a shared key, null-safe, with a presence column per side."""
    a = left.withColumn("in_left", F.lit(True)).alias("a")
    b = right.withColumn("in_right", F.lit(True)).alias("b")
    on = None
    for k in key:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    joined = a.join(b, on, "full_outer")
    keys = [F.when(F.col("a.in_left"), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in key]
    rest = [F.col(f"a.{c}") for c in left.columns if c not in key] + [F.col(f"b.{c}") for c in right.columns if c not in key]
    return joined.select(*keys, *rest, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def resolved(df: DataFrame, column: str, aliases: DataFrame, out: str) -> DataFrame:
    """Look a name up among aliases (alias, official); an official name stands for itself, others are NULL."""
    both = aliases.select("alias", "official").union(aliases.select("official", "official")).distinct()
    return df.join(both.select(F.col("alias").alias(column), F.col("official").alias(out)), column, "left")


def grid(df: DataFrame, **dimensions: Sequence[object]) -> DataFrame:
    """Every row with every combination of the given values, by exploding literals (no join)."""
    for name, values in dimensions.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def replace_group(old: DataFrame, new: DataFrame, column: str, value: object) -> DataFrame:
    """Rows of the group replaced by new ones; NULL groups stay."""
    return old.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new)


def add_missing_groups(local: DataFrame, remote: DataFrame, column: str) -> DataFrame:
    """Local rows, and remote rows of groups that are absent locally."""
    return local.unionByName(remote.join(local.select(column).distinct(), column, "left_anti").select(local.columns))


def shared_rows(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Left rows whose key is also on the right."""
    return left.join(right.select(*key).distinct(), list(key), "left_semi")


def multiset_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs: the row and ``change`` (copies after minus before).

    One signed grouped count answers both directions; NULLs are equal.
    """
    names = before.columns
    signed = before.select(*names, F.lit(-1).alias("_s")).unionByName(after.select(*names, F.lit(1).alias("_s")))
    return signed.groupBy(*names).agg(F.sum("_s").alias("change")).where("change <> 0")


def require_same_rows(before: DataFrame, after: DataFrame, what: str = "output") -> int:
    """Raise if two tables differ as multisets; gives the row count."""
    first = multiset_changes(before, after).limit(1).collect()
    if first:
        raise ViolationError(f"{what} changed rows: {first[0].asDict()}")
    return before.count()


def key_sets(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every distinct key with ``in_left`` and ``in_right``; NULL keys are equal."""
    both = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(*key).agg((F.max("l") == 1).alias("in_left"), (F.max("r") == 1).alias("in_right"))


def provenance(df: DataFrame, source_file: str, source_unit: str) -> DataFrame:
    """The frame with its origin in the first two columns."""
    return df.select(F.lit(source_file).alias("source_file"), F.lit(source_unit).alias("source_unit"), "*")


def preferred(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (a total order is the caller's matter)."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def aligned_start(df: DataFrame, group: str, position: str) -> DataFrame:
    """Rows from the latest of the groups' first positions on."""
    start = df.groupBy(group).agg(F.min(position).alias("_first")).agg(F.max("_first").alias("_start"))
    return df.crossJoin(F.broadcast(start)).where(F.col(position) >= F.col("_start")).drop("_start")  # one row
