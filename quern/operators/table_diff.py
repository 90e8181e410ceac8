"""Differences between two copies of a table, field by field.

Each side is reduced to the row that stands for its key (latest ``loaded_at``)
by a map-side combinable ``max``, so a key that was re-sent a million times
costs one row per map task, and the join sees unique keys. The join is a
null-safe full outer join; the compared columns become one array of
(field, left value, right value) differences. Null-safety lies in the keys themselves (a
fill value and one bitmap of what was NULL), so that reduction and join agree on one
partitioning and one order: each side is shuffled and sorted once.

Defined results: NULL keys match NULL keys; NULL and NaN are alike missing;
rows tied on ``loaded_at`` are resolved by the greatest value struct, which is
the same on every run; repeated rows collapse; empty sides report every row of
the other side as missing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import present, strip_blanks, whole_number
from quern.session import checked_broadcast


_FILL = {"string": "", "bigint": 0, "int": 0}
NULLS = "_nulls"


def latest_rows(df: DataFrame, keys: Mapping[str, Column], fields: Mapping[str, Column], order: Column) -> DataFrame:
    """One row per key: the ``fields`` of the row with the greatest ``order``.

    NULL keys are filled; bit k of ``_nulls`` tells that key k was NULL. Keys are text or whole numbers.
    """
    packed = df.select(
        *[c.alias(f"k_{k}") for k, c in keys.items()],
        F.struct(*[c.alias(f) for f, c in fields.items()]).alias("v"),
        order.alias("o"),
    )
    types = dict(packed.dtypes)
    nulls = sum((F.when(F.col(f"k_{k}").isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)), F.lit(0))
    filled = packed.select(*[F.coalesce(f"k_{k}", F.lit(_FILL[types[f"k_{k}"]]).cast(types[f"k_{k}"])).alias(k) for k in keys], nulls.alias(NULLS), "v", "o")
    # NULL orders before everything else; the row is carried once, inside what it is ordered by
    kept = filled.groupBy(*keys, NULLS).agg(F.max(F.struct("o", "v")).alias("r"))
    return kept.select(*keys, NULLS, *[F.col(f"r.v.{f}").alias(f) for f in fields])


def differs(left: Column, right: Column, tolerance: float) -> Column:
    """Whether two doubles differ: one missing, or more than ``tolerance`` apart. Never NULL."""
    a, b = present(left), present(right)
    apart = F.coalesce(~((a == b) | (F.abs(a - b) <= tolerance)), F.lit(False))
    return (a.isNull() != b.isNull()) | apart


def diff_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows missing on a side, and differing fields of rows on both.

    Both sides come from ``latest_rows``, so they have one row per key. Result: keys, ``side`` (``both``,
    ``left_only``, ``right_only``) and ``differences``, an array of
    struct(field, left_value, right_value); rows without any difference are left out.
    """
    on = [*keys, NULLS]
    sided = lambda df, mark: df.select(*on, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias(mark))
    joined = sided(left, "a").join(sided(right, "b"), on, "full_outer")
    side = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").otherwise("both")
    candidates = F.array(
        *[
            F.when(
                differs(F.col(f"a.{f}"), F.col(f"b.{f}"), tolerance),
                F.struct(F.lit(f).alias("field"), present(F.col(f"a.{f}")).alias("left_value"), present(F.col(f"b.{f}")).alias("right_value")),
            )
            for f in fields
        ]
    )
    return (
        joined.select(
            *[F.when(F.col(NULLS).bitwiseAND(1 << i) == 0, F.col(k)).alias(k) for i, k in enumerate(keys)],
            side.alias("side"),
            F.when(side == "both", F.filter(candidates, lambda d: d.isNotNull())).otherwise(F.array().cast("array<struct<field:string,left_value:double,right_value:double>>")).alias("differences"),
        )
        .where((F.col("side") != "both") | (F.size("differences") > 0))
    )


#: Compared fields: name in the detail copy to name in the aggregate copy.
TASK_FIELDS = {"primary_score": "primary_metric", "acc_raw": "acc_raw", "acc_per_token": "acc_per_token", "acc_per_char": "acc_per_char", "acc_uncond": "acc_uncond", "no_answer": "no_answer"}
TASK_KEYS = ("recipe", "params", "seed_value", "step", "task")


def _plain(c: str) -> Column:
    return F.lower(strip_blanks(F.col(c)))


def diff_task_results(tasks: DataFrame, olmes: DataFrame, recipes: DataFrame, seeds: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``diff_tables`` of the two copies of task results (left: detail, right: aggregate).

    Keys are compared and reported in the spelling of the detail copy: recipe and
    task in lower case, params in upper case, no outer blanks; on the aggregate
    side the recipe is looked up by display name, the seed by name and the step
    is read by value. A display name without a recipe stands for itself; a seed
    or step that cannot be read is NULL. Such rows come out as missing.
    """
    left = latest_rows(
        tasks,
        {"recipe": _plain("recipe"), "params": F.upper(strip_blanks(F.col("params"))), "seed_value": F.col("seed_value").cast("bigint"), "step": F.col("step").cast("bigint"), "task": _plain("task")},
        {f: F.col(f) for f in TASK_FIELDS},
        F.col("loaded_at"),
    )
    names = recipes.select(_plain("recipe_name").alias("r_name"), _plain("recipe").alias("r_recipe")).dropDuplicates(["r_name"])
    seed_names = seeds.select(_plain("seed").alias("s_name"), F.col("seed_value").cast("bigint").alias("s_value")).dropDuplicates(["s_name"])
    spelt = olmes.select(
        _plain("recipe_name").alias("o_name"), F.upper(strip_blanks(F.col("params"))).alias("params"), _plain("seed").alias("o_seed"),
        whole_number(F.col("step")).alias("step"), _plain("task").alias("task"), "loaded_at", *[F.col(g).alias(f) for f, g in TASK_FIELDS.items()],
    )
    # Keys are undone before the reduction: two spellings are one key.
    undone = spelt.join(checked_broadcast(names), F.col("o_name") == F.col("r_name"), "left").join(checked_broadcast(seed_names), F.col("o_seed") == F.col("s_name"), "left")
    right = latest_rows(
        undone,
        {"recipe": F.coalesce("r_recipe", "o_name"), "params": F.col("params"), "seed_value": F.col("s_value"), "step": F.col("step"), "task": F.col("task")},
        {f: F.col(f) for f in TASK_FIELDS},
        F.col("loaded_at"),
    )
    return diff_tables(left, right, TASK_KEYS, list(TASK_FIELDS), tolerance)


def task_findings(differences: DataFrame) -> DataFrame:
    """One row per missing key or differing field: keys and ``finding``."""
    finding = (
        F.when(F.col("side") == "left_only", F.array(F.lit("missing_in_olmes")))
        .when(F.col("side") == "right_only", F.array(F.lit("missing_in_tasks")))
        .otherwise(F.transform("differences", lambda d: d["field"]))
    )
    return differences.select(*TASK_KEYS, F.explode(finding).alias("finding"))
