"""Writers: staged, counted, validated and swapped in as a set."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.contracts import TableContract
from quern.operators.relational import add_missing_groups, replace_group
from quern.operators.validate import ViolationError, check_table, order_breaks
from quern.sources.files import FileSystem
from quern.sources.readers import parquet_with_ordinal


def staging_path(path: str) -> str:
    """A hidden sibling of ``path`` that readers of its folder skip."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.{name}.{uuid.uuid4().hex[:8]}"


def write_staged(df: DataFrame, path: str, *, sort: Sequence[str] = (), partition_by: Sequence[str] = (), expected: int | None = None) -> tuple[str, int]:
    """Write compressed Parquet beside ``path`` and count it back from disk.

    ``sort`` gives a global order (a range-partitioned sort, nulls last), so that file statistics
    let later scans skip; gives the staging path and the rows.
    """
    staged = staging_path(path)
    ordered = df.orderBy(*[F.col(c).asc_nulls_last() for c in sort]) if sort else df
    writer = ordered.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    rows = df.sparkSession.read.parquet(staged).count()
    if expected is not None and rows != expected:
        FileSystem(df.sparkSession).delete(staged)
        raise ViolationError(f"{path}: wrote {rows} rows, expected {expected}")
    return staged, rows


def swap_in(spark: SparkSession, staged: Mapping[str, str], before: Callable[[str], None] | None = None) -> None:
    """Move staged outputs (final path to staging path) into place, all or none.

    Old outputs are set aside first; on any error everything is put back. A
    backup that cannot be put back is kept and named in the error.
    """
    fs = FileSystem(spark)
    backups: dict[str, str] = {}
    moved: list[str] = []
    try:
        for final, source in staged.items():
            if before is not None:
                before(final)
            if fs.exists(final):
                backup = staging_path(final) + ".bak"
                fs.rename(final, backup)
                backups[final] = backup
            fs.rename(source, final)
            moved.append(final)
    except BaseException:
        stuck = []
        for final in staged:
            try:
                if final in moved:
                    fs.delete(final)
                if final in backups:
                    fs.rename(backups[final], final)
            except Exception:
                stuck.append(backups.get(final, final))
        for source in staged.values():
            fs.delete(source)
        if stuck:
            raise OSError(f"rollback failed; backups kept at {', '.join(stuck)}") from None
        raise
    for backup in backups.values():
        fs.delete(backup)


def write_table(df: DataFrame, path: str, contract: TableContract) -> int:
    """Write a contract table: project, sort by key, stage, validate from disk, swap in."""
    staged, _ = write_staged(contract.project(df), path, sort=contract.key)
    try:
        rows = validate_written(df.sparkSession, staged, contract)
    except BaseException:
        FileSystem(df.sparkSession).delete(staged)
        raise
    swap_in(df.sparkSession, {path: staged})
    return rows


def validate_written(spark: SparkSession, path: str, contract: TableContract) -> int:
    """Check a written table against its contract: columns, NULLs, keys and physical order."""
    df, place, origin = parquet_with_ordinal(spark, path)
    rows = check_table(df.select(*[c for c in df.columns if c not in (place, origin)]), contract)
    if contract.key and order_breaks(df, origin, place, contract.key).limit(1).collect():
        raise ViolationError(f"{contract.name}: not in the order of {contract.key}")
    return rows


def upsert_group(spark: SparkSession, path: str, new: DataFrame, contract: TableContract, column: str, value: object) -> int:
    """Replace one group's rows in a written table (or create it)."""
    current = spark.read.parquet(path) if FileSystem(spark).exists(path) else contract.empty(spark)
    return write_table(replace_group(contract.project(current), contract.project(new), column, value), path, contract)


def add_groups(spark: SparkSession, path: str, remote: DataFrame, contract: TableContract, column: str) -> int:
    """Add remote rows of groups that a written table lacks; nothing is written if there are none."""
    local = contract.project(spark.read.parquet(path))
    if not remote.join(local.select(column).distinct(), column, "left_anti").limit(1).collect():
        return 0
    return write_table(add_missing_groups(local, contract.project(remote), column), path, contract)


def write_shards(df: DataFrame, path: str, column: str, sort: Sequence[str] = ()) -> None:
    """One folder per group; rows of a group are sorted within their files.

    Rows are spread by group and a hash of the row, so a hot group gets several files.
    """
    spread = df.repartition(F.col(column), F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    spread.sortWithinPartitions(column, *sort).write.mode("overwrite").partitionBy(column).option("compression", "zstd").parquet(path)


def with_row_ids(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """0-based ``row_id`` in a total order.

    Ranks within range partitions plus the sizes of the partitions before them: no
    window over the whole table.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
    tagged = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    from quern.session import stable_checkpoint

    fixed = stable_checkpoint(tagged)  # range bounds are sampled: both uses must see one result
    sizes = fixed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_p", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n")).alias("_start"))  # one row per partition
    return fixed.join(F.broadcast(starts), "_p").select((F.col("_start") + F.col("_k")).alias("row_id"), *df.columns)


def write_measurements(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A measurement table with row ids, as CSV or Parquet by the path's suffix."""
    numbered = with_row_ids(df, order)
    if path.endswith(".csv"):
        numbered.write.mode("overwrite").option("header", True).csv(path)
    else:
        numbered.write.mode("overwrite").parquet(path)


def write_evidence(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Nested evidence with an exact schema."""
    require_schema(df, schema)
    df.write.mode("overwrite").parquet(path)


def read_evidence(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    df = spark.read.parquet(path)
    require_schema(df, schema)
    return df


def require_schema(df: DataFrame, schema: T.StructType) -> None:
    have, want = df.schema.simpleString(), schema.simpleString()
    if have != want:
        raise ViolationError(f"schema {have} is not {want}")


def require_totals(staged: DataFrame, manifest: DataFrame, counters: Mapping[str, str]) -> None:
    """Staged rows per kind must equal the sums the manifest declares."""
    have = {r["kind"]: r["n"] for r in staged.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per kind
    want = manifest.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in counters.items()]).first().asDict()
    off = {k: (have.get(k, 0), n) for k, n in want.items() if have.get(k, 0) != n}
    if off:
        raise ViolationError(f"staged totals differ from the manifest: {off}")
