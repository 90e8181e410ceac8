"""Readers: Parquet with ordinals, strict CSV, declared JSON, text slices, known tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.contracts import TableContract
from quern.operators.validate import ViolationError
from quern.sources.files import FileSystem


class UnknownTableError(KeyError):
    """No table of that name is known."""


class MissingTableError(FileNotFoundError):
    """A known table has not been written."""


class HeaderError(ViolationError):
    """A delimited file's header is not the declared one."""


def unused_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until the frame has no such column."""
    while wanted in df.columns:
        wanted = "_" + wanted
    return wanted


def parquet_with_ordinal(spark: SparkSession, path: str | Sequence[str], ordinal: str = "row_index", file: str = "file_path") -> tuple[DataFrame, str, str]:
    """The table, with each row's file and 0-based place in it; gives the names used."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    place, origin = unused_name(df, ordinal), unused_name(df, file)
    return df.select("*", F.col("_metadata.row_index").alias(place), F.col("_metadata.file_path").alias(origin)), place, origin


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Names in the first line of a delimited file (reads one line)."""
    first = spark.read.text(path).limit(1).collect()
    return next(csv.reader(io.StringIO(first[0][0]))) if first else []


def require_header(spark: SparkSession, path: str, names: Sequence[str]) -> None:
    have = header_of(spark, path)
    if have != list(names):
        raise HeaderError(f"{path}: header {have} is not {list(names)}")


def strict_csv(spark: SparkSession, path: str, contract: TableContract) -> DataFrame:
    """Typed CSV without inference: the header must match, a cell that does not fit its type fails the read.

    Blank cells are NULL for other types and stay ``''`` for text.
    """
    require_header(spark, path, contract.names)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in contract.schema().fields])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c.name}`"), F.lit("")).alias(c.name) if c.kind == "string" else F.col(f"`{c.name}`") for c in contract.columns])


def text_csv(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All-text CSVs, later ones trusted more: adds source_priority, source_file and 1-based source_row.

    A quoted field may hold line ends, so each file is one task and its row number
    comes from the reader's own order.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    out = None
    for priority, path in enumerate(paths):
        require_header(spark, path, columns)
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
        part = df.select(F.lit(priority).alias("source_priority"), F.element_at(F.split(F.lit(path), "/"), -1).alias("source_file"), row.alias("source_row"), *[F.col(f"`{c}`") for c in columns])
        out = part if out is None else out.unionByName(part)
    return out


def csv_with_filename(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Several CSVs as text with the file each row came from; every header must match, quoted fields may hold line ends, a bad record fails the read."""
    for path in paths:
        require_header(spark, path, columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"')
    return reader.csv(list(paths)).select("*", F.col("_metadata.file_path").alias("filename"))


def json_pairs(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """(pair_index, model_1, model_2) of a file that holds a list of two-name lists."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("p"))
    pairs = whole.select(F.posexplode("p").alias("pair_index", "pair"))
    fine = (F.size("pair") == 2) & F.forall("pair", lambda n: F.coalesce(F.trim(n) != "", F.lit(False)))
    n, bad = pairs.agg(F.count(F.lit(1)), F.count_if(~F.coalesce(fine, F.lit(False)))).first()
    if n != expected or bad:
        raise ViolationError(f"{path}: {n} pairs, {bad} of them malformed; expected {expected}")
    return pairs.select(F.col("pair_index").cast("bigint").alias("pair_index"), F.col("pair")[0].alias("model_1"), F.col("pair")[1].alias("model_2"))


def declared_json(spark: SparkSession, paths: Sequence[str], schema: str | T.StructType, tasks: DataFrame | None = None) -> DataFrame:
    """Newline-delimited JSON with a declared nested schema and its file; joined to (filename, task) if given."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(list(paths)).select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("filename"))
    return df if tasks is None else df.join(tasks, "filename")


def rows_relation(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """An in-memory relation; typed and empty without rows."""
    return spark.createDataFrame(list(rows), schema)


def rows_by_id(df: DataFrame, ids: Sequence[int], id_column: str = "row_id") -> DataFrame:
    """Exactly the rows with these ids; missing or repeated ids raise (runs a query)."""
    wanted = sorted(set(ids))
    found = df.where(F.col(id_column).isin(*wanted)) if wanted else df.limit(0)
    have = [r[0] for r in found.select(id_column).collect()]  # as many as were asked for
    if sorted(have) != wanted:
        raise ViolationError(f"missing ids {sorted(set(wanted) - set(have))[:5]}, repeated ids {sorted({i for i in have if have.count(i) > 1})[:5]}")
    return found


def text_slices(spark: SparkSession, path: str, slices: DataFrame) -> DataFrame:
    """``slices`` (line, start, end; lines from 1, characters [start, end)) with their ``text``; NULL for absent lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("k", "value")).select((F.col("k") + 1).alias("line"), "value")
    return slices.join(lines, "line", "left").select(*slices.columns, F.substring(F.col("value"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def write_cache(df: DataFrame, path: str, derived: Sequence[str] = ()) -> None:
    """JSON-lines cache without derived columns."""
    df.drop(*derived).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_cache(spark: SparkSession, path: str, schema: str | T.StructType, derived: Mapping[str, Column] | None = None) -> DataFrame:
    """A cached table with its derived columns built again."""
    return spark.read.schema(schema).json(path).withColumns(dict(derived or {}))


@dataclass
class TableCatalog:
    """Known tables under a root: a file, or a directory of shards read as one table."""

    spark: SparkSession
    root: str
    paths: Mapping[str, str] = field(default_factory=dict)

    def read(self, name: str, columns: Sequence[str] | None = None, where: Column | str | None = None) -> DataFrame:
        """The table; the filter and the projection reach the Parquet scan."""
        if name not in self.paths:
            raise UnknownTableError(f"{name}: known tables are {', '.join(sorted(self.paths))}")
        path = f"{self.root.rstrip('/')}/{self.paths[name]}"
        if not FileSystem(self.spark).exists(path):
            raise MissingTableError(path)
        df = self.spark.read.option("mergeSchema", False).parquet(path)
        df = df if where is None else df.where(where)
        return df if columns is None else df.select(*columns)
