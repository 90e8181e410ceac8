"""Resumable ingest with Structured Streaming.

New files of a folder are taken in micro-batches by an ``availableNow`` query; the
streaming checkpoint remembers what is done, so a killed run resumes where it
stopped. Each batch is written to its own folder under its batch id and is
overwritten if it is retried, so every file counts exactly once. A fingerprint of
the contract guards against resuming under another one, and the path, size and time of every
staged file against input that was replaced under its old name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.files import FileSystem

Transform = Callable[[DataFrame], DataFrame]


class FingerprintError(ValueError):
    """Staged data was written under another contract, or from files that have changed since."""


#: Columns of staged rows that tell where they came from.
ORIGIN = ("file_path", "file_size", "file_modified")


def fingerprint(schema: T.StructType, version: str) -> str:
    return hashlib.sha256(f"{version}\n{schema.simpleString()}".encode()).hexdigest()


def ingest(spark: SparkSession, source: str, schema: T.StructType, staging: str, *, transform: Transform = lambda df: df, file_format: str = "json", version: str = "1", files_per_batch: int = 100) -> DataFrame:
    """Stage all new files of ``source`` and give the staged rows with their ``batch_id``."""
    fs = FileSystem(spark)
    mark, data, state = f"{staging}/_fingerprint", f"{staging}/data", f"{staging}/_checkpoint"
    own = fingerprint(schema, version)
    if fs.exists(mark):
        if fs.read_text(mark) != own:
            raise FingerprintError(f"{staging} was staged under another contract; clear it first")
        if changed := changed_files(spark, source, staging):
            raise FingerprintError(f"{changed[0]} is not the file that was staged; clear {staging} first")
    else:
        fs.make(staging)
        fs.write_text(mark, own)

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{data}/batch_id={batch_id}")

    stream = spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_batch).load(source)
    about = [F.col(f"_metadata.{f}").alias(c) for f, c in zip(("file_path", "file_size", "file_modification_time"), ORIGIN, strict=True)]
    query = stream.select("*", *about).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return staged(spark, staging)


def staged(spark: SparkSession, staging: str) -> DataFrame:
    """All rows staged so far."""
    return spark.read.parquet(f"{staging}/data")


def manifest(spark: SparkSession, staging: str) -> DataFrame:
    """Files done, with their batch and number of rows."""
    return staged(spark, staging).groupBy("batch_id", *ORIGIN).agg(F.count(F.lit(1)).alias("n_rows"))


def changed_files(spark: SparkSession, source: str, staging: str) -> list[str]:
    """Names of staged files that now have another size or time in ``source``; files without rows and files that are gone are not told."""
    fs = FileSystem(spark)
    if not fs.names(f"{staging}/data"):
        return []
    now = [(name, *fs.status(f"{source}/{name}")) for name in fs.names(source)]
    listed = spark.createDataFrame(now, "name string, size bigint, modified bigint")
    done = staged(spark, staging).select(F.element_at(F.split("file_path", "/"), -1).alias("name"), "file_size", F.unix_millis("file_modified").alias("staged_at")).distinct()
    unlike = done.join(listed, "name").where((F.col("size") != F.col("file_size")) | (F.col("modified") != F.col("staged_at")))
    return [r["name"] for r in unlike.select("name").orderBy("name").limit(10).collect()]


def clear(spark: SparkSession, staging: str) -> None:
    FileSystem(spark).delete(staging)
