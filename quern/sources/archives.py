"""Nested checkpoint archives: a Spark data source for the outer files, parallel work on the inner ones.

An outer ``tar.gz`` holds ``{recipe}/{params}/seed-{n}/step-{s}.tar.gz`` members; each of
those holds ``step-{s}/{task}-metrics.json`` and ``-predictions.jsonl`` files. A gzip
stream cannot be split, so an outer archive is read by one task, member by
member and without unpacking: it gives the compressed checkpoints, which are then
spread over the cluster, so that unpacking runs per checkpoint. Archives are opened through
Arrow's file systems (local, HDFS and object stores by their URI).

Rows: recipe, params, seed_value, step, task, metrics (JSON text, on the first row of a task
only), line_no and prediction (JSON text; a task without predictions gives one row with
NULLs). Predictions are passed on in batches of lines, so no checkpoint's text is held whole.
Members that match no checkpoint path are skipped. A second copy of a checkpoint
in an archive, files outside their checkpoint's folder, repeated files and
unpaired files raise.
"""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KEY = ("recipe", "params", "seed_value", "step")
MEMBERS = "recipe string, params string, seed_value bigint, step bigint, data binary"
SCHEMA = "recipe string, params string, seed_value bigint, step bigint, task string, metrics string, line_no bigint, prediction string"
_CHECKPOINT = re.compile(r"(?:^|.*/)(?P<recipe>[^/]+)/(?P<params>[^/]+)/seed-(?P<seed>\d+)/step-(?P<step>\d+)\.tar\.gz$", re.I)
_INNER = re.compile(r"^(?:\./)?(?P<folder>[^/]+)/(?P<task>[^/]+)-(?P<kind>metrics\.json|predictions\.jsonl)$")
#: Prediction lines handed on at once.
LINES = 1_000


class ArchiveError(ValueError):
    """An archive breaks the expected layout."""


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def matching(pattern: str) -> list[str]:
    """Files of a path whose last part may be a pattern; a plain path stands for itself."""
    folder, _, name = pattern.rpartition("/")
    if not any(c in name for c in "*?["):
        return [pattern]
    files, at = _opened(folder)
    listed = files.get_file_info(arrow_fs.FileSelector(at))
    return sorted(f"{folder}/{i.base_name}" for i in listed if i.type == arrow_fs.FileType.File and fnmatch(i.base_name, name))


def checkpoints(path: str, recipe: str | None = None) -> Iterator[tuple]:
    """(recipe, params, seed_value, step, compressed data) of one outer archive; with ``recipe`` only its members (case ignored)."""
    seen: set[tuple] = set()
    files, at = _opened(path)
    with files.open_input_stream(at, compression=None) as source, tarfile.open(fileobj=source, mode="r|gz") as outer:
        for member in outer:
            named = _CHECKPOINT.match(member.name) if member.isfile() else None
            if named is None or (recipe is not None and named["recipe"].casefold() != recipe.casefold()):
                continue
            key = (recipe or named["recipe"], named["params"], int(named["seed"]), int(named["step"]))
            if key in seen:
                raise ArchiveError(f"checkpoint {key} occurs twice in {path}")
            seen.add(key)
            yield (*key, outer.extractfile(member).read())


def unpacked(data: bytes, step: int) -> Iterator[tuple[str, str | None, int | None, str | None]]:
    """(task, metrics, line_no, prediction) rows of an inner archive.

    A first pass checks the layout and reads the metrics, a second one streams the predictions.
    """
    metrics: dict[str, str] = {}
    predictions: set[str] = set()
    with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz") as inner:
        for member in inner:
            if not member.isfile():
                continue
            named = _INNER.match(member.name)
            if named is None or named["folder"] != f"step-{step}":
                raise ArchiveError(f"unexpected file {member.name} in step {step}")
            task, kind = named["task"], named["kind"].split(".")[0]
            if task in (metrics if kind == "metrics" else predictions):
                raise ArchiveError(f"{member.name} occurs twice")
            if kind == "metrics":
                metrics[task] = inner.extractfile(member).read().decode("utf-8")
            else:
                predictions.add(task)
    for task in sorted(metrics.keys() ^ predictions):
        raise ArchiveError(f"task {task} of step {step} lacks {'predictions' if task in metrics else 'metrics'}")
    with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz") as inner:
        for member in inner:
            named = _INNER.match(member.name) if member.isfile() else None
            if named is None or named["kind"] != "predictions.jsonl":
                continue
            task, k = named["task"], 0
            for line in inner.extractfile(member):
                if line.strip():
                    yield task, None if k else metrics[task], k, line.decode("utf-8").rstrip("\n")
                    k += 1
            if k == 0:
                yield task, metrics[task], None, None


def archive_rows(path: str, recipe: str | None = None) -> Iterator[tuple]:
    """All rows of one outer archive, unpacked where it is read."""
    for *key, data in checkpoints(path, recipe):
        for row in unpacked(data, key[3]):
            yield (*key, *row)


class _ArchivePartition(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for pattern in options["path"].split(",") for p in matching(pattern)]
        self.recipe = options.get("recipe")

    def partitions(self) -> list[InputPartition]:
        return [_ArchivePartition(p) for p in self.paths]

    def read(self, partition: _ArchivePartition) -> Iterator[tuple]:
        yield from checkpoints(partition.path, self.recipe)


class CheckpointArchive(DataSource):
    """``spark.read.format("checkpoint_archive").load(path)``: compressed checkpoints; several paths or patterns by comma."""

    @classmethod
    def name(cls) -> str:
        return "checkpoint_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(dict(self.options))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*KEY, "task", "metrics", "line_no", "prediction"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            *key, data = (batch.column(c)[i].as_py() for c in range(5))
            rows: list[tuple] = []
            for row in unpacked(data, key[3]):
                rows.append((*key, *row))
                if len(rows) == LINES:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)


def read_archives(spark: SparkSession, paths: str, recipe: str | None = None) -> DataFrame:
    """Rows of all archives; one task per archive to read, as many as there are checkpoints to unpack."""
    from quern.session import ship_package

    ship_package(spark)
    spark.dataSource.register(CheckpointArchive)
    reader = spark.read.format("checkpoint_archive")
    members = (reader.option("recipe", recipe) if recipe else reader).load(paths)
    return members.repartition(*KEY).mapInArrow(_unpack, SCHEMA)
