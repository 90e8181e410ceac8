"""Table contracts: ordered typed columns, keys, and the frames they describe."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Logical column kinds and the types they are stored as.
KINDS: dict[str, T.DataType] = {"string": T.StringType(), "int64": T.LongType(), "float64": T.DoubleType(), "bool": T.BooleanType()}


@dataclass(frozen=True)
class ContractColumn:
    name: str
    kind: str
    nullable: bool = True


@dataclass(frozen=True)
class TableContract:
    """What a table must look like. ``key`` identifies a row and orders the table."""

    name: str
    columns: tuple[ContractColumn, ...]
    key: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, KINDS[c.kind], c.nullable) for c in self.columns])

    def empty(self, spark: SparkSession) -> DataFrame:
        """A typed relation without rows."""
        return spark.createDataFrame([], self.schema())

    def project(self, df: DataFrame, renamed: Mapping[str, str] | None = None) -> DataFrame:
        """Contract columns in order and type; ``renamed`` maps contract to raw names.

        A column the input lacks becomes a typed NULL; unknown columns are
        dropped. Text that cannot be read as the type becomes NULL.
        """
        source = renamed or {}
        out = []
        for c in self.columns:
            raw, kind = source.get(c.name, c.name), KINDS[c.kind].simpleString()
            out.append((F.col(f"`{raw}`").try_cast(kind) if raw in df.columns else F.lit(None).cast(kind)).alias(c.name))
        return df.select(*out)

    def schema_faults(self, df: DataFrame) -> list[str]:
        """Differences between the frame's columns and the contract, in order."""
        have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
        want = [(c.name, KINDS[c.kind].simpleString()) for c in self.columns]
        if have == want:
            return []
        faults = [f"missing {n}" for n, _ in want if n not in df.columns] + [f"unknown {n}" for n, _ in have if n not in self.names]
        faults += [f"{n} is {t}, not {dict(want)[n]}" for n, t in have if n in self.names and dict(want)[n] != t]
        return faults or ["columns out of order"]


def contract(name: str, columns: Mapping[str, str], key: tuple[str, ...] = ()) -> TableContract:
    """Shorthand: a trailing ``!`` on the kind marks a required column; key columns are required."""
    made = tuple(ContractColumn(n, k.rstrip("!"), not (k.endswith("!") or n in key)) for n, k in columns.items())
    return TableContract(name, made, key)
