"""Rows that fail to parse: split raw CSV records into typed rows and findings.

Structure is judged on the quote-separated pieces of a record (one linear pass
of built-in array functions, no regular-expression backtracking). Values are
judged once per distinct value and column: the distinct values are counted with
a map-side aggregate (a value that a third of all rows share is one row per map task),
cast, and the bad ones kept with their reason as a dictionary in the checkpoint folder.
Rows are then parsed once for all outputs and looked up in the dictionary beside their
structural checks: its measured size decides between broadcast joins (no shuffle of
rows) and shuffle joins, whose hot values adaptive execution splits.

Defined results: every row is judged by itself, so rows without an id or with a
shared one keep their own outcome and a record written twice is judged twice; a NULL
record and an empty record have no 15 fields (``column_count``); extra columns of the
input are ignored; an empty table gives empty outputs. Ties cannot arise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import finite_double, let, strip_blanks, whole_number
from quern.session import checked_broadcast, stable_checkpoint

#: Column order of the scaling-law CSV files.
SCALING_COLUMNS = (
    "group", "model", "task", "chinchilla", "step", "tokens", "compute", "metrics",
    "eval/c4_en-validation/CrossEntropyLoss", "eval/dolma_common-crawl-validation/CrossEntropyLoss",
    "eval/pile-validation/CrossEntropyLoss", "eval/wikitext_103-validation/CrossEntropyLoss",
    "train/CrossEntropyLoss", "throughput/total_tokens", "seed",
)
#: Fixed value: seed of retired runs that is still a valid value in the raw files.
LEGACY_SEED = 6198
_COMMA, _MARK = "\u0001b", "\u0001"


@dataclass(frozen=True)
class ParsedRecords:
    """``findings``: (line_id, reason); ``rejected``: one row per bad record; ``valid``: typed rows."""

    findings: DataFrame
    rejected: DataFrame
    valid: DataFrame
    invalid_values: DataFrame


#: Value columns that are judged, each finding bearing the column's name.
JUDGED = ("step", "tokens", "compute", "seed")
#: Longest value that stands for itself in the dictionary.
KEY_CHARS = 64


def record_parts(line: Column) -> Column:
    """``struct(sound, parts)`` of one comma-separated record; ``bare_part`` reads a part.

    A NULL record counts as an empty one. ``sound`` is false when a quoted field is not closed, has text after its
    closing quote, or a bare quote stands in an unquoted field. ``parts`` holds the fields as
    written, with commas inside quotes replaced, and is meaningful only if ``sound``.
    """
    pieces = F.split(F.coalesce(line, F.lit("")), '"', -1)
    last = F.size(pieces) - 1

    def unsound(piece: Column, i: Column) -> Column:
        opens = piece.endswith(",")
        follows = piece.startswith(",")
        fine = (
            F.when(last == 0, F.lit(True))
            .when(i == 0, (piece == "") | opens)
            .when(i == last, (piece == "") | follows | piece.isin("\r", "\n", "\r\n"))
            .otherwise((piece == "") | (follows & opens))
        )
        return (i % 2 == 0) & ~fine

    sound = (last % 2 == 0) & ~F.exists(F.transform(pieces, unsound), lambda bad: bad)
    shielded = F.transform(
        pieces,
        lambda p, i: F.when((i % 2 == 0) | ~p.rlike(f"[,{_MARK}]"), p).otherwise(F.replace(F.replace(p, F.lit(_MARK), F.lit(_MARK + "a")), F.lit(","), F.lit(_COMMA))),
    )
    return F.struct(sound.alias("sound"), F.split(F.array_join(shielded, '"'), ",", -1).alias("parts"))


def bare_part(part: Column) -> Column:
    """A part of a record without its quotes."""
    closed = F.rtrim(part, F.lit("\r\n"))
    inner = F.replace(F.substring(closed, F.lit(2), F.length(closed) - 2), F.lit('""'), F.lit('"'))
    inner = F.replace(F.replace(inner, F.lit(_COMMA), F.lit(",")), F.lit(_MARK + "a"), F.lit(_MARK))
    return F.when(part.startswith('"'), inner).otherwise(part)


def record_fields(line: Column) -> Column:
    """``struct(sound, fields)``: ``record_parts`` with every field bare."""
    return let(record_parts(line), lambda r: F.named_struct(F.lit("sound"), r["sound"], F.lit("fields"), F.transform(r["parts"], bare_part)))


def _key(value: Column) -> Column:
    """What a value is looked up by: itself, or a digest where it is long, so that a dictionary row is small."""
    return F.when(F.char_length(value) > KEY_CHARS, F.concat(F.lit("#"), F.sha2(value, 256))).otherwise(value)


def _bad_values(distinct: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (name, key, value, records) of ``distinct`` whose value cannot be loaded; every value is cast once here."""
    whole = F.when(F.col("name") != "compute", whole_number(F.col("value")))
    amount = F.when(F.col("name") == "compute", finite_double(F.col("value")))
    cast = distinct.select("*", whole.alias("whole"), amount.alias("amount"))
    looked_up = cast.join(checked_broadcast(known.distinct()), (F.col("name") == "seed") & (F.col("whole") == F.col("known")), "left")
    blank = F.col("value") == ""
    good = (
        F.when(F.col("name") == "compute", blank | F.coalesce(F.col("amount") >= 0, F.lit(False)))
        .when(F.col("name") == "seed", blank | F.col("known").isNotNull())
        .otherwise((blank & (F.col("name") == "tokens")) | F.coalesce(F.col("whole") >= 0, F.lit(False)))
    )
    return looked_up.where(~good).select("name", "key", "value", "records")


def parse_records(
    lines: DataFrame,
    seeds: DataFrame,
    *,
    id_col: str = "line_id",
    line_col: str = "raw_line",
    columns: tuple[str, ...] = SCALING_COLUMNS,
    extra_seeds: tuple[int, ...] = (LEGACY_SEED,),
    max_broadcast: int = 100_000,
) -> ParsedRecords:
    """Separate the records of ``lines`` that cannot be loaded from those that can.

    ``seeds`` needs ``seed_value``; it is a lookup table. Reasons: ``quoting``,
    ``column_count``, or the name of a bad value column, one finding each. Runs the
    query that builds the dictionary.
    """
    width = len(columns)
    at = {c: columns.index(c) for c in columns}
    # exploded, so that no later step repeats the splitting
    records = lines.select(F.col(id_col).alias("line_id"), F.col(line_col).alias("raw_line")).select("*", F.explode(F.array(record_parts(F.col("raw_line")))).alias("r"))
    shape = F.when(~F.col("r.sound"), "quoting").when(F.size("r.parts") != width, "column_count")
    shaped = records.select("line_id", "raw_line", shape.alias("shape"), F.col("r.parts").alias("parts"))
    text = {c: bare_part(F.get("parts", F.lit(at[c]))) for c in columns}
    value = {c: strip_blanks(text[c]) for c in JUDGED}

    cells = shaped.where("shape IS NULL").select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), v.alias("value")) for c, v in value.items()])).alias("cell"))
    distinct = cells.groupBy("cell.name", "cell.value").agg(F.count(F.lit(1)).alias("records")).select("name", _key(F.col("value")).alias("key"), "value", "records")
    known = seeds.select(F.col("seed_value").cast("bigint").alias("known")).where("known IS NOT NULL")
    if extra_seeds:
        known = known.union(seeds.sparkSession.createDataFrame([(s,) for s in extra_seeds], "known bigint"))
    invalid = stable_checkpoint(_bad_values(distinct, known))
    few = F.broadcast if invalid.count() <= max_broadcast else lambda df: df

    judged = shaped.select("*", *[F.when(F.col("shape").isNull(), _key(v)).alias(f"_{c}") for c, v in value.items()])
    for c in JUDGED:
        bad = invalid.where(F.col("name") == c).select(F.col("key").alias(f"_{c}"), F.lit(c).alias(f"bad_{c}"))
        judged = judged.join(few(bad), f"_{c}", "left")
    judged = judged.select("line_id", "raw_line", "parts", F.array_compact(F.array("shape", *[f"bad_{c}" for c in JUDGED])).alias("reasons"))

    typed = {"step": whole_number, "tokens": whole_number, "seed": whole_number, "compute": finite_double, "throughput/total_tokens": finite_double}
    typed |= {c: finite_double for c in columns if c.endswith("CrossEntropyLoss")}
    return ParsedRecords(
        findings=judged.select("line_id", F.explode("reasons").alias("reason")),
        rejected=judged.where(F.size("reasons") > 0).select("line_id", "raw_line", F.sort_array("reasons").alias("reasons")),
        valid=judged.where(F.size("reasons") == 0).select("line_id", *[typed.get(c, strip_blanks)(text[c]).alias(plain_name(c)) for c in columns]),
        invalid_values=invalid.select("name", "value", "records"),
    )


def plain_name(name: str) -> str:
    """Output name of a raw column."""
    return name.replace("/", "_").replace("-", "_").lower().replace("crossentropyloss", "cross_entropy")
