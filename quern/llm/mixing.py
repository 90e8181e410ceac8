"""Mixing sources to target weights, measured in tokens.

Tokens are summed per source (one pass, map-side combined to a row per source).
The mix is as large as it can be with every source at its share: its size is
the smallest of cap x tokens / share over the sources. The repetition rate of a
source is share x size / tokens; each document is emitted floor(rate) times, plus
once more with the probability of the fraction, drawn from a hash of its id and
a seed, so every run and every retry emits the same copies.

The mix itself reads the corpus a second time instead of carrying its texts
through a shuffle: only the per-source rates (as many rows as there are targets) are joined.

Defined results: source names are compared without case, outer blanks and
separators; targets that spell one source twice add up, with the smaller cap; a
source without a target is left out; a target without tokens is reported with
share 0 and its weight goes to the others in proportion; a NULL or negative share
is 0, a NULL cap is 1; NULL and blank texts weigh 0 or few tokens and follow their source;
each input row is a document, so equal texts under two ids count twice; no
targets or no documents give an empty mix; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quern.llm.tokens import TOKENIZER, count_tokens
from quern.session import stable_checkpoint


def _all() -> WindowSpec:
    """One window over the targets, of which there is a row each."""
    return Window.partitionBy(F.lit(0))


def source_name(source: Column) -> Column:
    """A source name in lower case with single underscores between its words."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"[\s_\-]+", "_"), r"^_+|_+$", "")


def mix_rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Repetition rates per target source.

    ``sizes``: (source, n_tokens) rows, aggregated here. ``total_tokens`` asks
    for another size than the largest one that meets every share; a source that
    cannot fill its part then stops at its cap. Columns: source, target_share,
    aim_share (among sources that have tokens), max_repeats, documents, tokens, rate.
    """
    wanted = (
        targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("s"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)), F.lit(0)).alias("m"))
        .where("source IS NOT NULL")
        .groupBy("source")
        .agg(F.sum("s").alias("target_share"), F.min("m").alias("max_repeats"))
    )
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    joined = wanted.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    weight = F.when(usable, F.col("target_share")).otherwise(0.0)
    aimed = joined.withColumn("aim_share", F.coalesce(F.try_divide(weight, F.sum(weight).over(_all())), F.lit(0.0)))
    largest = F.min(F.when(F.col("aim_share") > 0, F.col("max_repeats") * F.col("tokens") / F.col("aim_share"))).over(_all())
    size = largest if total_tokens is None else F.lit(float(total_tokens))
    rate = F.when(F.col("aim_share") > 0, F.least(F.col("max_repeats").cast("double"), F.col("aim_share") * size / F.col("tokens"))).otherwise(0.0)
    return aimed.select("source", "target_share", "aim_share", "max_repeats", "documents", "tokens", rate.alias("rate"))


def copies(doc_id: Column, rate: Column, seed: int) -> Column:
    """floor(rate) copies plus one with probability of the fraction, fixed by id and seed."""
    draw = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


#: Targets up to which their names and rates are broadcast.
MAX_TARGETS = 10_000


def _sender(targets: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``F.broadcast`` where the targets are measured to be few, else nothing: names and rates have at most a row per target."""
    return F.broadcast if targets.limit(MAX_TARGETS + 1).count() <= MAX_TARGETS else lambda df: df


def _wanted(targets: DataFrame) -> DataFrame:
    return targets.select(source_name(F.col("source")).alias("source")).where("source IS NOT NULL").distinct()


def _rates(documents: DataFrame, targets: DataFrame, total_tokens: int | None, tokenizer: str, counts: DataFrame | None, send: Callable[[DataFrame], DataFrame]) -> DataFrame:
    if counts is None:
        mixed = documents.select(source_name(F.col("source")).alias("source"), "text").join(send(_wanted(targets)), "source", "left_semi")
        counts = count_tokens(mixed, {"source": F.col("source")}, tokenizer=tokenizer)
    return mix_rates(counts, targets, total_tokens)


def mix_documents(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER, counts: DataFrame | None = None) -> DataFrame:
    """The mix: (doc_id, source, copy, text), one row per emitted copy."""
    send = _sender(targets)
    rates = _rates(documents, targets, total_tokens, tokenizer, counts, send).where("rate > 0").select("source", "rate")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    drawn = rows.join(send(rates), "source")
    n = copies(F.col("doc_id"), F.col("rate"), seed)
    return drawn.where(n > 0).select("doc_id", "source", F.explode(F.sequence(F.lit(1), n)).alias("copy"), "text")


def mix_shares(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """What the mix really reaches per target source.

    Token counts are checkpointed (ids and numbers, no texts) because the rates
    and the copies both need them.
    """
    send = _sender(targets)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text").join(send(_wanted(targets)), "source", "left_semi")
    counts = stable_checkpoint(count_tokens(rows, {"doc_id": F.col("doc_id"), "source": F.col("source")}, tokenizer=tokenizer))
    rates = mix_rates(counts, targets, total_tokens)
    used = counts.join(send(rates.select("source", "rate")), "source").select("source", "n_tokens", copies(F.col("doc_id"), F.col("rate"), seed).alias("n"))
    per_source = used.groupBy("source").agg(F.sum("n").alias("mixed_documents"), F.sum(F.col("n") * F.col("n_tokens")).alias("mixed_tokens"), F.max("n").alias("most_copies"))
    filled = rates.join(per_source, "source", "left").withColumn("all_tokens", F.sum("mixed_tokens").over(_all()))
    return filled.select(
        "source", "target_share", "aim_share", "max_repeats", "documents", "tokens", "rate",
        F.coalesce("mixed_documents", F.lit(0)).alias("mixed_documents"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.try_divide("mixed_tokens", "all_tokens"), F.lit(0.0)).alias("reached_share"),
    )
