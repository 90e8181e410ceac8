"""Run names read by their separators.

A name is a line of words: a time stamp, an experiment, a data part that
begins with ``DD-``, sizes, token counts and ``--key=value`` options. It is cut at its
separators and the pieces are told apart by what they consist of; a piece is
never searched by a pattern over the whole name.

Defined results: a part that a name does not have is NULL; of several
pieces that fit, the first counts (of options given twice the last); only the first
tuned-model part of a name is read; a NULL name has NULL parts and no options.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.numbers import finite_double, let, whole_number

_DIGITS = "0123456789"
# What stands before the data part, before a tuned model's data, and in names without a data part.
DATA_MARK, TUNED_MARK, OTHER_MARKS = "_DD-", "_Ft_DD-", ("_dd__", "_dolma", "_dclm")
# Marks of token counts (with and without epochs) and of options; option renamed.
TOKENS_EPOCHS, TOKENS, OPTION, RENAMED = "Mtx", "Mt", "--", {"learning_rate": "lr"}


def _lead(text: Column) -> Column:
    """The digits at the start of a piece."""
    return F.substring(text, F.lit(1), F.length(text) - F.length(F.ltrim(text, F.lit(_DIGITS))))


def _tail(text: Column) -> Column:
    """The digits at the end of a piece."""
    return F.substring(text, F.length(F.rtrim(text, F.lit(_DIGITS))) + 1, F.length(text))


def _after_digits(piece: Column) -> Column:
    """What follows the digits a piece begins with; NULL if it begins with none."""
    rest = F.ltrim(piece, F.lit(_DIGITS))
    return F.when(F.length(rest) < F.length(piece), rest)


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _is_size(piece: Column) -> Column:
    """``150M`` or ``1B``."""
    return _is(_after_digits(piece).isin("M", "B"))


def _has_size(piece: Column) -> Column:
    return _is(F.substring(_after_digits(piece), 1, 1).isin("M", "B"))


def _first(pieces: Column, fits: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(pieces, fits), F.lit(0))


def _rest(pieces: Column) -> Column:
    """All pieces but the first."""
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))


def _between(text: Column, mark: str) -> Column:
    """Text before the first ``mark`` that has something before it, NULL without one."""
    at = F.locate(mark, text, 2)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1))


def _stamp(name: Column) -> Column:
    """Length of the time stamp at the start (13 or 19), 0 without one."""
    shape = F.translate(F.substring(name, 1, 20), _DIGITS, "0" * 10)
    return F.when(shape.startswith("000000-000000_"), 13).when(shape == "0000_00_00-00_00_00_", 19).otherwise(0)


def run_time(name: Column) -> Column:
    """ISO time of the stamp: ``YYMMDD-HHMMSS`` or ``YYYY_MM_DD-HH_MM_SS``."""
    size = _stamp(name)
    digits = F.translate(F.substring(name, F.lit(1), size), "_-", "")
    whole = F.when(size == 13, F.concat(F.lit("20"), digits)).when(size == 19, digits)

    def written(d: Column) -> Column:
        pairs = [F.substring(d, k, 2) for k in (5, 7, 9, 11, 13)]
        return F.when(d.isNotNull(), F.concat(F.concat_ws("-", F.substring(d, 1, 4), *pairs[:2]), F.lit(" "), F.concat_ws(":", *pairs[2:])))

    return let(whole, written)


def experiment(name: Column) -> Column:
    """Words between the stamp and the data part, up to the first size or token count."""
    size = _stamp(name)
    body = F.substring(name, size + 2, F.length(name))
    other = F.array_min(F.filter(F.array(*[_between(F.when(size == 19, body), m) for m in OTHER_MARKS]), lambda t: t.isNotNull()))
    whole = F.when(size > 0, F.coalesce(_between(body, DATA_MARK), other))

    def named(text: Column) -> Column:
        words = F.split(text, "_", -1)
        sized = F.filter(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda k: _has_size(F.get(words, k - 1)))
        short = F.array_join(F.slice(words, F.lit(1), F.coalesce(F.get(sized, F.lit(0)) - 1, F.size(words))), "_")
        return F.when(short != "", short).otherwise(text)

    return let(whole, named)


def tuned_model(name: Column) -> Column:
    """struct(data, size, checkpoint) of a ``_Ft_DD-data-size-checkpoint-n`` part, NULL without one."""
    at = F.locate(TUNED_MARK, name)
    text = F.when(at > 0, F.substring(name, at + len(TUNED_MARK), F.length(name)))

    def read(t: Column) -> Column:
        pieces = F.split(F.translate(t, "_", "-"), "-", -1)
        # the data part holds no dash, so its words end before the first one
        last = F.size(F.split(F.substring_index(t, "-", 1), "_", -1))

        def fits(k: Column) -> Column:
            return _is_size(F.get(pieces, k)) & _is((_after_digits(F.get(pieces, k + 1)) == "") & _after_digits(F.get(pieces, k + 2)).isNotNull())

        found = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), fits)

        def parts(k: Column) -> Column:
            data = F.array_join(F.slice(pieces, F.lit(1), k), "_")
            return F.when(data != "", F.struct(data.alias("data"), F.get(pieces, k).alias("size"), F.get(pieces, k + 1).alias("checkpoint")))

        return let(F.array_max(found), lambda k: F.when(k.isNotNull(), parts(k)))

    return let(text, lambda t: F.when(t.isNotNull(), read(t)))


def plain_model(name: Column) -> Column:
    """struct(data, size, checkpoint) of a name without a tuned part: ``DD-data-size_checkpoint_10Mtx2``."""
    at = F.locate("DD-", name)
    marked = F.split(F.when(at > 0, F.substring(name, at + 3, F.length(name))), "-", -1)
    data = F.when((F.size(marked) > 1) & (F.get(marked, F.lit(0)) != ""), F.get(marked, F.lit(0)))
    dashed = _rest(F.split(name, "-", -1))
    sized = _first(dashed, lambda p: p.contains("_") & _is_size(F.substring_index(p, "_", 1)))

    def checkpoint(piece: Column) -> Column:
        words = F.split(piece, "_", -1)
        counts = F.filter(F.sequence(F.lit(2), F.greatest(F.size(words) - 1, F.lit(2))), lambda k: _is(_after_digits(F.get(words, k)).startswith(TOKENS_EPOCHS)))
        middle = F.array_join(F.slice(words, F.lit(2), F.array_max(counts) - 1), "_")
        return F.when(_is(_after_digits(F.get(words, F.lit(0))) == "M") & (middle != ""), middle)

    found = F.filter(F.transform(dashed, checkpoint), lambda c: c.isNotNull())
    return F.struct(data.alias("data"), F.substring_index(sized, "_", 1).alias("size"), F.get(found, F.lit(0)).alias("checkpoint"))


def token_counts(name: Column) -> Column:
    """struct(millions, epochs): ``100Mtx2`` anywhere, else ``__100Mt``."""
    pieces = F.split(name, TOKENS_EPOCHS, -1)
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _rest(pieces), lambda a, b: F.struct(_tail(a).alias("millions"), _lead(b).alias("epochs")))
    both = F.get(F.filter(pairs, lambda p: (p["millions"] != "") & (p["epochs"] != "")), F.lit(0))
    alone = _first(F.transform(_rest(F.split(name, "__", -1)), lambda p: F.substring_index(p, "_", 1)), lambda w: _is(_after_digits(w) == TOKENS))
    return F.struct(F.coalesce(both["millions"], _lead(alone)).try_cast("bigint").alias("millions"), both["epochs"].try_cast("bigint").alias("epochs"))


def typed_options(name: Column) -> Column:
    """Options as map(key, value): numbers in their shortest form (whole ones without fraction), other text as it is."""

    def pair(piece: Column) -> Column:
        at = F.instr(piece, "=")
        key = F.substring(piece, F.lit(1), at - 1)
        value = F.regexp_substr(F.substring(piece, at + 1, F.length(piece)), F.lit(r"^[^\s_]+"))
        renamed = key
        for old, new in RENAMED.items():
            renamed = F.when(renamed == old, new).otherwise(renamed)
        number = F.coalesce(whole_number(value).cast("string"), finite_double(value).cast("string"))
        return F.when((at > 1) & key.rlike(r"^\w+$"), F.struct(renamed.alias("k"), F.coalesce(number, value).alias("v")))

    given = F.filter(F.transform(_rest(F.split(F.coalesce(name, F.lit("")), OPTION, -1)), pair), lambda p: p["v"].isNotNull())
    last = F.filter(given, lambda p, k: ~F.exists(F.slice(given, k + 2, F.size(given)), lambda later: later["k"] == p["k"]))
    return F.map_from_entries(last)


def without_size(model: Column) -> Column:
    """A model's folder name without the size it may end with (``c4-60M`` gives ``c4``)."""
    size = F.substring_index(model, "-", -1)
    sized = model.contains("-") & _is_size(size) & (F.length(model) > F.length(size) + 1)
    short = F.when(sized, F.substring(model, F.lit(1), F.length(model) - F.length(size) - 1)).otherwise(model)
    return F.when(short != "", short)
