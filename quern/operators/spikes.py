"""Implausible spikes in measurements, judged per source by its own course.

Every (source, field) is a series with a robust autoregression of its own: the
coefficients solve the Yule-Walker equations of quadrant autocorrelations (signs of the
changes against the local Theil-Sen slope), which single wild readings cannot
move. The residual of a reading against the autoregression of the readings before it
tells where the series is left, the residual against that of the readings after it
(run backwards) where it comes back. Residuals of one sign at the start and at the end of
a block of readings make it an additive outlier; a jump without its return is a level
shift and no finding. An exact check of each block follows: all its readings must
leave the course, interpolated between local regressions of both sides, by more than
``limit`` times the series' usual scatter, and each one-sided course by ``edge`` times, and the
block must begin and end in one step. Found blocks are taken out and both tests repeated
until nothing new is found, so spikes do not hide behind each other. Stuck runs (three
or more equal readings) and values outside the physical range are separated first.

Scale: all series of an Arrow batch are judged at once in numpy. A source may hold a
third of all rows: series of sources beyond ``segment`` readings are cut at
approximate quantiles of time, refined until a piece holds about ``segment`` readings,
and each piece is judged with its two neighbours as context, so no task ever holds
more than three pieces. The usual scatter, the even count and the autocorrelations are
figures of the whole series at every length: a first pass forms their parts per piece
(exact medians, sums of signs), and every piece is judged by them. A spike is at most
``longest`` readings long at every length of series.

Defined results: NULL readings are skipped, NaN and infinite ones are limit
findings; deliveries of one row_id count once (the latest arrival); rows with
a NULL source or row_id are left out; readings with a NULL time have no place in a
course and get limit findings only; equal times are ordered by row_id; series with fewer
than three usable readings get limit and stuck findings only; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import micros
from quern.session import checked_broadcast, ship_package, stable_checkpoint

#: Field name to the kind of series: a loss is positive, a count runs evenly and is not negative.
LOSS_FIELDS = {"train_cross_entropy": "loss", "c4_en_validation_cross_entropy": "loss", "step": "count"}
#: Readings on each side that a prediction rests on.
REACH = 5
#: Longest spike, in readings in a row: what "a few readings" means.
LONGEST = 12
#: Order of the autoregression of the changes.
ORDER = REACH - 1
#: Part of a spike's deviation that its first and last step must make up.
STEP_SHARE = 0.7
#: Part of the largest deviation of a spike of many readings that these steps must make up: a bump swells, a spike stands.
TOP_SHARE = 0.5
_MAD = 1.4826
#: Figures of a whole series that its parts are judged by: medians, and sums of sign products and their numbers by lag.
MEDIANS = ("off", "bend", "level", "step")
SUMS = tuple(f"{what}{k}" for k in range(1, ORDER + 1) for what in ("signs", "pairs"))
FIGURES = (*MEDIANS, *SUMS)
FINDING = "row_id long, field_name string, kind string"
_KINDS = np.array(["", "limit", "stuck", "spike"], object)


def _sides(y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, centre, slope) fitted to the readings before and after each one, as two 3 x n arrays.

    The level is a median, the slope the median of pairwise slopes (Theil-Sen); a side
    with one reading borrows the slope of the other.
    """
    n = len(y)
    pad = np.full(REACH, np.nan)
    window = np.lib.stride_tricks.sliding_window_view

    def fit(v: np.ndarray, at: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            slopes = np.stack([(v[:, i] - v[:, j]) / (at[:, i] - at[:, j]) for i in range(REACH) for j in range(i)], axis=1)
        return np.stack([_median(v), _median(at), _median(slopes)])

    left = fit(window(np.concatenate([pad, y]), REACH)[:n], window(np.concatenate([pad, t]), REACH)[:n])
    right = fit(window(np.concatenate([y, pad]), REACH)[1 : n + 1], window(np.concatenate([t, pad]), REACH)[1 : n + 1])
    for own, other in ((left, right), (right, left)):
        own[2] = np.nan_to_num(np.where(np.isnan(own[2]), other[2], own[2]))
    return left, right


def _leaves(y: np.ndarray, t: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deviations of readings ``at`` from the interpolated, forward and backward course."""
    when = t[at]
    forward = left[0] + left[2] * (when - left[1])
    backward = right[0] + right[2] * (when - right[1])
    with np.errstate(all="ignore"):
        between = left[0] + (right[0] - left[0]) * (when - left[1]) / (right[1] - left[1])
    return y[at] - between, y[at] - forward, y[at] - backward


def _median(a: np.ndarray) -> np.ndarray:
    """Row medians without NaN; NaN for empty rows. Faster than ``nanmedian`` on narrow rows."""
    ordered = np.sort(a, axis=1)  # NaN last
    count = (~np.isnan(a)).sum(axis=1)
    rows = np.arange(len(a))
    lo, hi = ordered[rows, np.maximum((count - 1) // 2, 0)], ordered[rows, np.maximum(count // 2, 0) % a.shape[1]]
    return np.where(count > 0, (lo + hi) / 2, np.nan)


def _edges(y: np.ndarray, t: np.ndarray, left: np.ndarray, right: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether readings lo..hi depart from and return to the course in one step each, and the smaller of the steps.

    ``left`` and ``right`` are those of lo and of hi. A step, less the course's own slope,
    must make up most of the deviation there.
    """
    out, _, _ = _leaves(y, t, left, right, lo)
    back, _, _ = _leaves(y, t, left, right, hi)
    leave = (y[lo] - y[lo - 1] - left[2] * (t[lo] - t[lo - 1])) * np.sign(out)
    enter = (y[hi] - y[hi + 1] + right[2] * (t[hi + 1] - t[hi])) * np.sign(back)
    with np.errstate(invalid="ignore"):
        return (leave >= STEP_SHARE * np.abs(out)) & (enter >= STEP_SHARE * np.abs(back)), np.fmin(leave, enter)


class Batch:
    """Several series of one field laid end to end, each in time order.

    ``x``: values; ``sid``: series of each, ascending from 0. Windows never reach into
    another series: ``REACH`` empty places stand behind each.
    """

    def __init__(self, x: np.ndarray, sid: np.ndarray, kind: str) -> None:
        self.x, self.sid, self.kind = x, sid, kind
        self.count = int(sid[-1]) + 1 if len(sid) else 0
        self.starts = np.searchsorted(sid, np.arange(self.count))
        self.place = np.arange(len(x)) - self.starts[sid] if len(x) else np.zeros(0, np.int64)
        self.code = self._separated()
        self.level = x

    def _separated(self) -> np.ndarray:
        """Codes of the stuck (2) and impossible (1) readings; 0 for those that follow a course."""
        x = self.x
        same = np.zeros(len(x), bool)
        same[1:] = (x[1:] == x[:-1]) & (self.sid[1:] == self.sid[:-1])
        run = np.cumsum(~same)
        code = np.where(same & (np.bincount(run, minlength=1)[run] >= 3), 2, 0).astype(np.int8)
        code[~np.isfinite(x) | (x <= 0 if self.kind == "loss" else x < 0)] = 1
        return code

    def lay(self, series: np.ndarray) -> None:
        """Lay out the readings without findings of the given series."""
        live = np.flatnonzero((self.code == 0) & series[self.sid])
        self.live, self.of = live, self.sid[live]
        number = np.cumsum(np.concatenate([[False], self.of[1:] != self.of[:-1]])) if len(live) else np.zeros(0, np.int64)
        self.at = np.arange(len(live)) + REACH * (number + 1)  # place of each reading in the padded arrays
        size = len(live) + REACH * (int(number[-1]) + 2 if len(live) else 1)
        self.y, self.t = np.full(size, np.nan), np.full(size, np.nan)
        self.y[self.at], self.t[self.at] = self.level[live], self.place[live]
        first = np.flatnonzero(np.concatenate([[True], self.of[1:] != self.of[:-1]])) if len(live) else np.zeros(0, np.int64)
        length = np.diff(np.concatenate([first, [len(live)]]))
        self.before = np.arange(len(live)) - np.repeat(first, length)  # readings before it in its series
        self.after = np.repeat(length, length) - 1 - self.before
        self.left, self.right = _sides(self.y, self.t)

    def _changes(self, lag: int, slope: np.ndarray, backward: bool = False) -> np.ndarray:
        """Change ``lag`` readings ago, less what the course's slope explains."""
        step = -1 if backward else 1
        near, far = self.at - step * lag, self.at - step * (lag + 1)
        return self.y[near] - self.y[far] - slope * (self.t[near] - self.t[far])

    def figures(self, own: np.ndarray | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """(series, value) parts of every figure, from the readings laid out (the ``own`` ones of them)."""
        mine = np.ones(len(self.live), bool) if own is None else own[self.live]
        follows = self.before > 0
        at, y, t = self.at, self.y, self.t
        if self.kind == "count":
            parts = {"step": (follows, (y[at] - y[at - 1]) / (t[at] - t[at - 1]))}
        else:
            off, _, _ = _leaves(y, t, self.left[:, at], self.right[:, at], at)
            parts = {"off": (~np.isnan(off), np.abs(off)), "bend": (follows & (self.after > 0), np.abs(y[at] - (y[at - 1] + y[at + 1]) / 2)), "level": (mine, np.abs(y[at]))}
            slope = (self.left[2, at] + self.right[2, at]) / 2  # of both sides: that of one would be made of these very changes
            now = np.sign(self._changes(0, slope))
            for lag in range(1, ORDER + 1):
                product = now * np.sign(self._changes(lag, slope))
                some = np.nan_to_num(product) != 0
                parts[f"signs{lag}"], parts[f"pairs{lag}"] = (some, product), (some, np.ones(len(product)))
        return {name: (self.of[use & mine], value[use & mine]) for name, (use, value) in parts.items()}

    def residuals(self, weights: np.ndarray, backward: bool) -> np.ndarray:
        """Residuals of the autoregression; terms before the series' start are missing."""
        slope = (self.right if backward else self.left)[2, self.at]
        out = self._changes(0, slope, backward)
        for lag in range(1, ORDER + 1):
            out = out - weights[self.of, lag - 1] * np.nan_to_num(self._changes(lag, slope, backward))
        return out


def _gathered(parts: Mapping[str, tuple[np.ndarray, np.ndarray]], count: int) -> dict[str, np.ndarray]:
    """Figures of each series from their parts."""
    out = {}
    for name, (series, value) in parts.items():
        if name in MEDIANS:
            order = np.lexsort((value, series))
            series, value = series[order], value[order]
            lo, hi = np.searchsorted(series, np.arange(count)), np.searchsorted(series, np.arange(count), "right")
            size, some = hi - lo, hi > lo
            out[name] = np.full(count, np.nan)
            out[name][some] = (value[(lo + (size - 1) // 2)[some]] + value[(lo + size // 2)[some]]) / 2
        else:
            out[name] = np.bincount(series, value, count)
    return out


def autoregression(figures: Mapping[str, np.ndarray]) -> np.ndarray:
    """Coefficients (series x ORDER) from the sign products: Yule-Walker on quadrant autocorrelations.

    The ridge keeps the equations sound where few pairs were seen; without any pair all are 0.
    """
    shares = np.stack([figures[f"signs{k}"] / np.maximum(figures[f"pairs{k}"], 1) for k in range(1, ORDER + 1)], axis=1)
    rho = np.sin(np.pi / 2 * shares)
    lags = np.abs(np.subtract.outer(np.arange(ORDER), np.arange(ORDER)))
    full = np.concatenate([np.full((len(rho), 1), 1.2), rho], axis=1)
    return np.clip(np.linalg.solve(full[:, lags], rho[:, :, None])[:, :, 0], -1, 1)


def judge(batch: Batch, limit: float = 10.0, edge: float = 5.0, longest: int = LONGEST, figures: Mapping[str, np.ndarray] | None = None) -> np.ndarray:
    """Codes of all readings of a batch: 0 fine, 1 limit, 2 stuck, 3 spike.

    ``figures`` (one value a series) are those of whole series where the batch holds parts of them.
    """
    count = batch.count
    if not count:
        return batch.code
    active = np.ones(count, bool)
    if figures is None or batch.kind == "count":
        batch.lay(active)
    if figures is None:
        figures = _gathered(batch.figures(), count)
    if batch.kind == "count":  # deviation from an even count; a restart is a shift of level
        batch.level = batch.x - np.nan_to_num(figures["step"])[batch.sid] * batch.place
        # an even count has no scatter and no course but its slope: a quarter is off it
        scatter, floor, weights = np.zeros(count), np.full(count, 0.25), np.zeros((count, ORDER))
    else:
        scatter = _MAD * np.nan_to_num(figures["off"])
        floor = 1e-9 * np.fmax(1.0, figures["level"])
        # The course's bend inflates this. Second differences are free of it, but
        # blind to slow noise, so they may lower the scatter by a quarter at most.
        scatter = np.fmin(scatter, np.fmax(_MAD * figures["bend"] / np.sqrt(1.5), 0.75 * scatter))
        weights = autoregression(figures)
    while active.any():  # every round takes readings out, so it ends
        batch.lay(active)
        wide, near, leave = ((factor * scatter + floor)[batch.of] for factor in (limit, edge, edge / 2))
        with np.errstate(invalid="ignore"):
            out = batch.residuals(weights, backward=False)
            back = batch.residuals(weights, backward=True)
            out, back = np.where(np.abs(out) > leave, np.sign(out), 0), np.where(np.abs(back) > leave, np.sign(back), 0)
        hit = np.zeros(len(batch.live), bool)
        found = np.zeros(count, bool)
        for size in range(1, min(longest, len(out)) + 1):
            # Additive outlier: left at its first reading, returned from at its last, to the same side,
            # with at least as many readings before and after it as it has itself.
            begin = np.flatnonzero((out[: len(out) - size + 1] * back[size - 1 :] > 0) & (batch.before[: len(out) - size + 1] >= size) & (batch.after[: len(out) - size + 1] >= 2 * size - 1))
            begin = begin[~found[batch.of[begin]]]  # a series with shorter spikes is laid out without them first
            if not len(begin):
                continue
            lo, hi = batch.at[begin], batch.at[begin + size - 1]
            left, right = batch.left[:, lo], batch.right[:, hi]
            abrupt, step = _edges(batch.y, batch.t, left, right, lo, hi)
            up, down = abrupt, abrupt
            for k in range(size):
                a, b, c = _leaves(batch.y, batch.t, left, right, lo + k)
                top = np.fmax(np.abs(a), top) if k else np.abs(a)
                with np.errstate(invalid="ignore"):
                    up = up & (a > wide[begin]) & (b > near[begin]) & (c > near[begin])
                    down = down & (a < -wide[begin]) & (b < -near[begin]) & (c < -near[begin])
            # the more readings, the more of the whole rise the steps must make up: nothing of two, a quarter of three, half from five on
            share = min(TOP_SHARE, (size - 2) / (size + 1)) if size > 2 else 0.0
            good = begin[(up | down) & (step >= share * top)]
            found[batch.of[good]] = True
            hit[(good[:, None] + np.arange(size)).ravel()] = True
        batch.code[batch.live[hit]] = 3
        active = found
    return batch.code


def judge_series(x: np.ndarray, kind: str, limit: float = 10.0, edge: float = 5.0, longest: int = LONGEST) -> np.ndarray:
    """``judge`` for one series."""
    return judge(Batch(x, np.zeros(len(x), np.int64), kind), limit, edge, longest)


def _findings(fields: Mapping[str, str], limit: float, longest: int):
    """Findings of whole series: one value column per field."""

    def judged(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        ids, names, kinds = [], [], []
        row_id = table.column("row_id").to_numpy()
        series = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for k, (field, kind) in enumerate(fields.items()):
            value = table.column(f"v_{k}").combine_chunks()
            at = np.flatnonzero(~np.asarray(value.is_null().to_numpy(zero_copy_only=False)))
            _, sid = np.unique(series[at], return_inverse=True)
            code = judge(Batch(value.drop_null().to_numpy(), sid, kind), limit, longest=longest)
            hit = np.flatnonzero(code)
            ids.append(row_id[at[hit]])
            names += [field] * len(hit)
            kinds.append(_KINDS[code[hit]])
        return _finding_batch(ids, names, kinds)

    return judged


def _finding_batch(ids: list[np.ndarray], names: list[str], kinds: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(flat, pa.int64()), pa.array(names, pa.string()), pa.array(np.concatenate(kinds).tolist() if kinds else [], pa.string())], names=["row_id", "field_name", "kind"])


def _pieces(table: pa.Table, bounds: np.ndarray, fields: Mapping[str, str]) -> Iterator[tuple[str, Batch, np.ndarray, np.ndarray]]:
    """(field, batch, rows, piece of each series) of the pieces of each field of a table in long form."""
    value, of = table.column("value").to_numpy(), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    names = np.array(table.column("field").take(pa.array(bounds[:-1])).to_pylist(), object)
    for field, kind in fields.items():
        rows = np.flatnonzero((names == field)[of])
        piece, sid = np.unique(of[rows], return_inverse=True)
        yield field, Batch(value[rows], sid, kind), rows, piece


def _piece_findings(fields: Mapping[str, str], limit: float, longest: int):
    def judged(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        ids, names, kinds = [], [], []
        row_id, own = table.column("row_id").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        known = table.column("figures").take(pa.array(bounds[:-1])).combine_chunks()
        for field, batch, rows, piece in _pieces(table, bounds, fields):
            figures = {f: pa.compute.struct_field(known, f).to_numpy(zero_copy_only=False).astype(float)[piece] for f in FIGURES}
            figures |= {f: np.nan_to_num(figures[f]) for f in SUMS}
            code = judge(batch, limit, longest=longest, figures=figures)
            hit = np.flatnonzero((code > 0) & own[rows])
            ids.append(row_id[rows[hit]])
            names += [field] * len(hit)
            kinds.append(_KINDS[code[hit]])
        return _finding_batch(ids, names, kinds)

    return judged


def _measured(fields: Mapping[str, str]):
    def parts(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        origins = np.array(table.column("source").take(pa.array(bounds[:-1])).to_pylist(), object)
        own = table.column("own").to_numpy(zero_copy_only=False)
        sources, names, figures, values = [], [], [], []
        for field, batch, rows, piece in _pieces(table, bounds, fields):
            batch.lay(np.ones(batch.count, bool))
            for figure, (series, value) in batch.figures(own[rows]).items():
                if figure in SUMS:  # one part a piece
                    some = np.unique(series)
                    series, value = some, np.bincount(series, value, batch.count)[some]
                sources.append(origins[piece[series]])
                names += [field] * len(value)
                figures += [figure] * len(value)
                values.append(value)
        flat = lambda chunks, kind: pa.array(np.concatenate(chunks).tolist() if chunks else [], kind)
        return pa.RecordBatch.from_arrays([flat(sources, pa.string()), pa.array(names, pa.string()), pa.array(figures, pa.string()), flat(values, pa.float64())], names=["source", "field", "figure", "value"])

    return parts


def _series_runner(work):
    """mapInArrow function over partitions sorted by series; a series may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            series = table.column("series").to_numpy()
            return work(table, np.concatenate([[0], np.flatnonzero(series[1:] != series[:-1]) + 1, [table.num_rows]]).astype(np.int64))

        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            series = batch.column("series").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(series[1:] != series[:-1]) + 1
            first_is_new = last is not None and series[0] != last
            last = series[-1]
            if first_is_new:
                yield flush()
                held = []
            if len(cuts):
                held.append(batch.slice(0, int(cuts[-1])))
                yield flush()
                held = [batch.slice(int(cuts[-1]))]
            else:
                held.append(batch)
        if held:
            yield flush()

    return run


def exact_medians(rows: DataFrame, key: list[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """key, median: exact for groups of any size.

    A quantile sketch (rank error at most 1 / accuracy) bounds the middle; only distinct
    values between its bounds are ordered, the ones below count at the lower bound.
    """
    share = [0.5 - 3 / accuracy, 0.5 + 3 / accuracy]
    bounds = rows.groupBy(*key).agg(F.count(value).alias("n"), F.percentile_approx(value, share, accuracy).alias("b"))
    middle = rows.join(bounds, key).where(F.col(value) <= F.col("b")[1]).groupBy(*key, "n", F.greatest(F.col(value), F.col("b")[0]).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    seen = middle.withColumn("upto", F.sum("c").over(Window.partitionBy(*key).orderBy("v")))
    at = [F.min(F.when(F.col("upto") > F.floor((F.col("n") - k) / 2), F.col("v"))) for k in (1, 0)]
    return seen.groupBy(*key).agg(((at[0] + at[1]) / 2).alias("median"))


def _impossible(value: Column, kind: str) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf")) | (value <= 0 if kind == "loss" else value < 0)


def find_spikes(
    readings: DataFrame,
    fields: Mapping[str, str] = LOSS_FIELDS,
    *,
    source: Column | str = "run_id",
    id_col: str = "row_id",
    time_col: str = "logged_at",
    arrival_col: str = "arrived_at",
    limit: float = 10.0,
    longest: int = LONGEST,
    segment: int = 20_000,
) -> DataFrame:
    """(row_id, field_name, kind) of implausible readings; kind is limit, stuck or spike.

    Counts the readings per source first (one query), to know whether any must be cut.
    """
    ship_package(readings.sparkSession)
    types = dict(readings.dtypes)
    origin = F.col(source) if isinstance(source, str) else source
    names = [f"v_{k}" for k in range(len(fields))]
    rows = readings.select(
        origin.cast("string").alias("source"), F.col(id_col).cast("bigint").alias("row_id"),
        micros(time_col, types[time_col]).alias("t"), micros(arrival_col, types[arrival_col]).alias("arrived"),
        *[F.col(f).cast("double").alias(v) for f, v in zip(fields, names, strict=True)],
    ).where("source IS NOT NULL AND row_id IS NOT NULL")
    once = rows.groupBy("row_id").agg(F.max(F.struct(F.coalesce("arrived", F.lit(-(2**63))).alias("arrived"), "source", "t", *names)).alias("r")).select("row_id", "r.*").drop("arrived")
    cells = F.array(*[F.when(_impossible(F.col(v), kind), F.lit(f)) for (f, kind), v in zip(fields.items(), names, strict=True)])
    timeless = once.where("t IS NULL").select("row_id", F.explode(F.array_compact(cells)).alias("field_name"), F.lit("limit").alias("kind"))
    timed = once.where("t IS NOT NULL")
    counted = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > segment)
    largest = counted.agg(F.max("n")).first()[0]
    whole = timed
    if largest:
        heavy = checked_broadcast(counted.select("source"))
        whole = timed.join(heavy, "source", "left_anti")
    series = whole.select(F.xxhash64("source").alias("series"), "source", "t", "row_id", *names).repartition("source").sortWithinPartitions("series", "source", "t", "row_id")
    found = series.select("series", "row_id", *names).mapInArrow(_series_runner(_findings(dict(fields), limit, longest)), FINDING)
    if largest:
        found = found.unionByName(_cut_findings(timed.join(heavy, "source", "left_semi"), fields, limit, longest, segment, largest))
    return found.unionByName(timeless)


#: Pieces that a piece of a long series is cut into at a time.
_FAN = 64


def _cut_findings(rows: DataFrame, fields: Mapping[str, str], limit: float, longest: int, segment: int, largest: int) -> DataFrame:
    """Findings in series that are cut into pieces of about ``segment`` readings."""
    long = (
        rows.select("row_id", "source", "t", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v_{k}").alias("value")) for k, f in enumerate(fields)])).alias("c"))
        .select("row_id", "source", "t", "c.field", "c.value", F.lit(0).cast("bigint").alias("piece"))
        .where("value IS NOT NULL")
    )
    span = 1
    # Each level cuts every piece that is still too long at quantiles of time; the pieces keep their order.
    while span * segment < largest:
        long, span = _refined(long, segment), span * _FAN
    long = stable_checkpoint(long)
    key = ["source", "field"]
    ends = long.groupBy(*key, "piece").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*key).orderBy("piece")  # one row per piece
    around = ends.select(*key, "piece", F.array_compact(F.array(F.lag("piece").over(order), F.col("piece"), F.lead("piece").over(order))).alias("targets"))
    spread = (
        long.join(around, [*key, "piece"]).withColumn("at", F.explode("targets"))
        .select(F.xxhash64(*key, "at").alias("series"), *key, "at", "t", "row_id", "value", (F.col("at") == F.col("piece")).alias("own"))
    )
    by = ["series", *key, "at", "t", "row_id"]
    parts = stable_checkpoint(spread.repartition(*key, "at").sortWithinPartitions(*by).select("series", *key, "row_id", "own", "value").mapInArrow(_series_runner(_measured(dict(fields))), "source string, field string, figure string, value double"))
    medians = exact_medians(parts.where(F.col("figure").isin(*MEDIANS)), [*key, "figure"], "value")
    sums = parts.where(F.col("figure").isin(*SUMS)).groupBy(*key, "figure").agg(F.sum("value").alias("median"))
    figures = medians.unionByName(sums).groupBy(*key).agg(F.struct(*[F.max(F.when(F.col("figure") == f, F.col("median"))).alias(f) for f in FIGURES]).alias("figures"))
    guided = spread.join(checked_broadcast(figures), key, "left").repartition(*key, "at").sortWithinPartitions(*by)
    return guided.select("series", "field", "row_id", "own", "value", "figures").mapInArrow(_series_runner(_piece_findings(dict(fields), limit, longest)), FINDING)


def _refined(long: DataFrame, segment: int) -> DataFrame:
    """Every piece beyond ``segment`` readings cut at up to ``_FAN - 1`` quantiles of time."""
    key = ["source", "field", "piece"]
    marks = F.percentile_approx("t", [k / _FAN for k in range(1, _FAN)], 10_000)
    step = F.greatest(F.lit(1), F.floor(F.lit(_FAN) / F.ceil(F.col("n") / segment))).cast("int")
    cuts = long.groupBy(*key).agg(marks.alias("marks"), F.count(F.lit(1)).alias("n")).where(F.col("n") > segment)
    kept = cuts.select(*key, F.array_distinct(F.filter("marks", lambda m, i: (i + 1) % step == 0)).alias("cuts"))
    part = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda m: m <= F.col("t"))))
    return long.join(checked_broadcast(kept), key, "left").withColumn("piece", F.col("piece") * _FAN + part).drop("cuts")
