"""Deeply nested JSON records into linked flat rows by structural indexing.

The payloads of an Arrow batch are laid end to end in one byte buffer. Bitmaps
of unescaped quotes, brackets and delimiters are built for the whole buffer with
numpy; a prefix sum over quote bits tells what lies inside strings, a prefix
sum over brackets gives the nesting depth, and from depth every token finds its
container. Members and list elements are then spans of the buffer, picked for
all payloads of the batch at once: no tree is built, and no depth is too deep.

The same index decides validity: quotes and brackets of a text must pair up, every
item (string, scalar, bracket, delimiter) must be one that may follow the item before
it in its container, scalars must pass a small automaton (NaN and Infinity are
not JSON), escapes must be known and strings free of control characters.

Defined results: NULL and damaged payloads give no rows; a null or non-object
list element gives no row but keeps its place; a lone object is a list of one; a
list kept as JSON text is that list; of a member given twice the last counts;
unknown members are ignored; a prediction without a readable doc_id has a
NULL one; repeated bundles count for themselves; extra columns are ignored.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from decimal import Decimal, InvalidOperation

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import whole_number
from quern.session import ship_package

LINKS = ("bundle_id", "prediction_index", "doc_id", "choice_index", "span_index")
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 13]] = True
_QUOTE, _SLASH, _LIST, _OBJECT = 34, 92, 91, 123
# Kinds of items.
_OPEN_OBJECT, _OPEN_LIST, _CLOSE_OBJECT, _CLOSE_LIST, _COMMA, _COLON, _STRING, _SCALAR = range(1, 9)
_KIND = np.zeros(256, np.int8)
for _byte, _code in zip(b"{[}],:", range(1, 7), strict=True):
    _KIND[_byte] = _code
_STEP = np.array([0, 1, 1, -1, -1, 0, 0, 0, 0], np.int64)
# What may come next: a value, a key or }, a value or ], a key, a colon, "," or }, "," or ], nothing.
_VALUE, _FIRST_KEY, _FIRST_ELEMENT, _KEY, _AFTER_KEY, _IN_OBJECT, _IN_LIST, _END = range(8)
_MAY = np.zeros((8, 9), bool)
for _state, _kinds in ((_VALUE, (1, 2, 7, 8)), (_FIRST_KEY, (7, 3)), (_FIRST_ELEMENT, (1, 2, 7, 8, 4)), (_KEY, (7,)), (_AFTER_KEY, (6,)), (_IN_OBJECT, (5, 3)), (_IN_LIST, (5, 4))):
    _MAY[_state, list(_kinds)] = True
_ESCAPES, _HEX = np.zeros(256, bool), np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_HEX[list(b"0123456789abcdefABCDEF")] = True
#: Bytes indexed at once; bounds the memory of the bitmaps, not of a payload.
CHUNK_BYTES = 4 << 20


def _scalar_automaton() -> tuple[np.ndarray, np.ndarray]:
    """(transitions state x byte, accepting states) of numbers, true, false and null; state 0 starts, 1 is dead."""
    table, accepting = np.ones((32, 256), np.int8), np.zeros(32, bool)
    zero, digits, point, fraction, power, signed, exponent, minus = range(2, 10)
    nonzero, every = list(b"123456789"), list(b"0123456789")
    for start in (0, minus):
        table[start, ord("0")], table[start, nonzero] = zero, digits
    table[0, ord("-")] = minus
    table[digits, every], table[point, every], table[fraction, every] = digits, fraction, fraction
    for whole in (zero, digits):
        table[whole, ord(".")] = point
    for mantissa in (zero, digits, fraction):
        table[mantissa, list(b"eE")] = power
    table[power, list(b"+-")] = signed
    for before in (power, signed, exponent):
        table[before, every] = exponent
    accepting[[zero, digits, fraction, exponent]] = True
    free = minus + 1
    for word in (b"true", b"false", b"null"):
        state = 0
        for byte in word:
            table[state, byte], state = free, free
            free += 1
        accepting[state] = True
    return table, accepting


_AUTOMATON, _ACCEPTING = _scalar_automaton()


def valid_json(text: str) -> bool:
    """Whether ``text`` is strict JSON, at any depth."""
    return bool(StructuralIndex([text.encode("utf-8", "surrogatepass")]).valid[0])


class StructuralIndex:
    """Bitmaps and containers of several texts laid end to end; ``valid`` tells which of them are JSON."""

    def __init__(self, texts: list[bytes]) -> None:
        odd = np.zeros(len(texts), bool)
        # A text without paired quotes, then one without paired brackets, would shift those behind it.
        for faults in (self._scan, self._unbalanced):
            if (bad := faults(texts)).any():
                odd |= bad
                texts = [b"null" if b else t for t, b in zip(texts, bad.tolist(), strict=True)]
                self._scan(texts)
        self._nest()
        self.valid = ~odd & self._sound()
        self.by_home = np.argsort(self.home, kind="stable")
        self.sorted_home = self.home[self.by_home]

    def _scan(self, texts: list[bytes]) -> np.ndarray:
        """Bitmaps of the buffer; which texts have a quote without a partner."""
        self.raw = b"\n".join(texts) + b"\n"
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        b = self.b = np.frombuffer(self.raw, np.uint8)
        # a quote is escaped by an odd run of backslashes before it
        quotes, slashes = np.flatnonzero(b == _QUOTE), np.flatnonzero(b == _SLASH)
        self.slashes, self.escape = slashes, slashes
        if len(slashes):
            head = slashes[np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(slashes) > 1]), np.arange(len(slashes)), 0))]
            self.escape = slashes[(slashes - head) % 2 == 0]  # a backslash that is not itself escaped
            quotes = quotes[~np.isin(quotes - 1, self.escape)]
        self.open_quote, self.close_quote = quotes[0::2], quotes[1::2]
        bits = np.zeros(len(b), np.int8)
        bits[quotes] = 1
        self.inside = (np.cumsum(bits, dtype=np.int32) & 1) == 1
        kind = np.where(self.inside, 0, _KIND[b])
        self.pos = np.flatnonzero(kind)
        self.kind = kind[self.pos]
        self.solid = np.flatnonzero(~_SPACE[b])
        return np.diff(np.searchsorted(quotes, self.starts)) % 2 == 1

    def _unbalanced(self, texts: list[bytes]) -> np.ndarray:
        """Which texts have a bracket without a partner."""
        after = np.cumsum(_STEP[self.kind])
        edge = np.searchsorted(self.pos, self.starts)
        base = np.concatenate([[0], after])[edge]
        lowest = np.zeros(len(texts), np.int64)
        some = edge[1:] > edge[:-1]
        if some.any():
            lowest[some] = np.minimum.reduceat(after, edge[:-1][some]) - base[:-1][some]
        return (np.diff(base) != 0) | (lowest < 0)

    def _nest(self) -> None:
        """Items in order, the container around each and the token that opens it."""
        b = self.b
        mark = np.zeros(len(b), np.int8)
        plain = ~self.inside & ~_SPACE[b] & (_KIND[b] == 0) & (b != _QUOTE)
        plain[self.close_quote] = False
        begins = plain.copy()
        begins[1:] &= ~plain[:-1]
        ends = plain.copy()
        ends[:-1] &= ~plain[1:]
        self.scalars = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        mark[self.scalars[0]], mark[self.open_quote], mark[self.pos] = _SCALAR, _STRING, self.kind
        self.item = np.flatnonzero(mark)
        self.item_kind = mark[self.item]
        depth = np.cumsum(_STEP[self.item_kind])
        # In order of depth, and of place within a depth, the last opening token before an item is its container.
        order = np.argsort(depth, kind="stable")
        opens = (self.item_kind == _OPEN_OBJECT) | (self.item_kind == _OPEN_LIST)
        around = np.full(len(order), -1, np.int64)
        around[order] = np.maximum.accumulate(np.where(opens[order], np.arange(len(order)), -1))
        around[order] = np.where(around[order] >= 0, order[around[order]], -1)
        around[depth == 0] = -1
        self.around = around  # the container open after each item, as an item
        token = np.cumsum(self.item_kind <= _COLON) - 1  # number of an item among the tokens
        closes = (self.item_kind == _CLOSE_OBJECT) | (self.item_kind == _CLOSE_LIST)
        home = np.where(closes, np.concatenate([[-1], around[:-1]]), around) if len(around) else around
        home = home[self.item_kind <= _COLON]
        self.home = np.where(home >= 0, token[home], -1)

    def _sound(self) -> np.ndarray:
        """Which texts follow the grammar."""
        b, kind, n = self.b, self.item_kind, len(self.starts) - 1
        text_of = lambda at: np.searchsorted(self.starts, at, "right") - 1
        sound = np.ones(n, bool)
        edge = np.searchsorted(self.item, self.starts)
        sound &= np.diff(edge) > 0
        container = np.where(self.around >= 0, kind[self.around], 0)  # 0 outside of all
        before = np.concatenate([[0], kind[:-1]])
        key = (kind == _STRING) & ((before == _OPEN_OBJECT) | ((before == _COMMA) & (container == _OPEN_OBJECT)))
        ended = np.array([_END, _IN_OBJECT, _IN_LIST])[container]
        state = np.where(key, _AFTER_KEY, ended)
        state[kind == _OPEN_OBJECT], state[kind == _OPEN_LIST], state[kind == _COLON] = _FIRST_KEY, _FIRST_ELEMENT, _VALUE
        state[kind == _COMMA] = np.where(container[kind == _COMMA] == _OPEN_OBJECT, _KEY, _VALUE)
        came = np.concatenate([[_VALUE], state[:-1]])
        came[edge[:-1][edge[:-1] < len(came)]] = _VALUE
        sound[text_of(self.item[~_MAY[came, kind]])] = False
        last = edge[1:] - 1
        sound[(last >= edge[:-1]) & (state[np.maximum(last, 0)] != _END) if len(state) else np.zeros(n, bool)] = False
        # scalars: all of them step through the automaton together
        start, end = self.scalars
        at, verdict, open_ = np.zeros(len(start), np.int8), np.zeros(len(start), bool), np.arange(len(start))
        step = 0
        while len(open_):
            at[open_] = _AUTOMATON[at[open_], b[start[open_] + step]]
            step += 1
            done = (start[open_] + step >= end[open_]) | (at[open_] == 1)
            verdict[open_[done]] = _ACCEPTING[at[open_[done]]]
            open_ = open_[~done]
        sound[text_of(start[~verdict])] = False
        sound[text_of(np.flatnonzero((b < 32) & self.inside))] = False
        if len(self.escape):
            follows = b[self.escape + 1]
            sound[text_of(self.escape[~_ESCAPES[follows]])] = False
            units = self.escape[follows == ord("u")]
            padded = np.concatenate([b, np.zeros(8, np.uint8)])
            sound[text_of(units[~_HEX[padded[units[:, None] + np.arange(2, 6)]].all(axis=1)])] = False
        return sound

    def first(self, at: np.ndarray) -> np.ndarray:
        """Position of the first non-blank byte at or after ``at``."""
        return self.solid[np.searchsorted(self.solid, at)]

    def token_at(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pos, at)

    def text(self, start: int, end: int) -> bytes:
        return self.raw[start:end].strip(b" \t\r\n")

    def _within(self, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``homes``, place, index in by_home) of all tokens of the containers."""
        lo, hi = np.searchsorted(self.sorted_home, homes), np.searchsorted(self.sorted_home, homes, "right")
        size = hi - lo
        row = np.repeat(np.arange(len(homes)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        return row, place, np.repeat(lo, size) + place

    def elements(self, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, start, end) of the elements of list containers."""
        row, place, at = self._within(homes)
        token = self.by_home[at]
        starts = self.kind[token] != _CLOSE_LIST
        row, place, at, token = row[starts], place[starts], at[starts], token[starts]
        start, end = self.pos[token] + 1, self.pos[self.by_home[at + 1]]
        some = self.first(start) < end  # false for the gap of an empty list
        return row[some], place[some], start[some], end[some]

    def members(self, homes: np.ndarray, name: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of the value of member ``name`` of object containers; the last of several."""
        row, _, at = self._within(homes)
        token = self.by_home[at]
        colon = self.kind[token] == _COLON
        row, at, token = row[colon], at[colon], token[colon]
        key = np.searchsorted(self.close_quote, self.pos[token]) - 1
        lo, hi = self.open_quote[key] + 1, self.close_quote[key]
        same = hi - lo == len(name)
        span = lo[same][:, None] + np.arange(len(name))
        same[same] = (self.b[span] == np.frombuffer(name, np.uint8)).all(axis=1)
        long = np.flatnonzero(hi - lo > len(name))
        if len(long) and len(self.slashes):
            escaped = np.searchsorted(self.slashes, hi[long]) > np.searchsorted(self.slashes, lo[long])
            for k in long[escaped]:  # a key written with escapes
                same[k] = json.loads(self.raw[lo[k] - 1 : hi[k] + 1]) == name.decode()
        row, at, token = row[same], at[same], token[same]
        last = np.ones(len(row), bool)
        last[:-1] = row[1:] != row[:-1]
        row, at, token = row[last], at[last], token[last]
        return row, self.pos[token] + 1, self.pos[self.by_home[at + 1]]

    def values(self, homes: np.ndarray, name: bytes) -> pa.Array:
        """Member ``name`` of each container as text: strings without quotes, other values as JSON; null and missing are NULL."""
        row, start, end = self.members(homes, name)
        start = self.first(start)
        end = self.solid[np.searchsorted(self.solid, end) - 1] + 1
        quoted = self.b[start] == _QUOTE
        start, end = start + quoted, end - quoted
        some = quoted | (self.b[start] != ord("n"))
        row, start, end, quoted = row[some], start[some], end[some], quoted[some]
        size, known = np.zeros(len(homes), np.int64), np.zeros(len(homes), bool)
        size[row], known[row] = end - start, True
        offsets = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(start - offsets[row], end - start) + np.arange(offsets[-1])
        buffers = [np.packbits(known, bitorder="little"), offsets.astype(np.int32), self.b[place]]
        out = pa.Array.from_buffers(pa.string(), len(homes), [pa.py_buffer(x.tobytes()) for x in buffers])
        escaped = quoted & (np.searchsorted(self.slashes, end) > np.searchsorted(self.slashes, start))
        if escaped.any():
            texts = out.to_pylist()
            for k, lo, hi in zip(row[escaped].tolist(), start[escaped].tolist(), end[escaped].tolist(), strict=True):
                texts[k] = json.loads(self.raw[lo - 1 : hi + 1]).encode("utf-8", "replace").decode()
            out = pa.array(texts, pa.string())
        return out


def whole_id(raw: bytes) -> int | None:
    """The whole number that a JSON number or string stands for, None if none."""
    if raw.isdigit() and len(raw) < 19:
        return int(raw)
    if raw[:1] in (b"{", b"["):
        return None
    try:
        value = json.loads(raw, parse_float=Decimal)
        if isinstance(value, bool) or not isinstance(value, int | str | Decimal):
            return None
        number = Decimal(value.strip() if isinstance(value, str) else value)
        if not number.is_finite() or abs(number.adjusted()) > 30 or number != number.to_integral_value():
            return None
        return int(number) if -(2**63) <= number < 2**63 else None
    except (ValueError, InvalidOperation):
        return None


_MEMBER = {"predictions": b"model_output", "choices": b"spans"}
_NEXT = {"predictions": "choices", "choices": "spans"}


class _Flattener:
    """Collects the rows of one chunk of bundles: of all levels, or of one with the texts of some members."""

    def __init__(self, level: str | None = None, members: Sequence[str] = ()) -> None:
        self.level, self.names = level, [m.encode() for m in members]
        self.out: list[list[np.ndarray]] = []
        self.members: list[list[pa.Array]] = []
        self.texts: list[tuple[str, np.ndarray, bytes]] = []

    def bundles(self, ids: np.ndarray, payloads: list[bytes]) -> None:
        index = StructuralIndex(payloads)
        sound = np.flatnonzero(index.valid)
        root = index.first(index.starts[:-1][sound])
        objects = index.b[root] == _OBJECT
        homes, ids = index.token_at(root[objects]), ids[sound[objects]]
        links = np.full((len(ids), 4), -1, np.int64)
        links[:, 0] = ids
        self.emit(index, "bundles", links, np.full(len(ids), -1, np.int64), homes)
        row, start, end = index.members(homes, b"predictions")
        self.lists(index, "predictions", links[row], start, end)
        while self.texts:
            todo, self.texts = self.texts, []
            for level in ("predictions", "choices", "spans"):
                some = [(link, text) for at, link, text in todo if at == level]
                if some:
                    inner = StructuralIndex([t for _, t in some])
                    keep = inner.valid
                    self.lists(inner, level, np.stack([link for link, _ in some])[keep], inner.starts[:-1][keep], inner.starts[1:][keep] - 1)

    def emit(self, index: StructuralIndex, level: str, own: np.ndarray, span: np.ndarray, homes: np.ndarray) -> None:
        if level == self.level or (self.level is None and level != "bundles"):
            self.out.append([*own.T, span])
            self.members.append([index.values(homes, n) for n in self.names])

    def lists(self, index: StructuralIndex, level: str, links: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Emit the objects of list values; links: bundle, prediction index, doc_id, choice index."""
        head = index.first(start)
        lead = index.b[head]
        for k in np.flatnonzero(lead == _QUOTE):
            text = json.loads(index.text(start[k], end[k]))
            self.texts.append((level, links[k], text.encode("utf-8", "surrogatepass")))
        lone = lead == _OBJECT
        rows = np.flatnonzero(lead == _LIST)
        row, place, at, to = index.elements(index.token_at(head[rows]))
        owner = np.concatenate([np.flatnonzero(lone), rows[row]])
        place = np.concatenate([np.zeros(lone.sum(), np.int64), place])
        at = np.concatenate([head[lone], index.first(at)])
        objects = index.b[at] == _OBJECT
        owner, place, at = owner[objects], place[objects], at[objects]
        own = links[owner].copy()
        homes = index.token_at(at)
        span = np.full(len(own), -1, np.int64)
        if level == "predictions":
            # an unreadable doc_id is remembered through the lowest value
            own[:, 1], own[:, 2] = place, _NO_ID
            row, start, end = index.members(homes, b"doc_id")
            for k, lo, hi in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
                value = whole_id(index.text(lo, hi))
                own[k, 2] = _NO_ID if value is None else value
        elif level == "choices":
            own[:, 3] = place
        else:
            span = place
        self.emit(index, level, own, span, homes)
        if level in _MEMBER and (self.level is None or level != self.level):
            row, start, end = index.members(homes, _MEMBER[level])
            self.lists(index, _NEXT[level], own[row], start, end) if len(row) else None

    def batch(self) -> pa.RecordBatch:
        columns = [np.concatenate([o[k] for o in self.out]) if self.out else np.zeros(0, np.int64) for k in range(5)]
        arrays = [pa.array(c, pa.int64(), mask=c == _NO_ID if k == 2 else None) for k, c in enumerate(columns)]
        arrays += [pa.concat_arrays([m[k] for m in self.members]) if self.members else pa.array([], pa.string()) for k in range(len(self.names))]
        return pa.RecordBatch.from_arrays(arrays, names=[*LINKS, *[f"m_{n.decode()}" for n in self.names]])


_NO_ID = -(2**63)


def _flatten(level: str | None, members: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.set_int_max_str_digits(0)

        def done(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
            flat = _Flattener(level, members)
            flat.bundles(np.array(ids, np.int64), texts)
            return flat.batch()

        for batch in batches:
            ids, texts, size = [], [], 0
            for bundle, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = payload.as_py()
                if text is None or bundle is None:
                    continue
                ids.append(bundle)
                texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)

    return run


def flatten_bundles(bundles: DataFrame, level: str | None = None, members: Sequence[str] = (), *, id_col: str = "bundle_id", payload_col: str = "payload") -> DataFrame:
    """Linked rows of the objects in bundles; no shuffle.

    Without ``level`` one row per prediction, choice and span (indexes are -1 above their
    level). With a level (``bundles``, ``predictions``, ``choices`` or ``spans``) its
    objects only, each with ``m_<name>`` columns for the texts of ``members``.
    """
    ship_package(bundles.sparkSession)
    source = bundles.select(F.col(id_col).cast("bigint").alias("bundle_id"), F.col(payload_col).alias("payload"))
    schema = ", ".join([*[f"{c} long" for c in LINKS], *[f"m_{m} string" for m in members]])
    return source.mapInArrow(_flatten(level, members), schema)


def _whole(*names: str) -> list[Column]:
    """Whole numbers by value; NULL where a text stands for none."""
    return [whole_number(F.col(f"m_{n}")).alias(n) for n in names]


def _real(*names: str) -> list[Column]:
    return [F.col(f"m_{n}").try_cast("double").alias(n) for n in names]


def _text(*names: str) -> list[Column]:
    return [F.col(f"m_{n}").alias(n) for n in names]


def bundle_table(bundles: DataFrame, **options: str) -> DataFrame:
    """One row per valid bundle: its hashes, declared size, settings and metrics (JSON texts)."""
    texts = ("task_name", "task_hash", "model_hash", "model_config", "task_config", "metrics")
    rows = flatten_bundles(bundles, "bundles", (*texts, "num_instances"), **options)
    return rows.select("bundle_id", *_text(*texts), *_whole("num_instances"))


def prediction_table(bundles: DataFrame, **options: str) -> DataFrame:
    """Typed predictions, linked to their bundle; ``metrics`` stays JSON text (see ``metric_table``)."""
    texts = ("native_id", "task_hash", "model_hash", "metrics")
    rows = flatten_bundles(bundles, "predictions", (*texts, "label"), **options)
    return rows.select("bundle_id", "prediction_index", "doc_id", *_text(*texts), *_whole("label"))


def metric_table(predictions: DataFrame) -> DataFrame:
    """One row per metric of a prediction of ``prediction_table``: (bundle_id, prediction_index, doc_id, metric, value).

    Metrics grouped in inner objects come out by their own names; a metric that is no number has a NULL value.
    """
    outer = F.map_entries(F.from_json("metrics", "map<string,string>"))
    inner = lambda e: F.when(e["value"].startswith("{"), F.map_entries(F.from_json(e["value"], "map<string,string>"))).otherwise(F.array(e))
    flat = predictions.select("bundle_id", "prediction_index", "doc_id", F.explode(F.flatten(F.transform(outer, inner))).alias("e"))
    return flat.select("bundle_id", "prediction_index", "doc_id", F.col("e.key").alias("metric"), F.col("e.value").try_cast("double").alias("value"))


def choice_table(bundles: DataFrame, **options: str) -> DataFrame:
    """Typed choices, linked by (bundle_id, prediction_index); unreadable values are NULL."""
    reals = ("sum_logits", "sum_logits_uncond", "logits_per_token", "logits_per_char", "logits_per_byte")
    wholes = ("num_tokens", "num_tokens_all", "num_chars")
    rows = flatten_bundles(bundles, "choices", (*reals, *wholes, "is_greedy"), **options)
    return rows.select("bundle_id", "prediction_index", "doc_id", "choice_index", *_real(*reals), *_whole(*wholes), F.col("m_is_greedy").try_cast("boolean").alias("is_greedy"))


def span_table(bundles: DataFrame, **options: str) -> DataFrame:
    """Typed spans, linked by (bundle_id, prediction_index, choice_index)."""
    rows = flatten_bundles(bundles, "spans", ("start", "end", "logit"), **options)
    return rows.select("bundle_id", "prediction_index", "doc_id", "choice_index", "span_index", *_whole("start", "end"), *_real("logit"))
