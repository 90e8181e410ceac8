"""Evaluation texts inside a training corpus: pigeonhole edit matching.

A test item leaks if a document holds ``min_words`` consecutive words of one of
its texts with at most ``max_edits`` words inserted, deleted or replaced. Every
stretch of ``min_words`` words of an item is split into ``max_edits + 1`` pieces; by the
pigeonhole principle one of them stands unchanged in a leaking document. Exact
piece hits are found by hashing every run of that many words of a batch of documents at
once; each hit is then verified on the words themselves with Myers' bit-parallel
distance.

The corpus is read once per block of items, by narrow tasks without a shuffle.
The items are a stated query set: they are sent to the executors in blocks of
about ``block_words`` words, one block after the other where there are several, so what
is broadcast at a time is bounded whatever their number. Counting the words and
fetching the items of a block run queries while the result is built.

Defined results: NULL and blank documents and item texts hold nothing; texts
below ``min_words`` words cannot leak; a word broken at a line end is read in every
way that the items make possible, each break by itself; items that share a text each get a row; a
document is reported once per item however often it holds it; two documents of
equal text both count; documents repeated under one doc_id give one row; extra
columns are ignored; whole texts are searched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.textprep import WORD, gram_hashes, hash_words, joined, readings, undressed
from quern.session import ship_package, stable_checkpoint

#: Characters hashed at once; a longer text is hashed whole.
CHUNK_CHARS = 1 << 19


def piece_length(min_words: int, max_edits: int) -> int:
    """Words per piece when ``min_words`` words are split into ``max_edits + 1`` pieces."""
    length = min_words // (max_edits + 1)
    if length < 1:
        raise ValueError("too many edits for so few words")
    return length


def myers_distance(pattern: Sequence[str], text: Iterable[str], limit: int) -> bool:
    """Whether ``pattern`` stands somewhere in ``text`` with at most ``limit`` edits (bit-parallel)."""
    size = len(pattern)
    if size <= limit:
        return True
    full, top = (1 << size) - 1, 1 << (size - 1)
    match: dict[str, int] = defaultdict(int)
    for k, symbol in enumerate(pattern):
        match[symbol] |= 1 << k
    plus, minus, score = full, 0, size
    for symbol in text:
        equal = match.get(symbol, 0)
        cross = equal | minus
        equal |= (((equal & plus) + plus) ^ plus) & full
        high, low = minus | (~(equal | plus) & full), plus & equal
        if high & top:
            score += 1
        elif low & top:
            score -= 1
        # a match may start anywhere in the text: no carry into the first row
        high, low = (high << 1) & full, (low << 1) & full
        plus, minus = low | (~(cross | high) & full), high & cross
        if score <= limit:
            return True
    return False


@dataclass
class ItemIndex:
    """Pieces of a block of item texts, ready for lookup."""

    min_words: int
    max_edits: int
    texts: list[list[str]] = field(default_factory=list)
    owners: list[list[int]] = field(default_factory=list)

    def build(self, items: Iterable[tuple[int, str | None]]) -> ItemIndex:
        owners: dict[tuple[str, ...], dict[int, None]] = defaultdict(dict)
        for item, text in items:
            words = tuple(WORD.findall(joined(undressed(text)))) if text else ()
            if len(words) >= self.min_words:
                owners[words][item] = None  # a text that several items share is searched once
        self.texts, self.owners = [list(w) for w in owners], [list(o) for o in owners.values()]
        self.known = frozenset(w for words in self.texts for w in words)
        self.length = piece_length(self.min_words, self.max_edits)
        hashes, where, place = [], [], []
        for k, words in enumerate(self.texts):
            value, _, _ = hash_words(" ".join(words))
            # the pieces of all stretches: they overlap, so each run is kept once
            grams = gram_hashes(value, self.length)
            hashes.append(grams)
            where.append(np.full(len(grams), k))
            place.append(np.arange(len(grams)))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.where = np.concatenate(where)[order] if where else np.zeros(0, int)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, int)
        self.bits = max(16, int(4 * len(flat) + 1).bit_length())
        self.sieve = np.zeros(1 << self.bits, bool)
        self.sieve[(flat >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        return self

    def leaks(self, text: str, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """(index of document, item) of documents laid end to end, split at ``bounds``."""
        value, start, end = hash_words(text)
        grams = gram_hashes(value, self.length)
        hit = np.flatnonzero(self.sieve[(grams >> np.uint64(64 - self.bits)).astype(np.int64)]) if len(grams) else np.zeros(0, int)
        low = np.searchsorted(self.hashes, grams[hit])
        real = (low < len(self.hashes)) & (self.hashes[np.minimum(low, len(self.hashes) - 1)] == grams[hit]) if len(self.hashes) else np.zeros(len(hit), bool)
        done: set[tuple[int, int]] = set()
        first_word = np.searchsorted(start, bounds)  # words before each document
        for p, lo in zip(hit[real].tolist(), low[real].tolist(), strict=True):
            doc = int(np.searchsorted(bounds, start[p], "right")) - 1
            left, right = int(first_word[doc]), int(first_word[doc + 1])
            while lo < len(self.hashes) and self.hashes[lo] == grams[p]:
                which, q = int(self.where[lo]), int(self.place[lo])
                lo += 1
                if (doc, which) in done:
                    continue
                if self._verified(text, start, end, left, right, p, which, q):
                    done.add((doc, which))
                    for item in self.owners[which]:
                        yield doc, item

    def _verified(self, text: str, start: np.ndarray, end: np.ndarray, left: int, right: int, p: int, which: int, q: int) -> bool:
        words, n, k = self.texts[which], self.min_words, self.max_edits
        reach = n - self.length + k
        lo, hi = max(left, p - reach), min(right, p + self.length + reach)
        around = [text[a:b] for a, b in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)]
        if len(around) < n - k:
            return False
        return any(myers_distance(words[s : s + n], around, k) for s in range(max(0, q + self.length - n), min(q, len(words) - n) + 1))


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value

        def chunk(ids: list[int], texts: list[str]) -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            found = {(ids[d], item) for d, item in index.leaks("\n".join(texts) + "\n", bounds)}
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], names=["doc_id", "item_id"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = text.as_py()
                if doc is None or not whole:
                    continue
                for reading in readings(undressed(whole), index.known, index.min_words + index.max_edits, index.max_edits > 0):
                    ids.append(doc)
                    texts.append(reading)
                    size += len(reading)
                if size >= CHUNK_CHARS:
                    yield chunk(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield chunk(ids, texts)

    return run


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    texts: Sequence[str | Column] = ("passage", "question"),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    min_words: int = 10,
    max_edits: int = 0,
    block_words: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id): documents that hold part of a test item."""
    spark = documents.sparkSession
    ship_package(spark)
    flat = None
    for text in texts:
        part = items.select(F.col(item_col).cast("bigint").alias("item"), (F.col(text) if isinstance(text, str) else text).alias("text"))
        flat = part if flat is None else flat.unionByName(part)
    flat = flat.where("item IS NOT NULL AND text IS NOT NULL")
    words = flat.agg(F.sum(F.length("text") / 5)).first()[0] or 0
    blocks = max(1, -int(-words // block_words))
    corpus = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for b in range(blocks):
        block = flat.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toLocalIterator()
        shared = spark.sparkContext.broadcast(ItemIndex(min_words, max_edits).build((r["item"], r["text"]) for r in block))
        part = corpus.mapInArrow(_search(shared), "doc_id long, item_id long")
        if blocks > 1:  # searched now, so that the next index takes the place of this one
            part = stable_checkpoint(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    # Readings of one text, or a repeated doc_id, may find the same item twice.
    return found.distinct()
