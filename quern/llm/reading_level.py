"""Reading level of each document, from sentence-level models.

Every sentence gets a distribution over the five levels from a regularised
softmax model over its words and over the character n-grams of its words; the
character part carries over to words never seen in training. A document's
sentence distributions are aggregated (word-weighted means, spread, tails), and a
regularised cumulative model turns the aggregate into a calibrated distribution
over document levels. The sentence model used to fit the calibration is
cross-fitted, so that it is calibrated on sentences it has not seen.

Training: a bounded sample of labelled documents, at most ``max_documents`` by a
hash of their ids (a documented bound, see ``fit_reading_level``), read to the
driver. Scoring: one narrow pass over the corpus without a shuffle; words are
hashed for a whole batch of texts at once and each distinct word is scored once per
worker.

The language of a text comes from a model of its own, naive Bayes over the character
n-grams of its words, fitted on documents whose ``lang`` says so, with a class of none.

Defined results: NULL and blank texts have no level and no language; texts without
words of letters, and texts unlike all known languages, have no language; equal texts
get equal levels; labels outside 1..5, NULL labels and labels of missing documents are
ignored; an empty label table, or no document with a language, raises ValueError; extra columns are ignored; whole
texts are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.textprep import hash_words
from quern.session import ship_package

LEVELS = 5
ENGLISH = "en"
N_FEATURES = 2 * LEVELS + 3
_CHUNK_CHARS = 1 << 19
_CACHE_WORDS = 1 << 19
_LOWEST = -1e30
_STOPS = np.array([ord(c) for c in ".!?"], np.uint32)
_GRAMS = (3, 4)


def _spelling(word: str) -> str:
    """Digits of a word are alike; very long words keep all their characters."""
    return "".join("0" if c.isdigit() else c for c in word) if not word.isalpha() else word


def _gram_rows(word: str, size: int, grams: tuple[int, ...] = _GRAMS) -> np.ndarray:
    """Hashed rows of the character n-grams of a word, with its edges."""
    w = f"<{_spelling(word)}>"
    code = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rows = []
    for n in grams:
        if len(code) < n:
            continue
        h = np.zeros(len(code) - n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h + code[k : len(code) - n + 1 + k] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        rows.append((h % np.uint64(size)).astype(np.int64))
    return np.concatenate(rows) if rows else np.zeros(0, np.int64)


@dataclass
class Sentences:
    """Words of several texts: distinct-word row, sentence and document of each."""

    distinct: list[str]
    word: np.ndarray
    first: np.ndarray  # first word of each sentence
    doc: np.ndarray  # document of each sentence
    size: np.ndarray  # words of each sentence


def split_sentences(texts: list[str]) -> Sentences:
    """Sentences end at . ! ? before a blank, and at line ends."""
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    whole = "\n".join(texts) + "\n"
    value, start, end = hash_words(whole)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    line = code == 10
    stop = np.isin(code, _STOPS)
    blank = np.isin(code, np.array([32, 10, 9, 13, 0xA0], np.uint32))
    stop[:-1] &= blank[1:]
    ends = np.cumsum(line | stop)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Sentences([], none, none, none, none)
    number = ends[start]
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    _, at, word = np.unique(value, return_index=True, return_inverse=True)
    distinct = [whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
    doc = np.searchsorted(bounds, start[first], "right") - 1
    return Sentences(distinct, word.astype(np.int64), first, doc, np.diff(np.concatenate([first, [len(word)]])))


@dataclass
class SentenceModel:
    """Softmax over mean word scores: score(word) = own weight + mean of its n-gram weights."""

    words: dict[str, int]
    word_weight: np.ndarray
    gram_weight: np.ndarray
    bias: np.ndarray

    def word_scores(self, words: Iterable[str]) -> np.ndarray:
        words = list(words)
        out = np.zeros((len(words), LEVELS), np.float32)
        for k, word in enumerate(words):
            rows = _gram_rows(word, len(self.gram_weight))
            if len(rows):
                out[k] = self.gram_weight[rows].mean(axis=0)
            own = self.words.get(_spelling(word))
            if own is not None:
                out[k] += self.word_weight[own]
        return out

    def probabilities(self, scores: np.ndarray, s: Sentences) -> np.ndarray:
        """Distribution of each sentence, from the scores of the distinct words."""
        if not len(s.first):
            return np.zeros((0, LEVELS), np.float32)
        mean = np.add.reduceat(scores[s.word], s.first, axis=0) / s.size[:, None]
        return _softmax(mean + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_sentences(texts: list[str], targets: np.ndarray, *, l2: float = 2e-6, grams: int = 1 << 13, rounds: int = 120, rate: float = 0.5) -> SentenceModel:
    """Fit the sentence model: every sentence carries the label distribution of its document."""
    s = split_sentences(texts)
    spelt = [_spelling(w) for w in s.distinct]
    index: dict[str, int] = {}
    own = np.array([index.setdefault(w, len(index)) for w in spelt], np.int64)
    names = list(index)
    rows = [_gram_rows(w, grams) for w in names]
    counts = np.array([len(r) for r in rows])
    gram_of = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    word_of = np.repeat(np.arange(len(names)), counts)
    gram_share = np.repeat(1.0 / np.maximum(counts, 1), counts).astype(np.float32)
    token = own[s.word]
    sentence = np.repeat(np.arange(len(s.first)), s.size)
    # sparse sentence x word matrix of shares, as unique pairs
    pair, n = np.unique(sentence * np.int64(len(names)) + token, return_counts=True)
    p_sentence, p_word = pair // len(names), pair % len(names)
    share = (n / s.size[p_sentence]).astype(np.float32)
    target = targets[s.doc].astype(np.float32)
    # a document counts by its words, a sentence by its part of them
    weight = np.sqrt(s.size).astype(np.float32)
    weight /= weight.sum()
    starts = np.searchsorted(p_sentence, np.arange(len(s.first)))
    by_word = np.argsort(p_word, kind="stable")
    word_starts = np.searchsorted(p_word[by_word], np.arange(len(names)))
    by_gram = np.argsort(gram_of, kind="stable")
    used, gram_starts = np.unique(gram_of[by_gram], return_index=True)
    gram_starts_of_words = np.cumsum(counts) - counts
    some = counts > 0
    ww, wg, bias = np.zeros((len(names), LEVELS), np.float32), np.zeros((grams, LEVELS), np.float32), np.zeros(LEVELS, np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (ww, wg, bias)]
    for step in range(1, rounds + 1):
        scores = ww.copy()
        scores[some] += np.add.reduceat(wg[gram_of] * gram_share[:, None], gram_starts_of_words[some], axis=0)
        z = np.add.reduceat(scores[p_word] * share[:, None], starts, axis=0) + bias
        error = (_softmax(z) - target) * weight[:, None]
        g_word = np.add.reduceat((error[p_sentence] * share[:, None])[by_word], word_starts, axis=0)
        g_gram = np.zeros_like(wg)
        g_gram[used] = np.add.reduceat((g_word[word_of] * gram_share[:, None])[by_gram], gram_starts, axis=0)
        for k, (p, g, decay) in enumerate(((ww, g_word, l2), (wg, g_gram, l2), (bias, error.sum(axis=0), 0.0))):
            g = g + decay * p
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (1 - 0.9 * step / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return SentenceModel(index, ww, wg, bias)


def document_features(p: np.ndarray, s: Sentences, n: int) -> np.ndarray:
    """Aggregate of the sentence distributions of each of ``n`` documents (zeros without words)."""
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(s.first):
        return out
    weight = s.size.astype(np.float64)
    level = p @ np.arange(1, LEVELS + 1)
    sure = np.log(np.maximum(p, 1e-4))
    cut = np.flatnonzero(np.concatenate([[True], s.doc[1:] != s.doc[:-1]]))
    docs = s.doc[cut]
    total = np.add.reduceat(weight, cut)[:, None]
    mean = np.add.reduceat(p * weight[:, None], cut, axis=0) / total
    logs = np.add.reduceat(sure * weight[:, None], cut, axis=0) / total
    average = np.add.reduceat(level * weight, cut)[:, None] / total
    spread = np.sqrt(np.maximum(np.add.reduceat(level**2 * weight, cut)[:, None] / total - average**2, 0))
    hard = np.add.reduceat((level >= 3.5) * weight, cut)[:, None] / total
    out[docs] = np.concatenate([mean, logs / 4, average, spread, hard], axis=1)
    return out


@dataclass
class LanguageModel:
    """Naive Bayes over the character n-grams of words: which language a text is most likely written in.

    A text whose grams are less likely in every language than any text it was fitted on, by
    ``REJECT`` nats a gram, is in none of them; so is a text without words of letters.
    """

    names: tuple[str, ...]
    weight: np.ndarray  # gram rows x languages: log likelihood
    floor: float

    GRAMS = (2, 3, 4)
    REJECT = 1.0
    #: Grams below which a text is too short to be rejected.
    ENOUGH = 40

    def word_scores(self, words: Iterable[str]) -> np.ndarray:
        """Log likelihood of each word in each language, and its number of grams; 0 for words that are not all letters."""
        words = list(words)
        out = np.zeros((len(words), len(self.names) + 1), np.float32)
        for k, word in enumerate(words):
            if word.isalpha():
                rows = _gram_rows(word, len(self.weight), self.GRAMS)
                out[k, :-1], out[k, -1] = self.weight[rows].sum(axis=0), len(rows)
        return out

    def languages(self, sums: np.ndarray) -> np.ndarray:
        """Place in ``names`` for each document's summed word scores; -1 for none."""
        best, grams = sums[:, :-1].max(axis=1), sums[:, -1]
        unlike = (grams >= self.ENOUGH) & (best < (self.floor - self.REJECT) * grams)
        return np.where((grams == 0) | unlike, -1, sums[:, :-1].argmax(axis=1))


def _document_sums(s: Sentences, scores: np.ndarray, n: int) -> np.ndarray:
    """Word scores summed over each of ``n`` documents."""
    out = np.zeros((n, scores.shape[1]))
    if len(s.first):
        np.add.at(out, s.doc, np.add.reduceat(scores[s.word], s.first, axis=0))
    return out


def fit_languages(texts: list[str], labels: list[str], *, size: int = 1 << 15, smoothing: float = 0.05, rounds: int = 3, folds: int = 3) -> LanguageModel:
    """Fit the language model without the documents whose label contradicts it.

    Whether a label does is told by models fitted on the other folds; equal texts share a
    fold, so no document speaks for itself.
    """
    names = tuple(sorted(set(labels)))
    if not names:
        raise ValueError("no document with a language to learn from")
    texts = [t.lower() for t in texts]
    order = {t: k for k, t in enumerate(dict.fromkeys(texts))}
    fold = np.array([order[t] % folds for t in texts])
    s = split_sentences(texts)
    label = np.array([names.index(x) for x in labels], np.int64)
    document = np.repeat(s.doc, s.size)
    rows = [_gram_rows(w, size, LanguageModel.GRAMS) if w.isalpha() else np.zeros(0, np.int64) for w in s.distinct]
    lengths = np.array([len(r) for r in rows], np.int64)
    gram, word_of = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), lengths)

    def fitted(kept: np.ndarray) -> tuple[LanguageModel, np.ndarray]:
        """A model of the kept documents, and what it says of all."""
        counts = np.zeros((len(s.distinct), len(names)))
        used = kept[document]
        np.add.at(counts, (s.word[used], label[document[used]]), 1)
        # equal sentences are repeated from text to text: a word counts by the logarithm
        grams = np.zeros((size, len(names)))
        np.add.at(grams, gram, np.log1p(counts)[word_of])
        grams += smoothing
        model = LanguageModel(names, np.log(grams / grams.sum(axis=0)).astype(np.float32), _LOWEST)
        return model, _document_sums(s, model.word_scores(s.distinct), len(texts))

    keep = np.ones(len(texts), bool)
    for _ in range(rounds):
        agrees = np.zeros(len(texts), bool)
        for f in range(folds):
            model, sums = fitted(keep & (fold != f))
            agrees |= (fold == f) & ((model.languages(sums) == label) | (sums[:, -1] == 0))
        if (agrees == keep).all():
            break
        keep = agrees
    for name in range(len(names)):  # too few documents to speak for each other
        if not keep[label == name].any():
            keep |= label == name
    model, sums = fitted(keep)
    sure = keep & (sums[:, -1] >= LanguageModel.ENOUGH)
    if sure.any():
        model.floor = float((sums[sure, :-1].max(axis=1) / sums[sure, -1]).min())
    return model


@dataclass
class LevelModel:
    """Sentence model, cumulative document calibration and language model."""

    sentences: SentenceModel
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # features x (LEVELS - 1): P(level > k)
    offset: np.ndarray
    language: LanguageModel | None = None

    def distribution(self, features: np.ndarray) -> np.ndarray:
        above = 1 / (1 + np.exp(-((features - self.centre) / self.scale @ self.weight + self.offset)))
        above = np.minimum.accumulate(above, axis=1)  # P(level > k) falls in k
        full = np.concatenate([np.ones((len(features), 1)), above, np.zeros((len(features), 1))], axis=1)
        return full[:, :-1] - full[:, 1:]


def _fit_cumulative(x: np.ndarray, above: np.ndarray, weight: np.ndarray, l2: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Ridge logistic fit of each threshold by Newton steps."""
    xs = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.diag([l2] * x.shape[1] + [1e-6])
    out = np.zeros((xs.shape[1], above.shape[1]))
    for k in range(above.shape[1]):
        w = out[:, k]
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
            step = np.linalg.solve((xs * (weight * q * (1 - q) + 1e-9)[:, None]).T @ xs + ridge, xs.T @ (weight * (q - above[:, k])) + ridge @ w)
            w = w - np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        out[:, k] = w
    return out[:-1], out[-1]


def fit_levels(texts: list[str], targets: np.ndarray, raters: np.ndarray, *, folds: int = 3, l2: float = 1.0, **sentence_options) -> LevelModel:
    """Fit both models. ``targets``: label distribution per document; ``raters``: labels per document."""
    texts = [t.lower() for t in texts]
    features = np.zeros((len(texts), N_FEATURES))
    # equal texts share a fold, or calibration would see trained sentences
    order = {t: k for k, t in enumerate(dict.fromkeys(texts))}
    fold = np.array([order[t] % folds for t in texts])

    def crossed(f: int) -> None:
        held, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if len(held):
            train = rest if len(rest) else held
            fitted = fit_sentences([texts[k] for k in train], targets[train], **sentence_options)
            s = split_sentences([texts[k] for k in held])
            features[held] = document_features(fitted.probabilities(fitted.word_scores(s.distinct), s), s, len(held))

    with ThreadPoolExecutor(folds + 1) as pool:
        whole = pool.submit(fit_sentences, texts, targets, **sentence_options)
        list(pool.map(crossed, range(folds)))
    model = whole.result()
    centre, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    above = 1 - np.cumsum(targets, axis=1)[:, :-1]
    weight, offset = _fit_cumulative((features - centre) / scale, above, raters.astype(float), l2)
    return LevelModel(model, centre, scale, weight, offset)


class Scorer:
    """Scores texts with a model; keeps the scores of words it has met."""

    def __init__(self, model: LevelModel) -> None:
        self.model = model
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, LEVELS + len(model.language.names) + 1), np.float32)

    def _known(self, words: list[str]) -> np.ndarray:
        if len(self.rows) + len(words) > _CACHE_WORDS:
            self.rows.clear()
        new = [w for w in words if w not in self.rows]
        if new:
            at = len(self.rows)
            need = at + len(new)
            if need > len(self.scores):
                self.scores = np.concatenate([self.scores[:at], np.zeros((max(need, 2 * at) - at, self.scores.shape[1]), np.float32)])
            self.scores[at:need, :LEVELS] = self.model.sentences.word_scores(new)
            self.scores[at:need, LEVELS:] = self.model.language.word_scores(new)
            self.rows.update((w, at + k) for k, w in enumerate(new))
        return self.scores[[self.rows[w] for w in words]]

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(level distribution, language index, words) of each text; language -1 for none of those known."""
        s = split_sentences([t.lower() for t in texts])
        n = len(texts)
        words = np.zeros(n, np.int64)
        language = np.full(n, -1, np.int64)
        if not len(s.first):
            return np.zeros((n, LEVELS)), language, words
        known = self._known(s.distinct)
        p = self.model.sentences.probabilities(known[:, :LEVELS], s)
        np.add.at(words, s.doc, s.size)
        language = self.model.language.languages(_document_sums(s, known[:, LEVELS:], n))
        return self.model.distribution(document_features(p, s, n)), language, words


_READY: dict[str, Scorer] = {}

SCORED = "language string, level double, " + ", ".join(f"p{k} double" for k in range(1, LEVELS + 1)) + ", n_words long"


def _score(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = Scorer(shared.value)
        scorer = _READY[key]

        def done(kept: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            p, language, words = scorer.score(texts)
            none = words == 0
            level = p @ np.arange(1, LEVELS + 1)
            names = np.array([*scorer.model.language.names, None], object)[language]
            arrays = [pa.array(names.tolist(), pa.string()), pa.array(level, pa.float64(), mask=none)]
            arrays += [pa.array(p[:, k], pa.float64(), mask=none) for k in range(LEVELS)]
            own = ["language", "level", *[f"p{k}" for k in range(1, LEVELS + 1)], "n_words"]
            return pa.RecordBatch.from_arrays([*kept.columns, *arrays, pa.array(words, pa.int64())], names=[*kept.schema.names, *own])

        for batch in batches:
            kept = batch.select(range(batch.num_columns - 1))
            first, texts, size = 0, [], 0
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                whole = text.as_py() or ""
                texts.append(whole)
                size += len(whole)
                if size >= _CHUNK_CHARS:
                    yield done(kept.slice(first, len(texts)), texts)
                    first, texts, size = k + 1, [], 0
            if texts:
                yield done(kept.slice(first, len(texts)), texts)

    return run


def fit_reading_level(documents: DataFrame, labels: DataFrame, *, max_documents: int = 1200, per_language: int = 300, **options) -> LevelModel:
    """Fit on a bounded sample: at most ``max_documents`` documents with levels and as many with a language
    (``per_language`` of each), both chosen by a hash of their ids. One pass over the texts fetches them.

    ``lang`` may be missing, wrong or in uneven spelling: its first letters count, and documents
    that contradict the model fitted on the others are left out.
    """
    clean = labels.select(F.col("doc_id").cast("bigint").alias("l_id"), F.col("reading_level").cast("int").alias("l_level")).where("l_id IS NOT NULL AND l_level BETWEEN 1 AND 5")
    votes = [f"n{k}" for k in range(1, LEVELS + 1)]
    counts = clean.groupBy("l_id").agg(*[F.count_if(F.col("l_level") == k + 1).alias(n) for k, n in enumerate(votes)])
    levels = counts.orderBy(F.xxhash64("l_id"), "l_id").limit(max_documents).select("l_id", F.lit(None).cast("string").alias("l_lang"), *votes)
    known = documents.select(F.col("doc_id").cast("bigint").alias("l_id"), F.regexp_extract(F.lower(F.trim("lang")), r"^\p{L}+", 0).alias("l_lang")).where("l_id IS NOT NULL AND l_lang NOT IN ('', 'und')")
    place = F.row_number().over(Window.partitionBy("l_lang").orderBy(F.xxhash64("l_id"), "l_id"))  # cut before the shuffle, so no language is sorted whole
    spoken = known.withColumn("_k", place).where(F.col("_k") <= per_language).orderBy("_k", "l_lang").limit(max_documents).select("l_id", "l_lang", *[F.lit(0).cast("bigint").alias(n) for n in votes])
    rows = (
        documents.select(F.col("doc_id").cast("bigint").alias("d_id"), F.col("text").alias("d_text"))
        .where("d_text IS NOT NULL")
        .join(F.broadcast(levels.unionByName(spoken)), F.col("d_id") == F.col("l_id"))  # bounded by twice max_documents
        .select("d_text", "l_lang", *votes, "d_id")
        .toPandas()
        .sort_values("d_id", kind="stable")
    )
    levelled, spoken = rows[rows["l_lang"].isna()], rows[rows["l_lang"].notna()]
    if levelled.empty:
        raise ValueError("no labelled document to learn from")
    n = levelled[votes].to_numpy(float)
    model = fit_levels(levelled["d_text"].tolist(), n / n.sum(axis=1, keepdims=True), n.sum(axis=1), **options)
    model.language = fit_languages(spoken["d_text"].tolist(), spoken["l_lang"].tolist())
    return model


def reading_levels(documents: DataFrame, model: LevelModel, keep: Sequence[str] = ()) -> DataFrame:
    """Language, expected level and level distribution of each document, with the columns of ``keep``; no shuffle."""
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, F.col("text").alias("text"))
    kept = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(_score(shared, uuid.uuid4().hex), f"{kept}, {SCORED}")


def demanding_documents(documents: DataFrame, labels: DataFrame, *, at_least: int = 4, **options) -> DataFrame:
    """(doc_id) of English documents more likely than not at level ``at_least`` or above."""
    scored = reading_levels(documents, fit_reading_level(documents, labels, **options))
    reach = sum((F.col(f"p{k}") for k in range(at_least, LEVELS + 1)), F.lit(0.0))
    return scored.where((F.col("language") == ENGLISH) & (reach >= 0.5)).select("doc_id").distinct()
