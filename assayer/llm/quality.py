"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  Their votes are counted by
pattern, at most three to the number of labellers, and expectation-maximisation over these counts
(all documents, not a sample) estimates how often each labeller is right.  The posterior of a
pattern labels its documents, and these soft labels train a linear scorer over hashed character
shapes, on a sample of at most ``SAMPLE`` documents.  The scorer judges every whole text.

Defined results: a null or empty text draws no votes and has no features: its score is that of the
scorer's bias alone, the share of good documents; repeated rows get equal scores; an empty table
gives no rows; other columns are kept, one named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import SPACED, binary_column, mix, other_columns, prepare, words_of
from assayer.llm.linear import LinearModel, fit

SAMPLE = 8192
FEATURES = 1 << 14
GRAM = 4
SHRINK = 100
PART = 1 << 20
GOOD, BAD, NONE = 1, 0, 2

_B = np.arange(256)
_UPPER = (_B >= 0x41) & (_B <= 0x5A)
_LOWER = (_B >= 0x61) & (_B <= 0x7A)
_DIGIT = (_B >= 0x30) & (_B <= 0x39)
_SPACE = ~SPACED
_LETTER = _UPPER | _LOWER | (_B >= 0x80)
_SYMBOL = np.isin(_B, np.frombuffer(b"|#$%&*{}<>^~=_\\@+", np.uint8))
_STOP = np.isin(_B, np.frombuffer(b".!?", np.uint8))
# Letters of one kind count as one; punctuation stands for itself.
_SHAPE = _B.astype(np.uint8).copy()
_SHAPE[_UPPER], _SHAPE[_LOWER], _SHAPE[_DIGIT], _SHAPE[_B >= 0x80] = ord("A"), ord("a"), ord("0"), ord("a")
_SHAPE[_SPACE] = 0x20


def parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about ``PART`` bytes of text: what is computed per byte stays small."""
    _, offsets = binary_column(batch, column)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + PART, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _good(value: np.ndarray) -> np.ndarray:
    return np.where(value, GOOD, NONE)


def _bad(value: np.ndarray) -> np.ndarray:
    return np.where(value, BAD, NONE)


# The first six find one kind of fault each and else say nothing; the last two vouch for a text.
LABELLERS = ("symbols", "capitals", "echoes", "exclaims", "variety", "lengths", "sentences", "plain")


def votes(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Votes of all labellers, documents x labellers."""
    data, offsets = binary_column(batch, column)
    size = np.diff(offsets)
    words = words_of(batch, column, SPACED, lower=True)
    n = words.counts.astype(np.float64)
    some = np.maximum(n, 1)
    letters = _sums(_UPPER[data] | _LOWER[data], offsets)
    hashes = words.hashes()
    echo = np.zeros(len(words), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    echoes = np.bincount(words.doc, echo, batch.num_rows) / some
    symbols = _sums(_SYMBOL[data], offsets) / np.maximum(size, 1)
    capitals = _sums(_UPPER[data], offsets) / np.maximum(letters, 1)
    stops = _sums(_STOP[data], offsets) / some
    exclaims = _sums(data == ord("!"), offsets) / some
    # different words among the first of a word's neighbours: short range, so length plays no part
    keys = mix(hashes ^ words.doc.astype(np.uint64))
    back = 32
    seen = np.zeros(len(words), bool)
    for step in range(1, back + 1):
        if len(words) > step:
            seen[step:] |= keys[step:] == keys[:-step]
    variety = 1 - np.bincount(words.doc, seen, batch.num_rows) / some
    mean = size / some
    enough = n >= 20
    signs = _sums(~_SPACE[data] & ~_LETTER[data] & ~_DIGIT[data], offsets)
    printed = np.maximum(size - _sums(_SPACE[data], offsets), 1)
    return np.stack(
        [
            _bad(symbols > 0.02),
            _bad((letters >= 20) & (capitals > 0.4)),
            _bad((n >= 8) & (echoes > 0.1)),
            _bad((n >= 4) & (exclaims > 0.2)),
            _bad(enough & (variety < 0.4)),
            _bad((n > 0) & ((mean > 16) | (mean < 2))),
            _good((stops > 0.02) & (exclaims < 0.05) & (symbols < 0.01)),
            _good((size > 0) & (signs / printed < 0.15) & (capitals < 0.4) & (symbols < 0.01)),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class LabelModel:
    prior: float  # share of good documents
    chance: np.ndarray  # labeller x class (bad, good) x vote (bad, good, none)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a document with these votes is good."""
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :].repeat(len(patterns), axis=0)
        for j in range(patterns.shape[1]):
            log += np.log(self.chance[j][:, patterns[:, j]].T)
        return 1 / (1 + np.exp(np.clip(log[:, BAD] - log[:, GOOD], -700, 700)))

    @property
    def accuracy(self) -> np.ndarray:
        """Chance that a labeller is right, given that it votes."""
        weight = np.array([1 - self.prior, self.prior])
        right = self.chance[:, BAD, BAD] * weight[BAD] + self.chance[:, GOOD, GOOD] * weight[GOOD]
        return right / (self.chance[:, :, :2].sum(axis=2) @ weight)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> LabelModel:
    """Expectation-maximisation for labellers that vote independently given the class.

    Starts from labellers that find two faults in five and raise one false alarm in fifty, which
    also says which of the two classes is the bad one.  Counts are smoothed by these chances.
    """
    k = patterns.shape[1]
    start = np.tile(np.array([[0.4, 0.2, 0.4], [0.02, 0.8, 0.18]]), (k, 1, 1))
    model = LabelModel(0.8, start)
    for _ in range(steps):
        good = model.posterior(patterns) if len(patterns) else np.zeros(0)
        weight = np.stack([counts * (1 - good), counts * good])
        chance = start.copy()
        for j in range(k):
            for vote in (BAD, GOOD, NONE):
                chance[j, :, vote] += weight[:, patterns[:, j] == vote].sum(axis=1)
        chance /= chance.sum(axis=2, keepdims=True)
        total = weight.sum(axis=1)
        prior = float((total[GOOD] + 0.8) / (total.sum() + 1))
        moved = abs(prior - model.prior) + np.abs(chance - model.chance).max()
        model = LabelModel(prior, chance)
        if moved < 1e-9:
            break
    return model


def shape_features(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hashed shape n-gram, and the weight of a place, for every place."""
    data, offsets = binary_column(batch, column)
    shape = _SHAPE[data].astype(np.uint32)
    last = max(0, len(shape) - GRAM + 1)
    code = np.zeros(last, np.uint32)
    for j in range(GRAM):
        code = code * np.uint32(257) + shape[j : j + last]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - 14)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    inside = doc[:last] == doc[GRAM - 1 :] if last else np.zeros(0, bool)
    doc, code = doc[:last][inside], code[inside]
    size = np.bincount(doc, minlength=batch.num_rows)
    # a short text has few places to tell by, so its shares count for less
    return doc, code, 20 / (size[doc] + SHRINK)


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    scorer: LinearModel


def train(docs: DataFrame, text_column: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Fit the label model on all documents and the scorer on at most ``sample`` different texts.

    The sample are the texts with the smallest hashes, each once and with the number of its copies
    as weight.  The driver sees pattern counts and the sample's features, at most ``sample`` rows of
    at most ``FEATURES`` numbers.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{text_column}`").cast("binary"), F.lit(b"")).alias("text"))
    powers = 3 ** np.arange(len(LABELLERS))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, "text")):
            found, n = np.unique(votes(batch, "text") @ powers, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pattern", "n"])

    counted = texts.mapInArrow(patterns, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    table = counted.orderBy("pattern").toPandas()
    codes = table["pattern"].to_numpy(np.int64)
    count = table["n"].to_numpy(np.float64)
    labels = fit_labels(codes[:, None] // powers % 3, count)
    named = texts.select(F.xxhash64("text").alias("name"), "text")
    drawn = named.groupBy("name").agg(F.count("*").alias("n")).orderBy("name").limit(sample).toArrow()
    chosen, copies = drawn["name"].to_numpy(), drawn["n"].to_numpy()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in wanted(batches) for part in parts(whole, "text")):
            doc, code, value = shape_features(batch, "text")
            key, inverse = np.unique(doc.astype(np.int64) * FEATURES + code, return_inverse=True)
            total = np.bincount(inverse, value, len(key)).astype(np.float32)
            bounds = np.searchsorted(key // FEATURES, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = lambda flat: pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
            good = labels.posterior(votes(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(good), lists((key % FEATURES).astype(np.int32)), lists(total)],
                names=["name", "good", "feature", "value"],
            )

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each text once a task: of copies in other tasks one stays below
        seen: set[int] = set()
        for batch in batches:
            names = batch.column(0).to_numpy()
            first = np.zeros(len(names), bool)
            for i in np.flatnonzero(np.isin(names, chosen)):
                first[i] = names[i] not in seen
                seen.add(int(names[i]))
            yield batch.filter(pa.array(first))

    found = named.mapInArrow(features, "name bigint, good double, feature array<int>, value array<float>")
    got = found.dropDuplicates(["name"]).orderBy("name").toArrow().combine_chunks()
    good = got["good"].to_numpy()
    weight = copies[np.searchsorted(chosen, got["name"].to_numpy())]
    lists = got["feature"].combine_chunks()
    doc = np.repeat(np.arange(len(good), dtype=np.int32), lists.value_lengths().to_numpy()) if len(good) else np.zeros(0, np.int32)
    feature, value = lists.flatten().to_numpy(), got["value"].combine_chunks().flatten().to_numpy()
    scorer = fit(doc, feature, value, np.stack([1 - good, good], axis=1), FEATURES, weight=weight)
    del got, lists, feature, value
    pa.default_memory_pool().release_unused()
    return QualityModel(labels, scorer)


def score(docs: DataFrame, model: QualityModel, text_column: str = "text") -> DataFrame:
    """All columns of ``docs``, ``posterior`` of its votes and ``score``, the scorer's chance of good."""
    from pyspark.sql import types as T

    added = ("posterior", "score")
    rows = docs.select(*(F.col(f"`{c}`") for c in other_columns(docs, added)))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in added)])
    labels, scorer = model.labels, model.scorer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, text_column)):
            doc, code, value = shape_features(batch, text_column)
            chance = scorer.probabilities(doc, code, value, batch.num_rows)[:, GOOD]
            posterior = labels.posterior(votes(batch, text_column))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(posterior), pa.array(chance)], names=[*batch.schema.names, *added]
            )

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, text_column: str = "text") -> DataFrame:
    """Train on ``docs`` and add ``posterior``, ``score`` and ``kept``: score at or above the threshold."""
    scored = score(docs, train(docs, text_column, sample), text_column)
    others = [F.col(f"`{c}`") for c in other_columns(scored, ("kept",))]
    return scored.select(*others, (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, text_column: str = "text") -> DataFrame:
    """The rows that ``classify`` keeps, with their own columns only; rows stay in their tasks."""
    model = train(docs, text_column, sample)
    scorer, schema = model.scorer, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, text_column)):
            doc, code, value = shape_features(batch, text_column)
            yield batch.filter(pa.array(scorer.probabilities(doc, code, value, batch.num_rows)[:, GOOD] >= threshold))

    return docs.mapInArrow(run, schema)
