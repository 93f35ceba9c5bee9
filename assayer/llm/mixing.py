"""Mixing to target weights with soft membership.

A classifier trained on a labelled table gives every document a posterior over domains.  A document
of ``n`` tokens at rate ``r`` is expected to give ``r * n * p[k]`` tokens to domain ``k``.  Least
squares fit the rates: half the squared distance of the totals from their targets falls along projected
gradient steps ``rate <- max(0, rate - p . x)``, from rates of one on.  ``x`` is the miss, scaled by the
inverse of the summed products of posteriors over the documents whose rate is positive, so that one step
would meet the targets if it took no rate below zero; where that brings no total nearer, the miss scaled by
the products over all documents or by their greatest eigenvalue, which always does.  In each pass Spark sums
totals and products for some lengths of a step, and the driver, which holds a matrix of domains, takes the
best.  A rate depends on the posteriors and the steps alone, so no state of documents is kept.

Defined results: a null or empty text has no tokens and the posterior of the bias, and gets its rate
like others; unlabelled documents, null labels and labels of absent documents play no part in
training, of repeated labels the smallest domain counts; without any labelled document all posteriors
are equal; an empty table gives no rows; a domain with a target but no tokens stays short,
and what is missed by more than ``TOLERANCE`` is logged as a warning.
Other columns are kept, one named like an added one is replaced.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import SPACED, other_columns, prepare, words_of
from assayer.llm.linear import LinearModel, fit
from assayer.session import materialize

SAMPLE = 8192
FEATURES = 1 << 18
STEPS = 60
TOLERANCE = 1e-6
# Shares of a scaled step that one pass tries.
TRIED = (1.0, 0.5, 0.1)

log = logging.getLogger(__name__)


def word_features(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and hashed word, each pair once, and the number of words of every document."""
    words = words_of(batch, column, SPACED, lower=True)
    # a closing mark is not part of the word
    data, ends = words.data, words.ends.copy()
    marks = np.isin(data, np.frombuffer(b".,;:!?", np.uint8))
    trim = marks[ends - 1] & (ends - words.starts > 1)
    ends[trim] -= 1
    words.ends = ends
    key = np.unique((words.doc.astype(np.int64) << 18) | (words.hashes() >> np.uint64(46)).astype(np.int64))
    return key >> 18, key & (FEATURES - 1), words.counts


def train(
    docs: DataFrame, labelled: DataFrame, domains: int, id_column: str = "doc_id", text_column: str = "text",
    sample: int = SAMPLE,
) -> LinearModel:
    """Classifier over hashed words from at most ``sample`` labelled documents.

    ``labelled`` has ``id_column`` and ``domain`` (0 to ``domains`` - 1).  The labelled rows are
    drawn by hash of their id, so what is broadcast to the texts is bounded; of texts that repeat a
    labelled id at most as many again are taken.
    """
    prepare(docs.sparkSession)
    labels = labelled.select(F.col(f"`{id_column}`").alias("id"), F.col("domain").cast("int").alias("domain"))
    labels = labels.filter("id is not null and domain is not null").groupBy("id").agg(F.min("domain").alias("domain"))
    labels = labels.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.coalesce(F.col(f"`{text_column}`").cast("binary"), F.lit(b"")).alias("text"),
    ).join(F.broadcast(labels), "id").select("domain", "text").limit(2 * sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, feature, _ = word_features(batch, "text")
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["domain", "feature"])

    got = texts.mapInArrow(features, "domain int, feature array<int>").toArrow().combine_chunks()
    domain = got["domain"].to_numpy().astype(np.int64)
    lists = got["feature"].combine_chunks()
    doc = np.repeat(np.arange(len(domain), dtype=np.int32), lists.value_lengths().to_numpy()) if len(domain) else np.zeros(0, np.int32)
    feature = lists.flatten().to_numpy()
    del got, lists
    pa.default_memory_pool().release_unused()
    # a word of one document tells nothing about others
    often = (np.bincount(feature, minlength=FEATURES) >= 3)[feature]
    doc, feature = doc[often], feature[often]
    pa.default_memory_pool().release_unused()
    return fit(doc, feature, np.ones(len(doc), np.float32), np.eye(domains)[domain], FEATURES, steps=80, l2=1e-3)


def posteriors(
    docs: DataFrame, model: LinearModel, text_column: str = "text", steps: Sequence[Sequence[float]] | None = None
) -> DataFrame:
    """All columns of ``docs``, ``n_tokens`` and ``posterior``, an array over the domains; after
    ``steps`` also the ``rate``."""
    added = ("n_tokens", "posterior", "rate")[: 2 if steps is None else 3]
    rows = docs.select(*(F.col(f"`{c}`") for c in other_columns(docs, added)))
    kinds = (T.LongType(), T.ArrayType(T.DoubleType()), T.DoubleType())
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, k) for c, k in zip(added, kinds, strict=False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, feature, n = word_features(batch, text_column)
            chance = model.probabilities(doc, feature, np.ones(len(doc)), batch.num_rows)
            bounds = (np.arange(batch.num_rows + 1) * chance.shape[1]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(chance.ravel()))
            more = [pa.array(n.astype(np.int64)), lists]
            if steps is not None:
                more.append(pa.array(rates_after(chance, steps)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *added])

    return rows.mapInArrow(run, schema)


def rates_after(posterior: np.ndarray, steps: Sequence[Sequence[float]]) -> np.ndarray:
    """Rates of documents after all steps: from one, down the gradient, never below zero."""
    rate = np.ones(len(posterior))
    for step in steps:
        rate = np.maximum(0.0, rate - posterior @ np.asarray(step))
    return rate


def _matrix(batch: pa.RecordBatch, name: str, domains: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy().reshape(-1, domains)


def fit_rates(
    members: DataFrame, weights: Sequence[float], budget: float = 1.0, steps: int = STEPS, tolerance: float = TOLERANCE
) -> tuple[list[list[float]], np.ndarray, np.ndarray]:
    """The steps that bring the expected domain totals to ``weights`` times ``budget``.

    ``members`` has ``n_tokens`` and ``posterior``; totals are shares of all its tokens.  Steps end when
    every total is within ``tolerance`` of its target, or, where targets cannot be met together, when none
    brings the totals nearer; at most ``steps`` passes, each of one sum per batch.  Returns the steps, the
    totals reached and the targets.
    """
    k = len(weights)
    target = np.asarray(weights, np.float64) / np.sum(weights) * budget
    each = k + k * k

    def sums(history: list[list[float]], moves: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """After the history and each of the moves: totals, and products over positive rates."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                posterior, n = _matrix(batch, "posterior", k), batch.column(0).to_numpy()
                before = rates_after(posterior, history)
                values = [float(n.sum())]
                for move in moves:
                    rate = np.maximum(0.0, before - posterior @ move)
                    active = posterior * ((rate > 0) * n)[:, None]
                    values += [*((rate * n) @ posterior), *(active.T @ posterior).ravel()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(np.array(values, np.float64))], names=["at", "value"]
                )

        # a row for each sum: a plan of one column for each would be planned and kept anew in every pass
        parts = members.select("n_tokens", "posterior").mapInArrow(run, "at int, value double")
        got = np.zeros(1 + each * len(moves))
        for row in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
            got[row["at"]] = row["value"]
        got = (got[1:] / max(1.0, got[0])).reshape(len(moves), each)
        return [(g[:k], g[k:].reshape(k, k)) for g in got]

    def scaled(products: np.ndarray, miss: np.ndarray) -> np.ndarray:
        """The miss by the inverse of the products; a domain without tokens asks for nothing."""
        size, axes = np.linalg.eigh(products)
        inverse = np.where(size > 1e-12 * max(size.max(), 1e-300), 1 / np.maximum(size, 1e-300), 0.0)
        return axes @ (inverse * (axes.T @ miss))

    history: list[list[float]] = []
    total, active = sums(history, [np.zeros(k)])[0]
    whole = active
    widest = max(float(np.linalg.eigvalsh(whole).max()), 1e-300)
    for _ in range(steps):
        miss = total - target
        if np.abs(miss).max() < tolerance:
            break
        moves = [share * scaled(products, miss) for products in (active, whole) for share in TRIED] + [miss / widest]
        tried = sums(history, moves)
        losses = [float(np.square(found[0] - target).sum()) for found in tried]
        best = int(np.argmin(losses))
        if losses[best] >= float(np.square(miss).sum()) * (1 - 1e-6):
            break
        history.append(moves[best].tolist())
        total, active = tried[best]
    said = log.warning if np.abs(total - target).max() > tolerance else log.info
    said("domain totals after %d steps: reached %s, target %s", len(history), total.tolist(), target.tolist())
    return history, total, target


def mix(
    docs: DataFrame, labelled: DataFrame, weights: Sequence[float], budget: float = 1.0,
    id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE,
) -> DataFrame:
    """All columns of ``docs`` and ``n_tokens, posterior, rate, copies``.

    ``copies`` rounds the rate up or down by a hash of id and text, so that its expectation is the
    rate; equal rows are rounded alike.
    """
    k = len(weights)
    model = train(docs, labelled, k, id_column, text_column, sample)
    members = posteriors(docs, model, text_column).select("n_tokens", "posterior")
    history, _, _ = fit_rates(materialize(members, "members"), weights, budget)
    rated = posteriors(docs.select(*(F.col(f"`{c}`") for c in other_columns(docs, ("copies",)))), model, text_column, history)
    draw = F.pmod(F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", F.floor(F.col("rate") + draw).cast("bigint"))
