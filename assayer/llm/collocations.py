"""Phrase collocations by top-order marginalisation: above the orders that pruning counts only longest
windows are counted, and grouping sets sum their shorter prefixes.

Words, then pairs, then triples are counted, each where the parts of one occur ``least`` times.  Every word
starts one window of up to ``LONGEST`` words, told by lead columns ``w1 … w5``.  A window is padded from the
end of its piece on, and from the first word, pair or triple on that occurs fewer than ``least`` times: no
phrase that is wanted, and no part of one, reaches over such a place, so every count of ``least`` or more is
exact.  A window that ends before its fourth word tells nothing new and goes no further; the others are folded
in their task before they move, and grouping sets make the counts of their prefixes of four words and five.

Words are named by 64-bit hashes that include the language, so no language appears in a key; texts of
words come back from the table of words at the end.  Which words, pairs and triples are frequent is told to
the tasks by bitmaps of fixed size; what a bitmap lets through in error has too low a count and goes later.

Score of a phrase that occurs ``a`` times: of all cuts into ``l`` and ``r`` occurrences of its parts the
least ``floor(1000 * a * n / (l * r))``, in decimals of 38 digits; ``n`` is the number of words in its
language.  A phrase within a longer one that occurs as often is dropped; it suffices to look one word
further, since a longer phrase passes its count down through all that lie between.

Defined results: a null or empty text has no words; a null language is ``und``, and one named so is the
same; repeated rows count as often as they stand; equal scores are ordered by count, then by phrase; an
empty table gives no rows; extra columns are ignored, ids are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import (
    Words,
    binary_text,
    bitmap_of,
    combine,
    in_bitmap,
    prepare,
    signed,
    unsigned,
    words_in,
)
from assayer.session import materialize

LONGEST = 5
LEAST = 100
TOP = 2000
CHUNK = 1 << 21  # names folded together
NO_WORD = 0
PRUNED = 2  # orders above one word that windows are pruned by: pairs, then triples

_CUTS = np.zeros(256, bool)
_CUTS[[ord(c) for c in ".,;:!?"]] = True
_CUTS[0x0A:0x0E] = True
_KIND = ~_CUTS
_KIND[[0x20, 0x09]] = False


def named_words(batch: pa.RecordBatch, words: Words) -> np.ndarray:
    """Names of all words, language included."""
    langs = batch.column(1).to_pylist()
    seeds = {x: np.frombuffer(hashlib.blake2b(x.encode(), digest_size=8).digest(), np.uint64)[0] for x in set(langs)}
    seed = np.array([seeds[x] for x in langs], np.uint64)
    names = combine(seed[words.doc], words.hashes())
    return np.where(names == NO_WORD, np.uint64(1), names)


def neighbours(words: Words) -> np.ndarray:
    """For every word but the last: does the next one stand in the same piece of the same text?"""
    cuts = np.concatenate([[0], np.cumsum(_CUTS[words.data], dtype=np.int32)])
    return (words.doc[1:] == words.doc[:-1]) & (cuts[words.starts[1:]] == cuts[words.ends[:-1]])


def word_texts(words: Words, which: np.ndarray) -> pa.Array:
    """The bytes of some words."""
    starts, lengths = words.starts[which], (words.ends - words.starts)[which]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    flat = words.data[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], lengths)]
    return pa.Array.from_buffers(
        pa.binary(), len(which), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)]
    )


def frequent_words(texts: DataFrame) -> DataFrame:
    """``lang, name, word, n`` of every word; folded per batch before it moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in words_in(batches, "text", _KIND, lower=True):
            names, first, n = np.unique(named_words(batch, words), return_index=True, return_counts=True)
            langs = batch.column(1).take(pa.array(words.doc[first]))
            yield pa.RecordBatch.from_arrays(
                [langs.cast(pa.string()), pa.array(signed(names)), word_texts(words, first), pa.array(n)],
                names=["lang", "name", "word", "n"],
            )

    found = texts.mapInArrow(count, "lang string, name bigint, word binary, n bigint")
    return found.groupBy("lang", "name", "word").agg(F.sum("n").alias("n"))


def _folded(parts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns of ``parts`` (one row a place in them) that differ, with their numbers.

    What a chunk folds to is folded again with the next one while it is small, so a task gives its
    frequent rows once; what is held is bounded by two chunks.
    """

    def fold(columns: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        name = columns[0]
        for column in columns[1:]:
            name = combine(name, column)
        _, first, place = np.unique(name, return_index=True, return_inverse=True)
        return columns[:, first], np.bincount(place, times, len(first)).astype(np.int64)

    held, counts, size = [], [], 0
    for part in parts:
        held.append(part)
        counts.append(np.ones(part.shape[1], np.int64))
        size += part.size
        if size < CHUNK:
            continue
        columns, n = fold(np.concatenate(held, axis=1), np.concatenate(counts))
        if columns.size > CHUNK // 2:
            yield columns, n
            held, counts, size = [], [], 0
        else:
            held, counts, size = [columns], [n], columns.size
    if size:
        yield fold(np.concatenate(held, axis=1), np.concatenate(counts))


def linked_places(words: Words, names: np.ndarray, common, linked: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For every order up to ``len(linked) + 1`` whether a phrase of frequent parts stands at a word;
    then where one of the next order may stand, and the names of those without their last words."""
    often = in_bitmap(common.value, signed(names))
    flags, grams = [often], names
    same = np.zeros(len(names), bool)
    same[:-1] = neighbours(words)
    for k in range(2, len(linked) + 3):
        at = np.flatnonzero(flags[-1][:-1] & flags[-1][1:] & same[:-1])
        if k == len(linked) + 2:
            return flags, at, grams[at]
        longer = combine(grams[at], names[at + k - 1])
        hit = in_bitmap(linked[k - 2].value, signed(longer))
        found = np.zeros(len(names), bool)
        found[at[hit]] = True
        grams = grams.copy()
        grams[at[hit]] = longer[hit]
        flags.append(found)
    raise AssertionError


def _counted(parts: Iterator[np.ndarray], leads: list[str]) -> Iterator[pa.RecordBatch]:
    for columns, n in _folded(parts):
        yield pa.RecordBatch.from_arrays([*(pa.array(signed(c)) for c in columns), pa.array(n)], names=[*leads, "n"])


def frequent_grams(texts: DataFrame, common, linked: list, least: int) -> DataFrame:
    """``head, word, n`` of the phrases of ``len(linked) + 2`` words that occur ``least`` times; the head is
    the name of all words but the last."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch, words in words_in(batches, "text", _KIND, lower=True):
            if len(words):
                names = named_words(batch, words)
                _, at, heads = linked_places(words, names, common, linked)
                yield np.stack([heads, names[at + len(linked) + 1]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(grams(batches), ["head", "word"])

    found = texts.mapInArrow(count, "head bigint, word bigint, n bigint")
    return found.groupBy("head", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def spelled_grams(grams: DataFrame, heads: DataFrame) -> DataFrame:
    """``name, key, n`` of ``head, word, n``, whose heads are among the names of ``heads``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = combine(*(unsigned(batch.column(i).to_numpy()) for i in range(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(name))], names=[*batch.schema.names, "name"])

    named = grams.mapInArrow(run, "head bigint, word bigint, n bigint, name bigint")
    key = F.concat("key", F.array("word")).alias("key")
    return named.join(heads.select(F.col("name").alias("head"), "key"), "head").select("name", key, "n")


def windows(texts: DataFrame, common, linked: list) -> DataFrame:
    """``w1 … w5, n``: the longest window from every frequent word on, padded with ``NO_WORD``, if it is
    longer than the phrases that ``linked`` tells of."""
    known = len(linked) + 1

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch, words in words_in(batches, "text", _KIND, lower=True):
            if not len(words):
                continue
            names = named_words(batch, words)
            flags, _, _ = linked_places(words, names, common, linked)
            last = len(names) - 1
            # a window that goes on after what is counted already begins with a frequent phrase of that order
            start = np.flatnonzero(flags[-1])
            columns, open_ = [names[start]], np.ones(len(start), bool)
            for k in range(2, LONGEST + 1):
                # the window goes on to its k-th word if the phrase that ends there may be frequent
                order = min(k, len(flags))
                open_ = open_ & flags[order - 1][np.minimum(start + k - order, last)]
                columns.append(np.where(open_, names[np.minimum(start + k - 1, last)], np.uint64(NO_WORD)))
            found = np.stack(columns)
            yield found[:, found[known] != NO_WORD]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(leads(batches), _LEADS)

    schema = ", ".join(f"{c} bigint" for c in [*_LEADS, "n"])
    return texts.mapInArrow(count, schema)


_LEADS = [f"w{k}" for k in range(1, LONGEST + 1)]


def phrase_counts(found: DataFrame, known: list[DataFrame], least: int) -> DataFrame:
    """``key`` (array of names), ``size`` and ``n`` of every phrase that occurs ``least`` times.

    ``known`` has the keys of one word, of two and so on, counted before; of windows the longer prefixes count.
    """
    sizes = range(LONGEST, len(known), -1)
    rolled = found.groupingSets([[F.col(c) for c in _LEADS[:k]] for k in sizes], *_LEADS)
    rolled = rolled.agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    # of the columns that are not summed over the last must be a word
    size = F.lit(LONGEST) - F.bit_count("level")
    names = F.array(*_LEADS)
    kept = rolled.withColumn("size", size).filter((F.col("n") >= least) & (F.get(names, F.col("size") - 1) != NO_WORD))
    out = kept.select(F.slice(names, F.lit(1), F.col("size")).alias("key"), "size", "n")
    for k, frame in enumerate(known, 1):
        out = out.unionAll(frame.select("key", F.lit(k).alias("size"), "n"))
    return out


def independent(counts: DataFrame) -> DataFrame:
    """Phrases of two words and more that no longer phrase contains as often."""
    longer = counts.filter("size > 2").select(
        F.explode(F.array(F.expr("slice(key, 1, size - 1)"), F.expr("slice(key, 2, size - 1)"))).alias("key"),
        F.col("n").alias("more"),
    )
    longer = longer.groupBy("key").agg(F.max("more").alias("more"))
    joined = counts.filter("size > 1").join(longer, "key", "left")
    return joined.filter(F.col("more").isNull() | (F.col("more") < F.col("n"))).drop("more")


def _digits(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` collocations of every language."""
    context = prepare(docs.sparkSession).sparkContext
    lang = F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit("und"))
    texts = docs.select(binary_text(f"`{text_column}`"), lang.alias("lang"))
    words = materialize(frequent_words(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    often = words.filter(F.col("n") >= least)
    common = context.broadcast(bitmap_of(often.select("name"), "name"))
    linked, known = [], [often.select("name", F.array("name").alias("key"), "n")]
    for _ in range(PRUNED):
        grams = spelled_grams(frequent_grams(texts, common, linked, least), known[-1])
        known.append(materialize(grams, "grams"))
        linked.append(context.broadcast(bitmap_of(known[-1], "name")))
    counts = materialize(phrase_counts(windows(texts, common, linked), known, least), "phrases")

    found = independent(counts).withColumnRenamed("n", "a")
    cut = found.select("key", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "*", F.expr("slice(key, 1, k)").alias("head"), F.expr("slice(key, k + 1, size(key) - k)").alias("tail")
    )
    heads = counts.select(F.col("key").alias("head"), F.col("n").alias("l"))
    tails = counts.select(F.col("key").alias("tail"), F.col("n").alias("r"))
    cut = cut.join(heads, "head").join(tails, "tail").select("key", "a", "k", "l", "r")

    spelled = cut.select("key").distinct().select("key", F.posexplode("key").alias("at", "name"))
    spelled = spelled.join(often.select("name", "lang", "word"), "name").groupBy("key").agg(
        F.any_value("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words")
    )
    phrase = F.array_join(F.transform("words", lambda x: x["word"].cast("string")), " ")
    spelled = spelled.select("key", "lang", phrase.alias("phrase")).join(totals, "lang")

    # the divisor is a whole number, so floor and div agree
    score = (F.lit(1000).cast("decimal(38,0)") * _digits("a") * _digits("total")).alias("above")
    scored = cut.join(spelled, "key").select("*", score, (_digits("l") * _digits("r")).alias("below"))
    scored = scored.withColumn("score", F.expr("above div below"))
    best = scored.groupBy("key", "lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "best.l", "best.r",
        F.col("total").alias("n"), "best.score",
    )
