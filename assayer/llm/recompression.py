"""Substring deduplication by recompression of word sequences.

A round of recompression first names runs of equal symbols, then pairs: a symbol is left or right by
a bit of its name and the round, and a left one followed by a right one becomes a new symbol.  Names
are hashes of what they stand for, so all tasks give equal substrings equal names without asking
each other.  A symbol is certain within its context, the words that decide it; inside two equal
substrings the symbols whose context lies inside are the same.

Two rounds leave every window of 13 words at least one certain symbol, or it lies in a run or a
repetition.  Each window selects one chain of certain symbols (as long a chain as it has, of these
the one with the least name), or is its own name where it has none.  Chains that occur in more than
one document reveal repeats: only windows around them are named as a whole, and compared by these
names.  A window is removed where a document with a smaller id has it too.

What meets in one place is reduced first: within a batch, of the documents with the same chain or
window one asks and the others know already, so a passage that a third of all documents share sends
one row per batch.

Defined results: a null or empty text has no words; a null id counts as larger than every other;
documents with equal ids never remove each other's words and get a row each; texts shorter than a
window keep all words; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import (
    SPACED,
    Words,
    binary_text,
    bitmap_of,
    combine,
    in_bitmap,
    mix,
    prepare,
    repeated,
    signed,
    unsigned,
    words_in,
)
from assayer.session import materialize

WINDOW = 13
ROUNDS = 2
CHAINS = (3, 2, 1)
NO_ID = np.iinfo(np.int64).max


def compress(names: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, round_: int):
    """One round over symbols with contexts ``lo..hi``: name runs, then pairs.

    A new symbol's context reaches over the symbols on both sides; at the ends of a text there are
    none, and the symbol is never certain (``lo`` is -1, or ``hi`` past everything).
    """
    n = len(names)
    if not n:
        return names, lo, hi, doc
    first = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], n) - 1
    letters, own = names[first], doc[first]
    size = (last - first + 1).astype(np.uint64)
    runs = np.where(size > 1, combine(letters, size), letters)
    left = (mix(letters ^ np.uint64(0x5851F42D4C957F2D * (round_ + 1) % (1 << 64))) & np.uint64(1)).astype(bool)
    paired = np.zeros(len(first), bool)
    paired[:-1] = left[:-1] & ~left[1:] & (own[:-1] == own[1:])
    second = np.zeros(len(first), bool)
    second[1:] = paired[:-1]
    heads = np.flatnonzero(~second)
    tails = heads + paired[heads]
    new = np.where(paired[heads], combine(runs[heads], runs[np.minimum(heads + 1, len(first) - 1)]), runs[heads])
    a, b = first[heads], last[tails]
    inner_a = (a > 0) & (doc[np.maximum(a - 1, 0)] == doc[a])
    inner_b = (b < n - 1) & (doc[np.minimum(b + 1, n - 1)] == doc[b])
    new_lo = np.where(inner_a, lo[np.maximum(a - 1, 0)], -1)
    new_hi = np.where(inner_b, hi[np.minimum(b + 1, n - 1)], np.iinfo(np.int64).max)
    return new, new_lo, new_hi, own[heads]


def window_starts(words: Words, window: int) -> np.ndarray:
    """Index of the first word of every window of every text."""
    last = len(words) - window + 1
    if last <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.doc[:last] == words.doc[window - 1 :])


def selected_chains(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window its start and the name of the chain that it selects.

    The choice depends on the window's words alone, so equal windows choose equal names.
    """
    starts = window_starts(words, window)
    chosen = np.zeros(len(starts), np.uint64)
    place = np.arange(len(hashes))
    names, lo, hi, doc = hashes, place, place, words.doc
    for round_ in range(ROUNDS):
        names, lo, hi, doc = compress(names, lo, hi, doc, round_)
    open_ = np.arange(len(starts))
    for size in CHAINS:
        if len(names) < size or not len(open_):
            continue
        chain = np.full(len(names) - size + 1, np.uint64(size))
        for j in range(size):
            chain = combine(chain, names[j : len(names) - size + 1 + j])
        a, b = lo[: len(chain)], hi[size - 1 :]
        fits = (a >= 0) & (b < len(hashes)) & (doc[: len(chain)] == doc[size - 1 :])
        chain, a, b = chain[fits], a[fits], b[fits]
        if not len(chain):
            continue
        # contexts move on with the chain, so those inside a window are neighbours
        before = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(hashes)))])
        until = np.cumsum(np.bincount(b, minlength=len(hashes)))
        begin = before[starts[open_]]
        end = until[starts[open_] + window - 1]
        has = begin < end
        begin, end, at = begin[has], end[has], open_[has]
        best = chain[begin]
        step = 1
        more = np.flatnonzero(begin + step < end)
        while len(more):
            best[more] = np.minimum(best[more], chain[begin[more] + step])
            step += 1
            more = more[begin[more] + step < end[more]]
        chosen[at] = best
        open_ = open_[~has]
    if len(open_):
        whole = hashes[starts[open_]]
        for j in range(1, window):
            whole = combine(whole, hashes[starts[open_] + j])
        chosen[open_] = mix(whole)
    return starts, chosen


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(NO_ID).to_numpy().astype(np.int64)


def _unique_pairs(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(name, id)``, sorted by name and id."""
    order = np.lexsort((ids, names))
    names, ids = names[order], ids[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (ids[1:] != ids[:-1])
    return names[new], ids[new]


ASKED = "name bigint, id bigint, known boolean"


def _asked(names: np.ndarray, ids: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(names)), pa.array(ids), pa.array(known)], names=["name", "id", "known"]
    )


def _deal(asked: DataFrame) -> DataFrame:
    """Rows that ask go to the place of their name, those that know are spread by their id."""
    place = F.when(F.col("known"), F.xxhash64("id")).otherwise(F.col("name"))
    return asked.repartition(place)


def shared_chains(texts: DataFrame, window: int) -> DataFrame:
    """``name, id`` of the selected chains that more than one document has (or one id twice)."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in words_in(batches, "text", SPACED, lower=False):
            starts, chosen = selected_chains(words, words.hashes(), window)
            names, ids = _unique_pairs(chosen, _ids(batch)[words.doc[starts]])
            again = np.zeros(len(names), bool)
            again[1:] = names[1:] == names[:-1]
            # of the documents of this batch with one chain: the first asks for all others, and
            # learns that it is shared from a second row of its own that knows
            shared = again.copy()
            shared[:-1] |= again[1:]
            heads = np.flatnonzero(~again)
            knows = np.flatnonzero(shared)
            yield _asked(
                np.concatenate([names[heads], names[knows]]), np.concatenate([ids[heads], ids[knows]]),
                np.concatenate([np.zeros(len(heads), bool), np.ones(len(knows), bool)]),
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, twice in repeated(batches):
            kept = batch.filter(pa.array(twice | batch.column(2).to_numpy(zero_copy_only=False)))
            yield kept.select(["name", "id"])

    asked = _deal(texts.mapInArrow(select, ASKED)).sortWithinPartitions("name")
    return asked.mapInArrow(meet, "name bigint, id bigint")


def _texts_of(texts: DataFrame, sets: DataFrame, how: str) -> DataFrame:
    """``id, text, names``: texts with the names listed for their id.

    A bitmap of fixed size over the ids keeps most other texts in their tasks.
    """
    bitmap = texts.sparkSession.sparkContext.broadcast(bitmap_of(sets, "id"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap.value, _ids(batch))))

    keyed = texts.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text")
    lists = sets.groupBy("id").agg(F.collect_list("name").alias("names"))
    picked = keyed.mapInArrow(pick, "id bigint, text binary")
    return picked.join(lists.hint("merge"), "id", how).select("id", "text", "names")


def _listed(batch: pa.RecordBatch, doc: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of ``names`` are on the list (third column) of the document they stand in."""
    lists = batch.column(2)
    lengths = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(batch.num_rows), lengths).astype(np.uint64)
    have = np.sort(combine(unsigned(lists.flatten().to_numpy()), rows))
    if not len(have):
        return np.zeros(len(names), bool)
    asked = combine(names, doc.astype(np.uint64))
    at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
    return have[at] == asked


def repeated_windows(texts: DataFrame, chains: DataFrame, window: int) -> DataFrame:
    """``name, id`` of the windows that a document with a smaller id has too."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in words_in(batches, "text", SPACED, lower=False):
            hashes = words.hashes()
            starts, chosen = selected_chains(words, hashes, window)
            near = starts[_listed(batch, words.doc[starts], chosen)]
            names = hashes[near]
            for j in range(1, window):
                names = combine(names, hashes[near + j])
            names, ids = _unique_pairs(names, _ids(batch)[words.doc[near]])
            # sorted by id within a name: all but the smallest of this batch know the answer
            known = np.zeros(len(names), bool)
            known[1:] = names[1:] == names[:-1]
            yield _asked(names, ids, known)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, least = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            known = batch.column(2).to_numpy(zero_copy_only=False)
            first = np.concatenate([[True], names[1:] != names[:-1]])
            begin = np.flatnonzero(first)
            smallest = ids[begin].copy()
            if names[0] == name:
                smallest[0] = least
            smallest_of = smallest[np.cumsum(first) - 1]
            name, least = names[-1], smallest_of[-1]
            yield batch.filter(pa.array((ids > smallest_of) & ~known)).select(["name", "id"])

    near = _texts_of(texts, chains, "inner").mapInArrow(windows, ASKED)
    near = materialize(near, "windows")
    asked = near.filter("not known").repartition("name").sortWithinPartitions("name", "id")
    found = asked.mapInArrow(judge, "name bigint, id bigint")
    return found.unionAll(near.filter("known").select("name", "id"))


RESULT = "id bigint, n_words bigint, n_removed bigint, kept binary, kept_sha256 string"


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``id, n_words, n_removed, kept, kept_sha256`` of every document.

    ``kept`` are the words left, joined by one space.  A word goes where a window of ``window``
    words that covers it also starts in a document with a smaller id, judged on the input.
    """
    prepare(docs.sparkSession)
    texts = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"), binary_text(f"`{text_column}`")
    )
    chains = materialize(shared_chains(texts, window), "chains")
    removed = materialize(repeated_windows(texts, chains, window), "removed")
    bitmap = texts.sparkSession.sparkContext.broadcast(bitmap_of(removed, "id"))

    def rows(batch: pa.RecordBatch, kept: list[bytes], n: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        ids = _ids(batch)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=ids == NO_ID), pa.array(n.astype(np.int64)), pa.array(gone.astype(np.int64)),
                pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            ],
            names=["id", "n_words", "n_removed", "kept", "kept_sha256"],
        )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that surely keep all words."""
        for batch in batches:
            batch = batch.filter(pa.array(~in_bitmap(bitmap.value, _ids(batch))))
            split = [text.split() for text in batch.column(1).to_pylist()]
            n = np.array([len(words) for words in split], np.int64)
            yield rows(batch, [b" ".join(words) for words in split], n, np.zeros(len(n), np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in words_in(batches, "text", SPACED, lower=False):
            hashes = words.hashes()
            starts, names = words.grams(hashes, window)
            starts = starts[_listed(batch, words.doc[starts], names)]
            change = np.bincount(starts, minlength=len(words) + window) - np.bincount(
                starts + window, minlength=len(words) + window
            )
            gone = np.cumsum(change)[: len(words)] > 0
            kept = []
            split = (text.split() for text in batch.column(1).to_pylist())
            for a, own in zip(words.bounds[:-1], split, strict=True):
                drop = gone[a : a + len(own)]
                kept.append(b" ".join(w for w, d in zip(own, drop, strict=True) if not d))
            counted = np.bincount(words.doc, weights=gone, minlength=batch.num_rows)
            yield rows(batch, kept, words.counts, counted)

    keyed = texts.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text")
    untouched = keyed.mapInArrow(whole, RESULT)
    return untouched.unionAll(_texts_of(texts, removed, "left").mapInArrow(cut, RESULT))
