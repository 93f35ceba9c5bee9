"""Benchmark decontamination over a distributed positional inverted index of the training words.

The index is a table of blocks.  A block covers some MB of texts; its words are numbered through,
and per hash range of terms (bucket) one row holds the sorted terms, their counts and their
positions as gaps.  The table is bucketed by ``slot`` (block and bucket), so that probes for known
places come to the index and the index is never shuffled after it was built.

A phrase is found by intersecting offset-adjusted lists, starting from its rarest word: the list of
that word is read whole, the next rarest word is probed at the places it leaves, and only what
survives both is compared word by word.

Defined results: null and empty texts have no words and get a row with zeros; an item without words
has no window, one with fewer words than a window is one window; items with equal ids count once,
a null id marks words but is not counted; repeated documents get a row each; empty tables give no
rows, or no hits; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.common import ALNUM, binary_text, prepare, signed, unsigned, words_in
from assayer.session import materialize, new_table_path

WINDOW = 13
BUCKET_BITS = 6
BUCKETS = 1 << BUCKET_BITS
BLOCK_WORDS = 2_000_000

INDEX = (
    "slot bigint, block bigint, bucket int, doc_ids array<bigint>, lengths binary, "
    "terms binary, counts binary, gaps binary"
)


@dataclass(frozen=True)
class PositionalIndex:
    path: str
    table: str


def pack(values: np.ndarray, kind: str) -> bytes:
    """Compress numbers byte plane by byte plane."""
    raw = np.ascontiguousarray(values, dtype=kind)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def unpack(blob: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(blob[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.Codec("zstd").decompress(blob[4:], n * size, asbytes=True)
    flat = np.frombuffer(planes, np.uint8).reshape(size, n).T
    return np.ascontiguousarray(flat).view(kind).ravel()


def _block_rows(block: int, ids: list, lengths: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """All rows of a block: one with the ids, and one per bucket that has words."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else order
    terms = ranked[first]
    counts = np.diff(np.append(first, len(ranked)))
    gaps = order.copy()
    gaps[1:] -= order[:-1]
    gaps[first] = order[first]
    packed = pack(lengths, "<u4")
    edges = np.searchsorted(terms >> np.uint64(64 - BUCKET_BITS), np.arange(BUCKETS + 1, dtype=np.uint64))
    rows = [(block * (BUCKETS + 1), block, -1, ids, packed, None, None, None)]
    for bucket in range(BUCKETS):
        a, b = edges[bucket], edges[bucket + 1]
        if a < b:
            x, y = first[a], first[b] if b < len(first) else len(ranked)
            rows.append((
                block * (BUCKETS + 1) + bucket + 1, block, bucket, None, packed,
                terms[a:b].tobytes(), pack(counts[a:b], "<u4"), pack(gaps[x:y], "<u4"),
            ))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())] + [pa.binary()] * 4
    names = [c.split()[0] for c in INDEX.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    ids, lengths, hashes, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        return _block_rows(block, ids, np.concatenate(lengths), np.concatenate(hashes))

    for batch, words in words_in(batches, "text", ALNUM, lower=True):
        ids += batch.column(0).to_pylist()
        lengths.append(words.counts)
        hashes.append(words.hashes())
        size += len(words)
        if size >= BLOCK_WORDS:
            yield flush()
            block, ids, lengths, hashes, size = block + 1, [], [], [], 0
    if ids:
        yield flush()


def build_index(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    path: str | None = None, files: int | None = None,
) -> PositionalIndex:
    """Store the postings of every word of ``docs``.

    ``files`` is the number of buckets the table is stored in, by default the session's number of
    shuffle partitions, which follows the data.
    """
    spark = prepare(docs.sparkSession)
    path = path or new_table_path(spark, "postings")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"postings_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {table} ({INDEX}) USING parquet CLUSTERED BY (slot) SORTED BY (slot) "
        f"INTO {files} BUCKETS LOCATION '{path}'"
    )
    texts = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"), binary_text(f"`{text_column}`")
    )
    rows = texts.mapInArrow(_index, INDEX)
    rows.repartition(files, "slot").write.insertInto(table)
    spark.catalog.refreshTable(table)
    return PositionalIndex(path, table)


def close_index(spark: SparkSession, index: PositionalIndex) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {index.table}")


def documents_of(spark: SparkSession, index: PositionalIndex) -> DataFrame:
    """``block, ord, doc_id, n_words`` of every indexed document."""
    rows = spark.table(index.table).filter("bucket = -1").select("block", "doc_ids", "lengths")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, lengths in zip(*(batch.column(i) for i in range(3)), strict=True):
                counts = unpack(lengths.as_py(), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), block.as_py()), pa.int64()),
                        pa.array(np.arange(len(counts)), pa.int64()),
                        ids.values, pa.array(counts, pa.int64()),
                    ],
                    names=["block", "ord", "doc_id", "n_words"],
                )

    return rows.mapInArrow(expand, "block bigint, ord bigint, doc_id bigint, n_words bigint")


def _bucket(term: Column) -> Column:
    return F.shiftrightunsigned(term, 64 - BUCKET_BITS).cast("int")


def _positions(counts: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of every posting, and where each term's postings begin."""
    begin = np.concatenate([[0], np.cumsum(counts)])
    total = np.cumsum(gaps)
    base = total[begin[:-1]] - gaps[begin[:-1]]
    return total - np.repeat(base, counts), begin


def _wanted(spark: SparkSession, index: PositionalIndex, terms: DataFrame, columns: list[str]) -> DataFrame:
    """Index rows of the buckets that hold ``terms`` (column ``term``), with the wanted terms.

    Terms come in lists of at most 4096; Spark broadcasts the lists only if their written size is
    under its threshold.
    """
    lists = terms.select("term").distinct().select("term", _bucket(F.col("term")).alias("bucket"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("term"))
    lists = lists.withColumn("part", F.floor((nth - 1) / 4096)).groupBy("bucket", "part").agg(
        F.array_sort(F.collect_list("term")).alias("wanted")
    )
    lists = materialize(lists.drop("part"), "wanted")
    return spark.table(index.table).select("block", "bucket", *columns).join(lists, "bucket")


def term_counts(spark: SparkSession, index: PositionalIndex, terms: DataFrame) -> DataFrame:
    """``term, n``: how often each of the terms occurs; absent terms are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stored, counts, wanted in zip(*(batch.column(i) for i in range(3)), strict=True):
                have = np.frombuffer(stored.as_py(), np.uint64)
                asked = unsigned(wanted.values.to_numpy())
                at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
                hit = have[at] == asked
                n = unpack(counts.as_py(), "<u4").astype(np.int64)[at[hit]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(asked[hit])), pa.array(n)], names=["term", "n"]
                )

    rows = _wanted(spark, index, terms, ["terms", "counts"]).select("terms", "counts", "wanted")
    return rows.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def postings(spark: SparkSession, index: PositionalIndex, terms: DataFrame) -> DataFrame:
    """``term, block, ord, at, first, last``: all places of the terms.

    ``at`` numbers the words of a block; ``first`` and ``last`` are those of the document.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                have = np.frombuffer(row["terms"], np.uint64)
                asked = unsigned(np.array(row["wanted"], np.int64))
                at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
                at = at[have[at] == asked]
                if not len(at):
                    continue
                counts = unpack(row["counts"], "<u4").astype(np.int64)
                places, begin = _positions(counts, unpack(row["gaps"], "<u4").astype(np.int64))
                n = counts[at]
                pick = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                where = places[pick]
                ends = np.cumsum(unpack(row["lengths"], "<u4").astype(np.int64))
                doc = np.searchsorted(ends, where, side="right")
                first = ends[doc] - np.diff(np.concatenate([[0], ends]))[doc]
                columns = [
                    signed(np.repeat(have[at], n)), np.full(len(where), row["block"]), doc, where, first, ends[doc] - 1
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=["term", "block", "ord", "at", "first", "last"],
                )

    rows = _wanted(spark, index, terms, ["lengths", "terms", "counts", "gaps"])
    schema = "term bigint, block bigint, ord bigint, at bigint, first bigint, last bigint"
    return rows.mapInArrow(read, schema)


def probe(spark: SparkSession, index: PositionalIndex, probes: DataFrame) -> DataFrame:
    """Those of the distinct ``block, term, at`` rows where the index has the term at that place."""
    slot = F.col("block") * (BUCKETS + 1) + _bucket(F.col("term")) + 1
    # one list per slot: at most the words of a block in one hash range
    asked = probes.select("block", "term", "at").distinct().groupBy(slot.alias("slot")).agg(
        F.collect_list("term").alias("asked"), F.collect_list("at").alias("places")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                have = np.frombuffer(row["terms"], np.uint64)
                counts = unpack(row["counts"], "<u4").astype(np.int64)
                places, _ = _positions(counts, unpack(row["gaps"], "<u4").astype(np.int64))
                keys = (np.repeat(np.arange(len(have)), counts) << 32) | places
                term, at = unsigned(np.array(row["asked"], np.int64)), np.array(row["places"], np.int64)
                i = np.minimum(np.searchsorted(have, term), len(have) - 1)
                key = (i << 32) | at
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (have[i] == term) & (keys[found] == key)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(int(hit.sum()), row["block"]), pa.int64()),
                        pa.array(signed(term[hit])), pa.array(at[hit]),
                    ],
                    names=["block", "term", "at"],
                )

    stored = spark.table(index.table).select("slot", "block", "terms", "counts", "gaps")
    rows = stored.join(asked.hint("merge"), "slot").drop("slot")
    return rows.mapInArrow(check, "block bigint, term bigint, at bigint")


def item_words(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``item, item_id, n, j, term``: the words of every item, ``item`` numbering the rows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in words_in(batches, "text", ALNUM, lower=True):
            at = np.arange(len(words)) - words.bounds[:-1][words.doc]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(words.doc)), batch.column(1).take(pa.array(words.doc)),
                    pa.array(words.counts[words.doc]), pa.array(at), pa.array(signed(words.hashes())),
                ],
                names=["item", "item_id", "n", "j", "term"],
            )

    rows = items.select(
        F.monotonically_increasing_id().alias("item"),
        F.col(f"`{id_column}`").cast("string").alias("item_id"), binary_text(f"`{text_column}`"),
    )
    schema = "item bigint, item_id string, n bigint, j bigint, term bigint"
    return materialize(rows.mapInArrow(split, schema), "item-words")


def matched_runs(spark: SparkSession, index: PositionalIndex, words: DataFrame, window: int) -> DataFrame:
    """Maximal runs of item words that stand consecutively in a document: exact phrase matches.

    Returns ``item, block, ord, j, at, size``: ``size`` words from word ``j`` of the item stand
    from place ``at``; runs have at least ``window`` words, or all words of a shorter item.
    """
    counts = term_counts(spark, index, words)
    counts = counts.withColumnRenamed("n", "n_seen")
    known = words.join(counts, "term", "left")
    known = known.withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))
    length = F.least(F.col("n"), F.lit(window))
    # every word to the windows that it is in, and per window its words from the rarest on
    starts = F.sequence(F.greatest(F.lit(0), F.col("j") - length + 1), F.least(F.col("j"), F.col("n") - length))
    spread = known.select("item", length.alias("size"), "j", "term", "n_seen", F.explode(starts).alias("s"))
    windows = spread.groupBy("item", "s", "size").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("n_seen", "j", "term"))), 1, 2).alias("rarest")
    )
    windows = windows.filter(F.col("rarest")[0]["n_seen"] > 0)
    two = lambda k: F.get(F.col("rarest"), F.lit(k))
    windows = materialize(
        windows.select(
            "item", "s", "size", two(0)["term"].alias("term"), two(0)["j"].alias("j1"),
            two(1)["term"].alias("term2"), two(1)["j"].alias("j2"),
        ),
        "windows",
    )
    lists = postings(spark, index, windows)
    places = windows.join(lists, "term")
    diagonal = F.col("at") - F.col("j1")
    begin = diagonal + F.col("s")
    places = places.filter((begin >= F.col("first")) & (begin + F.col("size") - 1 <= F.col("last")))
    places = materialize(
        places.select("item", "s", "size", "block", "ord", diagonal.alias("diagonal"), "term2", "j2"), "places"
    )
    second = places.filter(F.col("term2").isNotNull()).select(
        "block", F.col("term2").alias("term"), (F.col("diagonal") + F.col("j2")).alias("at")
    )
    agreed = probe(spark, index, second).select(
        "block", F.col("term").alias("term2"), (F.col("at")).alias("at2")
    )
    both = places.withColumn("at2", F.col("diagonal") + F.col("j2")).join(
        agreed, ["block", "term2", "at2"], "left_semi"
    )
    single = places.filter(F.col("term2").isNull())
    columns = ["item", "s", "size", "block", "ord", "diagonal"]
    left = both.select(*columns).unionAll(single.select(*columns))
    spots = left.select(
        "item", "size", "block", "ord", "diagonal",
        F.explode(F.sequence(F.col("s"), F.col("s") + F.col("size") - 1)).alias("j"),
    ).distinct()
    spots = spots.join(words.select("item", "j", "term"), ["item", "j"])
    spots = materialize(spots.withColumn("at", F.col("diagonal") + F.col("j")), "spots")
    true = spots.join(probe(spark, index, spots), ["block", "term", "at"], "left_semi")
    line = Window.partitionBy("item", "block", "ord", "diagonal").orderBy("j")
    runs = true.withColumn("island", F.col("j") - F.row_number().over(line)).groupBy(
        "item", "block", "ord", "diagonal", "island", "size"
    ).agg(F.min("j").alias("j"), F.min("at").alias("at"), F.count("*").alias("words"))
    return runs.filter(F.col("words") >= F.col("size")).select(
        "item", "block", "ord", "j", "at", F.col("words").alias("size")
    )


def phrase_matches(index: PositionalIndex, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, doc_id, item_word, doc_word, size`` of every maximal exact match."""
    spark = prepare(items.sparkSession)
    words = item_words(items)
    runs = matched_runs(spark, index, words, window)
    ids = words.select("item", "item_id").distinct()
    docs = documents_of(spark, index)
    ends = F.sum("n_words").over(Window.partitionBy("block").orderBy("ord"))
    docs = docs.withColumn("first", ends - F.col("n_words"))
    return runs.join(ids, "item").join(docs, ["block", "ord"]).select(
        "item_id", "doc_id", F.col("j").alias("item_word"), (F.col("at") - F.col("first")).alias("doc_word"), "size"
    )


def proximity_matches(index: PositionalIndex, items: DataFrame, within: int) -> DataFrame:
    """``item_id, doc_id, doc_word``: places of an item's rarest word that have all its other words
    within ``within`` words, in any order.  Places meet by cells of that width, never all by all."""
    spark = prepare(items.sparkSession)
    words = item_words(items)
    terms = words.select("item", "item_id", "term").distinct()
    counts = term_counts(spark, index, terms).withColumnRenamed("n", "n_seen")
    terms = materialize(terms.join(counts, "term", "left").fillna(0, ["n_seen"]), "query-terms")
    per_item = terms.groupBy("item", "item_id").agg(
        F.count("*").alias("wanted"), F.min(F.struct("n_seen", "term")).alias("rarest")
    )
    lists = materialize(postings(spark, index, terms), "places")
    cell = F.floor(F.col("at") / (within + 1))
    centre = per_item.select("item", "item_id", "wanted", F.col("rarest.term").alias("term")).join(lists, "term")
    centre = centre.select(
        "item", "item_id", "wanted", "block", "ord", "first", F.col("at").alias("here"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"),
    )
    around = terms.select("item", "term").join(lists, "term").select(
        "item", "term", "block", "ord", "at", cell.alias("cell")
    )
    near = centre.join(around, ["item", "block", "ord", "cell"]).filter(F.abs(F.col("at") - F.col("here")) <= within)
    full = near.groupBy("item", "item_id", "wanted", "block", "ord", "first", "here").agg(
        F.count_distinct("term").alias("found")
    ).filter(F.col("found") == F.col("wanted"))
    docs = documents_of(spark, index)
    return full.join(docs, ["block", "ord"]).select(
        "item_id", "doc_id", (F.col("here") - F.col("first")).alias("doc_word")
    )


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document.

    A word is hit inside any occurrence of a window; a document is contaminated where
    ``share * n_hit >= n_words`` and a word is hit.
    """
    spark = prepare(docs.sparkSession)
    index = build_index(docs, id_column, text_column)
    words = item_words(items)
    runs = materialize(matched_runs(spark, index, words, window), "runs")
    hits = runs.select(
        "block", "ord", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("at")
    ).distinct().groupBy("block", "ord").agg(F.count("*").alias("n_hit"))
    ids = words.select("item", "item_id").distinct()
    named = runs.select("item", "block", "ord").distinct().join(ids, "item")
    named = named.groupBy("block", "ord").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    marked = hits.join(named, ["block", "ord"], "left")
    out = documents_of(spark, index).join(marked, ["block", "ord"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
    )
    hit = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return out.withColumn("contaminated", hit)
