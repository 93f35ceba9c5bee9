"""Line deduplication over range-partitioned line hashes, told by keep bitmaps.

A line's key is the line without white space at both ends, A-Z in lower case; two 64-bit hashes name
it.  Entries ``(hash, document, position)`` are range-partitioned by all of these and sorted within, so
a key that a third of all lines have lies in many partitions, in the order of documents.  A task streams
its entries: of a run of equal keys it holds those of fewer than ``least`` documents, then it knows, and
the rest passes through.  A run at an edge of a partition may go on in the next one; such runs, two a
partition at most, are told in summaries that are put together before their undecided entries are judged.

What comes out are no texts but one row a document: the numbers of its lines and of those dropped, and a
zlib-compressed bitmap of the lines that stay.  ``keep="first"`` leaves the first line of a key, by
document and position, ``keep="none"`` leaves none.  ``cut`` applies bitmaps to texts; those that lose
nothing stay in their tasks.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` code points are
never dropped; documents with equal ids and different texts are two, rows equal in both are one document
with the same decision for each row; a null id is an id, before all others; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import ascii_lower, bitmap_of, in_bitmap, prepare
from assayer.session import materialize

LEAST = 10
MIN_CHARS = 1
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _sources(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, mark, text``: the mark is a hash that tells texts of one id apart."""
    named = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text")
    )
    return named.select("id", F.xxhash64(F.col("id").isNull(), "id", "text").alias("mark"), "text")


def entries(sources: DataFrame, min_chars: int) -> DataFrame:
    lines = sources.select("id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("id", "mark", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), "id", "mark", "pos"
    )


ENTRY = "h bigint, g bigint, id bigint, mark bigint, pos int"
# What a task tells of an entry: it goes if its run does, or nothing can be said in this partition.
GOES, OPEN, EDGE = 0, 1, 2
TOLD = f"{ENTRY}, kind int, head boolean, docs bigint, last_id bigint, last_mark bigint"


def _told(part: pa.Table, kind: int, head: np.ndarray, docs: int = 0, last: tuple = (None, 0)) -> pa.RecordBatch:
    n = part.num_rows
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
    more = [
        pa.array(np.full(n, kind, np.int32)), pa.array(head), pa.array(np.full(n, docs, np.int64)),
        pa.nulls(n, pa.int64()) if last[0] is None else pa.array([last[0]] * n, pa.int64()),
        pa.array(np.full(n, last[1], np.int64)),
    ]
    return pa.RecordBatch.from_arrays([*columns, *more], names=[f.split()[0] for f in TOLD.split(", ")])


def _changes(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where a key begins, and where a document of a key begins."""
    h, g, mark = (part.column(c).to_numpy() for c in ("h", "g", "mark"))
    ids = part.column("id").fill_null(0).to_numpy()
    run, doc = np.ones(len(h), bool), np.ones(len(h), bool)
    run[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    doc[1:] = run[1:] | (mark[1:] != mark[:-1]) | (ids[1:] != ids[:-1])
    return run, doc


def _equal(part: pa.Table, other: pa.Table) -> np.ndarray:
    """Entries that are another's repetition: same document, same line, from a row that repeats."""
    same = np.ones(part.num_rows, bool)
    for column in ("id", "mark", "pos"):
        mine, its = (t.column(column).fill_null(0).to_numpy() for t in (part, other))
        same &= mine == its
    return same


def judge_runs(least: int):
    """The streaming pass over one sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # entries of the run that is not decided yet
        known = None  # or the first entry of the run that goes, its last document, its count
        at_start = True  # is it the run that the partition begins with?

        def edge(first: pa.Table, docs: int, last: pa.Table) -> pa.RecordBatch:
            return _told(first, EDGE, np.zeros(1, bool), docs, (last.column("id")[0].as_py(), last.column("mark")[0].as_py()))

        for batch in batches:
            part = pa.Table.from_batches([batch])
            if not part.num_rows:
                continue
            if known is not None:
                h, g = part.column("h").to_numpy(), part.column("g").to_numpy()
                other = (h != known[0].column("h")[0].as_py()) | (g != known[0].column("g")[0].as_py())
                m = int(other.argmax()) if other.any() else len(other)
                if m:
                    yield _told(part.slice(0, m), GOES, _equal(part.slice(0, m), known[0]))
                    known = (known[0], part.slice(m - 1, 1))
                part = part.slice(m)
                if not part.num_rows:
                    continue
                if at_start:
                    yield edge(known[0], least, known[1])
                known, at_start = None, False
            if held is not None:
                part = pa.concat_tables([held, part])
            starts, docs = _changes(part)
            first = np.flatnonzero(starts)
            counts = np.add.reduceat(docs.astype(np.int64), first)
            ends = np.append(first[1:], part.num_rows)
            heads = _equal(part, part.take(pa.array(np.repeat(first, ends - first))))
            goes = np.repeat(counts >= least, ends - first)
            if goes.any():
                yield _told(part.filter(pa.array(goes)), GOES, heads[goes])
            if at_start and len(first) > 1:
                if counts[0] < least:
                    yield _told(part.slice(0, ends[0]), OPEN, heads[: ends[0]])
                yield edge(part.slice(0, 1), int(counts[0]), part.slice(ends[0] - 1, 1))
            at_start = at_start and len(first) == 1
            tail = part.slice(int(first[-1]))
            known, held = ((tail.slice(0, 1), tail.slice(tail.num_rows - 1, 1)), None) if counts[-1] >= least else (None, tail)
        if known is not None:
            yield edge(known[0], least, known[1])
        if held is not None:
            docs = _changes(held)[1]
            yield _told(held, OPEN, _equal(held, held.slice(0, 1)))
            yield edge(held.slice(0, 1), int(docs.sum()), held.slice(held.num_rows - 1, 1))

    return run


def dropped_lines(sources: DataFrame, least: int, min_chars: int, keep: str) -> DataFrame:
    """``id, mark, pos`` of the lines that go."""
    found = materialize(entries(sources, min_chars), "lines")
    order = ["h", "g", "id", "mark", "pos"]
    lined = found.repartitionByRange(*order).sortWithinPartitions(*order)
    told = materialize(lined.mapInArrow(judge_runs(least), TOLD), "runs")

    # a document at the end of one partition may be the first of the next
    edges = told.filter(F.col("kind") == EDGE)
    along = Window.partitionBy("h", "g").orderBy("id", "mark", "pos")
    again = F.lag("last_mark").over(along).eqNullSafe(F.col("mark")) & F.lag("last_id").over(along).eqNullSafe(F.col("id"))
    counted = edges.withColumn("own", F.col("docs") - F.when(again, 1).otherwise(0))
    counted = counted.groupBy("h", "g").agg(
        F.sum("own").alias("docs"), F.min(F.struct("id", "mark", "pos")).alias("first")
    ).filter(F.col("docs") >= least)
    counted = F.broadcast(materialize(counted.select("h", "g", "first"), "edges"))  # two rows a partition at most

    rows = told.filter(F.col("kind") != EDGE).join(counted, ["h", "g"], "left")
    gone = (F.col("kind") == GOES) | F.col("first").isNotNull()
    if keep == "first":
        here = F.struct("id", "mark", "pos")
        gone = gone & (~F.col("head") | (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(here)))
    return rows.filter(gone).select("id", "mark", "pos")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keeps, gone = [], []
        for n, at in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            bits = np.ones(n, bool)
            bits[at.values.to_numpy()] = False
            keeps.append(zlib.compress(np.packbits(bits).tobytes()))
            gone.append(n - int(bits.sum()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(gone, pa.int64()), pa.array(keeps, pa.binary())],
            names=["id", "mark", "n_lines", "n_dropped", "keep"],
        )


def keep_bitmaps(
    docs: DataFrame, least: int = LEAST, min_chars: int = MIN_CHARS, keep: str = "none",
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``id, mark, n_lines, n_dropped, keep`` of the documents that lose lines; one row for equal rows."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    prepare(docs.sparkSession)
    sources = _sources(docs, id_column, text_column)
    gone = dropped_lines(sources, least, min_chars, keep).groupBy("id", "mark").agg(F.collect_set("pos").alias("gone"))
    sizes = sources.select("id", "mark", _n_lines().alias("n_lines")).distinct()
    same = F.col("g.mark").eqNullSafe(F.col("s.mark")) & F.col("g.id").eqNullSafe(F.col("s.id"))
    joined = gone.alias("g").join(sizes.alias("s"), same).select("g.id", "g.mark", "s.n_lines", "g.gone")
    schema = "id bigint, mark bigint, n_lines bigint, n_dropped bigint, keep binary"
    return materialize(joined.mapInArrow(_bitmaps, schema), "keep-bitmaps")


def _n_lines(text: str = "text") -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def lines_kept(text: bytes, keep: bytes) -> bytes:
    """The text without the lines that its bitmap drops."""
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return b"\n".join(compress(lines, bits))


def cut(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_lines, n_dropped, kept`` (the text that stays, UTF-8) of every row of ``docs``."""
    sources = _sources(docs, id_column, text_column)
    touched = docs.sparkSession.sparkContext.broadcast(bitmap_of(bitmaps.select("mark"), "mark"))

    def part(wanted: bool):
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(touched.value, batch.column(1).to_numpy()) == wanted))

        return sources.mapInArrow(pick, sources.schema)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                text if keep is None else lines_kept(text, keep)
                for text, keep in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(kept, pa.binary())], names=["id", "n_lines", "n_dropped", "kept"]
            )

    whole = part(False).select(
        "id", _n_lines().alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"), F.col("text").cast("binary").alias("kept")
    )
    same = F.col("s.mark").eqNullSafe(F.col("b.mark")) & F.col("s.id").eqNullSafe(F.col("b.id"))
    met = part(True).alias("s").join(bitmaps.alias("b").hint("merge"), same, "left").select(
        "s.id", _n_lines("s.text").alias("n_lines"), F.coalesce("b.n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
        F.col("s.text").cast("binary").alias("text"), "b.keep",
    )
    schema = "id bigint, n_lines bigint, n_dropped bigint, kept binary"
    return whole.unionAll(met.mapInArrow(shorten, schema))
