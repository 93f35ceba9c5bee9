"""What the operators share: session settings, row keys, words and hashes of words in batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.session import materialize

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Batches are bounded by bytes, so that long texts and narrow rows both travel well.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "65536",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the session settings that the operators of this subpackage assume."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    text = text if isinstance(text, Column) else F.col(text)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase)
    )


# Word classes, as 256 flags over bytes.  Bytes from 0x80 on belong to words in both.
_BYTES = np.arange(256)
SPACED = ~(((_BYTES >= 0x09) & (_BYTES <= 0x0D)) | (_BYTES == 0x20))
ALNUM = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xD6E8FEB86659FD93)
_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: a bijection whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name of an ordered pair of 64-bit names."""
    return mix(left * _M1 + (right ^ _M2))


@dataclass
class Words:
    """Words of the texts of one batch, one after another."""

    data: np.ndarray  # bytes of all texts
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # row of each word
    bounds: np.ndarray  # words of row i are bounds[i]:bounds[i + 1]

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, equal in every process."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        loads = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        lengths = self.ends - self.starts
        out = mix(lengths.astype(np.uint64) + _M1)
        active, at = np.arange(len(lengths)), 0
        while active.size:
            rest = lengths[active] - at
            block = loads[self.starts[active] + at] & _TAIL[np.minimum(rest, 8)]
            out[active] = combine(out[active], block)
            active, at = active[rest > 8], at + 8
        return out

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (index of a word) and hash of every run of ``n`` words within one text."""
        last = len(hashes) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:last] == self.doc[n - 1 :])
        out = hashes[at]
        for j in range(1, n):
            out = combine(out, hashes[at + j])
        return at, out


def binary_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; nulls are empty."""
    column = batch.column(batch.schema.get_field_index(name))
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def words_of(batch: pa.RecordBatch, name: str, kind: np.ndarray, lower: bool) -> Words:
    """All words (runs of bytes of ``kind``) of a binary column."""
    data, offsets = binary_column(batch, name)
    if lower:
        data = _LOWER[data]
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    return Words(data, starts, ends, doc, bounds)


def words_in(batches: Iterator[pa.RecordBatch], name: str, kind: np.ndarray, lower: bool):
    for batch in batches:
        if batch.num_rows:
            yield batch, words_of(batch, name, kind, lower)


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit names as Spark's bigint."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def unsigned(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.int64).view(np.uint64)


def blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per range of ``values``: ``bounds[i]:bounds[i + 1]``."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(
        pa.binary(),
        len(bounds) - 1,
        [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)],
    )


def binary_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("text")


def row_key(*columns: Column) -> Column:
    """A key without nulls that tells rows apart by these columns, null from empty included."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.lit("="), text), F.lit("-")))
    return F.concat_ws(":", *parts)


def other_columns(df: DataFrame, added: Iterable[str]) -> list[str]:
    """The columns of ``df`` but those that an added one replaces; Spark tells names apart without case."""
    taken = {name.lower() for name in added}
    return [c for c in df.columns if c.lower() not in taken]


def unused_prefix(df: DataFrame) -> str:
    """What no column of ``df`` begins with, for columns that come and go inside an operator."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def keep_rows(docs: DataFrame, decided: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose key is in ``decided``, one row for each key.

    ``keys`` names what makes up the key and says how ``docs`` computes it; ``decided`` has
    columns of these names.  Rows with equal keys are copies, of which one stays.  Texts move
    once, to the partition of their key; the window needs no sort of its own.
    """
    own = unused_prefix(docs)
    key, rank = f"{own}key", f"{own}rank"
    wanted = decided.select(row_key(*(F.col(name) for name in keys)).alias(key)).distinct()
    joined = docs.withColumn(key, row_key(*keys.values())).join(wanted.hint("merge"), key)
    order = Window.partitionBy(key).orderBy(F.lit(1))
    ranked = joined.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1)
    return ranked.select(*(F.col(f"`{c}`") for c in docs.columns))


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with a flag for each row whose first column also stands in a neighbouring row.

    Rows come sorted by that column.  A row that may have its partner in the next batch is held
    back and heads that batch, so a run of any length streams past.
    """
    held, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            table = pa.Table.from_batches([held, batch]).combine_chunks()
            batch = table.to_batches(max_chunksize=table.num_rows)[0]
        value = batch.column(0).to_numpy()
        same = value[1:] == value[:-1]
        flag = np.zeros(len(value), bool)
        flag[1:] |= same
        flag[:-1] |= same
        if held is None and last is not None:
            flag[0] |= value[0] == last
        last = value[-1]
        held = None if flag[-1] else batch.slice(batch.num_rows - 1)
        n = batch.num_rows - (held is not None)
        if n:
            yield batch.slice(0, n), flag[:n]
    if held is not None:
        yield held, np.zeros(1, bool)


BITMAP_BITS = 1 << 26


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size over hashed keys: false only for keys that are surely absent.

    It is put together from partial words, of which there are at most ``BITMAP_BITS / 64``.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit_of(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bit >> 6), pa.array(np.left_shift(np.int64(1), bit & 63))],
                names=["word", "bits"],
            )

    marks = keys.select(F.col(column).cast("bigint")).distinct().mapInArrow(mark, "word bigint, bits bigint")
    marks = marks.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS >> 6, np.uint64)
    out[marks["word"].to_numpy()] = unsigned(marks["bits"].to_numpy())
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = _bit_of(keys)
    return ((bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _bit_of(keys: np.ndarray) -> np.ndarray:
    return (mix(unsigned(keys)) % np.uint64(BITMAP_BITS)).astype(np.int64)


def drop_ids(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is not among ``ids`` (one column ``id``); a null id is among none.

    A bitmap of fixed size tells which rows can be among them.  The others, most of a corpus, stay
    in their tasks, and only the rest moves to an exact anti-join.
    """
    ids = materialize(ids.select(F.col("id").cast("bigint").alias("id")).distinct(), "dropped")
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids, "id"))
    place = docs.columns.index(column)

    def part(wanted: bool):
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(place)
                hit = in_bitmap(bitmap.value, keys.fill_null(0).to_numpy().astype(np.int64))
                hit &= keys.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == wanted))

        return docs.mapInArrow(pick, docs.schema)

    dropped = ids.select(F.col("id").alias("__dropped")).hint("merge")
    moved = part(True).join(dropped, F.col(f"`{column}`").cast("bigint") == F.col("__dropped"), "left_anti")
    return part(False).unionAll(moved)


def most_frequent(counts: DataFrame, limit: int, least: float | None = None) -> pa.Table:
    """Rows of ``counts`` with the greatest ``n``, at most ``limit`` of them, and all from ``least`` on.

    A histogram over fine classes of ``n`` (some thousand at most) gives the lowest class down to
    which they are few enough.  Nothing is sorted, and no task sees more than its own rows.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 64)
    found = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("m")).collect(), reverse=True)
    taken, lowest = 0, None
    for row in found:
        taken += row["m"]
        if taken > limit:
            break
        lowest = row["level"]
    wanted = F.lit(False) if lowest is None else level >= lowest
    if least is not None:
        wanted = wanted | (F.col("n") >= least)
    return counts.filter(wanted).toArrow()
