"""Exact cosine top-k that skips cells of vectors which cannot reach a query's k-th best.

The vectors of a collection are assigned to the nearest of a few of them, its centres; a cell knows the
greatest angle between its centre and a member.  By the triangle inequality of angles no member is more
similar to a query than ``cos(max(0, angle(query, centre) - radius))``.  A query first meets its most
promising cells, as many as hold ``k`` vectors; then only those whose bound reaches its k-th similarity.

Vectors lie in blocks of bounded size and queries in packs, so a task multiplies matrices and sends at most
``k`` rows for each query and block.  Which vectors are centres changes the work, never the rows; ties go
to the smaller id.  Vectors and queries without length have similarity 0 to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer import rules
from assayer.session import materialize

BLOCK = 1024  # vectors in a block
PACK = 256  # queries in a pack
MARGIN = 1e-4  # similarities are rounded to four digits
CENTRES = 64  # at most, and about the root of a collection's size


@dataclass(frozen=True)
class Cells:
    blocks: DataFrame  # collection, cell, block, members: array of (id, embedding)
    centres: DataFrame  # collection, cells: array of (cell, n, radius, embedding)


def _matrix(rows: pa.Array) -> np.ndarray:
    """A list of equally long vectors as a matrix of unit rows; those without length stay zero."""
    if not len(rows):
        return np.zeros((0, 0))
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    length = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return flat / np.where(length > 0, length, 1.0)


def _members(batch: pa.RecordBatch, name: str) -> Iterator[pa.StructArray]:
    column = batch.column(batch.schema.get_field_index(name))
    for i in range(len(column)):
        yield column.slice(i, 1).flatten()


def _dealt(rows: DataFrame, keys: list[str], order: str, size: int, name: str, fields: list[str]) -> DataFrame:
    """Rows of equal keys in lists of about ``size``, however many a key has."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.pmod(F.xxhash64(order), F.col("parts"))
    listed = rows.join(counts, keys).groupBy(*keys, part.alias(name))
    return listed.agg(F.collect_list(F.struct(*fields)).alias("members"))


def build_cells(vectors: DataFrame, centres: int = CENTRES) -> Cells:
    """Cells over ``(id, collection, embedding)``."""
    rows = vectors.select("collection", F.col("id").cast("string").alias("id"), "embedding")
    sizes = rows.groupBy("collection").agg(
        F.least(F.lit(centres), F.ceil(F.sqrt(F.count("*").cast("double")))).cast("int").alias("wanted")
    )
    order = Window.partitionBy("collection").orderBy(F.xxhash64("id"), "id")
    drawn = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= centres)
    drawn = drawn.join(sizes, "collection").filter(F.col("place") <= F.col("wanted"))
    packed = drawn.groupBy("collection").agg(
        F.collect_list(F.struct(F.col("place").alias("cell"), "embedding")).alias("centres")
    )
    blocks = _dealt(rows, ["collection"], "id", BLOCK, "block", ["id", "embedding"]).join(packed, "collection")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (own, centre) in enumerate(zip(_members(batch, "members"), _members(batch, "centres"), strict=True)):
                close = _matrix(own.field("embedding")) @ _matrix(centre.field("embedding")).T
                best = close.argmax(axis=1)
                angle = np.arccos(np.clip(close[np.arange(len(best)), best], -1, 1))
                names = centre.field("cell").to_numpy()
                where = pa.array([batch.column(0)[i].as_py()] * len(own), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [where, pa.array(names[best].astype(np.int32)), pa.array(angle), own.field("id"), own.field("embedding")],
                    names=["collection", "cell", "angle", "id", "embedding"],
                )

    kind = vectors.schema["embedding"].dataType.simpleString()
    schema = f"collection string, cell int, angle double, id string, embedding {kind}"
    placed = materialize(blocks.select("collection", "members", "centres").mapInArrow(assign, schema), "placed")
    dealt = materialize(_dealt(placed, ["collection", "cell"], "id", BLOCK, "block", ["id", "embedding"]), "blocks")
    radii = placed.groupBy("collection", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    known = drawn.select("collection", F.col("place").alias("cell"), "embedding").join(radii, ["collection", "cell"])
    listed = known.groupBy("collection").agg(F.collect_list(F.struct("cell", "n", "radius", "embedding")).alias("cells"))
    return Cells(dealt, materialize(listed, "centres"))


def cell_bounds(queries: DataFrame, cells: Cells) -> DataFrame:
    """``query_id, collection, cell, n, bound``: the greatest similarity that a member can have."""
    packs = _dealt(queries, ["collection"], "query_id", PACK, "pack", ["query_id", "embedding"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (asked, known) in enumerate(zip(_members(batch, "members"), _members(batch, "cells"), strict=True)):
                close = _matrix(asked.field("embedding")) @ _matrix(known.field("embedding")).T
                angle = np.arccos(np.clip(close, -1, 1)) - known.field("radius").to_numpy()
                most = np.cos(np.maximum(angle, 0.0)) + 1e-9
                q, c = (x.ravel() for x in np.indices(most.shape))
                yield pa.RecordBatch.from_arrays(
                    [
                        asked.field("query_id").take(pa.array(q)), pa.array([batch.column(0)[i].as_py()] * len(q), pa.string()),
                        known.field("cell").take(pa.array(c)), known.field("n").take(pa.array(c)), pa.array(most.ravel()),
                    ],
                    names=["query_id", "collection", "cell", "n", "bound"],
                )

    joined = packs.join(cells.centres, "collection").select("collection", "members", "cells")
    return joined.mapInArrow(bound, "query_id string, collection string, cell int, n bigint, bound double")


def _scored(pairs: DataFrame, queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """The best ``k`` of every block for the queries paired with its cell, ties included."""
    asked = pairs.select("query_id", "collection", "cell").join(queries, ["query_id", "collection"])
    packs = _dealt(asked, ["collection", "cell"], "query_id", PACK, "pack", ["query_id", "embedding"])
    met = packs.withColumnRenamed("members", "asked").join(cells.blocks, ["collection", "cell"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (asked_, own) in enumerate(zip(_members(batch, "asked"), _members(batch, "members"), strict=True)):
                close = np.round(_matrix(asked_.field("embedding")) @ _matrix(own.field("embedding")).T, 4)
                if close.shape[1] > k:
                    least = -np.partition(-close, k - 1, axis=1)[:, k - 1 : k]
                    q, v = np.nonzero(close >= least)
                else:
                    q, v = (x.ravel() for x in np.indices(close.shape))
                yield pa.RecordBatch.from_arrays(
                    [
                        asked_.field("query_id").take(pa.array(q)), pa.array([batch.column(0)[i].as_py()] * len(q), pa.string()),
                        own.field("id").take(pa.array(v)), pa.array(close[q, v] + 0.0),
                    ],
                    names=["query_id", "collection", "id", "similarity"],
                )

    schema = "query_id string, collection string, id string, similarity double"
    return met.select("collection", "asked", "members").mapInArrow(multiply, schema)


def _ranked(found: DataFrame, k: int, id_type: str) -> DataFrame:
    order = Window.partitionBy("query_id", "collection").orderBy(F.desc("similarity"), F.col("id").cast(id_type))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class Search:
    hits: DataFrame  # query_id, collection, id, similarity, rank
    skipped: DataFrame  # query_id, collection, cells, met


def top_k(queries: DataFrame, cells: Cells, k: int = rules.TOP_K, id_type: str = "string") -> Search:
    """The ``k`` most similar vectors of each query's collection, and how many cells were met for it.

    ``queries``: ``(query_id, collection, embedding)``, both names as text; ids rank as ``id_type``.
    """
    queries = materialize(queries.select(F.col("query_id").cast("string").alias("query_id"), "collection", "embedding"), "queries")
    bounds = materialize(cell_bounds(queries, cells), "bounds")
    along = Window.partitionBy("query_id", "collection").orderBy(F.desc("bound"), "cell")
    before = F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1))
    promising = bounds.withColumn("first", F.coalesce(before, F.lit(0)) < k)
    promising = materialize(promising, "promising")
    first = materialize(_ranked(_scored(promising.filter("first"), queries, cells, k), k, id_type), "first")
    reached = first.filter(F.col("rank") == k).select("query_id", "collection", F.col("similarity").alias("reached"))
    others = promising.filter(~F.col("first")).join(reached, ["query_id", "collection"], "left")
    others = others.filter(F.col("reached").isNull() | (F.col("bound") + MARGIN >= F.col("reached")))
    others = materialize(others.select("query_id", "collection", "cell"), "others")
    found = first.drop("rank").unionByName(_scored(others, queries, cells, k))
    met = promising.filter("first").select("query_id", "collection").unionByName(others.select("query_id", "collection"))
    met = met.groupBy("query_id", "collection").agg(F.count("*").alias("met"))
    skipped = bounds.groupBy("query_id", "collection").agg(F.count("*").alias("cells")).join(met, ["query_id", "collection"])
    return Search(_ranked(found, k, id_type), skipped)
