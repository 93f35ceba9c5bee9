"""Vectors kept by content: a text is encoded once, collections hold references to it.

Two bucketed tables: texts by the digest of their content, references by collection.  Indexing a commit
encodes only texts that no earlier one had, whichever repository or user it came from; what is stored meets
what is new bucket by bucket and does not move.  A job killed between the two writes leaves texts that the
next try finds.  Two jobs may store the same text at once; readers take one row a digest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.retrieval import Encoder
from assayer.session import materialize, small_side
from assayer.sources import bucketed
from assayer.sources.bucketed import BucketedTable

TEXTS = "text_key STRING, content STRING, embedding ARRAY<FLOAT>"
REFERENCES = "collection STRING, id STRING, text_key STRING, path STRING, chunk_index INT"


@dataclass(frozen=True)
class VectorStore:
    texts: BucketedTable
    references: BucketedTable


def open_store(spark: SparkSession, path: str, buckets: int = bucketed.BUCKETS) -> VectorStore:
    """The store at ``path``, made with ``buckets`` if there is none."""

    def part(name: str, schema: str, key: str) -> BucketedTable:
        at = f"{path}/{name}"
        return bucketed.open_table(spark, at) if bucketed.exists(spark, at) else bucketed.create(spark, at, schema, [key], buckets)

    return VectorStore(part("texts", TEXTS, "text_key"), part("references", REFERENCES, "collection"))


def add_collections(store: VectorStore, chunks: DataFrame, encoder: Encoder) -> None:
    """Index ``(collection, id, path, chunk_index, content)``; collections already there stay as they are."""
    spark = chunks.sparkSession
    # names of collections go to the chunks: few hold all contents, which would else meet in as few tasks
    there = small_side(store.references.frame(spark).select("collection").distinct())
    fresh = chunks.join(there, "collection", "left_anti").withColumn("text_key", F.sha1("content"))
    fresh = materialize(fresh.select("collection", "id", "text_key", "path", "chunk_index", "content"), "chunks")
    # copies fold in their tasks, then whole buckets of stored digests are passed by
    texts = fresh.select("text_key", "content").dropDuplicates(["text_key"])
    known = store.texts.frame(spark).select("text_key").hint("merge")
    bucketed.append(store.texts, encoder(texts.join(known, "text_key", "left_anti")))
    bucketed.append(store.references, fresh)


def read_collections(store: VectorStore, collections: DataFrame) -> DataFrame:
    """``(id, collection, path, chunk_index, content, embedding)`` of the collections asked for."""
    spark = collections.sparkSession
    asked = store.references.frame(spark).join(collections.select("collection").distinct(), "collection", "left_semi")
    texts = store.texts.frame(spark).dropDuplicates(["text_key"]).hint("merge")
    found = asked.dropDuplicates(["collection", "id"]).join(texts, "text_key")
    return found.select("id", "collection", "path", "chunk_index", "content", "embedding")
