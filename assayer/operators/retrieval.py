"""Embedding, exact cosine top-k and context assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import text as T
from assayer.session import materialize, small_side

# Queries carry a vector each: some 3 kB at 768 dimensions.
MAX_BROADCAST_QUERIES = 10_000

Encoder = Callable[[DataFrame], DataFrame]


def fit_encoder(texts: DataFrame, dimensions: int = 256) -> Encoder:
    """Default encoder: hashed term frequencies, inverse document frequency, unit length.

    Any function adding an ``embedding array<float>`` column to ``(text_key, content)`` rows can
    stand in for it, a model behind ``predict_batch_udf`` for instance.
    """
    stages = [
        RegexTokenizer(inputCol="content", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]
    model = Pipeline(stages=stages).fit(texts.select("content"))

    def encode(df: DataFrame) -> DataFrame:
        return (
            model.transform(df)
            .withColumn("embedding", vector_to_array("_unit", "float32"))
            .drop("_words", "_tf", "_tfidf", "_unit")
        )

    return encode


def embed(chunks: DataFrame, encoder: Encoder, costly: bool = False) -> DataFrame:
    """Add ``embedding`` to every chunk, in place: no text moves, and chunks are made once.

    For a ``costly`` encoder each distinct text is encoded once and its vector handed to every
    copy.  Copies fold on the map side before the shuffle; on the way back a text copied very
    often is a skewed join partition, which adaptive execution splits.
    """
    keyed = chunks.withColumn("text_key", F.sha1("content"))
    if not costly:
        return encoder(keyed).drop("text_key")
    keyed = materialize(keyed, "chunks")
    distinct = keyed.select("text_key", "content").dropDuplicates(["text_key"])
    vectors = encoder(distinct).select("text_key", "embedding")
    return keyed.join(vectors, "text_key").drop("text_key")


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.sqrt(_dot(a, a))


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = rules.TOP_K,
    where: dict[str, object] | None = None,
) -> DataFrame:
    """The ``k`` most similar vectors of each query's collection, ties by id.

    ``queries``: ``(query_id, collection, embedding)``; ``vectors``: ``(id, collection,
    embedding, …)``; ``where``: metadata equality filters.  Queries meet vectors through the
    collection: broadcast when counted to be few, so vectors stay in place, else by shuffle.
    The rank limit is applied below the shuffle: each task forwards at most ``k`` rows per query.
    """
    for column, value in (where or {}).items():
        vectors = vectors.filter(F.col(column) == value)
    asked = queries.select(
        "query_id", "collection", F.col("embedding").alias("_q"), norm("embedding").alias("_qn")
    )
    stored = vectors.withColumn("_n", norm("embedding"))
    scale = F.nullif(F.col("_qn") * F.col("_n"), F.lit(0.0))
    scored = stored.join(small_side(asked, MAX_BROADCAST_QUERIES), "collection").withColumn(
        "similarity",
        T.round_to(F.coalesce(_dot(F.col("_q"), F.col("embedding")) / scale, F.lit(0.0)), 4),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return (
        scored.drop("_q", "_qn", "_n", "embedding")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def assemble_context(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Ranked hits (at most ``k`` per key) as one prompt context."""
    return (
        hits.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "path", "content"))).alias("hits"))
        .select(
            *keys,
            F.array_join(
                F.transform(
                    "hits",
                    lambda h: F.concat(F.lit("### "), h["path"], F.lit("\n"), h["content"]),
                ),
                "\n\n",
            ).alias("context"),
        )
    )
