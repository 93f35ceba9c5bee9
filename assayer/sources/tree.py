"""Repository listings and file payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import text as T


def tracked_paths(tree: DataFrame) -> DataFrame:
    """Files of a listing; directories and submodules are not files.  ``ord`` is the order."""
    return tree.filter(F.col("type") == "blob").withColumn(
        "size", F.coalesce("size", F.lit(0).cast("long"))
    )


def decode_contents(
    raw: DataFrame,
    max_lines: int = rules.MAX_FILE_LINES,
    minified_lines: int = rules.MINIFIED_MAX_LINES,
    minified_chars: int = rules.MINIFIED_MIN_CHARS,
    size: str = "size",
) -> DataFrame:
    """Payloads to text, with the ``outcome`` of each read (null: read, not empty).

    ``raw``: ``(…, http_status, encoding, size, content_b64)``; ``size`` names the payload's size.  Bytes that are not UTF-8 are
    replaced, they never fail the read.
    """
    encoded = F.coalesce("content_b64", F.lit(""))
    binary = F.try_to_binary(F.translate(encoded, "\n", ""), F.lit("base64"))
    text = F.make_valid_utf8(binary.cast("string"))
    decoded = raw.withColumn("content", F.when(encoded == "", F.lit("")).otherwise(text))
    failed = (
        F.when(F.coalesce(F.col("http_status") != 200, F.lit(True)), F.lit(rules.FETCH_HTTP_ERROR))
        .when((encoded == "") & (F.col("encoding") == "none"), F.lit(rules.FETCH_CONTENT_UNAVAILABLE))
        .when(
            (encoded == "") & (F.col("encoding") == "base64") & (F.col(size) == 0),
            F.lit(rules.EMPTY_FILES),
        )
        .when(encoded == "", F.lit(rules.FETCH_UNEXPECTED_PAYLOAD))
        .when(F.col("content").isNull(), F.lit(rules.FETCH_EXCEPTION))
        .otherwise(T.content_guard("content", max_lines, minified_lines, minified_chars))
    )
    return decoded.withColumn("outcome", failed).drop("content_b64")


def readable(attempts: DataFrame) -> DataFrame:
    """The files the audit reads: everything fetched, empty files included."""
    return attempts.filter(F.col("outcome").isNull() | (F.col("outcome") == rules.EMPTY_FILES))


def repo_catalog(
    raw: DataFrame, max_rows: int | None = rules.CATALOG_MAX_ROWS, owner: str = "user_id"
) -> DataFrame:
    """Every user's repositories, the first ``max_rows`` of each in listing order (None: all).

    ``overflow`` tells of a user who has more.  Ranking stops below the shuffle at one row over
    the limit per user and task.
    """
    if max_rows is None:
        kept = raw.withColumn("overflow", F.lit(False))
    else:
        mine = Window.partitionBy(owner)
        ranked = raw.withColumn("place", F.row_number().over(mine.orderBy("ord")))
        ranked = ranked.filter(F.col("place") <= max_rows + 1)
        over = F.max("place").over(mine) > max_rows
        kept = ranked.withColumn("overflow", over).filter(F.col("place") <= max_rows)
    return kept.select(
        owner,
        "overflow",
        "id",
        F.col("full_name").alias("name"),
        "description",
        "language",
        "visibility",
        F.col("html_url").alias("url"),
    )
