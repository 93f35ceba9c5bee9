"""Ranked lexical search, term at a time with a limit on accumulators.

Of every text only the terms that some query has are stored, with their frequencies; a bitmap of fixed
size tells the tasks which these are.  Query terms are taken from the rarest on, in classes of their
document frequency (each class reaches to four times the frequency of the one before).  A round adds what
its terms give to the accumulators of its queries, one for each query and document met so far.  Every
term has a bound, the most that it gives any document.

After a round the best accumulators of a query are completed with all its terms; the k-th of these scores
is one that its k best documents reach.  Where it passes the sum of the bounds of the terms to come, no
document without an accumulator can be among them: the query makes no new ones.  An accumulator whose
partial score and that sum together stay below it goes.  What is left of a query is updated exactly with
its remaining terms, all at once; the long lists of common words are thus only read for survivors.

Scores are whole numbers: a term of weight ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` that occurs
``tf`` times in a text of ``n`` terms gives ``w * (1000000000 tf div (1000 tf + 8 m))``, where ``m`` is
``100 - b + b n N div L``, ``N`` the number of texts with terms and ``L`` their terms.

Defined results: a null or empty text or query has no terms; every row is a document or a query of its
own, also where ids repeat or are null; equal scores are ordered by id, null ids last; only scores above
0 are given; without documents or queries there are no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import (
    ALNUM,
    binary_text,
    bitmap_of,
    in_bitmap,
    prepare,
    signed,
    words_in,
)
from assayer.session import discard, materialize

TOP = 10
LENGTH_WEIGHT = 90  # b, of 100


def query_terms(queries: DataFrame) -> DataFrame:
    """``q, term``: the different terms of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in words_in(batches, "text", ALNUM, lower=True):
            rows = batch.column(0).take(pa.array(words.doc))
            yield pa.RecordBatch.from_arrays([rows, pa.array(signed(words.hashes()))], names=["q", "term"])

    return queries.select("q", "text").mapInArrow(run, "q bigint, term bigint").distinct()


STORED = "row bigint, id bigint, n bigint, terms array<bigint>, times array<bigint>"


def stored_terms(texts: DataFrame, asked) -> DataFrame:
    """Per text the number of its terms, and those that queries may ask for with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in words_in(batches, "text", ALNUM, lower=True):
            hashes = words.hashes()
            at = np.flatnonzero(in_bitmap(asked.value, signed(hashes)))
            doc, term = words.doc[at], hashes[at]
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(doc)))
            bounds = np.searchsorted(doc[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (signed(term[first]), times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words.counts.astype(np.int64)), *lists],
                names=[f.split()[0] for f in STORED.split(", ")],
            )

    return texts.select("row", "id", "text").mapInArrow(run, STORED)


def postings(stored: DataFrame, n_texts: int, n_terms: int, *carried: str) -> DataFrame:
    """``row, term, given`` (what a term gives a text, before its weight), and carried columns."""
    # multiplications first, as the scores are stated in whole numbers
    m = F.expr(f"100 - {LENGTH_WEIGHT} + (({LENGTH_WEIGHT} * n * {n_texts}L) div {max(n_terms, 1)}L)")
    listed = stored.select("row", *carried, m.alias("m"), F.expr("inline(arrays_zip(terms, times))"))
    return listed.select(
        "row", *carried, F.col("terms").alias("term"),
        F.expr("(1000000000L * times) div (1000L * times + 8L * m)").alias("given"),
    )


def weighted_terms(asked: DataFrame, found: DataFrame, n_texts: int) -> DataFrame:
    """``q, term, w, level, bound`` of the query terms that some text has."""
    counts = found.groupBy("term").agg(F.count("*").alias("df"), F.max("given").alias("most"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_texts + 2) / (2 * F.col("df") + 1)))
    weighed = counts.withColumn("w", weight).filter("w > 0 and most > 0").select(
        "term", "w", F.floor(F.log2(F.col("df").cast("double")) / 2).cast("int").alias("level"),
        (F.col("w") * F.col("most")).alias("bound"),
    )
    return asked.join(weighed, "term").select("q", "term", "w", "level", "bound")


def completed(partial: DataFrame, stored: DataFrame, weighted: DataFrame, n_texts: int, n_terms: int) -> DataFrame:
    """``q, row, score``: partial scores (of the terms up to ``level``) and all the terms to come."""
    later = weighted.select("q", "term", "w", F.col("level").alias("late"))
    met = postings(stored.join(partial.select("q", "row", "level"), "row"), n_texts, n_terms, "q", "level")
    more = met.join(later, ["q", "term"]).filter(F.col("late") > F.col("level"))
    more = more.select("q", "row", (F.col("w") * F.col("given")).alias("score"))
    both = partial.select("q", "row", "score").unionAll(more)
    return both.groupBy("q", "row").agg(F.sum("score").alias("score"))


def _best(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def survivors(stored: DataFrame, weighted: DataFrame, n_texts: int, n_terms: int, top: int) -> DataFrame | None:
    """``q, row, score, level``: the accumulators that can be among the best, with the sums of their
    query's terms up to ``level``; None where no text has a term of a query."""
    found = postings(stored, n_texts, n_terms)
    # open queries with the score that their best documents reach at least, once that many were met
    open_ = weighted.select("q").distinct().withColumn("reached", F.lit(0).cast("bigint"))
    accumulators, closed, last = None, None, None
    for level in sorted(r["level"] for r in weighted.select("level").distinct().collect()):  # 32 at most
        listed = weighted.filter(F.col("level") == level).join(open_.select("q"), "q", "left_semi")
        added = found.join(listed, "term").select("q", "row", (F.col("w") * F.col("given")).alias("score"))
        if accumulators is not None:
            added = added.unionAll(accumulators)
        to_come = F.when(F.col("level") > level, F.col("bound")).otherwise(0)
        bounds = weighted.join(open_, "q").groupBy("q", "reached").agg(F.sum(to_come).alias("rest"))
        summed = added.groupBy("q", "row").agg(F.sum("score").alias("score"))
        summed = summed.join(bounds, "q").filter(F.col("score") + F.col("rest") >= F.col("reached"))
        summed = materialize(summed.select("q", "row", "score"), f"accumulators-{level}")
        # where fewer documents than wanted were met nothing is known to be reached
        best = _best(summed, top).select("q", "row", "score", F.lit(level).alias("level"))
        full = _best(completed(best, stored, weighted, n_texts, n_terms), top).groupBy("q").agg(
            F.count("*").alias("met"), F.min("score").alias("least")
        )
        known = bounds.join(full.filter(F.col("met") >= top), "q", "left")
        known = known.withColumn("reached", F.greatest("reached", F.coalesce("least", F.lit(0).cast("bigint"))))
        known = materialize(known.select("q", "reached", "rest"), f"reached-{level}")
        ended = (F.col("rest") == 0) | (F.col("reached") > F.col("rest"))
        left = summed.join(known, "q").filter(F.col("score") + F.col("rest") >= F.col("reached"))
        here = materialize(left.filter(ended).select("q", "row", "score", F.lit(level).alias("level")), f"survivors-{level}")
        closed = here if closed is None else closed.unionAll(here)
        discard(last)
        open_, last = known.filter(~ended).select("q", "reached"), summed
        if open_.isEmpty():
            break
        accumulators = left.filter(~ended).select("q", "row", "score")
    return closed


def search(
    docs: DataFrame, queries: DataFrame, top: int = TOP, id_column: str = "doc_id", text_column: str = "text",
    query_id: str = "item_id", query_text: str = "text",
) -> DataFrame:
    """``q, query_id, rank, id, score``: the ``top`` documents of every row of ``queries``."""
    spark = prepare(docs.sparkSession)
    # rows are numbered as they are written, so all that follows sees the same numbers
    asked_of = materialize(queries.select(
        F.monotonically_increasing_id().alias("q"), F.col(f"`{query_id}`").alias("query_id"),
        binary_text(f"`{query_text}`"),
    ), "queries")
    terms = materialize(query_terms(asked_of), "query-terms")
    asked = spark.sparkContext.broadcast(bitmap_of(terms.select("term"), "term"))
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("bigint").alias("id"),
        binary_text(f"`{text_column}`"),
    )
    stored = materialize(stored_terms(texts, asked), "stored-terms")
    size = stored.filter("n > 0").agg(F.count("*").alias("texts"), F.sum("n").alias("terms")).first()
    n_texts, n_terms = size["texts"], size["terms"] or 0
    found = postings(stored, n_texts, n_terms)
    weighted = materialize(weighted_terms(terms, found, n_texts), "weighted-terms")
    left = survivors(stored, weighted, n_texts, n_terms, top)
    if left is None:
        left = spark.createDataFrame([], "q bigint, row bigint, score bigint, level int")
    sums = completed(left, stored, weighted, n_texts, n_terms)
    named = sums.filter("score > 0").join(stored.select("row", "id"), "row")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(asked_of.select("q", "query_id"), "q").select("q", "query_id", "rank", "id", "score")
