"""Katz backoff language model: Good-Turing discounted bigrams of words.

Every word of the training texts is a class of its own, and every bigram is stored, however rare.
One more class, ``OTHER``, stands for the words not seen in training.  A caller may fold words below
a share ``epsilon`` of the training tokens into it; inside it a word has probability
``(c + 1) / (C + V + 1)``.

    P(w | h)     = d(c) * c(h, w) / c(h)          for a stored bigram, d by Good-Turing up to ``K``
                 = alpha(h) * P(class of w)       otherwise
    P(word | h)  = P(class | h) * P(word | class)

``alpha`` is what the discounts leave, divided by the probability of the classes not seen after h, so
each history's probabilities add up to one.  The logarithm of a text is the sum over its tokens of
``log alpha(h) + log P(class)``, plus a correction for each stored bigram, plus the word's share of
its class.  The counts, the ``alpha`` of every history and the corrections are tables.  The most
frequent words and bigrams travel with the tasks (at most ``CACHED`` each); the rest are looked up by
joins, which no frequent word takes part in.  What travels changes the work, not the result.

Defined results: a null or empty text has one token, its end; a null id trains; repeated rows count
and are scored like others; without training texts every word is one unseen word; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import SPACED, Words, binary_text, combine, most_frequent, prepare, signed, unsigned, words_in
from assayer.session import delete_table, new_table_path

EPSILON = 0.0
K = 5
CACHED = 1 << 17
CHUNK = 2_000_000
PARTS = 16
# Names of the end, the begin and the folded words; hashes of words are spread over 64 bits.
END, BEGIN, OTHER = np.uint64(0x456E64), np.uint64(0x42656769), np.uint64(0x4F74686572)


@dataclass(frozen=True)
class Tables:
    words: str  # word, n: partitioned by part
    bigrams: str  # h, w, n, of_w, hot: partitioned by part
    rare: str  # h, w, n, of_w, hot: bigrams whose second word does not travel
    histories: str  # h, log_alpha, log_scale: partitioned by part
    known: str  # word, n, log_alpha: partitioned by part
    model: str  # key, n, delta: partitioned by part


@dataclass(frozen=True)
class Model:
    """What tasks carry: bounded by ``CACHED``, and by 1 / ``epsilon`` where words are folded."""

    tables: Tables
    train_tokens: int
    train_types: int
    least: float  # count from which a word is a class of its own
    rest_total: int  # tokens and types of the folded words
    rest_types: int
    log_other: float  # log10 P(OTHER)
    begin_alpha: float
    other_alpha: float
    own: np.ndarray | None  # words that are not folded, sorted; None: nothing is folded
    names: np.ndarray  # cached words, sorted
    counts: np.ndarray
    log_alpha: np.ndarray
    keys: np.ndarray  # cached bigrams, sorted
    deltas: np.ndarray


def sequences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each closed by its end, and the document of each."""
    n = len(words.bounds) - 1
    doc = np.concatenate([words.doc, np.arange(n)])
    order = np.argsort(doc, kind="stable")
    return np.concatenate([words.hashes(), np.full(n, END)])[order], doc[order]


def _counted(frames: Iterator[np.ndarray], name: str) -> Iterator[pa.RecordBatch]:
    """Counts by value, given out per some million values."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(n)], names=[name, "n"])

    for values in frames:
        held.append(values)
        size += len(values)
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _store(counts: DataFrame, column: str, path: str) -> DataFrame:
    part = F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int")
    placed = counts.withColumn("part", part)
    placed.write.partitionBy("part").parquet(path)
    # an empty table has no files to tell its columns
    return counts.sparkSession.read.schema(placed.schema).parquet(path)


def _places(names: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of every value among the sorted names, or -1."""
    if not len(names):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(names, values), len(names) - 1)
    return np.where(names[at] == values, at, -1)


def classes_of(tokens: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """Tokens, those that are folded by the name of all of them."""
    return tokens if own is None else np.where(_places(own, tokens) >= 0, tokens, OTHER)


def histories_of(classes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """What stands before every token of its text."""
    history = np.full(len(classes), BEGIN)
    if len(classes) > 1:
        history[1:] = np.where(doc[1:] == doc[:-1], classes[:-1], BEGIN)
    return history


def _counted_pairs(frames: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Counts by history and word, given out per some million tokens."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        h, w = (np.concatenate(part) for part in zip(*held, strict=True))
        _, first, n = np.unique(combine(h, w), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(h[first])), pa.array(signed(w[first])), pa.array(n)], names=["h", "w", "n"]
        )

    for pair in frames:
        held.append(pair)
        size += len(pair[0])
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def discounts(n_of: dict[int, int], k: int = K) -> np.ndarray:
    """Katz's discount for counts 1 to ``k``; where the counts of counts allow none, r / (r + 1)."""
    out = np.ones(k + 1)
    n = lambda r: n_of.get(r, 0)
    top = (k + 1) * n(k + 1) / n(1) if n(1) else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n(r + 1) / (r * n(r)) - top) / (1 - top) if n(r) and top < 1 else 0.0
        out[r] = d if 0 < d < 1 else r / (r + 1)
    return out


def train(texts: DataFrame, epsilon: float = EPSILON, k: int = K, cached: int = CACHED) -> Model:
    """Count ``texts`` (column ``text``, binary), store the tables and fit the model.

    Counts are combined in each task before they move.  The driver sees the cached rows and the
    first counts of counts.  A bigram meets the count of its word, then the ``alpha`` of its
    history: those of cached words in its task, the others, of few bigrams each, by a join.
    """
    spark = prepare(texts.sparkSession)
    tables = Tables(*(new_table_path(spark, f"katz-{t}") for t in ("words", "bigrams", "rare", "histories", "known", "model")))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted((sequences(w)[0] for _, w in words_in(batches, "text", SPACED, lower=True)), "word")

    summed = lambda df, *c: df.groupBy(*c).agg(F.sum("n").alias("n"))
    words = _store(summed(texts.mapInArrow(count_words, "word bigint, n bigint"), "word"), "word", tables.words)
    size = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, types = size["n"] or 0, size["v"]
    least = max(1.0, epsilon * total)
    folds = least > 1
    top = most_frequent(words.select("word", "n"), cached, least if folds else None)
    order = np.argsort(unsigned(top["word"].to_numpy()))
    names, counts = unsigned(top["word"].to_numpy())[order], top["n"].to_numpy()[order]
    own = names[counts >= least] if folds else None
    rest_total = total - int(counts[counts >= least].sum()) if folds else 0
    classes = (len(own) if folds else types) + 1

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for _, found in words_in(batches, "text", SPACED, lower=True):
                tokens, doc = sequences(found)
                kind = classes_of(tokens, own)
                yield histories_of(kind, doc), kind

        return _counted_pairs(pairs())

    pair = "h bigint, w bigint, n bigint, of_w bigint, hot boolean"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The count of the word, and whether the history travels too; null where a table knows."""
        for batch in batches:
            h, w = unsigned(batch.column(0).to_numpy()), unsigned(batch.column(1).to_numpy())
            at = _places(names, w)
            of_w = np.where(at >= 0, counts[at], 0) if len(counts) else np.zeros(len(w), np.int64)
            of_w = np.where(w == OTHER, rest_total + 1, of_w)
            hot = (_places(names, h) >= 0) | (h == BEGIN) | (h == OTHER)
            more = [pa.array(of_w, mask=(at < 0) & (w != OTHER)), pa.array(hot)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["h", "w", "n", "of_w", "hot"])

    grouped = summed(texts.mapInArrow(count_bigrams, "h bigint, w bigint, n bigint"), "h", "w")
    bigrams = _store(grouped.mapInArrow(place, pair), "h", tables.bigrams).drop("part")
    rare = bigrams.filter("of_w is null").drop("of_w").join(
        words.select(F.col("word").alias("w"), F.col("n").alias("of_w")).hint("merge"), "w"
    ).select(*bigrams.columns)
    rare.write.parquet(tables.rare)
    bigrams = bigrams.filter("of_w is not null").unionByName(spark.read.schema(bigrams.schema).parquet(tables.rare))
    n_of = {r["n"]: r["m"] for r in bigrams.filter(F.col("n") <= k + 1).groupBy("n").agg(F.count("*").alias("m")).collect()}
    d = discounts(n_of, k)
    discount = F.get(F.array(*(F.lit(float(x)) for x in d)), F.least("n", F.lit(k)).cast("int"))
    kept = F.when(F.col("n") <= k, discount).otherwise(1.0) * F.col("n")
    by_history = bigrams.groupBy("h").agg(
        F.sum("n").alias("n"), F.sum(kept).alias("kept"), F.sum("of_w").alias("seen"), F.count("*").alias("m")
    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, left, seen, m = (batch.column(i).to_numpy() for i in range(1, 5))
            unseen = (total + 1 - seen) / (total + 1)
            full = m >= classes  # every class was seen after it
            share = left / n
            # a history whose bigrams are all frequent leaves one count to the classes not seen after it
            scale = np.where(full, 1 / share, np.where(share >= 1 - 1e-12, n / (n + 1), 1.0))
            alpha = np.where(full, 1.0, (1 - share * scale) / np.where(full, 1.0, unseen))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.log10(alpha)), pa.array(np.log10(scale / n))],
                names=["h", "log_alpha", "log_scale"],
            )

    histories = _store(by_history.mapInArrow(weigh, "h bigint, log_alpha double, log_scale double"), "h", tables.histories)
    histories = histories.select("h", "log_alpha", "log_scale")

    def travels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = unsigned(batch.column(0).to_numpy())
            yield batch.filter(pa.array((_places(names, h) >= 0) | (h == BEGIN) | (h == OTHER)))

    near = histories.mapInArrow(travels, histories.schema).toArrow()
    order = np.argsort(unsigned(near["h"].to_numpy()))
    near_h = unsigned(near["h"].to_numpy())[order]
    near_alpha, near_scale = near["log_alpha"].to_numpy()[order], near["log_scale"].to_numpy()[order]
    at = _places(near_h, np.concatenate([names, [BEGIN, OTHER]]).astype(np.uint64))
    alphas = np.where(at >= 0, near_alpha[at], 0.0) if len(near_h) else np.zeros(len(at))

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = unsigned(batch.column(0).to_numpy()), unsigned(batch.column(1).to_numpy())
            n, of_w = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            if batch.num_columns == 6:
                past = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            else:
                at = _places(near_h, h)
                past = near_alpha[at], near_scale[at]
            left = np.where(n <= k, d[np.minimum(n, k)], 1.0) * n
            delta = np.log10(left) + past[1] - past[0] - np.log10(of_w / (total + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(combine(h, w))), batch.column(2), pa.array(delta)], names=["key", "n", "delta"]
            )

    row = ["h", "w", "n", "of_w"]
    far = bigrams.filter("not hot").select(*row).join(histories.hint("merge"), "h")
    corrected = bigrams.filter("hot").select(*row).mapInArrow(correct, "key bigint, n bigint, delta double").unionAll(
        far.select(*row, "log_alpha", "log_scale").mapInArrow(correct, "key bigint, n bigint, delta double")
    )
    model = _store(corrected, "key", tables.model)
    past = histories.select(F.col("h").alias("word"), "log_alpha")
    known = words.select("word", "n").join(past.hint("merge"), "word", "left").fillna(0.0, ["log_alpha"])
    _store(known, "word", tables.known)
    # the model holds what scoring asks for
    for path in (tables.bigrams, tables.rare):
        delete_table(spark, path)
    hot = most_frequent(model.select("key", "n", "delta"), cached)
    order = np.argsort(hot["key"].to_numpy())
    return Model(
        tables, total, types, least, rest_total, types - len(own) if folds else 0,
        float(np.log10((rest_total + 1) / (total + 1))), float(alphas[-2]), float(alphas[-1]), own,
        names, counts, alphas[:-2], hot["key"].to_numpy()[order], hot["delta"].to_numpy()[order],
    )


SCORED = (
    "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, "
    "words array<bigint>, bigrams array<bigint>"
)


def score(texts: DataFrame, model: Model) -> DataFrame:
    """Score ``id, held_out, text`` rows: ``id, held_out, n_tokens, n_known, base_score, score``.

    A pass over the texts sums what the cached rows tell and lists the rest, which two joins look
    up.  The listing is written once, and its rows are numbered as they are written.
    """
    spark = prepare(texts.sparkSession)
    names, counts, log_alpha, own = model.names, model.counts, model.log_alpha, model.own
    keys, deltas, least = model.keys, model.deltas, model.least
    log_other, begin_alpha, other_alpha = model.log_other, model.begin_alpha, model.other_alpha
    total = model.train_tokens + 1
    base_size = model.train_tokens + model.train_types + 1
    rest_size = model.rest_total + model.rest_types + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in words_in(batches, "text", SPACED, lower=True):
            rows = batch.num_rows
            tokens, doc = sequences(found)
            at = _places(names, tokens)
            known = at >= 0
            c = np.where(known, counts[at], 0) if len(counts) else np.zeros(len(tokens))
            past = np.where(known, log_alpha[at], 0.0) if len(counts) else np.zeros(len(tokens))
            base = np.where(known, np.log10((c + 1) / base_size), 0.0)
            # a word adds its class, its share of it, and alpha as the history of the next
            alone = np.log10(np.maximum(c, 1) / total) + past
            folded = log_other + np.log10((c + 1) / rest_size) + np.where(tokens == END, 0.0, other_alpha)
            value = np.where(known, np.where(c >= least, alone, folded), 0.0)
            value = value + np.where(tokens == END, begin_alpha, 0.0)  # once a text
            kind = classes_of(tokens, own)
            key = signed(combine(histories_of(kind, doc), kind))
            if len(keys):
                i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hot = keys[i] == key
                value = value + np.where(hot, deltas[i], 0.0)
            else:
                hot = np.zeros(len(key), bool)

            def lists(flat: np.ndarray, flags: np.ndarray, doc=doc, rows=rows) -> pa.ListArray:
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[flags], minlength=rows))])
                return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat[flags]))

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.bincount(doc, minlength=rows)),
                    pa.array(np.bincount(doc, known, rows).astype(np.int64)),
                    pa.array(np.bincount(doc, base, rows)), pa.array(np.bincount(doc, value, rows)),
                    lists(signed(tokens), ~known), lists(key, ~hot),
                ],
                names=[f.split()[0] for f in SCORED.split(", ")],
            )

    path = new_table_path(spark, "katz-scored")
    passed = texts.select("id", "held_out", "text").mapInArrow(run, SCORED)
    passed.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    words = spark.read.schema("word bigint, n bigint, log_alpha double, part int").parquet(model.tables.known)
    bigrams = spark.read.schema("key bigint, n bigint, delta double, part int").parquet(model.tables.model)
    words, bigrams = words.select("word", "n", "log_alpha"), bigrams.select("key", "delta")
    asked = rows.select("row", F.explode("words").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    looked = asked.join(words.hint("merge"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    alone = F.log10(F.col("n") / float(total)) + F.col("log_alpha")
    after = F.when(F.col("word") == int(END), 0.0).otherwise(other_alpha)
    folded = log_other + F.log10((F.col("n") + 1) / float(rest_size)) + after
    by_word = looked.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / float(base_size))).alias("more_base"),
        F.sum(F.col("times") * F.when(F.col("n") >= least, alone).otherwise(folded)).alias("more_value"),
    )
    pairs = rows.select("row", F.explode("bigrams").alias("key"))
    by_bigram = pairs.join(bigrams.hint("merge"), "key").groupBy("row").agg(F.sum("delta").alias("more_delta"))
    plus = lambda column, more: F.col(column) + F.coalesce(F.col(more), F.lit(0))
    joined = rows.drop("words", "bigrams").join(by_word, "row", "left").join(by_bigram, "row", "left")
    return joined.select(
        "id", "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"),
        plus("base", "more_base").alias("base_score"),
        (plus("score", "more_value") + F.coalesce("more_delta", F.lit(0.0))).alias("score"),
    )


def held_out_scores(
    docs: DataFrame, folds: int = 7, fold: int = 2, epsilon: float = EPSILON, k: int = K, cached: int = CACHED,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Train on all but one fold, told by the CRC-32 of the id as text, and score every document."""
    prepare(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string")) % folds == fold, F.lit(False))
    texts = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"), held.alias("held_out"), binary_text(f"`{text_column}`")
    )
    model = train(texts.filter(~F.col("held_out")).select("text"), epsilon, k, cached)
    return score(texts, model).withColumn("train_tokens", F.lit(model.train_tokens).cast("bigint"))
