"""N-gram Jaccard join: documents with equal prefixes and size form a group, groups are filtered
against each other by prefix, size and position, and members are verified on their whole sets.

A document's set is sorted by a global order of shingles, frequent ones last; its prefix is so long
that two sets above the threshold share a shingle of it.  The order needs to be total, not exact:
frequent shingles come from counts within chunks of the input, and at most ``MAX_FREQUENT`` of them
are broadcast.  Which shingles are known as frequent changes the work, never the links.

Prefixes are extended: with ``e`` more shingles two linked sets share ``e + 1`` of the extended ones, so
each group may leave out those ``e`` of its shingles that most other groups have, and still meets every
group that it is linked with at the rarest shingle that both have.  How many groups have a shingle is
counted exactly where its entries meet.  Most texts then meet no other at all: they have enough
shingles of their own, and a passage that many texts share is only asked for by texts made of it.

Pairs of groups are filtered by size, by position and by parities: a set has ``PARITY`` bits, each the
parity of the number of its shingles that fall on it, so two sets that differ in ``d`` shingles differ in at
most ``d`` bits.  A group knows the bits in which all its members agree.  Near copies of one text that are
all a little too far from each other are told apart by their bits, and never move.

What is wanted are components, so pairs inside one are not all verified.  First every group is
compared with one representative per shared shingle and size class, which joins nearly all copies;
then with others, chosen anew; at last all pairs of groups that still lie in different components
are verified, so that no link between components is lost.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; fewer words than a shingle make one shingle; equal sets are linked whatever the ids; null
ids are linked like others but never name a component unless it has no other id; repeated rows get
a row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import (
    SPACED,
    Words,
    binary_text,
    bitmap_of,
    combine,
    in_bitmap,
    mix,
    most_frequent,
    prepare,
    signed,
    unsigned,
    words_in,
)
from assayer.llm.components import components
from assayer.session import discard, gathered, materialize

SHINGLE = 4
PERCENT = 85
MAX_FREQUENT = 1 << 16
CHUNK = 1 << 21  # shingles counted together
OFTEN = 2  # times in a chunk
STARS = 8  # rounds at most
FEW = 20  # a round that links fewer than one in so many pairs is the last
PAIRS_PER_TASK = 512
PARITY = 512  # bits
EARLIER = 8  # entries of a group that each of its entries knows
MOST = 1 << 16  # groups of one shingle are told apart up to this number


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 63-bit name of all shingles of a batch, in order of rows, repeats included."""
    hashes = words.hashes()
    at, names = words.grams(hashes, n)
    rows = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = mix(words.counts[short].astype(np.uint64))
        for j in range(n - 1):
            more = words.counts[short] > j
            whole[more] = combine(whole[more], hashes[words.bounds[short[more]] + j])
        rows, names = np.concatenate([rows, short]), np.concatenate([names, whole])
        order = np.argsort(rows, kind="stable")
        rows, names = rows[order], names[order]
    return rows, names >> np.uint64(1)


def frequent_shingles(texts: DataFrame, n: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` of the shingles that many documents have, with their order class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            names, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= OFTEN
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(names[often])), pa.array(times[often])], names=["name", "n"]
            )

        for batch, words in words_in(batches, "text", SPACED, lower=True):
            rows, names = shingle_sets(words, n)
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                held.append(np.unique(names[a:b]))
                size += len(held[-1])
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counted = texts.mapInArrow(count, "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    top = most_frequent(materialize(counted, "frequent"), limit)
    names = unsigned(top["name"].to_numpy())
    order = np.argsort(names)
    levels = np.minimum(np.log2(np.maximum(top["n"].to_numpy(), 1)), 62).astype(np.uint64)
    return names[order], levels[order]


def ordered(names: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Names whose numeric order puts frequent shingles last, the most frequent at the end."""
    known, level = frequent
    if not len(known):
        return names
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    last = (np.uint64(1) << np.uint64(63)) | (level[at] << np.uint64(57)) | (names & np.uint64((1 << 57) - 1))
    return np.where(known[at] == names, last, names)


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def extension(n: int, percent: int) -> int:
    """How many shingles a prefix is longer than it must be: as many again, where there are."""
    prefix = prefix_size(n, percent)
    return min(prefix, n - prefix)


BITS = [f"s{i}" for i in range(PARITY // 64)]
DESCRIBED = "id bigint, n bigint, node bigint, cluster bigint, prefix binary, " + ", ".join(f"{s} bigint" for s in BITS)


def parity(names: np.ndarray) -> np.ndarray:
    """The parity bits of a set, as words of 64."""
    falls = np.bincount((mix(names) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
    return np.packbits((falls & 1).astype(np.uint8), bitorder="little").view("<i8")


def describe(texts: DataFrame, n: int, percent: int, frequent: tuple) -> DataFrame:
    """Per row: size of its set, ``node`` (name of the set), ``cluster`` (of extended prefix and size), prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in words_in(batches, "text", SPACED, lower=True):
            rows, names = shingle_sets(words, n)
            names = ordered(names, frequent)
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            sizes, nodes, clusters, prefixes, bits = [], [], [], [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = np.unique(names[a:b])
                size = len(own)
                head = own[: prefix_size(size, percent) + extension(size, percent)].tobytes() if size else b""
                node = hashlib.blake2b(own.tobytes(), digest_size=8).digest()
                tied = hashlib.blake2b(head + size.to_bytes(8, "little"), digest_size=8).digest()
                sizes.append(size)
                nodes.append(int.from_bytes(node, "little", signed=True))
                clusters.append(int.from_bytes(tied, "little", signed=True))
                prefixes.append(head)
                bits.append(parity(own))
            words_ = np.stack(bits, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                    pa.array(clusters, pa.int64()), pa.array(prefixes, pa.binary()), *(pa.array(w) for w in words_),
                ],
                names=["id", "n", "node", "cluster", "prefix", *BITS],
            )

    return texts.mapInArrow(run, DESCRIBED)


def counted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column, those whose value repeats, with its number (``MOST`` at most).

    A run is held until it ends or has ``MOST`` rows, so one of any length streams past.
    """

    def give(part: pa.RecordBatch, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(n.astype(np.int32))], names=[*part.schema.names, "df"])

    held, size, value = [], 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        if size > 1:
            for part in held:
                yield give(part, np.full(part.num_rows, min(size, MOST)))

    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        lengths = np.diff(np.append(starts, len(values)))
        i = 0
        if value is not None and values[0] == value:
            held.append(batch.slice(0, int(lengths[0])))
            size += int(lengths[0])
            if size >= MOST:
                yield from flush()
                held = []
            if len(starts) == 1:
                continue
            i = 1
        yield from flush()
        if starts[-1] > starts[i]:
            n = np.repeat(lengths[i:-1], lengths[i:-1])
            part = batch.slice(int(starts[i]), len(n))
            yield give(part.filter(pa.array(n > 1)), np.minimum(n[n > 1], MOST))
        held, size, value = [batch.slice(int(starts[-1]))], int(lengths[-1]), values[-1]
    yield from flush()


def shared_entries(clusters: DataFrame, percent: int) -> DataFrame:
    """``token, cluster, n, pos``: of each cluster's prefix the shingles that other clusters have too,
    less those that most have.

    Entries meet sorted by shingle and stream past: no list of them is ever held.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) // 8 for x in batch.column(2).to_pylist()], np.int64)
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tokens), pa.array(np.repeat(batch.column(0).to_numpy(), lengths)),
                    pa.array(np.repeat(batch.column(1).to_numpy(), lengths).astype(np.int32)),
                    pa.array(pos.astype(np.int32)),
                ],
                names=["token", "cluster", "n", "pos"],
            )

    schema = "token bigint, cluster bigint, n int, pos int"
    entries = clusters.select("cluster", "n", "prefix").mapInArrow(explode, schema)
    entries = entries.repartition("token").sortWithinPartitions("token").mapInArrow(counted_runs, f"{schema}, df int")
    # sizes as in prefix_size and extension; the smallest set that can be linked leaves out fewest
    must = lambda n: F.floor((n * percent + 99) / 100)
    prefix = lambda n: n - must(n) + 1
    more = lambda n: F.least(prefix(n), n - prefix(n))
    n = F.col("n").cast("bigint")
    own = Window.partitionBy("cluster")
    alone = prefix(n) + more(n) - F.count("*").over(own)  # shingles that no other cluster has
    place = F.row_number().over(own.orderBy("df", "token"))
    kept = entries.withColumns({"place": place, "most": prefix(n) + more(n) - more(must(n)) - alone})
    return kept.filter(F.col("place") <= F.col("most")).select("token", "cluster", "n", "pos")


def _compatible(n1: Column, n2: Column, percent: int) -> Column:
    return (F.least(n1, n2) * 100) >= (F.greatest(n1, n2) * percent)


def _size_class(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")


def _may_reach(times: Column, n1: Column, n2: Column, percent: int) -> Column:
    """Can two sets that share ``times`` prefix shingles reach the threshold?

    Of the two prefixes one ends first in the global order.  What the sets share beyond shingles of
    both prefixes lies behind that end, among the rest of that set.
    """
    rest = lambda n: F.floor((n * percent + 99) / 100) - 1  # noqa: E731  n less its prefix
    return (times + F.greatest(rest(n1), rest(n2))) * (100 + percent) >= (n1 + n2) * percent


def star_pairs(entries: DataFrame, percent: int, round_: int, rows: int) -> DataFrame:
    """One or two pairs per cluster: with the representative of its own and of the next lower size
    class that it shares most prefix shingles with, if these are enough.  Representatives come from the
    largest component that has their shingle, where copies with few changes meet, and are drawn anew
    every round.  ``entries`` has ``cluster, n, root, size``, and about so many ``rows``.  Shingles that have another representative are not counted here, so a
    link may be passed over; ``rest_pairs`` passes over none."""
    tagged = entries.withColumn("class", _size_class(F.col("n"), percent))
    pick = F.xxhash64("cluster", F.lit(round_))
    reps = tagged.groupBy("token", "class").agg(
        F.max(F.struct("size", pick.alias("h"), "cluster", "n", "root")).alias("rep"),
    )
    reps = gathered(reps, rows)
    reps = reps.select(
        "token", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"), "rep",
        F.col("class").alias("rep_class"),
    )
    met = gathered(tagged.join(reps, ["token", "class"]), rows).filter(
        (F.col("root") != F.col("rep.root")) & _compatible(F.col("n"), F.col("rep.n"), percent)
    )
    below = (F.col("class") - F.col("rep_class")).alias("below")
    counted = met.groupBy("cluster", below, "n", F.col("rep.cluster").alias("other"), F.col("rep.n").alias("n2")).agg(
        F.count("*").alias("times")
    )
    counted = gathered(counted.filter(_may_reach(F.col("times"), F.col("n"), F.col("n2"), percent)), rows)
    best = counted.groupBy("cluster", "below").agg(F.max(F.struct("times", "other")).alias("best"))
    return best.select("cluster", F.col("best.other").alias("other")).distinct()


def _near_enough(differ: list[Column], n1: Column, n2: Column, percent: int) -> Column:
    """Linked sets differ in at most ``(n1 + n2) * (100 - percent) / (100 + percent)`` shingles, hence bits."""
    count = sum((F.bit_count(d) for d in differ[1:]), F.bit_count(differ[0]))
    return count * (100 + percent) <= (n1 + n2) * (100 - percent)


def meetings(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs of clusters, in different components, that size, position and parities allow; few repeat.

    ``entries`` has ``low`` and ``high``, the least and greatest root among the cluster's members, and
    ``and_…`` and ``or_…``, the bits that all and that any of them have.

    A pair is made where it first meets, not at every shingle that both have: an entry knows the
    ``EARLIER`` ones before it, and where two entries have one of these in common, their pair was met
    there.  At the first of all the shingles that a pair shares no entry before is common.
    """
    open_ = entries.groupBy("token").agg(F.min("low").alias("a"), F.max("high").alias("b")).filter("a <> b")
    mine = entries.join(open_.select("token"), "token", "left_semi")
    before = Window.partitionBy("cluster").orderBy("token").rowsBetween(-EARLIER, -1)
    mine = mine.withColumn("earlier", F.collect_list("token").over(before))
    other = mine.select("token", *(F.col(c).alias(f"{c}2") for c in mine.columns if c != "token"))
    differ = [
        F.col(f"and_{s}").bitwiseAND(F.bitwise_not(f"or_{s}2")).bitwiseOR(F.bitwise_not(f"or_{s}").bitwiseAND(F.col(f"and_{s}2")))
        for s in BITS
    ]
    before = F.least("pos", "pos2") + 1
    after = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) - 1
    enough = (before + after) * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    split = (F.col("low") != F.col("high2")) | (F.col("high") != F.col("low2"))
    pairs = mine.join(other, "token").filter(
        (F.col("cluster") < F.col("cluster2")) & split & _compatible(F.col("n"), F.col("n2"), percent) & enough
        & _near_enough(differ, F.col("n"), F.col("n2"), percent) & ~F.arrays_overlap("earlier", "earlier2")
    )
    return pairs.select("cluster", F.col("cluster2").alias("other"))


def rest_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``meetings``, once each."""
    return meetings(entries, percent).distinct()


def verified(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, percent: int, frequent: tuple) -> DataFrame:
    """Those ``a, b`` pairs of nodes whose sets reach the threshold.

    Sets are made again from the texts.  A bitmap of fixed size, over one id of every node, passes most
    other texts by unread; an exact join drops what else it lets through.  Then every ``a`` moves to a
    part of its ``b``: a node in many pairs is dealt out in parts.
    """
    pairs = pairs.filter("a <> b").distinct()
    few = pairs.count()
    pairs = materialize(gathered(pairs, few), "pairs")
    sides = gathered(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), few)
    wanted = nodes.join(sides, "node", "left_semi").select(F.coalesce("least", F.lit(0).cast("bigint")).alias("least"))
    shared = texts.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "least"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(shared.value, batch.column(0).fill_null(0).to_numpy())))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in words_in(asked(batches), "text", SPACED, lower=True):
            rows, names = shingle_sets(words, n)
            names = ordered(names, frequent)
            bounds = np.searchsorted(rows, np.arange(len(words.bounds)))
            found, own = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a < b:
                    own.append(np.unique(names[a:b]).tobytes())
                    found.append(int.from_bytes(hashlib.blake2b(own[-1], digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array(own, pa.binary())], names=["node", "set"]
            )

    made = texts.mapInArrow(sets, "node bigint, set binary")
    parts = gathered(pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).alias("parts")), few)
    dealt = gathered(pairs.join(parts, "b"), few).select(
        F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), F.lit(True).alias("member")
    )
    heads = parts.select(
        F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
        F.lit(False).alias("member"),
    )
    places = dealt.unionAll(heads)
    sent = made.join(places.hint("merge"), "node").select("b", "part", "member", "node", "set")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, key = None, None
        for batch in batches:
            left, right = [], []
            for b, member, node, raw in zip(
                batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(),
                batch.column(4), strict=True,
            ):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if not member:
                    head, key = own.copy(), b
                elif key == b:
                    at = np.minimum(np.searchsorted(head, own), len(head) - 1)
                    both = int((head[at] == own).sum())
                    if 100 * both >= percent * (len(head) + len(own) - both):
                        left.append(node)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    lined = sent.repartition("b", "part").sortWithinPartitions("b", "part", "member")
    # a set is some kB, so a task takes fewer of them
    return materialize(gathered(lined.mapInArrow(compare, "a bigint, b bigint"), few, 2_000), "verified")


def similar_components(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
    id_column: str = "doc_id", text_column: str = "text", max_frequent: int = MAX_FREQUENT,
) -> DataFrame:
    """``id, n_shingles, component_id`` of every row of ``docs``.

    Rows are linked where ``100 * |A and B| >= percent * |A or B|``; ``component_id`` is the
    smallest id that links reach.
    """
    prepare(docs.sparkSession)
    texts = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"), binary_text(f"`{text_column}`")
    )
    frequent = frequent_shingles(texts, shingle, max_frequent)
    described = materialize(describe(texts, shingle, percent, frequent), "described")
    full = described.filter("n > 0")
    nodes = materialize(
        full.groupBy("node", "cluster", "n").agg(F.min("id").alias("least"), *(F.max(s).alias(s) for s in BITS)), "nodes"
    )
    heads = nodes.groupBy("cluster").agg(F.min("node").alias("head"), F.count("*").alias("members"))
    heads = materialize(heads, "heads")
    clusters = full.groupBy("cluster").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    entries = materialize(shared_entries(clusters, percent), "entries")
    n_entries, n_heads = entries.count(), heads.count()

    check = lambda pairs: verified(texts, nodes, pairs, shingle, percent, frequent)
    named = lambda pairs: (  # noqa: E731  clusters to their first members
        pairs.join(heads.select("cluster", F.col("head").alias("a")), "cluster")
        .join(heads.select(F.col("cluster").alias("other"), F.col("head").alias("b")), "other")
        .select("a", "b")
    )
    inner = nodes.join(heads.filter("members > 1"), "cluster").select(F.col("node").alias("a"), F.col("head").alias("b"))
    links, roots = None, None
    for round_ in range(STARS):
        placed = gathered(_roots_of(heads, roots), n_heads)
        sizes = gathered(placed.groupBy("root").agg(F.count("*").alias("size")), n_heads)
        placed = materialize(gathered(placed.join(sizes, "root"), n_heads), "placed")
        rooted = gathered(entries.join(placed, "cluster"), n_entries)
        pairs = named(star_pairs(rooted, percent, round_, n_entries))
        if round_ == 0:
            pairs = pairs.unionAll(inner)
        pairs = materialize(gathered(pairs.distinct(), n_heads), "star-pairs")
        found = check(pairs)
        compared, linked = pairs.count(), found.count()
        discard(placed, pairs)
        if round_ and not linked:
            break
        links = found if links is None else links.unionAll(found)
        roots = materialize(gathered(components(links), n_heads), "roots")
        if linked * FEW < compared:
            break
    members = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = materialize(members.select("node", "cluster", "n", "root", *BITS), "members")
    spread = members.groupBy("cluster").agg(
        F.min("root").alias("low"), F.max("root").alias("high"),
        *(F.bit_and(s).alias(f"and_{s}") for s in BITS), *(F.bit_or(s).alias(f"or_{s}") for s in BITS),
    )
    pairs = rest_pairs(entries.join(spread, "cluster"), percent).unionAll(
        spread.filter("low <> high").select("cluster", F.col("cluster").alias("other"))
    )
    side = lambda key, mark: members.select(
        F.col("cluster").alias(key), F.col("node").alias(mark), *(F.col(c).alias(f"{c}_{mark}") for c in ("root", "n", *BITS))
    )
    differ = [F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b")) for s in BITS]
    expanded = pairs.join(side("cluster", "a"), "cluster").join(side("other", "b"), "other").filter(
        (F.col("root_a") != F.col("root_b")) & _near_enough(differ, F.col("n_a"), F.col("n_b"), percent)
    )
    expanded = expanded.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    expanded = materialize(expanded.distinct(), "rest")
    if not expanded.isEmpty():
        more = check(expanded)
        if not more.isEmpty():
            roots = materialize(components(links.unionAll(more)), "roots")
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named_roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = materialize(placed.join(named_roots, "root").select("node", "component_id"), "by-node")
    rows = full.join(by_node.hint("merge"), "node").select("id", F.col("n").alias("n_shingles"), "component_id")
    alone = described.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return rows.unionAll(alone)


def _roots_of(heads: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return heads.select("cluster", F.col("head").alias("root"))
    return heads.join(roots, heads["head"] == roots["node"], "left").select(
        "cluster", F.coalesce("root", "head").alias("root")
    )
