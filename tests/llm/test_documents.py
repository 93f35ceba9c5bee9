"""Operators on documents against brute force over a small corpus with all odd cases."""

from __future__ import annotations

import collections
import hashlib
import string

import pytest

from assayer.llm import exact_dedup, jaccard_join, recompression

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def split(text, lower=True):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def rows_of(df, *columns):
    order = lambda r: tuple((v is None, v) for v in r)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order)


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def test_exact_dedup(spark, make_docs, corpus):
    index = exact_dedup.open_index(spark, buckets=4)
    got = rows_of(exact_dedup.dedup_batch(index, make_docs(corpus)), "digest", "id", "keep_id", "group_size", "kept")
    groups = collections.defaultdict(list)
    for i, text in corpus:
        groups[hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()].append(i)
    expected = []
    for digest, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = True
        for i in ids:
            expected.append((digest, i, keep, len(ids), left and i == keep))
            left = left and i != keep
    assert got == in_order(expected)
    again = exact_dedup.dedup_batch(index, make_docs([(1000, "ONE"), (1001, "new"), (1002, "NEW")])).collect()
    assert {(r.id, r.keep_id, r.kept) for r in again} == {(1000, 5, False), (1001, 1002, False), (1002, 1002, True)}
    stored = spark.table(index.table)
    assert stored.count() == len(groups) + 1 == stored.select("digest").distinct().count()
    assert exact_dedup.dedup_batch(index, make_docs([])).count() == 0
    # an index opened again by another session's name knows the same texts
    same = exact_dedup.open_index(spark, index.path, index.buckets)
    assert not exact_dedup.dedup_batch(same, make_docs([(2000, "new")])).first().kept


def test_a_batch_sent_again_gets_the_same_rows(spark, make_docs):
    index = exact_dedup.open_index(spark, buckets=4)
    columns = ["id", "digest", "keep_id", "group_size", "kept"]
    docs = make_docs([(1, "a"), (2, "b"), (3, "A")])
    first = rows_of(exact_dedup.dedup_batch(index, docs, name="one"), *columns)
    assert {r[0] for r in first if r[-1]} == {2, 3}
    # the driver was lost after the append
    assert rows_of(exact_dedup.dedup_batch(index, docs, name="one"), *columns) == first
    assert spark.table(index.table).count() == 2
    again = exact_dedup.dedup_batch(index, docs, name="two").collect()
    assert not any(r.kept for r in again)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ranges_meet_a_filled_index(spark, make_docs, corpus, parts):
    columns = ["digest", "id", "keep_id", "group_size", "kept"]
    whole = exact_dedup.open_index(spark, buckets=4)
    expected = rows_of(exact_dedup.dedup_batch(whole, make_docs(corpus)), *columns)
    index = exact_dedup.open_index(spark, buckets=4)
    got = exact_dedup.dedup_ranges(index, make_docs(corpus), name="all", parts=parts)
    assert rows_of(got, *columns) == expected
    assert rows_of(exact_dedup.dedup_ranges(index, make_docs(corpus), name="all", parts=parts), *columns) == expected
    assert spark.table(index.table).select("batch").distinct().count() == min(parts, 3) or parts == 7
    assert exact_dedup.dedup_ranges(index, make_docs([])).count() == 0


def brute_components(corpus, n, percent):
    sets = []
    for _, text in corpus:
        words = split(text)
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        sets.append(grams or ({tuple(words)} if words else set()))
    parent = list(range(len(corpus)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(corpus)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(corpus):
        root = find(a)
        known = [x for x in (least.get(root), i) if x is not None]
        least[root] = min(known) if known else None
    return in_order((i, len(sets[a]), least[find(a)]) for a, (i, _) in enumerate(corpus))


@pytest.mark.parametrize("n, percent, frequent", [(4, 85, 1 << 16), (5, 80, 8)])
def test_jaccard_join(make_docs, corpus, n, percent, frequent):
    found = jaccard_join.similar_components(make_docs(corpus), n, percent, max_frequent=frequent)
    assert rows_of(found, "id", "n_shingles", "component_id") == brute_components(corpus, n, percent)


def test_jaccard_join_of_chains(make_docs):
    """Neighbours in a chain are linked, its ends are not; the work is done by the last phase too."""
    words = [f"w{i}" for i in range(220)]
    rows = [(100 - i, " ".join(words[4 * i : 4 * i + 100])) for i in range(30)] + [(7, "alone here are words")]
    found = jaccard_join.similar_components(make_docs(rows), 4, 85)
    assert rows_of(found, "id", "n_shingles", "component_id") == brute_components(rows, 4, 85)
    assert jaccard_join.similar_components(make_docs([])).count() == 0


def test_jaccard_join_meets_a_pair_once(spark):
    """Groups with many shingles in common are one row, wherever the common ones stand among their own."""
    bits = {f"{kind}_{s}": 0 for kind in ("and", "or") for s in jaccard_join.BITS}
    row = lambda cluster, token: {"token": token, "cluster": cluster, "n": 400, "pos": 0, "low": cluster, "high": cluster} | bits
    far = 10 * jaccard_join.EARLIER
    rows = [row(c, t) for c in range(5) for t in range(100)]  # the same hundred
    rows += [row(5, t) for t in range(1000, 1000 + far)] + [row(6, t) for t in range(1000 + far - 1, 1000 + 2 * far)]  # one
    rows += [row(7, t) for t in range(2000, 2040)] + [row(8, t) for t in range(2040, 2080)]  # none
    types = ["token bigint", "cluster bigint", "n int", "pos int", "low bigint", "high bigint", *(f"{b} bigint" for b in bits)]
    entries = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(types))
    met = sorted(tuple(r) for r in jaccard_join.meetings(entries, 85).collect())
    assert met == [(a, b) for a in range(5) for b in range(a + 1, 5)] + [(5, 6)]


def brute_repeats(corpus, window):
    least = {}
    big = float("inf")
    docs = [(big if i is None else i, split(text, lower=False)) for i, text in corpus]
    for i, words in docs:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            least[key] = min(least.get(key, big), i)
    out = []
    for (i, _), (own, words) in zip(corpus, docs, strict=True):
        gone = set()
        for s in range(len(words) - window + 1):
            if least[tuple(words[s : s + window])] < own:
                gone |= set(range(s, s + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return in_order(out)


@pytest.mark.parametrize("window", [13, 9])
def test_recompression(make_docs, corpus, window):
    found = recompression.remove_repeats(make_docs(corpus), window)
    assert rows_of(found, "id", "n_words", "n_removed", "kept_sha256") == brute_repeats(corpus, window)


def test_recompression_of_periods(make_docs):
    """Runs and periods have few certain symbols; windows still meet their equals."""
    rows = [(i, " ".join((["a", "b", "c"][: 1 + i % 3]) * (8 + i))) for i in range(1, 16)]
    rows += [(20 + i, " ".join(["x"] * i + ["y"] * (30 - i))) for i in range(12)]
    found = recompression.remove_repeats(make_docs(rows))
    assert rows_of(found, "id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows, 13)
    assert recompression.remove_repeats(make_docs([])).count() == 0
