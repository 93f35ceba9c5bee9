"""Line deduplication, ranked search and collocations against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from assayer.llm import collocations, line_dedup, ranked_search

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ODD = [(1, None), (2, ""), (3, "\n\n"), (4, " \t\n\x0b\x0c\r"), (None, "a\nB "), (None, None)]


def lined_corpus():
    draw = random.Random(3)
    pool = [f"Line {k} of the pool" for k in range(25)] + ["ÄÖ", "äÖ", "x"]
    rows = list(ODD)
    for i in range(10, 70):
        lines = [draw.choice(["", "  ", "\t"]) + draw.choice(pool).swapcase() + draw.choice(["", "\r", " "]) for _ in range(draw.randint(1, 9))]
        rows.append((i, "\n".join([*lines, f"own line {i}", *(["HOT line"] if i % 3 else []), ""])))
    rows += [(20, rows[16][1]), (20, rows[16][1]), (20, "hot line\nanother text of an id that repeats")]
    rows += [(99, "hot line\n" * 500 + "end")]
    return rows


def brute_lines(rows, least, min_chars=1, keep="none"):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    docs = collections.defaultdict(set)
    for row in rows:
        for line in (row[1] or "").split("\n"):
            docs[key(line)].add((row[0], row[1] or ""))
    often = {k for k, of in docs.items() if len(k) >= min_chars and len(of) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        out.append((i, text or "", [key(x) in often for x in lines]))
    return out


def by_text(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("least", [1, 2, 10, 40])
@pytest.mark.parametrize("partitions", [1, 7])
def test_frequent_lines_go(spark, make_docs, least, partitions):
    rows = lined_corpus()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = make_docs(rows)
        got = line_dedup.cut(docs, line_dedup.keep_bitmaps(docs, least=least)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = [
        (i, len(gone), sum(gone), "\n".join(x for x, g in zip(text.split("\n"), gone, strict=True) if not g).encode())
        for i, text, gone in brute_lines(rows, least)
    ]
    assert by_text((r.id, r.n_lines, r.n_dropped, bytes(r.kept)) for r in got) == by_text(expected)


def test_one_key_over_many_partitions(spark, make_docs):
    """The hot key spans partitions, each with fewer documents of it than are asked for."""
    rows = [(i, f"same\nown {i}\nrare {i // 2}") for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = make_docs(rows)
        found = line_dedup.keep_bitmaps(docs, least=100)
        got = {(r.n_lines, r.n_dropped) for r in found.collect()}
        assert found.count() == 400 and got == {(3, 1)}
        first = line_dedup.cut(docs, line_dedup.keep_bitmaps(docs, least=100, keep="first")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.id for r in first if bytes(r.kept).startswith(b"same")] == [0]


def test_first_lines_stay(spark, make_docs):
    rows = [(2, "b\nA\nb"), (1, "c\n a "), (3, "a\nc\nd"), (3, "a\nc\nd")]
    docs = make_docs(rows)
    got = line_dedup.cut(docs, line_dedup.keep_bitmaps(docs, least=1, keep="first")).collect()
    assert sorted((r.id, bytes(r.kept)) for r in got) == [(1, b"c\n a "), (2, b"b"), (3, b"d"), (3, b"d")]
    assert line_dedup.keep_bitmaps(make_docs([])).count() == 0
    assert line_dedup.cut(make_docs([]), line_dedup.keep_bitmaps(make_docs([]))).count() == 0
    with pytest.raises(ValueError):
        line_dedup.keep_bitmaps(docs, keep="last")


def test_bitmaps_restore_texts():
    import zlib

    import numpy as np

    text = "a\n\nß\nd".encode()
    bits = zlib.compress(np.packbits(np.array([1, 0, 1, 0], bool)).tobytes())
    assert line_dedup.lines_kept(text, bits) == "a\nß".encode()


TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items, top):
    docs = [collections.Counter(TERM.findall((t or "").translate(LOWER).encode())) for _, t in rows]
    sizes = [sum(d.values()) for d in docs]
    n_texts, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for d in docs for t in d)
    out = []
    for item, text in items:
        scored = []
        for k, (doc, size) in enumerate(zip(docs, sizes, strict=True)):
            score = 0
            for term in set(TERM.findall((text or "").translate(LOWER).encode())) & set(doc):
                w = math.floor(1000 * math.log((2 * n_texts + 2) / (2 * df[term] + 1)))
                m = 10 + 90 * size * n_texts // n_terms
                score += w * (10**9 * doc[term] // (1000 * doc[term] + 8 * m))
            if score > 0:
                scored.append((-score, rows[k][0] is None, rows[k][0] or 0, k))
        out += [(item, at + 1, rows[k][0], -s) for at, (s, _, _, k) in enumerate(sorted(scored)[:top])]
    return out


def searched_corpus():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 4))) for _ in range(300)]
    rows = list(ODD)
    for i in range(10, 260):
        size = draw.choice([1, 4, 20, 80])
        rows.append((i, " ".join([*(draw.choice(words) for _ in range(size)), *["the", "of"] * draw.randint(0, 3)])))
    rows += [(300, rows[20][1]), (300, rows[20][1]), (None, rows[20][1]), (301, "Ünï-cöde ÜNÏ"), (302, "word " * 3000)]
    items = [(1, " ".join(draw.choice(words) for _ in range(25)) + " the of the"), (2, None), (3, ""), (4, "..."), (5, "the"),
             (6, "nowhere seen"), (7, "ünï cöde the"), (None, "the of word"), (1, rows[20][1]), (8, rows[25][1]), (9, "of " + rows[40][1])]
    return rows, items


@pytest.mark.parametrize("top", [1, 10, 1000])
def test_search(spark, make_docs, top):
    rows, items = searched_corpus()
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, score string")
    got = [(r.query_id, r["rank"], r.id, r.score) for r in ranked_search.search(make_docs(rows), bench, top).collect()]
    assert by_text(got) == by_text(brute_search(rows, items, top))


def test_search_without_rows(spark, make_docs):
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(make_docs([]), bench).count() == 0
    assert ranked_search.search(make_docs([(1, "a b"), (2, "b")]), bench.limit(0)).count() == 0
    assert ranked_search.search(make_docs([(1, "b"), (2, None)]), bench).count() == 0


def test_queries_stop_making_accumulators(spark, make_docs):
    """A query whose rare terms decide never meets the documents that only share its common words."""
    rows = [(i, "common words fill this text " + ("rare unusual" if i < 3 else f"n{i}")) for i in range(400)]
    bench = spark.createDataFrame([(1, "rare unusual common")], "item_id long, text string")
    docs = make_docs(rows)
    terms = ranked_search.query_terms(bench.selectExpr("item_id as q", "cast(text as binary) as text"))
    asked = spark.sparkContext.broadcast(ranked_search.bitmap_of(terms.select("term"), "term"))
    stored = ranked_search.stored_terms(docs.selectExpr("doc_id as row", "doc_id as id", "cast(text as binary) as text"), asked)
    found = ranked_search.postings(stored, 400, 400 * 7)
    weighted = ranked_search.weighted_terms(terms, found, 400)
    left = ranked_search.survivors(stored, weighted, 400, 400 * 7, 3).collect()
    assert {r.row for r in left} == {0, 1, 2}
    best = ranked_search.search(docs, bench, 3).collect()
    assert [(r["rank"], r.id, r.score) for r in sorted(best, key=lambda r: r["rank"])] == [r[1:] for r in brute_search(rows, [(1, "rare unusual common")], 3)]


def brute_collocations(rows, least, top, longest=5):
    total, counts = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for s in range(len(words) - k + 1):
                    counts[lang, tuple(words[s : s + k])] += 1
    often = {k: n for k, n in counts.items() if n >= least and len(k[1]) > 1}
    inside = lambda short, long: any(long[s : s + len(short)] == short for s in range(len(long) - len(short) + 1))
    found = collections.defaultdict(list)
    for (lang, g), a in often.items():
        if any(x != g and len(x) > len(g) and n >= a and y == lang and inside(g, x) for (y, x), n in often.items()):
            continue
        cuts = []
        for k in range(1, len(g)):
            left, right = counts[lang, g[:k]], counts[lang, g[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return [
        (lang, at + 1, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, rows in found.items() for at, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top])
    ]


@pytest.mark.parametrize(("least", "top"), [(2, 10_000), (8, 10_000), (8, 5), (10_000, 5)])
def test_collocations(spark, least, top):
    draw = random.Random(11)
    words = ["a", "of", "the", "Ünd", "x\x00y", "B", "é", "zz", "-", "word"]
    rows = [(1, None, "en"), (2, "", None), (3, "...", "xx"), (4, "one", "yy")]
    for i in range(10, 120):
        text = draw.choice([" ", "\t", "  "]).join(draw.choice(words) + draw.choice(["", "", "", ",", "\n", ". "]) for _ in range(draw.randint(1, 60)))
        rows.append((i, text, draw.choice(["en", "en", "de", None, "und", ""])))
    rows += [(200, "always these five words together\n" * 12 + "one", "de")] * 2 + [(201, "again " * 300, "de")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, lang string, key string, n int")
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = collocations.collocations(docs, least=least, top=top).collect()
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(brute_collocations(rows, least, top))
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    """The products are made in decimals."""
    big = spark.createDataFrame([(10**12, 10**13, 10**9, 10**9)], "a long, total long, l long, r long")
    above = collocations._digits("a") * collocations._digits("total")
    got = big.select(above.alias("above"), (collocations._digits("l") * collocations._digits("r")).alias("below"))
    assert got.selectExpr("above div below as x").first().x == 10**7


def test_digest_of_kept_text(spark, make_docs):
    from assayer.llm import queries

    assert {"op11_collocations", "op12_line_dedup", "op13_ranked_search"} <= set(queries.QUERIES) & set(queries.ORACLES)
    docs = make_docs([(i, "same\nown") for i in range(3)] + [(9, "x")])
    rows = line_dedup.cut(docs, line_dedup.keep_bitmaps(docs, least=3)).selectExpr("id", "sha2(kept, 256) as s").collect()
    assert {r.id: r.s for r in rows} == {i: hashlib.sha256(b"" if i < 9 else b"x").hexdigest() for i in (0, 1, 2, 9)}


def test_windows_carry_only_what_no_shorter_order_counts(spark):
    """Words, pairs and triples are counted before windows are; no task gives them once more."""
    rows = [("one two three. " * 50, "en"), ("one two. one", "en"), ("a b c d e f " * 30, "en"), ("a b c d", "de")] * 3
    texts = spark.createDataFrame(rows, "text string, lang string").select(F.col("text").cast("binary"), "lang")
    words = collocations.frequent_words(texts).filter("n >= 5")
    common, linked = spark.sparkContext.broadcast(collocations.bitmap_of(words, "name")), []
    known = [words.select("name", F.array("name").alias("key"), "n")]
    for _ in range(collocations.PRUNED):
        known.append(collocations.spelled_grams(collocations.frequent_grams(texts, common, linked, 5), known[-1]))
        linked.append(spark.sparkContext.broadcast(collocations.bitmap_of(known[-1], "name")))
    found = collocations.windows(texts, common, linked)
    assert found.count() > 0 and found.filter("w4 = 0").count() == 0
    assert found.agg(F.sum("n")).first()[0] == 3 * (6 * 30 - 3)
    counts = collocations.phrase_counts(found, known, 5)
    sizes = {r["size"]: r["m"] for r in counts.groupBy("size").agg(F.count("*").alias("m")).collect()}
    assert sizes == {1: 9, 2: 8, 3: 7, 4: 6, 5: 6}
