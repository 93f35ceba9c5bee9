"""Fitted operators: language model against brute force, classifiers on held-out labels, rates."""

from __future__ import annotations

import collections
import math
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import katz, linear, mixing, quality, queries

SF_DIR = "/root/testdata/sf0.01"


def brute_katz(corpus, epsilon, folds=7, fold=2):
    rows = []
    for i, text in corpus:
        held = i is not None and zlib.crc32(str(i).encode()) % folds == fold
        rows.append((i, held, [*(text or "").encode().lower().split(), None]))
    count = collections.Counter(w for _, held, t in rows if not held for w in t)
    n, v = sum(count.values()), len(count)
    own = {w for w, c in count.items() if c >= max(1, epsilon * n)}
    kind = lambda w: w if w in own else "<other>"
    pairs = collections.Counter()
    for _, held, t in rows:
        if not held:
            pairs.update(zip(["<begin>", *map(kind, t[:-1])], map(kind, t), strict=True))
    d = katz.discounts(collections.Counter(pairs.values()))
    rest = sum(c for w, c in count.items() if w not in own)
    p1 = {w: count[w] / (n + 1) for w in own} | {"<other>": (rest + 1) / (n + 1)}
    model = collections.defaultdict(dict)
    for (h, w), c in pairs.items():
        model[h][w] = c
    alpha = {}
    for h, ws in model.items():
        total = sum(ws.values())
        p = {w: (d[c] if c <= 5 else 1) * c / total for w, c in ws.items()}
        mass = sum(p.values())
        if len(ws) == len(p1):
            p, alpha[h] = {w: x / mass for w, x in p.items()}, 1.0
        else:
            if mass >= 1 - 1e-12:
                p = {w: x * total / (total + 1) for w, x in p.items()}
            alpha[h] = (1 - sum(p.values())) / (1 - sum(p1[w] for w in ws))
        model[h] = p
        assert abs(sum(p.values()) + sum(alpha[h] * x for w, x in p1.items() if w not in p) * (len(ws) < len(p1)) - 1) < 1e-9
    out = []
    for i, held, t in rows:
        score, h = 0.0, "<begin>"
        for w in t:
            k = kind(w)
            p = model.get(h, {}).get(k) or alpha.get(h, 1.0) * p1.get(k, 0)
            if k == "<other>":
                p *= (count[w] + 1) / (rest + v - len(own) + 1)
            score, h = score + math.log10(p), k
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        out.append((i, held, len(t), sum(count[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("epsilon, cached", [(1e-5, 1 << 17), (5e-3, 20)])
def test_katz(make_docs, corpus, epsilon, cached):
    got = katz.held_out_scores(make_docs(corpus), epsilon=epsilon, cached=cached).collect()
    columns = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    found = sorted((tuple(r[c] for c in columns) for r in got), key=order)
    expected = sorted(brute_katz(corpus, epsilon), key=order)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in expected], rtol=1e-9)


def test_katz_keeps_bigrams_of_rare_words(make_docs, corpus):
    # of half a million tokens, words seen three times are below a share of 1e-5
    train = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [*corpus, (train[0], "fill " * 500_000), (train[1], "rarest pair"), (train[2], "rarest pair"), (train[3], "pair rarest")]
    found = {r.id: r.score for r in katz.held_out_scores(make_docs(rows), cached=20).collect()}
    expected = {r[0]: r[6] for r in brute_katz(rows, 0.0)}
    ids = [i for i, n in collections.Counter(r[0] for r in rows).items() if n == 1]
    assert np.allclose([found[i] for i in ids], [expected[i] for i in ids], rtol=1e-9)
    assert found[train[1]] > found[train[3]]


def test_katz_without_training_or_rows(make_docs):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = katz.held_out_scores(make_docs([(held, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)
    assert katz.held_out_scores(make_docs([])).count() == 0


def test_discounts_stay_proper():
    for counts in ({}, {1: 5}, {1: 10, 2: 9, 3: 9}, {1: 1000, 2: 300, 3: 150, 4: 90, 5: 60, 6: 40}):
        d = katz.discounts(counts)
        assert all(0 < x < 1 for x in d[1:])


def test_label_model_recovers_accuracies():
    draw = np.random.default_rng(5)
    good = draw.random(20000) < 0.85
    k = 8
    faults = np.array([0.5, 0.3, 0.4, 0.2, 0.6, 0.1])
    votes = np.full((len(good), k), quality.NONE)
    for j, share in enumerate(faults):
        votes[np.where(good, draw.random(len(good)) < 0.005, draw.random(len(good)) < share), j] = quality.BAD
    for j in (6, 7):
        votes[np.where(good, draw.random(len(good)) < 0.9, draw.random(len(good)) < 0.15), j] = quality.GOOD
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - good.mean()) < 0.01
    assert np.abs(model.chance[:6, quality.BAD, quality.BAD] - faults).max() < 0.05
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.97


def plain_fit(doc, feature, value, target, features, steps, rate=0.05, l2=1e-4):
    n, classes = target.shape
    x = np.zeros((n, features))
    np.add.at(x, (doc, feature), value)
    bias, w = np.log(np.maximum(target.mean(axis=0), 1e-6)), np.zeros((features, classes))
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias)]
    for t in range(1, steps + 1):
        error = (linear.softmax(x @ w + bias) - target) / n
        for i, (p, g) in enumerate(((w, x.T @ error + l2 * w / n * 100), (bias, error.sum(axis=0)))):
            m, v = moment[2 * i], moment[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w, bias


@pytest.mark.parametrize("block", [1, 7, 1 << 17])
def test_blocks_change_no_weights(monkeypatch, block):
    draw = np.random.default_rng(8)
    doc = np.sort(draw.integers(0, 30, 400)).astype(np.int32)  # some documents have no places
    feature, value = draw.integers(0, 50, 400).astype(np.int32) * 2, draw.random(400).astype(np.float32)
    target = np.eye(3)[draw.integers(0, 3, 31)]
    monkeypatch.setattr(linear, "BLOCK", block)
    model = linear.fit(doc, feature, value, target, 100, steps=40)
    w, bias = plain_fit(doc, feature, value, target, 100, 40)
    assert np.allclose(model.weights, w, atol=1e-6) and np.allclose(model.bias, bias)


def test_a_fit_holds_few_bytes_a_place():
    draw = np.random.default_rng(9)
    n = 1_000_000
    doc, feature = np.sort(draw.integers(0, 4000, n)).astype(np.int32), draw.integers(0, 5000, n).astype(np.int32)
    value, target = np.ones(n, np.float32), np.eye(3)[draw.integers(0, 3, 4000)]
    tracemalloc.start()
    linear.fit(doc, feature, value, target, 5000, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28 * n


def test_quality_on_labels(spark):
    judged = queries.op3_quality_classifier(spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    both = judged.join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in both}
    assert n.get((1, False), 0) <= 0.02 * n[1, True]
    assert n.get((0, True), 0) <= 0.1 * n[0, False]
    assert judged.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_quality_of_odd_texts(make_docs, corpus):
    judged = quality.classify(make_docs([*corpus, (300, None), (300, None)]))
    assert judged.columns.count("score") == 1 and judged.count() == len(corpus) + 2
    empty = {round(r.score, 9) for r in judged.filter("text is null or text = ''").collect()}
    assert len(empty) == 1
    assert quality.classify(make_docs([])).count() == 0


def test_a_hot_text_is_one_row_of_the_sample(spark, make_docs, corpus):
    """A text that half of all rows have is drawn once, with its copies as weight, wherever it lies."""
    rows = [*corpus, *[(1000 + i, corpus[20][1]) for i in range(len(corpus))]]
    one = quality.train(make_docs(rows), sample=40)
    two = quality.train(make_docs(rows[::-1]).repartition(5), sample=40)
    assert np.allclose(one.scorer.bias, two.scorer.bias) and np.allclose(one.scorer.weights, two.scorer.weights, atol=1e-5)
    assert np.allclose(one.labels.chance, two.labels.chance)


def test_names_that_differ_in_case(spark, corpus):
    rows = [(i, t, 9.0, "own") for i, t in corpus]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score double, KEPT string")
    judged = quality.classify(docs)
    assert sorted(c.lower() for c in judged.columns) == ["doc_id", "kept", "posterior", "score", "text"] and judged.count() == len(rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and all(r.Score == 9.0 and r.KEPT == "own" for r in kept.collect())
    assert kept.count() == judged.filter("kept").count()
    rated = spark.createDataFrame([(i, t, 1.0, 2) for i, t in corpus], "doc_id long, text string, Rate double, COPIES int")
    labels = spark.createDataFrame([(10, 0), (11, 1)], "doc_id long, domain int")
    mixed = mixing.mix(rated, labels, (0.5, 0.5))
    assert [c.lower() for c in mixed.columns].count("rate") == 1 and mixed.count() == len(rows)


def test_rates_match_targets(spark):
    mixed = queries.op10_target_mixing(spark, SF_DIR).cache()
    sums = mixed.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("rate") * F.col("n_tokens") * F.col("posterior")[k]).alias(f"s{k}") for k in range(3))).first()
    assert all(abs(sums[f"s{k}"] / sums["n"] - w) < 1e-3 for k, w in enumerate(queries.TARGETS))
    assert mixed.filter("rate < 0 or copies < floor(rate) or copies > rate + 1").count() == 0
    assert mixed.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    labelled = queries.labelled_domains(spark, SF_DIR)
    best = F.expr("array_position(posterior, array_max(posterior)) - 1")
    assert mixed.join(labelled, "doc_id").filter(best != F.col("domain")).count() <= 8
    mixed.unpersist()


def test_rates_against_plain_projected_gradient(spark):
    draw = np.random.default_rng(3)
    p = draw.dirichlet([0.3, 0.3, 0.3], 200)
    n = draw.integers(1, 400, 200)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
    weights = (0.7, 0.3, 0.0)
    steps, reached, target = mixing.fit_rates(members, weights)
    rate = mixing.rates_after(p, steps)
    assert np.allclose(reached, (rate * n) @ p / n.sum())
    # no nonnegative rates do better than a long plain descent
    best = np.ones(200)
    for _ in range(20000):
        best = np.maximum(0, best - 0.5 * p @ ((best * n) @ p / n.sum() - target))
    loss = lambda r: np.square((r * n) @ p / n.sum() - target).sum()
    assert loss(rate) <= loss(best) + 1e-6


def rates_for(spark, p, n, weights):
    rows = [(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)]
    return mixing.fit_rates(spark.createDataFrame(rows, "n_tokens long, posterior array<double>"), weights)


def test_rates_reach_a_rare_domain(spark):
    p = np.zeros((20000, 3))
    p[:, 1] = 1.0
    p[:2] = [1.0, 0.0, 0.0]  # one in ten thousand tokens, to become one in twenty
    p[2:5000] = [0.0, 0.3, 0.7]
    steps, reached, target = rates_for(spark, p, np.full(20000, 100), (0.05, 0.65, 0.3))
    assert np.abs(reached - target).max() < 1e-6
    assert np.allclose(mixing.rates_after(p, steps)[:2], 500, rtol=1e-4)


def test_rates_with_soft_posteriors(spark):
    p = np.random.default_rng(4).dirichlet([2.0, 2.0, 2.0], 3000)
    _, reached, target = rates_for(spark, p, np.full(3000, 7), (0.2, 0.25, 0.55))
    assert np.abs(reached - target).max() < 1e-6


def test_a_missed_target_is_told(spark, caplog):
    p = np.array([[0.0, 1.0, 0.0], [0.0, 0.0, 1.0]] * 50)
    steps, reached, _ = rates_for(spark, p, np.full(100, 10), (0.2, 0.2, 0.6))
    assert np.allclose(reached, [0.0, 0.2, 0.6], atol=1e-6)
    assert [r.levelname for r in caplog.records if r.name == mixing.__name__] == ["WARNING"]
    assert mixing.rates_after(p, steps).max() < 2


def test_mixing_of_odd_tables(spark, make_docs, corpus):
    labels = spark.createDataFrame([(10, 0), (10, 1), (11, None), (None, 1), (999, 1)], "doc_id long, domain int")
    mixed = mixing.mix(make_docs(corpus), labels, (0.5, 0.5)).collect()
    assert len(mixed) == len(corpus) and all(abs(sum(r.posterior) - 1) < 1e-9 for r in mixed)
    none = mixing.mix(make_docs(corpus), labels.limit(0), (0.5, 0.5)).collect()
    assert {tuple(round(x, 9) for x in r.posterior) for r in none} == {(0.5, 0.5)}
    assert mixing.mix(make_docs([]), labels, (1.0,)).count() == 0
