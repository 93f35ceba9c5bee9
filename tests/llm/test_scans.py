"""License scan and benchmark decontamination against brute force."""

from __future__ import annotations

import hashlib
import re

import pytest

from assayer.llm import decontaminate, license_scan

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").encode().lower())


def brute_scan(text, rules, base):
    words = [w.decode() for w in words_of(text)]
    norm = " " + "".join(w + " " for w in words)
    found = []
    for k, rule in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", norm):
            start = norm[: m.start()].count(" ") - 1
            found.append((start, start + m.group().count(" ") + 1, rule.priority, k))
    rank = lambda d: (d[0], -d[1], -d[2], d[3])
    kept = []
    for d in found:
        covered = any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and rank(e) < rank(d) for e in found)
        if not covered or d[3] < base:
            kept.append(d)
    places = [d[0] for d in kept if d[3] < base]
    labels = sorted({rules[d[3]].label for d in kept})
    doubt = 1.0
    for label in labels:
        doubt *= min(1 - license_scan.WEIGHTS[d[2]] for d in kept if rules[d[3]].label == label)
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted({rules[d[3]].label for d in kept if d[3] < base})), ",".join(labels), round(1 - doubt, 9),
    )


LICENSED = [
    (1, None), (2, ""), (3, "plain words"), (4, "Licensed under the Apache License, Version 2.0."),
    (5, "GNU General Public License v3 or any later version; general public license. All Rights Reserved!"),
    (6, "cc-by cc by cc-by-sa 4.0 Creative Commons Attribution-ShareAlike 4.0 CC BY cc bye accc by"),
    (7, "SPDX-License-Identifier: MPL-2.0 only; the MIT license; Copyright (c) 2020 x"),
    (8, "all rights reserved " * 700), (8, "all rights reserved " * 700), (None, "all rights reserved"),
    (9, "GENERAL\x00PUBLIC\nLICENSE, ÄLL rights reserved Permission is hereby granted, free of charge, to any person obtaining a copy"),
    (10, "Redistribution and use in source and binary forms, with or without modification. BSD 3-clause"),
]


SENTENCES = [
    (20, "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    (21, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    (22, "The Software shall be used for Good, not Evil. Copyright 2002"), (23, "Server Side Public License, version 1"),
    (24, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    (25, "Open Government Licence v3.0 contains public sector information licensed under"), (26, "mulan psl v2 licence"),
]


def test_sentences_of_licences(make_docs):
    rules = license_scan.signatures()
    got = {r.id: (r.labels, round(r.score, 9)) for r in license_scan.scan(make_docs(SENTENCES)).collect()}
    assert got == {i: brute_scan(t, rules, 3)[-2:] for i, t in SENTENCES}
    assert "apache-2.0" in got[20][0] and "bsd" in got[21][0] and "json" in got[22][0] and "sspl" in got[23][0] and "ogl" in got[25][0]
    written = len(license_scan._SENTENCES) + len(license_scan._PHRASES)
    assert written > 190 and len({r.pattern for r in rules}) > 500


def test_license_keywords_are_looked_for_once():
    """Every rule stands once, below its keyword; every keyword once, below a gate word that it contains."""
    rules = license_scan.signatures()
    gates = license_scan.rules_by_gate(rules)
    below = [(gate, keyword, i) for gate, keywords in gates.items() for keyword, own in keywords.items() for i in own]
    assert sorted(i for _, _, i in below) == list(range(len(rules)))
    assert all(rules[i].keyword == keyword and gate in keyword for gate, keyword, i in below)
    assert sum(map(len, gates.values())) == len({r.keyword for r in rules}) and list(gates) == license_scan.gate_words(rules)


def test_license_scan(make_docs):
    rules = license_scan.signatures()
    assert 200 < len(rules) and all(r.keyword for r in rules)
    got = license_scan.scan(make_docs(LICENSED)).collect()
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
    found = sorted(((r.id is None, r.id or 0), tuple(r[c] for c in columns) + (round(r.score, 9),)) for r in got)
    assert found == sorted(((i is None, i or 0), brute_scan(t, rules, 3)) for i, t in LICENSED)
    assert license_scan.scan(make_docs([])).count() == 0


def test_notices_of_owners(make_docs):
    texts = [(1, "This file is PROPRIETARY and Confidential."), (2, "Unauthorized copying is prohibited."), (3, "copying")]
    got = {r.id: (r.labels, round(r.score, 9)) for r in license_scan.scan(make_docs(texts)).collect()}
    assert got == {1: ("proprietary", 0.8), 2: ("proprietary", 0.8), 3: ("", 0.0)}
    labels = {r.label for r in license_scan.signatures()}
    assert all(label in labels for label, *_ in license_scan._PHRASES)


def test_a_signature_needs_a_keyword():
    with pytest.raises(ValueError):
        license_scan.Signature("x", "some words", "", license_scan.NAMED)


def test_gate_loses_no_rule():
    rules = license_scan.signatures()
    gate = license_scan.gate_words(rules)
    assert all(any(word in rule.keyword for word in gate) for rule in rules)


def brute_contamination(docs, items, window=13):
    out = []
    split = [(i, words_of(t)) for i, t in items]
    for i, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for item, own in split:
            size = min(window, len(own))
            for s in range(len(own) - size + 1) if own else ():
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == own[s : s + size]:
                        hit |= set(range(p, p + size))
                        ids.add(item)
        named = sorted(str(x) for x in ids if x is not None)
        bad = bool(hit) and 20 * len(hit) >= len(words)
        out.append((i, len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bad))
    return sorted(out, key=lambda r: (r[0] is None, r))


def test_contamination(spark, make_docs, corpus):
    item = "The quick brown fox, jumps over the lazy dog; and then it sleeps near a river bank until dawn."
    long = " ".join(f"t{k}" for k in range(40))
    docs = corpus[:14] + [
        (200, f"before {item.upper()} after"), (201, " ".join(item.split()[2:16])), (202, " ".join(item.split()[2:14])),
        (203, "filler " * 600 + item), (204, "yes no"), (205, "no yes no yes no"), (206, long + " " + long),
        (207, " ".join(long.split()[:20] + ["gap"] + long.split()[20:])), (207, long), (None, item), (208, "yes-no"),
    ]
    items = [(1, item), (10, "Yes, no"), (2, long), (3, None), (4, ""), (5, "..."), (None, "filler filler filler"), (2, long), (7, "never seen words at all")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontaminate.contamination(make_docs(docs), bench).collect()
    assert sorted((tuple(r[c] for c in columns) for r in got), key=lambda r: (r[0] is None, r)) == brute_contamination(docs, items)
    clean = decontaminate.contamination(make_docs(docs), bench.limit(0))
    assert clean.filter("contaminated or n_hit > 0").count() == 0 and clean.count() == len(docs)
    assert decontaminate.contamination(make_docs([]), bench).count() == 0


def test_index_answers_phrases_and_proximity(spark, make_docs):
    index = decontaminate.build_index(make_docs([(1, "a b c d e x a b c"), (2, "c far b and a lot of words then a c b"), (3, None)]))
    bench = spark.createDataFrame([(5, "b c d")], "item_id long, text string")
    found = decontaminate.phrase_matches(index, bench, window=2).collect()
    assert {(r.item_id, r.doc_id, r.item_word, r.doc_word, r.size) for r in found} == {("5", 1, 0, 1, 3), ("5", 1, 0, 7, 2)}
    near = spark.createDataFrame([(6, "a b c")], "item_id long, text string")
    found = {(r.doc_id, r.doc_word) for r in decontaminate.proximity_matches(index, near, 2).collect()}
    assert all(doc in (1, 2) for doc, _ in found) and {doc for doc, _ in found} == {1, 2}


@pytest.mark.parametrize("within", [1, 4, 30])
def test_proximity_against_brute_force(spark, make_docs, within):
    import random

    draw = random.Random(13)
    vocabulary = [f"v{i}" for i in range(12)]
    docs = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 60)))) for i in range(40)]
    docs += [(100, "r1 v1 v2"), (101, "v1 x v2 x r1"), (102, "r1 r1 v2 v1 r1"), (103, None)]
    docs += [(200 + i, f"r2 {' x' * i} v3") for i in range(8)]
    items = [(1, "r1 v1 v2"), (2, "v3 r2"), (3, "r1"), (4, "r1 missing"), (5, "v3 v3 r2 r2")]
    index = decontaminate.build_index(make_docs(docs))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(int(r.item_id), r.doc_id, r.doc_word) for r in decontaminate.proximity_matches(index, bench, within).collect()}
    split = {i: [w.decode() for w in words_of(t)] for i, t in docs}
    expected = set()
    for item, text in items:
        wanted = set(text.split())
        rarest = next(w for w in ("r1", "r2") if w in wanted)  # each occurs less often than any other word
        if "missing" in wanted:
            continue
        for i, words in split.items():
            for at, word in enumerate(words):
                if word == rarest and wanted <= set(words[max(0, at - within) : at + within + 1]):
                    expected.add((item, i, at))
    assert got == expected and got
