"""Coverage, contents, chunks, retrieval, answers and stored tables."""

from __future__ import annotations

import base64
import json
import math

import pytest
from pyspark.sql import functions as F

from assayer import rules
from assayer.operators import KEY, chunks, quality, retrieval, verdicts
from assayer.plans import scan
from assayer.sources import answers, tables, tree

TREE = "repo string, commit_sha string, ord long, path string, type string, sha string, size long, truncated boolean"
RAW = "repo string, commit_sha string, path string, http_status int, encoding string, size long, content_b64 string"


def b64(data) -> str:
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def test_coverage_counts_every_tracked_file_once(spark):
    entries = [
        ("ok.py", "blob", 10, (200, "base64", 10, b64("x = 1\n"))),
        ("empty.py", "blob", 0, (200, "base64", 0, "")),
        ("none.py", "blob", 10, (200, "none", 10, "")),
        ("gone.py", "blob", 10, (404, None, None, None)),
        ("odd.py", "blob", 10, (200, "base64", 5, "")),
        ("bad.py", "blob", 10, (200, "base64", 5, "!")),
        ("long.py", "blob", 10, (200, "base64", 5, b64("\n" * 2000))),
        ("mini.js", "blob", 10, (200, "base64", 5, b64("x" * 5001))),
        ("logo.png", "blob", 10, None),
        ("dist/a.js", "blob", 10, None),
        ("big.py", "blob", 100_001, None),
        ("src", "tree", None, None),
        ("capped.py", "blob", 10, (200, "base64", 10, b64("late"))),
    ]
    listing = spark.createDataFrame(
        [("r", "c", i, p, t, "s", size, False) for i, (p, t, size, _) in enumerate(entries)], TREE
    )
    raw = spark.createDataFrame([("r", "c", p, *pay) for p, _, _, pay in entries if pay], RAW)
    done = scan.prepare_files(listing, raw, max_files=8)
    cov = done.coverage.first()
    assert (cov["tracked_files"], cov["eligible_files"], cov["fetched_files"], cov["skipped"]) == (12, 8, 2, 6)
    assert cov["excluded"] == {
        "capped_over_limit": 1, "excluded_by_extension": 1, "excluded_by_path": 1,
        "skipped_too_large": 1, "skipped_too_many_lines": 1, "skipped_minified": 1,
    }
    assert cov["fetch_failures"] == {
        "fetch_content_unavailable": 1, "fetch_exception": 1, "fetch_http_error": 1, "fetch_unexpected_payload": 1,
    }
    assert cov["fetched_detail"] == {"empty_files": 1}
    assert sum(cov["excluded"].values()) + sum(cov["fetch_failures"].values()) + cov["fetched_files"] == 12
    assert {r["path"] for r in done.files.collect()} == {"ok.py", "empty.py"}


def test_cap_is_per_repository_and_in_tree_order(spark):
    rows = [("r", "c", 1000 - i, f"f{i}.py", 1) for i in range(505)] + [("q", "c", i, f"f{i}.py", 1) for i in range(500)]
    from assayer.operators.coverage import cap_cutoffs, cap_files

    eligible = spark.createDataFrame(rows, "repo string, commit_sha string, ord long, path string, size long")
    kept = cap_files(eligible)
    assert {r["repo"]: r["n"] for r in kept.groupBy("repo").agg(F.count("*").alias("n")).collect()} == {"r": 500, "q": 500}
    assert kept.filter("repo = 'r'").agg(F.max("ord")).first()[0] == 1000 - 5
    assert "WindowGroupLimit" in cap_cutoffs(eligible)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().toString()


def test_a_side_over_the_limit_is_not_broadcast(spark):
    from assayer.session import small_side

    wide = spark.range(1000).withColumn("x", F.lit("y"))
    for limit, expected in ((10, False), (100, True)):
        side = small_side(spark.range(0, 1000, 10), limit)
        joined = wide.join(side, "id", "left_semi")
        assert joined.count() == 100
        logical = joined._jdf.queryExecution().analyzed().toString()
        assert ("ResolvedHint" in logical) == expected


def test_bytes_that_are_not_text_are_replaced(spark):
    data = b"a\xffb\xc3"
    raw = spark.createDataFrame([("r", "c", "a.py", 200, "base64", 4, b64(data)[:4] + "\n" + b64(data)[4:])], RAW)
    row = tree.decode_contents(raw).first()
    assert (row["outcome"], row["content"]) == (None, data.decode("utf-8", errors="replace"))


# --- chunks -------------------------------------------------------------------------------


def plain_windows(text: str, size: int, overlap: int) -> list[str]:
    starts = range(0, max(len(text) - overlap - 1, 0) + 1, size - overlap)
    return [w for w in (text[s : s + size] for s in starts) if len(w.strip()) > 50]


def test_chunks_cover_their_file(make_files):
    body = "\n\n".join(f"def f{i}(x):\n    return x + {i}  # " + "word " * (i % 40) for i in range(60))
    files = make_files(
        [("src/a.py", body), ("docs/b.md", "x" * 2600), ("README.md", "old " * 40), ("sub/readme.MD", "## T\n\n" + "new " * 400),
         ("blank.py", " \n "), ("tiny.py", "x = 1"), ("conf.yml", "k: v\n" * 500)]
    )
    found = chunks.chunk_files(files).orderBy("path", "chunk_index").collect()
    by_path = {}
    for r in found:
        by_path.setdefault(r["path"], []).append(r)
    assert set(by_path) == {"src/a.py", "docs/b.md", "sub/readme.MD", "conf.yml"}, "the last README wins"
    limits = {"src/a.py": 1500, "docs/b.md": 1000, "sub/readme.MD": 1000, "conf.yml": 800}
    for path, rows in by_path.items():
        assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
        assert {r["total_chunks"] for r in rows} == {len(rows)}
        assert all(50 < len(r["content"]) <= limits[path] for r in rows)
        assert {r["file_type"] for r in rows} == {"readme" if path == "sub/readme.MD" else "code"}
    text = dict((p, c) for p, c in [("src/a.py", body)])["src/a.py"]
    assert all(r["content"] in text for r in by_path["src/a.py"])
    assert all(word in "".join(r["content"] for r in by_path["src/a.py"]) for word in ("f0(", "f30(", "f59("))
    assert [len(r["content"]) for r in by_path["docs/b.md"]] == [1000, 1000, 1000, 500]


def test_splitter_overlap_and_separators():
    text = "aa bb cc dd ee"
    # " ee" no longer fits beside " cc dd": eight characters hold "cc dd" and its separator
    assert chunks.split_text(text, [" ", ""], 8, 3) == ["aa bb cc", "cc dd", "dd ee"]
    assert chunks.split_text(text, [" ", ""], 9, 3) == ["aa bb cc", "cc dd ee"]
    assert chunks.split_text("abcdefghij", [""], 4, 1) == ["abcd", "defg", "ghij"]
    assert chunks.split_text("one\n\ntwo\n\nthree", ["\n\n", " ", ""], 8, 0) == ["one\n\ntwo", "three"]
    assert chunks.split_text("x", ["\n", ""], 5, 1) == ["x"]


def test_windows(make_files):
    text = "".join(chr(97 + i % 26) for i in range(3333))
    rows = chunks.window_chunks(make_files([("a.py", text), ("b.txt", "y" * 51), ("c.txt", "z" * 50)])).orderBy("path", "chunk_index").collect()
    assert [r["content"] for r in rows if r["path"] == "a.py"] == plain_windows(text, 1500, 200)
    assert [r["path"] for r in rows if r["path"] != "a.py"] == ["b.txt"]


# --- vectors ------------------------------------------------------------------------------


def test_top_k_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.lit("c").alias("collection"), "embedding", "label"
    )
    rows = vectors.collect()
    asked = rows[:3]
    queries = spark.createDataFrame([(f"q{r['id']}", "c", r["embedding"]) for r in asked], "query_id string, collection string, embedding array<float>")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    for where in (None, {"label": 1}):
        hits = retrieval.top_k(queries, vectors, 5, where).collect()
        pool = [r for r in rows if not where or r["label"] == 1]
        for q in asked:
            expected = sorted(((-round(cosine(q["embedding"], r["embedding"]), 4), r["id"]) for r in pool))[:5]
            got = sorted((h["rank"], -h["similarity"], h["id"]) for h in hits if h["query_id"] == f"q{q['id']}")
            assert [i for *_, i in got] == [i for _, i in expected]
            assert [s for _, s, _ in got] == pytest.approx([s for s, _ in expected])
    assert "WindowGroupLimit" in retrieval.top_k(queries, vectors, 5)._jdf.queryExecution().toString()


def test_equal_texts_share_one_vector(spark):
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(["alpha beta", "gamma delta", "alpha beta"] * 4)], "chunk_id string, content string")
    encoder = retrieval.fit_encoder(texts, 32)
    seen = []

    def counting(df):
        seen.append(df.count())
        return encoder(df)

    # a costly encoder sees each text once, any other sees every chunk in its place
    for costly, met in ((True, 2), (False, 12)):
        seen.clear()
        rows = retrieval.embed(texts, counting, costly).collect()
        assert seen == [met] and len(rows) == 12
        assert len({tuple(r["embedding"]) for r in rows}) == 2
        assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 or not any(r["embedding"]) for r in rows)


# --- answers ------------------------------------------------------------------------------

SCOPE = ("r", "c", "secrets_detection")


@pytest.mark.parametrize(
    "raw, accepted",
    [
        (json.dumps({"verdicts": [{"finding_id": "a", "verdict": "confirmed", "reason": "ok"}]}), {"a": "confirmed"}),
        ("```json\n" + json.dumps({"verdicts": [{"finding_id": "a", "verdict": "uncertain"}]}) + "\n```", {"a": "uncertain"}),
        (json.dumps({"verdicts": [{"finding_id": "a", "verdict": "confirmed"}, {"finding_id": "zz", "verdict": "confirmed"}]}), None),
        (json.dumps({"verdicts": [{"finding_id": "a", "verdict": "perhaps"}]}), None),
        (json.dumps({"verdicts": [{"finding_id": "a", "verdict": "confirmed"}, "x"]}), None),
        (json.dumps({"verdicts": [{"finding_id": "a", "verdict": "confirmed"}, {"finding_id": "a", "verdict": "uncertain"}]}), {"a": "confirmed"}),
        ("not json", None),
        ("", None),
        ('{"other": []}', None),
        ('{"verdicts": []}', {}),
    ],
)
def test_closed_list(spark, raw, accepted):
    allowed = spark.createDataFrame([(*SCOPE, "a"), (*SCOPE, "b")], "repo string, commit_sha string, axis string, id string")
    given = spark.createDataFrame([(*SCOPE, raw)], "repo string, commit_sha string, axis string, raw string")
    rows = verdicts.validate_verdicts(given, allowed).collect()
    assert {r["finding_id"]: r["verdict"] for r in rows} == (accepted or {})
    status = verdicts.answer_statuses(given, allowed).first()["status"]
    assert status == ("error" if accepted is None else "accepted")


def test_linter_reports(spark, make_files):
    reports = spark.createDataFrame(
        [
            ("r", "c", 0, "ruff", json.dumps([
                {"code": "F401", "filename": "a.py", "location": {"row": 1}, "message": "m"},
                {"code": "NEW1", "filename": "a.py", "location": {"row": "?"}, "message": "new"},
                {"code": "C901", "filename": "a.py", "location": {"row": 2}, "message": "complex"},
            ])),
            ("r", "c", 1, "eslint", json.dumps([
                {"filePath": "b.js", "messages": [{"ruleId": "eqeqeq", "line": 9, "message": "e"}, {"ruleId": None, "fatal": True, "message": "x"}]}
            ])),
            ("r", "c", 2, "ruff", "broken"),
        ],
        "repo string, commit_sha string, report_ord long, tool string, report string",
    )
    files = make_files([("a.py", "import os\r\nx\n"), ("b.js", "a == b")])
    issues = quality.attach_code_hint(quality.ingest_linter_reports(reports), files)
    hints = {r["rule"]: (r["severity"], r["line"], r["code_hint"]) for r in issues.collect()}
    assert hints == {"F401": ("low", 1, "import os"), "NEW1": ("low", None, ""), "C901": ("high", 2, "x"), "eqeqeq": ("low", 9, "")}
    found = {r["rule"]: r for r in quality.linter_findings(issues).collect()}
    assert set(found) == {"F401", "NEW1", "eqeqeq"}
    assert found["NEW1"]["title"] == "new" and found["F401"]["title"] is None


def test_cache_key_has_five_parts(spark):
    key = (1, "sha", 6, "hash", "fr")
    schema = "repo_id long, commit_sha string, scan_version int, config_hash string, language string"
    cache = spark.createDataFrame([(*key, "p")], schema + ", payload string")
    varied = [key] + [tuple({0: 2, 1: "x", 2: 7, 3: "y", 4: "en"}[i] if i == j else v for i, v in enumerate(key)) for j in range(5)]
    hits, misses = tables.cache_split(spark.createDataFrame(varied, schema), cache)
    assert hits.count() == 1 and misses.count() == 5


def test_events(spark):
    lines = spark.createDataFrame([("r", 'data: {"event": "progress", "step": "fetching", "message": "m"}'), ("r", ""), ("r", ": ping"), ("r", "data: nonsense")], "run_id string, line string")
    assert [(r["event"], r["step"]) for r in answers.parse_events(lines).collect()] == [("progress", "fetching")]


def test_rule_tables_keep_their_sizes():
    assert (len(rules.ALLOWED_EXTENSIONS), len(rules.ALLOWED_FILENAMES), len(rules.EXCLUDED_DIRS)) == (100, 87, 62)


def test_clean_up_removes_what_a_session_wrote(spark):
    from assayer import session

    fresh = spark.newSession()
    kept = session.materialize(spark.range(3), "kept")
    path = session.new_table_path(fresh, "gone")
    fresh.range(5).write.parquet(path)
    assert session.run_folder(fresh) != session.run_folder(spark)
    session.clean_up(fresh)
    files = fresh.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not files.getFileSystem(fresh.sparkContext._jsc.hadoopConfiguration()).exists(files)
    assert kept.count() == 3
