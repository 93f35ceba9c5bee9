from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayer.functions import paths as P
from assayer.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def column_of(spark, values, fn, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r["x"] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text",
    ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "a\rb", "\n", "\n\n", "a\x0bb\x0cc\x1cd\x1de\x1ef", "é\x85b\u2028c\u2029", "a\n\r\n", "x\x1fy"],
)
def test_lines_follow_text_boundaries(spark, text):
    parts = spark.createDataFrame([(text,)], "t string").select(T.split_lines("t").alias("parts"))
    assert parts.select(T.drop_last(F.col("parts")).alias("x")).first()["x"] == text.splitlines()


def test_whitespace_functions_agree_with_text_methods(spark):
    texts = [" a ", "\u00a0b\u3000", "\x1c c \x1f", "", " \t\u2003", "d  e\n f", "\x85g", "plain"]
    assert column_of(spark, texts, T.strip) == [t.strip() for t in texts]
    assert column_of(spark, texts, T.is_blank) == [not t.strip() for t in texts]
    longer = column_of(spark, texts + ["x" * 51, " " + "x" * 50 + " ", "a" + " " * 60 + "b"], lambda c: T.stripped_longer_than(c, 50))
    assert longer == [False] * len(texts) + [True, False, True]


def test_fingerprint(spark):
    import hashlib

    texts = ["x  =\t1", "x = 1", " ", "é\u00a0b"]
    expected = [
        hashlib.sha1(" ".join(t.split()).encode()).hexdigest()[:12] if t.strip() else "-" for t in texts
    ]
    assert column_of(spark, texts, T.fingerprint) == expected
    assert expected[0] == expected[1]


def test_language_tags(spark):
    tags = ["fr", "en", "EN", "en-US", "fr_FR", "  en ", "de", "", None]
    assert column_of(spark, tags, T.normalize_lang) == ["fr", "en", "en", "en", "fr", "en", "fr", "fr", "fr"]


def test_rounding_to_even(spark):
    values = [0.125, 0.375, 2.5, 1 / 3, 0.575]
    assert column_of(spark, values, lambda c: T.round_to(c, 2), "v double") == [round(v, 2) for v in values]


def test_template_keeps_unknown_parts(spark):
    params = F.create_map(F.lit("name"), F.lit(".env"))
    assert one(spark, T.fill_template(F.lit("{name} at {line}"), params, ["name", "line"])) == ".env at {line}"


def test_fences_and_objects(spark):
    raw = ['```json\n{"a": 1}\n```', "[1]", "no json", '{"a": ', "{}", "```{\"b\": 2}```"]
    assert column_of(spark, raw, lambda c: T.is_json_object(T.strip_fences(c))) == [True, False, False, False, True, True]


def test_times(spark):
    texts = ["2024-01-02T03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "never"]
    shown = column_of(spark, texts, lambda c: F.date_format(T.parse_utc(c), "dd HH:mm"))
    assert shown == ["02 03:04", "02 03:04", "02 01:04", None]


KEPT = [
    ".env", "config/.env", "id_rsa", "certs/private.pem", "app.key", ".netrc", "terraform.tfvars",
    "src/main.py", "src/stats.R", "README.md", "Dockerfile", "a/b/KEY.PEM",
]
REJECTED = {
    "node_modules/a/index.js": "excluded_by_path",
    "dist/app.js": "excluded_by_path",
    ".venv/lib/x.py": "excluded_by_path",
    "a/__pycache__/m.py": "excluded_by_path",
    "logo.png": "excluded_by_extension",
    "video.mp4": "excluded_by_extension",
    "noextension": "excluded_by_extension",
}


def test_file_selection(spark):
    reason = lambda c: P.rejection_reason(c, F.lit(1000))
    assert column_of(spark, KEPT, reason) == [None] * len(KEPT)
    assert column_of(spark, list(REJECTED), reason) == list(REJECTED.values())
    big = lambda c: P.rejection_reason(c, F.lit(100_001))
    assert set(column_of(spark, ["package-lock.json", "src/main.py"], big)) == {"skipped_too_large"}
    assert column_of(spark, ["dist/x.py"], big) == ["excluded_by_path"]


def test_path_parts(spark):
    paths = [".env", ".env.local", "a/b.tar.gz", "a/b", "x.", "src/F.PY", "..x"]
    assert column_of(spark, paths, P.path_suffix) == ["", ".local", ".gz", "", "", ".PY", ".x"]
    assert column_of(spark, paths, P.file_language) == ["text", "local", "gz", "text", "text", "PY", "x"]
    assert column_of(spark, paths, P.path_parent) == [".", ".", "a", "a", ".", "src", "."]


def test_sensitive_names(spark):
    paths = [".env", "deploy/id_rsa", "X.PEM", ".env.example", "src/main.py", "key.pub", "secrets"]
    assert column_of(spark, paths, P.classify_sensitive) == [
        "committed.env", "committed.ssh_key", "committed.pem", None, None, None, "committed.secrets",
    ]


def test_test_and_pipeline_paths(spark):
    tests = ["tests/a.txt", "src/test_a.py", "a_TEST.go", "x.Spec.ts", "FooTest.java", "a_spec.rb", "Tests/a.py", "src/tests.py", "latest.py"]
    assert column_of(spark, tests, P.is_test_path) == [True, True, True, True, True, True, False, False, False]
    ci = [".github/workflows/a.yml", ".github/workflows/d/a.yml", "Jenkinsfile", "x/Jenkinsfile", ".travis.yml", "azure-pipelines.yaml"]
    assert column_of(spark, ci, P.is_ci_path) == [True, False, True, False, True, True]


LINKS = [
    ("README.md", "docs/guide.md", "docs/guide.md"),
    ("docs/a.md", "../src/x.py#L3", "src/x.py"),
    ("docs/a.md", "/top.md?raw=1", "top.md"),
    ("docs/a.md", "./b/../c.md", "docs/c.md"),
    ("docs/a.md", "../../x.md", None),
    ("a.md", "../x.md", None),
    ("a.md", "HTTPS://x.y/z.md", None),
    ("a.md", "mailto:a@b.c", None),
    ("a.md", "#anchor", None),
    ("a.md", "..", None),
    ("a/b.md", "..", None),
    ("a.md", "//cdn/x.md", None),
    ("a.md", "..hidden.md", None),
    ("a/b/c.md", "../../../../d/e.md", None),
    ("a.md", "x//y.md", "x/y.md"),
]


def test_link_targets(spark):
    rows = spark.createDataFrame([(i, d, t) for i, (d, t, _) in enumerate(LINKS)], "i int, d string, t string")
    found = rows.select("i", P.resolve_link("d", "t").alias("x")).orderBy("i").collect()
    assert [r["x"] for r in found] == [expected for *_, expected in LINKS]


def test_collection_name(spark):
    name = P.collection_name(F.lit("user1234abcd"), F.lit("owner/my-repo"), F.lit("abcdef1234567890"))
    assert one(spark, name) == "cc-user1234-owner-my-repo-abcdef12"
    long = P.collection_name(F.lit("u" * 20), F.lit("Owner_X/" + "r" * 90), F.lit("a" * 40))
    assert len(one(spark, long)) == 63
