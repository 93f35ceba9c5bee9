"""The corpus pipeline: stages against brute force on what each was given, and the entry point."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from assayer.llm import exact_dedup, queries
from assayer.session import materialize, new_table_path
from tests.compare import differences, oracle_connection
from tests.llm.test_documents import brute_components
from tests.llm.test_scans import brute_contamination

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_entry_has_all_operators():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = oracle_connection(SF_DIR)
    assert differences(queries.QUERIES[name](spark, SF_DIR), con, queries.ORACLES[name]) == []


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = materialize(stage(spark, docs, SF_DIR), "stage-test")
        after = {r.doc_id for r in docs.collect()}
        gone = {i for i, _ in before} - after
        if name == "quality classifier":
            wrong = labels.filter(F.col("doc_id").isin(list(gone))).filter("quality = 1").count()
            assert gone and wrong <= 2
        elif name == "exact dedup":
            last = {}
            for i, text in before:
                key = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                last[key] = max(i, last.get(key, i))
            assert after == set(last.values())
        elif name == "n-gram Jaccard join":
            assert after == {i for i, _, c in brute_components(before, 5, 80) if i == c}
        elif name == "benchmark decontamination":
            assert after == {r[0] for r in brute_contamination(before, bench) if not r[-1]}
        else:
            assert docs.columns == [*COLUMNS, "n_tokens", "posterior", "rate", "copies"]
            assert docs.filter("copies < 1").count() == 0
            break
        assert docs.columns == COLUMNS and len(after) == docs.count()


def test_the_index_has_no_more_buckets_than_partitions(spark, make_docs, corpus, monkeypatch):
    opened, plain = [], exact_dedup.open_index
    monkeypatch.setattr(exact_dedup, "open_index", lambda *a, **k: opened.append(plain(*a, **k)) or opened[-1])
    kept = corpus_pipeline.exact_duplicates(spark, make_docs(corpus), SF_DIR).collect()
    last = {}
    for i, text in corpus:
        key = (text or "").encode().lower()
        last[key] = max(last.get(key, -1), -1 if i is None else i)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == sorted(last.values())
    assert [x.buckets for x in opened] == [4]


def test_the_first_stage_leaves_columns_alone(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumns({"score": F.lit(7.5), "kept": F.lit("own")})
    out = corpus_pipeline.quality_classifier(spark, docs, SF_DIR)
    assert out.columns == docs.columns and out.select("score", "kept").distinct().collect() == [(7.5, "own")]


def test_stages_on_odd_rows(spark, make_docs, corpus):
    docs = make_docs([*corpus, (5, None), (None, "Null id text")]).select("doc_id", "text", "lang", "source", "n_chars", "score")
    sf_dir = new_table_path(spark, "odd")
    spark.createDataFrame([(1, None), (None, "one two three")], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    spark.createDataFrame([(10, 1, 0), (11, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        # every stage by itself: words drawn at random have no sentences, and the first rejects them
        kept = stage(spark, rows, sf_dir).count()
        assert kept <= rows.count() and (kept > 0 or name == "quality classifier")
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
