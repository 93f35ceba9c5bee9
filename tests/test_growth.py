"""What must not grow faster than the input: sides that are broadcast, contents that meet in one task, walks."""

from __future__ import annotations

import ast
import re

from pyspark.sql import functions as F

from assayer.operators import quality
from assayer.session import new_table_path, spread
from assayer.sources import bucketed, tables, vectors, versions


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_contents_do_not_meet_by_collection(spark, monkeypatch):
    plans = []

    def kept(df, name, **options):
        plans.append(formatted(df))
        return materialize(df, name, **options)

    materialize = vectors.materialize
    monkeypatch.setattr(vectors, "materialize", kept)
    store = vectors.open_store(spark, new_table_path(spark, "growth"), buckets=4)
    chunks = spark.range(40).selectExpr(
        "concat('c', id % 2) AS collection", "concat('i', id) AS id", "'p' AS path", "0 AS chunk_index", "concat('text ', id % 7) AS content"
    )
    encoder = lambda df: df.withColumn("embedding", F.array(F.length("content")).cast("array<float>"))
    vectors.add_collections(store, chunks.filter("collection = 'c0'"), encoder)
    vectors.add_collections(store, chunks, encoder)
    assert plans and not any("hashpartitioning(collection" in plan for plan in plans)
    assert store.references.frame(spark).count() == 40
    assert store.texts.frame(spark).select("text_key").distinct().count() == store.texts.frame(spark).count() == 7
    bucketed.forget(spark, store.texts)
    bucketed.forget(spark, store.references)


def test_a_stored_cache_is_not_broadcast(spark):
    path = new_table_path(spark, "growth")
    key = ["id AS repo_id", "'c' AS commit_sha", "1 AS scan_version", "'h' AS config_hash", "'fr' AS language", "'p' AS payload"]
    tables.cache_put(spark, path, spark.range(30).selectExpr(*key))
    new = spark.range(20, 50).selectExpr(*key)
    stored = spark.read.parquet(path)
    added = tables.cache_additions(stored, new)
    _, misses = tables.cache_split(new.drop("payload"), stored)
    for found in (added, misses):
        assert "Broadcast" not in formatted(found)
        assert {r["repo_id"] for r in found.collect()} == set(range(30, 50))


def test_orders_are_not_broadcast_to_their_lines(spark, tmp_path, monkeypatch):
    from checks import joins

    spark.range(40).selectExpr("id AS o_orderkey", "if(id % 2 = 0, 'F', 'O') AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(120).selectExpr("id % 40 AS l_orderkey", "id DIV 40 + 1 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans, put = [], versions.put_group
    monkeypatch.setattr(versions, "put_group", lambda table, rows, groups: (plans.append(formatted(rows)), put(table, rows, groups)))
    found = joins.results_by_version(spark, str(tmp_path))
    assert len(plans) == 3 and not any("BroadcastHashJoin" in plan for plan in plans)
    assert found.filter("status = 'first'").count() == 60
    assert found.filter("status = 'second'").count() == len([k for k in range(0, 40, 2) if k % 3]) * 2


def test_one_walk_scores_all_functions():
    source = """
@deco(1 if a else 2)
def outer(x=1 if a else 2):
    class C:
        y = 1 if a else 2
        def method(self):
            return [i for i in x if i if x]
    async def inner():
        while a and b and c:
            try:
                pass
            except E:
                pass
    match x:
        case 1:
            pass
    return lambda: 0 if a else 1
"""
    scored = quality.scored_functions(ast.parse(source))
    assert [(n.name, branches) for n, branches in scored] == [("outer", 4), ("inner", 4), ("method", 3)]
    deep = ast.parse("def f():\n    return " + "1 + " * 900 + "(1 if a else 2)\n")
    assert [branches for _, branches in quality.scored_functions(deep)] == [1]


def test_a_file_of_one_row_group_is_shared_out(spark, tmp_path):
    spark.range(4000).selectExpr("id", "repeat(sha2(string(id), 256), 4) AS text").coalesce(1).write.parquet(f"{tmp_path}/t")
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {name: spark.conf.get(name) for name in (size, cost)}
    spark.conf.set(size, "20000")
    spark.conf.set(cost, "1")
    try:
        source = spark.read.parquet(f"{tmp_path}/t")
        assert source.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        shared = spread(source)
        assert shared.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
        assert re.search("REPARTITION", formatted(shared)) and shared.count() == 4000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_env_pieces(spark):
    from assayer.operators import lines

    texts = ["x = os.getenv('A')", "OS.GETENV", "osxgetenv", "process.env.B", "import.meta.env", "ENV[", "ENV", "os.environ", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", lines.may_read_env(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in found] == [True, False, False, True, True, True, False, True, False, None]


def test_near_copies_move_texts_and_not_their_sets(spark, monkeypatch):
    from assayer.operators import near

    written, materialize = {}, near.materialize

    def kept(df, name, **options):
        made = materialize(df, name, **options)
        written.setdefault(name, []).append(made)
        return made

    monkeypatch.setattr(near, "materialize", kept)
    text = "concat_ws(' ', transform(sequence(1, 60), i -> if(i = 30 AND id % 2 = 1, 'x', concat('w', i * (id DIV 2 + 1)))))"
    blocks = spark.range(20).selectExpr("'r' AS repo", "concat('p', id) AS path", "0 AS chunk_index", f"{text} AS content")
    found = near.near_duplicates(blocks, ["repo"])
    assert {r.path for r in found.members.collect()} == {f"p{i}" for i in range(20)}
    assert not any("set" in df.columns for frames in written.values() for df in frames)
    # what is in one group is not looked at again
    assert [df.count() > 0 for df in written["met"]] == [True, False]
