"""Joins against stored tables: linter reports, cache, users, messages, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import rules
from assayer.operators import findings, localize, quality, runs, verdicts
from assayer.plans.scan import config_hash_column
from assayer.session import new_table_path
from assayer.sources import tables, versions
from assayer.sources.tree import repo_catalog as catalog_of
from assayer.streaming.incremental import scan_batch
from checks.axes import LINT_RAW, MERGED, K, raw
from checks.corpus import FILES, files, tracked
from checks.linters import lint_sql, linter_reports
from checks.registry import query, table

# --- linter reports -----------------------------------------------------------------------

LINT = lint_sql(4)


@query(f"WITH {FILES}, {LINT} SELECT repo, commit_sha, tool, rule, severity, path AS file_path, line, message, code_hint FROM capped")
def linter_issues(spark, sf_dir):
    issues = quality.ingest_linter_reports(linter_reports(tracked(spark, sf_dir)), 4)
    hinted = quality.attach_code_hint(issues, files(spark, sf_dir))
    return hinted.select(*K, "tool", "rule", "severity", "file_path", "line", "message", "code_hint")


@query(
    f"""WITH {FILES}, {LINT}, numbered AS (SELECT *, row_number() OVER (PARTITION BY repo, commit_sha ORDER BY tool DESC, ord) - 1 AS idx FROM capped WHERE rule <> 'C901'),
    raw AS ({LINT_RAW}), {MERGED} SELECT repo, commit_sha, id, severity, line, rank FROM ranked"""
)
def linter_findings(spark, sf_dir):
    issues = quality.ingest_linter_reports(linter_reports(tracked(spark, sf_dir)), 4)
    found = quality.linter_findings(quality.attach_code_hint(issues, files(spark, sf_dir)))
    return findings.rank_findings(findings.merge_findings(found)).select(*K, "id", "severity", "line", "rank")


@query(
    """SELECT key, round_even(total, 2) AS total, place FROM (SELECT o_custkey AS key, o_totalprice AS total,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 3"""
)
def head_per_group(spark, sf_dir):
    from assayer.functions import text as T

    orders = table(spark, sf_dir, "orders")
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    return findings.head_per(orders, ["o_custkey"], order, 3).select(
        F.col("o_custkey").alias("key"), T.round_to(F.col("o_totalprice"), 2).alias("total"), F.col("rank").alias("place")
    )


# --- model issues on tracked paths --------------------------------------------------------


def claimed_issues(spark, sf_dir):
    """One issue per file; every third names a path that does not exist."""
    n = F.col("ord")
    return tracked(spark, sf_dir).select(
        *K,
        "ord",
        F.when(n % 3 == 0, F.concat(F.lit("invented/"), "path")).otherwise(F.col("path")).alias("file_path"),
        F.lit("llm").alias("source"),
    )


@query(f"WITH {FILES} SELECT repo, commit_sha, count(*) FILTER (WHERE ord % 3 <> 0) AS kept, count(*) FILTER (WHERE ord % 3 = 0) AS rejected FROM files GROUP BY ALL")
def rejected_paths(spark, sf_dir):
    return verdicts.rejected_counts(claimed_issues(spark, sf_dir), tracked(spark, sf_dir))


@query(f"WITH {FILES} SELECT ord, path AS file_path FROM files WHERE ord % 3 <> 0")
def known_path_issues(spark, sf_dir):
    issues = verdicts.reject_unknown_paths(claimed_issues(spark, sf_dir), tracked(spark, sf_dir))
    return issues.select("ord", "file_path")


# --- scan cache ---------------------------------------------------------------------------


def cache_rows(spark, sf_dir):
    """Orders as stored scans: customers are repositories, several entries per key."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("repo_id"),
        F.col("o_orderstatus").alias("commit_sha"),
        F.lit(rules.SCAN_VERSION).alias("scan_version"),
        F.col("o_orderpriority").alias("config_hash"),
        F.lit("fr").alias("language"),
        F.concat(F.lit("p-"), "o_custkey", F.lit("-"), "o_orderstatus").alias("payload"),
    )


def scan_requests(spark, sf_dir):
    """One request per order with the next customer's key, in two languages."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        (F.col("o_custkey") + 1).alias("repo_id"),
        F.col("o_orderstatus").alias("commit_sha"),
        F.lit(rules.SCAN_VERSION).alias("scan_version"),
        F.col("o_orderpriority").alias("config_hash"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("en")).otherwise(F.lit("fr")).alias("language"),
    )


REQUESTS = """cache AS (SELECT DISTINCT o_custkey AS repo_id, o_orderstatus AS commit_sha, o_orderpriority AS config_hash FROM orders),
  requests AS (SELECT o_orderkey AS request_id, o_custkey + 1 AS repo_id, o_orderstatus AS commit_sha, o_orderpriority AS config_hash, CASE WHEN o_orderkey % 4 = 0 THEN 'en' ELSE 'fr' END AS language FROM orders)"""


@query(
    f"""WITH {REQUESTS} SELECT r.request_id, c.repo_id IS NOT NULL AS hit, CASE WHEN c.repo_id IS NOT NULL THEN concat('p-', c.repo_id, '-', c.commit_sha) END AS payload
    FROM requests r LEFT JOIN cache c ON (c.repo_id, c.commit_sha, c.config_hash, 'fr') = (r.repo_id, r.commit_sha, r.config_hash, r.language)"""
)
def cache_lookup(spark, sf_dir):
    hits, misses = tables.cache_split(scan_requests(spark, sf_dir), cache_rows(spark, sf_dir))
    return hits.select("request_id", F.lit(True).alias("hit"), "payload").unionByName(
        misses.select("request_id", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("payload"))
    )


@query(
    f"""WITH {REQUESTS} SELECT repo_id, commit_sha, config_hash, language FROM (SELECT DISTINCT repo_id, commit_sha, config_hash, language FROM requests) r
    WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE (c.repo_id, c.commit_sha, c.config_hash, 'fr') = (r.repo_id, r.commit_sha, r.config_hash, r.language))"""
)
def cache_additions(spark, sf_dir):
    new = scan_requests(spark, sf_dir).withColumn("payload", F.lit("new"))
    return tables.cache_additions(cache_rows(spark, sf_dir), new).select(
        "repo_id", "commit_sha", "config_hash", "language"
    )


@query(
    f"""WITH {REQUESTS} SELECT repo_id, commit_sha, config_hash, language, payload FROM (SELECT repo_id, commit_sha, config_hash, 'fr' AS language, concat('p-', repo_id, '-', commit_sha) AS payload FROM cache
    UNION ALL SELECT DISTINCT repo_id, commit_sha, config_hash, language, 'new' FROM requests r
    WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE (c.repo_id, c.commit_sha, c.config_hash, 'fr') = (r.repo_id, r.commit_sha, r.config_hash, r.language)))"""
)
def cache_after_two_puts(spark, sf_dir):
    path = new_table_path(spark, "cache")
    new = scan_requests(spark, sf_dir).drop("request_id").withColumn("payload", F.lit("new"))
    tables.cache_put(spark, path, cache_rows(spark, sf_dir))
    tables.cache_put(spark, path, new)
    tables.cache_put(spark, path, new.withColumn("payload", F.lit("late")))
    return spark.read.parquet(path).select("repo_id", "commit_sha", "config_hash", "language", "payload")


@query(
    """WITH asked AS (SELECT o_custkey AS repo_id, o_orderstatus AS commit_sha, o_orderpriority AS config_hash, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 2 END AS round,
      CASE WHEN o_orderkey % 4 = 0 THEN 'en' ELSE 'fr' END AS language FROM orders)
    SELECT repo_id, commit_sha, language, concat('round ', min(round)) AS payload FROM asked GROUP BY repo_id, commit_sha, language"""
)
def incremental_scans(spark, sf_dir):
    """Two rounds of requests: each scans and caches only what no round before has."""
    path = new_table_path(spark, "incremental")
    requests = scan_requests(spark, sf_dir)
    urgent = F.col("config_hash") < "3"
    for number, part in ((1, requests.filter(urgent)), (2, requests.filter(~urgent)), (3, requests)):
        asked = part.drop("request_id").withColumns({"config_hash": F.lit("h"), "repo_id": F.col("repo_id") - 1})
        scan_batch(asked, path, lambda df, number=number: df.withColumn("payload", F.lit(f"round {number}")))
    return spark.read.parquet(path).select("repo_id", "commit_sha", "language", "payload")


CACHE_ROW = "repo_id bigint, commit_sha string, scan_version int, config_hash string, language string, payload string"


def versioned(spark, sf_dir):
    """What two writers put who both saw an empty cache, then some repositories gone and put anew."""
    stored = versions.open_versions(spark, new_table_path(spark, "versions"), CACHE_ROW, tables.CACHE_KEY, buckets=16)
    rows = cache_rows(spark, sf_dir)
    versions.put(stored, rows)
    versions.put(stored, rows.withColumn("payload", F.lit("late")))
    customers = table(spark, sf_dir, "customer")
    gone = customers.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("repo_id"))
    versions.remove(stored, gone)
    back = customers.filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("repo_id"))
    versions.put(stored, rows.join(back, "repo_id", "left_semi").withColumn("payload", F.lit("anew")))
    return versions.open_versions(spark, stored.path)


_VERSIONED = """kept AS (SELECT DISTINCT o_custkey AS repo_id, o_orderstatus AS commit_sha, o_orderpriority AS config_hash,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'anew' ELSE concat('p-', o_custkey, '-', o_orderstatus) END AS payload
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING')"""


@query(f"WITH {_VERSIONED} SELECT * FROM kept")
def versioned_cache(spark, sf_dir):
    """One entry a key, the first that was written and still stands."""
    found = versions.current(spark, versioned(spark, sf_dir), first=True)
    return found.select("repo_id", "commit_sha", "config_hash", "payload")


@query(
    f"""WITH {_VERSIONED}, asked AS (SELECT DISTINCT o_custkey + 1 AS repo_id FROM orders WHERE o_orderkey % 50 = 0)
    SELECT repo_id, commit_sha, config_hash, payload FROM kept SEMI JOIN asked USING (repo_id)"""
)
def versioned_lookup(spark, sf_dir):
    """The entries of the repositories asked for; other folders are not read."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 50 == 0)
    asked = orders.select((F.col("o_custkey") + 1).alias("repo_id"))
    found = versions.current(spark, versioned(spark, sf_dir), asked, first=True)
    return found.select("repo_id", "commit_sha", "config_hash", "payload")


@query(
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT o_custkey AS repo_id, 'removed' AS what, count(*) AS n FROM orders WHERE o_custkey IN (FROM gone) GROUP BY o_custkey
    UNION ALL SELECT o_custkey, 'remaining', count(*) FROM orders WHERE o_custkey NOT IN (FROM gone) GROUP BY o_custkey"""
)
def cache_invalidation(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    remaining, removed = tables.cache_invalidate(
        cache_rows(spark, sf_dir), customers.select(F.col("c_custkey").alias("repo_id"))
    )
    left = remaining.groupBy("repo_id").agg(F.count("*").alias("n"))
    return removed.select("repo_id", F.lit("removed").alias("what"), F.col("removed").alias("n")).unionByName(
        left.select("repo_id", F.lit("remaining").alias("what"), "n")
    )


@query(
    """SELECT c_custkey, substr(sha256(concat('{"name":"', c_name, '","segment":"', c_mktsegment, '","nation":', c_nationkey, '}')), 1, 16) AS config_hash FROM customer"""
)
def config_hashes(spark, sf_dir):
    inputs = F.struct(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", config_hash_column(inputs).alias("config_hash"))


# --- results ------------------------------------------------------------------------------


@query(
    """WITH known AS (SELECT l_orderkey AS analysis_id, l_linenumber AS aspect, o_orderstatus = 'F' AND o_orderkey IS NOT NULL AS replaced
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT analysis_id, aspect, CASE WHEN replaced THEN 'second' ELSE 'first' END AS status FROM known WHERE NOT replaced OR (aspect <= 2 AND analysis_id % 3 <> 0)"""
)
def replaced_results(spark, sf_dir):
    """Results of finished orders are replaced by fewer rows, of some by none; twice, to show it
    is idempotent."""
    lineitem = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").alias("aspect")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id"), "o_orderstatus")
    known = lineitem.join(orders.hint("merge"), "analysis_id")  # one row an order is no side to broadcast
    path = new_table_path(spark, "analysis")
    tables.replace_results(spark, path, known.select("analysis_id", "aspect", F.lit("first").alias("status")))
    again = known.filter((F.col("o_orderstatus") == "F") & (F.col("aspect") <= 2) & (F.col("analysis_id") % 3 != 0)).select(
        "analysis_id", "aspect", F.lit("second").alias("status")
    )
    finished = orders.filter(F.col("o_orderstatus") == "F").select("analysis_id")
    tables.replace_results(spark, path, again, finished)
    tables.replace_results(spark, path, again, finished)
    return spark.read.parquet(path).select("analysis_id", "aspect", "status")


@query(
    """WITH known AS (SELECT l_orderkey AS analysis_id, l_linenumber AS aspect, o_orderstatus = 'F' AND o_orderkey IS NOT NULL AS replaced
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT analysis_id, aspect, CASE WHEN replaced THEN 'second' ELSE 'first' END AS status FROM known WHERE NOT replaced OR (aspect <= 2 AND analysis_id % 3 <> 0)"""
)
def results_by_version(spark, sf_dir):
    """The same replacement without rewriting: every run's rows are those of its last version."""
    lineitem = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").cast("int").alias("aspect")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id"), "o_orderstatus")
    known = lineitem.join(orders.hint("merge"), "analysis_id")  # one row an order is no side to broadcast
    schema = "analysis_id bigint, aspect int, status string"
    stored = versions.open_versions(spark, new_table_path(spark, "results"), schema, ["analysis_id", "aspect"], buckets=16)
    first = known.select("analysis_id", "aspect", F.lit("first").alias("status"))
    versions.put_group(stored, first, first)
    again = known.filter((F.col("o_orderstatus") == "F") & (F.col("aspect") <= 2) & (F.col("analysis_id") % 3 != 0)).select(
        "analysis_id", "aspect", F.lit("second").alias("status")
    )
    finished = orders.filter(F.col("o_orderstatus") == "F").select("analysis_id")
    versions.put_group(stored, again, finished)
    versions.put_group(stored, again, finished)
    return versions.newest_group(spark, versions.open_versions(spark, stored.path))


# --- users --------------------------------------------------------------------------------


def users(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("github_id"),
        F.col("c_name").alias("login"),
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("avatar_url"),
        F.lit(None).cast("string").alias("email"),
        F.lit(0).cast("long").alias("created_at"),
    )


def profile_updates(spark, sf_dir):
    """Orders as profile updates: several per user, some of users not known yet."""
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") * 2).alias("github_id"),
        F.concat(F.lit("login"), n.cast("string")).alias("login"),
        F.when(n % 3 == 0, F.lit("")).when(n % 3 == 1, F.concat(F.lit("Name "), n.cast("string"))).alias("name"),
        F.col("o_orderpriority").alias("avatar_url"),
        F.col("o_orderstatus").alias("email"),
        n.alias("seen_at"),
    )


@query(
    """WITH updates AS (SELECT o_custkey * 2 AS github_id, max(o_orderkey) AS k, arg_max(o_orderpriority, o_orderkey) AS a, arg_max(o_orderstatus, o_orderkey) AS e FROM orders GROUP BY 1)
    SELECT coalesce(c.c_custkey, u.github_id) AS github_id, CASE WHEN u.k IS NULL THEN c.c_name ELSE concat('login', u.k) END AS login,
      CASE WHEN u.k IS NULL THEN c.c_name WHEN u.k % 3 = 1 THEN concat('Name ', u.k) ELSE concat('login', u.k) END AS username,
      CASE WHEN u.k IS NULL THEN c.c_mktsegment ELSE u.a END AS avatar_url, u.e AS email, CASE WHEN c.c_custkey IS NULL THEN u.k ELSE 0 END AS created_at,
      CASE WHEN c.c_custkey IS NULL THEN 'inserted' WHEN u.k IS NULL THEN 'kept' ELSE 'updated' END AS change
    FROM customer c FULL JOIN updates u ON u.github_id = c.c_custkey"""
)
def upserted_users(spark, sf_dir):
    return runs.upsert_users(users(spark, sf_dir), profile_updates(spark, sf_dir))


@query(
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
    SELECT 'users' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (FROM gone)
    UNION ALL SELECT 'runs', count(*) FROM orders WHERE o_custkey NOT IN (FROM gone)
    UNION ALL SELECT 'results', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gone))
    UNION ALL SELECT 'users_removed', count(*) FROM gone UNION ALL SELECT 'runs_removed', count(*) FROM orders WHERE o_custkey IN (FROM gone)
    UNION ALL SELECT 'results_removed', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gone))"""
)
def purged_users(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"))
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("analysis_id"))
    gone = customers.filter(F.col("c_mktsegment") == "MACHINERY")
    left = runs.purge_users(customers, orders, results, gone)

    def counted(df, name):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")

    removed = left["removed"].agg(
        F.count("*").alias("users_removed"),
        F.sum("runs_removed").alias("runs_removed"),
        F.sum("results_removed").alias("results_removed"),
    )
    parts = counted(left["users"], "users").union(counted(left["runs"], "runs")).union(counted(left["results"], "results"))
    return parts.union(removed.unpivot([], removed.columns, "name", "n"))


# --- messages -----------------------------------------------------------------------------


def part_messages(spark, sf_dir):
    """Parts as a message catalog: French always, English for most, some blank or extra."""
    part = table(spark, sf_dir, "part")
    key = F.concat(F.lit("aspect."), F.col("p_partkey").cast("string"))
    french = part.filter(F.col("p_partkey") % 11 != 0).select(
        key.alias("key"), F.lit("fr").alias("lang"),
        F.when(F.col("p_partkey") % 17 == 0, F.lit("  ")).otherwise(F.concat(F.lit("fr "), "p_name")).alias("template"),
    )
    english = part.filter(F.col("p_partkey") % 7 != 0).select(
        key.alias("key"), F.lit("en").alias("lang"), F.col("p_name").alias("template")
    )
    return french.unionByName(english)


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN lang = 'en' AND l_partkey % 7 <> 0 THEN p_name
      WHEN l_partkey % 11 <> 0 AND p_partkey IS NOT NULL THEN CASE WHEN l_partkey % 17 = 0 THEN '  ' ELSE concat('fr ', p_name) END ELSE CAST(l_partkey AS VARCHAR) END AS shown
    FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'en' ELSE 'fr' END AS lang FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey"""
)
def localized_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("value"),
        F.when(F.col("l_linestatus") == "O", F.lit("en-GB")).otherwise(F.lit("de")).alias("lang"),
    )
    shown = localize.label(rows, part_messages(spark, sf_dir), "aspect", "value", F.col("lang"), "shown")
    return shown.select("l_orderkey", "l_linenumber", "shown")


@query(
    """SELECT 'en' AS lang, concat('aspect.', p_partkey) AS key, 'missing' AS problem FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 11 <> 0
    UNION ALL SELECT 'en', concat('aspect.', p_partkey), 'extra' FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 = 0
    UNION ALL SELECT 'fr', concat('aspect.', p_partkey), 'blank' FROM part WHERE p_partkey % 17 = 0 AND p_partkey % 11 <> 0"""
)
def message_parity(spark, sf_dir):
    return localize.catalog_parity(part_messages(spark, sf_dir))


# --- repository catalog -------------------------------------------------------------------


def repositories(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("user_id"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("full_name"),
        F.col("p_type").alias("description"),
        F.when(F.col("p_size") % 5 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("language"),
        F.when(F.col("p_size") % 2 == 0, F.lit("public")).otherwise(F.lit("private")).alias("visibility"),
        F.concat(F.lit("https://example.com/"), F.col("p_partkey").cast("string")).alias("html_url"),
    )


CATALOG = """repos AS (SELECT p_partkey AS id, p_name AS name, p_type AS description, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS language,
  CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'private' END AS visibility, concat('https://example.com/', p_partkey) AS url FROM part)"""


@query(
    f"""WITH {CATALOG} SELECT r.*, p_brand AS user_id, count(*) OVER (PARTITION BY p_brand) > 60 AS overflow FROM repos r JOIN part ON p_partkey = id
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY id) <= 60"""
)
def repo_catalog(spark, sf_dir):
    return catalog_of(repositories(spark, sf_dir), 60)


@query(f"WITH {CATALOG} SELECT r.*, p_brand AS user_id, false AS overflow FROM repos r JOIN part ON p_partkey = id")
def whole_repo_catalog(spark, sf_dir):
    return catalog_of(repositories(spark, sf_dir), None)


@query(f"WITH {CATALOG} SELECT id, name FROM repos WHERE visibility = 'public' AND contains(lower(name), 'widget') AND language = 'Brand#17'")
def filtered_repos(spark, sf_dir):
    repos = repositories(spark, sf_dir).withColumnRenamed("full_name", "name")
    return runs.filter_repos(repos, "public", "Brand#17", " WIDGET ").select("id", "name")


@query(f"WITH {CATALOG} SELECT DISTINCT language FROM repos WHERE language IS NOT NULL")
def language_facets(spark, sf_dir):
    return runs.language_facets(repositories(spark, sf_dir))
