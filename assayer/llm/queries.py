"""Registered queries of the operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import (
    collocations,
    decontaminate,
    exact_dedup,
    jaccard_join,
    katz,
    license_scan,
    line_dedup,
    mixing,
    quality,
    ranked_search,
    recompression,
    url_filter,
    warc,
)
from assayer.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

WARC_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
    SELECT *, strlen(body) AS bytes, max(page_id) OVER (PARTITION BY digest) AS largest FROM p
)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
    CASE WHEN bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM g
"""


@query(WARC_SQL)
def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("bigint").alias("key"), F.col("url").alias("target_uri"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    )
    # the payloads travel through the assembly, and are hashed as they come out of it
    captures = warc.resolve_revisits(warc.archive_and_read(pages))
    payload = F.col("response.payload")
    key = lambda column: F.expr(f"try_cast({column} AS bigint)")  # noqa: E731
    named = captures.withColumns({
        "own": warc.field(F.col("metadata"), "captureKey"),
        "other": warc.field(F.col("original_metadata"), "captureKey"),
    })
    return named.select(
        key("own").alias("page_id"), F.coalesce(F.octet_length(payload).cast("bigint"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha1(payload), "response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), key("other").alias("refers_to"),
    )


URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]

_TRACKED = r"'^(utm_[^=]*|gclid|fbclid|ref)(=.*)?$'"
URL_SQL = rf"""
WITH cut AS (
    SELECT page_id, url,
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
    FROM pages
), parts AS (
    SELECT page_id, rest,
        translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), {UPPER}) AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
        list_filter(str_split(regexp_extract(coalesce(rest, ''), '^[^?#]*\?([^#]*)', 1), '&'),
            lambda p: p <> '') AS asked
    FROM cut
), named AS (
    SELECT page_id, host, path,
        len(list_filter(asked, lambda p: regexp_matches(p, {_TRACKED}))) > 0 AS tracked,
        CASE WHEN rest IS NOT NULL THEN
            regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '')
            || regexp_replace(path, '/+$', '')
            || CASE WHEN len(list_filter(asked, lambda p: NOT regexp_matches(p, {_TRACKED}))) > 0 THEN '?'
                || array_to_string(list_sort(
                    list_filter(asked, lambda p: NOT regexp_matches(p, {_TRACKED}))), '&') ELSE '' END
        END AS canonical
    FROM parts
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule
    FROM named
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN canonical IN (SELECT canonical FROM named WHERE tracked AND canonical IS NOT NULL) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


@query(URL_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs that occur with a tracking parameter on any page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(url_filter.has_tracking(F.col("url"))).select(
        url_filter.canonical_url(F.col("url")).alias("canonical")
    )
    judged = url_filter.judge(pages, listed, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


EXACT_SQL = f"""
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), {UPPER})) AS text_sha256 FROM documents
), n AS (
    SELECT doc_id, text_sha256, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
        row_number() OVER (PARTITION BY text_sha256, doc_id) AS nth
    FROM d WINDOW g AS (PARTITION BY text_sha256)
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND nth = 1 AS kept, text_sha256
FROM n
"""


@query(EXACT_SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    index = exact_dedup.open_index(spark)
    out = exact_dedup.dedup_ranges(index, docs)
    exact_dedup.close_index(spark, index)
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.col("digest").alias("text_sha256"),
    )


@query()
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
DECONTAMINATION_SQL = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), {_ALNUM}) AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), {_ALNUM}) AS w FROM benchmark
), iw AS (
    SELECT item_id, size, array_to_string(w[s + 1 : s + size], ' ') AS phrase FROM (
        SELECT item_id, w, least(13, len(w)) AS size, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s
        FROM i WHERE len(w) > 0)
), dw AS (
    SELECT doc_id, size, s, array_to_string(w[s + 1 : s + size], ' ') AS phrase FROM (
        SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS s
        FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)
), m AS (
    SELECT doc_id, item_id, s, size FROM dw JOIN iw USING (size, phrase)
), h AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
        SELECT doc_id, unnest(range(s, s + size)) AS p FROM m) GROUP BY doc_id
), n AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query(DECONTAMINATION_SQL)
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


_SPACED = r"'[^\x20\x09-\x0D]+'"
JACCARD_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), {_SPACED}) AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0))
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g)
        WHERE x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
    WHERE 100 * c >= 85 * (p.n + q.n - c)
), r AS (
    SELECT doc_id AS a, doc_id AS root FROM d
    UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a
)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


@query(JACCARD_SQL)
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


REPEATS_SQL = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents
), g AS (
    SELECT doc_id, s, array_to_string(w[s + 1 : s + 13], ' ') AS g FROM (
        SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS s FROM d WHERE len(w) >= 13)
), r AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id
), p AS (
    SELECT DISTINCT doc_id, s + k AS i FROM r, range(0, 13) t(k)
), q AS (
    SELECT doc_id, count(*) AS n_removed, list(i) AS gone FROM p GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN w
        ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""


@query(REPEATS_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = recompression.remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "posterior", "score", "kept")


# Domains of the labelled table, and the share of tokens that each is to have.
JUNK, TOXIC, CLEAN = 0, 1, 2
TARGETS = (0.05, 0.05, 0.90)


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("quality") == 0, JUNK).when(F.col("toxic") == 1, TOXIC).otherwise(CLEAN)
    known = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    return read_table(spark, sf_dir, "labels").filter(known).select("doc_id", domain.alias("domain"))


@query()
def op10_target_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, labelled_domains(spark, sf_dir), TARGETS)
    return mixed.select("doc_id", "n_tokens", "posterior", "rate", "copies")


@query()
def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.held_out_scores(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


COLLOCATION_SQL = rf"""
WITH t AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), {UPPER}) AS text
    FROM documents
), p AS (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?

]')), '[^ 	]+') AS w
    FROM t
), g AS (
    SELECT lang, w[s : s + k - 1] AS g, k FROM (
        SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM p, range(1, 6) r(k) WHERE len(w) >= k)
), f AS (
    SELECT lang, g, k, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), n AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), c AS (
    SELECT * FROM f WHERE k > 1 AND NOT EXISTS (
        SELECT 1 FROM f x WHERE x.lang = f.lang AND x.k > f.k AND 100 * x.a >= 100 * f.a
        AND instr(' ' || array_to_string(x.g, ' ') || ' ', ' ' || array_to_string(f.g, ' ') || ' ') > 0)
), s AS (
    SELECT c.lang, c.g, c.a, x.k, x.a AS l, y.a AS r, n.n,
        (1000::HUGEINT * c.a * n.n // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM c JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.g = c.g[1 : x.k]
    JOIN f y ON y.lang = c.lang AND y.g = c.g[x.k + 1 : c.k] JOIN n ON n.lang = c.lang
), b AS (
    SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score
    FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
    phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000
"""


@query(COLLOCATION_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


LINE_SQL = f"""
WITH d AS (
    SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), k AS (
    SELECT doc_id, lines, list_transform(lines, lambda x:
        translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {UPPER})) AS keys FROM d
), f AS (
    SELECT key FROM (SELECT doc_id, unnest(keys) AS key FROM k) WHERE length(key) >= 1
    GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
    SELECT coalesce(list(key), []) AS often FROM f
), g AS (
    SELECT doc_id, lines, list_transform(keys, lambda x: list_contains(often, x)) AS gone FROM k, m
)
SELECT doc_id, len(lines) AS n_lines, len(list_filter(gone, lambda x: x)) AS n_dropped,
    sha256(coalesce(array_to_string(list_filter(lines, lambda x, i: NOT gone[i]), chr(10)), '')) AS kept_sha256
FROM g
"""


@query(LINE_SQL)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = line_dedup.cut(docs, line_dedup.keep_bitmaps(docs))
    return found.select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
SEARCH_SQL = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), {_TERMS}) AS w FROM documents
), t AS (
    SELECT doc_id, term, n, count(*) AS tf
    FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL
), z AS (
    SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0
), f AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM t GROUP BY term), z
), i AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {UPPER}), {_TERMS})) AS term
    FROM benchmark
), s AS (
    SELECT item_id, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM i JOIN f USING (term) JOIN t USING (term), z GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@query(SEARCH_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
