"""Chunks, duplicates, vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import cells, chunks, near, retrieval
from assayer.plans import deepen
from assayer.session import new_table_path
from assayer.sources import tables
from assayer.sources import vectors as V
from checks.axes import K
from checks.corpus import FILES, NAME, SPACE, files, sql_strip
from checks.registry import query, table
from checks.paths import SUFFIX, sql_list
from assayer import rules
from assayer.functions.paths import file_language

README_TYPE = f"CASE WHEN lower({NAME}) = 'readme.md' THEN 'readme' ELSE 'code' END"
SIZES = f"""sized AS (SELECT *, CASE WHEN lower({NAME}) = 'readme.md' THEN 1000 WHEN {SUFFIX} IN {sql_list(rules.CONFIG_EXTENSIONS)} THEN 800
    WHEN {SUFFIX} IN {sql_list(rules.DOC_EXTENSIONS)} THEN 1000 ELSE 1500 END AS size_, CASE WHEN lower({NAME}) = 'readme.md' THEN 300
    WHEN {SUFFIX} IN {sql_list(rules.CONFIG_EXTENSIONS)} THEN 100 WHEN {SUFFIX} IN {sql_list(rules.DOC_EXTENSIONS)} THEN 300 ELSE 200 END AS overlap FROM files)"""
WINDOWS = f"""{SIZES}, cut AS (SELECT repo, commit_sha, ord, path, start, substr(content, start + 1, size_) AS content FROM (
    SELECT *, unnest(range(0, greatest(length(content) - overlap - 1, 0) + 1, size_ - overlap)) AS start FROM sized)),
  windows AS (SELECT *, {README_TYPE} AS file_type, CAST(row_number() OVER (PARTITION BY ord ORDER BY start) - 1 AS INTEGER) AS chunk_index,
    CAST(count(*) OVER (PARTITION BY ord) AS INTEGER) AS total_chunks FROM cut WHERE length({sql_strip('content')}) > 50)"""


def corpus(spark, sf_dir):
    return files(spark, sf_dir).withColumn("language", file_language("path"))


@query(f"WITH {FILES}, {WINDOWS} SELECT ord, chunk_index, total_chunks, file_type, content FROM windows")
def window_chunks(spark, sf_dir):
    return chunks.window_chunks(corpus(spark, sf_dir)).select(
        "ord", "chunk_index", "total_chunks", "file_type", "content"
    )


@query(
    f"""WITH {FILES}, {WINDOWS} SELECT f.repo, f.commit_sha, f.total_files, coalesce(w.total_chunks, 0) AS total_chunks, coalesce(w.readme_found, FALSE) AS readme_found
    FROM (SELECT repo, commit_sha, count(*) AS total_files FROM files GROUP BY ALL) f
    LEFT JOIN (SELECT repo, commit_sha, count(*) AS total_chunks, bool_or(file_type = 'readme') AS readme_found FROM windows GROUP BY ALL) w USING (repo, commit_sha)"""
)
def chunk_stats(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return chunks.chunk_stats(rows, chunks.window_chunks(rows))


def _sql_texts(values):
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


_OWN_SEPARATORS = " ".join(
    f"WHEN '.{name}' THEN {_sql_texts(values)}" for name, values in rules.LANGUAGE_SEPARATORS.items()
)
# A node is a text that is cut by the first separator it holds; pieces that are too long are nodes of the
# next level, runs of the others are packed.  ``key`` is the path of piece numbers that leads to a node.
_CUT = """SELECT ord, key, size_, overlap, CASE WHEN sep <> '' THEN seps[chosen + 1:] ELSE [] END AS finer,
    CASE WHEN sep = '' THEN string_split(t, '') ELSE list_filter(list_transform(string_split(t, sep), lambda x, i: CASE WHEN i = 1 THEN x ELSE concat(sep, x) END), lambda x: x <> '') END AS pieces
  FROM (SELECT *, seps[chosen] AS sep FROM (SELECT *, coalesce(list_position(list_transform(seps, lambda x: x = '' OR contains(t, x)), TRUE), len(seps)) AS chosen FROM node))"""
RECURSIVE = f"""{SIZES}, whole AS (SELECT s.*, CASE WHEN lower({NAME}) = 'readme.md' THEN {_sql_texts(rules.README_SEPARATORS)} ELSE CASE lower({SUFFIX}) {_OWN_SEPARATORS} ELSE {_sql_texts(rules.DEFAULT_SEPARATORS)} END END AS seps
    FROM sized s WHERE {sql_strip('content')} <> '' AND NOT (lower({NAME}) = 'readme.md' AND ord < (SELECT max(f.ord) FROM files f WHERE f.repo = s.repo AND f.commit_sha = s.commit_sha AND lower({NAME.replace('path', 'f.path')}) = 'readme.md'))),
  node AS (SELECT ord, CAST([] AS INT[]) AS key, content AS t, seps, size_, overlap FROM whole
    UNION ALL SELECT ord, list_append(key, i), piece, finer, size_, overlap FROM (SELECT *, unnest(pieces) AS piece, CAST(generate_subscripts(pieces, 1) AS INT) AS i FROM ({_CUT})) WHERE length(piece) >= size_ AND len(finer) > 0),
  pieces AS (SELECT *, count(*) FILTER (WHERE long) OVER (PARTITION BY ord, key ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, length(piece) >= size_ AS long FROM (SELECT *, unnest(pieces) AS piece, CAST(generate_subscripts(pieces, 1) AS INT) AS i FROM ({_CUT})))),
  runs AS (SELECT ord, key, min(i) AS i, size_, overlap, list(piece ORDER BY i) AS p, list_prepend(0, list(before ORDER BY i)) AS pre
    FROM (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY ord, key, run ORDER BY i) AS BIGINT) AS before FROM pieces WHERE NOT long) GROUP BY ord, key, run, size_, overlap),
  packs AS (SELECT ord, key, i, size_, overlap, p, pre, 1 AS first, 0 AS nth, len(list_filter(pre[2:], lambda x: x <= size_)) AS last FROM runs
    UNION ALL SELECT ord, key, i, size_, overlap, p, pre, first, nth, first - 1 + len(list_filter(pre[first + 1:], lambda x: x - pre[first] <= size_)) FROM
      (SELECT ord, key, i, size_, overlap, p, pre, nth + 1 AS nth, first + len(list_filter(pre[first:last], lambda x: pre[last + 1] - x > overlap OR pre[last + 2] - x > size_)) AS first FROM packs WHERE last < len(p))),
  made AS (SELECT ord, list_append(key, i) AS key, nth, {sql_strip("array_to_string(p[first:last], '')")} AS content FROM packs
    UNION ALL SELECT ord, list_append(key, i), 0, {sql_strip('piece')} FROM pieces WHERE long AND len(finer) = 0),
  chunked AS (SELECT f.repo, f.commit_sha, f.path, {README_TYPE.replace('path', 'f.path')} AS file_type, m.content,
      CAST(row_number() OVER (PARTITION BY m.ord ORDER BY m.key, m.nth) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY m.ord) AS INTEGER) AS total_chunks
    FROM made m JOIN files f ON f.ord = m.ord WHERE length(m.content) > {rules.MIN_CHUNK_CHARS})"""


@query(
    f"""WITH RECURSIVE {FILES}, {RECURSIVE} SELECT repo, commit_sha, path, sha1(concat_ws(':', repo, commit_sha, path, CAST(chunk_index AS VARCHAR))) AS chunk_id,
    file_type, chunk_index, total_chunks, content FROM chunked"""
)
def recursive_chunks(spark, sf_dir):
    """Separator-aware chunks of every file."""
    return chunks.chunk_files(corpus(spark, sf_dir)).select(
        *K, "path", "chunk_id", "file_type", "chunk_index", "total_chunks", "content"
    )


_BLOCK = f"sha1({sql_strip(f'regexp_replace(content, {chr(39)}{SPACE}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')})"


@query(
    f"""SELECT block, count(DISTINCT doc_id) AS files, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_doc
    FROM (SELECT doc_id, {_BLOCK.replace('content', 'text')} AS block FROM documents) GROUP BY block HAVING count(DISTINCT doc_id) > 1"""
)
def duplicate_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.lit("all").alias("repo"), F.col("doc_id").alias("path"), F.lit(0).alias("chunk_index"), F.col("text").alias("content")
    )
    found = chunks.duplicate_blocks(docs, ["repo"])
    return found.select("block", "files", "copies", F.col("first_path").alias("first_doc"))


@query(
    rf"""SELECT block, count(DISTINCT doc_id) AS files, CAST(count(*) AS BIGINT) AS copies FROM (SELECT doc_id, sha1({sql_strip("regexp_replace(unnest(string_split(text, chr(10))), '" + SPACE + "+', ' ', 'g')")}) AS block FROM documents)
    GROUP BY block HAVING count(DISTINCT doc_id) > 1"""
)
def duplicate_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(
        F.lit("all").alias("repo"), F.col("doc_id").alias("path"),
        F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"),
    )
    return chunks.duplicate_blocks(lines, ["repo"]).select("block", "files", "copies")


# Every document is a file, and so is a revision of it: whole text and some words more.
REVISED = "concat(text, ' ', repeat(concat('rev', CAST(doc_id AS STRING), ' '), CAST(doc_id % 40 AS INT)))"
_WORDS = f"string_split({sql_strip(f'regexp_replace(content, {chr(39)}{SPACE}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, ' ')"


@query(
    f"""WITH RECURSIVE b AS (SELECT concat('a/', doc_id) AS path, text AS content FROM documents UNION ALL SELECT concat('b/', doc_id), {REVISED} FROM documents),
    w AS (SELECT path, {_WORDS} AS w FROM b), s AS (SELECT DISTINCT path, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT path, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE w[1] <> '')),
    n AS (SELECT path, count(*) AS n FROM s GROUP BY path),
    l AS (SELECT a, b FROM (SELECT x.path AS a, y.path AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.path <> y.path GROUP BY ALL) JOIN n p ON p.path = a JOIN n q ON q.path = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
    r AS (SELECT path AS a, path AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a)
    SELECT a AS path, min(root) AS first_path FROM r GROUP BY a HAVING count(*) > 1"""
)
def near_copies(spark, sf_dir):
    """Blocks that share four fifths of their five-word shingles, all documents and their revisions."""
    docs = table(spark, sf_dir, "documents")
    both = docs.select(
        F.explode(F.array(
            F.struct(F.concat(F.lit("a/"), "doc_id").alias("path"), F.col("text").alias("content")),
            F.struct(F.concat(F.lit("b/"), "doc_id").alias("path"), F.expr(REVISED).alias("content")),
        )).alias("f")
    ).select(F.lit("all").alias("repo"), "f.path", F.lit(0).alias("chunk_index"), "f.content")
    return near.near_duplicates(both, ["repo"]).members.select("path", "first_path")


ROUTE = chunks.ROUTE.replace("'", "''")


@query(
    f"""WITH {FILES}, routes AS (SELECT repo, commit_sha, lower({NAME}) = 'readme.md' AS claimed, unnest(regexp_extract_all(content, '{ROUTE}', 1)) AS route FROM files)
    SELECT repo, commit_sha, route FROM routes GROUP BY ALL HAVING bool_or(claimed) AND NOT bool_or(NOT claimed)"""
)
def unbacked_claims(spark, sf_dir):
    return chunks.unbacked_claims(files(spark, sf_dir))


# --- vectors ------------------------------------------------------------------------------


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"),
        "embedding", "label", (F.col("vec_id") % 2 == 0).alias("even"),
    )


def centroids(spark, sf_dir):
    """The mean vector of each label, as the query of its collection."""
    parts = vectors(spark, sf_dir).select("collection", F.posexplode("embedding").alias("pos", "x"))
    mean = parts.groupBy("collection", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("collection").agg(
        F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")
    ).select(F.col("collection").alias("query_id"), "collection", F.col("p.x").alias("embedding"))


CENTROIDS = """parts AS (SELECT concat('c', label) AS collection, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
  queries AS (SELECT collection, list(x ORDER BY pos) AS q FROM (SELECT collection, pos, avg(CAST(x AS DOUBLE)) AS x FROM parts GROUP BY ALL) GROUP BY collection),
  scored AS (SELECT e.vec_id AS id, q.collection AS query_id, e.vec_id % 2 = 0 AS even, round_even(list_cosine_similarity(q.q, CAST(e.embedding AS DOUBLE[])), 4) AS similarity
    FROM embeddings e JOIN queries q ON q.collection = concat('c', e.label))"""


@query(
    f"""WITH {CENTROIDS} SELECT query_id, id, similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM scored) WHERE rank <= 15"""
)
def top_k_cosine(spark, sf_dir):
    hits = retrieval.top_k(centroids(spark, sf_dir), vectors(spark, sf_dir))
    return hits.select("query_id", "id", "similarity", "rank")


# Every vector of the table asks in one collection of all.
_EVERY = """asked AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0),
  near AS (SELECT a.q, v.vec_id AS id, round_even(list_cosine_similarity(a.e, CAST(v.embedding AS DOUBLE[])), 4) AS similarity FROM asked a, embeddings v)"""


@query(
    f"""WITH {_EVERY} SELECT CAST(q AS VARCHAR) AS query_id, CAST(id AS VARCHAR) AS id, similarity, rank FROM
    (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM near) WHERE rank <= 10"""
)
def pruned_top_k(spark, sf_dir):
    """Top-k in cells: a fiftieth of the vectors as queries against all of them."""
    rows = vectors(spark, sf_dir).withColumn("collection", F.lit("all"))
    asked = rows.filter(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "collection", "embedding")
    return cells.top_k(asked, cells.build_cells(rows), 10, "bigint").hits.select("query_id", "id", "similarity", "rank")


@query(
    f"""WITH {CENTROIDS} SELECT query_id, CAST(id AS VARCHAR) AS id, similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM scored) WHERE rank <= 15"""
)
def pruned_top_k_by_collection(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found = cells.top_k(centroids(spark, sf_dir), cells.build_cells(rows), id_type="bigint").hits
    return found.select("query_id", "id", "similarity", "rank")


@query(
    f"""WITH {CENTROIDS} SELECT query_id, id, similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM scored WHERE even) WHERE rank <= 8"""
)
def top_k_with_metadata(spark, sf_dir):
    hits = retrieval.top_k(centroids(spark, sf_dir), vectors(spark, sf_dir), 8, {"even": True})
    return hits.select("query_id", "id", "similarity", "rank")


@query(
    f"""WITH {CENTROIDS}, hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM scored)
    SELECT query_id, string_agg(concat('### v', id, chr(10), 'label ', query_id), chr(10) || chr(10) ORDER BY rank) AS context FROM hits WHERE rank <= 5 GROUP BY query_id"""
)
def assembled_context(spark, sf_dir):
    hits = retrieval.top_k(centroids(spark, sf_dir), vectors(spark, sf_dir), 5)
    shown = hits.withColumns(
        {"path": F.concat(F.lit("v"), F.col("id").cast("string")), "content": F.concat(F.lit("label "), "collection")}
    )
    return retrieval.assemble_context(shown, ["query_id"])


def vector_runs(spark, sf_dir):
    """Runs that point at collections; every fourth has no commit."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("user_id"), F.concat(F.lit("o/"), "lang").alias("repo_name"),
        F.when(F.col("doc_id") % 4 != 0, F.md5(F.col("n_chars").cast("string"))).alias("repo_sha"),
    )


_KEY = "concat('cc-', sha1(concat('=', source, chr(10), '=o/', lang, chr(10), '=', md5(CAST(n_chars AS VARCHAR)))))"
_REFS = f"""refs AS (SELECT DISTINCT {_KEY} AS collection FROM documents WHERE doc_id % 4 <> 0),
  stored AS (SELECT doc_id AS id, {_KEY} AS collection FROM documents)"""


def stored_vectors(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.expr(_KEY.replace("VARCHAR", "STRING")).alias("collection")
    )


@query(f"WITH {_REFS} SELECT collection FROM refs WHERE collection IN (SELECT collection FROM stored)")
def existing_collections(spark, sf_dir):
    return tables.index_exists(tables.index_refs(vector_runs(spark, sf_dir)), stored_vectors(spark, sf_dir))


@query(f"WITH {_REFS} SELECT id, collection FROM stored WHERE collection NOT IN (FROM refs)")
def index_after_drop(spark, sf_dir):
    return tables.drop_index(stored_vectors(spark, sf_dir), tables.index_refs(vector_runs(spark, sf_dir)))


@query(f"WITH {_REFS}, half AS (SELECT DISTINCT collection FROM stored WHERE id % 2 = 0) SELECT id, collection FROM stored WHERE id % 2 = 0 OR collection NOT IN (FROM half)")
def index_built_twice(spark, sf_dir):
    """Even rows first, then everything: collections already there keep what they have."""
    path = new_table_path(spark, "index")
    rows = stored_vectors(spark, sf_dir)
    tables.build_index(spark, path, rows.filter(F.col("id") % 2 == 0))
    tables.build_index(spark, path, rows)
    return spark.read.parquet(path).select("id", "collection")


@query()
def embedded_chunks(spark, sf_dir):
    """Chunks of the corpus with the default encoder; floating point, so no SQL twin."""
    rows = corpus(spark, sf_dir)
    made = chunks.window_chunks(rows)
    encoder = retrieval.fit_encoder(made)
    return retrieval.embed(made, encoder).select("chunk_id", "path", F.size("embedding").alias("dimensions"))


def measure(df):
    """An encoder that SQL can state: letters, lines and words of a text."""
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    blanks = F.length("content") - F.length(F.replace("content", F.lit(" "), F.lit("")))
    counts = F.array(F.length("content"), lines, blanks).cast("array<float>")
    return df.withColumn("embedding", counts)


MEASURED = f"""WITH {FILES}, {WINDOWS} SELECT ord, chunk_index, CAST(length(content) AS DOUBLE) AS letters, CAST(length(content) - length(replace(content, chr(10), '')) AS DOUBLE) AS lines,
  CAST(length(content) - length(replace(content, ' ', '')) AS DOUBLE) AS blanks FROM windows"""


def measured(spark, sf_dir, costly):
    made = retrieval.embed(chunks.window_chunks(corpus(spark, sf_dir)), measure, costly)
    names = ["letters", "lines", "blanks"]
    values = [F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate(names)]
    return made.select("ord", "chunk_index", *values)


@query(MEASURED)
def measured_chunks(spark, sf_dir):
    return measured(spark, sf_dir, False)


@query(MEASURED)
def measured_copies(spark, sf_dir):
    """The same, every distinct text encoded once."""
    return measured(spark, sf_dir, True)


def two_commits(spark, sf_dir):
    """Every document in a first commit, and in a second where one in five has changed."""
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    place = [F.concat(F.lit("f"), "doc_id").alias("path"), F.lit(0).alias("chunk_index")]
    one = docs.select(F.concat(F.lit("1-"), "source").alias("collection"), F.concat(F.lit("1-"), "doc_id").alias("id"), *place, F.col("text").alias("content"))
    two = docs.select(F.concat(F.lit("2-"), "source").alias("collection"), F.concat(F.lit("2-"), "doc_id").alias("id"), *place, changed.alias("content"))
    return one, two


def stored_commits(spark, sf_dir):
    store = V.open_store(spark, new_table_path(spark, "vectors"), buckets=16)
    one, two = two_commits(spark, sf_dir)
    V.add_collections(store, one, measure)
    V.add_collections(store, one.unionByName(two), measure)  # the first is there already
    return store


COMMITS = "commits AS (SELECT concat('1-', source) AS collection, concat('1-', doc_id) AS id, text AS content FROM documents UNION ALL SELECT concat('2-', source), concat('2-', doc_id), CASE WHEN doc_id % 5 = 0 THEN concat(text, ' changed') ELSE text END FROM documents)"


@query(f"WITH {COMMITS} SELECT collection, id, sha1(content) AS text_key FROM commits")
def stored_references(spark, sf_dir):
    return stored_commits(spark, sf_dir).references.frame(spark).select("collection", "id", "text_key")


@query(f"WITH {COMMITS} SELECT DISTINCT sha1(content) AS text_key, length(content) AS letters FROM commits")
def stored_texts(spark, sf_dir):
    """Every text of both commits once, with its vector."""
    texts = stored_commits(spark, sf_dir).texts.frame(spark)
    return texts.select("text_key", F.element_at("embedding", 1).cast("bigint").alias("letters"))


@query(f"WITH {COMMITS} SELECT collection, id, content, CAST(length(content) AS DOUBLE) AS letters FROM commits WHERE collection LIKE '2-%'")
def read_vectors(spark, sf_dir):
    store = stored_commits(spark, sf_dir)
    asked = table(spark, sf_dir, "documents").select(F.concat(F.lit("2-"), "source").alias("collection"))
    found = V.read_collections(store, asked)
    return found.select("collection", "id", "content", F.element_at("embedding", 1).cast("double").alias("letters"))


KINDS_ = 16


def counted_words(df):
    """An encoder that SQL can state: words by first letter and length."""
    words = F.filter(F.split("content", " "), lambda w: w != "")
    kind = lambda w: (F.ascii(w) + F.length(w)) % KINDS_
    spread = df.withColumn("kinds", F.transform(words, kind))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k))
    counts = [count(k) for k in range(KINDS_)]
    return spread.withColumn("embedding", F.array(*counts).cast("array<float>")).drop("kinds")


_KINDS = f"list_transform(list_filter(string_split(content, ' '), lambda w: w <> ''), lambda w: (unicode(w) + length(w)) % {KINDS_})"
_COUNTED = "[" + ", ".join(f"CAST(len(list_filter(kinds, lambda x: x = {k})) AS DOUBLE)" for k in range(KINDS_)) + "]"
_PLACED = "sha1(concat_ws(':', repo, commit_sha, path, CAST(chunk_index AS VARCHAR)))"


@query(
    f"""WITH {FILES}, {WINDOWS}, held AS (SELECT repo, commit_sha, path, content, {_PLACED} AS id, {_KINDS} AS kinds FROM windows),
    stored AS (SELECT *, {_COUNTED} AS e FROM held), asked AS (SELECT repo, commit_sha, arg_min(content, ord) AS content FROM files GROUP BY ALL),
    questions AS (SELECT repo, commit_sha, {_COUNTED} AS q FROM (SELECT repo, commit_sha, {_KINDS} AS kinds FROM asked)),
    scored AS (SELECT s.repo, s.commit_sha, s.path, s.content, s.id, round_even(coalesce(CASE WHEN list_sum(q.q) > 0 AND list_sum(s.e) > 0 THEN list_cosine_similarity(q.q, s.e) END, 0), 4) AS similarity
      FROM stored s JOIN questions q USING (repo, commit_sha)),
    hits AS (SELECT *, row_number() OVER (PARTITION BY repo, commit_sha ORDER BY similarity DESC, id) AS rank FROM scored)
    SELECT concat(repo, '@', commit_sha) AS query_id, string_agg(concat('### ', path, chr(10), content), chr(10) || chr(10) ORDER BY rank) AS context FROM hits WHERE rank <= 8 GROUP BY ALL"""
)
def answered_questions(spark, sf_dir):
    """A question per repository and commit through the whole second phase: chunks, stored vectors,
    cells, ranking, context."""
    rows = corpus(spark, sf_dir)
    store = V.open_store(spark, new_table_path(spark, "store"), buckets=16)
    deepen.index_commits(rows, store, counted_words, windows=True)
    asked = rows.groupBy(*K).agg(F.min_by("content", "ord").alias("content"))
    questions = asked.select(
        F.concat_ws("@", *K).alias("query_id"),
        deepen.P.collection_key(F.lit("shared"), F.col("repo"), F.col("commit_sha")).alias("collection"), "content",
    )
    return deepen.answer(questions, store, counted_words, 8).select("query_id", "context")


@query()
def retrieved_contexts(spark, sf_dir):
    """A question per repository and commit, answered from its own collection."""
    rows = corpus(spark, sf_dir)
    encoder = retrieval.fit_encoder(rows)
    found = deepen.build_vectors(rows, encoder)
    questions = rows.groupBy(*K).agg(F.min_by("content", "ord").alias("content"))
    asked = questions.select(
        F.concat_ws("@", *K).alias("query_id"),
        deepen.P.collection_key(F.lit("shared"), F.col("repo"), F.col("commit_sha")).alias("collection"),
        "content",
    )
    return deepen.retrieve(asked, found, encoder, 8)
