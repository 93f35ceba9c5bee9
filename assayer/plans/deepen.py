"""Retrieval and the model-assisted second phase."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import paths as P
from assayer.operators import KEY, cells, chunks, retrieval, verdicts
from assayer.operators.retrieval import Encoder
from assayer.session import materialize
from assayer.sources.vectors import VectorStore, add_collections, read_collections


def build_vectors(files: DataFrame, encoder: Encoder, user_id: str = "shared") -> DataFrame:
    """Chunks of all files with their embeddings, keyed by collection."""
    made = chunks.chunk_files(files)
    name = P.collection_key(F.lit(user_id), F.col("repo"), F.col("commit_sha"))
    return retrieval.embed(made.withColumn("collection", name), encoder).withColumnRenamed("chunk_id", "id")


def retrieve(
    questions: DataFrame, vectors: DataFrame, encoder: Encoder, k: int = rules.TOP_K
) -> DataFrame:
    """Question texts to prompt contexts: ``(query_id, collection, content)`` in, context out."""
    keyed = questions.withColumn("text_key", F.sha1("content"))
    asked = encoder(keyed).select("query_id", "collection", "embedding")
    hits = retrieval.top_k(asked, vectors, k)
    return retrieval.assemble_context(hits, ["query_id", "collection"])


def index_commits(files: DataFrame, store: VectorStore, encoder: Encoder, user_id: str = "shared", windows: bool = False) -> None:
    """Index the chunks of all files: texts that the store knows are not encoded again.

    Chunks are separator-aware, or fixed ``windows``.
    """
    made = chunks.window_chunks(files) if windows else chunks.chunk_files(files)
    name = P.collection_key(F.lit(user_id), F.col("repo"), F.col("commit_sha"))
    named = made.select(name.alias("collection"), F.col("chunk_id").alias("id"), "path", "chunk_index", "content")
    add_collections(store, named, encoder)


def answer(questions: DataFrame, store: VectorStore, encoder: Encoder, k: int = rules.TOP_K) -> DataFrame:
    """``(query_id, collection, content)`` to prompt contexts, from the stored collections.

    The best chunks are found in cells, exactly; contents join the hits, at most ``k`` a question.
    """
    found = materialize(read_collections(store, questions), "vectors")
    asked = encoder(questions.withColumn("text_key", F.sha1("content"))).select("query_id", "collection", "embedding")
    hits = cells.top_k(asked, cells.build_cells(found), k).hits
    shown = hits.join(found.select("collection", "id", "path", "content"), ["collection", "id"])
    return retrieval.assemble_context(shown, ["query_id", "collection"])


@dataclass
class Deepened:
    issues: DataFrame
    statuses: DataFrame
    verdicts: DataFrame


def ai_merge(
    issues: DataFrame,
    statuses: DataFrame,
    answers: DataFrame,
    discovered: DataFrame,
    tracked: DataFrame,
    per_call: int = rules.MAX_FINDINGS_PER_CALL,
) -> Deepened:
    """Merge model answers into a scan: closed-list verdicts, then discoveries.

    ``issues`` carry ``place``, their order inside an axis; ``per_call`` is what the prompts were
    made with.  A rejected answer leaves the issues of its call as they are.
    """
    triage = issues.filter(F.col("axis").isin(rules.TRIAGE_AXES))
    decided = verdicts.validate_verdicts(answers, verdicts.submitted(triage, per_call))
    triaged = verdicts.apply_verdicts(triage, decided)
    merged, after = verdicts.merge_ai(issues, statuses, triaged, discovered, tracked)
    return Deepened(merged, after, decided)


def succeeded(answers_status: DataFrame) -> DataFrame:
    """Scans to charge: at least one agent did not end in error."""
    return verdicts.all_failed(answers_status, KEY).filter(~F.col("all_failed")).select(*KEY)
