"""Files to overlapping chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import paths as P
from assayer.functions import text as T
from assayer.operators import KEY
from assayer.session import small_side

CHUNKED = (
    "repo string, commit_sha string, ord long, path string, sha string, language string, "
    "file_type string, chunk_index int, total_chunks int, content string"
)


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of ``text``, each but the first starting with ``separator``."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [piece for piece in (head, *(separator + rest for rest in tail)) if piece]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to ``size``; the next chunk repeats up to ``overlap``."""
    held: deque[str] = deque()
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.popleft())
        held.append(piece)
        length += len(piece)
    if held:
        yield "".join(held)


def split_text(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    """Recursive separator-aware splitting: the first separator that occurs cuts the text,
    pieces still too long are cut by the finer ones, short neighbours are packed together."""
    usable = [i for i, s in enumerate(separators) if not s or s in text]
    chosen = usable[0] if usable else len(separators) - 1
    finer = separators[chosen + 1 :] if separators[chosen] else []
    chunks: list[str] = []
    short: list[str] = []
    for piece in _cut(text, separators[chosen]):
        if len(piece) < size:
            short.append(piece)
            continue
        chunks += _pack(short, size, overlap)
        short = []
        chunks += split_text(piece, finer, size, overlap) if finer else [piece]
    chunks += _pack(short, size, overlap)
    return [chunk for chunk in (c.strip() for c in chunks) if chunk]


def _chunk_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in CHUNKED.split(", ")]
    for batch in batches:
        rows = []
        for file in batch.itertuples(index=False):
            pieces = split_text(
                file.content, list(file.separators), file.chunk_size, file.chunk_overlap
            )
            kept = [p for p in pieces if len(p) > rules.MIN_CHUNK_CHARS]
            head = (file.repo, file.commit_sha, file.ord, file.path, file.sha, file.language, file.file_type)
            rows += [(*head, i, len(kept), piece) for i, piece in enumerate(kept)]
        yield pd.DataFrame(rows, columns=columns)


def _separators(path: Column, language: Column) -> Column:
    def lit_array(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    chosen = lit_array(rules.DEFAULT_SEPARATORS)
    # Keyed by the raw suffix, so ``py`` files use the default list; kept as audited.
    for name, values in rules.LANGUAGE_SEPARATORS.items():
        chosen = F.when(F.lower(language) == name, lit_array(values)).otherwise(chosen)
    return F.when(P.is_readme(path), lit_array(rules.README_SEPARATORS)).otherwise(chosen)


def file_type(path: Column | str) -> Column:
    return F.when(P.is_readme(path), F.lit("readme")).otherwise(F.lit("code"))


def without_superseded_readmes(files: DataFrame) -> DataFrame:
    """Keep one README per repository, the last in tree order.

    The anti-join side holds READMEs of repositories that have several, metadata only.
    """
    readmes = files.filter(P.is_readme("path")).select(*KEY, "ord")
    last = readmes.groupBy(*KEY).agg(F.max("ord").alias("last"))
    superseded = readmes.join(last, KEY).filter(F.col("ord") < F.col("last")).select(*KEY, "ord")
    return files.join(small_side(superseded), [*KEY, "ord"], "left_anti")


def _described(chunks: DataFrame) -> DataFrame:
    place = F.concat_ws(":", *KEY, "path", F.col("chunk_index").cast("string"))
    return chunks.withColumns(
        {
            "chunk_id": F.sha1(place),
            "file_name": P.path_name("path"),
            "directory": P.path_parent("path"),
        }
    )


def chunk_files(files: DataFrame) -> DataFrame:
    """Separator-aware chunks with their metadata; numbers count chunks that are kept.

    Sizes, overlaps and separators are chosen in Spark; Python only cuts the text of one file
    at a time.
    """
    prepared = without_superseded_readmes(files).filter(~T.is_blank("content"))
    path, language = F.col("path"), F.col("language")
    return _described(
        prepared.select(
            *KEY, "ord", "path", "sha", "language", file_type("path").alias("file_type"),
            "content",
            _separators(path, language).alias("separators"),
            P.chunk_params("path")["chunk_size"].alias("chunk_size"),
            P.chunk_params("path")["chunk_overlap"].alias("chunk_overlap"),
        ).mapInPandas(_chunk_batches, CHUNKED)
    )


def window_chunks(files: DataFrame, size: Column | None = None, overlap: Column | None = None) -> DataFrame:
    """Fixed windows with overlap, entirely inside Spark; short windows are dropped before
    numbering."""
    sized = files.withColumns(
        {
            "_size": P.chunk_params("path")["chunk_size"] if size is None else size,
            "_overlap": P.chunk_params("path")["chunk_overlap"] if overlap is None else overlap,
        }
    )
    step = F.col("_size") - F.col("_overlap")
    length = F.char_length("content")
    last_start = F.greatest(length - F.col("_overlap") - 1, F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(0), last_start, step),
        lambda start: F.substring(F.col("content"), start + 1, F.col("_size")),
    )
    kept = F.filter(windows, lambda w: T.stripped_longer_than(w, rules.MIN_CHUNK_CHARS))
    return _described(
        sized.select(*KEY, "ord", "path", "sha", "language", file_type("path").alias("file_type"), kept.alias("kept"))
        .select(
            *KEY, "ord", "path", "sha", "language", "file_type",
            F.size("kept").alias("total_chunks"),
            F.posexplode("kept").alias("chunk_index", "content"),
        )
    )


def split_readme(files: DataFrame) -> DataFrame:
    return files.withColumn("file_type", file_type("path"))


def chunk_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files, chunks and whether a README produced any."""
    totals = files.groupBy(*KEY).agg(F.count("*").alias("total_files"))
    made = chunks.groupBy(*KEY).agg(
        F.count("*").alias("total_chunks"),
        F.bool_or(F.col("file_type") == "readme").alias("readme_found"),
    )
    return totals.join(made, KEY, "left").select(
        *KEY,
        "total_files",
        F.coalesce("total_chunks", F.lit(0).cast("long")).alias("total_chunks"),
        F.coalesce("readme_found", F.lit(False)).alias("readme_found"),
    )


def duplicate_blocks(chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Blocks whose normalised text occurs in different files of one scope.

    Copies are summarised, never paired: counts and the first place are partial aggregates, so
    a block copied a billion times still reaches the final step as a few rows.
    """
    keys = KEY if keys is None else keys
    block = F.sha1(T.strip(F.regexp_replace("content", f"{T.SPACE}+", " ")))
    per_file = (
        chunks.withColumn("block", block)
        .groupBy(*keys, "block", "path")
        .agg(F.count("*").alias("n"), F.min("chunk_index").alias("chunk_index"))
    )
    return (
        per_file.groupBy(*keys, "block")
        .agg(
            F.count("*").alias("files"),
            F.sum("n").alias("copies"),
            F.min(F.struct("path", "chunk_index")).alias("first"),
        )
        .filter(F.col("files") > 1)
        .select(
            *keys, "block", "files", "copies",
            F.col("first.path").alias("first_path"), F.col("first.chunk_index").alias("first_index"),
        )
    )


ROUTE = r"(?:^|[\s\"'`(=])(/[A-Za-z0-9_{}:-]+(?:/[A-Za-z0-9_{}:-]+)+)"


def unbacked_claims(files: DataFrame) -> DataFrame:
    """Route-like tokens a README names that no code file of the repository contains."""
    tokens = files.select(
        *KEY,
        P.is_readme("path").alias("claimed"),
        F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(ROUTE), F.lit(1)))).alias("route"),
    )
    return (
        tokens.groupBy(*KEY, "route")
        .agg(F.bool_or("claimed").alias("claimed"), F.bool_or(~F.col("claimed")).alias("backed"))
        .filter(F.col("claimed") & ~F.col("backed"))
        .select(*KEY, "route")
    )
