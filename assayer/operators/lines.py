"""Files to lines, and the facts a line carries.

``line_hits`` is the one pass over file contents: it splits only files that can hold a fact and
keeps only lines that do, so what reaches a shuffle is a small fraction of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import paths as P
from assayer.functions import text as T
from assayer.operators import KEY

SecretRule = tuple[str, str, str]


def _exploded(split: DataFrame, *kept: str) -> DataFrame:
    """Rows with ``parts`` to lines; the split is its own projection so that it runs once."""
    return split.select(
        *KEY, "ord", "path", *kept, F.posexplode(T.drop_last(F.col("parts"))).alias("pos", "line")
    )


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    split = files.select(*KEY, "ord", "path", T.split_lines("content").alias("parts"))
    return _exploded(split).select(
        *KEY, "ord", "path", (F.col("pos") + 1).alias("line_no"), "line"
    )


# --- what one line can say ----------------------------------------------------------------


def secret_rule(line: Column, secret_rules: list[SecretRule]) -> Column:
    """First rule that matches, in table order; null for placeholder lines."""
    chain = F.when(line.rlike("(?iu)" + rules.PLACEHOLDER_PATTERN), F.lit(None).cast("string"))
    for name, pattern, _ in secret_rules:
        chain = chain.when(line.rlike(pattern), F.lit(name))
    return chain


def secret_severity(rule: Column, secret_rules: list[SecretRule]) -> Column:
    chain = F.lit("low")
    for name, _, severity in secret_rules:
        chain = F.when(rule == name, F.lit(severity)).otherwise(chain)
    return chain


def _depends_on_line_ends(pattern: str) -> bool:
    bare = pattern.replace("[^", "[")
    return any(mark in bare for mark in ("^", "$", r"\A", r"\Z", r"\z", "(?", r"\b", r"\B"))


def secret_hint(text: Column, secret_rules: list[SecretRule], whole_file: bool) -> Column:
    """False only where no rule can match: a search for fixed pieces of the patterns.

    Rules without a known piece are matched as they are, except that on a whole file a pattern
    with anchors or look-around may miss what it would find in a line, so it lets all pass.
    """
    found = F.lit(False)
    for name, pattern, _ in secret_rules:
        piece = rules.SECRET_PIECES.get(name)
        if piece:
            found = found | F.contains(text, F.lit(piece))
        elif whole_file and _depends_on_line_ends(pattern):
            return F.lit(True)
        else:
            found = found | text.rlike(pattern)
    return found


def link_targets(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(rules.LINK_PATTERN), F.lit(1))


def env_reads(line: Column) -> Column:
    """``array<struct<pattern, pos, name>>`` in pattern order, then position."""
    def numbered(number: int, pattern: str) -> Column:
        names = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
        return F.transform(
            names,
            lambda name, pos: F.struct(
                F.lit(number).alias("pattern"), pos.alias("pos"), name.alias("name")
            ),
        )

    found = [numbered(n, p) for n, p in enumerate(rules.ENV_READ_PATTERNS)]
    return F.filter(
        F.flatten(F.array(*found)), lambda hit: hit["name"].rlike(rules.ENV_NAME_PATTERN)
    )


MAY_READ_ENV = ["os.getenv", "os.environ", "process.env", "import.meta.env", "ENV["]


def may_read_env(text: Column) -> Column:
    """A search for fixed pieces: many times faster over whole contents than one pattern of them."""
    found = F.contains(text, F.lit(MAY_READ_ENV[0]))
    for piece in MAY_READ_ENV[1:]:
        found = found | F.contains(text, F.lit(piece))
    return found


def env_declaration(line: Column) -> Column:
    """Variable a template line declares, else null."""
    stripped = T.strip(line)
    name = F.regexp_extract(stripped, rules.ENV_DECLARATION_PATTERN, 1)
    declares = ~F.startswith(stripped, F.lit("#")) & name.rlike(rules.ENV_NAME_PATTERN)
    return F.when(declares, name)


def upper_tokens(line: Column) -> Column:
    """Whole upper-case words; words are runs of letters, digits and underscores."""
    words = F.split(line, r"[^\p{L}\p{N}_]+", -1)
    return F.array_distinct(F.filter(words, lambda w: w.rlike(rules.ENV_NAME_PATTERN)))


def requirement_kind(line: Column) -> Column:
    """``pinned`` or ``loose`` for a requirement, null for a line that is none."""
    stripped = T.strip(line)
    return F.when(stripped.rlike(rules.IGNORED_REQUIREMENT), F.lit(None).cast("string")).when(
        stripped.rlike(rules.PINNED_REQUIREMENT), F.lit("pinned")
    ).otherwise(F.lit("loose"))


def ignore_rule_text(line: Column) -> Column:
    """A rule line of an ignore file, null for blanks and comments."""
    stripped = T.strip(line)
    return F.when((stripped != "") & ~F.startswith(stripped, F.lit("#")), line)


# --- one pass over contents ---------------------------------------------------------------

HIT_KINDS = ("secret", "links", "env", "declared", "tokens", "requirement")


def line_hits(
    files: DataFrame,
    kinds: tuple[str, ...] = HIT_KINDS,
    secret_rules: list[SecretRule] | None = None,
) -> DataFrame:
    """Lines that carry at least one of the requested facts, facts as columns.

    Columns per kind: ``secret_rule``; ``links``; ``env_reads``; ``declared``; ``tokens``;
    ``requirement``.  A fact that does not apply to a file's kind is null there.
    """
    secret_rules = rules.SECRET_RULES if secret_rules is None else secret_rules
    path, content, line = "path", F.col("content"), F.col("line")

    applies = {
        "secret": ~P.is_env_template(path) & secret_hint(content, secret_rules, whole_file=True),
        "links": P.is_markdown(path) & F.contains(content, F.lit("](")),
        "env": ~P.is_markdown(path) & ~P.is_test_path(path) & may_read_env(content),
        "declared": P.is_env_template(path),
        "tokens": P.is_markdown(path),
        "requirement": P.path_name(path) == rules.REQUIREMENTS_FILE,
    }
    extract = {
        "secret": ("secret_rule", secret_rule(line, secret_rules)),
        "links": ("links", link_targets(line)),
        "env": ("env_reads", env_reads(line)),
        "declared": ("declared", env_declaration(line)),
        "tokens": ("tokens", upper_tokens(line)),
        "requirement": ("requirement", requirement_kind(line)),
    }
    in_line = {
        "secret": secret_hint(line, secret_rules, whole_file=False),
        "links": F.contains(line, F.lit("](")),
        "env": may_read_env(line),
        "declared": F.contains(line, F.lit("=")),
        "tokens": line.rlike("[A-Z]{3}|[A-Z][A-Z0-9_]{2}"),
        "requirement": F.lit(True),
    }

    flagged = files.select(
        *KEY, "ord", "path", "content", *[applies[k].alias(f"is_{k}") for k in kinds]
    )
    wanted = F.lit(False)
    for kind in kinds:
        wanted = wanted | F.col(f"is_{kind}")
    flags = [f"is_{k}" for k in kinds]
    split = flagged.filter(wanted).select(
        *KEY, "ord", "path", *flags, T.split_lines("content").alias("parts")
    )
    lines = _exploded(split, *flags)
    # Cheap per-line tests first; the exact extraction only runs on lines that pass one.
    candidate = F.lit(False)
    for kind in kinds:
        candidate = candidate | (F.col(f"is_{kind}") & in_line[kind])
    facts = lines.filter(candidate).select(
        *KEY,
        "ord",
        "path",
        (F.col("pos") + 1).alias("line_no"),
        "line",
        *[
            F.when(F.col(f"is_{k}") & in_line[k], extract[k][1]).alias(extract[k][0])
            for k in kinds
        ],
    )
    found = F.lit(False)
    for kind in kinds:
        column = F.col(extract[kind][0])
        is_list = kind in ("links", "env", "tokens")
        found = found | (F.coalesce(F.size(column), F.lit(0)) > 0 if is_list else column.isNotNull())
    return facts.filter(found)
