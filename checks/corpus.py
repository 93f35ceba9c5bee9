"""The corpus that the queries audit, derived row by row from ``documents``.

Every document becomes one file: whole text, whole table, nothing filtered or folded.  A source
is a repository and a language one of its commits.  Blocks of 400 documents form a directory
level, so special file names (ignore files, READMEs, manifests) stay unique per repository and
share directories with other files.  A few lines are appended to the text, by file kind, so that
links, variables, requirements, ignore rules and credentials occur at all.

The expressions are SQL that Spark and DuckDB both read; ``~`` stands for a newline
in appended lines and ``<...>`` for values of the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import table

ID = "CAST(doc_id AS STRING)"
SLOT = "(CAST(floor(doc_id / 20) AS BIGINT) % 20)"
MODULE = "CAST(floor(doc_id / 400) AS BIGINT)"

# One entry per slot; ``#`` is the document id, ``@`` an extension.
NAMES = [
    "src/f#@", "docs/f#@", "tests/f#@", ".gitignore", "config/f#@", "README.md", "src/f#@",
    "config/.env", ".env.example", "requirements.txt", "config/f#@", "deploy/id_rsa", "src/f#@",
    "deploy/server.PEM", "docs/f#@", "package.json", "node_modules/pkg/f#.js",
    ".github/workflows/ci.yml", "logs/f#.log", "yarn.lock",
]
EXTENSIONS = [".py", ".js", ".md", ".json", ".txt", ".yml", ".go", ".png"]

_MARKDOWN = (
    "See [self](<name>) and [abs](/<path>#part) or [gone](gone#.md).~![pic](img.png) "
    "[site](https://example.com/a.md) [top](#top) [up](../../../../x.md) [q](missing.yml?raw=1)~"
    "Set SETTING_<n40> or DEBUG_MODE, call /api/v<n5>/items/list~"
)
# Lines appended to a text, by extension and by special name.
BY_EXTENSION = {
    ".py": "key = os.getenv('SETTING_<n41>')~opt = os.environ['OPTION_<n9>X'] or "
    "os.environ.get(\"PORT\")~get(\"/api/v<n2>/items/list\")~",
    ".js": "const k = process.env.SETTING_<n40> + process.env[\"NODE_ENV\"] + "
    "import.meta.env.VITE_KEY + process.env.lower~",
    ".md": _MARKDOWN,
    ".json": "\"placeholder\": \"AKIA<HEX>\"~",
    ".txt": "see ghp_<hex>abcd and sk-<hex>~",
    ".yml": "aws: AKIA<HEX>~  aws:  AKIA<HEX>~aws: AKIA<HEX>~",
    ".go": "dir = ENV[\"CACHE_DIR\"]~db = \"postgresql://svc:pw#@db.example.com/app\"~",
    ".png": "",
}
BY_NAME = {
    ".gitignore": "<rules>",
    "README.md": _MARKDOWN,
    ".env.example": "export SETTING_<n40>=1~OPTION_<n7>X=~# HIDDEN_VALUE=1~lower_name=2~PORT=80~",
    "requirements.txt": "<pins>alpha @ https://example.com/a~  beta == 2~-r base.txt~--no-index~~"
    "gamma>=1~delta~",
}
IGNORE_RULES = [
    "*.log~node_modules/~.env*~!.env.example~",
    "/deploy/~*.json~!package.json~.venv/~",
    "config/~logs/*~!logs/f*7.log~__pycache__/~",
    "/*~!/src/~!/docs/~build-[0-9]/~**/tmp/~",
]
KINDS = [BY_NAME.get(name, "") for name in NAMES] + [BY_EXTENSION[e] for e in EXTENSIONS]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def columns(dialect: str) -> dict[str, str]:
    """SQL of the file columns; the two engines differ in how they index a list and quote."""

    def literal(text: str) -> str:
        if dialect == "spark":
            return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return _quoted(text)

    def pick(values: list[str], index: str) -> str:
        listed = ", ".join(literal(v) for v in values)
        if dialect == "spark":
            return f"element_at(array({listed}), CAST({index} AS INT) + 1)"
        return f"list_value({listed})[CAST({index} AS INT) + 1]"

    extension = f"(({MODULE} * 3 + {SLOT}) % 8)"
    name = pick(NAMES, SLOT)
    prefix = f"CASE WHEN {MODULE} = 0 THEN '' ELSE concat('m', CAST({MODULE} AS STRING), '/') END"
    local = f"replace(replace({name}, '#', {ID}), '@', {pick(EXTENSIONS, extension)})"
    path = f"concat({prefix}, {local})"
    last = f"CASE WHEN {SLOT} = 5 THEN 'README.md' ELSE concat('f', {ID}, '.md') END"
    free = f"contains({name}, '@')"
    extra = pick(KINDS, f"CASE WHEN {free} THEN 20 + {extension} ELSE {SLOT} END")
    hexed = f"substr(md5({ID}), 1, 32)"
    for token, value in {
        "<rules>": pick(IGNORE_RULES, "doc_id % 4"),
        "<pins>": f"repeat('pkg==1.0~', CAST(doc_id % 12 AS INT))",
        "<path>": path,
        "<name>": last,
        "<n40>": "CAST(doc_id % 40 AS STRING)",
        "<n41>": "CAST((doc_id + 20) % 41 AS STRING)",
        "<n9>": "CAST(doc_id % 9 AS STRING)",
        "<n7>": "CAST(doc_id % 7 AS STRING)",
        "<n5>": "CAST(doc_id % 5 AS STRING)",
        "<n2>": "CAST(doc_id % 2 AS STRING)",
        "<hex>": hexed,
        "<HEX>": f"upper(substr({hexed}, 1, 16))",
        "#": ID,
        "~": "chr(10)",
    }.items():
        extra = f"replace({extra}, '{token}', {value})"
    # Ignore files and manifests carry the text as comments.
    commented = f"concat('# ', replace(text, chr(10), concat(chr(10), '# ')))"
    text = f"CASE WHEN {SLOT} IN (3, 9) THEN {commented} ELSE text END"
    return {
        "repo": "source",
        "commit_sha": "lang",
        "ord": "doc_id",
        "path": path,
        "size": "n_chars",
        "sha": "md5(text)",
        "content": f"concat({text}, chr(10), {extra})",
    }


def _derive(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """The named columns, each computed once per row.

    A one-element ``inline`` keeps the optimizer from copying the long expressions into every
    filter and projection above; only columns that are asked for are computed.
    """
    sql = columns("spark")
    row = F.struct(*[F.expr(sql[name]).alias(name) for name in names])
    return table(spark, sf_dir, "documents").select(F.inline(F.array(row)))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, ["repo", "commit_sha", "ord", "path", "size", "sha", "content"])


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, ["repo", "commit_sha", "ord", "path", "size"])


BASE = ", ".join(f"{sql} AS {name}" for name, sql in columns("duckdb").items())
# Contents are read from ``files``; absence is judged over ``paths``, all that is tracked.
PATHS = "paths AS (SELECT repo, commit_sha, ord, path FROM files)"
FILES = f"files AS (SELECT {BASE} FROM documents), {PATHS}"

# The line rules of the engine, in the other dialect.
LINES = r"""lines AS (
  SELECT repo, commit_sha, ord, path, line_no, line FROM (
    SELECT repo, commit_sha, ord, path, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (
      SELECT repo, commit_sha, ord, path, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS l FROM (
        SELECT repo, commit_sha, ord, path,
          string_split_regex(content, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{0085}\x{2028}\x{2029}]') AS p FROM files))))"""

SPACE = r"[\t-\r\x1C-\x20\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_fingerprint(c: str) -> str:
    normal = sql_strip(f"regexp_replace({c}, '{SPACE}+', ' ', 'g')")
    return f"CASE WHEN {normal} = '' THEN '-' ELSE substr(sha1({normal}), 1, 12) END"


NAME = "regexp_extract(path, '([^/]*)$', 1)"
SUFFIX = "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+([.][^.]+)$', 1))"


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
