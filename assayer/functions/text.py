"""Scalar text, hash and clock functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer import rules

# Line boundaries and whitespace as text files use them, beyond what \R and \s cover.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
OTHER_BREAK = r"[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
SPACE = (
    r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A"
    r"\u2028\u2029\u202F\u205F\u3000]"
)
NOT_SPACE = SPACE.replace("[", "[^", 1)
SPACE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace (Unicode whitespace, not only blanks)."""
    return F.btrim(_col(c), F.lit(SPACE_CHARACTERS))


def is_blank(c: Column | str) -> Column:
    """No visible character; stops reading at the first one."""
    return ~_col(c).rlike(NOT_SPACE)


def stripped_longer_than(c: Column | str, n: int) -> Column:
    """Is the stripped text longer than ``n`` characters?  Nothing is copied to find out."""
    return _col(c).rlike(f"(?s){NOT_SPACE}.{{{n - 1},}}{NOT_SPACE}")


def split_lines(content: Column | str) -> Column:
    """Lines of a text, with the empty piece after a final line break (see ``drop_last``).

    Nearly all texts break lines by newline only, and those take the fast single-character
    split.
    """
    content = _col(content)
    return F.when(content.rlike(OTHER_BREAK), F.split(content, LINE_BREAK, -1)).otherwise(
        F.split(content, "\n", -1)
    )


def drop_last(parts: Column) -> Column:
    """A trailing line break does not open another line."""
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts)


def fingerprint(identity: Column | str) -> Column:
    """Twelve hex digits over whitespace-normalised content; ``-`` for blank content."""
    normal = strip(F.regexp_replace(_col(identity), f"{SPACE}+", " "))
    digest = F.substring(F.sha1(normal), 1, rules.FINGERPRINT_LENGTH)
    return F.when(normal == "", F.lit(rules.EMPTY_FINGERPRINT)).otherwise(digest)


def finding_id(axis: Column, rule: Column, path: Column, content_fingerprint: Column) -> Column:
    shown_path = F.when(F.coalesce(path, F.lit("")) == "", F.lit("-")).otherwise(path)
    return F.concat_ws(":", axis, rule, shown_path, content_fingerprint)


def known_severity(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.isin(rules.SEVERITIES), c).otherwise(F.lit("low"))


def severity_rank(c: Column | str) -> Column:
    """0 for critical up to 4 for info; unknown severities sort last."""
    c = _col(c)
    rank = F.lit(len(rules.SEVERITIES))
    for position, name in reversed(list(enumerate(rules.SEVERITIES))):
        rank = F.when(c == name, F.lit(position)).otherwise(rank)
    return rank


def legacy_severity(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c == "info", F.lit("low")).otherwise(c)


def truncate(c: Column | str, length: int, ellipsis: str = "") -> Column:
    c = _col(c)
    if not ellipsis:
        return F.substring(c, 1, length)
    return F.when(
        F.char_length(c) > length, F.concat(F.substring(c, 1, length), F.lit(ellipsis))
    ).otherwise(c)


def first_text(*columns: Column | str) -> Column:
    """First argument holding more than whitespace."""
    return F.coalesce(*[F.when(~is_blank(c), _col(c)) for c in columns])


def normalize_lang(c: Column | str) -> Column:
    head = F.split_part(F.translate(F.lower(strip(c)), "_", "-"), F.lit("-"), F.lit(1))
    return F.when(head.isin(rules.SUPPORTED_LANGUAGES), head).otherwise(
        F.lit(rules.DEFAULT_LANGUAGE)
    )


def fill_template(template: Column, params: Column, names: list[str]) -> Column:
    """Replace ``{name}`` by ``params[name]`` for the names a catalog uses.

    The template is split at its marks once, so a mark inside a value stays as it is.
    """
    marks = [F.lit("{" + name + "}") for name in names]

    def part(piece: Column) -> Column:
        name = F.substr(piece, F.lit(2), F.length(piece) - 2)
        value = F.when(piece.isin(*marks), F.try_element_at(params, name))
        return F.coalesce(value, piece)

    return F.array_join(F.transform(F.split(template, r"(?=\{)|(?<=\})"), part), "")


def strip_fences(raw: Column | str) -> Column:
    """Drop Markdown code fences around a JSON answer."""
    return strip(F.regexp_replace(_col(raw), "```(?:json)?|```", ""))


def is_json_object(text: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def round_to(c: Column, digits: int) -> Column:
    """Round binary floating point with ties to even (0.125 to 0.12), as reports do."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def valid_repo_name(c: Column | str) -> Column:
    return F.size(F.split(_col(c), "/", -1)) == 2


def export_name(repo: Column, created_at: Column, extension: str, prefix: str = "report") -> Column:
    return F.concat(
        F.lit(f"{prefix}_"),
        F.replace(repo, F.lit("/"), F.lit("_")),
        F.lit("_"),
        F.date_format(created_at, "yyyyMMdd"),
        F.lit(f".{extension}"),
    )


def start_of_day(c: Column | str) -> Column:
    return F.date_trunc("day", _col(c))


def later(moment: Column, *, minutes: int = 0, days: int = 0, seconds: int = 0) -> Column:
    """A moment shifted by a fixed span; the clock is always an argument."""
    return moment + F.lit(dt.timedelta(days=days, minutes=minutes, seconds=seconds))


def parse_utc(c: Column | str) -> Column:
    """Timestamp text; text without an offset is UTC."""
    c = _col(c)
    zoned = F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def content_guard(
    content: Column | str,
    max_lines: int = rules.MAX_FILE_LINES,
    minified_lines: int = rules.MINIFIED_MAX_LINES,
    minified_chars: int = rules.MINIFIED_MIN_CHARS,
) -> Column:
    """Why a readable file is skipped on purpose, else null.

    Counts plain newlines by length difference: no array of lines is built.
    """
    content = _col(content)
    lines = F.char_length(content) - F.char_length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    return F.when(lines > max_lines, F.lit(rules.SKIPPED_TOO_MANY_LINES)).when(
        (lines <= minified_lines) & (F.char_length(content) > minified_chars),
        F.lit(rules.SKIPPED_MINIFIED),
    )
