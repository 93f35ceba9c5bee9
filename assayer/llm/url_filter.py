"""URL filter: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a small table: one row per block, eight words of 32 bits.  A listed URL sets one bit
in each word of its block, so a probe is one broadcast hash join on the block and eight bit tests,
all in generated code.  What passes is joined exactly with the list, which removes false positives.

The number of blocks follows the list up to ``max_blocks``.  Beyond it the filter passes more and
the exact join, a shuffle join, has more to do: results are the same.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule, and its
canonical form is null, which is on no list; repeated rows are judged one by one; an empty list
blocks nothing; extra columns of the pages are kept, those with the name of an added one replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import ascii_lower, other_columns, prepare, unused_prefix
from assayer.session import materialize

WORDS = 8
BITS_PER_URL = 16
MAX_HASHED = 50_000_000  # listed URLs, some 100 bytes each, dealt over the shuffle's parts
MAX_BLOCKS = 1 << 17
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=.*)?$"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(None))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits; null if none does.

    ``rules`` are written into the plan, so they are meant to be hundreds at most.
    """
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        found = F.when(fits & F.startswith(path, F.lit(rule.path)), F.lit(rule.name)).otherwise(found)
    return found


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` and default port, path without a closing slash, query sorted and
    without tracking parameters; scheme and fragment go.  Null where there is no ``://``."""
    rest = after_scheme(url)
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    asked = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(
        rest.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    )


def has_tracking(url: Column) -> Column:
    asked = F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    return F.exists(F.split(asked, "&"), lambda p: p.rlike(TRACKING))


def _block(hash_: Column, blocks: int) -> Column:
    """Block of a URL, from the upper 24 bits of its hash."""
    return F.pmod(F.shiftrightunsigned(hash_, 40), F.lit(blocks)).cast("int")


def _masks(hash_: Column) -> list[Column]:
    """One bit per word of the block, each from five of the lower 40 bits."""
    one = F.lit(1).cast("bigint")
    return [
        F.call_function(
            "shiftleft", one, F.shiftright(hash_, 5 * i).bitwiseAND(F.lit(31)).cast("int")
        )
        for i in range(WORDS)
    ]


@dataclass(frozen=True)
class BlockedBloom:
    listed: int
    blocks: int
    table: DataFrame  # block, w0 … w7: at most ``blocks`` rows


def build_filter(
    listed: DataFrame, column: str, bits_per_url: int = BITS_PER_URL, max_blocks: int = MAX_BLOCKS
) -> BlockedBloom:
    """Filter over distinct listed URLs; ``max_blocks`` bounds its rows, hence its broadcast."""
    n = listed.count()
    need = max(1, math.ceil(n * bits_per_url / (32 * WORDS)))
    blocks = min(max_blocks, 1 << (need - 1).bit_length())
    hashed = listed.select(F.xxhash64(column).alias("h"))
    parts = hashed.select(_block(F.col("h"), blocks).alias("block"), *(
        mask.alias(f"w{i}") for i, mask in enumerate(_masks(F.col("h")))
    ))
    table = parts.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
    return BlockedBloom(n, blocks, table)


def may_be_listed(rows: DataFrame, column: str, bloom: BlockedBloom, flag: str) -> DataFrame:
    """Add ``flag``: false only where the URL of ``column`` is surely not on the list."""
    hash_ = F.xxhash64(column)
    own = unused_prefix(rows)
    probed = rows.withColumn(f"{own}block", _block(hash_, bloom.blocks))
    table = bloom.table.select(
        F.col("block").alias(f"{own}block"), *(F.col(f"w{i}").alias(f"{own}w{i}") for i in range(WORDS))
    )
    joined = probed.join(F.broadcast(table), f"{own}block", "left")
    hit = F.col(column).isNotNull()
    for i, mask in enumerate(_masks(hash_)):
        hit = hit & (F.col(f"{own}w{i}").bitwiseAND(mask) != 0)
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return joined.select(*kept, F.coalesce(hit, F.lit(False)).alias(flag))


def judge(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], url_column: str = "url",
    bits_per_url: int = BITS_PER_URL, max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """Add ``host, path, canonical, rule, verdict`` to every page.

    ``listed`` has one column ``canonical``: the URLs to block, as :func:`canonical_url` writes
    them.  A rule decides where one fits; elsewhere a listed URL is blocked, any other allowed.
    """
    prepare(pages.sparkSession)
    listed = materialize(
        listed.select("canonical").filter(F.col("canonical").isNotNull()).distinct(), "listed-urls"
    )
    bloom = build_filter(listed, "canonical", bits_per_url, max_blocks)
    url = F.col(f"`{url_column}`")
    added = ["host", "path", "canonical", "rule", "verdict"]
    # a page's own column of such a name is replaced, whatever its case
    kept, own = other_columns(pages, added), unused_prefix(pages)
    rows = pages.select(
        *(F.col(f"`{c}`") for c in kept),
        host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("canonical"),
    )
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdicts = {rule.name: rule.verdict for rule in rules}
    by_rule = F.lit(None).cast("string")
    for name, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(by_rule)
    rows = may_be_listed(rows, "canonical", bloom, f"{own}maybe")
    ask = F.col(f"{own}maybe") & F.col("rule").isNull()
    done = rows.filter(~ask).withColumn("verdict", F.coalesce(by_rule, F.lit("allow")))
    # Only possible hits move, and the exact hash join takes the false positives out.  A list whose
    # parts might not fit in memory meets them sorted, which spills.
    how = "shuffle_hash" if bloom.listed <= MAX_HASHED else "merge"
    exact = listed.withColumn(f"{own}listed", F.lit(True)).hint(how)
    asked = rows.filter(ask).join(exact, "canonical", "left")
    asked = asked.withColumn(
        "verdict", F.when(F.col(f"{own}listed"), F.lit("block")).otherwise(F.lit("allow"))
    )
    out = kept + added
    return done.select(*(f"`{c}`" for c in out)).unionAll(asked.select(*(f"`{c}`" for c in out)))
