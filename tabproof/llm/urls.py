"""URL filters: path rules first, then a blocked Bloom filter of listed URLs and an exact join behind it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import lower_ascii

#: Words of 64 bits in the Bloom filter: at most so many rows are broadcast, whatever the length of the list.
BLOCKS = 1 << 16
#: Bits that a URL sets in its word.
PROBES = 4


@dataclass(frozen=True)
class Rule:
    """Holds for ``host`` and all subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def canonical(host: Column, path: Column) -> Column:
    """One spelling of a page's address: no www. or m., no index page, .html or last slash."""
    bare = F.regexp_replace(host, r"^(www\.|m\.)+", "")
    return F.when(host == "", None).otherwise(F.concat(bare, F.regexp_replace(path, r"(/index)?(\.html?)?/*$", "")))


def _place(key: Column) -> tuple[Column, Column]:
    """Word of the filter, and the bits in it."""
    h = F.xxhash64(key)
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {16 + 6 * i}) & 63 AS INT))") for i in range(PROBES)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return h, mask


def _probed(df: DataFrame, key: str) -> DataFrame:
    h, mask = _place(F.col(key))
    return df.withColumn("h", h).withColumn("block", F.expr(f"cast(h & {BLOCKS - 1} AS INT)")).withColumn("mask", mask).drop("h")


def bloom_filter(listed: DataFrame, key: str) -> DataFrame:
    """(block, word): at most BLOCKS rows."""
    return _probed(listed.where(F.col(key).isNotNull()), key).groupBy("block").agg(F.bit_or("mask").alias("word"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict (allow or block), listed.

    The longest fitting rule decides (of equal length, the first); ``rules`` is a short list that becomes one expression. Without a rule,
    a page is blocked if its canonical URL is that of a row of ``listed`` (column ``url``). Most pages end at the Bloom
    filter, a table of bounded size; only those that pass it are shuffled to the exact join, which removes
    its false positives. Null and malformed URLs have no canonical form and are allowed; null and repeated ids
    and URLs stay as they are; an empty list allows all; other columns are not read.
    """
    order = sorted(rules, key=lambda r: -len(r.text))
    host, path = url_parts(F.col("url_"))
    parts = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url_")).withColumn("host", host).withColumn(
        "path", path).drop("url_").withColumn("canon", canonical(F.col("host"), F.col("path")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(order):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    parts = parts.withColumn("rule", rule).withColumn("by_rule", verdict)
    lhost, lpath = url_parts(F.col("url"))
    keys = listed.select("url").withColumn("lhost", lhost).withColumn("lpath", lpath).select(
        canonical(F.col("lhost"), F.col("lpath")).alias("canon")).where("canon IS NOT NULL").distinct()
    probed = _probed(parts, "canon").join(F.broadcast(bloom_filter(keys, "canon")), "block", "left").withColumn(
        "maybe", F.expr("canon IS NOT NULL AND word IS NOT NULL AND (word & mask) = mask"))
    wanted = ["page_id", "host", "path", "rule", "by_rule"]
    clear = probed.where("NOT maybe").select(*wanted, F.lit(False).alias("listed"))
    exact = probed.where("maybe").select(*wanted, "canon").join(
        keys.withColumn("found", F.lit(True)).hint("shuffle_hash"), "canon", "left").select(
        *wanted, F.coalesce("found", F.lit(False)).alias("listed"))
    return clear.unionByName(exact).select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
