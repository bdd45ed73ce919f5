"""The registered queries of this folder and, where SQL can say the same, their twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabproof.session import new_folder

from .bpe import token_counts
from .decontaminate import contaminated
from .divergence import source_divergence
from .licenses import scan_licenses
from .lm import pseudo_likelihood
from .packing import Limits, pack
from .passages import repeated_passages
from .perplexity import quality_rules
from .quality import quality_scores
from .simhash import simhash_components
from .text import read
from .token_files import write_tokens
from .urls import Rule, filter_urls, url_parts
from .vector_codes import vector_codes, with_label_errors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"), shingle=4, radius=4)


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), VOCABULARY, Limits(tokens=4096, segments=2048, loss=4096))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), VOCABULARY, limit=2048)


@query
def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"), least=50)


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), similarity=0.8)


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


#: Parts of a host's name that put its pages on the list.
UNWANTED = "(^|[.-])(casino|bets?|pills|adult|spam|ads)([.-]|$)"
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: URLs of the pages whose host has an unwanted name."""
    pages = read(spark, sf_dir, "pages")
    listed = pages.where(url_parts(F.col("url"))[0].rlike(UNWANTED)).select("url")
    return filter_urls(pages, listed, RULES).drop("listed")


_CANON = "regexp_replace(host, '^(www\\.|m\\.)+', '') || regexp_replace(path, '(/index)?(\\.html?)?/*$', '')"
_FITS = "(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
_CASES = {k: " ".join(f"WHEN {_FITS.format(h=r.host, p=r.path)} THEN '{k(r)}'" for r in sorted(RULES, key=lambda r: -len(r.text)))
          for k in (lambda r: r.text, lambda r: r.verdict)}
_rule, _verdict = _CASES.values()
ORACLES["op6_url_filter"] = f"""
    WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    c AS (SELECT *, CASE WHEN host <> '' THEN {_CANON} END AS canon FROM b),
    d AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '{UNWANTED}'))
    SELECT page_id, host, path, CASE {_rule} END AS rule,
           CASE {_verdict} WHEN canon IN (SELECT canon FROM d WHERE canon IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
    FROM c"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), examples=10_000)


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), width=4.0)


@query
def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(read(spark, sf_dir, "documents"))


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(read(spark, sf_dir, "documents"), BYTE_LEVEL, new_folder(spark, "token-files")).checksums()


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes(read(spark, sf_dir, "embeddings"), keep=("label",), parts=16, entries=64, rounds=2, scale=256)
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _lloyd(before: str, after: str) -> str:
    """SQL of a round: the nearest entry of each part, and the entries' floored means."""
    return f"""
    near{before} AS (SELECT r, p, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d FROM (
        SELECT c.r, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM parts c JOIN book{before} b USING (p, i) GROUP BY ALL) GROUP BY r, p),
    sums{before} AS (SELECT c.p, n.e, c.i, sum(c.x)::BIGINT AS s, count(*) AS n FROM parts c JOIN near{before} n USING (r, p) GROUP BY ALL),
    book{after} AS (SELECT p, e, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM book{before} LEFT JOIN sums{before} USING (p, e, i))"""


ORACLES["op11_vector_codes"] = f"""
    WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS v FROM embeddings
                  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    parts AS (SELECT r, (k - 1) // (len(v) // 16) AS p, (k - 1) % (len(v) // 16) AS i, floor(256 * v[k]::DOUBLE)::BIGINT AS x
              FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS k FROM kept)),
    book0 AS (SELECT p, r AS e, i, x FROM parts WHERE r < 64),
    {_lloyd("0", "1")}, {_lloyd("1", "2")}, {_lloyd("2", "3")},
    coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM book2) AS codebooks_sha256
    FROM kept JOIN coded USING (r)"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"), least=10, top=10)


ORACLES["op12_source_divergence"] = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    dense AS (SELECT lang, source, term, v, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
    p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + 2 * v) AS p FROM dense),
    q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // ((sum(n) OVER (PARTITION BY lang))::HUGEINT + 2 * v) AS q
          FROM (SELECT lang, term, v, sum(n)::HUGEINT AS n FROM dense GROUP BY ALL)),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
             FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    best AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
                   FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best))
    WHERE part = 'pair' OR rank <= 10"""
