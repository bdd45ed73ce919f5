import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tabproof.llm import lm, perplexity, quality
from tabproof.llm.queries import QUERIES
from tabproof.llm.text import as_bytes
from tabproof.llm.vocabulary import SHAPES, frequent_words, shape, word_counts
from tests.conftest import SF_DIR

from .conftest import EDGES

LARGER = "/root/testdata/sf0.01"


# Quality classifier ----------------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_quality"](spark, LARGER).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{LARGER}/labels.parquet'").fetchall())
    assert len(rows) == 1000
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [(rows[i].score, q) for i, q in labels.items() if rows[i].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.97


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) = 1 THEN 1 - quality ELSE quality END AS quality")
    own, other = (sorted((r.doc_id, r.score) for r in quality.quality_scores(docs, x).collect()) for x in (labels, flipped))
    assert own == other


def test_leader_separates_and_forgets_noise():
    rows = [(b"good plain words here", 1), (b"bad $$$ words %%% here", 0)] * 200
    w = quality.learn(rows)
    assert quality.probability(w, b"plain good words") > 0.8 > 0.2 > quality.probability(w, b"$$$ words %%%")
    assert (w != 0).sum() < 200


def test_quality_edges(edges, nothing, spark):
    labels = spark.createDataFrame([(6, 1, None), (8, 0, 1), (None, 1, 1), (10, None, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(edges, labels).collect()
    assert len(rows) == len(EDGES) and all(r.score is not None and r.held_out is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert {r.score for r in quality.quality_scores(edges, labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(nothing, labels).collect() == []


# Quality rules -----------------------------------------------------------------------------------------

def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    earlier, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in earlier
            earlier.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), failed


def seen(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_equals_brute_force(spark, documents):
    rows = QUERIES["op9_quality_rules"](spark, SF_DIR).collect()
    assert {r.doc_id: seen(r) for r in rows} == {i: plain_base(t) for i, t in documents.items()}
    assert not any(r.kept and r.base_failed for r in rows)


def test_bands_keep_clean_and_reject_junk(spark):
    rows = {r.doc_id: r for r in QUERIES["op9_quality_rules"](spark, LARGER).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{LARGER}/labels.parquet'").fetchall()
    kept = {q: [rows[i].kept for i, v in labels if v == q and not rows[i].base_failed] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.99 and np.mean(kept[0]) < 0.1


def test_rules_edges(edges, nothing):
    rows = perplexity.quality_rules(edges).collect()
    assert sorted((str(r.doc_id), seen(r)) for r in rows if r.doc_id) == sorted((str(i), plain_base(t)) for i, t, _ in EDGES if i)
    assert len(rows) == len(EDGES) and all(r.kept is not None for r in rows)
    assert all((r.log_perplexity is None) == (r.n_words == 0) for r in rows)
    assert perplexity.quality_rules(nothing).collect() == []


def test_kneser_ney_equals_its_definition():
    rng = np.random.default_rng(0)
    codes = np.concatenate(([0, 0], 1 + rng.zipf(1.5, 3000) % 12))
    grams, counts = np.unique(perplexity.trigrams(codes), return_counts=True)
    model = perplexity.KneserNey.fit(grams, counts)
    c = perplexity.CODES
    tri = {(int(g) // c // c, int(g) // c % c, int(g) % c): int(n) for g, n in zip(grams, counts)}
    two = Counter((v, w) for _, v, w in tri)
    one = Counter(w for _, w in two)

    def loss(table):
        d = perplexity.discounts(np.array(list(table.values())))
        return lambda k: d[min(k, 3)]

    def level(table, context, lower):
        lost = loss(table)

        def p(key):
            own = {k: n for k, n in table.items() if k[:-1] == context(key)}
            if not own:
                return lower(key)
            total = sum(own.values())
            n = table.get(key, 0)
            return (n - lost(n)) / total + sum(lost(x) for x in own.values()) / total * lower(key)
        return p

    p1 = level({(w,): n for w, n in one.items()}, lambda k: (), lambda k: 1 / c)
    p2 = level(dict(two), lambda k: k[:-1], lambda k: p1(k[-1:]))
    p3 = level(tri, lambda k: k[:-1], lambda k: p2(k[-2:]))
    tests = [codes[:40], np.array([0, 0, 3, 1, 2, 90, 3, 3, 100, 101, 5])]
    for t in tests:
        keys = [tuple(int(x) for x in t[i:i + 3]) for i in range(len(t) - 2)]
        assert model.log_perplexity(t) == pytest.approx(-np.mean([np.log(p3(k)) for k in keys]), rel=1e-4)
    every = [np.array([3, 1, w]) for w in range(c)]
    assert sum(np.exp(-model.log_perplexity(t)) for t in every) == pytest.approx(1, rel=1e-4)


def test_discounts():
    counts = np.repeat([1, 2, 3, 4, 9], [60, 30, 20, 10, 5])
    y = 60 / (60 + 2 * 30)
    assert perplexity.discounts(counts) == pytest.approx([0, 1 - 2 * y * 30 / 60, 2 - 3 * y * 20 / 30, 3 - 4 * y * 10 / 20])


# Words and the network ------------------------------------------------------------------------------------

def test_word_counts_equal_brute_force(spark, documents, monkeypatch):
    texts = as_bytes(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id")
    expected = Counter(w for t in documents.values() for w in t.encode().split())
    assert {bytes(r.word): r.n for r in word_counts(texts).collect()} == expected
    assert frequent_words(texts, 50) == sorted(expected, key=lambda w: (-expected[w], w))[:50]


def test_shapes_are_few():
    words = "a B Ab aB 1 12 x1 a. B, <b> $$$ é Éa ... abcdefghijk ABCDEFGHIJ! -".split()
    assert all(0 <= shape(w.encode()) < SHAPES for w in words)


def test_network_is_a_distribution_and_its_gradient_is_right():
    rng = np.random.default_rng(0)
    flat = lm.first_parameters().astype(np.float64)
    around, words = lm.spread([rng.integers(1, lm.CODES, 40), rng.integers(1, lm.CODES, 30)])
    all_codes = np.arange(lm.CODES)
    assert np.exp(lm.log_probabilities(lm.parts(flat), np.repeat(around[3:4], lm.CODES, 0), all_codes)).sum() == pytest.approx(1)
    g = lm.gradient(lm.parts(flat), around, words)
    loss = lambda x: -lm.log_probabilities(lm.parts(x), around, words).mean()
    for i in [int(words[0]) * lm.WIDTH, *range(lm.CODES * lm.WIDTH, lm.PARAMETERS, 211)]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert g[i] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-7)


def test_words_around():
    around, words = lm.spread([np.array([5, 6, 7]), np.array([8])])
    assert around.tolist() == [[0, 0, 6, 7], [0, 5, 7, 0], [5, 6, 0, 0], [0, 0, 0, 0]] and words.tolist() == [5, 6, 7, 8]


def test_totals_are_sums_over_words():
    rng = np.random.default_rng(1)
    own = lm.parts(lm.first_parameters())
    texts = [rng.integers(1, lm.CODES, n) for n in (3, 1, 9000)]
    for t, total in zip(texts, lm.totals(own, texts)):
        assert total == pytest.approx(lm.log_probabilities(own, *lm.spread([t])).sum(dtype=np.float64), rel=1e-4)


def test_learning_lowers_the_loss_and_ranks_texts(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_pseudo_likelihood"](spark, LARGER).collect()}
    total, n = sum(r.log_likelihood for r in rows.values()), sum(r.n_words for r in rows.values())
    assert len(rows) == 1000 and -total / n < 0.75 * np.log(lm.CODES)
    for r in rows.values():
        assert r.log_likelihood <= 0 and (r.n_words == 0 or r.mean_log_likelihood == pytest.approx(r.log_likelihood / r.n_words))


def test_likelihood_edges(edges, nothing):
    rows = lm.pseudo_likelihood(edges, rounds=1).collect()
    assert len(rows) == len(EDGES)
    assert all((r.n_words == 0) == (r.mean_log_likelihood is None) for r in rows)
    assert {r.log_likelihood for r in rows if r.doc_id in (1, 2, 3)} == {0.0}
    assert lm.pseudo_likelihood(nothing).collect() == []


def test_table_of_logarithms():
    """Every text's perplexity by place is the one that is looked up word by word."""
    grams = np.unique(np.random.default_rng(5).integers(0, perplexity.CODES ** 3, 3000))
    model = perplexity.KneserNey.fit(grams, np.arange(len(grams)) % 7 + 1)
    logs = model.table()
    assert len(logs) == perplexity.CODES ** 3 and logs.dtype == np.float32
    for seed in range(5):
        codes = np.concatenate(([0, 0], np.random.default_rng(seed).integers(1, perplexity.CODES, 200)))
        assert float(-logs[perplexity.trigrams(codes)].mean()) == model.log_perplexity(codes)
