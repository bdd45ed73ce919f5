import random
import re
from collections import Counter

import numpy as np

from tabproof.llm.decontaminate import block_keys, contaminated, weighted_similarity
from tabproof.llm.queries import QUERIES
from tests.conftest import SF_DIR

from .conftest import text_of


def plain(docs, items, least=0.8):
    """{(doc, item): best weighted similarity of a window as long as the item}."""
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingled = lambda w, k: Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))
    out = {}
    for i, t in items:
        item = norm(t)
        if i is None or not item:
            continue
        k, own = min(5, len(item)), None
        own = shingled(item, k)
        for d, text in docs:
            words = norm(text)
            if d is None or not any(w in words for w in item):
                continue
            for a in range(len(words) - len(item) + 1):
                window = shingled(words[a:a + len(item)], k)
                alike = (own & window).total() / (own | window).total()
                if alike >= least:
                    out[d, i] = max(alike, out.get((d, i), 0))
    return out


def found(df):
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in df.collect()}


def test_query_equals_brute_force(spark, documents):
    rows = QUERIES["op10_decontamination"](spark, SF_DIR)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert found(rows) == {k: round(v, 9) for k, v in plain(documents.items(), items).items()}
    assert rows.count() > 0


def test_edited_items(spark):
    rng = random.Random(4)
    items = [(i, text_of(rng.randint(30, 90), 10 + i)) for i in range(30)] + [(30, "two words"), (31, "lonely"), (32, "a b c d e a b c d e"),
                                                                             (33, ""), (34, None), (None, text_of(40, 70)), (35, text_of(35, 11))]
    docs = []
    for i, t in items[:30]:
        words = t.split()
        for edits in (0, 1, 2, 4):
            own = list(words)
            for at in rng.sample(range(len(own)), edits):
                own[at] = "changed"
            docs.append((100 * i + edits, text_of(25, 500 + i) + ", " + " ".join(own).upper() + "! " + text_of(25, 600 + i)))
    docs += [(9000, "Two words."), (9001, "some LONELY word"), (9002, "a b c d e a b c d e a b c d e"), (9003, None), (None, items[0][1]),
             (9004, items[1][1]), (9004, items[1][1])]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == {k: round(v, 9) for k, v in plain(docs, items).items()}
    assert got.count() == len(found(got))


def test_edges(edges, nothing, spark):
    items = spark.createDataFrame([(1, text_of(60, 1), "clash"), (2, "mit license", "clash")], "item_id long, text string, doc_id string")
    assert set(found(contaminated(edges, items))) == {(6, 1), (7, 1), (11, 1), (14, 2)}
    assert contaminated(nothing, items).collect() == []
    assert contaminated(edges, items.where("false")).collect() == []


def test_blocks_find_all_within_the_radius():
    rng = random.Random(1)
    for _ in range(300):
        f = rng.getrandbits(64)
        g = f ^ sum(1 << b for b in rng.sample(range(64), 20))
        assert set(block_keys(f, 2)) & set(block_keys(g, 0))


def test_weighted_similarity():
    assert weighted_similarity(np.array([1, 1, 2]), np.array([1, 2, 2])) == 2 / 4


def test_documents_shorter_than_the_item(spark):
    words = text_of(59, 3).split()
    docs = [(k, " ".join(words[a:b])) for k, (a, b) in enumerate([(0, 57), (2, 59), (0, 48), (0, 20), (0, 3)])]
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                        spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    got = {r.doc_id: (r.start_word, r.n_words, round(r.similarity, 9)) for r in rows if r.distance <= 20}
    assert got == {0: (0, 57, round(53 / 55, 9)), 1: (0, 57, round(53 / 55, 9)), 2: (0, 48, 0.8)}
