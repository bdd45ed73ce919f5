import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabproof.llm.bpe import merge_table, token_counts
from tabproof.llm.packing import Item, Limits, Packer, pack, word_ids
from tabproof.llm.queries import QUERIES, VOCABULARY
from tests.conftest import SF_DIR

from .conftest import EDGES

TRICKY = ["", "   ", "a<|endoftext|>b", "<|STARTOFTEXT|> x <|startoftext|>", "don't I'LL we'RE 'sx", "İstanbul ΣΑΣ σς Ǆ",
          "é\u0301 \u0301x\xa0y\u3000z\x85q\x1cz", "123 4½ Ⅷ x²", "👩‍👩‍👧 !!!???", "ﬁ ſ ß ẞ", "\x00\x01 a\x0bb",
          "<|endoftext|><|endoftext|>", "中文字符 テスト かな가나다", "...###$$$ a.b.c", "hello" * 300, "'S 'T x'Ve", "\ud7ff é́́"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_counts_and_ids_equal_the_library(library, documents):
    table, ids = merge_table(VOCABULARY), word_ids(VOCABULARY)
    texts = TRICKY + list(documents.values())
    for t, raw in zip(texts, ids.of([t.encode() for t in texts])):
        expected = library.encode(t, add_special_tokens=False).ids
        assert table.count(t.encode()) == len(expected), t
        assert np.frombuffer(raw, np.uint32).tolist() == expected, t


def test_counts_of_edges(edges, nothing, library):
    rows = token_counts(edges, VOCABULARY, limit=100).collect()
    expected = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100)
                      for i, t, _ in EDGES)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == expected
    assert token_counts(nothing, VOCABULARY).collect() == []


def check_pieces(rows, texts, library):
    """Every id of every text is in one piece; sequences have no holes and full or power-of-two lengths."""
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            part = np.array(ids[i][at:at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at.bit_count() == 1


def test_packing_query(spark, documents, library):
    check_pieces(QUERIES["op3_packing"](spark, SF_DIR).collect(), documents, library)


def test_packing_edges(edges, nothing, library):
    some = edges.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_pieces(pack(some, VOCABULARY).collect(), {i: t or "" for i, t, _ in EDGES if i}, library)
    all_rows = pack(edges, VOCABULARY).collect()
    assert sum(r.length for r in all_rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in EDGES)
    assert pack(nothing, VOCABULARY).collect() == []


@pytest.mark.parametrize("limits", [Limits(64, 5, 64), Limits(64, 64, 20), Limits(32, 3, 16), Limits(64, 1, 64)])
def test_limits_hold(limits):
    rng = np.random.default_rng(0)
    packer, rows, masked = Packer(limits, 10, pool=16), [], {}
    for i in range(400):
        n = int(rng.integers(1, 90))
        masked[i] = int(rng.integers(0, n + 1))
        rows += packer.add(Item(i, bytes(4 * n), masked[i]))
    rows += packer.end()
    used = defaultdict(lambda: [0, 0, 0])
    for doc, start, length, *_, sequence, _ in rows:
        held = used[sequence]
        held[0] += length
        held[1] += 1
        held[2] += max(0, start + length - max(masked[doc], start))
    assert all(t <= limits.tokens and s <= limits.segments and x <= limits.loss for t, s, x in used.values())
    assert all(length > 0 for _, _, length, *_ in rows)
