import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tabproof.llm.queries import BYTE_LEVEL, QUERIES
from tabproof.llm.token_files import Layout, byte_ids, write_tokens
from tests.conftest import SF_DIR

from .conftest import EDGES
from .test_tokens import TRICKY

SPACES = [" a  b ", "\n\n x\t\ty \r\n", "a\xa0\xa0b\x85c", "   ", "it's 'S don't 've", " 12 ½³x ª", "x\x1cy\x1d z", "a <|endoftext|> b",
          "  lead", "   lead", "trail ", "trail  ", "trail \n", "a \n\n b", "a\n  b", "a \t \n c", " ", "  ", "\n ", " \n", "a.  (b) 's  't", "x \xa0 y"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_LEVEL)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_equal_the_library(library, documents):
    texts = SPACES + TRICKY + list(documents.values())
    found = byte_ids(BYTE_LEVEL).of(pa.array([b"left out", *[t.encode() for t in texts]], pa.binary()).slice(1))
    assert len(found) == len(texts)
    for t, ids in zip(texts, found):
        assert [*ids.tolist(), 2] == ids_of(library, t), t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab's'tre vml d.,\n\t \xa0\x85é×½1²'\x1cª<|ā"), max_size=25), max_size=4))
def test_parts_equal_the_library(texts):
    known = Tokenizer.from_file(BYTE_LEVEL)
    found = byte_ids(BYTE_LEVEL).of(pa.array([t.encode() for t in texts], pa.binary()))
    assert [x.tolist() for x in found] == [known.encode(t, add_special_tokens=False).ids for t in texts]


def expected(library, rows):
    out, start = [], 0
    for i, t in rows:
        ids = ids_of(library, t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark, library, documents):
    rows = QUERIES["op13_token_files"](spark, SF_DIR).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, rows)) == expected(library, sorted(documents.items()))


@pytest.mark.parametrize("encoding,used", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_layout_of_the_files(spark, library, documents, folder, encoding, used):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(3)
    files = write_tokens(docs, BYTE_LEVEL, folder, Layout(encoding, group_bytes=64 << 10, page_rows=5))
    found = [pq.ParquetFile(f.removeprefix("file://")) for f in files.tokens.inputFiles()]
    assert any(f.num_row_groups > 1 for f in found)
    for f in found:
        for g in range(f.num_row_groups):
            columns = {c.path_in_schema: c for c in map(f.metadata.row_group(g).column, range(f.metadata.num_columns))}
            ids = columns["ids.list.element"]
            assert used in ids.encodings and all(c.has_offset_index for c in columns.values())
            assert columns["doc_id"].has_column_index and columns["doc_id"].statistics.has_min_max
    texts = sorted(documents.items())
    order = expected(library, texts)
    assert sorted(map(tuple, files.metadata().collect())) == [x[:3] for x in order]
    some = [r.asDict() for r in files.documents(3, 77, 10**9).orderBy("doc_id").collect()]
    assert [(r["doc_id"], r["start"], r["ids"]) for r in some] == [(i, order[i][1], ids_of(library, documents[i])) for i in (3, 77)]
    every = [x for _, t in texts for x in ids_of(library, t)]
    for a, b in [(0, 1), (order[50][1] - 3, order[120][1] + 9), (0, len(every)), (len(every), len(every) + 5), (7, 7)]:
        parts = files.span(a, b).orderBy("start").collect()
        assert [x for r in parts for x in r.ids] == every[a:b]
        assert [r.start for r in parts] == [a + sum(p.n_tokens for p in parts[:k]) for k in range(len(parts))]


def test_only_what_is_asked_for_is_read(spark, folder):
    files = write_tokens(spark.read.parquet(f"{SF_DIR}/documents.parquet"), BYTE_LEVEL, folder)
    plan = files.metadata()._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.replace("doc_ids", "")
    plan = files.documents(3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)" in plan or "In(doc_id, [3])" in plan


def test_edges(spark, edges, nothing, library, folder):
    rows = write_tokens(edges, BYTE_LEVEL, f"{folder}/a").checksums().collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (str(i), len(ids_of(library, t)), zlib.crc32(np.array(ids_of(library, t), "<u4").tobytes())) for i, t, _ in EDGES)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id or -1 for r in rows] == sorted(i or -1 for i, _, _ in EDGES)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    empty = write_tokens(nothing, BYTE_LEVEL, f"{folder}/b")
    assert empty.checksums().collect() == [] and empty.span(0, 9).collect() == []
    with pytest.raises(ValueError):
        Layout("plain").options()
