import duckdb
import pytest

from tests.conftest import SF_DIR

#: Columns that operators might use themselves.
CLASHES = "component_id fingerprint labels score f h n at words k t utf8 node passages".split()


def text_of(n: int, seed: int = 0) -> str:
    """Words that occur nowhere else."""
    return " ".join(f"w{seed}x{i * 7919 % 10007}" for i in range(n))


#: (doc_id, text, lang): nulls, empty and very long texts, ties, repeated rows.
EDGES = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (None, "no id here", "en"), (None, None, None),
    (4, "one", "en"), (5, "one two three", "fr"), (6, text_of(120, 1), "en"), (7, text_of(120, 1), "en"),
    (7, text_of(120, 1), "en"), (8, "word " * 30_000, "de"), (9, "x" * 200_000, "de"), (10, text_of(400, 2), "xx"),
    (11, "intro words " + text_of(120, 1) + " outro", "en"), (12, "Ünïcode É ñ 中文 ΣΑΣ İ <|endoftext|> it's", "fr"),
    (13, "a\nb\na\n\nb\na b c a b c", "en"), (14, "THE MIT License and the Apache license, MIT license.", "en"),
]


@pytest.fixture(scope="package")
def edges(spark):
    rows = [(i, t, lang, "s", 0, *["clash"] * len(CLASHES)) for i, t, lang in EDGES]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="package")
def nothing(edges):
    return edges.where("false")


@pytest.fixture(scope="package")
def documents():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()}
