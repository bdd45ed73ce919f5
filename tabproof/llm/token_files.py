"""Token ids of documents as Parquet list columns, laid out for reading some documents or no ids at all.

Files hold documents in ascending order, one file a range. A row has the document's ids and what finds them again:
the file's number (``shard``), the place among the file's ids (``first``) and their number. A small table of one row
a file (``shards``) tells how many ids stand before each, so that starts over all files need no second writing.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .bpe import byte_letters
from .text import Memo, as_bytes, release, turn_to

END_OF_DOCUMENT = 2
#: Parts that a worker remembers, and bytes of text that are encoded together.
REMEMBERED, TOGETHER = 300_000, 2 << 20

# Classes of characters in the pre-tokenizer's pattern, fixed values as far as Latin-1: white space, letters, numbers, others.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KINDS = np.array([_SPACE if c in "\t\n\x0b\x0c\r \x85\xa0" else _LETTER if c.isalpha() else _NUMBER if c.isnumeric() else _OTHER
                   for c in map(chr, range(256))], np.uint8)
#: What follows an apostrophe in a part of its own, fixed values.
_ONE, _TWO = np.frombuffer(b"stmd", np.uint8), [tuple(x) for x in (b"re", b"ve", b"ll")]


def part_starts(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the parts of texts start, for UTF-8 of Latin-1 characters in one array of bytes; ``starts``: of the texts that are not empty.

    A part is a run of letters, numbers or other characters with a space before it, a short form behind an apostrophe, or
    white space. The last character of white space that something follows is no part of the run before it: a space
    belongs to what follows, any other stands alone.
    """
    kind = _KINDS[text]
    second = np.flatnonzero((text & 0xC0) == 0x80)
    kind[second] = _KINDS[(text[second] & 0x3F) | (text[second - 1] << 6)]  # two bytes of one character
    kind[second - 1] = kind[second]
    first = np.zeros(len(text), bool)
    first[starts] = True
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new)
    ends = np.append(run[1:], len(text))
    follows = np.append(~first[run[1:]], False)  # something of the same text
    blank = (kind[run] == _SPACE) & follows
    tail = ends[blank] - 1
    tail -= (text[tail] & 0xC0) == 0x80
    new[tail] = True
    new[ends[blank][text[ends[blank] - 1] == 32]] = False
    # Short forms: an apostrophe alone, with letters behind it and no space before it.
    mark = np.flatnonzero((text[run] == 39) & (ends - run == 1) & follows & new[run])
    mark = mark[kind[run[np.minimum(mark + 1, len(run) - 1)]] == _LETTER]
    at, letters = run[mark], ends[mark + 1] if len(mark) else run[:0]
    one = np.isin(text[at + 1], _ONE)
    after = np.minimum(at + 2, len(text) - 1)
    two = ~one & (at + 3 <= letters) & np.logical_or.reduce([(text[at + 1] == x) & (text[after] == y) for x, y in _TWO])
    new[at[one | two] + 1] = False
    rest = np.concatenate([at[one] + 2, at[two] + 3])
    inside = rest < np.concatenate([letters[one], letters[two]])
    new[rest[inside]] = True
    return np.flatnonzero(new)


class ByteIds:
    """Ids of whole texts from the tokenizers library, whose model sees each remembered part of a text once.

    The file must be byte-level without normalizer and prefix space: its parts are then encoded apart from each other.
    Texts beyond Latin-1, and those that may hold a special string, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        self.parts = Memo(limit=REMEMBERED)
        self.parts.fn = self.part

    def whole(self, utf8: bytes) -> np.ndarray:
        return np.array(self.library.encode(utf8.decode("utf-8", "replace"), add_special_tokens=False).ids, "<i4")

    def part(self, part: bytes) -> bytes:
        """Ids of what the pre-tokenizer does not cut: the model takes its bytes as letters."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(part.decode("latin-1").translate(self.letters))])

    def plain(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in one array, and how many ids stand before each of their ``starts``."""
        if not len(text):
            return np.zeros(0, "<i4"), np.zeros(0, np.int64)
        at = part_starts(text, starts)
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(text)).astype(np.int32)), pa.py_buffer(text)])
        found = parts.dictionary_encode()
        raw = [self.parts[p] for p in found.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        known = pa.ListArray.from_arrays(pa.array(np.append(0, sizes.cumsum()), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
        line = found.indices.to_numpy()
        before = np.append(0, sizes[line].cumsum())
        return known.take(found.indices).flatten().to_numpy(), before[np.searchsorted(at, starts)]

    def of(self, texts: pa.BinaryArray) -> list[np.ndarray]:
        """Ids of each text."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        text = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        # Whole to the library: bytes beyond two-byte Latin-1, broken UTF-8, special strings.
        leads = (text == 0xC2) | (text == 0xC3)
        odd = (text >= 0xC4) | (((text & 0xC0) == 0x80) != np.append(False, leads[:-1])[:len(text)])
        odd |= leads & ~np.append(((text & 0xC0) == 0x80)[1:], False)[:len(text)]
        counted = np.append(0, odd.cumsum())
        strange = counted[ends[1:]] > counted[ends[:-1]]
        raw = text.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                strange[np.searchsorted(ends, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        sizes = np.diff(ends)
        kept = text if not strange.any() else text[np.repeat(~strange, sizes)]
        own = np.where(strange, 0, sizes)
        starts = own.cumsum() - own
        ids, before = self.plain(kept, starts[own > 0])
        upto = np.append(before[1:], len(ids)) if len(before) else before
        stretch = iter(zip(before.tolist(), upto.tolist()))
        out = []
        for i, (alone, n) in enumerate(zip(strange.tolist(), own.tolist())):
            if alone:
                out.append(self.whole(raw[ends[i]:ends[i + 1]]))
            elif n:
                a, b = next(stretch)
                out.append(ids[a:b])
            else:
                out.append(ids[:0])
        return out


@cache
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


@dataclass(frozen=True)
class Layout:
    """How token files are written.

    ``encoding``: ``dictionary`` (ids as indexes into each row group's own list of ids) or ``delta`` (differences in packed
    blocks). ``group_bytes`` is the size of a row group in memory, ``page_rows`` the most documents of a page:
    the page index tells pages apart by their documents, so a page is the least that a selective read touches.
    """

    encoding: str = "dictionary"
    group_bytes: int = 32 << 20
    page_rows: int = 256
    compression: str = "snappy"

    def options(self) -> dict[str, str]:
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"encoding is dictionary or delta, got {self.encoding!r}")
        kept = str(self.encoding == "dictionary").lower()
        return {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false",
                "parquet.enable.dictionary#ids.list.element": kept, "parquet.block.size": str(self.group_bytes),
                "parquet.page.row.count.limit": str(self.page_rows), "compression": self.compression}


def _schema(doc_id: str, kind: str) -> str:
    return f"`{doc_id}` {kind}, shard int, line long, first long, n_tokens long, ids array<int>"


def encoded(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END_OF_DOCUMENT) -> DataFrame:
    """doc_id, shard, line, first, n_tokens, ids: documents in ascending order over the frame's partitions.

    Rows are dealt by ranges of ids (and by where they come from, so that copies of one id spread too) and sorted;
    the texts cross one shuffle and are encoded behind it.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    placed = as_bytes(docs, doc_id, text=text, names=("__id",)).withColumn("__from", F.spark_partition_id())
    ranged = placed.repartitionByRange("__id", "__from").sortWithinPartitions("__id", "__from", F.xxhash64("utf8"))

    def run(batches):
        turn_to("token_files")
        shard, line, first = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            bytes_before = np.append(0, pc.binary_length(texts).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64))
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(bytes_before, bytes_before[at] + TOGETHER, "right")) - 1)
                found = byte_ids(tokenizer).of(texts.slice(at, upto - at))
                n = np.array([len(x) + 1 for x in found], np.int64)
                ends = np.cumsum(n)
                marked = [x for own in found for x in (own, [end])]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, upto - at), pa.array(np.full(len(n), shard, np.int32)), pa.array(line + np.arange(len(n))),
                    pa.array(first + ends - n), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.concatenate(marked), pa.int32()))],
                    names=[doc_id, "shard", "line", "first", "n_tokens", "ids"])
                line, first, at = line + len(n), first + int(ends[-1]), upto
        release()

    return ranged.select("__id", "utf8").mapInArrow(run, _schema(doc_id, kind))


class TokenFiles:
    """Token files below ``path``: ``tokens`` with a row for each document, ``shards`` with a row for each file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.tokens = spark.read.parquet(f"{path}/tokens")
        self.doc_id = self.tokens.columns[0]
        self.shards = spark.read.schema("shard int, n_documents long, n_tokens long, base long").parquet(f"{path}/shards")

    def _started(self, rows: DataFrame, *more: str | Column) -> DataFrame:
        """``rows`` of the files with their start among all ids; one row of ``shards`` a file is joined."""
        return rows.join(self.shards.select("shard", "base"), "shard").select(
            self.doc_id, (F.col("base") + F.col("first")).alias("start"), "n_tokens", *more)

    def metadata(self) -> DataFrame:
        """doc_id, start, n_tokens of all documents. No page of ids is read."""
        return self._started(self.tokens.select(self.doc_id, "shard", "first", "n_tokens"))

    def documents(self, *wanted) -> DataFrame:
        """doc_id, start, n_tokens, ids of all documents, or of the ``wanted`` ids: row groups and pages are chosen by them."""
        return self._started(self.tokens.where(F.col(self.doc_id).isin(*wanted)) if wanted else self.tokens, "ids")

    def span(self, start: int, stop: int) -> DataFrame:
        """The ids from ``start`` up to ``stop`` over all files, by document: doc_id, start, n_tokens, ids of the part inside.

        Only the files that hold the span are read, and of those the pages by ``first``; the bounds of at most as many files as
        the span covers pass the driver.
        """
        held = self.shards.where((F.col("base") < stop) & (F.col("base") + F.col("n_tokens") > start)).agg(
            F.min("shard").alias("a"), F.max("shard").alias("b"), F.max(F.lit(stop) - F.col("base")).alias("most")).first()
        rows = self.tokens.where(F.col("shard").between(held["a"], held["b"]) & (F.col("first") < held["most"])
                                 if held["a"] is not None else F.lit(False))
        a = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
        b = F.least(F.lit(stop) - F.col("start"), F.col("n_tokens"))
        return self._started(rows, "ids").where(a < b).select(
            self.doc_id, (F.col("start") + a).alias("start"), (b - a).alias("n_tokens"),
            F.slice("ids", (a + 1).cast("int"), (b - a).cast("int")).alias("ids"))

    def checksums(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) as the files have them."""
        name, kind = self.doc_id, self.tokens.schema[self.doc_id].dataType.simpleString()

        def run(batches):
            for batch in batches:
                *kept, ids = batch.columns
                values, at = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B"), ids.offsets.to_pylist()
                crc = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(at, at[1:])]
                n = np.diff(np.array(at, np.int64))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array(crc, pa.int64())],
                                                 names=[name, "shard", "first", "n_tokens", "ids_crc32"])

        read = self.tokens.select(self.doc_id, "shard", "first", "ids").mapInArrow(
            run, f"`{name}` {kind}, shard int, first long, n_tokens long, ids_crc32 long")
        return self._started(read, "ids_crc32")


def write_tokens(docs: DataFrame, tokenizer: str, path: str, layout: Layout = Layout(), doc_id: str = "doc_id",
                 text: str = "text", end: int = END_OF_DOCUMENT) -> TokenFiles:
    """Writes the ids of every whole text, ``end`` behind each, in ascending order of ``doc_id`` below ``path``.

    A null text is empty: its end alone is written. A null id comes first; rows that share an id stand together in any
    order. An empty table gives files without rows. Other columns are not read. ``tokenizer`` is a byte-level file
    readable on every executor. Every file is one task's; a task that runs again writes the same rows.
    """
    rows = encoded(docs, tokenizer, doc_id, text, end)
    rows.write.options(**layout.options()).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    sizes = spark.read.schema(rows.schema).parquet(f"{path}/tokens").groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    sizes.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{path}/shards")
    return TokenFiles(spark, path)
