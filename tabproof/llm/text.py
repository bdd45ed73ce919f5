"""Words, hashes and columns that several operators of this folder need."""

from __future__ import annotations

import ctypes
import functools
import gc
import unicodedata
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words remembered by one Python worker before its memory of them is emptied.
REMEMBERED = 300_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PUNCTUATION = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


_MEMOS: weakref.WeakSet = weakref.WeakSet()
_OWNER = [""]


def turn_to(owner: str) -> None:
    """Called where a task begins: a Python worker that goes on to another operator forgets what the last one remembered."""
    if _OWNER[0] != owner:
        for memo in list(_MEMOS):
            memo.clear()
        _OWNER[0] = owner
        release()


def release() -> None:
    """Gives memory that is free inside this process back to the machine, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Memo(dict):
    """Results of a function by argument, forgotten all at once when there are too many."""

    __hash__, __eq__ = object.__hash__, object.__eq__

    def __init__(self, fn: Callable | None = None, limit: int = REMEMBERED):
        super().__init__()
        self.fn, self.limit = fn, limit
        _MEMOS.add(self)

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Only A-Z become lower case."""
    return F.translate(text, _UPPER, _UPPER.lower())


def as_bytes(df: DataFrame, *ids: str, text: str = "text", names: tuple[str, ...] = ()) -> DataFrame:
    """The id columns (under ``names``, if given) and the whole text as UTF-8, a null text as an empty one."""
    return df.select(*[F.col(i).alias(n) for i, n in zip(ids, names or ids)], F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("utf8"))


def spaced_words(utf8: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return utf8.lower().split()


def plain_words(utf8: bytes) -> list[bytes]:
    """Words without ASCII punctuation and letter case, in composed form."""
    if not utf8.isascii():
        utf8 = unicodedata.normalize("NFC", utf8.decode("utf-8", "replace")).lower().encode()
        return utf8.translate(_PUNCTUATION).split()
    return utf8.lower().translate(_PUNCTUATION).split()


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


_HASHES = Memo(_hash)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits for each word."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


#: A number for each byte in lower case, 0 for white space; the k-th byte of a word counts BASE**k times its number.
_LETTERS = np.random.default_rng(5).integers(1, 2**64, 256, np.uint64, endpoint=False)
_LETTERS[65:91] = _LETTERS[97:123]
_LETTERS[[32, *range(9, 14)]] = 0
_BASE, _UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Bytes of a text that are looked at together, unless one word is longer.
_AT_ONCE = 1 << 15


@functools.lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))))


def spaced_codes(utf8: bytes) -> np.ndarray:
    """64 bits for each of the :func:`spaced_words`, the same for equal words, without making the words."""
    letters = _LETTERS[np.frombuffer(utf8, np.uint8)]
    inside = np.concatenate(([False], letters != 0))
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    out = [np.zeros(0, np.uint64)]
    at = 0
    while at < len(starts):
        # Words that begin within so many bytes, up to the next word's start.
        upto = int(np.searchsorted(starts, starts[at] + _AT_ONCE))
        begin, end = int(starts[at]), int(starts[upto]) if upto < len(starts) else len(letters)
        places = max(2 * _AT_ONCE, 1 << (end - begin).bit_length())
        own = starts[at:upto] - begin
        sums = np.add.reduceat(letters[begin:end] * _powers(_BASE, places)[:end - begin], own)
        out.append(mixed(sums * _powers(_UNBASE, places)[own]))
        at = upto
    return np.concatenate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each run of ``k`` words; a shorter, nonempty text is one run."""
    if 0 < len(hashes) < k:
        k = len(hashes)
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n]
    return mixed(out + np.uint64(k))


def crc_remainder(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def by_row(df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: str, packed: int = 4096) -> DataFrame:
    """Applies ``fn`` (a generator over one row's values) to every row of a partition, with Arrow batches both ways."""
    arrow, owner = to_arrow_schema(StructType.fromDDL(schema)), f"{fn.__module__}.{fn.__qualname__}"

    def run(batches):
        turn_to(owner)
        rows = []
        for batch in batches:
            for part in few(batch):
                for values in zip(*[c.to_pylist() for c in part.columns]):
                    rows.extend(fn(*values))
                    if len(rows) >= packed:
                        yield batch_of(rows, arrow)
                        rows = []
        if rows:
            yield batch_of(rows, arrow)

    return df.mapInArrow(run, schema)


def few(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch some rows at a time, so that only their texts become objects."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
