"""Row hashes that treat equal rows alike, and hash sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .names import c

# Bits of a hash that are summed at a time: 2**43 rows fit a long before it overflows.
SUM_BITS = 20
SUM_MASK = (1 << SUM_BITS) - 1


def has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(has_map(f.dataType) for f in dtype.fields)
    return False


def ordered_maps(col: Column, dtype: T.DataType) -> Column:
    """Maps as arrays of entries in key order, at any depth, so that they hash and sort."""
    if not has_map(dtype):
        return col
    if isinstance(dtype, T.MapType):
        entries = F.transform(F.map_entries(col), lambda e: F.struct(
            ordered_maps(e["key"], dtype.keyType).alias("key"),
            ordered_maps(e["value"], dtype.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: ordered_maps(x, dtype.elementType))
    parts = [ordered_maps(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
    return F.when(col.isNotNull(), F.struct(*parts))


def hashable(df: DataFrame) -> list[Column]:
    """All columns in a form that can be hashed, maps included."""
    return [ordered_maps(c(f.name), f.dataType) for f in df.schema.fields]


def row_hash(hashes: list[str]) -> str:
    """SQL text: hash of a row from the hashes of its values, which are never null."""
    return f"xxhash64({', '.join(hashes)})"


def hash_total(hashed: str) -> str:
    """SQL text: order-free checksum of a column of hashes, as a plain long sum."""
    return f"coalesce(sum({hashed} & {SUM_MASK}L), 0L)"


def hash_totals(hashed: str) -> list[str]:
    """SQL texts: checksums of three stretches of the hash, nearly all of its bits."""
    return [f"coalesce(sum(shiftright({hashed}, {SUM_BITS * i}) & {SUM_MASK}L), 0L)" for i in range(3)]


def sample_slot(keys: list[Column], seed: int) -> Column:
    """A number in ``[0, 2**32)`` that depends only on the seed and the key values.

    Each value carries its length, so that no two key tuples read alike.
    """
    texts = [F.coalesce(F.concat(F.length(k.cast("string")).cast("string"), F.lit(":"),
                                 k.cast("string")), F.lit("-")) for k in keys]
    text = reduce(lambda a, b: F.concat(a, F.lit("|"), b), texts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def in_sample(keys: list[Column], percent: float, seed: int = 42) -> Column:
    """Whether a key belongs to the sample; any file layout gives the same answer."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must lie in (0, 100], got {percent}")
    return sample_slot(keys, seed) < F.lit(int(percent / 100.0 * 2**32))
