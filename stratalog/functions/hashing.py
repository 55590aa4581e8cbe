"""Byte-exact hashes and Bloom filters as Arrow UDFs, for interchange with other writers.

Spark's own crc32 is another polynomial, and its xxhash64 another hash, so neither replaces these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: The CRC-32C polynomial (reflected), FNV-1a's prime and offset, the second offset
#: and the constants of the double hashing, and the filter's sizes.
CRC32C_POLYNOMIAL = 0x82F63B78
FNV_PRIME = 0x100000001B3
FNV_OFFSET = 0xCBF29CE484222325
SECOND_OFFSET = 0x84222325CBF29CE4
AVALANCHE = 0xFF51AFD7ED558CCD
NONZERO = 0x9E3779B97F4A7C15
BITS_PER_KEY = 10
PROBES = 7
BLOOM_VERSION = 1
MASK = (1 << 64) - 1


@lru_cache
def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (CRC32C_POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


def crc32c_bytes(data: bytes) -> int:
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = table[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def _padded(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix and lengths; null is empty."""
    data = [b"" if v is None else bytes(v) for v in values]
    lens = np.fromiter(map(len, data), np.int64, len(data))
    width = int(lens.max(initial=0))
    out = np.zeros((len(data), width), np.uint8)
    out[np.arange(width)[None, :] < lens[:, None]] = np.frombuffer(b"".join(data), np.uint8)
    return out, lens


def fnv_vector(values: pd.Series, seed: int) -> np.ndarray:
    rows, lens = _padded(values)
    h = np.full(len(rows), seed, np.uint64)
    for j in range(rows.shape[1]):
        live = lens > j
        h[live] = (h[live] ^ rows[live, j].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return h


def bloom_pair(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    a, b = fnv_vector(values, FNV_OFFSET), fnv_vector(values, SECOND_OFFSET)
    b ^= b >> np.uint64(33)
    b *= np.uint64(AVALANCHE)
    b ^= b >> np.uint64(33)
    return a, np.where(b == 0, np.uint64(NONZERO), b)


def _crc32c(values: pd.Series) -> pd.Series:
    rows, lens = _padded(values)
    table = np.array(_crc_table(), np.uint32)
    c = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for j in range(rows.shape[1]):
        live = lens > j
        c[live] = table[(c[live] ^ rows[live, j]) & np.uint32(0xFF)] ^ (c[live] >> np.uint32(8))
    return pd.Series((c ^ np.uint32(0xFFFFFFFF)).astype(np.int64))


def _fnv1a64(values: pd.Series) -> pd.Series:
    return pd.Series([f"{int(x):016x}" for x in fnv_vector(values, FNV_OFFSET)])


def _uvarint(values: pd.Series) -> pd.Series:
    def one(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    return values.map(lambda v: one(int(v)))


def crc32c(data: Column) -> Column:
    return pandas_udf(_crc32c, "long")(data)


def fnv1a64(data: Column) -> Column:
    """Sixteen hex digits: Spark has no unsigned 64-bit integer."""
    return pandas_udf(_fnv1a64, "string")(data)


def uvarint(number: Column) -> Column:
    return pandas_udf(_uvarint, "binary")(number)


def bloom_bits(keys: int) -> int:
    return max(8, BITS_PER_KEY * keys)


def bloom_filters(rows: DataFrame, group: str, key: str) -> DataFrame:
    """group, n, filter: one serialised Bloom filter a group (version, probes, bits, then the bit
    array), over distinct keys. Each batch sets its bits in 64-bit words; words are combined before
    a group is put together, so what a task gathers is the filter, not the keys."""
    counts = rows.groupBy(group).agg(F.count_distinct(key).alias("n"))
    sized = rows.select(group, F.col(key).cast("binary").alias("k")).distinct().join(counts, group)
    kind = dict(rows.dtypes)[group]

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = bloom_pair(pdf["k"])
            m = np.maximum(8, BITS_PER_KEY * pdf["n"].to_numpy(np.uint64)).astype(np.uint64)
            for name, at in pdf.groupby(group, sort=False, dropna=False).indices.items():
                bit = np.concatenate([(a[at] + np.uint64(i) * b[at]) % m[at] for i in range(PROBES)])
                word, place = np.unique(bit >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(bits, place, np.uint64(1) << (bit & np.uint64(63)))
                yield pd.DataFrame({group: pdf[group].iloc[at[0]], "n": pdf["n"].iloc[at[0]], "word": word.astype(np.int64), "v": bits.view(np.int64)})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        m = bloom_bits(int(pdf["n"].iloc[0]))
        body = np.zeros(-(-m // 64), np.uint64)
        body[pdf["word"].to_numpy()] = pdf["v"].to_numpy(np.int64).view(np.uint64)
        data = bytes([BLOOM_VERSION, PROBES]) + m.to_bytes(8, "little") + body.astype("<u8").tobytes()[: -(-m // 8)]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [int(pdf["n"].iloc[0])], "filter": [data]})

    set_words = sized.mapInPandas(words, f"{group} {kind}, n long, word long, v long").groupBy(group, "n", "word").agg(F.bit_or("v").alias("v"))
    return set_words.groupBy(group).applyInPandas(build, f"{group} {kind}, n long, filter binary")


#: Keys that are probed in one task, about.
PROBE_KEYS = 4_000_000


def may_contain(rows: DataFrame, filters: DataFrame, group: str, key: str) -> DataFrame:
    """group, key, hit: whether the filter of its group may hold each key; a group without a filter
    holds nothing. A filter meets its keys once a task, in slices of about ``PROBE_KEYS`` keys by the
    number of keys that it was made for."""
    slices = (1 + F.floor(F.col("n") / PROBE_KEYS)).cast("int")
    sizes = filters.select(group, slices.alias("slices"))
    left = rows.select(group, key).join(sizes, group, "left").withColumn("slice", F.pmod(F.xxhash64(key), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    right = filters.select(group, "filter", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))

    def probe(keys: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(keys), bool)
        if len(found) and len(keys):
            hit = _probe(bytes(found["filter"].iloc[0]), keys[key])
        return pd.DataFrame({group: keys[group], key: keys[key], "hit": hit})

    types = dict(rows.dtypes)
    return left.groupBy(group, "slice").cogroup(right.groupBy(group, "slice")).applyInPandas(probe, f"{group} {types[group]}, {key} {types[key]}, hit boolean")


def contains(data: bytes, key: bytes) -> bool:
    """Membership in a serialised filter; a malformed one is an error."""
    m = int.from_bytes(data[2:10], "little")
    if len(data) < 11 or data[0] != BLOOM_VERSION or data[1] != PROBES or m == 0 or len(data) - 10 != -(-m // 8):
        raise ValueError("malformed filter")
    return bool(_probe(data, pd.Series([key]))[0])


def _probe(data: bytes, keys: pd.Series) -> np.ndarray:
    a, b = bloom_pair(keys)
    m, body = np.uint64(int.from_bytes(data[2:10], "little")), np.frombuffer(data, np.uint8, offset=10)
    out = np.ones(len(keys), bool)
    for i in range(PROBES):
        bit = (a + np.uint64(i) * b) % m
        out &= (body[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
