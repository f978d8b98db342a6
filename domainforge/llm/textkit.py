"""Columnar text kernels: words and n-gram hashes of a whole Arrow batch at once, in numpy, on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_rng = np.random.default_rng(20_240_229)
BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
PRIME = np.uint64(0x9E3779B97F4A7C15)
GRAM_KEYS = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)

#: Bytes of words that are hashed at once.
HASH_CHARS = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes by the definition: everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes by the definition: ASCII letters and digits, and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def sample_texts(df: DataFrame, text: str, most: int) -> list[str]:
    """At most ``most`` distinct texts, those of the smallest hashes. Hashes alone are ordered, so no partition
    sends more than its own share of the sample's texts."""
    hashed = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    last = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return []
    rows = hashed.where(F.col("h") <= last).groupBy("h").agg(F.min("t").alias("t")).collect()
    return [r.t for r in sorted(rows, key=lambda r: r.h)]


def ddl(df: DataFrame) -> str:
    """The columns of ``df`` as a schema text."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def arrow_schema(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(text))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def blocks(batch: pa.RecordBatch, column: str, each: int = 4 << 20, rows: int = 30_000) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with about ``each`` bytes of text, so that work arrays stay small."""
    col = batch.column(batch.schema.get_field_index(column))
    _, at = text_buffers(col)
    start = 0
    while start < len(col):
        end = max(start + 1, int(np.searchsorted(at, at[start] + each, "right")) - 1)
        end = min(end, start + rows, len(col))
        yield batch.slice(start, end - start)
        start = end


class Words:
    """All words of some texts: ``first`` and ``last`` byte (exclusive), 64-bit ``hash``, and ``row`` offsets
    (words of row r are ``row[r]:row[r+1]``)."""

    __slots__ = ("first", "last", "hash", "row", "raw")

    def __init__(self, raw: np.ndarray, at: np.ndarray, member: np.ndarray, hashed: bool = True):
        raw = LOWER[raw]
        inside = member[raw]
        edge = np.empty(len(raw) + 1, bool)
        edge[0] = True
        edge[1:] = False
        edge[at[:-1][at[:-1] < len(raw)]] = True
        before = np.empty(len(raw), bool)
        if len(raw):
            before[0] = False
            before[1:] = inside[:-1]
        begins = inside & (~before | edge[:-1])
        self.raw = raw
        self.first = np.flatnonzero(begins)
        ends = np.empty(len(raw), bool)
        if len(raw):
            ends[-1] = inside[-1]
            ends[:-1] = inside[:-1] & (~inside[1:] | edge[1:-1])
        self.last = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(self.first, at)
        self.hash = self._hashes(inside) if hashed else None

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.first):
            return np.empty(0, np.uint64)
        lengths = self.last - self.first
        power = np.ones(int(lengths.max()), np.uint64)
        power[1:] = PRIME
        np.multiply.accumulate(power, out=power)
        out, total, a = np.empty(len(lengths), np.uint64), np.cumsum(lengths), 0
        while a < len(lengths):  # so many words at once that the work arrays stay small
            b = max(a + 1, int(np.searchsorted(total, total[a] + HASH_CHARS)))
            own = lengths[a:b]
            chars = np.flatnonzero(inside[self.first[a] : self.last[b - 1]])
            starts = np.zeros(len(own), np.int64)
            np.cumsum(own[:-1], out=starts[1:])
            place = np.arange(len(chars)) - np.repeat(starts, own)
            value = BYTE_KEY[self.raw[self.first[a] : self.last[b - 1]][chars]]
            value *= power[place]
            out[a:b] = np.add.reduceat(value, starts)
            a = b
        return mix(out + lengths.astype(np.uint64) * PRIME)

    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def text(self, k: int) -> str:
        return self.raw[self.first[k] : self.last[k]].tobytes().decode("utf-8")


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each row and their row offsets; a row of fewer words, but not none,
    gives its whole sequence as one."""
    count = np.diff(row)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(row), np.int64)
    np.cumsum(made, out=at[1:])
    out = np.empty(int(at[-1]), np.uint64)
    if len(hashes) >= n:
        rolled = hashes[: len(hashes) - n + 1] * GRAM_KEYS[0]
        for k in range(1, n):
            rolled += hashes[k : len(hashes) - n + 1 + k] * GRAM_KEYS[k]
        long = np.flatnonzero(count >= n)
        if len(long):
            src = np.repeat(row[long] - at[long], made[long])
            dst = np.repeat(at[long], made[long]) + (np.arange(int(made[long].sum())) - np.repeat(np.concatenate(([0], np.cumsum(made[long])[:-1])), made[long]))
            out[dst] = rolled[dst + src]
    for r in np.flatnonzero((count > 0) & (count < n)):
        part = hashes[row[r] : row[r + 1]]
        out[at[r]] = (part * GRAM_KEYS[: len(part)]).sum(dtype=np.uint64) ^ GRAM_KEYS[15 - len(part)]
    return mix(out), at


def distinct_per_row(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, and their row offsets."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, owner)) if len(at) > 2 else np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    return v, np.searchsorted(o, np.arange(len(at)))
