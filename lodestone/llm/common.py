"""Shared pieces of the training-data operators: scratch tables, word hashing, rolling hashes, grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.tables import batch_rows, discard, discard_at_exit, materialize, scratch, small_batches  # noqa: F401  of these operators, too

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for at most ``most`` words at a time."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def of(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.of(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in order; bytes.split() breaks at just these bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Rolling:
    """Rabin-Karp hashes of any span of a word sequence, modulo 2**64, from one prefix sum."""

    _powers = np.ones(1, U64)
    _inverses = np.ones(1, U64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if len(Rolling._powers) < n + 1:
            size = 2 * n + 1
            with np.errstate(over="ignore"):
                Rolling._powers = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, _BASE))])
                Rolling._inverses = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, _INVERSE))])
        self.prefix = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * Rolling._powers[:n], dtype=U64)])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.prefix[ends] - self.prefix[starts]) * Rolling._inverses[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        n = len(self.prefix) - 1 - width + 1
        return mix((self.prefix[width:] - self.prefix[:n]) * Rolling._inverses[:n] + U64(width * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, done = a, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def longs(a) -> pa.Array:
    """uint64 values as Spark's signed longs, bit for bit."""
    return pa.array(np.ascontiguousarray(a, U64).view(np.int64))


def list_array(parts: list[np.ndarray]) -> pa.Array:
    """One list<int64> from each array."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), longs(np.concatenate(parts) if parts else np.zeros(0, U64)))


def rows(batches: Iterator[pa.RecordBatch], most: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most``, so that working memory does not follow Arrow's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of equal ``key`` from batches that are sorted by it; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def crc_of(column: str):
    """crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list, distributed: (node, component = smallest node id).

    Alternates large-star and small-star steps until the edges are stars. Each step keeps connectivity and groups
    only by min, so no neighbourhood is gathered in one task; a written table cuts lineage after each round.
    Nulls, loops and repeated edges are allowed; nodes without an edge are absent.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = materialize(e, "cc")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            break
        before = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        last, e = e, materialize(small.where("u > v").distinct(), "cc")
        discard(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
