"""LM scoring: an interpolated modified Kneser-Ney model of any order, counted in Spark, stored as sorted hash arrays.

Words are counted first and numbered, the frequent ones low. Counts of the longest n-grams, as rows of word numbers, are
merged by ranges of the n-gram's hash; each range gives its part of the counts of the n-grams one word shorter, which are
merged alike, down to words. Every range becomes one file of sorted arrays in the shared folder. Scoring workers
memory-map those files, a bounded number at a time, so neither driver nor workers hold the model. Nothing is pruned.
"""

from __future__ import annotations

import mmap
import os
import shutil
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, batch_rows, discard_at_exit, mix, rows, scratch

#: Hash of the end that every text has as its last token.
END = U64(0x454E44)
#: Numbers of no word: PAD fills up n-grams that would begin before START, the one beginning of a text; UNSEEN has no n-gram.
PAD, START, FIRST_WORD, UNSEEN = 0, 1, 2, 1 << 62
GRAMS_PER_SHARD = 2_000_000
#: Ranges are cut by so many leading bits at a time, so that the parts that travel keep a useful size.
FAN = 11
#: Files that a worker keeps mapped. A batch visits the ranges one after the other, so more of them would not be met again.
MOST_MAPS = 32
#: Words of more bytes are hashed one by one; texts of about so many bytes are cut into words at once.
LONG_WORD, TEXT_BYTES = 64, 1 << 22
#: A-Z lower-cased and each of \x09-\x0D a space; what an eight-byte number keeps of a word's last 0 to 8 bytes.
_PLAIN = bytes(0x20 if 9 <= b <= 13 else b for b in range(256)).lower()
_LAST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_TOKENS_PER_CHAR = 1 / 6
_PARTS = "shard int, blob binary, level int, sums array<long>"


class Store:
    """Files in the shared folder. A file appears whole or not at all, and a task that runs again writes the same one."""

    def __init__(self, root: str):
        self.root = root

    def _place(self):
        if "://" in self.root and not self.root.startswith("file:"):
            from pyarrow import fs

            return fs.FileSystem.from_uri(self.root)
        return None, "/" + self.root.removeprefix("file:").lstrip("/")

    def write(self, name: str, sections: list[bytes]) -> None:
        system, root = self._place()
        part = f"{root}/.{name}-{uuid.uuid4().hex}"
        if system is None:
            os.makedirs(root, exist_ok=True)
            with open(part, "wb") as out:
                out.writelines(sections)
            os.replace(part, f"{root}/{name}")
        else:
            system.create_dir(root, recursive=True)
            with system.open_output_stream(part) as out:
                for s in sections:
                    out.write(s)
            system.move(part, f"{root}/{name}")

    def map(self, name: str) -> mmap.mmap:
        """The file, memory-mapped; from a store that can't be mapped a copy, which is unlinked once mapped."""
        system, root = self._place()
        if system is None:
            with open(f"{root}/{name}", "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        with tempfile.TemporaryFile() as copy, system.open_input_stream(f"{root}/{name}") as source:
            shutil.copyfileobj(source, copy)
            copy.flush()
            return mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ)


def file_of(keys: np.ndarray, bits: int, values: np.ndarray, places: np.ndarray | None = None) -> list[bytes]:
    """Sorted distinct hashes of one range, with their values, as sections of a file.

    The leading ``bits`` of a hash are its range; the next ones lead, by a directory, to a bucket of about eight hashes, of
    which the following 32 bits are stored. So a lookup of an absent hash is answered wrongly about once in 10**9. Rows of
    values that are frequent in the range are stored as one byte, others apart.
    """
    n, width = values.shape
    deep = max(0, int(n // 8).bit_length())
    bucket = (keys << U64(bits)) >> U64(64 - deep) if deep else np.zeros(n, U64)
    directory = np.searchsorted(bucket, np.arange((1 << deep) + 1, dtype=U64))
    rest = (keys << U64(bits + deep)) >> U64(32)
    whole = gram_keys(list(values.T)) if width > 1 else values[:, 0]
    _, first, code, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    common = np.argsort(-count, kind="stable")[:255]
    rank = np.full(len(first), 255, np.uint8)
    rank[common] = np.arange(len(common))
    code = rank[code]
    apart = np.flatnonzero(code == 255)
    sections = [directory.astype(np.uint32), rest.astype(np.uint32), code, values[first[common]].astype(np.int64), apart.astype(np.uint32), values[apart].astype(np.int64)]
    if places is not None:
        sections.append(places.astype(np.uint32))
    head = np.array([n, width, deep, len(common), len(apart), int(places is not None)], np.int64)
    return [head.tobytes(), *(s.tobytes() + bytes(-s.nbytes % 8) for s in sections)]


class Arrays:
    """A file of file_of() as arrays over the mapped memory."""

    def __init__(self, memory, bits: int):
        head = np.frombuffer(memory, np.int64, 6)
        self.n, self.width, self.deep, common, apart, placed = head.tolist()
        self.bits, self._memory, self._at = bits, memory, head.nbytes
        self.directory = self._take(np.uint32, (1 << self.deep) + 1)
        self.rest = self._take(np.uint32, self.n)
        self.code = self._take(np.uint8, self.n)
        self.kinds = self._take(np.int64, common * self.width).reshape(-1, self.width)
        self.apart = self._take(np.uint32, apart)
        self.values = self._take(np.int64, apart * self.width).reshape(-1, self.width)
        self.places = self._take(np.uint32, self.n) if placed else None

    def _take(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self._memory, kind, n, self._at)
        self._at += out.nbytes + -out.nbytes % 8
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each hash is there, its position)."""
        if not self.n:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        bucket = ((keys << U64(self.bits)) >> U64(64 - self.deep)).astype(np.int64) if self.deep else np.zeros(len(keys), np.int64)
        rest = ((keys << U64(self.bits + self.deep)) >> U64(32)).astype(np.uint32)
        at = self.directory[bucket].astype(np.int64)
        size = self.directory[bucket + 1].astype(np.int64) - at
        some = size > 0
        for _ in range(int(size.max(initial=0)).bit_length()):
            half = size >> 1  # 0 where one hash is left, so that nothing moves
            at += half * (self.rest[at + half - 1] < rest)
            size -= half
        at = np.minimum(at, self.n - 1)
        return some & (self.rest[at] == rest), at

    def rows_at(self, at: np.ndarray) -> np.ndarray:
        """Values at positions, a row for each."""
        code = self.code[at].astype(np.int64)
        out = self.kinds[np.minimum(code, len(self.kinds) - 1)]
        own = code == 255
        out[own] = self.values[np.searchsorted(self.apart, at[own])]
        return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, bytes of like weight together."""
    sizes = np.array([x for a in arrays for x in (len(a), a.itemsize)], np.int64)
    parts = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize) for a in arrays]
    planes = [part[:, i].tobytes() for part in parts for i in range(part.shape[1])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes.tobytes(), *planes]))


def unpack(blob: bytes, arrays: int) -> list[np.ndarray]:
    """The arrays of pack(), as int64."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes, at, out = raw[: 16 * arrays].view(np.int64).reshape(-1, 2).tolist(), 16 * arrays, []
    for n, size in sizes:
        plane = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(f"u{size}").ravel()
        out.append(plane.astype(np.int64))
        at += n * size
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max))


#: Numbers of an n-gram below the highest order: its count for smoothing (different words before it; as it occurs where a
#: text begins with it), the sum of the smoothing counts of its followers, and its followers of count 1, 2 and more.
NUMBERS = 5


def hashes_of(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its lower-cased words, then of one end.

    Eight bytes of all words are taken at a time; words of one length up to eight bytes never share a hash.
    """
    raw = b" ".join([*texts, bytes(8)]).translate(_PLAIN)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = np.frombuffer(raw, np.uint8, len(raw) - 8) != 0x20
    edge = inside.copy()
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    edges = np.flatnonzero(edge)
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    hashes = mix(mix(eights[starts] & _LAST[np.minimum(sizes, 8)]) + sizes.astype(U64) * U64(0x9E3779B97F4A7C15))
    more = np.flatnonzero(sizes > LONG_WORD)
    hashes[more] = [xxhash.xxh64_intdigest(raw[a : a + n]) for a, n in zip(starts[more].tolist(), sizes[more].tolist(), strict=True)]
    more = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
    for at in range(8, LONG_WORD, 8):
        more = more[sizes[more] > at]
        hashes[more] = mix(hashes[more] * U64(0x9E3779B97F4A7C15) + (eights[starts[more] + at] & _LAST[np.minimum(sizes[more] - at, 8)]))
    cuts = np.searchsorted(starts, ends)
    return np.split(np.insert(hashes, cuts, END), (cuts + np.arange(1, len(cuts) + 1))[:-1])


def tokens(_, text: str | None) -> np.ndarray:
    """hashes_of() one text; null is an empty one."""
    return hashes_of([(text or "").encode("utf-8", "surrogatepass")])[0]


def tokens_of(column: pa.Array) -> Iterator[np.ndarray]:
    """hashes_of() each text of a column, some megabytes at a time."""
    held, size = [], 0
    for text in column:
        held.append(text.as_buffer() if text.is_valid else b"")
        size += len(held[-1])
        if size >= TEXT_BYTES:
            yield from hashes_of(held)
            held, size = [], 0
    if held:
        yield from hashes_of(held)


def columns_of(t: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token (by its number) the n-gram that ends with it, a column for each place."""
    padded = np.concatenate([np.full(order - 2, PAD, t.dtype), np.full(1, START, t.dtype), t])
    return [padded[i : i + len(t)] for i in range(order)]


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each n-gram of word numbers."""
    key = mix(columns[0].astype(U64) + U64(0x9E3779B97F4A7C15))
    for c in columns[1:]:
        key = mix(key * U64(0x9E3779B97F4A7C15) + mix(c.astype(U64) + U64(1)))
    return key


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Positions at which a new key begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, int)


def _summed(keys: np.ndarray, columns: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted keys of the different n-grams, their words and their summed numbers."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = _firsts(keys)
    return keys[starts], [c[order[starts]] for c in columns], [np.add.reduceat(x[order], starts) if len(keys) else x for x in numbers]


def _cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, begin, end) of sorted keys by their leading bits, for the ranges that have keys."""
    shard = keys >> U64(64 - bits)
    at = _firsts(shard)
    return list(zip(shard[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)], strict=True))


def _parts(blobs: list[tuple[int, bytes]], told: list[tuple[int, int, list[int]]] = ()) -> pa.RecordBatch:
    """Rows of packed n-grams (shard, blob), and of what a range has to tell the driver (shard, level, sums)."""
    shard = [s for s, _ in blobs] + [s for s, _, _ in told]
    blob = [b for _, b in blobs] + [None] * len(told)
    level, sums = [None] * len(blobs) + [x for _, x, _ in told], [None] * len(blobs) + [x for _, _, x in told]
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(blob, pa.binary()), pa.array(level, pa.int32()), pa.array(sums, pa.list_(pa.int64()))], ["shard", "blob", "level", "sums"])


def _packed(keys: np.ndarray, columns: list[np.ndarray], numbers: list[np.ndarray], bits: int) -> list[tuple[int, bytes]]:
    """N-grams cut by range. Rows of a range are sorted by as many columns as fit into 63 bits; of those a column holds
    steps within equal values of the columns before it."""
    wide = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    ordered = next((k for k in range(len(columns), 0, -1) if sum(wide[:k]) <= 63), 1)
    sort = np.zeros(len(keys), np.int64)
    for c, w in zip(columns[:ordered], wide, strict=False):
        sort = sort << w | c.astype(np.int64)
    out = []
    for s, a, b in _cuts(keys, bits):
        order = np.argsort(sort[a:b])
        new = np.zeros(b - a, bool)
        new[0] = True
        steps = []
        for c in columns[:ordered]:
            c = c[a:b][order]
            step = np.where(new, c, np.diff(c, prepend=0))
            new = new | (step != 0)
            steps.append(small(step))
        out.append((s, pack(np.array([ordered], np.uint8), *steps, *(small(c[a:b][order]) for c in [*columns[ordered:], *numbers]))))
    return out


def _unpacked(blobs, n: int, numbers: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns and numbers of n-grams from all blobs."""
    columns, sums = [], []
    for blob in blobs:
        (ordered, *_), *arrays = unpack(blob, 1 + n + numbers)
        new = np.zeros(len(arrays[0]), bool)
        new[0] = True
        found = []
        for step in arrays[:ordered]:
            total = np.cumsum(step)
            starts = np.flatnonzero(new)
            found.append(total - np.repeat(total[starts] - step[starts], np.diff(np.append(starts, len(step)))))
            new = new | (step != 0)
        columns.append([*found, *arrays[ordered:n]])
        sums.append(arrays[n:])
    return [np.concatenate(x) for x in zip(*columns, strict=True)], [np.concatenate(x) for x in zip(*sums, strict=True)]


def _count_words(bits: int, most: int = 2_000_000):
    """Word hashes with their counts, merged while they come, cut by range."""

    def merged(held):
        words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(at, np.concatenate([c for _, c in held]), len(words)).astype(np.int64)

    def flush(words, counts):
        return _parts([(s, pack(np.diff(words[a:b], prepend=U64(0)), small(counts[a:b]))) for s, a, b in _cuts(words, bits)])

    def run(batches):
        held, n = [], 0
        for batch in rows(batches):
            t = list(tokens_of(batch.column(0)))
            if t:
                held.append(np.unique(np.concatenate(t), return_counts=True))
                n += len(held[-1][0])
            if n >= most:
                held = [merged(held)]
                n = len(held[0][0])
                if 2 * n >= most:
                    yield flush(*held[0])
                    held, n = [], 0
        if held:
            yield flush(*merged(held))

    return run


def _rarity(counts: np.ndarray) -> np.ndarray:
    """Class of a word by its count; frequent words have low classes and so low numbers."""
    return 63 - np.log2(np.maximum(counts, 1)).astype(np.int64)


def _merge_words(store: Store, bits: int):
    """Writes a range's sorted words with their counts and places among the range's words of one class of rarity."""

    def run(key, table):
        shard = key[0].as_py()
        found = [unpack(b.as_py(), 2) for b in table.column("blob")]
        words, at = np.unique(np.concatenate([np.cumsum(w.view(U64), dtype=U64) for w, _ in found]), return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, at, np.concatenate([c for _, c in found]))
        kind = _rarity(counts)
        places = np.zeros(len(words), np.int64)
        for k in np.unique(kind).tolist():
            places[kind == k] = np.arange((kind == k).sum())
        store.write(f"word-{shard:06d}", file_of(words, bits, counts[:, None], places))
        return pa.Table.from_batches([_parts([], [(shard, 0, [int(counts.sum()), *np.bincount(kind, minlength=64).tolist()])])])

    return run


def _count_grams(model: KneserNey, bits: int, most: int = 2_000_000):
    """N-grams of the highest order, counted per some million tokens, cut by range."""

    def flush(held):
        sizes = np.array([len(t) for t in held])
        words, at = np.unique(np.concatenate(held), return_inverse=True)
        held.clear()
        numbers = model.numbers(words)[1]
        numbers = numbers.astype(np.int32 if numbers.max() < 1 << 31 else np.int64)[at]
        del words, at
        columns = [np.concatenate(c) for c in zip(*(columns_of(t, model.order) for t in np.split(numbers, np.cumsum(sizes)[:-1])), strict=True)]
        keys, columns, counts = _summed(gram_keys(columns), columns, [np.ones(len(columns[0]), np.int32)])
        return _parts(_packed(keys, columns, counts, min(bits, FAN)))

    def run(batches):
        held, n = [], 0
        for batch in rows(batches):
            for t in tokens_of(batch.column(0)):
                held.append(t)
                n += len(t)
                if n >= most:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _told(table) -> list[tuple[int, int, list[int]]]:
    """The rows of earlier levels for the driver, which only pass through."""
    return [(r["shard"], r["level"], r["sums"]) for r in table.select(["shard", "level", "sums"]).to_pylist() if r["level"] is not None]


def _cut_again(n: int, numbers: int, bits: int, most: int = 4_000_000):
    """Parts of coarse ranges as parts of fine ones, some million n-grams at a time."""

    def flush(held):
        columns, sums = _unpacked(held, n, numbers)
        return _parts(_packed(*_summed(gram_keys(columns), columns, sums), bits))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            told = _told(batch)
            if told:
                yield _parts([], told)
            for blob in batch.column("blob"):
                if blob.is_valid:
                    held.append(blob.as_py())
                    size += len(unpack(held[-1], 2)[1])
                    if size >= most:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return run


def _merge_grams(store: Store, n: int, order: int, bits: int):
    """Writes a range's sorted arrays of n-grams; gives the range's part of the numbers one order below, cut by range."""

    def run(key, table):
        shard, told = key[0].as_py(), _told(table)
        blobs = [b.as_py() for b in table.column("blob") if b.is_valid]
        del table
        if not blobs:
            return pa.Table.from_batches([_parts([], told)])
        columns, numbers = _unpacked(blobs, n, 1 if n == order else NUMBERS)
        del blobs
        keys, columns, numbers = _summed(gram_keys(columns), columns, numbers)
        real = columns[0] != PAD
        c = numbers[0][real]
        if n > 1:
            store.write(f"gram{n}-{shard:06d}", file_of(keys[real], bits, np.stack([x[real] for x in numbers], axis=1)))
            told.append((shard >> max(0, bits - FAN), n, [shard, *((c == i).sum().item() for i in (1, 2, 3, 4)), 0, 0]))
        else:
            store.write(f"gram1-{shard:06d}", file_of(keys, bits, np.stack(numbers, axis=1)))
            told.append((shard >> max(0, bits - FAN), 1, [shard, *((c == i).sum().item() for i in (1, 2, 3, 4)), int((c > 2).sum()), int(c.sum())]))
            return pa.Table.from_batches([_parts([], told)])
        # as the end of n-grams and, after it, as their beginning
        end, begin = columns[1:], [x[real] for x in columns[:-1]]
        none = np.zeros(len(real), np.int64)
        of_end = [np.where(real, 1, numbers[0]), none, none, none, none]
        of_begin = [np.zeros(len(c), np.int64), c, *((x).astype(np.int64) for x in (c == 1, c == 2, c > 2))]
        del keys, numbers
        below = [[np.concatenate(x) for x in zip(*pair, strict=True)] for pair in ((end, begin), (of_end, of_begin))]
        del columns, end, begin, of_end, of_begin
        both = _summed(gram_keys(below[0]), *below)
        return pa.Table.from_batches([_parts(_packed(*both, min(bits, FAN)), told)])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more; halves where a count of counts is zero."""
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), i + 1.0) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)))


@dataclass
class KneserNey:
    """A trained model: where its files lie, which ranges have one, and its global numbers. Workers get it without the files."""

    root: str
    order: int
    word_bits: int
    bits: int
    tokens: int = 0
    vocabulary: int = 0
    bases: np.ndarray | None = None  # first number of the words of a class of rarity, by class and range
    files: dict[str, np.ndarray] = field(default_factory=dict)  # a bit for each range that has a file, by kind
    discounts: dict[int, tuple] = field(default_factory=dict)
    pair_types: int = 0
    leftover: float = 1.0
    _maps: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_maps": OrderedDict()}

    def list_files(self, kind: str, shards: list[int], bits: int) -> None:
        there = np.zeros(1 << bits, bool)
        there[shards] = True
        self.files[kind] = np.packbits(there)

    def _file(self, kind: str, shard: int, bits: int) -> Arrays | None:
        """A range's arrays; None where training found nothing in the range. A listed file that is gone is an error."""
        if kind not in self.files or not self.files[kind][shard >> 3] >> (7 - (shard & 7)) & 1:
            return None
        name = f"{kind}-{shard:06d}"
        if name in self._maps:
            self._maps.move_to_end(name)
        else:
            while len(self._maps) >= MOST_MAPS:
                self._maps.popitem(last=False)
            self._maps[name] = Arrays(Store(self.root).map(name), bits)
        return self._maps[name]

    def numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and numbers of sorted distinct word hashes; 0 and UNSEEN for words that were not in training."""
        count, number = np.zeros(len(words), np.int64), np.full(len(words), UNSEEN)
        for s, a, b in _cuts(words, self.word_bits):
            have = self._file("word", s, self.word_bits)
            if have is not None:
                hit, at = have.find(words[a:b])
                at = at[hit]
                count[a:b][hit] = have.rows_at(at)[:, 0]
                number[a:b][hit] = self.bases[_rarity(count[a:b][hit]), s] + have.places[at]
        return count, number

    def _find(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Rows of numbers of n-gram keys, zeros where a key is absent."""
        order = np.argsort(keys)
        keys = keys[order]
        found = np.zeros((len(keys), 1 if n == self.order else NUMBERS), np.int64)
        for s, a, b in _cuts(keys, self.bits):
            have = self._file(f"gram{n}", s, self.bits)
            if have is not None and have.n:
                hit, at = have.find(keys[a:b])
                found[a:b] = have.rows_at(at)
                found[a:b][~hit] = 0
        out = np.empty_like(found)
        out[order] = found
        return out

    def score(self, sequences: list[np.ndarray]):
        """For each token sequence: number of tokens, known tokens, add-0.1 unigram and model log10 probabilities."""
        sizes = np.array([len(s) for s in sequences])
        starts = np.cumsum(sizes) - sizes
        words, inverse = np.unique(np.concatenate(sequences), return_inverse=True)
        seen, number = self.numbers(words)
        base = np.log10((seen + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))
        columns = [np.concatenate(c) for c in zip(*(columns_of(s, self.order) for s in np.split(number[inverse], starts[1:])), strict=True)]
        p = np.full(len(inverse), 1.0 / (self.vocabulary + 1))
        back, total = np.full(len(p), self.leftover), np.full(len(p), max(self.pair_types, 1))
        for n in range(1, self.order + 1):
            d = np.array([0.0, *self.discounts[n]])
            # of words a row for each different one, and for the beginning at last
            found, each = (self._find(1, gram_keys([np.append(number, START)])), inverse) if n == 1 else (self._find(n, gram_keys(columns[-n:])), slice(None))
            held = np.maximum(found[:, 0] - d[np.minimum(found[:, 0], 3)], 0)
            p = held[each] / np.maximum(total, 1) + back * p
            if n < self.order:
                # what comes before a token is the n-gram that ends one token earlier, or the beginning
                after = found[:, 1]
                share = np.where(after > 0, (found[:, 2:] @ np.array(self.discounts[n + 1])) / np.maximum(after, 1), 1.0)
                total, back = np.roll(after[each], 1), np.roll(share[each], 1)
                total[starts], back[starts] = (after[-1], share[-1]) if n == 1 else (0, 1.0)
        known, base, p = (seen > 0)[inverse].astype(np.int64), base[inverse].astype(np.longdouble), np.log10(p).astype(np.longdouble)
        return sizes, np.add.reduceat(known, starts), *(np.add.reduceat(x, starts).astype(float) for x in (base, p))


def _bits(n: float, most: int) -> int:
    return max(3, int(np.ceil(np.log2(max(1.0, n / most)))))


def train(docs: DataFrame, wanted: Column | None = None, order: int = 3, grams_per_shard: int = GRAMS_PER_SHARD) -> KneserNey:
    """Count all rows of ``docs`` where ``wanted`` holds (null texts are empty ones) and write the model's arrays.

    ``order`` is the length of the longest n-grams, 2 or more. N-grams at the beginning of a text count as they occur
    at every order, since nothing but the beginning comes before them. A range holds about ``grams_per_shard`` n-grams,
    which one task merges in memory. The files stay until the session ends.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    texts = (docs if wanted is None else docs.where(wanted)).select(F.col("text").cast("string").alias("text"))
    size = (texts.agg(F.sum(F.length("text"))).first()[0] or 0) * _TOKENS_PER_CHAR
    root = f"{scratch(spark)}/kneser-ney-{uuid.uuid4().hex}"
    discard_at_exit(spark, root)
    store = Store(root)
    model = KneserNey(root, order, _bits(size / 4, grams_per_shard), _bits(size, grams_per_shard))
    with batch_rows(spark):
        words = texts.mapInArrow(_count_words(model.word_bits), _PARTS).groupBy("shard").applyInArrow(_merge_words(store, model.word_bits), _PARTS).collect()
        by_class = np.zeros((64, 1 << model.word_bits), np.int64)
        for r in words:
            by_class[:, r.shard] = r.sums[1:]
        model.tokens, model.vocabulary = sum(r.sums[0] for r in words), int(by_class.sum())
        model.bases = FIRST_WORD + np.cumsum(np.append(0, by_class.ravel()))[:-1].reshape(by_class.shape)
        model.list_files("word", [r.shard for r in words], model.word_bits)
        parts = texts.mapInArrow(_count_grams(model, model.bits), _PARTS)
        for n in range(order, 0, -1):
            if model.bits > FAN:
                parts = parts.repartition("shard").mapInArrow(_cut_again(n, 1 if n == order else NUMBERS, model.bits), _PARTS)
            parts = parts.groupBy("shard").applyInArrow(_merge_grams(store, n, order, model.bits), _PARTS)
        told = parts.collect()
    for n in range(1, order + 1):
        of = [r.sums for r in told if r.level == n]
        model.list_files(f"gram{n}", [s[0] for s in of], model.bits)
        counts = [sum(s[i] for s in of) for i in range(1, 7)]
        model.discounts[n] = discounts(*counts[:4])
        if n == 1 and counts[5]:
            d = model.discounts[1]
            model.pair_types, model.leftover = counts[5], (d[0] * counts[0] + d[1] * counts[1] + d[2] * counts[4]) / counts[5]
    return model


def score_documents(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity for each row.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end token. Null and empty texts are the end token
    alone. base_score is the add-0.1 unigram's, score the model's log10 probability; perplexity is that of the model
    per token. Whole texts are scored. Repeated rows are each scored; other columns are not read; an empty table gives
    an empty result. A model file that is gone is an error.
    """

    def run(batches):
        for batch in rows(batches, 1_000):
            n, k, base, score = model.score(list(tokens_of(batch.column(1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(k), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(score), pa.array(10.0 ** (-score / n))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    )
