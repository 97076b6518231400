"""Benchmark decontamination: n-gram seeds join passages to test items, then Smith-Waterman alignment scores them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, Rolling, WordHashes, rows, split_words

#: Text of the items that travel together; with their seeds and words they take about 26 times that in a worker.
MOST_ITEM_BYTES = 4 << 20
#: Cells of one row of the alignment, over all passages aligned together.
MOST_CELLS = 1 << 18
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class PlainWords(WordHashes):
    """Hash of a word in lower case without punctuation at its ends; 0 where nothing is left."""

    def of(self, word: bytes) -> int:
        bare = word.decode("utf-8", "replace").lower()
        bare = bare if bare.isalnum() else _EDGE.sub("", bare)
        return super().of(bare.encode("utf-8", "replace")) | 1 if bare else 0


def plain(known: PlainWords, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the non-empty plain words and their positions among all words."""
    h = known.array(split_words(text))
    at = np.flatnonzero(h)
    return h[at], at


def align(item: np.ndarray, passages: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Smith-Waterman (match 2, mismatch -1, gap -1): (score, begin, end) of the best local alignment in each passage."""
    longest = max(map(len, passages))
    grid = np.zeros((len(passages), longest), U64)
    for row, p in zip(grid, passages, strict=True):
        row[: len(p)] = p
    h = np.zeros((len(passages), longest + 1), np.int32)
    start = np.broadcast_to(np.arange(longest + 1, dtype=np.int32), h.shape).copy()
    best = np.zeros((len(passages), 3), np.int64)
    steps = np.arange(longest + 1, dtype=np.int32)
    for word in item:
        diagonal = h[:, :-1] + np.where(grid == word, 2, -1).astype(np.int32)
        up = h[:, 1:] - 1
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(np.maximum(diagonal, up), 0)
        begin = np.broadcast_to(steps, h.shape).copy()
        begin[:, 1:] = np.where(new[:, 1:] == 0, begin[:, 1:], np.where(diagonal >= up, start[:, :-1], start[:, 1:]))
        # a gap along the passage costs 1 a word: running maximum of score + position
        run = np.maximum.accumulate(new + steps, axis=1)
        gapped = run - steps
        source = np.maximum.accumulate(np.where(new + steps == run, steps, 0), axis=1)
        longer = gapped > new
        begin = np.where(longer, np.take_along_axis(begin, source, axis=1), begin)
        h, start = np.where(longer, gapped, new), begin
        top = h.argmax(axis=1)
        score = np.take_along_axis(h, top[:, None], axis=1)[:, 0]
        better = score > best[:, 0]
        best[better] = np.stack([score, np.take_along_axis(start, top[:, None], axis=1)[:, 0], top], axis=1)[better]
    return [tuple(map(int, b)) for b in best]


class Items:
    """Test items with their seeds: all n-grams of an item, the whole item where it has fewer than n words."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        known = PlainWords()
        self.ids, self.words = [], []
        for item, text in items:
            h, _ = plain(known, text)
            if len(h):
                self.ids.append(item)
                self.words.append(h)
        self.sizes = np.array([len(h) for h in self.words], np.int64)
        self.widths = sorted(set(np.minimum(self.sizes, n).tolist()))
        grams = [np.unique(Rolling(h).windows(min(n, len(h)))) for h in self.words]
        # seeds, items of each seed and seeds of each item; words, and the words of each item with their numbers
        self.seeds, of_item = np.unique(np.concatenate([np.zeros(0, U64), *grams]), return_inverse=True)
        self.seeds_of = np.split(of_item, np.cumsum([len(g) for g in grams])[:-1]) if grams else []
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.owners = owner[np.argsort(of_item, kind="stable")]
        self.owners_at = np.concatenate([[0], np.cumsum(np.bincount(of_item, minlength=len(self.seeds)))])
        bags = [np.unique(h, return_counts=True) for h in self.words]
        self.vocabulary, self.bag = np.unique(np.concatenate([np.zeros(0, U64), *(w for w, _ in bags)]), return_inverse=True)
        self.times = np.concatenate([np.zeros(0, np.int64), *(m for _, m in bags)])
        self.bag_at = np.concatenate([[0], np.cumsum([len(w) for w, _ in bags], dtype=np.int64)])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seeds >> U64(44)).astype(np.int64)] = True

    def _hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the passage at which a seed begins, and the seeds."""
        rolling, found = Rolling(h), []
        for width in self.widths:
            if len(h) >= width:
                grams = rolling.windows(width)
                likely = np.flatnonzero(self.maybe[(grams >> U64(44)).astype(np.int64)])
                slot = np.searchsorted(self.seeds, grams[likely])
                slot[slot == len(self.seeds)] = 0
                sure = self.seeds[slot] == grams[likely]
                found.append((likely[sure], slot[sure]))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2

    def regions(self, h: np.ndarray, threshold: float) -> dict[int, list[tuple[int, int]]]:
        """For each item seeded in the passage the regions to align, merged where they overlap.

        An item, and then a region, with too few of the item's words for the threshold, even if all aligned, is left
        out. The words are looked up for all items of a seed together, so a seed that many items share costs little.
        """
        hits, slots = self._hits(h)
        if not len(hits):
            return {}
        seeded = np.unique(np.concatenate([self.owners[self.owners_at[x] : self.owners_at[x + 1]] for x in np.unique(slots).tolist()]))
        ids = np.searchsorted(self.vocabulary, h)
        ids[ids == len(self.vocabulary)] = 0
        ids[self.vocabulary[ids] != h] = len(self.vocabulary)
        there = np.zeros(len(self.vocabulary) + 1, bool)
        there[ids] = True
        there[-1] = False
        kept = {}
        for k in range(0, len(seeded), 4096):
            part = seeded[k : k + 4096]
            size = self.bag_at[part + 1] - self.bag_at[part]
            begin = np.cumsum(size) - size
            at = np.repeat(self.bag_at[part] - begin, size) + np.arange(size.sum())
            for i in part[np.add.reduceat(self.times[at] * there[self.bag[at]], begin) >= threshold * self.sizes[part]].tolist():
                kept[i] = []
        there[:] = False
        for i in list(kept):
            reach, found = 2 * len(self.words[i]), []
            for at in np.sort(hits[np.isin(slots, self.seeds_of[i])]).tolist():
                a, b = max(0, at - reach), min(len(h), at + reach)
                if found and a <= found[-1][1]:
                    found[-1][1] = b
                else:
                    found.append([a, b])
            mine = slice(self.bag_at[i], self.bag_at[i + 1])
            for a, b in found:
                there[ids[a:b]] = True
                if self.times[mine] @ there[self.bag[mine]] >= threshold * len(self.words[i]):
                    kept[i].append((a, b))
                there[ids[a:b]] = False
        return {i: found for i, found in kept.items() if found}


def _alike(cases: list) -> Iterator[list]:
    """Cases, sorted by length, at most 64 at a time and few enough that a row of their alignment stays small."""
    part: list = []
    for c in cases:
        if part and (len(part) >= 64 or (len(part) + 1) * len(c[2]) > MOST_CELLS):
            yield part
            part = []
        part.append(c)
    if part:
        yield part


def _search(shared, threshold: float):
    def run(batches):
        known = PlainWords()
        items = shared.value
        for batch in rows(batches, 1_000):
            todo = defaultdict(list)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, at = plain(known, text.as_py())
                for i, regions in items.regions(h, threshold).items():
                    todo[i] += [(doc, at[a:b], h[a:b]) for a, b in regions]
            out = []
            for i, cases in todo.items():
                cases.sort(key=lambda c: len(c[2]))
                for part in _alike(cases):
                    for (doc, at, _), (score, begin, end) in zip(part, align(items.words[i], [c[2] for c in part]), strict=True):
                        if score >= threshold * 2 * len(items.words[i]):
                            out.append((doc, items.ids[i], score / (2 * len(items.words[i])), int(at[begin]), int(at[end - 1]) + 1))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "score", "begin", "end"])

    return run


def item_blocks(benchmark: DataFrame, n: int = 3) -> Iterator[Broadcast]:
    """The benchmark's items in blocks of at most about MOST_ITEM_BYTES of text, each sent to the workers."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.length("text") * 4)).first()[0] or 0
    blocks = size // MOST_ITEM_BYTES + 1
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in part.orderBy("item_id", "text").collect()], n))


def _leaky(shared: Broadcast, threshold: float):
    @F.arrow_udf("boolean")
    def leaky(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), texts], ["doc_id", "text"])
        found = {d for part in _search(shared, threshold)([batch]) for d in part.column(0).to_pylist()}
        return pa.array([i in found for i in range(len(texts))], pa.bool_())

    return leaky


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item is found; a filter, so no row moves. See find_leaks().

    Rows without a text stay. Repeated rows are judged alike. An empty benchmark keeps all.
    """
    for shared in item_blocks(benchmark, **settings):
        docs = docs.where(~_leaky(shared, threshold)(F.col("text").cast("string")))
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """Passages that copy a test item: doc_id, item_id, score, begin, end (word positions, end exclusive).

    A document meets an item through any n-gram of the item, however many items share it and however common it is in
    the corpus, and the surroundings are aligned with the whole item; an item under ``n`` words is met through all its
    words in a row. score is the alignment's score over that of a perfect copy; rows reach ``threshold``. Words compare
    in lower case without punctuation at their ends.

    Null or empty texts match nothing, and so do items without a word. Whole texts are searched, and each word of a
    document is aligned with an item once, however many seeds of the item surround it. Repeated documents each give
    their rows; equal items each give theirs; of equally good alignments in a region the first is told. Empty tables
    give an empty result; other columns are not read. Items travel to the workers in blocks of at most 4 MB of text,
    a pass over the documents for each block. An edited copy without any ``n`` words of the item in a row is not found.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id long, item_id long, score double, begin long, end long"
    out = None
    for shared in item_blocks(benchmark, n):
        found = docs.mapInArrow(_search(shared, threshold), schema)
        out = found if out is None else out.unionByName(found)
    return out


def judge_documents(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """A row for each input row: doc_id, n_items, item_ids (sorted), best_score, contaminated; see find_leaks."""
    leaks = find_leaks(docs, benchmark, **settings).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("score").alias("best_score"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(leaks, "doc_id", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<long>"))
    return out.select("doc_id", F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"), F.col("item_ids").isNotNull().alias("contaminated"))
