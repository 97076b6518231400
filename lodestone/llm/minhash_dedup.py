"""MinHash near-dedup by fast similarity sketching.

Each of the sketch's ``bins`` coordinates is filled in rounds: in the first ``bins`` rounds every shingle is placed in a
hashed bin, and round bins + i places all in bin i, so every coordinate fills after at most 2 * bins rounds; the share of
equal coordinates is concentrated around the Jaccard similarity. Bands of the sketch give candidates; full shingle sets
confirm them in exact integer arithmetic.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, Rolling, WordHashes, components, discard, groups, list_array, longs, materialize, mix, rows

_GOLD = U64(0x9E3779B97F4A7C15)
TILE = 2048
TILE_SHINGLES = 2_000_000


def _lower(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes; the whole sequence as one when it has fewer words; none without words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, U64)
    rolling = Rolling(hashes)
    return np.unique(rolling.windows(width)) if n >= width else rolling.spans(np.array([0]), np.array([n]))


def sketch(x: np.ndarray, bins: int = 128) -> np.ndarray:
    """Sketch of a non-empty set of hashes; the coordinate's value holds the round that filled it and the hash."""
    out = np.full(bins, np.iinfo(np.uint64).max, U64)
    begin, step = 0, max(1, math.ceil(bins * (math.log(bins) + 2) / len(x)))
    while begin < 2 * bins:
        end = min(2 * bins, begin + step, bins if begin < bins else 2 * bins)
        rounds = np.arange(begin, end, dtype=U64)[:, None]
        h = mix(x[None, :] + (rounds + U64(1)) * _GOLD)
        at = (h % U64(bins) if begin < bins else np.broadcast_to(rounds - U64(bins), h.shape)).astype(np.int64)
        np.minimum.at(out, at.ravel(), ((rounds << U64(48)) | (h >> U64(16))).ravel())
        if begin < bins and out.max() < np.iinfo(np.uint64).max:
            # a later round's value exceeds an earlier one's, so rounds beyond the first full one change nothing
            break
        begin = end
        if begin >= bins:
            step = bins
    return out


def band_keys(s: np.ndarray, width: int) -> np.ndarray:
    parts = s.reshape(-1, width)
    key = np.arange(len(parts), dtype=U64) * _GOLD
    for i in range(width):
        key = mix(key + parts[:, i])
    return key


def _sketches(width: int, bins: int, band: int):
    def run(batches):
        known = WordHashes()
        for batch in rows(batches):
            n, s1, s2, keys = [], [], [], []
            for text in batch.column(1):
                x = shingles(known.array(_lower(text.as_py())), width)
                n.append(len(x))
                s1.append(mix(x).sum(dtype=U64))
                s2.append(mix(x ^ U64(0xE7037ED1A0B428DB)).sum(dtype=U64))
                keys.append(band_keys(sketch(x, bins), band) if len(x) else x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), longs(np.array(s1, U64)), longs(np.array(s2, U64)), list_array(keys)], ["doc_id", "n", "s1", "s2", "bands"]
            )

    return run


def _sets(width: int):
    def run(batches):
        known = WordHashes()
        for batch in rows(batches, 500):
            found = [shingles(known.array(_lower(text.as_py())), width) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, found)), pa.int64()), list_array(found)], ["rep", "n", "shingles"])

    return run


def intersections(sets: list[np.ndarray], dense_from: int = 24, block: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, exact.

    Shingles of few sets are counted pair by pair of those sets; the others as products of 0/1 matrices, some thousand
    shingles at a time (sums stay far below 2**24, so single precision is exact).
    """
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    row, flat = row[order], flat[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, int)
    times = np.diff(np.append(starts, len(flat)))
    out = np.zeros(n * n, np.float32)
    for c in np.unique(times[(times > 1) & (times < dense_from)]).tolist():
        i, j = np.triu_indices(c, 1)
        at = starts[times == c]
        for k in range(0, len(at), 20_000):
            of = row[at[k : k + 20_000, None] + np.arange(c)]
            np.add.at(out, (of[:, i] * n + of[:, j]).ravel(), 1)
    out = out.reshape(n, n)
    out += out.T
    often = np.flatnonzero(times >= dense_from)
    for k in range(0, len(often), block):
        part = often[k : k + block]
        x = np.zeros((n, len(part)), np.float32)
        size = times[part]
        at = np.repeat(starts[part], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        x[row[at], np.repeat(np.arange(len(part)), size)] = 1
        out += x @ x.T
    return out


def _joined_components(percent: int):
    """Of each tile: the pairs of components that a link joins, as few as tell which components come together.

    All pairs of the tile (between its two sides, where it has two) are confirmed on the full sets.
    """

    def run(batches):
        for table in groups(batches, "tile"):
            comps, side = (table.column(c).to_numpy() for c in ("comp", "side"))
            sets = [np.asarray(x.values).view(U64) for chunk in table.column("shingles").chunks for x in chunk]
            n = np.array([len(x) for x in sets], np.int64)
            common = intersections(sets)
            p, q = np.nonzero((100 + percent) * common.astype(np.float64) >= percent * (n[:, None] + n[None, :]))
            keep = (comps[p] != comps[q]) & ((side[p] < side[q]) if side.any() else (p < q))
            a, b = np.minimum(comps[p], comps[q])[keep], np.maximum(comps[p], comps[q])[keep]
            of: dict[int, int] = {}

            def root(c, of=of):
                while of.setdefault(c, c) != c:
                    of[c] = c = of[of[c]]
                return c

            joined = []
            for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist():
                x, y = root(x), root(y)
                if x != y:
                    of[max(x, y)] = min(x, y)
                    joined.append((min(x, y), max(x, y)))
            if joined:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*joined, strict=True)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, bins: int = 128, band: int = 4, hubs: int = 3) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, class_id (smallest doc_id of the same shingle set), component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Documents link when 100 * |A & B| >= percent * |A | B| on the full
    sets. A pair at 0.75 shares a band of ``band`` of 128 coordinates with probability 1 - (1 - 0.75**4)**32 > 0.99999.
    Equal sets collapse to one representative first. Members of a bucket are then compared with ``hubs`` of them and
    linked into components; in buckets that still hold several components, all pairs but those inside the largest one are
    confirmed on the full sets, in tiles. Links inside a component change nothing and tiles give only the components
    that they join, so no group is expanded into rows of pairs. With ``band`` = 1 the chance to lose a link is below
    10**-70, at the cost of larger buckets.

    Null or empty text: no shingles, linked with nothing, kept. Null doc_id: component_id and kept are null. Rows
    repeated with one doc_id share its component. Empty table: empty result.
    """
    if bins % band:
        raise ValueError("bins must be a multiple of band")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = materialize(
        docs.mapInArrow(_sketches(width, bins, band), "doc_id long, n long, s1 long, s2 long, bands array<long>"), "sketches"
    )
    named = sketched.where("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    in_bands = classes.select("rep", F.posexplode("bands").alias("t", "key"))
    shared = in_bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")  # a key holds its band's number
    members = materialize(in_bands.join(shared, "key", "left_semi"), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "rep long, n long, shingles array<long>")
    sets = materialize(sets, "sets")
    hub = [F.min_by("rep", F.xxhash64("rep", F.lit(i))).alias(f"h{i}") for i in range(1, hubs)]
    pairs = members.join(members.groupBy("key").agg(F.min("rep").alias("h0"), *hub), "key").select("rep", F.explode(F.array_distinct(F.array(*(f"h{i}" for i in range(hubs))))).alias("hub")).where("rep <> hub")
    pairs = pairs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    links = materialize(_confirm(pairs, sets, percent), "links")
    comp = materialize(components(links), "components")
    discard(links)
    at = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("t", "key", "rep", F.coalesce("component", "rep").alias("comp"))
    at = at.join(classes.select("rep", "n"), "rep")
    # in a bucket the members of its largest component need not meet each other, only the rest
    by_comp = at.groupBy("t", "key", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    open_ = by_comp.groupBy("t", "key").agg(F.max(F.struct("size", "weight", "comp")).alias("main"), F.sum("size").alias("size"), F.sum("weight").alias("weight")).where("size > main.size")
    chunks = lambda size, weight: F.greatest(F.ceil(size / TILE), F.ceil(weight / TILE_SHINGLES)).cast("int")
    rest = chunks(F.col("size") - F.col("main.size"), F.col("weight") - F.col("main.weight"))
    open_ = open_.select("t", "key", F.col("main.comp").alias("main"), chunks(F.col("main.size"), F.col("main.weight")).alias("mains"), rest.alias("rests"))
    met, inside = at.join(open_, ["t", "key"]), F.col("comp") == F.col("main")
    met = met.withColumn("chunk", F.when(inside, -1 - F.pmod(F.xxhash64("rep"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("rests"))).cast("int"))
    others = F.sequence(F.when(inside, 0).otherwise(-F.col("mains")), F.col("rests") - 1)
    met = met.join(sets.select("rep", "shingles"), "rep").withColumn("other", F.explode(others))
    tile = F.xxhash64("t", "key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    met = met.select(tile.alias("tile"), "rep", "comp", "shingles", (F.col("chunk") > F.col("other")).cast("int").alias("side"))
    met = met.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "tile").sortWithinPartitions("tile", "side", "rep")
    more = materialize(met.mapInArrow(_joined_components(percent), "a long, b long"), "joined")
    discard(members, sets)
    over = components(more).toDF("component", "top")
    discard(more)
    comp = comp.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component")).unionByName(
        over.join(comp.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
    )
    found = sketched.join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"], "left")
    found = found.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link by their full shingle sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("xb"))
    both = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    common = F.size(F.array_intersect("xa", "xb")).cast("long")
    return both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")
