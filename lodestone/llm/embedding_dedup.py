"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

A rotation learned on a bounded sample turns vectors into balanced binary codes. Codes are cut into substrings, one
table each; vectors of one label that agree on a substring meet there, with their codes alone. Pairs that meet for the
first time and lie within a Hamming radius are candidates. Only vectors that have one travel on, to be compared by
cosine in double precision. Links come out as counts and spanning edges, so a large group is never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batch_rows, components, discard, materialize

TILE = 2048
#: Up to so many vectors of one length are compared within their label, without tables.
FEW = 2048
#: Vectors of a bucket that the number of bits aims at.
BUCKET = 1000


def learn_rotation(x: np.ndarray, seed: int, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(centre, rotation) that minimise the quantisation error of sign(rotated vectors), by alternating steps.

    The centre is the mean and then, in the rotated space, each direction's median, so each bit is balanced.
    """
    mean = x.mean(axis=0)
    centred = x - mean
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(steps):
        u, _, v = np.linalg.svd(np.where(centred @ rotation >= 0, 1.0, -1.0).T @ centred)
        rotation = (u @ v).T
    return mean + np.median(centred @ rotation, axis=0) @ rotation.T, rotation


def pairs_at(x: np.ndarray, threshold: float, n: int = 4000, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the sample with partners at the very threshold, half of them towards another vector of the sample."""
    rng = np.random.default_rng(seed)
    a = x[rng.integers(len(x), size=n)]
    way = np.where(np.arange(n)[:, None] % 2, x[rng.integers(len(x), size=n)], rng.normal(size=a.shape))
    way = way - (way * a).sum(axis=1, keepdims=True) * a
    size = np.linalg.norm(way, axis=1, keepdims=True)
    sound = size[:, 0] > 1e-6
    a, way, size = a[sound], way[sound], size[sound]
    return a, threshold * a + np.sqrt(1 - threshold**2) * way / size


def plan_tables(x: np.ndarray, n: int, threshold: float, recall: float, most: int = 4096) -> tuple[list, int, int, int]:
    """(rotations, bits of a substring, tables, Hamming radius) for n vectors of which x is a sample.

    Bits follow from n, so that a bucket holds about BUCKET vectors. How well codes of vectors at the threshold agree is
    measured on the sample; the tables are as many as the recall wanted needs, and the radius lets all those pairs
    through. Where even ``most`` tables are too few, bits are taken away.
    """
    dim = x.shape[1]
    bits = min(dim, 32, max(6, round(float(np.log2(n / BUCKET)))))
    a, b = pairs_at(x, threshold)
    models: list = []
    while True:
        per = dim // bits
        while len(models) * dim < 256:
            models.append(learn_rotation(x, len(models)))
        agree = np.concatenate([(a - m) @ r >= 0 for m, r in models], axis=1) == np.concatenate([(b - m) @ r >= 0 for m, r in models], axis=1)
        meet = agree.mean(axis=1) ** bits
        found = lambda t, meet=meet: 1 - np.mean((1 - meet) ** t)
        tables = next((t for t in range(1, most + 1) if found(t) >= recall), None)
        if tables or bits == 1:
            break
        bits -= 1
    tables = tables or most
    while len(models) * per < tables:
        models.append(learn_rotation(x, len(models)))
    models = models[: -(-tables // per)]
    apart = distances(*(substrings(v, models, bits, tables) for v in (a, b)))
    return models, bits, tables, int(apart.max()) + 2


def substrings(x: np.ndarray, models: list, bits: int, tables: int) -> np.ndarray:
    """The value of each table's substring for each vector, shape (vectors, tables)."""
    codes = np.concatenate([((x - m) @ r >= 0)[:, : x.shape[1] // bits * bits] for m, r in models], axis=1)
    values = codes.reshape(len(x), -1, bits)[:, :tables] @ (1 << np.arange(bits, dtype=np.int64))
    return values.astype(_kind(bits))


def _kind(bits: int):
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32


def _codes(column, bits: int, tables: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _kind(bits)).reshape(len(column), tables) if tables else np.zeros((len(column), 0), np.uint8)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of codes, along the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _unit(column) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision; the largest component is scaled to 1 first."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(models: list, bits: int, tables: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = substrings(_unit(batch.column("vector")), models, bits, tables)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], [*batch.schema.names, "code"])

    return run


def _meetings(bits: int, tables: int):
    """(label, t, key, rep, code) for each table; only labels, ids and codes, no vectors."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 + 100_000 // max(tables, 1)):
                part = batch.slice(at, 1 + 100_000 // max(tables, 1))
                n = part.num_rows
                keys = _codes(part.column("code"), bits, tables) if tables else np.zeros((n, 1))
                of = pa.array(np.repeat(np.arange(n), keys.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").take(of), pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), n)), pa.array(keys.ravel().astype(np.int64)), part.column("rep").take(of), part.column("code").take(of)],
                    ["label", "t", "key", "rep", "code"],
                )

    return run


def _tiles(batches) -> Iterator[pa.Table]:
    """Groups of two and more rows of one tile from batches that are sorted by it."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        tile = table.column("tile").to_numpy()
        if not len(tile):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        ends = np.append(cuts[1:], len(tile))
        for a, b in zip(cuts[:-1].tolist(), ends[:-1].tolist(), strict=True):
            if b - a > 1:
                yield table.slice(a, b - a)
        held = table.slice(int(cuts[-1]))
    if held is not None and held.num_rows > 1:
        yield held


def _near(table: pa.Table, bits: int, tables: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of a tile: pairs (across its sides, where it has two) that meet in no earlier table, within the radius."""
    side, n = table.column("side").to_numpy(), table.num_rows
    codes = _codes(table.column("code"), bits, tables)
    t = int(table.column("t")[0].as_py())
    two = bool(side.any())
    first, second = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(n),) * 2
    for a in range(0, len(first), 256):
        for b in range(0 if two else a, len(second), 256):
            i, j = first[a : a + 256], second[b : b + 256]
            apart, mine = np.zeros((len(i), len(j)), np.int32), np.ones((len(i), len(j)), bool)
            for k in range(tables):
                differ = codes[i, k][:, None] ^ codes[j, k][None, :]
                apart += np.bitwise_count(differ)
                if k < t:
                    mine &= differ != 0
            p, q = np.nonzero(mine & (apart <= radius))
            p, q = i[p], j[q]
            keep = slice(None) if two else p < q
            yield p[keep], q[keep]


def _candidates(bits: int, tables: int, radius: int):
    """Of each tile the rows that have a candidate."""

    def run(batches):
        for table in _tiles(batches):
            hit = np.zeros(table.num_rows, bool)
            for p, q in _near(table, bits, tables, radius):
                hit[p] = hit[q] = True
            if hit.any():
                yield from table.filter(pa.array(hit)).select(["tile", "t", "side", "rep"]).combine_chunks().to_batches()

    return run


def _tile_links(bits: int, tables: int, radius: int, threshold: float):
    """Links of the candidates of each tile, by their vectors."""

    def run(batches):
        for table in _tiles(batches):
            ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
            x, n = _unit(table.column("vector")), table.num_rows
            links, low, linked = np.zeros(n, np.int64), np.arange(n), []
            for p, q in _near(table, bits, tables, radius):
                near = np.concatenate([np.zeros(0, bool), *((x[p[k : k + 65536]] * x[q[k : k + 65536]]).sum(axis=1) >= threshold for k in range(0, len(p), 65536))])
                p, q = p[near], q[near]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                linked.append((p, q))
            p, q = map(np.concatenate, zip(*linked, strict=True))
            while len(p):  # smallest position reachable within the tile
                before = low.copy()
                m = np.minimum(low[p], low[q])
                np.minimum.at(low, p, m)
                np.minimum.at(low, q, m)
                low = low[low]
                if (low == before).all():
                    break
            hit = np.flatnonzero(links)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[low[hit]])], ["rep", "links", "root"])

    return run


def _links(classes: DataFrame, plan: tuple, threshold: float) -> DataFrame:
    """(rep, links, root) of vectors of one length, or of one label key, by the tables of a plan."""
    models, bits, tables, radius = plan
    spark = classes.sparkSession
    kinds = dict(classes.dtypes)
    if tables:
        coded = materialize(classes.mapInArrow(_code(models, bits, tables), ", ".join(f"{c} {kinds[c]}" for c in classes.columns) + ", code binary"), "codes")
    else:
        coded = materialize(classes.withColumn("code", F.lit(b"")), "codes")
    spread = coded.select("label", "rep", "code").mapInArrow(_meetings(bits, tables), f"label {kinds['label']}, t int, key long, rep long, code binary")
    hot = spread.groupBy("label", "t", "key").agg(F.count("*").alias("size")).where(F.col("size") > TILE)
    met = spread.join(hot, ["label", "t", "key"], "left").withColumn("chunks", F.coalesce(F.ceil(F.col("size") / TILE), F.lit(1)).cast("int"))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tile = F.xxhash64("label", "t", "key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    met = met.select(tile.alias("tile"), "t", (F.col("chunk") > F.col("other")).cast("int").alias("side"), "rep", "code")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = lambda df: df.repartition(partitions, "tile").sortWithinPartitions("tile", "side", "rep")
    near = materialize(dealt(met).mapInArrow(_candidates(bits, tables, radius), "tile long, t int, side int, rep long"), "candidates")
    pairs = near.join(coded.select("rep", "copies", "code", "vector"), "rep")
    links = materialize(dealt(pairs).mapInArrow(_tile_links(bits, tables, radius, threshold), "rep long, links long, root long"), "links")
    discard(coded, near)
    return links


def near_vectors(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.995, sample: int = 20_000) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors linked directly), component_id, kept.

    Vectors of one non-null label and of one length link at cosine >= ``threshold``. Null or zero vectors and those with
    null or non-finite components link with nothing. Each length that more than FEW vectors have gets its own rotations,
    fitted on at most about ``sample`` vectors (chosen by a hash of vec_id), and its own tables, in all of which all
    vectors are indexed; the others are compared within label and length. The number of tables follows from the
    agreement of codes measured at the very threshold, so ``recall`` is that of the least similar pairs.

    Rows of equal label and embedding collapse to one class with its number of copies, each of which counts as another
    vector. A vec_id repeated with different embeddings has a row for each, and components join through it. Null
    vec_id: no component. Empty table: empty result. Other columns are not read. A bucket with many vectors is cut into
    tiles of about 2048, spread over tasks.
    """
    spark = vectors.sparkSession
    element = dict(vectors.dtypes)["embedding"]
    element = element if element in ("array<float>", "array<double>") else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast(element).alias("vector"))
    finite: Column = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    h = [F.when(sound, F.xxhash64("label", "vector", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    base = base.select("*", *h)
    good = base.where(sound)
    sizes = {r.d: r["count"] for r in good.groupBy(F.size("vector").alias("d")).count().where("count > 1").collect()}
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    out = []
    for d, n in sizes.items():
        if n > FEW:
            share = int(1_000_000 * min(1.0, sample / n)) + 1
            with batch_rows(spark):
                learned = good.where((F.size("vector") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share)).select("vector").toArrow()
            x = _unit(learned.column("vector")) if learned.num_rows else np.eye(d)
            of_length = classes.where(F.size("vector") == d).select("rep", "label", "copies", "vector")
            out.append(_links(of_length, plan_tables(x, n, threshold, recall), threshold))
    few = [d for d, n in sizes.items() if n <= FEW]
    if few:
        rest = classes.where(F.size("vector").isin(few)).select("rep", F.struct(F.col("label"), F.size("vector").alias("d")).alias("label"), "copies", "vector")
        out.append(_links(rest, ([], 0, 0, 0), threshold))
    if not out:
        found = spark.createDataFrame([], "rep long, links long, root long")
    else:
        found = out[0]
        for more in out[1:]:
            found = found.unionByName(more)
    # a vec_id that has several classes joins them
    ids = classes.select("rep", "id", "h1", "h2", "copies")
    again = good.select("vec_id", "h1", "h2").distinct()
    several = again.groupBy("vec_id").agg(F.count("*").alias("c"), F.min(F.struct("h1", "h2")).alias("to")).where("c > 1")
    joined = again.join(several, "vec_id").join(ids.select("h1", "h2", F.col("rep").alias("a")), ["h1", "h2"])
    joined = joined.join(ids.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("rep").alias("b")), (F.col("to.h1") == F.col("g1")) & (F.col("to.h2") == F.col("g2")))
    comp = materialize(components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(joined.select("a", "b").where("a <> b"))), "components")
    lowest = comp.join(ids.select(F.col("rep").alias("node"), "id"), "node").groupBy("component").agg(F.min("id").alias("low"))
    comp = comp.join(lowest, "component").select(F.col("node").alias("rep"), "low")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = ids.join(links, "rep", "left").join(comp, "rep", "left")
    per_class = per_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("low", "id").alias("component"))
    joined = base.select("vec_id", "h1", "h2").join(per_class, ["h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
