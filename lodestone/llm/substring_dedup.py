"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Every window of ``width`` words is hashed. Windows next to each other that share their smallest ``seed``-word hash form
a run, so that one row stands for about a dozen windows when runs are counted. A run that a smaller doc_id holds whole
is decided at once; only where one seed leads to different runs are the windows of each run's first document counted
one by one. So every repeated window is found (equal windows have equal seeds), while the shuffle carries few rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, Rolling, WordHashes, discard, list_array, longs, materialize, mix, rows, sliding_min, split_words


def _runs(hashes: np.ndarray, width: int, seed: int):
    """(rolling, seed of each run, hash of each run's words, first window, end window)."""
    rolling = Rolling(hashes)
    least = sliding_min(rolling.windows(seed), width - seed + 1)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(starts[1:], len(least))
    return rolling, least[starts], rolling.spans(starts, ends + width - 1), starts, ends


def _windows(hashes: np.ndarray, rolling: Rolling, width: int):
    """Two independent hashes of each window."""
    return rolling.windows(width), Rolling(mix(hashes ^ U64(0xA0761D6478BD642F))).windows(width)


def _find_runs(width: int, seed: int):
    def run(batches):
        known = WordHashes()
        for batch in rows(batches):
            ids, seeds, spans = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = split_words(text.as_py())
                if len(words) < width:
                    continue
                _, s, r, _, _ = _runs(known.array(words), width, seed)
                _, first = np.unique(s ^ mix(r), return_index=True)
                ids.append(np.full(len(first), doc, np.int64))
                seeds.append(s[first])
                spans.append(r[first])
            if ids:
                yield pa.RecordBatch.from_arrays([longs(np.concatenate(seeds)), longs(np.concatenate(spans)), pa.array(np.concatenate(ids))], ["seed", "run", "doc_id"])

    return run


def _find_windows(width: int, seed: int):
    def run(batches):
        known = WordHashes()
        for batch in rows(batches, 500):
            out = []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                hashes = known.array(split_words(text.as_py()))
                rolling, _, spans, starts, ends = _runs(hashes, width, seed)
                chosen = np.flatnonzero(np.isin(spans, np.asarray(wanted.values).view(U64)))
                at = np.concatenate([np.arange(starts[i], ends[i]) for i in chosen]) if len(chosen) else np.zeros(0, int)
                x, y = _windows(hashes, rolling, width)
                _, first = np.unique(x[at], return_index=True)
                out.append((x[at][first], y[at][first], np.full(len(first), doc, np.int64)))
            if out:
                x, y, d = map(np.concatenate, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([longs(x), longs(y), pa.array(d)], ["x", "y", "doc_id"])

    return run


def _remove(width: int, seed: int):
    def run(batches):
        known = WordHashes()
        for batch in rows(batches, 500):
            docs, n, removed, kept, firsts, lasts = batch.column(0), [], [], [], [], []
            for text, run_hits, window_hits in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                text = text.as_py()
                words = split_words(text)
                n.append(len(words))
                gone = np.zeros(len(words) + 1, np.int64)
                if len(words) >= width and (run_hits.is_valid or window_hits.is_valid):
                    hashes = known.array(words)
                    rolling, _, spans, starts, ends = _runs(hashes, width, seed)
                    hit = np.zeros(len(words) - width + 1, bool)
                    if run_hits.is_valid and len(run_hits.values):
                        for i in np.flatnonzero(np.isin(spans, np.asarray(run_hits.values).view(U64))):
                            hit[starts[i] : ends[i]] = True
                    if window_hits.is_valid and len(window_hits.values):
                        hit |= np.isin(rolling.windows(width), np.asarray(window_hits.values).view(U64))
                    at = np.flatnonzero(hit)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + width, -1)
                out = np.cumsum(gone[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                firsts.append(edge[::2].astype(U64))
                lasts.append(edge[1::2].astype(U64))
                removed.append(int(out.sum()))
                kept.append(b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x] if removed[-1] else words).decode("utf-8", "surrogatepass") if removed[-1] else text)
            digest = [hashlib.sha256(b" ".join(split_words(x))).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), list_array(firsts), list_array(lasts), pa.array(digest, pa.string()), *batch.columns[4:]],
                ["doc_id", "kept_text", "n_words", "n_removed", "span_starts", "span_ends", "kept_sha256", *batch.schema.names[4:]],
            )

    return run


def repeated_spans(docs: DataFrame, width: int = 50, seed: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word covered by a window whose words also start in a document with a smaller doc_id.

    Input: doc_id long, text string; those named in ``carry`` go along as a struct, carried. Output, a row for each input row: doc_id, kept_text,
    n_words, n_removed, span_starts and span_ends (maximal removed intervals, word positions, end exclusive),
    kept_sha256. ``kept_text`` is the text itself where nothing goes, else the kept words joined by one space.

    Null or empty text has no words and stays as it is. Documents under ``width`` words lose nothing. Rows with a null
    doc_id lose nothing and count for nobody. Repeated rows of one doc_id don't count against each other. An empty
    table gives an empty result. Windows are judged on the input. Hashes: 128 bits decide.
    """
    if not 0 < seed <= width:
        raise ValueError("seed must be between 1 and width")
    along = [F.struct(*carry).alias("carried")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *along)
    real = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    runs = materialize(real.mapInArrow(_find_runs(width, seed), "seed long, run long, doc_id long"), "runs")
    shared = runs.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("seed")
    met = materialize(runs.join(shared, "seed", "left_semi"), "shared-runs")
    classes = met.groupBy("seed", "run").agg(F.min("doc_id").alias("m"))
    run_hits = met.join(classes, ["seed", "run"]).where("doc_id > m").select("doc_id", "run", F.lit(None).cast("long").alias("x"))
    unclear = classes.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    wanted = classes.join(unclear, "seed", "left_semi").groupBy(F.col("m").alias("doc_id")).agg(F.collect_set("run").alias("wanted"))
    windows = materialize(
        real.join(wanted, "doc_id").mapInArrow(_find_windows(width, seed), "x long, y long, doc_id long"), "windows"
    )
    discard(runs)
    first = windows.groupBy("x", "y").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("hi")).where("m < hi")
    window_hits = windows.join(first, ["x", "y"]).where("doc_id > m").select("doc_id", F.lit(None).cast("long").alias("run"), "x")
    hits = run_hits.unionByName(window_hits).groupBy("doc_id").agg(F.collect_set("run").alias("runs"), F.collect_set("x").alias("xs"))
    schema = "doc_id long, kept_text string, n_words long, n_removed long, span_starts array<long>, span_ends array<long>, kept_sha256 string"
    joined = docs.join(hits, "doc_id", "left").select("doc_id", "text", "runs", "xs", *(["carried"] if carry else []))
    return joined.mapInArrow(_remove(width, seed), schema + (f", carried {dict(docs.dtypes)['carried']}" if carry else ""))
