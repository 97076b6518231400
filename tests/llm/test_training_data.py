"""The operators against plain Python versions, and their defined results on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lodestone.llm import decontaminate, embedding_dedup, language_id, minhash_dedup, mixing, queries, substring_dedup, token_counts, url_filter, warc_revisit
from lodestone.llm.common import components, crc_of, mix

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "one two three four five six"), (5, "word " * 30_000), (6, "\u00e9t\u00e9 \u00a0x"), (7, "%%% ### 123")]
SCHEMA = "doc_id long, text string, n int, rep string, component string, key string, source string, carried int"


def frame(spark, rows):
    """Documents with further columns whose names occur inside the operators."""
    return spark.createDataFrame([(i, t, 1, None, "c", "k", None, 7) for i, t in rows], SCHEMA)


def corpus(seed, n=60):
    """Documents with shared passages, near copies and repeats within a document."""
    r = random.Random(seed)
    vocabulary = [f"{r.choice('ABCxyz')}w{i}" for i in range(300)]
    words = lambda k: r.choices(vocabulary, k=k)
    passages = [words(k) for k in (49, 50, 51, 70, 120)] + [["Is", "onhe."] * 60]
    docs = []
    for i in range(n):
        d = words(r.randrange(0, 200))
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            at = r.randrange(len(d) + 1)
            d[at:at] = p[r.randrange(5) :] if r.random() < 0.4 else p
        if docs and r.random() < 0.3:
            d = list(r.choice(docs))
            for _ in range(r.randrange(4)):
                if d:
                    d[r.randrange(len(d))] = r.choice(vocabulary)
        docs.append(d)
    ids = r.sample(range(1000), n)
    return [(i, r.choice([" ", "\n", " \t"]).join(d)) for i, d in zip(ids, docs, strict=True)]


def union(pairs, ids):
    of = {i: i for i in ids}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("seed", "width", "gram"), [(0, 50, 20), (1, 50, 20), (2, 7, 3), (3, 5, 5)])
def test_substring_dedup(spark, seed, width, gram):
    rows = corpus(seed)
    first = {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(frame(spark, rows), width, gram, ("n", "carried")).collect()}
    assert len(got) == len(rows)
    for i, w in words.items():
        gone = {p for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert {p for a, b in zip(got[i].span_starts, got[i].span_ends, strict=True) for p in range(a, b)} == gone
        assert all(b < c for b, c in zip(got[i].span_ends, got[i].span_starts[1:], strict=False))
        assert got[i].carried.carried == 7


def test_substring_dedup_odd_rows(spark):
    out = substring_dedup.repeated_spans(frame(spark, ODD)).collect()
    assert len(out) == len(ODD) and all(r.n_removed == 0 for r in out)
    assert {r.doc_id: r.n_words for r in out if r.doc_id in (1, 2, 3, 5)} == {1: 0, 2: 0, 3: 0, 5: 30_000}
    again = substring_dedup.repeated_spans(frame(spark, [(5, "word " * 3000), (9, "word " * 3000), (5, "word " * 3000)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in again) == [(5, 0), (5, 0), (9, 3000)]
    assert substring_dedup.repeated_spans(frame(spark, [])).count() == 0


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_truth(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, union(links, ids)


@pytest.mark.parametrize("seed", [0, 1])
def test_minhash_dedup(spark, seed):
    rows = corpus(seed, 120) + [(2000 + i, t) for i, t in enumerate(["a b", "A b", "a b c", "", "a b c d e", "a b c d E"])]
    sets, want = near_truth(rows)
    got = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_dedup_group_of_near_copies(spark, monkeypatch):
    """Copies at all distances of one text, over small tiles, against all pairs."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        d = list(base)
        for p in r.sample(range(150), r.randrange(0, 14)):
            d[p] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(d)))
    monkeypatch.setattr(minhash_dedup, "TILE", 16)
    _, want = near_truth(rows)
    assert len(set(want.values())) > 3
    got = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_minhash_dedup_odd_rows(spark):
    out = minhash_dedup.near_duplicates(frame(spark, ODD)).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: r for r in out}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].component_id == 2
    assert by[None].component_id is None and by[None].kept is None and by[5].n_shingles == 1
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("dense", [2, 5, 1000])
def test_intersections_of_a_tile(dense):
    rng = np.random.default_rng(dense)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 120))).astype(np.uint64) for _ in range(40)] + [np.arange(300, dtype=np.uint64)] * 3
    got = minhash_dedup.intersections(sets, dense, 16)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert i == j or got[i, j] == len(np.intersect1d(x, y))


def test_minhash_dedup_pairs_of_a_tile():
    """All pairs of a tile are confirmed; between two sides only those that lie across."""
    a, b = np.arange(100, dtype=np.int64), np.arange(10, 110, dtype=np.int64)
    for side, want in (([0, 0, 0], [(1, 2)]), ([0, 1, 1], [(1, 2)]), ([0, 0, 1], [])):
        columns = {"tile": [5] * 3, "rep": [1, 2, 3], "comp": [1, 2, 3], "shingles": [a.tolist(), b.tolist(), [1, 500]], "side": side}
        out = [tuple(r.values()) for part in minhash_dedup._joined_components(75)([pa.RecordBatch.from_pydict(columns)]) for r in part.to_pylist()]
        assert out == want


def test_sketch_fills_every_coordinate():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 1000):
        s = minhash_dedup.sketch(rng.integers(0, 2**63, n).astype(np.uint64))
        assert s.max() < np.iinfo(np.uint64).max
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    agree = np.mean([(minhash_dedup.sketch(a ^ np.uint64(k)) == minhash_dedup.sketch(b ^ np.uint64(k))).mean() for k in range(20)])
    assert abs(agree - 800 / 1200) < 0.03


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(500, 500), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = [(a, b) for a, b in pairs if a is not None and a != b]
    want = union(linked, {x for p in linked for x in p})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed, n=400, dim=64, mean=0.0):
    """Unit vectors about a common component whose length is ``mean``; half of them lie near others."""
    rng = np.random.default_rng(seed)
    common = rng.normal(size=dim)
    common *= mean / np.linalg.norm(common)
    base = rng.normal(size=(n, dim))
    base = common + base / np.linalg.norm(base, axis=1, keepdims=True) * np.sqrt(1 - mean**2)
    for i in range(n // 2, n):
        way = rng.normal(size=dim)
        base[i] = base[rng.integers(n // 2)] + way / np.linalg.norm(way) * rng.choice([0, 0.1, 0.25, 0.33, 0.36, 0.38, 0.42])
    return [(i, [float(x) for x in np.float32(v)], int(rng.integers(3))) for i, v in enumerate(base)]


def cosine_truth(rows, threshold=0.93):
    sound = [(i, np.array(v, float) / max(map(abs, v)), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    groups = defaultdict(list)
    for i, v, lab in sound:
        groups[lab, len(v)].append((i, v / np.linalg.norm(v)))
    links = []
    for members in groups.values():
        x = np.stack([v for _, v in members])
        links += [(members[a][0], members[b][0]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True)]
    return links, Counter(i for p in links for i in p), union(links, [i for i, _, _ in rows])


@pytest.mark.parametrize(("tile", "few", "mean"), [(2048, 2048, 0.0), (16, 50, 0.6), (64, 50, 0.9)])
def test_embedding_dedup(spark, monkeypatch, tile, few, mean):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "FEW", few)
    monkeypatch.setattr(embedding_dedup, "BUCKET", 8)
    rows = vectors(1, 900, mean=mean)
    odd = [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [float("nan")] * 64, 1), (2003, [None] + [1.0] * 63, 1), (2004, rows[0][1], None), (2006, [float("inf")] * 64, 1), (2007, [], 2)]
    rows += [*odd, (2005, rows[0][1], rows[0][2]), (2008, [1.0, 2.0], 1), (2009, [1.0, 2.1], 1), (2010, [1.0, -2.0], 1), (2011, [1e200, 2e200], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, rep string, code int")
    links, n, comp = cosine_truth(rows)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.99 * len(links) <= found <= len(links) and len(links) > 100
    assert all(r.n_links <= n[i] for i, r in got.items())
    assert sum(r.component_id == comp[i] for i, r in got.items()) >= 0.99 * len(rows)
    assert all(got[i].n_links == 0 and got[i].kept for i, _, _ in odd)
    assert [got[i].n_links for i in (2008, 2009, 2010, 2011)] == [2, 2, 0, 2]  # few of one length: exact
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_embedding_dedup_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.01], 1), (None, [0.0, 1.0], 1), (3, [0.0, 1.0], 2)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted((tuple(r) for r in got), key=key) == sorted([(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False), (3, 0, 3, True)], key=key)


@pytest.mark.parametrize("mean", [0.0, 0.6, 0.8, 0.9])
def test_embedding_recall_by_measurement(mean):
    """Over all tables, of pairs at the threshold in another sample than the one planned on."""
    rng = np.random.default_rng(5)
    common = rng.normal(size=64)
    x = common / np.linalg.norm(common) * mean + rng.normal(size=(6000, 64)) / 8 * np.sqrt(1 - mean**2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    models, bits, tables, radius = embedding_dedup.plan_tables(x[:3000], 50_000, 0.93, 0.995)
    a, b = embedding_dedup.pairs_at(x[3000:], 0.93, 4000, 9)
    p, q = (embedding_dedup.substrings(v, models, bits, tables) for v in (a, b))
    met = (p == q).any(axis=1) & (embedding_dedup.distances(p, q) <= radius)
    assert met.mean() >= 0.99


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/1", "https://m.example.org/en/12?x", "http://example.org/en/2", "http://a.com/fr/", "http://a.com/fr", "http://com/de/x", "http://xcom/de/", "https://example.org", "x://.org/", "http://a.org#f", "http://a.com//de/", "h://a.com/de/b/c/d", "//a.org/"]

    def truth(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.lower()
        fits = [(h.count("."), len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge_urls(df).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [truth(u) for u in urls]
    assert url_filter.judge_urls(df.where("false")).count() == 0
    rules = [("allow", "a.com", "/x/"), ("block", "com", "/x/y"), ("block", "a.com", "/x/y/z")]
    one = lambda u: url_filter.judge_urls(spark.createDataFrame([(1, u)], "page_id long, url string"), rules, "block").first().rule
    assert [one(u) for u in ("h://b.a.com/x/q", "h://b.a.com/x/y/zz", "h://c.com/x/yy", "h://a.com/x")] == ["a.com/x/", "a.com/x/y/z", "com/x/y", None]


def test_warc_revisit(spark):
    r = random.Random(3)
    records = []
    for i in range(400):
        url = f"HTTP{r.choice(['', 's'])}://{r.choice(['www.', ''])}Site{r.randrange(4) if r.random() < 0.6 else 0}.com/p{r.randrange(3)}{r.choice(['', '/', '#x', '?utm_a=1'])}"
        records.append((i, r.randrange(300) if r.random() > 0.03 else None, url if r.random() > 0.03 else None, r.choice(["response", "revisit", "request"]), r.choice([200, 200, 304, None]), r.choice(['"a"', '"b"', None]), r.choice(["d1", "d2", None]), {"Date": str(i), "date": "lost", "X-Own": "1", "ETag": "e"} if r.random() > 0.1 else None))
    # stray times, which must not put all other records into one block; records 3 and 5 once more; columns that clash
    records += [(1000, 0, "http://site0.com/p0", "response", 200, '"a"', "d1", None), (1001, 253402300799, "http://site0.com/p0", "revisit", 304, '"a"', None, {}), (1002, 5, "http://" + "x" * 100_000, "revisit", 304, None, None, None)]
    df = spark.createDataFrame([(*x, 1, "b") for x in records], "record_id long, ts long, uri string, kind string, status int, etag string, digest string, headers map<string,string>, row int, block string")
    key = lambda u: re.sub(r"^https?://(www\.)?", "", u.lower()).split("#")[0].split("?")[0].rstrip("/")
    for size in (1, 16, 4096):
        got = {x.record_id: x for x in warc_revisit.resolve_revisits(df, size).collect()}
        assert len(got) == sum(x[3] == "revisit" for x in records) and len({x.outcome for x in got.values()}) == 4
        for i, ts, uri, kind, _, etag, digest, headers in records:
            if kind != "revisit":
                continue
            full = [x for x in records if x[3] == "response" and x[4] != 304 and None not in (x[1], x[2], ts, uri) and key(x[2]) == key(uri) and (x[1], x[0]) < (ts, i)]
            old = max(full, key=lambda x: (x[1], x[0]), default=None)
            if old is None:
                assert (got[i].refers_to, got[i].outcome, got[i].headers) == (None, "missing", None)
                continue
            checks = [a == b for a, b in ((etag, old[5]), (digest, old[6])) if a is not None and b is not None]
            outcome = "unvalidated" if not checks else "resolved" if checks[0] else "mismatch"
            assert (got[i].refers_to, got[i].outcome) == (old[0], outcome)
            if outcome != "mismatch":
                fold = lambda h: {k.lower(): h[k] for k in sorted(h or {}, reverse=True)}
                mine = {k: v for k, v in fold(headers).items() if k in warc_revisit.PERMITTED}
                assert got[i].headers == fold(old[7]) | mine and got[i].digest == old[6]
    assert warc_revisit.resolve_revisits(df.where("false")).count() == 0


def test_warc_revisit_repeated_rows(spark):
    one = (1, 10, "http://a.com/", "response", 200, '"e"', "d", {"A": "1"})
    again = (2, 20, "https://www.A.com", "revisit", 304, '"e"', "d", {"B": "2"})
    df = spark.createDataFrame([one, one, again, again], "record_id long, ts long, uri string, kind string, status int, etag string, digest string, headers map<string,string>")
    assert [(x.record_id, x.refers_to, x.outcome, x.headers) for x in warc_revisit.resolve_revisits(df).collect()] == [(2, 1, "resolved", {"a": "1"})] * 2


def test_url_filter_in_blocks_of_rules(spark, monkeypatch):
    """Rules in many tries give what one trie gives; repeated rows and long urls are judged."""
    r = random.Random(9)
    rules = [(r.choice(["allow", "block"]), ".".join(r.choices("abc", k=r.randrange(1, 4))), "/" + "/".join(r.choices(["x", "xy", "z", ""], k=r.randrange(1, 3)))) for _ in range(80)]
    urls = ["h://" + ".".join(r.choices("abc", k=r.randrange(1, 5))) + "/" + "/".join(r.choices(["x", "xyz", "z"], k=r.randrange(1, 4))) for _ in range(200)]
    urls += [None, "", "h://a.b/" + "x" * 200_000, urls[0], urls[0]]
    df = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, place int")
    want = [tuple(x) for x in url_filter.judge_urls(df, rules).orderBy("page_id").collect()]
    monkeypatch.setattr(url_filter, "MOST_RULE_BYTES", 200)
    assert len(list(url_filter._blocks(rules))) > 2
    assert [tuple(x) for x in url_filter.judge_urls(df, rules).orderBy("page_id").collect()] == want
    assert sum(x[3] is not None for x in want) > 50 and want[202][2] == "/" + "x" * 200_000


def test_token_counts(spark):
    r = random.Random(5)
    parts = ["word", " ", "  ", "\n", "***", "!!!!", "don't", "123", "\u00e9\u00e9", "...", " %%%", "\t\t", "a"]
    texts = ["".join(r.choices(parts, k=r.randrange(400))) for _ in range(60)] + [t for _, t in ODD]
    encoder = token_counts.Encoder(queries.VOCABULARY)
    got = token_counts.count_tokens(spark.createDataFrame([(*x, 1, "t") for x in enumerate(texts)], "doc_id long, text string, n_edits int, tokens_before string"), queries.VOCABULARY).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        text = text or ""
        cleaned = token_counts._RUNS.sub(r"\1", text)
        assert (row.tokens_before, row.tokens_after) == tuple(len(encoder.encoding.encode_ordinary(x)) for x in (text, cleaned))
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), queries.VOCABULARY).count() == 0


def test_token_tree_any_edits():
    r = random.Random(6)
    encoder = token_counts.Encoder(queries.VOCABULARY)
    pieces = ["ab", " ", "  ", "\n", "'s", "9", "!", "x y", ""]
    for _ in range(600):
        text = "".join(r.choices(pieces, k=r.randrange(500)))
        cuts = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, 2 * r.randrange(5)) // 2 * 2))
        edits = [(a, b, "".join(r.choices(pieces, k=r.randrange(4)))) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        tree = token_counts.TokenTree(encoder, text)
        tree.apply(edits)
        for a, b, s in reversed(edits):
            text = text[:a] + s + text[b:]
        assert tree.text == text and tree.total == len(encoder.encoding.encode_ordinary(text))
    long = "one two three. " * 5000 + "!!!!" + " four five six." * 5000
    tree = token_counts.TokenTree(encoder, long)
    assert 0 < tree.apply(token_counts.symbol_runs(long)) < 200


def test_token_tree_batches_of_edits():
    """Five batches one after the other equal a count from scratch; small edits stay cheap, whatever went before."""
    r = random.Random(7)
    encoder = token_counts.Encoder(queries.VOCABULARY)
    pieces = ["ab", " ", "  ", "\n", "'s", "9", "!", "x y", "", " word", "\u00e9"]
    for _ in range(200):
        text = "".join(r.choices(pieces, k=r.choice([0, 3, 60, 500])))
        tree = token_counts.TokenTree(encoder, text)
        for _ in range(5):
            cuts = sorted(r.choices(range(len(text) + 1), k=2 * r.randrange(4)))
            if r.random() < 0.1:
                cuts = [0, len(text)]
            edits = [(a, b, "".join(r.choices(pieces, k=r.choice([0, 1, 3, 400])))) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            edits = [e for i, e in enumerate(edits) if not i or e[0] > edits[i - 1][1]]
            tree.apply(edits)
            for a, b, s in reversed(edits):
                text = text[:a] + s + text[b:]
            assert tree.text == text and tree.total == len(encoder.encoding.encode_ordinary(text)) and (not text or tree.ends[-1] == len(text))
    tree = token_counts.TokenTree(encoder, "one two three. " * 8000)
    for k in range(50):
        assert tree.apply([(1000 * k, 1000 * k + 3, "six seven")]) < 300
    assert tree.total == len(encoder.encoding.encode_ordinary(tree.text))


def languages(seed, n=400):
    r = random.Random(seed)
    letters = {"aa": "aeioulmn", "bb": "bdgkrstz", "cc": "cfhpqvwx\u00e9", "dd": "aeighjy\u00fc"}
    rows = []
    for i in range(n):
        lang = r.choice(list(letters))
        rows.append((i, " ".join("".join(r.choices(letters[lang], k=r.randrange(2, 9))) for _ in range(r.randrange(3, 60))), lang))
    return rows


def test_language_id(spark):
    rows = languages(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, crc_of("doc_id") % 3 != 1)
    out = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    held = [r.doc_id for r in df.where(crc_of("doc_id") % 3 == 1).collect()]
    assert np.mean([out[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    odd = language_id.identify(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD)
    assert {r.doc_id: r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 7)} == dict.fromkeys((1, 2, 3, 7), "und")
    assert language_id.identify(df.where("false"), model).count() == 0
    none = language_id.train(df.where("false"))
    assert language_id.identify(df, none).first().lang_pred == "und"
    single = language_id.train(df.where("lang = 'aa'"))
    assert language_id.identify(df, single).first().lang_pred == "aa"


def plain_prediction(model, text):
    """The decoder written out: sums of log-odds of each n-gram, logistic losses over each codeword's bits."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not letters:
        return "und"
    raw = f" {' '.join(letters)} ".encode()
    grams = [int.from_bytes(raw[i : i + n], "big") + (1 << 24 if n == 3 else 0) for n in (2, 3) for i in range(len(raw) - n + 1)]
    buckets = [int(mix(np.array([g], np.uint64))[0]) % language_id.BUCKETS for g in grams]
    margins = [min(max(sum(float(model.weights[b, bit]) for b in buckets) / math.sqrt(len(buckets)), -30), 30) for bit in range(model.weights.shape[1])]
    losses = {lang: sum(math.log1p(math.exp(-int(c) * m)) for c, m in zip(model.code[i], margins, strict=True)) for i, lang in enumerate(model.languages)}
    return min(losses, key=lambda k: (losses[k], k))


def test_language_id_against_a_plain_version(spark):
    rows = languages(3, 200)
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, lang string, score string")
    model = language_id.train(df)
    # the classifier written out, for one bit
    seen = {k: Counter(b for _, t, lang in rows if lang == k for b in language_id.features(t).tolist()) for k in model.languages}
    share = {k: (np.array([c[b] for b in range(language_id.BUCKETS)]) + 0.5) / (sum(c.values()) + 0.5 * language_id.BUCKETS) for k, c in seen.items()}
    bit = 2
    sides = [np.mean([share[k] for i, k in enumerate(model.languages) if model.code[i, bit] == s], axis=0) for s in (1, -1)]
    assert model.weights[:, bit] == pytest.approx(np.log(sides[0] / sides[1]), rel=1e-4, abs=1e-5)
    odd = ["\u00bd \u2460", "\u2167", "\u00bd a\u2460b", "12", "", None, "\u6f22 x", "ab", "__"]
    texts = [t for _, t, _ in rows[:40]] + odd
    got = language_id.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == [plain_prediction(model, t) for t in texts]
    assert [got[40 + i].lang_pred for i in (0, 1, 3, 4, 5, 8)] == ["und"] * 6


def test_language_id_of_many_and_of_large_languages(spark, monkeypatch):
    """More languages than counts are held of at once; a share of a sample that is far below a millionth."""
    monkeypatch.setattr(language_id, "AT_ONCE", 5)
    r = random.Random(2)
    letters = {f"l{i:02d}": r.sample("abcdefghijklmnopqrstuvwxyz", 5) for i in range(12)}
    rows = [(i, " ".join("".join(r.choices(letters[k], k=6)) for _ in range(40)), k) for i, k in enumerate(list(letters) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert len(model.languages) == 12
    got = [x.lang_pred for x in language_id.identify(df, model).orderBy("doc_id").collect()]
    assert np.mean([g == k for g, (_, _, k) in zip(got, rows, strict=True)]) > 0.9
    assert int(language_id.SHARES * 4_000 / 10**13) > 10**5


def test_codewords_are_apart():
    for k in (2, 3, 4, 7, 12, 40):
        code = language_id.codewords(k)
        apart = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        assert code.shape[0] == k and apart >= 1 and (k < 5 or apart >= 5)


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_scores():
    rng = np.random.default_rng(1)
    for _ in range(100):
        item = rng.integers(1, 6, rng.integers(1, 15)).astype(np.uint64)
        passages = [rng.integers(1, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(4)]
        for p, (score, begin, end) in zip(passages, decontaminate.align(item, passages), strict=True):
            assert score == smith_waterman(item.tolist(), p.tolist())
            if score:
                assert smith_waterman(item.tolist(), p[begin:end].tolist()) == score


def test_decontamination(spark):
    r = random.Random(8)
    words = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(12, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "t1 t2"), (None, "t1 t2 t3")]
    docs, planted = [], defaultdict(set)
    for d in range(120):
        text = r.choices(words, k=r.randrange(0, 300))
        if d % 3 == 0:
            i = r.randrange(30)
            copy = items[i][1].split()
            for _ in range(r.randrange(1 + len(copy) // 8)):
                copy[r.randrange(len(copy))] = "edited"
            if r.random() < 0.5:
                del copy[len(copy) // 2]
            at = r.randrange(len(text) + 1)
            text[at:at] = [w.upper() + r.choice(["", ",", "!!"]) for w in copy]
            planted[d].add(i)
        docs.append((d, " ".join(text)))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs + [(500, None), (501, "")]], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: set(x.item_ids) for x in decontaminate.judge_documents(df, bench).collect()}
    assert got == {d: planted[d] for d in [*range(120), 500, 501]}
    kept = {x.doc_id for x in decontaminate.without_leaks(df, bench).collect()}
    assert kept >= {d for d in range(120) if not planted[d]} and not kept & set(planted) - {d for d in planted if not planted[d]}
    assert decontaminate.judge_documents(df, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.judge_documents(df.where("false"), bench).count() == 0


def test_decontamination_common_passage(spark):
    """Six items over one passage: a document with the passage alone reaches the threshold of each."""
    passage = [f"p{i}" for i in range(40)]
    items = [(i, " ".join([*passage, *(f"q{i}x{k}" for k in range(8))])) for i in range(6)]
    variants = [(10 + i, " ".join([*(f"v{k}" for k in range(15)), f"only{i}", *(f"v{k}" for k in range(15, 30))])) for i in range(6)]
    noise = [f"n{i}" for i in range(60)]
    docs = [(1, " ".join([*noise, *passage, *noise])), (2, " ".join([*noise, *(f"v{k}" for k in range(15)), "edited", *(f"v{k}" for k in range(15, 30))])), (3, " ".join([*noise, *passage[:4]]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items + variants, "item_id long, text string")
    got = {x.doc_id: x.item_ids for x in decontaminate.judge_documents(df, bench).collect()}
    assert got == {1: list(range(6)), 2: list(range(10, 16)), 3: []}


def test_decontamination_long_item_is_aligned_once():
    """An item of 5000 words against one copy: one region, about three times as long as the copy."""
    rng = np.random.default_rng(3)
    item = " ".join(f"w{i}" for i in rng.integers(0, 3000, 5000))
    items = decontaminate.Items([(1, item)], 3)
    text = " ".join([*(f"n{i}" for i in range(20000)), item, *(f"m{i}" for i in range(20000))])
    h, _ = decontaminate.plain(decontaminate.PlainWords(), text)
    ((a, b),) = items.regions(h, 0.5)[0]
    assert b - a <= 5 * 5000
    parts = list(decontaminate._alike([(0, None, np.zeros(n)) for n in (10, 20, 300_000, 300_000)]))
    assert [len(x) for x in parts] == [2, 1, 1]


@pytest.mark.parametrize(("edited", "least"), [(0.0, 1.0), (0.1, 0.99), (0.2, 0.95)])
def test_decontamination_recall(edited, least):
    """Of the copies that an alignment with every item finds, those that seeds lead to."""
    r = random.Random(int(100 * edited))
    words = [f"t{i}" for i in range(2000)]
    texts = [r.choices(words, k=r.randrange(20, 50)) for _ in range(40)]
    items = decontaminate.Items([(i, " ".join(t)) for i, t in enumerate(texts)], 3)
    found = wanted = 0
    for i, t in enumerate(texts):
        copy = [w if r.random() >= edited else r.choice([f"e{r.random()}", f"{w} e", ""]) for w in t]
        h, _ = decontaminate.plain(decontaminate.PlainWords(), " ".join([*r.choices(words, k=30), *copy, *r.choices(words, k=30)]))
        regions = items.regions(h, 0.5)
        for j, words_of in enumerate(items.words):
            if decontaminate.align(words_of, [h])[0][0] >= len(words_of):
                wanted += 1
                found += any(decontaminate.align(words_of, [h[a:b]])[0][0] >= len(words_of) for a, b in regions.get(j, []))
    assert wanted >= 30 and found >= least * wanted


def test_decontamination_short_items(spark):
    docs = [(1, "a b Naked singularity! c"), (2, "naked c singularity"), (3, "x \u6f22\u5b57\u6587 y")]
    bench = spark.createDataFrame([(1, "naked singularity"), (2, "\u6f22\u5b57\u6587"), (3, "..."), (4, "a b Naked singularity")], "item_id long, text string")
    got = {x.doc_id: x.item_ids for x in decontaminate.judge_documents(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: [1, 4], 2: [], 3: [2]}


def test_source_mixing(spark):
    weights = {"a": 5, "b": 3, "c": 1}
    rows = [(i, "a" if i % 3 else "bcd"[i // 3 % 3]) for i in range(3000)] + [(7, "a"), (None, None), (9, None)]
    df = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, source string, part string")
    out = mixing.mix_sources(df, weights, 4).collect()
    assert len(out) == len(rows) and Counter((r.doc_id, r.source) for r in out) == Counter(rows)
    assert len({(r.mix_slot, r.mix_place) for r in out}) == len(out)
    of = {}
    for r in out:
        g = r.source if r.source in weights else "other"
        assert of.setdefault(r.mix_slot, g) == g
    stop = 1 + max(r.mix_slot for r in out if r.mix_within)
    assert stop > 50
    done = Counter()
    for t in range(stop):
        done[of[t]] += 1
        assert all(abs(done[g] - (t + 1) * w / 10) < 1 for g, w in {**weights, "other": 1}.items())
    assert mixing.mix_sources(df.where("false"), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(df, {"a": 0})


def test_source_mixing_rows_in_many_parts(spark, monkeypatch):
    """Numbers on three levels of counts, and weights with a common divisor, give what one level gives."""
    df = spark.createDataFrame([(i, "a" if i % 4 else "b", 1) for i in range(2000)], "doc_id long, source string, mix_slot int")
    want = sorted(tuple(x) for x in mixing.mix_sources(df, {"a": 3, "b": 1}, 4).collect())
    monkeypatch.setattr(mixing, "ROWS_PER_PART", 20)
    monkeypatch.setattr(mixing, "PARTS_AT_ONCE", 7)
    assert sorted(tuple(x) for x in mixing.mix_sources(df, {"a": 3000, "b": 1000}, 4, 1000).collect()) == want


def test_period_is_pfair(spark, monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(mixing, "SLOTS_AT_ONCE", 64)
    for most in (30, 30, 30, 2000):  # the last sum is far above 2000
        w = {f"s{i}": r.randrange(1, most) for i in range(r.randrange(2, 8))}
        w = mixing.reduced(w)
        total = sum(w.values())
        got = mixing.period(spark, w).collect()
        assert sorted(x.slot for x in got) == list(range(total))
        for x in got:
            assert x.k * total // w[x.grp] <= x.slot < -(-(x.k + 1) * total // w[x.grp])


def test_pipeline(spark, tmp_path):
    """Every stage's effect on planted rows, by plain Python."""
    rows = [(i, t, lang, f"src{i % 20}", len(t)) for i, t, lang in languages(2, 80)]
    r = random.Random(0)
    base = rows[10][1].split() + [w for k in range(11, 16) for w in rows[k][1].split()]
    passage = [f"{'aeiou'[i % 5]}lm{i}" for i in range(60)]
    near = list(base)
    near[3] = "changed"
    item = " ".join(passage[:20][::-1])
    extra = [(200, " ".join(base)), (201, " ".join(near)), (202, " ".join(base)), (203, " ".join(r.sample(base, 40) + passage)), (204, " ".join(r.sample(base, 45) + passage)), (205, "123 %% 4"), (206, None), (207, " ".join(r.sample(base, 50)) + " " + item)]
    rows += [(i, t, "aa", "src1", 0) for i, t in extra]
    rows += [rows[20]] * 2  # the same document three times
    spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, carried string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len({x.doc_id for x in out})
    out = {x.doc_id: x for x in out}
    assert set(out) == set(range(80)) | {200, 203, 204} and all(x.carried == "k" for x in out.values())
    assert out[203].text == extra[3][1] and out[204].text == " ".join(extra[4][1].split()[:45]) and out[204].n_chars == len(out[204].text)
    assert len({(x.mix_slot, x.mix_place) for x in out.values()}) == len(out)
    empty = tmp_path / "empty"
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").where("false").write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "substring_dedup", "decontamination", "source_mixing"]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
