"""The model against a plain dictionary version."""

import glob
import math
import os
import random
import resource
import sys
from collections import Counter, OrderedDict, defaultdict
from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import kneser_ney, queries
from lodestone.llm.common import WordHashes


def brute(texts, queries):
    pairs = Counter()
    for t in texts:
        words = [*(t or "").lower().split(), "</s>"]
        pairs.update(zip(["<s>", *words[:-1]], words, strict=True))
    count, left, total, kinds = Counter(), Counter(), Counter(), defaultdict(Counter)
    for (u, w), c in pairs.items():
        count[w] += c
        left[w] += 1
        total[u] += c
        kinds[u][min(c, 3)] += 1
    d2 = [0, *kneser_ney.discounts(*(sum(c == i for c in pairs.values()) for i in (1, 2, 3, 4)))]
    d1 = [0, *kneser_ney.discounts(*(sum(c == i for c in left.values()) for i in (1, 2, 3, 4)))]
    n, v, types = sum(count.values()), len(count), len(pairs)
    leftover = sum(d1[min(c, 3)] for c in left.values()) / types if types else 1.0

    def p(u, w):
        low = max(left[w] - d1[min(left[w], 3)], 0) / max(types, 1) + leftover / (v + 1)
        if not total[u]:
            return low
        return max(pairs[u, w] - d2[min(pairs[u, w], 3)], 0) / total[u] + sum(d2[k] * m for k, m in kinds[u].items()) / total[u] * low

    out = []
    for t in queries:
        words = [*(t or "").lower().split(), "</s>"]
        out.append((len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), sum(math.log10(p(u, w)) for u, w in zip(["<s>", *words[:-1]], words, strict=True))))
    if v:
        for u in ("<s>", *list(total)[:3]):
            assert abs(sum(p(u, w) for w in count) + p(u, "never seen") - 1) < 1e-9
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_against_dictionaries(spark, seed):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    texts = [" ".join(r.choices(words, k=r.randrange(60))) for _ in range(120)] + [None, "", "  \n ", "A a A", "w1 " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    wanted = df.doc_id % 10 != 0
    got = kneser_ney.score_documents(df, kneser_ney.train(df, wanted, order=2)).orderBy("doc_id").collect()
    want = brute([t for i, t in rows if i % 10], texts)
    for g, w in zip(got, want, strict=True):
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert g.base_score == pytest.approx(w[3], rel=1e-9)
        assert g.score == pytest.approx(w[4], rel=1e-9)


def test_empty_training_table(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    model = kneser_ney.train(df.where("false"))
    got = {r.doc_id: r for r in kneser_ney.score_documents(df, model).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].score == 0
    assert got[None].n_tokens == 1
    assert kneser_ney.score_documents(df.where("false"), model).count() == 0


def brute_of_order(texts, queries, order):
    """log10 probabilities by the textbook recursion; n-grams that begin a text keep their plain counts."""
    padded = lambda t: ["<s>", *(t or "").lower().split(), "</s>"]
    plain = [Counter() for _ in range(order + 1)]
    for t in texts:
        w = padded(t)
        for n in range(1, order + 1):
            plain[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    counts = {order: plain[order]}
    for n in range(1, order):
        before = Counter(g[1:] for g in plain[n + 1])
        counts[n] = Counter({g: plain[n][g] if g[0] == "<s>" and n > 1 else before[g] for g in plain[n] if g != ("<s>",)})
    d = {n: [0, *kneser_ney.discounts(*(sum(c == i for c in counts[n].values()) for i in (1, 2, 3, 4)))] for n in counts}
    total, kinds = Counter(), defaultdict(Counter)
    for n in counts:
        for g, c in counts[n].items():
            total[g[:-1]] += c
            kinds[g[:-1]][min(c, 3)] += 1
    v = len(counts[1])

    def p(context, w):
        low = p(context[1:], w) if context else 1 / (v + 1)
        if not total[context]:
            return low
        n = len(context) + 1
        c = counts[n][*context, w]
        return max(c - d[n][min(c, 3)], 0) / total[context] + sum(d[n][k] * m for k, m in kinds[context].items()) / total[context] * low

    for context in [(), *list(kinds)[-3:]]:
        assert abs(sum(p(context, w) for (w,) in counts[1]) + p(context, "never seen") - 1) < 1e-9
    return [sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w))) for w in map(padded, queries)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders_against_dictionaries(spark, order):
    r = random.Random(order)
    words = [f"w{int(r.paretovariate(0.9))}" for _ in range(60)]
    texts = [" ".join(r.choices(words, k=r.randrange(60))) for _ in range(120)] + [None, "", "A a A", "w1 " * 2000, "w1 w2", "w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = kneser_ney.score_documents(df, kneser_ney.train(df, df.doc_id % 10 != 0, order=order)).orderBy("doc_id").collect()
    want = brute_of_order([t for i, t in enumerate(texts) if i % 10], texts, order)
    assert [g.score for g in got] == pytest.approx(want, rel=1e-9)


def test_query_has_order_three(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "a b c d") for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    orders, train = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda *a, **k: orders.append(train(*a, **k).order) or train(*a, **k))
    assert queries.op10_lm_scoring(spark, str(tmp_path)).count() == 40 and orders == [3]


def trained(spark, texts, **settings):
    return kneser_ney.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **settings)


def many_texts(seed=8, n=300):
    r = random.Random(seed)
    return [" ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(r.randrange(80))) for _ in range(n)]


def test_ranges_cut_in_two_steps_change_nothing(spark, monkeypatch):
    """Many small ranges, cut by two bits at a time, mapped few at a time, in a process that may open few files."""
    texts = many_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [r.score for r in kneser_ney.score_documents(df, trained(spark, texts)).orderBy("doc_id").collect()]
    monkeypatch.setattr(kneser_ney, "FAN", 2)
    model = trained(spark, texts, grams_per_shard=20)
    assert model.bits > 7
    known = WordHashes()
    limits = resource.getrlimit(resource.RLIMIT_NOFILE)
    opened = len(os.listdir("/proc/self/fd"))
    resource.setrlimit(resource.RLIMIT_NOFILE, (256, limits[1]))
    try:
        got = model.score([kneser_ney.tokens(known, t) for t in texts])[3]
        assert len(os.listdir("/proc/self/fd")) <= opened + kneser_ney.MOST_MAPS
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, limits)
    assert sum(int(np.unpackbits(f).sum()) for f in model.files.values()) > 512
    assert list(got) == pytest.approx(want, rel=1e-12)


def test_a_lost_file_is_an_error(spark):
    texts = many_texts(9, 40)
    model = trained(spark, texts)
    for name in ("word", "gram1", "gram2", "gram3"):
        path = next(iter(sorted(glob.glob(f"{model.root}/{name}-*"))))
        os.rename(path, path + ".gone")
        with pytest.raises(FileNotFoundError):
            replace(model, _maps=OrderedDict()).score([kneser_ney.tokens(WordHashes(), t) for t in texts])
        os.rename(path + ".gone", path)


def test_columns_that_clash_and_settings_that_stay(spark):
    df = spark.createDataFrame([(1, "a b a", "x", 2), (1, "a b a", "y", 3), (2, "b", None, None)], "doc_id long, text string, n_tokens string, score int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = kneser_ney.score_documents(df, kneser_ney.train(df)).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 4), (1, 4), (2, 2)]


def test_words_of_a_batch(monkeypatch):
    """Words cut and hashed together, against words cut and numbered one by one."""
    r = random.Random(5)
    space = [" ", "\t", "\n", "\v", "\f", "\r", "  ", " \n"]
    word = lambda: "".join(r.choices("aAbBzZ\0\x1c\x85\u00a0\u3000\u00c4\u0130_", k=r.choice([1, 2, 7, 8, 9, 15, 16, 17, 60, 64, 65, 70, 200])))
    texts = ["".join(word() + r.choice(space) for _ in range(r.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "\n\t a", "A a", "a\0 a", "x" * 100_000, "abcdefgh" * 8, "abcdefgh" * 8 + "i", *(w + word() for w in space), *("a" * n + "b" for n in range(80)), *("a" * n + "c" for n in range(80))]
    seen, words = {}, {}
    for kind in (pa.string(), pa.large_string()):
        for most in (1, 300, 1 << 22):
            monkeypatch.setattr(kneser_ney, "TEXT_BYTES", most)
            got = list(kneser_ney.tokens_of(pa.array(texts, kind)))
            for text, hashes in zip(texts, got, strict=True):
                plain = (text or "").encode().lower().split()
                assert len(hashes) == len(plain) + 1 and hashes[-1] == kneser_ney.END
                for w, h in zip(plain, hashes.tolist(), strict=False):
                    assert seen.setdefault(w, h) == h and words.setdefault(h, w) == w
                assert (kneser_ney.tokens(None, text) == hashes).all()
    assert list(kneser_ney.tokens_of(pa.array([], pa.string()))) == []


def test_words_cost_no_call_each():
    """Most of the time once went into calls for each word that was new."""
    texts = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = list(kneser_ney._count_words(3)([batch]))
    finally:
        sys.setprofile(None)
    assert sum(len(kneser_ney.unpack(b.as_py(), 2)[0]) for x in found for b in x.column("blob")) == 50_001
    assert calls < 10_000


def test_arrays_of_a_range():
    rng = np.random.default_rng(3)
    for n in (1, 7, 9, 5000):
        keys = np.unique(rng.integers(0, 1 << 61, n).astype(np.uint64) | np.uint64(5 << 61))
        values = np.stack([rng.integers(0, 3, len(keys)), np.where(rng.random(len(keys)) < 0.1, rng.integers(0, 1 << 40, len(keys)), 1)], axis=1)
        have = kneser_ney.Arrays(b"".join(kneser_ney.file_of(keys, 3, values)), 3)
        hit, at = have.find(keys)
        assert hit.all() and (have.rows_at(at) == values).all()
        assert not have.find(np.setdiff1d(rng.integers(0, 1 << 61, 1000).astype(np.uint64) | np.uint64(5 << 61), keys))[0].any()


def test_query_has_order_three_on_sql(spark, duck):
    """All columns against the textbook formulas in SQL."""
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op10_lm_scoring(spark, sf).collect()}
    duck.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duck.sql(queries.ORACLES["op10_lm_scoring"]).df()
    assert len(want) == len(got)
    for w in want.itertuples():
        g = got[w.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score, g.perplexity) == (w.held_out, w.n_tokens, w.n_known, w.train_tokens, w.base_score, w.score, w.perplexity)


@pytest.fixture
def duck():
    return duckdb.connect()
