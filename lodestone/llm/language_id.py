"""Language ID by error-correcting output codes over binary n-gram classifiers.

Every language has a codeword; one binary classifier per code bit, log-odds of hashed n-grams, predicts that bit.
Decoding weighs each bit by its loss and takes the codeword of least total loss; a small lead over the next is flagged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, materialize, mix, rows

BUCKETS = 1 << 16
#: Parts of the hash by which a language's sample is chosen; fine enough for 10**15 documents of a language.
SHARES = 1 << 50
_LETTERS = re.compile(r"[^\W\d_]+")
#: Languages whose counts are with the driver at a time.
AT_ONCE = 64


def letter_words(text: str) -> list[str]:
    """Runs of letters (Unicode class L); other numerals such as fractions, circled or Roman ones part words like blanks."""
    words = _LETTERS.findall(text)
    if all(map(str.isalpha, words)):
        return words
    return "".join(c if c.isalpha() else " " for c in " ".join(words)).split()


def features(text: str) -> np.ndarray:
    """Buckets of the byte 2- and 3-grams of the lower-cased letters, words parted by one space; empty without a letter."""
    words = letter_words(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    b = np.frombuffer(f" {' '.join(words)} ".encode("utf-8", "replace"), np.uint8).astype(U64)
    two = b[:-1] * U64(256) + b[1:]
    three = two[:-1] * U64(256) + b[2:] + U64(1 << 24)
    return (mix(np.concatenate([two, three])) & U64(BUCKETS - 1)).astype(np.int64)


def codewords(classes: int) -> np.ndarray:
    """-1/+1 codewords, a row for each class: all splits up to 7 classes, else seeded ones with balanced columns."""
    if classes == 1:
        return np.ones((1, 1), np.int8)
    if classes <= 7:
        bits = [[1 if (v >> c) & 1 else -1 for c in range(classes)] for v in range(1, 1 << (classes - 1))]
        return np.array(bits, np.int8).T
    rng = np.random.default_rng(7)
    length = int(np.ceil(10 * np.log2(classes)))
    best, spread = None, -1
    for _ in range(50):
        code = np.stack([rng.permutation(np.where(np.arange(classes) % 2, 1, -1)) for _ in range(length)], axis=1).astype(np.int8)
        alike = code.astype(np.float32) @ code.T.astype(np.float32) - 2 * length * np.eye(classes)
        apart = (length - alike.max()) / 2
        if apart > spread:
            best, spread = code, apart
    return best


@dataclass
class LanguageModel:
    """languages (sorted), their codewords, and the bits' weights, shape (BUCKETS, bits)."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, ambiguous); ``und``, 0 and true without a letter; ties go to the first by name."""
        x = features(text) if text else ()
        if not len(x) or not self.languages:
            return "und", 0.0, True
        total = np.zeros(self.weights.shape[1])
        for at in range(0, len(x), 1 << 16):
            total += self.weights[x[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        margins = np.clip(total / np.sqrt(len(x)), -30, 30)
        losses = np.log1p(np.exp(-self.code * margins[None, :])).sum(axis=1)
        order = np.argsort(losses, kind="stable")
        if len(order) == 1:
            return self.languages[0], 1.0, False
        lead = losses[order[1]] - losses[order[0]]
        score = float(1.0 - np.exp(-lead / self.code.shape[1]))
        return self.languages[order[0]], score, score < 0.05


def train(docs: DataFrame, wanted: Column | None = None, per_language: int = 4_000) -> LanguageModel:
    """Learn from rows with text and lang where ``wanted`` holds, at most about ``per_language`` of a language.

    The sample is chosen by a hash of doc_id. n-grams are counted in Spark; the driver gets at most BUCKETS counts a
    language, of AT_ONCE languages at a time, and one row for each language. Without a usable row the model knows no
    language. Rows without a letter teach nothing.
    """
    good = F.col("text").isNotNull() & F.col("lang").isNotNull()
    docs = docs.where(good if wanted is None else good & wanted).select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = dict(docs.groupBy("lang").count().collect())
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.ones((0, 1), np.int8), np.zeros((BUCKETS, 1), np.float32))
    share = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(int(SHARES * min(1.0, per_language / sizes[k])) + 1))))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SHARES)) < share[F.col("lang")]).repartition(12, "doc_id")
    at = {k: i for i, k in enumerate(languages)}

    def count(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in rows(batches):
            for text, lang in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                i = at[lang]
                if i not in seen and len(seen) >= AT_ONCE:
                    yield from parts(seen)
                    seen.clear()
                np.add.at(seen.setdefault(i, np.zeros(BUCKETS, np.int64)), features(text.as_py()), 1)
        yield from parts(seen)

    def parts(seen):
        for i, c in seen.items():
            f = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), i)), pa.array(f), pa.array(c[f])], ["i", "f", "c"])

    counts = materialize(sample.mapInArrow(count, "i long, f long, c long").groupBy("i", "f").agg(F.sum("c").alias("c")), "n-grams")
    code = codewords(len(languages))
    if len(languages) == 1:
        return LanguageModel(languages, code, np.ones((BUCKETS, 1), np.float32))
    sums = np.zeros((2, code.shape[1], BUCKETS))  # mean distributions of the languages on a bit's two sides
    for first in range(0, len(languages), AT_ONCE):
        some = counts.where(F.col("i").between(first, first + AT_ONCE - 1)).toArrow()
        seen = np.zeros((min(AT_ONCE, len(languages) - first), BUCKETS))
        seen[some["i"].to_numpy() - first, some["f"].to_numpy()] = some["c"].to_numpy()
        p = (seen + 0.5) / (seen + 0.5).sum(axis=1, keepdims=True)
        side = code[first : first + AT_ONCE].T > 0
        sums += np.stack([side @ p, ~side @ p])
    size = np.stack([(code > 0).sum(axis=0), (code < 0).sum(axis=0)])[:, :, None]
    weights = np.log(sums[0] / size[0]) - np.log(sums[1] / size[1])
    return LanguageModel(languages, code, weights.T.astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row; only text is an input of the prediction.

    Null or empty text and text without a letter: ``und``, 0.0, true. Ties go to the first language by name. Whole texts
    are read, however long. Repeated rows are each answered. Empty table: empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats, whatever the input

    def run(batches):
        for batch in rows(batches):
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def language_column(model: LanguageModel, text: str = "text") -> Column:
    """The predicted language as a column, so that a filter on it moves no rows."""

    @F.arrow_udf("string")
    def predicted(texts: pa.Array) -> pa.Array:
        return pa.array([model.predict(t.as_py())[0] for t in texts], pa.string())

    return predicted(F.col(text).cast("string"))
