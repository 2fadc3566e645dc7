"""Language of a text by multinomial logistic regression on TF-IDF character n-grams.

Letters are lowered, runs of other characters are one blank, and all 1- to 3-grams of the whole
text are hashed into ``BUCKETS``. A bucket's weight is log(1 + count) times its inverse document
frequency over all learning documents, and a text's weights have length one. The weights of the
regression are learned by follow-the-regularised-leader with an elastic net (L1 makes them
sparse), on at most ``SAMPLE`` learning documents; a fifth of them sets the temperature that
calibrates the probabilities.

Null texts and texts without a letter are ``und`` with score 0, as is everything if there is
nothing to learn from. Equal probabilities go to the first label by code points. Repeated rows count
each time and get the same result; so do rows of one id, or without one, by their own texts. Texts
of any length count whole; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from statewave.llm.hashing import mix
from statewave.llm.text import doc_bucket, plain

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SAMPLE = 4000
EPOCHS = 5
BATCH = 64
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def symbols(text: str) -> np.ndarray:
    """Code points with runs of non-letters as one blank; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < 0x10000
    letter = letters()[np.where(low, codes, 0)] & low
    if not low.all():
        letter[~low] = [chr(c).isalpha() for c in codes[~low]]
    if not letter.any():
        return codes[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    return np.concatenate([[np.uint64(32)], codes, [np.uint64(32)]])


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts per bucket, or None without a letter."""
    codes = symbols(text or "")
    if not len(codes):
        return None
    total = np.zeros(BUCKETS, dtype=np.int64)
    key = np.zeros(len(codes), dtype=np.uint64)
    for n in ORDERS:
        key = key[:len(codes) - n + 1] * np.uint64(0x110000) + codes[n - 1:]
        total += np.bincount((mix(key + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return total


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts with a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (counts := gram_counts(text.as_py())) is not None:
                    seen[:BUCKETS] += counts > 0
                    n += 1
        seen[BUCKETS] = n
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out[:BUCKETS], int(out[BUCKETS])


def sample_order(*more: str) -> Column:
    """Rows in order of a hash of their ids, those of one id by a hash of other columns."""
    return F.struct(F.xxhash64("doc_id", F.lit("sample")).alias("h"), F.xxhash64(*more).alias("g"))


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` first rows (doc_id, text, ...) in sample order, with all that equal the last one in id and text.

    ``first_rows`` bounds what is learned from them.
    """
    order = sample_order("text")
    last = rows.select(order.alias("o")).orderBy("o").limit(most).agg(F.max("o").alias("o")).select("o.*").first()
    if last["h"] is None:
        return rows.limit(0)
    return rows.where(order <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["g"]).alias("g")))


def first_rows(rows: DataFrame, most: int) -> list[Row]:
    """At most ``most`` rows, by a hash of all their columns."""
    return rows.orderBy(F.xxhash64(*rows.columns)).limit(most).collect()


def sparse_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to (buckets, counts, label) as bytes."""
    for batch in batches:
        rows = []
        for text, label in zip(batch.column(0), batch.column(1)):
            if (counts := gram_counts(text.as_py())) is not None:
                some = np.flatnonzero(counts)
                rows.append((some.astype(np.uint16).tobytes(), counts[some].astype(np.int32).tobytes(), label.as_py()))
        cols = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.string())],
                                         names=["buckets", "counts", "label"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def unit(self, some: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[some]
        return x / max(np.sqrt(x @ x), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text)
        if counts is None or not self.labels:
            return UNKNOWN, 0.0
        some = np.flatnonzero(counts)
        z = self.unit(some, counts[some]) @ self.weights[some] + self.bias
        p = softmax(z[None] / self.temperature)[0]
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets, classes) and bias. The last row of the state is the bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    rng = np.random.default_rng(1)

    def solve() -> np.ndarray:
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    w = solve()
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for start in range(0, len(x), BATCH):
            who = order[start:start + BATCH]
            dense = np.zeros((len(who), BUCKETS + 1))
            for i, k in enumerate(who):
                dense[i, x[k][0]] = x[k][1]
            dense[:, -1] = 1.0
            error = softmax(dense @ w)
            error[np.arange(len(who)), y[who]] -= 1.0
            g = dense.T @ error
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
            z += g - sigma * w
            n += g * g
            w = solve()
    return w[:-1], w[-1]


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the largest likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(learning: DataFrame) -> Model:
    """Learn from (doc_id, text, lang); rows without a language only count for the frequencies."""
    frequency, n = document_frequencies(learning)
    idf = np.log((1 + n) / (1 + frequency)) + 1.0
    sample = bounded_sample(learning.where("lang is not null and text is not null"), SAMPLE)
    rows = sample.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(
        sparse_grams, "buckets binary, counts binary, label string")
    rows = first_rows(rows, SAMPLE)
    rows.sort(key=lambda r: (r["label"], bytes(r["buckets"]), bytes(r["counts"])))
    labels = sorted({r["label"] for r in rows})
    model = Model(labels, idf, np.zeros((BUCKETS, len(labels))), np.zeros(len(labels)))
    if not rows:
        return model
    x = []
    for r in rows:
        some = np.frombuffer(r["buckets"], np.uint16).astype(np.int64)
        x.append((some, model.unit(some, np.frombuffer(r["counts"], np.int32))))
    y = np.array([labels.index(r["label"]) for r in rows])
    part = np.random.default_rng(0).permutation(len(x))
    held, used = part[:len(x) // 5], part[len(x) // 5:]
    model.weights, model.bias = ftrl([x[i] for i in used], y[used], len(labels))
    logits = np.array([x[i][1] @ model.weights[x[i][0]] + model.bias for i in held]).reshape(len(held), -1)
    model.temperature = calibrated(logits, y[held])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) from (doc_id, text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    """One row per document, as ``op4_langid`` returns it: held out where crc32 mod 3 is 1."""
    rows = plain(docs).select("doc_id", "text", "lang", (doc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"))
    return predict(rows, fit(rows.where(~F.col("held_out")).select("doc_id", "text", "lang")))
