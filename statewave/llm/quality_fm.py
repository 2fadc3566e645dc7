"""Quality of a text by a factorisation machine.

A text's features are its hashed words (log counts of length one), statistics of its structure
(shares of character classes, repetition, word and line lengths) and its sizes as metadata. The
score adds a bias, a linear part and all pairwise interactions of features, each the product of
two short vectors; the interactions are summed in linear time as half the difference between the
square of the sum and the sum of the squares.

Fitted by AdaGrad on at most ``SAMPLE`` labelled documents. Null and empty texts have a score
too, that of their (zero) features. Without labels every score is 0.5. Several labels of one id
are separate examples, as are several documents; rows with a null label are left out. Repeated rows
get the same score, texts of any length count whole, and an empty table gives no rows. A score of just
the threshold counts as good. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.llm.hashing import bytes_of, hashed_texts
from statewave.llm.langid import first_rows, sample_order
from statewave.llm.text import doc_bucket, plain

BUCKETS = 1 << 14
FACTORS = 8
SAMPLE = 8000
EPOCHS = 6
BATCH = 128
RATE, DECAY = 0.1, 1e-5
THRESHOLD = 0.3
#: Character classes by byte: the shares of each are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"#*$%&|<>", b"\n", b" \t\r", b"()[]{}\"'=_-/\\+@~^`")
STATISTICS = len(CLASSES) + 8
SIZE = BUCKETS + STATISTICS


def statistics(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Structure and size of one text, each about between 0 and 1."""
    n, w = max(len(data), 1), max(len(words), 1)
    histogram = np.bincount(data, minlength=256) / n
    shares = [np.sqrt(histogram[list(c)].sum()) for c in CLASSES]
    _, counts = np.unique(words, return_counts=True)
    repeated = (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0
    pairs = words[1:] * np.uint64(3) + words[:-1] if len(words) > 1 else words
    return np.array(shares + [
        np.sqrt(histogram[128:].sum()), len(counts) / w, counts.max() / w if len(counts) else 0.0, repeated,
        1 - len(np.unique(pairs)) / w, min(n / w / 20, 2.0), np.log1p(len(words)) / 10, np.log1p(len(data)) / 12])


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of every text of a column, in order."""
    data, starts = bytes_of(column)
    for row, end, words, counts in hashed_texts(column):
        ends = np.cumsum(counts)
        for i, (a, b) in enumerate(zip(ends - counts, ends), row):
            bucket, times = np.unique((words[a:b] & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
            x = np.log1p(times)
            x /= max(np.sqrt(x @ x), 1e-12)
            extra = statistics(data[starts[i]:starts[i + 1]], words[a:b])
            yield np.concatenate([bucket, BUCKETS + np.arange(STATISTICS)]), np.concatenate([x, extra])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[index] * x[:, None]
        sums = vx.sum(axis=0)
        return float(self.bias + self.linear[index] @ x + 0.5 * (sums @ sums - (vx * vx).sum()))

    def score(self, index: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(index, x), -30, 30))))


def train(examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
    """Logistic loss by AdaGrad in small batches."""
    rng = np.random.default_rng(2)
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, FACTORS)))
    g_bias, g_linear, g_factors = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(examples))
        for start in range(0, len(order), BATCH):
            who = order[start:start + BATCH]
            index = np.concatenate([examples[k][0] for k in who])
            x = np.concatenate([examples[k][1] for k in who])
            first = np.cumsum([0] + [len(examples[k][0]) for k in who[:-1]])
            size = np.diff(np.r_[first, len(index)])
            v = m.factors[index]
            vx = v * x[:, None]
            sums = np.add.reduceat(vx, first, axis=0)
            margin = m.bias + np.add.reduceat(m.linear[index] * x, first) + 0.5 * (
                (sums ** 2).sum(axis=1) - np.add.reduceat((vx ** 2).sum(axis=1), first))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[who]) / len(who)
            each = np.repeat(error, size)
            used, at = np.unique(index, return_inverse=True)
            d_linear = np.bincount(at, each * x, len(used)) + DECAY * m.linear[used]
            slope = (each * x)[:, None] * (np.repeat(sums, size, axis=0) - vx)
            d_factors = np.stack([np.bincount(at, slope[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * m.factors[used]
            d_bias = error.sum()
            g_bias += d_bias ** 2
            g_linear[used] += d_linear ** 2
            g_factors[used] += d_factors ** 2
            m.bias -= RATE * d_bias / np.sqrt(g_bias)
            m.linear[used] -= RATE * d_linear / np.sqrt(g_linear[used])
            m.factors[used] -= RATE * d_factors / np.sqrt(g_factors[used])
    return m


def sparse_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to (indices, values, label) as bytes."""
    for batch in batches:
        rows = [(i.astype(np.int32).tobytes(), x.astype(np.float32).tobytes()) for i, x in features(batch.column(0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), batch.column(1)],
            names=["index", "x", "label"])


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Learn from docs (doc_id, text) and labels (doc_id, label).

    At most ``SAMPLE`` labels are taken and broadcast, and at most as many examples learned from,
    whatever number of documents share their ids.
    """
    known = labels.where("label is not null and doc_id is not null")
    sample = known.orderBy(sample_order("label")).limit(SAMPLE)
    rows = first_rows(docs.join(F.broadcast(sample), "doc_id").select("text", F.col("label").cast("int").alias("label")).mapInArrow(
        sparse_features, "index binary, x binary, label int"), SAMPLE)
    rows.sort(key=lambda r: (r["label"], bytes(r["index"]), bytes(r["x"])))
    if not rows:
        return Machine(0.0, np.zeros(SIZE), np.zeros((SIZE, FACTORS)))
    examples = [(np.frombuffer(r["index"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(float)) for r in rows]
    return train(examples, np.array([float(r["label"]) for r in rows]))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) from (doc_id, text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([machine.score(i, x) for i, x in features(batch.column(2))], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, held_out boolean, score double, predicted int")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document, as ``op6_quality_fm`` returns it: held out where crc32 mod 5 is 0."""
    rows = plain(docs).select("doc_id", "text", (doc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"))
    seen = plain(labels, ("doc_id", "quality")).select("doc_id", F.col("quality").alias("label")).where(doc_bucket(F.col("doc_id"), 5) != 0)
    return score(rows, fit(rows.select("doc_id", "text"), seen))
