"""Resampling of documents towards a target: importance weights of hashed n-grams, drawn by Gumbel keys.

Features are runs of one and two words, hashed into buckets. A bucket's gain is how much more
often the target has it, as a logarithm; a document's weight is the mean gain of its features. A
document is drawn if its weight plus Gumbel noise, taken from a hash of its id, is among the highest.

Texts repeat lines, so they are cut into lines at newlines, which no word and no run within a line
spans. Spark brings equal lines of all texts together; each distinct line's features are counted
once and multiplied by its occurrences. The runs across two lines, from the last word of a line to the first one of the next
line with words, are counted separately. Documents are weighted in the same way: a batch's distinct lines
once, plus the runs across lines.

Buckets come from crc32 values. That of two words and a space follows from those of the words by
shifting the first by the length of the second, which tables do for whole batches.

Nulls, and texts without words, have no features and weight 0. A document of fewer than
``least_words`` words is never drawn. Equal scores are ordered by id (null last), then by weight and
number of features; repeated rows are drawn as documents of their own. A null id counts as
empty text in the hash. Empty tables give empty results, an empty target gains of the corpus
alone. Texts of any length count whole. Other columns are kept by ``resample`` and otherwise ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from statewave.llm.cut import Words, byte_set, cut_column
from statewave.llm.store import saved
from statewave.llm.text import plain

BUCKETS, SHARE, LEAST_WORDS, SEED = 10000, 25, 20, 7
BREAKS, LINE_END = byte_set(range(0, 48), range(58, 97), range(123, 128)), byte_set(10)
RUN_BYTES = 8_000_000


def shift_tables() -> np.ndarray:
    """[k, i, b]: what 2^k zero bytes make of the crc32 register whose i-th byte is b and whose others are zero."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(0xEDB88320), values >> 1)
    one = np.empty((4, 256), dtype=np.uint32)
    for i in range(4):
        register = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
        one[i] = values[register & 255] ^ (register >> np.uint32(8))
    tables = [one]
    while len(tables) < 32:
        tables.append(shifted_once(tables[-1], tables[-1]))
    return np.stack(tables)


def shifted_once(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


SHIFT = shift_tables()


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Registers after ``size`` zero bytes each."""
    crc = crc.copy()
    for k in range(int(size.max(initial=0)).bit_length()):
        at = np.flatnonzero(size >> k & 1)
        crc[at] = shifted_once(crc[at], SHIFT[k])
    return crc


class Buckets:
    """Buckets of the words of a run of texts and of neighbouring words."""

    def __init__(self, words: Words, buckets: int):
        self.words, self.buckets = words, buckets
        values = words.values.to_pylist()
        self.crc = np.array([zlib.crc32(v) for v in values], dtype=np.uint32)
        self.spaced = np.array([zlib.crc32(b" ", c) for c in self.crc.tolist()], dtype=np.uint32)
        self.size = np.array([len(v) for v in values], dtype=np.int64)

    def single(self) -> np.ndarray:
        return (self.crc % np.uint32(self.buckets)).astype(np.int64)[self.words.code]

    def double(self, first: np.ndarray) -> np.ndarray:
        """Buckets of the words at ``first`` with the ones that follow."""
        a, b = self.words.code[first], self.words.code[first + 1]
        return ((shifted(self.spaced[a], self.size[b]) ^ self.crc[b]) % np.uint32(self.buckets)).astype(np.int64)


def text_of(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.counts)), words.counts)


def within(text: np.ndarray) -> np.ndarray:
    """Places of words that another one of the same text follows."""
    return np.flatnonzero(text[1:] == text[:-1])


def bucket_rows(total: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], names=["bucket", "n"])


def count_lines(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches (line, occurrences) to (bucket, n)."""
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        times = batch.column(1).to_numpy()
        for row, end, words in cut_column(batch.column(0), RUN_BYTES, BREAKS):
            of, line = Buckets(words, buckets), text_of(words)
            first = within(line)
            for bucket, n in ((of.single(), times[row:end][line]), (of.double(first), times[row:end][line[first]])):
                np.add.at(total, bucket, n)
    yield bucket_rows(total)


def crossings(words: Words) -> np.ndarray:
    """Places of words whose next one lies on a later line of the same text."""
    first = within(text_of(words))
    return first[words.piece[first] != words.piece[first + 1]]


def count_crossings(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches (text) to (bucket, n) of the runs across two lines."""
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for _, _, words in cut_column(batch.column(0), RUN_BYTES, BREAKS, piece_breaks=LINE_END):
            total += np.bincount(Buckets(words, buckets).double(crossings(words)), minlength=buckets)
    yield bucket_rows(total)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of all texts (one column, ``text``)."""
    lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    inner = lines.mapInArrow(lambda batches: count_lines(batches, buckets), "bucket int, n bigint")
    across = texts.mapInArrow(lambda batches: count_crossings(batches, buckets), "bucket int, n bigint")
    return inner.union(across).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain: one number for each of a fixed number of buckets."""
    sides = bucket_counts(docs, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).union(
        bucket_counts(target, buckets).select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    every = docs.sparkSession.range(buckets).select(
        F.col("id").cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t"))
    counts = sides.union(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    table = counts.toArrow().sort_by("bucket")
    s, t = table.column("s").to_numpy().astype(float), table.column("t").to_numpy().astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Exact sums of whole numbers by group; groups follow each other."""
    ends = np.searchsorted(group, np.arange(groups + 1))
    return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])


def weigh(texts: pa.Array, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed gains of each text."""
    sizes, total = [], []
    for row, end, lines in cut_column(texts, RUN_BYTES, LINE_END):
        inner = np.zeros(len(lines.values), dtype=np.int64)
        for a, b, words in cut_column(lines.values, RUN_BYTES, BREAKS):
            of, line = Buckets(words, len(gain)), text_of(words)
            first = within(line)
            inner[a:b] = sums(gain[of.single()], line, b - a) + sums(gain[of.double(first)], line[first], b - a)
        here = sums(inner[lines.code], text_of(lines), end - row)
        for a, b, words in cut_column(texts.slice(row, end - row), 1 << 62, BREAKS, piece_breaks=LINE_END):
            first = crossings(words)
            total.append(here + sums(gain[Buckets(words, len(gain)).double(first)], text_of(words)[first], end - row))
            sizes.append(words.counts)
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *sizes]), np.concatenate([none, *total])


def weighted(rows: DataFrame, gain: np.ndarray, dropped: tuple[str, ...] = ()) -> DataFrame:
    """Rows of documents with ``__words``, ``__features`` and ``__weight``, without the ``dropped`` columns."""
    kept = [c for c in rows.columns if c not in dropped]
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, total = weigh(batch.column("text"), shared.value)
            features = np.maximum(2 * words - 1, 0)
            new = [words, features, total // np.maximum(features, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, new)],
                                             names=[*kept, "__words", "__features", "__weight"])

    schema = rows.select(*kept).schema
    for c in ("__words", "__features", "__weight"):
        schema = schema.add(c, LongType())
    return rows.mapInArrow(add, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``__rank`` from 1 in a global order.

    Rows are range-partitioned and numbered within partitions; what goes before a partition is a
    running sum over one number for each. Equal rows are dealt by where they lie in the table.
    """
    order = [*order, F.col("__at")]
    rows = saved(rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn(
        "__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__part").agg(F.count("*").alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.withColumn("__inside", inside).join(F.broadcast(parts), "__part").withColumn(
        "__rank", F.col("__before") + F.col("__inside")).drop("__at", "__part", "__inside", "__before")


def drawn(rows: DataFrame, share: int, least_words: int, seed: int) -> DataFrame:
    """Weighted rows with ``__score`` and ``__rank``, null if not drawn."""
    rows = saved(rows.withColumn("__score", F.col("__weight") + noise(F.col("doc_id"), seed)))
    enough = rows.where(F.col("__words") >= least_words)
    most = enough.count() * share // 100
    order = [F.desc("__score"), F.col("doc_id").asc_nulls_last(), F.col("__weight"), F.col("__features")]
    first = ranked(enough, order).withColumn("__rank", F.when(F.col("__rank") <= most, F.col("__rank")))
    return first.union(rows.where(F.col("__words") < least_words).withColumn("__rank", F.lit(None).cast("bigint")).select(*first.columns))


def texts(rows: DataFrame) -> DataFrame:
    return plain(rows).select(F.col("text").cast("string").alias("text"))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
             buckets: int = BUCKETS) -> DataFrame:
    """The drawn documents with their own columns."""
    own = plain(docs)
    rows = drawn(weighted(own, gains(texts(docs), texts(target), buckets)), share, least_words, seed)
    return rows.where("__rank is not null").select(*own.columns).toDF(*docs.columns)


def resample_digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document, as ``op12_resample`` returns it."""
    own = plain(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = drawn(weighted(own, gains(texts(docs), texts(target)), ("text",)), SHARE, LEAST_WORDS, SEED)
    return rows.select("doc_id", F.col("__features").alias("n_features"), F.col("__weight").alias("weight"),
                       F.col("__score").alias("score"), F.col("__rank").alias("rank"))
