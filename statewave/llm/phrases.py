"""Phrases of each language: frequent word n-grams scored by how far they exceed their parts.

Two passes over the texts find all n-grams with at least ``least`` occurrences, exactly:

1. Every block of texts sends the hashes of its n-grams with their numbers to hash partitions. A
   partition of mass m (occurrences) merges them into a Misra-Gries summary of more than m / least
   counters. Merging adds counters up and lowers all of them by the largest one that has no room;
   so each is too small by less than ``least`` in the end, and the sum of all lowerings bounds
   that error: what may reach ``least`` survives. Each partition marks its survivors in its share
   of a filter of ``FILTER_BITS`` bits, 16 MB whatever the size of the corpus.
2. Blocks count those n-grams that the filter lets pass by their words, Spark adds the numbers up,
   and what stays under ``least`` goes. So neither equal hashes nor a crowded filter change the
   result; they only let more n-grams into the exact count.

Lengths are counted per language (null is ``und``) within pieces of text between punctuation or
line ends. A phrase's score is the smallest, over its cuts in two, of
floor(1000000 * a * a / (l * r)), in decimals of 38 digits, exact up to 10^12 occurrences. A
phrase that lies in a longer one with at least ``contained`` per cent of its occurrences goes.

Nulls and empty texts have no words; repeated rows count each time; texts of any length count
whole. Equal scores are ordered by occurrences, then by the bytes of the phrase. An empty table
gives no rows, as does a language without phrases. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewave.llm.cut import Words, byte_set, cut_column
from statewave.llm.hashing import mix
from statewave.llm.store import saved
from statewave.llm.text import plain

LEAST, LONGEST, CONTAINED, TOP = 10, 3, 50, 2000
BLANKS, PIECE_ENDS = byte_set(32, 9), byte_set(*map(ord, ".,;:!?"), range(10, 14))
BLOCK_BYTES = 8_000_000
FILTER_BITS = 1 << 27
#: About so many occurrences to a hash partition; a word has about so many bytes.
MASS_PER_SHARD, BYTES_PER_WORD = 1 << 22, 6


class Block:
    """Words of a run of texts with the hashes of their n-grams."""

    def __init__(self, words: Words, langs: list[str]):
        self.words, self.langs = words, langs
        names, code = np.unique(np.array(langs, dtype=object), return_inverse=True) if langs else (np.array([]), np.array([], int))
        self.names = names.tolist()
        self.lang = np.repeat(code, words.counts)
        of = lambda values: np.array([xxhash.xxh64_intdigest(v) for v in values], dtype=np.uint64)
        self.hash = of(words.values.to_pylist())[words.code] if len(words.code) else np.empty(0, np.uint64)
        self.seed = of([n.encode() for n in self.names])[self.lang] if len(self.lang) else np.empty(0, np.uint64)

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places of first words, hashes) of the n-grams of each length."""
        place, value = np.arange(len(self.hash)), self.seed
        for k in range(longest):
            stay = place + k < len(self.hash)
            if k:
                stay[stay] = self.words.piece[place[stay]] == self.words.piece[place[stay] + k]
            place, value = place[stay], value[stay]
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + self.hash[place + k])
            yield k + 1, place, value


def blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """Arrow batches (lang, text) cut in blocks."""
    langs = batch.column(0).to_pylist()
    for row, end, words in cut_column(batch.column(1), BLOCK_BYTES, BLANKS, piece_breaks=PIECE_ENDS):
        yield Block(words, langs[row:end])


def shard_of(value: np.ndarray, shards: int) -> np.ndarray:
    return (value >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def deal(batches: Iterator[pa.RecordBatch], shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, the lower halves of n-grams' hashes, their numbers), one for each block and shard.

    Numbers are bytes; a larger one is dealt out over several entries.
    """
    for batch in batches:
        for block in blocks(batch):
            value = np.concatenate([value for _, _, value in block.grams(longest)])
            value = (shard_of(value, shards) << np.uint64(32)) | (value & np.uint64(0xFFFFFFFF))
            value.sort()
            start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])[:len(value)])
            count, value = np.diff(np.concatenate([start, [len(value)]])), value[start]
            parts = -(-count // 255)
            value, rest = np.repeat(value, parts), np.repeat(count, parts)
            nth = np.arange(len(value)) - np.repeat(np.cumsum(parts) - parts, parts)
            count = np.minimum(rest - 255 * nth, 255).astype(np.uint8)
            shard, low = value >> np.uint64(32), value.astype(np.uint32)
            cut = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int64)), pa.array([low[cut[s]:cut[s + 1]].tobytes() for s in used], pa.binary()),
                 pa.array([count[cut[s]:cut[s + 1]].tobytes() for s in used], pa.binary())], names=["shard", "low", "count"])


class Summary:
    """A mergeable Misra-Gries summary: counters that lie below the truth by at most ``error``."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.key, self.count = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, key: np.ndarray, count: np.ndarray) -> None:
        key, count = np.concatenate([self.key, key]), np.concatenate([self.count, count])
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
        key, count = key[start], np.add.reduceat(count, start) if len(start) else count
        if len(key) > self.capacity:
            least = int(np.partition(count, len(count) - self.capacity - 1)[len(count) - self.capacity - 1])
            self.error += least
            key, count = key[count > least], count[count > least] - least
        self.key, self.count = key, count

    def survivors(self, least: int) -> np.ndarray:
        return self.key[self.count + self.error >= least]


def summarise(rows: pd.DataFrame, least: int, width: int) -> pd.DataFrame:
    """One shard's entries to its share of the filter, ``width`` bits, with the survivors' bits set."""
    counts = [np.frombuffer(c, np.uint8) for c in rows["count"]]
    lows = [np.frombuffer(v, np.uint32) for v in rows["low"]]
    summary = Summary(sum(int(c.sum()) for c in counts) // least + 1)
    held: list[int] = []
    for i, low in enumerate(lows):
        held.append(i)
        if sum(len(lows[j]) for j in held) > summary.capacity or i + 1 == len(lows):
            summary.merge(np.concatenate([lows[j] for j in held]), np.concatenate([counts[j] for j in held]).astype(np.int64))
            held = []
    bits = np.zeros(width, dtype=bool)
    bits[place_in(summary.survivors(least).astype(np.uint64), width).astype(np.int64)] = True
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def place_in(low: np.ndarray, width: int) -> np.ndarray:
    return low * np.uint64(width) >> np.uint64(32)


def frequent_filter(rows: DataFrame, shards: int, least: int, longest: int) -> np.ndarray:
    """Bytes of the filter: at most ``FILTER_BITS`` bits, equal shares for all shards."""
    width = FILTER_BITS // shards // 8 * 8
    found = rows.mapInArrow(lambda batches: deal(batches, shards, longest), "shard bigint, low binary, count binary").groupBy(
        "shard").applyInPandas(lambda group: summarise(group, least, width), "shard bigint, bits binary").toArrow()
    out = np.zeros((shards, width // 8), dtype=np.uint8)
    for shard, bits in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        out[shard] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def numbered(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row that is equal for equal rows only."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        size = int(c.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + c
    return key


def count_block(block: Block, bits: np.ndarray, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, words, phrase, n) of a block's n-grams that pass the filter; a null phrase has all words' number."""
    types = (pa.string(), pa.int32(), pa.string(), pa.int64())
    names = ["lang", "words", "phrase", "n"]
    code, width = block.words.code, len(bits) * 8 // shards
    values = block.words.values.cast(pa.large_string())
    total = np.bincount(block.lang, minlength=len(block.names))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        (block.names, [0] * len(total), [None] * len(total), total), types)], names=names)
    langs = pa.array(block.names, pa.string())
    for k, place, value in block.grams(longest):
        at = (shard_of(value, shards) * np.uint64(width) + place_in(value & np.uint64(0xFFFFFFFF), width)).astype(np.int64)
        place = place[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        if not len(place):
            continue
        _, first, n = np.unique(numbered([block.lang[place], *(code[place + j] for j in range(k))]), return_index=True, return_counts=True)
        first = place[first]
        parts = [values.take(pa.array(code[first + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(block.lang[first])), pa.array(np.full(len(first), k, np.int32)),
                                          phrase.cast(pa.string()), pa.array(n.astype(np.int64))], names=names)


def frequent(docs: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, words, phrase, n): exact numbers of all n-grams with at least ``least``; a null phrase has its language's words."""
    rows = plain(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, min(size * longest // BYTES_PER_WORD // MASS_PER_SHARD, FILTER_BITS >> 6))
    bits = rows.sparkSession.sparkContext.broadcast(frequent_filter(rows, shards, least, longest))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield from count_block(block, bits.value, shards, longest)

    counted = rows.mapInArrow(count, "lang string, words int, phrase string, n bigint")
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(
        F.col("phrase").isNull() | (F.col("n") >= least))


def best_cut(found: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of phrases of two words and more, by their lowest-scoring cut."""
    part = lambda start, size: F.array_join(F.slice("parts", start, size), " ")
    cuts = found.where("words > 1").withColumn("parts", F.split("phrase", " ")).withColumn(
        "cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "words", "phrase", F.col("n").alias("a"), "cut", part(F.lit(1), F.col("cut")).alias("left"),
        part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    number = lambda side, name: found.where("phrase is not null").select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cuts = cuts.join(number("left", "l"), ["lang", "left"]).join(number("right", "r"), ["lang", "right"])
    exact = {c: F.col(c).cast("decimal(12,0)") for c in "alr"}
    cuts = cuts.withColumns({"up": exact["a"] * exact["a"] * F.lit(1000000).cast("decimal(7,0)"), "down": exact["l"] * exact["r"]})
    best = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(F.expr("up div down").alias("score"), "cut", "l", "r")).alias("best"))
    return best.select("lang", "words", "phrase", "a", "best.l", "best.r", "best.score")


def outermost(rows: DataFrame, contained: int) -> DataFrame:
    """Without phrases that lie in a longer one with at least ``contained`` per cent of their occurrences."""
    inner = F.explode(F.expr("""flatten(transform(sequence(2, words - 1), size -> transform(sequence(1, words - size + 1),
        start -> array_join(slice(split(phrase, ' '), start, size), ' '))))"""))
    longer = rows.where("words > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return rows.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a"))).drop("longer")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language with their numbers, as ``op11_phrases`` returns them."""
    found = saved(frequent(docs, least, longest))
    rows = outermost(saved(best_cut(found)), contained)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    total = found.where("phrase is null").select("lang", "n")
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
