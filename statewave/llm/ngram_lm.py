"""A trigram language model over the corpus, and the log10 probability of every text under it.

With c the counts in the learning texts, N their number of tokens, V of distinct ones,

    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
    p(w | g h) = (c(g h w) + A c(h w) + B p(w)) / (c(g h) + A c(h) + B).

A text is its words and one end token; what goes before its first word is the beginning, twice.
Every token but the end is the context of exactly one token, so log p of a text is a sum of terms
that each belong to one word and what stands before it: log(c(g h w) + A c(h w) + B p(w)) of the
token itself less log(c(h w) + A c(w) + B), the denominator of the next one; and the beginning's own term.

So tokens are dealt to shards by their word, once, packed as arrays by blocks of texts. A
frequent word's tokens are dealt by word and context, and its count comes from a first pass over
unigrams. A shard builds its part of the trie in three levels: words, the words before them relative to
the word (so that a word's contexts are one range), and the words before those relative to the
pair. Each level is an Elias-Fano list of keys that begin with the parent's place, the upper levels carry
quantised log values of numerator and denominator, the last one of its numerator, and everything is memory-mapped.
A token is looked up level by level by successor search in its parent's range; where a level has
no entry, the value of the level above without it holds.

Contexts are named by hashes relative to what follows them, of 40 bits and, before a pair, of 32. Nulls count as empty texts, which
have the end token alone. Repeated rows are separate texts. Rows without an id are scored too.
Texts of any length count whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.llm.elias_fano import EliasFano, Levels
from statewave.llm.hashing import hashed_texts, mix
from statewave.llm.text import doc_bucket, plain

#: A and B above: the best of 12 pairs on held-out documents.
PAIRS, SINGLES = 0.01, 2.0
BYTES_PER_SHARD = 9_000_000
TOKENS_PER_BLOCK = 700_000
TEXTS_PER_BLOCK = 32_000
#: A text's number in its block has this bit if the text is held out.
HELD_OUT = np.uint16(1 << 15)
#: A word with more tokens than this is dealt by word and context.
FREQUENT = 300_000
END, BEGINNING = np.uint64(1), np.uint64(2)
CONTEXT_BITS, BEFORE_BITS = np.uint64(40), np.uint64(32)
CONTEXT_MASK = (np.uint64(1) << CONTEXT_BITS) - np.uint64(1)
#: Log values are kept in steps of 1/STEPS above LEAST.
LEAST, STEPS = -24.0, 1500.0
BLOCK = ("shard int, block bigint, words binary, sizes binary, contexts binary, spread binary, befores binary, times binary, texts binary, "
         "about binary")
SUM = np.dtype([("model", "<f4"), ("base", "<f8"), ("known", "<u4")])
SUMS = "block bigint, texts binary, sums binary, about binary"


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(key) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def unigram_blocks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(text) of learning texts to their words and counts, a row per shard."""
    held: list[np.ndarray] = []
    size = texts = 0

    def flush() -> pa.RecordBatch:
        word, times = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        word, times = np.append(word, END), np.append(times, texts)
        shard = shard_of(word, shards)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [(int(k), word[order[cut[k]:cut[k + 1]]].tobytes(), times[order[cut[k]:cut[k + 1]]].astype(np.int32).tobytes())
                for k in np.flatnonzero(np.diff(cut))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                          names=["shard", "words", "times"])

    for batch in batches:
        for _, _, words, counts in hashed_texts(batch.column(0)):
            held.append(words)
            size += len(words)
            texts += len(counts)
            if size >= 2 * TOKENS_PER_BLOCK:
                yield flush()
                held, size, texts = [], 0, 0
    if texts:
        yield flush()


def unigram_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's sums, without a word, and its frequent words."""
    word = np.concatenate([np.frombuffer(b, np.uint64) for b in rows["words"]])
    times = np.concatenate([np.frombuffer(b, np.int32) for b in rows["times"]])
    word, at = np.unique(word, return_inverse=True)
    count = np.bincount(at, times).astype(np.int64)
    often = (count > FREQUENT) | (word == END)
    return pd.DataFrame({"word": pd.Series([None, *word[often].view(np.int64)], dtype="Int64"),
                         "tokens": [count.sum(), *count[often]], "distinct": [len(word), *[0] * int(often.sum())]})


class Totals:
    """What all shards need to know: N, V, and the counts of the frequent words (few to a shard)."""

    def __init__(self, rows: list):
        sums = [r for r in rows if r["word"] is None]
        self.tokens = sum(r["tokens"] for r in sums)
        self.distinct = sum(r["distinct"] for r in sums)
        often = sorted((np.int64(r["word"]).view(np.uint64).item(), r["tokens"]) for r in rows if r["word"] is not None)
        if not any(w == int(END) for w, _ in often):
            often = sorted([*often, (int(END), 0)])
        self.words = np.array([w for w, _ in often], dtype=np.uint64)
        self.counts = np.array([c for _, c in often], dtype=np.int64)
        self.texts = int(self.counts[self.words == END][0])

    def place(self, word: np.ndarray) -> np.ndarray:
        """Place among the frequent words, or -1."""
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at, -1)

    @property
    def mass(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def token_blocks(batches: Iterator[pa.RecordBatch], shards: int, totals: Totals) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, held_out) to blocks of texts, a row per shard that they need."""
    ids: list = []
    held_out: list[bool] = []
    words: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    serial = 0

    def flush() -> pa.RecordBatch:
        nonlocal serial
        block = (TaskContext.get().partitionId() << 32) + serial
        serial += 1
        word, count = np.concatenate(words), np.concatenate(counts)
        n = len(count)
        number = np.arange(n, dtype=np.uint16) | np.where(np.array(held_out, dtype=bool), HELD_OUT, np.uint16(0))  # at most TEXTS_PER_BLOCK
        text = np.repeat(number, count + 1)
        ends = np.cumsum(count + 1) - 1
        inner = np.ones(len(text), dtype=bool)
        inner[ends] = False
        token = np.full(len(text), END)
        token[inner] = word
        context, before = np.empty_like(token), np.empty_like(token)
        context[1:] = token[:-1]
        context[ends - count] = BEGINNING
        before[1:] = context[:-1]
        before[ends - count] = BEGINNING
        context = mix(context + token * np.uint64(0x9E3779B97F4A7C15))
        before = (mix(before + context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        context &= CONTEXT_MASK
        shard = shard_of(np.where(totals.place(token) >= 0, token ^ (context << np.uint64(20)), token), shards).astype(np.int32)
        order = np.lexsort((before, context, token, shard))
        token, context, before, shard, text = token[order], context[order], before[order], shard[order], text[order]
        del order, inner
        about = [pa.array(ids, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(count + 1, pa.int64())]
        about = pa.RecordBatch.from_arrays(about, names=["doc_id", "held_out", "n_tokens"]).serialize().to_pybytes()
        cut = np.searchsorted(shard, np.arange(shards + 1))
        rows = []
        for k in sorted({*np.flatnonzero(np.diff(cut)).tolist(), block % shards}):
            part = slice(cut[k], cut[k + 1])
            t, c, g = token[part], context[part], before[part]
            pair, triple = np.ones(len(t), dtype=bool), np.ones(len(t), dtype=bool)
            pair[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            triple[1:] = pair[1:] | (g[1:] != g[:-1])
            first, each = np.flatnonzero(pair), np.flatnonzero(triple)
            w, sizes = np.unique(t[first], return_counts=True)
            rows.append((k, block, w.tobytes(), sizes.astype(np.int32).tobytes(),
                         np.ascontiguousarray(c[first].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes(),
                         np.diff(np.r_[np.searchsorted(each, first), len(each)]).astype(np.int32).tobytes(), g[each].tobytes(),
                         np.diff(np.r_[each, len(t)]).astype(np.int32).tobytes(), text[part].tobytes(),
                         about if k == block % shards else None))
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 8]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          names=[x.split()[0] for x in BLOCK.split(", ")])

    for batch in batches:
        doc_ids, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for row, end, w, c in hashed_texts(batch.column(1)):
            for a in range(row, end, TEXTS_PER_BLOCK):
                b = min(a + TEXTS_PER_BLOCK, end)
                if ids and len(ids) + b - a > TEXTS_PER_BLOCK:
                    yield flush()
                    ids, held_out, words, counts = [], [], [], []
                p, q = int(c[:a - row].sum()), int(c[:b - row].sum())
                ids += doc_ids[a:b]
                held_out += flags[a:b]
                words.append(w[p:q])
                counts.append(c[a - row:b - row])
                if sum(map(len, words)) >= TOKENS_PER_BLOCK:
                    yield flush()
                    ids, held_out, words, counts = [], [], [], []
    if ids:
        yield flush()


class Trie:
    """Words with their counts, contexts with two values each, what goes before them with one, of one shard.

    A key of a lower level is its parent's place, then its own name relative to the parent.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, ends: np.ndarray,
                 befores: np.ndarray, triples: np.ndarray):
        self.levels = Levels()
        self.words = EliasFano(words, self.levels)
        self.counts = self.levels.put(counts)
        self.contexts = EliasFano(contexts, self.levels)
        self.befores = EliasFano(befores, self.levels)
        self.pairs, self.ends, self.triples = (self.levels.put(
            np.clip(np.rint((v - LEAST) * STEPS), 0, 65535).astype(np.uint16)) for v in (pairs, ends, triples))

    def count(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, or -1, and its count."""
        at = self.words.find(words)
        return at, np.where(at >= 0, self.counts[at], 0) if self.words.n else np.zeros(len(words), np.int64)

    @staticmethod
    def below(level: EliasFano, places: np.ndarray, bits: np.uint64, names: np.ndarray) -> np.ndarray:
        """Places of names under their parents' places, or -1."""
        out = np.full(len(places), -1)
        some = np.flatnonzero(places >= 0)
        out[some] = level.find((places[some].astype(np.uint64) << bits) | names[some])
        return out

    @staticmethod
    def value(codes: np.ndarray, places: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        out = otherwise.astype(float)
        some = np.flatnonzero(places >= 0)
        out[some] = LEAST + codes[places[some]] / STEPS
        return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


def score_shard(rows: pd.DataFrame, totals: Totals) -> pd.DataFrame:
    """Sums by block and text: model value, base value and number of known tokens."""
    word, context, spread, before, times, learned = [], [], [], [], [], []
    for r in rows.itertuples():
        w, n = np.frombuffer(r.words, np.uint64), np.frombuffer(r.sizes, np.int32)
        c = np.zeros((n.sum(), 8), dtype=np.uint8)
        c[:, :5] = np.frombuffer(r.contexts, np.uint8).reshape(-1, 5)
        m, t = np.frombuffer(r.times, np.int32), np.frombuffer(r.texts, np.uint16)
        word.append(np.repeat(w, n))
        context.append(c.view("<u8")[:, 0])
        spread.append(np.frombuffer(r.spread, np.int32))
        before.append(np.frombuffer(r.befores, np.uint32))
        times.append(m)
        learned.append(np.add.reduceat(t < HELD_OUT, np.cumsum(m) - m, dtype=np.int32) if len(m) else m)
    unique, rank = distinct(np.concatenate(word))
    pair, at_pair = distinct((rank.astype(np.uint64) << CONTEXT_BITS) | np.concatenate(context))
    spread = np.concatenate(spread)
    triple, at = distinct((np.repeat(at_pair, spread).astype(np.uint64) << BEFORE_BITS) | np.concatenate(before))
    del word, context, before, rank, at_pair
    entries = np.concatenate([[0], np.cumsum([len(m) for m in times])])
    pair_word = (pair >> CONTEXT_BITS).astype(np.int64)
    triple_pair = (triple >> BEFORE_BITS).astype(np.int64)
    triple_word = pair_word[triple_pair]
    c3 = np.bincount(at, np.concatenate(learned), len(triple))
    c2 = np.bincount(triple_pair, c3, len(pair))
    often = totals.place(unique)
    count = np.where(often >= 0, totals.counts[often], np.bincount(pair_word, c2, len(unique)).astype(np.int64))
    del learned
    # Trie of what was learned: places are those among the known words and pairs.
    known, met, seen = count > 0, c2 > 0, c3 > 0
    place, pair_place = np.cumsum(known) - 1, np.cumsum(met) - 1
    prior = SINGLES * (count + 0.5) / totals.mass
    trie = Trie(unique[known], count[known],
                (place[pair_word[met]].astype(np.uint64) << CONTEXT_BITS) | (pair[met] & CONTEXT_MASK),
                np.log10(PAIRS * c2[met] + prior[pair_word[met]]), np.log10(c2[met] + PAIRS * count[pair_word[met]] + SINGLES),
                (pair_place[triple_pair[seen]].astype(np.uint64) << BEFORE_BITS) | (triple[seen] & np.uint64(0xFFFFFFFF)),
                np.log10(c3[seen] + PAIRS * c2[triple_pair[seen]] + prior[triple_word[seen]]))
    # Every distinct token with what goes before it is looked up once, level by level.
    where, c = trie.count(unique)
    at2 = trie.below(trie.contexts, where[pair_word], CONTEXT_BITS, pair & CONTEXT_MASK)
    at3 = trie.below(trie.befores, at2[triple_pair], BEFORE_BITS, triple & np.uint64(0xFFFFFFFF))
    numerator = trie.value(trie.pairs, at2, np.log10(SINGLES * (c + 0.5) / totals.mass)[pair_word])
    ends = np.where(unique == END, 0.0, np.log10(PAIRS * c + SINGLES))[pair_word]
    ends = np.where(unique[pair_word] == END, 0.0, trie.value(trie.ends, at2, ends))
    value = trie.value(trie.triples, at3, numerator[triple_pair]) - ends[triple_pair]
    base, found = np.log10(c + 0.5), (c > 0).astype(float)
    texts, sums = [], []
    for i, m in enumerate(times):
        keys = at[entries[i]:entries[i + 1]]
        words = triple_word[keys]
        text = np.frombuffer(rows["texts"].iloc[i], np.uint16) & ~HELD_OUT
        each = np.repeat(np.arange(len(m)), m)
        total = [np.bincount(text, x[each]) for x in (value[keys], base[words], found[words])] if len(text) else [np.empty(0)] * 3
        there = np.unique(text)
        texts.append(there.tobytes())
        packed = np.empty(len(there), dtype=SUM)
        for name, x in zip(SUM.names, total):
            packed[name] = x[there] if len(there) else x
        sums.append(packed.tobytes())
    return pd.DataFrame({"block": rows["block"].to_numpy(), "texts": texts, "sums": sums, "about": rows["about"].to_numpy()})


def block_scores(rows: pd.DataFrame, totals: Totals) -> pd.DataFrame:
    """A block's texts from the sums of all shards."""
    about = next(a for a in rows["about"] if a is not None)
    out = pa.ipc.read_record_batch(pa.py_buffer(about), ABOUT).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
    total = np.zeros((len(out), 3))
    for texts, sums in zip(rows["texts"], rows["sums"]):
        part = np.frombuffer(sums, SUM)
        total[np.frombuffer(texts, np.uint16)] += np.stack([part[name] for name in SUM.names], axis=1)
    n = out["n_tokens"].to_numpy(dtype=np.int64)
    return out.assign(
        n_known=np.rint(total[:, 2]).astype(np.int64), train_tokens=totals.tokens,
        base_score=total[:, 1] - n * np.log10(totals.mass), score=total[:, 0] - np.log10((1 + PAIRS) * totals.texts + SINGLES))


ABOUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64())])


def lm_scores(docs: DataFrame) -> DataFrame:
    """Scores of (doc_id, text, held_out), learning from the rows that aren't held out."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // BYTES_PER_SHARD))
    unigrams = docs.where(~F.col("held_out")).select("text").mapInArrow(
        lambda b: unigram_blocks(b, shards), "shard int, words binary, times binary")
    totals = Totals(unigrams.groupBy("shard").applyInPandas(
        unigram_shard, "word bigint, tokens bigint, distinct bigint").collect())
    blocks = docs.mapInArrow(lambda b: token_blocks(b, shards, totals), BLOCK)
    sums = blocks.groupBy("shard").applyInPandas(lambda rows: score_shard(rows, totals), SUMS)
    return sums.groupBy("block").applyInPandas(
        lambda rows: block_scores(rows, totals), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
        "train_tokens bigint, base_score double, score double")


def lm_digest(docs: DataFrame) -> DataFrame:
    """One row per document, as ``op8_ngram_lm`` returns it: held out where crc32 mod 5 is 1."""
    return lm_scores(plain(docs).select("doc_id", "text", (doc_bucket(F.col("doc_id"), 5) == 1).alias("held_out")))
