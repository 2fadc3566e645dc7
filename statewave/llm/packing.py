"""Packing tokenised documents into sequences of bounded length by the sum-of-squares rule.

A document's token ids end with one separator id. Documents longer than a sequence are cut into
full pieces and a rest; all others stay whole. Every piece is placed where the sum over all gaps
of the squared number of open sequences with that gap becomes smallest, longest pieces first, and
a new sequence is opened only where no open one has room.

Pieces are grouped by a hash of document and piece number, about ``PIECES_PER_GROUP`` to a
group, and each group is packed on its own. A group leaves a few part-filled sequences behind,
less than a thousandth of what it packs.

A null or empty text has only the separator and is one piece. Repeated rows are packed as
separate documents. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.llm.store import saved
from statewave.llm.text import plain

CAPACITY = 2048
SEPARATOR = 0
PIECES_PER_GROUP = 50_000
#: Words whose ids a task keeps; beyond it, it starts anew.
CACHED_WORDS = 1_000_000
WORDS_PER_CALL = 120
RUN_CHARS = 500_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


def default_tokenizer() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


class CachedEncoder:
    """Ids of texts from the ids of their words.

    The tokenizer splits at white space and drops it, so a text's ids are those of its words one
    after the other; it also splits between letters and what follows them (where lower case and NFC leave letters). Ids of all known words
    lie in one array; a text is a gather from it. New words of letters only go to the tokenizer
    many at a time: each is one unit for it, whose last id alone is that of a word end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, dtype="<u4")
        self.used = 0
        self.first = np.empty(1 << 14, dtype=np.int64)
        self.size = np.empty(1 << 14, dtype=np.int64)

    def add(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        k = len(self.place)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while k + len(words) > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        self.ids[self.used:self.used + len(ids)] = ids
        self.first[k:k + len(words)] = self.used + np.cumsum(size) - size
        self.size[k:k + len(words)] = size
        self.used += len(ids)
        self.place.update(zip(words, range(k, k + len(words))))

    def one_by_one(self, words: list[str]) -> None:
        if words:
            codes = [c.ids for c in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            self.add([w.encode() for w in words], np.array([i for c in codes for i in c], dtype="<u4"), np.array([len(c) for c in codes]))

    def in_groups(self, words: list[str]) -> None:
        groups = [words[i:i + WORDS_PER_CALL] for i in range(0, len(words), WORDS_PER_CALL)]
        good: list[bytes] = []
        codes, sizes, odd = [], [], []
        for group, code in zip(groups, self.tokenizer.encode_batch_fast(
                [" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(code.ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(group):
                good += [w.encode() for w in group]
                codes.append(ids)
                sizes.append(np.diff(last, prepend=-1))
            else:
                odd += group
        if good:
            self.add(good, np.concatenate(codes), np.concatenate(sizes))
        self.one_by_one(odd)

    def learn(self, words: list[bytes]) -> None:
        """Words none of which is known."""
        letters, mixed, parts = [], [], []
        for raw in words:
            word = raw.decode()
            if word.isalpha():
                letters.append(word)
                continue
            core = word.rstrip(".,")
            if len(core) < len(word) and core.isalpha() and (core.isascii() or unicodedata.normalize("NFC", core.lower()).isalpha()):
                parts.append((raw, core.encode(), raw[len(core.encode()):]))
            else:
                mixed.append(word)
        new = set(letters)
        letters += [c for c in dict.fromkeys(core.decode() for _, core, _ in parts)
                    if c not in new and c.encode() not in self.place]
        new = set(mixed)
        mixed += [r for r in dict.fromkeys(rest.decode() for _, _, rest in parts)
                  if r not in new and r.encode() not in self.place]
        self.in_groups(letters)
        self.one_by_one(mixed)
        if parts:
            at = np.array([[self.place[core], self.place[rest]] for _, core, rest in parts])
            size = self.size[at]
            self.add([raw for raw, _, _ in parts], self.gather(at.ravel()), size.sum(axis=1))

    def gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of known words one after the other."""
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.first[at] - (ends - size), size)]

    def places(self, words: list[bytes]) -> np.ndarray:
        """Places of words, -1 for those not known."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lists = [text.encode().split() for text in texts]  # bytes split at ASCII white space only
        words = list(chain.from_iterable(lists))
        at = self.places(words)
        new = np.flatnonzero(at < 0)
        if len(new):
            unknown = list(dict.fromkeys(map(words.__getitem__, new.tolist())))
            if len(self.place) + len(unknown) > CACHED_WORDS and self.place:
                self.clear()
                unknown, new = list(dict.fromkeys(words)), np.arange(len(words))
            self.learn(unknown)
            at[new] = self.places([words[i] for i in new.tolist()])
        ends = np.cumsum([0, *map(len, lists)])
        sizes = np.concatenate([[0], np.cumsum(self.size[at])])[ends]
        return np.split(self.gather(at), sizes[1:-1])


@cache
def encoder(path: str) -> CachedEncoder:
    """One for each Python worker, kept from task to task."""
    return CachedEncoder(path)


def runs(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of some rows at a time, about ``RUN_CHARS`` characters."""
    docs, texts, held = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        docs.append(doc)
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held >= RUN_CHARS:
            yield docs, texts
            docs, texts, held = [], [], 0
    if docs:
        yield docs, texts


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches (doc_id, text) to pieces."""
    encode = encoder(path).encode
    end = np.array([SEPARATOR], dtype="<u4")
    for batch in batches:
        rows = []
        for docs, texts in runs(batch):
            for doc, ids in zip(docs, encode(texts)):
                ids = np.concatenate([ids, end])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
        if rows:
            columns = list(zip(*rows))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; the ids themselves are given by their crc32."""
    rows = plain(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: piece_batches(batches, tokenizer_path, capacity), PIECES)


def place_all(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, in the given order, and the number of sequences.

    ``open_at[g]`` holds the open sequences with gap g and ``count[g]`` their number. Putting a
    piece of length s into gap g lowers count[g] by one and raises count[g - s] by one, so the sum
    of squares changes by 2 * (count[g - s] - count[g]) + 2; a gap of zero isn't open.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        here = count[s:]
        fits = np.flatnonzero(here)
        if len(fits):
            after = count[fits]
            change = np.where(fits == 0, -2 * here[fits] + 1, 2 * (after - here[fits]) + 2)
            gap = int(fits[np.argmin(change)]) + s  # ties: the smallest gap
            k = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, k = capacity, used
            used += 1
        sequence[i], offset[i] = k, capacity - gap
        rest = gap - s
        if rest:
            open_at[rest].append(k)
            count[rest] += 1
    return sequence, offset, used


def pack_group(pieces: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """One group's pieces with their sequences, numbered from the group's number upwards."""
    pieces = pieces.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
    sequence, offset, _ = place_all(pieces["length"].to_numpy(), capacity)
    group = int(pieces["__group"].iloc[0])
    return pieces.drop(columns="__group").assign(sequence_id=sequence + (group << 32), offset=offset)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``."""
    pieces = saved(cut_pieces(docs, tokenizer_path or default_tokenizer(), capacity))
    groups = max(1, -(-pieces.count() // PIECES_PER_GROUP))
    return pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups))).groupBy(
        "__group").applyInPandas(lambda rows: pack_group(rows, capacity), PACKED)
