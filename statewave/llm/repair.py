"""Token ids in binary files, compressed by Re-Pair grammars, with random access.

Documents are range-sorted by id and encoded; each task writes its ids in shards of about
``SHARD_TOKENS`` ids, one file each. A shard repeatedly replaces frequent pairs of neighbouring
symbols by new symbols (nonterminals), all non-overlapping pairs of a round at once, more
frequent pairs first, until a round shortens it by less than a 32nd. No symbol reaches over a
document's end, so every document starts at a symbol of its own.

A file holds, little-endian (``HEADER`` first):

* rules: two symbols for each nonterminal, and how many rules each round made;
* the number of ids that each nonterminal expands to;
* document ids with a flag for null, and where each document begins, in symbols and in ids;
* the symbols, in as many bytes each as the largest one needs.

``Shard.tokens`` decodes any range of a document: expansion lengths lead to the symbols that hold
it, and only those are expanded. ``write_ids`` writes files into a folder of any file system that
pyarrow knows; a repeated or speculative task writes the same bytes under the same names and
moves them into place whole. The commit adds ``ids-index.json``, with the number of ids of each
write task, so the place of a shard in the whole is a sum over at most as many numbers as tasks.

Nulls and empty texts have the end id alone. Documents without an id come last; rows of one id
are ordered by a hash of their text, repeated rows are documents of their own. An empty table
gives no files and no rows. Texts of any length are encoded whole; a shard is at least one
document. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from statewave.llm.cut import byte_set, cut_column
from statewave.llm.packing import default_tokenizer
from statewave.llm.store import shared_folder
from statewave.llm.text import plain

END_ID = 2
SHARD_TOKENS = 1 << 20
#: A pair becomes a rule if a round replaces it so often.
LEAST_USES = 8
#: Rounds go on while they shorten a shard by one in so many symbols.
WORTHWHILE = 32
#: Texts are encoded in runs of about so many bytes; words whose ids a task keeps.
RUN_BYTES = 4_000_000
CACHED_WORDS = 1_000_000
WORDS_PER_CALL = 120

MAGIC = b"IDSRPR01"
#: magic, write task, ids of the same task before, documents, ids, symbols, terminals, rules, rounds, bytes a symbol
HEADER = struct.Struct("<8s9Q")
SPACE = byte_set(32, range(9, 14))
#: ASCII marks that the tokenizer parts from letters before them, whatever they are (an apostrophe may begin a unit).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS, STOPS = byte_set(range(65, 91), range(97, 123)), byte_set(44, 46)


class Encoder:
    """Ids of whole batches of texts from the ids of their distinct words.

    The tokenizer splits at white space and drops it, and between an ASCII letter and a full stop
    or comma, so a text's ids are those of the parts between. Each part that is new to the task is
    encoded by the tokenizer, parts of letters only many at a time: each is one unit for it, whose
    last id alone is that of a word end. Letters with ASCII marks after them are two units, the letters and the marks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.terminals = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.terminals, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.empty(0, dtype="<u4")
        self.size = np.empty(0, dtype=np.int64)

    def encoded(self, words: list[str]) -> list[list[int]]:
        return [c.ids for c in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def add(self, words: list[bytes], ids: list[np.ndarray], size: list[np.ndarray]) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.ids = np.concatenate([self.ids, *ids])
        self.size = np.concatenate([self.size, *size])

    def learn(self, words: list[bytes]) -> None:
        """Words none of which is known."""
        letters, alone, parts = [], [], []
        for raw in words:
            word = raw.decode()
            if word.isalpha() and (word.isascii() or word.lower().isalpha()):
                letters.append(word)
                continue
            core = word.rstrip(MARKS)
            if len(core) < len(word) and core.isalpha() and (
                    core.isascii() or unicodedata.normalize("NFC", core.lower()).isalpha()):
                parts.append((raw, core, word[len(core):]))
            else:
                alone.append(word)
        for new, at in ((letters, 1), (alone, 2)):  # letters before the marks, and these
            known = set(new)
            new += [w for w in dict.fromkeys(p[at] for p in parts) if w not in known and w.encode() not in self.place]
        groups = [letters[i:i + WORDS_PER_CALL] for i in range(0, len(letters), WORDS_PER_CALL)]
        ids, size, order = [], [], []
        for group, code in zip(groups, self.encoded([" ".join(g) for g in groups])):
            code = np.array(code, dtype="<u4")
            last = np.flatnonzero(self.ends[code])
            if len(last) == len(group):
                ids.append(code)
                size.append(np.diff(last, prepend=-1))
                order += group
            else:
                alone += group
        if alone:
            codes = self.encoded(alone)
            ids.append(np.array([i for c in codes for i in c], dtype="<u4"))
            size.append(np.array([len(c) for c in codes]))
        self.add([w.encode() for w in order + alone], ids, size)
        if parts:
            at = np.array([[self.place[core.encode()], self.place[rest.encode()]] for _, core, rest in parts])
            self.add([raw for raw, _, _ in parts], [self.gather(at.ravel())], [self.size[at].sum(axis=1)])

    def gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of known words one after the other."""
        first, size = (np.cumsum(self.size) - self.size)[at], self.size[at]
        ends = np.cumsum(size)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids one after the other with an end id each, ids per row) for runs of rows."""
        for row, end, words in cut_column(column, RUN_BYTES, SPACE, lower=False, ends_after=(LETTERS, STOPS)):
            values = words.values.to_pylist()
            at = self.places(values)
            unknown = np.flatnonzero(at < 0)
            if len(self.place) + len(unknown) > CACHED_WORDS and len(unknown) < len(values):
                self.forget()
                unknown = np.arange(len(values))
            if len(unknown):
                new = [values[i] for i in unknown.tolist()]
                self.learn(new)
                at[unknown] = self.places(new)
            at = at[words.code]
            total = np.concatenate([[0], np.cumsum(self.size[at])])[np.concatenate([[0], np.cumsum(words.counts)])]
            yield row, end, np.insert(self.gather(at), total[1:], END_ID), np.diff(total) + 1

    def places(self, words: list[bytes]) -> np.ndarray:
        """Places of words, -1 for those not known."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(path)


def ordered_pairs(symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that begin at ``place`` (first symbol in the upper bits), sorted, and their places.

    Pair and place are sorted as one number where both fit into 64 bits, which is many times faster.
    """
    bits, low = int(symbols.max()).bit_length(), len(symbols).bit_length()
    pair = (symbols[:-1].astype(np.uint64) << np.uint64(bits)) | symbols[1:]
    if 2 * bits + low > 64:
        place = place[np.argsort(pair[place], kind="stable")]
        return pair[place], place
    both = ((pair << np.uint64(low)) | np.arange(len(pair), dtype=np.uint64))[place]
    both.sort()
    return both >> np.uint64(low), (both & np.uint64((1 << low) - 1)).astype(np.int64)


def replaced(symbols: np.ndarray, last: np.ndarray, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: symbols with frequent pairs replaced by ``new`` and up, document ends, the pairs.

    A pair is taken where it is more frequent than the one that overlaps it on the left and at
    least as frequent as the one on the right; equal counts are ordered by the symbols. In a run of
    one symbol every second pair is taken.
    """
    nothing = np.empty((0, 2), dtype=np.uint32)
    if len(symbols) < 2:
        return symbols, last, nothing
    pair, place = ordered_pairs(symbols, np.flatnonzero(~last[:-1]))
    new_pair = np.flatnonzero(np.concatenate([[len(pair) > 0], pair[1:] != pair[:-1]])[:len(pair)])
    count = np.diff(np.concatenate([new_pair, [len(pair)]]))
    often = np.flatnonzero(count >= LEAST_USES)
    often = often[np.argsort(-count[often], kind="stable")]
    none = len(often)
    rank_of = np.full(len(new_pair), none, dtype=np.int32)
    rank_of[often] = np.arange(none, dtype=np.int32)
    rank = np.full(len(symbols) + 1, none, dtype=np.int32)
    rank[1 + place] = np.repeat(rank_of, count)
    first = rank[1:-1] < rank[:-2]
    again = np.flatnonzero((rank[1:-1] == rank[:-2]) & (rank[1:-1] < none))
    if len(again):  # a symbol repeated many times: every second place of the run
        start = np.arange(len(first))
        start[again] = 0
        start = np.maximum.accumulate(start)
        first[again] = first[start[again]] & ((again - start[again]) % 2 == 0)
    taken = np.flatnonzero(first & (rank[1:-1] <= rank[2:]))
    chosen = rank[1 + taken]
    kept = np.flatnonzero(np.bincount(chosen, minlength=none) >= LEAST_USES)
    number = np.zeros(none, dtype=np.uint32)
    number[kept] = new + np.arange(len(kept), dtype=np.uint32)
    to = number[chosen]
    taken, to = taken[to > 0], to[to > 0]
    out, stay, ends = symbols.copy(), np.ones(len(symbols), dtype=bool), last.copy()
    out[taken] = to
    stay[taken + 1] = False
    ends[taken] = last[taken + 1]
    pair = pair[new_pair[often[kept]]]
    bits = np.uint64(int(symbols.max()).bit_length())
    return out[stay], ends[stay], np.stack([pair >> bits, pair & ((np.uint64(1) << bits) - np.uint64(1))], axis=1).astype(np.uint32)


def compress(ids: np.ndarray, counts: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Symbols, symbols per document, rules and rules per round of documents' ids."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(counts) - 1] = True
    rules, rounds = [np.empty((0, 2), dtype=np.uint32)], []
    while True:
        before = len(symbols)
        symbols, last, new = replaced(symbols, last, terminals + sum(rounds))
        if len(new):
            rules.append(new)
            rounds.append(len(new))
        if (before - len(symbols)) * WORTHWHILE < before:
            break
    return symbols, np.diff(np.flatnonzero(last), prepend=-1), np.concatenate(rules), rounds


def lengths_of(rules: np.ndarray, rounds: list[int], terminals: int) -> np.ndarray:
    """Number of ids that each symbol expands to, terminals first."""
    length = np.ones(terminals + len(rules), dtype=np.int64)
    done = 0
    for n in rounds:
        length[terminals + done:terminals + done + n] = length[rules[done:done + n]].sum(axis=1)
        done += n
    return length


class Shard:
    """The contents of one file."""

    def __init__(self, data: bytes):
        magic, self.task, self.before, docs, self.ids, n, self.terminals, rules, rounds, width = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("This is no shard of token ids.")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += part.nbytes
            return part

        self.rounds = take("<u8", rounds).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.length = np.concatenate([np.ones(self.terminals, dtype=np.int64), take("<u4", rules)])
        self.doc_id, self.known = take("<i8", docs), take("u1", docs).astype(bool)
        self.first_symbol = np.concatenate([take("<u8", docs), [n]]).astype(np.int64)
        self.first_id = np.concatenate([take("<u8", docs), [self.ids]]).astype(np.int64)
        packed = np.zeros((n, 4), dtype=np.uint8)
        packed[:, :width] = take("u1", n * width).reshape(n, width)
        self.symbols = packed.view("<u4").ravel()

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols: the rules of the last round first."""
        top = self.terminals + len(self.rules)
        for n in self.rounds[::-1].tolist():
            top -= n
            deep = symbols >= top
            if deep.any():
                rule = self.rules[symbols[deep] - self.terminals]
                out = np.repeat(symbols, 1 + deep)
                at = (np.cumsum(1 + deep) - 2)[deep]
                out[at], out[at + 1] = rule[:, 0], rule[:, 1]
                symbols = out
        return symbols

    def tokens(self, document: int, start: int = 0, count: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of a document (to its end, by default)."""
        symbols = self.symbols[self.first_symbol[document]:self.first_symbol[document + 1]]
        ends = np.cumsum(self.length[symbols])
        stop = int(ends[-1]) if count is None else min(start + count, int(ends[-1]))
        if start >= stop:
            return symbols[:0]
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop)
        skipped = int(ends[a - 1]) if a else 0
        return self.expanded(symbols[a:b + 1])[start - skipped:stop - skipped]


def shard_bytes(task: int, before: int, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, terminals: int) -> bytes:
    symbols, sizes, rules, rounds = compress(ids, counts, terminals)
    width = max(1, (int(symbols.max()).bit_length() + 7) // 8)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    first = lambda n: (np.cumsum(n) - n).astype("<u8").tobytes()
    return b"".join([
        HEADER.pack(MAGIC, task, before, len(doc_ids), len(ids), len(symbols), terminals, len(rules), len(rounds), width),
        np.array(rounds, dtype="<u8").tobytes(), rules.astype("<u4").tobytes(),
        lengths_of(rules, rounds, terminals)[terminals:].astype("<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), known.tobytes(), first(sizes), first(counts),
        symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as path or address."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class IdsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.tokenizer, self.shard = options["path"], options["tokenizer"], int(options["shardtokens"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task, encode = TaskContext.get().partitionId(), encoder(self.tokenizer)
        store, folder = opened(self.folder)
        docs, parts, counts, held, before, files = [], [], [], 0, 0, 0

        def flush() -> None:
            nonlocal docs, parts, counts, held, before, files
            data = shard_bytes(task, before, docs, np.concatenate(parts), np.concatenate(counts), encode.terminals)
            name = f"{folder}/ids-{task:06d}-{files:06d}"
            part = f"{name}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write(data)
            store.move(part, f"{name}.rp")
            before, files = before + held, files + 1
            docs, parts, counts, held = [], [], [], 0

        for batch in iterator:
            doc_ids = batch.column(0).to_pylist()
            for row, end, ids, n in encode.encode(batch.column(1)):
                while row < end:  # as many of these rows as the shard still takes, one at least
                    k = min(max(1, int(np.searchsorted(np.cumsum(n), self.shard - held, side="right"))), end - row)
                    cut = int(n[:k].sum())
                    docs += doc_ids[row:row + k]
                    parts.append(ids[:cut])
                    counts.append(n[:k])
                    held += cut
                    row, ids, n = row + k, ids[cut:], n[k:]
                    if held >= self.shard or row < end:
                        flush()
        if docs:
            flush()
        return Written(task, before, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = opened(self.folder)
        tasks = {m.task: [m.ids, m.files] for m in messages if m is not None}
        with store.open_output_stream(f"{folder}/ids-index.json") as out:
            out.write(json.dumps(sorted([t, *v] for t, v in tasks.items())).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files without an index are not read."""


class Written(WriterCommitMessage):
    def __init__(self, task: int, ids: int, files: int):
        self.task, self.ids, self.files = task, ids, files


class IdsSource(DataSource):
    """``df.write.format("token_ids")``: rows (doc_id, text) in order of partitions and rows."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id bigint, text string"

    def writer(self, schema: StructType, overwrite: bool) -> IdsWriter:
        return IdsWriter(dict(self.options))


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes all documents' ids into a new folder, in ascending order of their ids.

    The range sort also deals rows of one id by their texts and, where those are equal, by where
    they lie in the table, so a hot id spreads over tasks. ``spark.sql.shuffle.partitions`` says
    how many tasks write.
    """
    rows = plain(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("at")]
    rows = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    docs.sparkSession.dataSource.register(IdsSource)
    rows.select("doc_id", "text").write.format("token_ids").mode("append").options(
        tokenizer=tokenizer_path or default_tokenizer(), shardTokens=str(shard_tokens)).save(folder)


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files to (task, doc_id, place within the task's ids, n_tokens, ids_crc32), every id decoded."""
    for batch in batches:
        for data in batch.column(0):
            shard = Shard(data.as_py())
            ids = shard.expanded(shard.symbols).astype("<u4")
            first = shard.first_id
            crc = [zlib.crc32(ids[a:b].data) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(crc), shard.task, dtype=np.int64)), pa.array(shard.doc_id, mask=~shard.known),
                 pa.array(shard.before + first[:-1]), pa.array(np.diff(first)), pa.array(crc, pa.int64())],
                names=["task", "doc_id", "place", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(task, task_start): ids before each write task's; one row per task."""
    store, path = opened(folder)
    with store.open_input_stream(f"{path}/ids-index.json") as data:
        tasks = json.loads(data.read())
    starts, total = [], 0
    for task, ids, _ in tasks:
        starts.append((task, total))
        total += ids
    return spark.createDataFrame(starts, "task bigint, task_start bigint")


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a folder of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rp").load(folder).select("content")
    rows = files.mapInArrow(decoded, "task bigint, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(read_index(spark, folder), "task").select(
        "doc_id", (F.col("task_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def ids_digest(docs: DataFrame) -> DataFrame:
    """Documents written and read back, one row each, as ``op13_token_files`` returns it."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder)
    return read_digest(spark, folder)
