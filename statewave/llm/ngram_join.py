"""Exact Jaccard self-join of documents by word shingles: similarity 0.75 or more.

Two sets of sizes a and b with that similarity differ in at most H = (a + b) / 7 elements. The
universe of shingles is hashed into segments, as many as the least size of a band of sizes
(bands are powers of two). By the pigeonhole principle two similar sets agree in one of any H + 1
segments of theirs, so each set is indexed under that many of its segments' subsets:

* Segments are allocated by cost. Subsets with more shingles that are not frequent in the corpus
  are rarer, so they come first, then larger ones; the order depends on the subset alone, so the
  first one two sets share is in both their lists.
* A set with too few segments buys one-deletion neighbourhoods: all its segments' subsets and
  each of them without one element, which counts twice in the pigeonhole sum. Where even that
  doesn't suffice, which needs many hash collisions, every single shingle is an index entry.
* A set also appears in the band below its own if a similar smaller set can lie there.

Sets that meet under an entry are candidates. Entries of up to ``SMALL_GROUP`` sets give all
pairs. Larger ones first tie every member to the smallest one, their pivot; entries with one pivot
are one group from then on. Members outside their pivot's component are then compared with all
others of the group that lie in other components, by parity sketches that never exceed the true
difference: in rounds each of them proposes its nearest one, until no round ties any; then all
pairs that the sketches let pass are candidates. Members in their pivot's component, nearly all of a family of
near copies, are only compared with those outside it. The comparisons of one group are dealt over blocks of
``BLOCK`` sets on either side, so they grow with its size times the number of sets that stay apart.

All candidates are verified on the whole sets.

The frequent shingles only steer the order, so the result doesn't depend on which ones were found.

Documents with equal sets are one node throughout, so exact copies cost nothing; a node is named
by a 64-bit hash of its set. Nulls count as empty; documents without words, or without an id, have
no links. Repeated rows are copies of each other. The result has a row for each input row; an
empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewave.llm.components import components
from statewave.llm.hashing import hashed_texts, mix, shingles
from statewave.llm.store import saved
from statewave.llm.text import plain

WIDTH = 5
SMALL_GROUP = 32
BLOCK = 4096
#: A shingle counts as frequent from so many different sets of one batch, and of all, on; the most frequent ones are used.
FREQUENT_IN_BATCH, FREQUENT, MOST_FREQUENT = 4, 8, 1 << 17
ENTRIES_PER_SHARD = 1 << 18
ENTRIES_PER_BLOCK = 1 << 20


def similar(a: int, b: int, common: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


def text_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every text."""
    for row, _, words, counts in hashed_texts(column):
        hashes, windows = shingles(words, counts, WIDTH)
        ends = np.cumsum(windows)
        for i, (a, b) in enumerate(zip(ends - windows, ends)):
            yield row + i, np.unique(hashes[a:b])


def node_of(s: np.ndarray) -> np.int64:
    return mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0]


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each of two to four times as many classes as elements.

    Two sketches differ in no more bits than their sets do in elements. The number of classes is
    a power of two, and a sketch folds to half of it by the exclusive or of its halves.
    """
    classes = 1 << max(9, (2 * len(s) - 1).bit_length())
    bits = np.bincount((mix(s + np.uint64(7)) & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    least = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, least) ^ folded(y, least)).sum())


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, mark) to (doc_id, n, node, sketch, mark)."""
    for batch in batches:
        n, node, bits = [], [], []
        for _, s in text_sets(batch.column(1)):
            n.append(len(s))
            node.append(int(node_of(s)) if len(s) else None)
            bits.append(sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()), batch.column(2)],
            names=["doc_id", "n", "node", "sketch", "mark"])


def frequent_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of many different sets of a batch and their numbers."""
    for batch in batches:
        sets = {int(node_of(s)): s for _, s in text_sets(batch.column(0)) if len(s)}
        token, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets.values()]), return_counts=True)
        often = n >= FREQUENT_IN_BATCH
        yield pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    found = docs.select("text").mapInArrow(frequent_in_batch, "token bigint, n bigint").groupBy("token").agg(
        F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token")
    return np.sort(found.toArrow().column(0).to_numpy().view(np.uint64))


def segments(s: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements by segment, where each segment begins, its number and its size."""
    number = (s >> np.uint64(40)) % np.uint64(count)
    order = np.argsort(number, kind="stable")
    number = number[order]
    start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    return s[order], start, number[start], np.diff(np.r_[start, len(s)])


def band_entries(s: np.ndarray, band: int, often: np.ndarray) -> np.ndarray:
    """Index entries of a set among sets of which the smaller has from 2^band to 2^(band + 1) - 1 elements."""
    n, least = len(s), 1 << band
    # In its own band a set may be the smaller one, with a partner from the next band.
    most = 4 * n // 3 if n < 2 * least else 2 * least - 1
    differ = (n + most) // 7
    elements, start, number, size = segments(s, least)
    at = np.minimum(np.searchsorted(often, elements), max(len(often) - 1, 0))
    rare = np.add.reduceat((often[at] != elements).astype(np.int64), start) if len(often) else size
    place = mix(number + (np.uint64(band) << np.uint64(50)))
    subset = np.add.reduceat(mix(elements), start)
    entry = mix(subset + place)
    if len(start) > differ:
        return entry[np.lexsort((entry, -size, -rare))[:differ + 1]]
    # Deficient: its list is all there is. Similar sets that are deficient too meet below.
    large = size >= 2
    without = (np.repeat(subset + place, size) - mix(elements))[np.repeat(large, size)]
    near = mix(np.concatenate([subset + place, without]) + np.uint64(1))
    alone = mix(elements + np.uint64(band + 2)) if len(start) + large.sum() <= differ else elements[:0]
    return np.unique(np.concatenate([entry, near, alone]))


def entries(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """``often``: frequent shingles, sorted."""
    band = len(s).bit_length() - 1
    out = [band_entries(s, band, often)]
    if band and 3 * len(s) <= 4 * ((1 << band) - 1):
        out.append(band_entries(s, band - 1, often))
    return np.concatenate(out)


class Blocks:
    """Index entries of many sets, dealt into one row per shard: arrays as bytes."""

    SCHEMA = "shard int, entry binary, owner binary, node binary, size binary"

    def __init__(self, shards: int):
        self.shards = shards
        self.clear()

    def clear(self) -> None:
        self.owners: list[tuple[int, int]] = []
        self.lists: list[np.ndarray] = []
        self.held = 0

    def add(self, entry: np.ndarray, node: int, size: int) -> bool:
        """Whether the block is full."""
        self.owners.append((node, size))
        self.lists.append(entry)
        self.held += len(entry)
        return self.held >= ENTRIES_PER_BLOCK

    def flush(self) -> pa.RecordBatch:
        entry = np.concatenate(self.lists)
        owner = np.repeat(np.arange(len(self.lists), dtype=np.uint32), [len(x) for x in self.lists])
        shard = ((entry >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        entry, owner, shard = entry[order], owner[order], shard[order]
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        node, size = (np.array(c, t) for c, t in zip(zip(*self.owners), (np.int64, np.int32)))
        rows: list[tuple] = []
        for k in np.flatnonzero(np.diff(cut)):
            part = slice(cut[k], cut[k + 1])
            used, local = np.unique(owner[part], return_inverse=True)
            local = local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
            rows.append((int(k), *(x.tobytes() for x in (entry[part], local, node[used], size[used]))))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*rows))],
                                          names=["shard", "entry", "owner", "node", "size"])


def index_blocks(batches: Iterator[pa.RecordBatch], shards: int, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(text) to index entries; equal sets of one block are indexed once."""
    blocks, seen = Blocks(shards), set()
    for batch in batches:
        for _, s in text_sets(batch.column(0)):
            if not len(s) or (node := int(node_of(s))) in seen:
                continue
            seen.add(node)
            if blocks.add(entries(s, often), node, len(s)):
                yield blocks.flush()
                seen.clear()
    if blocks.owners:
        yield blocks.flush()


#: What rows of ``meet`` are: other pairs and star pairs of small groups, pivot and member of a large one.
OTHER, STAR, MEMBER = 0, 1, 2
MET = "a bigint, b bigint, kind tinyint"


def meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes that meet under one shard's entries, as (a, b, kind). The pivot is the smallest node of a group."""
    entry, node, size = [], [], []
    for e, o, nd, sz in zip(rows["entry"], rows["owner"], rows["node"], rows["size"]):
        nd = np.frombuffer(nd, np.int64)
        o = np.frombuffer(o, np.uint16 if len(nd) < 1 << 16 else np.uint32)
        entry.append(np.frombuffer(e, np.uint64))
        node.append(nd[o])
        size.append(np.frombuffer(sz, np.int32)[o])
    entry, node, size = np.concatenate(entry), np.concatenate(node), np.concatenate(size)
    order = np.lexsort((node, entry))
    entry, node, size = entry[order], node[order], size[order]
    new = np.r_[True, (entry[1:] != entry[:-1]) | (node[1:] != node[:-1])]  # a node may come from several blocks
    entry, node, size = entry[new], node[new], size[new]
    start = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
    length = np.diff(np.r_[start, len(entry)])
    first = np.repeat(start, length)
    place = np.arange(len(entry)) - first
    group = np.repeat(length, length)
    found = [np.empty((0, 3), np.int64)]
    for gap in range(1, SMALL_GROUP):
        at = np.flatnonzero((group <= SMALL_GROUP) & (place >= gap))
        if not len(at):
            break
        at = at[4 * np.minimum(size[at - gap], size[at]) >= 3 * np.maximum(size[at - gap], size[at])]
        found.append(np.stack([node[at - gap], node[at], np.where(at - gap == first[at], STAR, OTHER)], axis=1))
    at = np.flatnonzero((group > SMALL_GROUP) & (place > 0))
    found.append(np.stack([node[first[at]], node[at], np.full_like(at, MEMBER)], axis=1))
    found = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1], "kind": found[:, 2].astype(np.int8)})


def compare(rows: pd.DataFrame, nearest: bool) -> pd.DataFrame:
    """Pairs of a block of sets outside their pivot's component (``apart``) and a block of others that the sketches let pass.

    ``nearest``: for each of the former only the nearest one.
    """
    sketches = [np.frombuffer(b, np.uint64) for b in rows["sketch"]]
    bits = np.stack([folded(b, min(map(len, sketches))) for b in sketches])
    apart, node, n, root = (rows[c].to_numpy() for c in ("apart", "node", "n", "root"))
    others, found = np.flatnonzero(~apart), [np.empty((0, 2), np.int64)]
    for k in np.flatnonzero(apart):
        ok = others[(root[others] != root[k]) & (4 * np.minimum(n[others], n[k]) >= 3 * np.maximum(n[others], n[k]))]
        distance = np.bitwise_count(bits[ok] ^ bits[k]).sum(axis=1, dtype=np.int64)
        near = 7 * distance <= n[ok] + n[k]
        ok, distance = ok[near], distance[near]
        if nearest and len(ok):
            ok = ok[[int(np.lexsort((node[ok], distance))[0])]]
        found.append(np.stack([np.minimum(node[ok], node[k]), np.maximum(node[ok], node[k])], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def near_by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, sa, sb) to the pairs (a, b) that the sketches don't rule out."""
    for batch in batches:
        most = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        pairs = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
        keep = [7 * sketch_distance(a, b) <= m for (a, b), m in zip(pairs, most)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, its set), where the text has that set."""
    for batch in batches:
        node, elements = [], []
        wanted = batch.column(0).to_pylist()
        for row, s in text_sets(batch.column(1)):
            if len(s) and int(node_of(s)) == wanted[row]:
                node.append(wanted[row])
                elements.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(elements, pa.binary())], names=["node", "elements"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, elements of a, elements of b) to the pairs (u, v) that are similar."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            keep.append(similar(len(x), len(y), int((both[1:] == both[:-1]).sum())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


class Join:
    """The steps over one table of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        own = plain(docs)
        self.docs = own.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows = saved(self.docs.withColumn("mark", text_mark()).mapInArrow(
            describe, "doc_id bigint, n bigint, node bigint, sketch binary, mark string"))
        known = self.rows.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
        self.nodes = saved(known.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
        self.often = frequent_shingles(self.docs)

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that sizes and sketches don't rule out."""
        of = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").where(
            4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(
            near_by_sketch, "a bigint, b bigint")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, elements) of nodes, from the texts."""
        texts = nodes.distinct().join(self.nodes.select("node", "doc_id"), "node").join(self.docs, "doc_id").select("node", "text")
        return saved(texts.mapInArrow(sets_of, "node bigint, elements binary").dropDuplicates(["node"]))

    def similar_pairs(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are similar, as (u, v); the larger node is looked up last."""
        pairs = saved(self.sketched(pairs))
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        of = lambda c: sets.select(F.col("node").alias(c), F.col("elements").alias(f"e{c}"))
        return saved(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ea", "eb").mapInArrow(
            verify, "u bigint, v bigint"))

    def met(self) -> DataFrame:
        """What meets in the index of all sets."""
        total = self.nodes.agg(F.sum("n")).first()[0] or 0
        shards, often = max(1, total // (2 * ENTRIES_PER_SHARD)), self.often
        blocks = self.docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(
            lambda batches: index_blocks(batches, shards, often), Blocks.SCHEMA)
        return saved(blocks.groupBy("shard").applyInPandas(meet, MET))

    def tie(self, tied: DataFrame | None, links: DataFrame) -> DataFrame:
        if tied is not None:
            links = links.union(tied.select(F.col("node").alias("u"), F.col("root").alias("v")))
        return saved(components(links))

    def open_groups(self, members: DataFrame, tied: DataFrame) -> DataFrame:
        """Large groups (pivot, node, root, late) with members outside their pivot's component, which are not ``late``."""
        named = lambda c: tied.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        groups = members.join(named("a"), "a", "left").join(named("b"), "b", "left").select(
            F.col("a").alias("pivot"), F.col("b").alias("node"), F.coalesce("rb", "b").alias("root"),
            (F.coalesce("ra", "a") == F.coalesce("rb", "b")).alias("late"))
        mixed = groups.groupBy("pivot").agg(F.count_if(~F.col("late")).alias("apart"), F.count("*").alias("size")).where("apart > 0")
        return saved(groups.join(mixed, "pivot"))

    def compared(self, groups: DataFrame, nearest: bool) -> DataFrame:
        """Pairs (a, b) of open groups that may be similar and lie in different components."""
        blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        own = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
        rows = groups.join(self.nodes.select("node", "n", "sketch"), "node")
        keep = ["pivot", "i", "j", "node", "root", "n", "sketch"]
        apart = rows.where(~F.col("late")).withColumn("i", own("apart")).withColumn("j", every("size")).select(*keep, F.lit(True).alias("apart"))
        others = rows.withColumn("j", own("size")).withColumn("i", every("apart")).select(*keep, F.lit(False).alias("apart"))
        return saved(apart.union(others).groupBy("pivot", "i", "j").applyInPandas(
            lambda pdf: compare(pdf, nearest), "a bigint, b bigint").distinct())

    def roots(self) -> DataFrame:
        """(node, root) for every node with a link."""
        met = self.met()
        tied = self.tie(None, self.similar_pairs(met.where(F.col("kind") != OTHER).select("a", "b").distinct()))
        members = saved(met.where(F.col("kind") == MEMBER).select("a", "b").distinct())
        while not (groups := self.open_groups(members, tied)).isEmpty():
            pairs = self.compared(groups, True)
            if pairs.isEmpty() or (links := self.similar_pairs(pairs)).isEmpty():
                break
            tied = self.tie(tied, links)
        named = lambda c: tied.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        apart = met.where(F.col("kind") == OTHER).select("a", "b").join(named("a"), "a", "left").join(named("b"), "b", "left").where(
            F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        if not groups.isEmpty():
            apart = apart.union(self.compared(groups, False))
        apart = saved(apart.distinct())
        return tied if apart.isEmpty() else self.tie(tied, self.similar_pairs(apart))

    def node_roots(self) -> DataFrame:
        """(node, root) for every node."""
        return self.nodes.select("node").join(saved(self.roots()), "node", "left").select("node", F.coalesce("root", "node").alias("root"))

    def classes(self) -> DataFrame:
        """A row per input row: doc_id, n_shingles, component_id."""
        ids = saved(self.node_roots().join(self.nodes.select("node", "doc_id"), "node"))
        least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        named = ids.join(least, "root").select("node", "component_id")
        return self.rows.join(named, "node", "left").select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))

    def kept(self) -> DataFrame:
        """(doc_id, mark) of the rows that stay: the smallest of each component, and each one without words."""
        known = self.rows.where(F.col("doc_id").isNotNull())
        first = F.min(F.struct("doc_id", "mark")).alias("first")
        linked = known.join(self.node_roots(), "node").groupBy("root").agg(first).select("first.*")
        return linked.union(known.where(F.col("node").isNull()).select("doc_id", "mark")).distinct()


def text_mark() -> Column:
    """Tells texts of one id apart."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def join_digest(docs: DataFrame) -> DataFrame:
    """One row per document, as ``op3_ngram_join`` returns it."""
    return Join(docs).classes()


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest id, and all without links; own columns.

    An id may have several texts: each counts as a document of its own, and of those that are
    similar the one of the smallest id stays, then of the smallest md5. Of rows that share id and
    text one stays, the first by a hash of all columns. Rows without an id stay.
    """
    kept = Join(docs).kept().select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"))
    own = plain(docs)
    marked = own.withColumn("__mark", text_mark()).withColumn("__doc", F.col("doc_id").cast("bigint"))
    one = Window.partitionBy("__doc", "__mark").orderBy(F.xxhash64(*own.columns))
    rows = marked.join(kept, ["__doc", "__mark"], "left_semi").withColumn("__row", F.row_number().over(one)).where("__row = 1")
    return rows.select(*own.columns).union(own.where(F.col("doc_id").isNull())).toDF(*docs.columns)
