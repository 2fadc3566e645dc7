"""Shallow decision trees and per-state thresholds that explain a labelling.

A tree grows level by level for all recordings and methods at once. Each level packs the values
of a node's feature, sorted and with their classes, into an array for each batch of rows; the arrays
of a feature meet in one task, or in one for each bucket of values if the node is large, where its
candidate thresholds and the classes left of them are read off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statewave.config import ExplainConfig
from statewave.functions.splits import bucket_part, join_parts, left_counts, run_starts
from statewave.operators import quantiles
from statewave.operators.blocks import REC
from statewave.session import cut_lineage, maybe_broadcast

NODE = [REC, "method", "path"]
#: Most rows of a node whose values of a feature meet in one task.
GROUP_ROWS = 1 << 20
#: Most buckets that the values of a larger node's feature are dealt to.
BUCKETS = 256
NODE_BYTES = 256


@dataclass
class Explanation:
    nodes: DataFrame  # pre-ordered tree nodes
    importance: DataFrame  # recording_id, method, feature, importance
    thresholds: DataFrame  # recording_id, method, cluster, feature, direction, ...
    predictions: DataFrame  # recording_id, method, window_index, label, predicted
    fidelity: DataFrame  # recording_id, method, fidelity
    rules: DataFrame  # recording_id, method, rules_text


def _gini(counts: list[Column], total: Column) -> Column:
    shares = sum(((c / total) * (c / total) for c in counts), F.lit(0.0))
    return F.when(total > 0, F.lit(1.0) - shares).otherwise(F.lit(0.0))


def _class_counts(k: int) -> list[Column]:
    return [F.sum((F.col("label") == c).cast("bigint")).alias(f"c{c}") for c in range(k)]


def _packer(cuts: dict[tuple, list[np.ndarray]], k: int) -> Callable:
    """Arrow batches of rows to sorted values with classes, one array for each node, feature and bucket."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for name in NODE:
                c = batch.column(name).dictionary_encode()
                code = code * len(c.dictionary) + c.indices.to_numpy()
            _, first, node = np.unique(code, return_index=True, return_inverse=True)
            names = [batch.column(c).take(pa.array(first)) for c in NODE]
            large = {i: cuts[key] for i, key in enumerate(zip(*[c.to_pylist() for c in names])) if key in cuts} if cuts else {}
            label = pc.fill_null(batch.column("label"), k).to_numpy(zero_copy_only=False)
            label = np.where((label < 0) | (label > k), k, label).astype(np.int32)
            cells = batch.column("x").flatten()
            x = cells.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, -1)
            there = cells.is_valid().to_numpy(zero_copy_only=False).reshape(x.shape) if cells.null_count else None
            for f in range(x.shape[1]):
                rows = slice(None) if there is None else np.flatnonzero(there[:, f])
                v, at, l = x[rows, f] + 0.0, node[rows], label[rows]  # -0.0 becomes 0.0
                order = np.lexsort((l, v, at))
                v, at, l = v[order], at[order], l[order]
                start = run_starts(at, v, l)
                weight = np.diff(np.append(start, len(v))).astype(np.int32)
                v, at, l = v[start], at[start], l[start]
                bucket = np.full(len(v), -1, dtype=np.int32)
                for i, by in large.items():
                    own = slice(*np.searchsorted(at, [i, i + 1]))
                    bucket[own] = np.searchsorted(by[f], v[own], side="left")
                group = run_starts(at, bucket)
                ends = pa.array(np.append(group, len(v)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(at[group])) for c in names], pa.array(np.full(len(group), f, dtype=np.int32)),
                     pa.array(bucket[group]), *[pa.ListArray.from_arrays(ends, pa.array(c)) for c in (v, l, weight)]],
                    names=[*NODE, "f", "bucket", "v", "label", "weight"])

    return pack


def _unpacked(table: pa.Table) -> list[np.ndarray]:
    return [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("v", "label", "weight")]


def _answer(key: tuple, thresholds: np.ndarray, left: np.ndarray) -> pa.Table:
    columns = {c: pa.array([v.as_py()] * len(thresholds), v.type) for c, v in zip([*NODE, "f"], key)}
    columns |= {"threshold": pa.array(thresholds)} | {f"l{c}": pa.array(left[:, c]) for c in range(left.shape[1])}
    return pa.table(columns)


def _large_cuts(rows: DataFrame) -> dict[tuple, list[np.ndarray]]:
    """Rough quantiles of every feature of each node that is too large for one task.

    They decide where a value is dealt to, not what is found, and one stands for ``GROUP_ROWS / 2`` rows or more.
    """
    sizes = rows.groupBy(*NODE).count().filter(F.col("count") > GROUP_ROWS)
    n = sizes.count()
    if not n:
        return {}
    width = rows.select(F.size("x")).first()[0]
    probs = [i / BUCKETS for i in range(1, BUCKETS)]
    found = rows.join(maybe_broadcast(sizes, n, NODE_BYTES), NODE).groupBy(*NODE, "count").agg(
        *[F.percentile_approx(F.col("x")[i], probs, 1000).alias(f"q{i}") for i in range(width)])
    cuts = {}
    for r in found.toLocalIterator():
        step = max(1, int(BUCKETS * GROUP_ROWS // (2 * r["count"])))
        each = [np.unique(np.array(r[f"q{i}"] or [], dtype=float)[step - 1::step]) for i in range(width)]
        cuts[tuple(r[c] for c in NODE)] = [q[~np.isnan(q)] for q in each]
    return cuts


def _large_counts(packed: DataFrame, kinds: str, found: str, k: int, limit: int) -> DataFrame:
    """``binned_counts`` of nodes whose values are dealt to buckets."""
    keys = [*NODE, "f", "bucket"]
    every = W.partitionBy(*NODE, "f")  # at most BUCKETS rows
    before = every.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ranks = packed.groupBy(*keys).agg(
        F.sum(F.aggregate("weight", F.lit(0).cast("bigint"), lambda s, w: s + w)).alias("n")).select(
        *[F.col(c).alias(f"of_{c}") for c in keys], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(every).alias("total"))

    def part(key: tuple, mine: pa.Table, rank: pa.Table) -> pa.Table:
        total = rank.column("total")[0].as_py()
        got = bucket_part(*_unpacked(mine), k, limit, rank.column("offset")[0].as_py(), total)
        return pa.table({c: pa.array([v.as_py()], v.type) for c, v in zip(keys, key)}
                        | {"total": pa.array([total]), "distinct": pa.array([got["distinct"]])}
                        | {c: pa.array([got[c]], pa.list_(kind)) for c, kind in (
                            ("ranks", pa.int64()), ("found", pa.float64()), ("kept", pa.float64()),
                            ("lefts", pa.int64()), ("classes", pa.int64()))})

    def close(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        arrays = {c: [v.values.to_numpy() for v in table.column(c)]
                  for c in ("ranks", "found", "kept", "lefts", "classes")}
        parts = [dict(zip(arrays, p)) | {"distinct": d.as_py()}
                 for d, *p in zip(table.column("distinct"), *arrays.values())]
        return _answer(key, *join_parts(parts, k, limit, table.column("total")[0].as_py()))

    parts = packed.groupBy(*keys).cogroup(ranks.groupBy(*[f"of_{c}" for c in keys])).applyInArrow(
        part, f"{kinds}, bucket int, total bigint, distinct bigint, ranks array<bigint>, found array<double>, "
              "kept array<double>, lefts array<bigint>, classes array<bigint>")
    return parts.groupBy(*NODE, "f").applyInArrow(close, found)


def binned_counts(rows: DataFrame, k: int, limit: int, max_rows: int) -> DataFrame:
    """Class counts left of every candidate: ``NODE, f, threshold, l0 .. l{k-1}``.

    ``rows`` has ``NODE, window_index, label, x``; ``f`` is the feature's position in ``x``. Up to ``limit``
    distinct values give the midpoints between neighbours, more give the distinct quantiles from 5 % to 95 %.
    ``max_rows`` is the counted size of the largest group. Values that are null lie right of every candidate.
    """
    rows = rows.dropna(subset=NODE)
    cuts = _large_cuts(rows) if max_rows > GROUP_ROWS else {}
    weighted = max_rows <= quantiles.BUFFER_ROWS
    types = dict(rows.dtypes)
    kinds = ", ".join(f"{c} {types[c]}" for c in NODE) + ", f int"
    found = f"{kinds}, threshold double, " + ", ".join(f"l{c} bigint" for c in range(k))
    packed = rows.select(*NODE, "label", "x").mapInArrow(
        _packer(cuts, k), f"{kinds}, bucket int, v array<double>, label array<int>, weight array<int>")

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        return _answer(key, *left_counts(*_unpacked(table), k, limit, weighted))

    packed = cut_lineage(packed) if cuts else packed  # read three times
    out = packed.filter("bucket < 0").groupBy(*NODE, "f").applyInArrow(whole, found)
    return out if not cuts else out.unionByName(
        _large_counts(packed.filter("bucket >= 0"), kinds, found, k, limit))


def node_counts(rows: DataFrame, k: int) -> DataFrame:
    return rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), *_class_counts(k))


def best_splits(candidates: DataFrame, nodes: DataFrame, k: int, min_leaf: int) -> DataFrame:
    """Admissible split with the highest gain per node; ties go to the first feature, then
    the lowest threshold."""
    left = [F.col(f"l{c}") for c in range(k)]
    right = [F.col(f"c{c}") - F.col(f"l{c}") for c in range(k)]
    n_left = sum(left[1:], left[0])
    n_right = F.col("n") - n_left
    weighted = (n_left * _gini(left, n_left) + n_right * _gini(right, n_right)) / F.col("n")
    priced = (
        candidates.join(nodes, NODE)
        .filter((n_left >= min_leaf) & (n_right >= min_leaf))
        .withColumn("gain", _gini([F.col(f"c{c}") for c in range(k)], F.col("n")) - weighted)
    )
    best = F.max_by(F.struct("f", "threshold", "gain"),
                    F.struct("gain", -F.col("f"), -F.col("threshold")))
    return priced.groupBy(*NODE).agg(best.alias("b")).select(*NODE, "b.*")


def f1_thresholds(candidates: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Best one-feature rule per cluster: ``REC, method, cluster, f, direction, threshold, score``.

    Both directions of every candidate are scored; the first best in the order threshold,
    then ``<=`` before ``>`` wins.
    """
    joined = candidates.join(totals, NODE)
    n_left = sum([F.col(f"l{c}") for c in range(1, k)], F.col("l0"))
    per_cluster = joined.select(
        REC, "method", "f", "threshold", "n", n_left.alias("n_left"),
        F.posexplode(F.array(*[F.struct(F.col(f"l{c}").alias("tp"), F.col(f"c{c}").alias("all"))
                               for c in range(k)])).alias("cluster", "hit"))
    rules = per_cluster.select(
        REC, "method", "f", "threshold", "cluster", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.lit("<=").alias("direction"),
                     F.col("hit.tp").alias("tp"), F.col("n_left").alias("picked"),
                     F.col("hit.all").alias("all")),
            F.struct(F.lit(1).alias("side"), F.lit(">").alias("direction"),
                     (F.col("hit.all") - F.col("hit.tp")).alias("tp"),
                     (F.col("n") - F.col("n_left")).alias("picked"),
                     F.col("hit.all").alias("all")))).alias("r")
    ).select(REC, "method", "f", "threshold", "cluster", "r.*")
    precision = F.col("tp") / F.greatest(F.col("picked"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("all"), F.lit(1))
    score = F.when(precision + recall == 0, F.lit(0.0)).otherwise(
        2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-300)))
    best = F.max_by(F.struct("direction", "threshold", "score"),
                    F.struct("score", -F.col("threshold"), -F.col("side")))
    return rules.withColumn("score", score).groupBy(REC, "method", "cluster", "f").agg(
        best.alias("b")).select(REC, "method", "cluster", "f", "b.*")


def _scaler_long(scaler: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.lit(c).alias("feature"),
                               F.col(f"center_{c}").alias("center"),
                               F.col(f"scale_{c}").alias("scale"))
                      for i, c in enumerate(columns)])
    return scaler.select(REC, F.explode(cells).alias("s")).select(REC, "s.*")


def rules_text(nodes: pd.DataFrame) -> str:
    """Indented rules from pre-ordered nodes of one tree."""
    by_path = {r.path: r for r in nodes.itertuples()}
    lines: list[str] = []

    def write(path: str, indent: str) -> None:
        node = by_path[path]
        if node.feature is None or pd.isna(node.feature):
            counts = ", ".join(f"S{i}={c}" for i, c in enumerate(node.class_counts))
            lines.append(f"{indent}Leaf -> state {node.predicted_class} ({counts})")
            return
        lines.append(f"{indent}if {node.feature} <= {node.threshold_raw:.4f}")
        write(path + "L", indent + "  ")
        lines.append(f"{indent}else")
        write(path + "R", indent + "  ")

    write("", "")
    return "\n".join(lines)


def explain(raw: DataFrame, scaled: DataFrame, scaler: DataFrame, columns: list[str],
            labels: DataFrame, k: int, config: ExplainConfig | None = None) -> Explanation:
    """Explain ``labels`` (``recording_id, window_index, method, label``, 0 <= label < k)."""
    cfg = config or ExplainConfig()
    rows = cut_lineage(
        labels.select(REC, "window_index", "method", "label")
        .join(scaled.select(REC, "window_index", F.array(*columns).alias("x")),
              [REC, "window_index"])
        .withColumn("path", F.lit("")))
    max_rows = rows.groupBy(REC, "method").count().agg(F.max("count")).first()[0] or 0
    root = None
    all_nodes, all_splits = [], []
    for depth in range(cfg.max_depth + 1):
        # a row stays where its tree stopped growing; only the deepest paths may split
        frontier = rows.filter(F.length("path") == depth)
        nodes = cut_lineage(node_counts(frontier, k))
        n_nodes = nodes.count()
        all_nodes.append(nodes)
        if depth == cfg.max_depth and depth > 0:
            break
        kinds = sum([(F.col(f"c{c}") > 0).cast("int") for c in range(1, k)],
                    (F.col("c0") > 0).cast("int"))
        open_nodes = nodes.filter((F.col("n") >= 2 * cfg.min_samples_leaf) & (kinds > 1))
        if depth == 0:
            root = cut_lineage(binned_counts(frontier, k, cfg.threshold_candidates, max_rows))
            candidates = root
            if cfg.max_depth == 0:
                break
        else:
            live = frontier.join(maybe_broadcast(open_nodes.select(*NODE), n_nodes, NODE_BYTES), NODE, "left_semi")
            candidates = binned_counts(live, k, cfg.threshold_candidates, max_rows)
        splits = cut_lineage(
            best_splits(candidates, open_nodes, k, cfg.min_samples_leaf).filter("gain > 0"))
        all_splits.append(splits)
        if splits.isEmpty():
            break
        side = F.when(F.expr("x[f] <= threshold"), "L").otherwise("R")
        rows = cut_lineage(
            rows.join(maybe_broadcast(splits.select(*NODE, "f", "threshold"), n_nodes, NODE_BYTES), NODE, "left")
            .withColumn("path", F.when(F.col("f").isNotNull(), F.concat("path", side))
                        .otherwise(F.col("path")))
            .select(REC, "window_index", "method", "label", "x", "path"))
    return _assemble(raw, scaler, columns, rows, all_nodes, all_splits, root, k)


def _assemble(raw, scaler, columns, rows, all_nodes, all_splits, root, k: int) -> Explanation:
    scale = _scaler_long(scaler, columns)
    nodes = all_nodes[0]
    for more in all_nodes[1:]:
        nodes = nodes.unionByName(more)
    empty = "f int, threshold double, gain double"
    splits = all_splits[0] if all_splits else nodes.select(*NODE).limit(0).selectExpr(
        *NODE, *[f"cast(null as {c.split()[1]}) {c.split()[0]}" for c in empty.split(", ")])
    for more in all_splits[1:]:
        splits = splits.unionByName(more)
    counts = [F.col(f"c{c}") for c in range(k)]
    order = W.partitionBy(REC, "method").orderBy("path")  # at most 2^(depth + 1) - 1 rows
    tree = cut_lineage(
        nodes.join(splits, NODE, "left").join(scale, [REC, "f"], "left")
        .select(
            REC, "method", "path",
            (F.row_number().over(order) - 1).alias("node_id"),
            F.length("path").alias("depth"),
            (F.array_position(F.array(*counts), F.greatest(*counts) if k > 1 else counts[0]) - 1)
            .cast("int").alias("predicted_class"),
            F.col("n").alias("n_samples"),
            _gini(counts, F.col("n")).alias("impurity"), "feature",
            F.col("threshold").alias("threshold_scaled"),
            (F.col("threshold") * F.col("scale") + F.col("center")).alias("threshold_raw"),
            F.array(*counts).alias("class_counts"), "gain"))
    totals = tree.filter("path = ''").select(REC, "method", F.col("n_samples").alias("all_rows"))
    gains = tree.filter("feature is not null").join(totals, [REC, "method"]).groupBy(
        REC, "method", "feature").agg(
        F.sum(F.col("gain") * F.col("n_samples") / F.col("all_rows")).alias("g"))
    every = totals.select(REC, "method").join(scale.select(REC, "f", "feature"), REC)
    raw_gain = F.coalesce("g", F.lit(0.0))
    total_gain = F.sum(raw_gain).over(W.partitionBy(REC, "method"))
    importance = every.join(gains, [REC, "method", "feature"], "left").select(
        REC, "method", "f", "feature",
        F.when(total_gain > 0, raw_gain / total_gain).otherwise(F.lit(0.0)).alias("importance"))
    predictions = rows.join(tree.select(*NODE, F.col("predicted_class").alias("predicted")),
                            NODE).select(REC, "method", "window_index", "label", "predicted")
    fidelity = predictions.groupBy(REC, "method").agg(
        F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("fidelity"))
    best = f1_thresholds(root, node_counts(rows.withColumn("path", F.lit("")), k), k)
    means = raw.groupBy(REC).agg(*[F.avg(c).alias(c) for c in columns])
    mean_long = means.select(REC, F.posexplode(F.array(*columns)).alias("f", "feature_mean_raw"))
    clusters = rows.groupBy(REC, "method").agg(F.max("label").alias("top"))
    grid = clusters.select(REC, "method", F.explode(F.sequence(F.lit(0), F.col("top")))
                           .alias("cluster")).join(scale, REC).join(mean_long, [REC, "f"])
    threshold = F.coalesce("threshold", F.lit(0.0))
    thresholds = grid.join(best, [REC, "method", "cluster", "f"], "left").select(
        REC, "method", "cluster", "f", "feature",
        F.coalesce("direction", F.lit("<=")).alias("direction"),
        threshold.alias("threshold_scaled"),
        (threshold * F.col("scale") + F.col("center")).alias("threshold_raw"),
        F.coalesce("score", F.lit(0.0)).alias("score_f1"), "feature_mean_raw")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({REC: [pdf[REC].iloc[0]], "method": [pdf["method"].iloc[0]],
                             "rules_text": [rules_text(pdf)]})

    rules = tree.groupBy(REC, "method").applyInPandas(
        write, f"{REC} string, method string, rules_text string")
    return Explanation(tree, importance, thresholds, predictions, fidelity, rules)
