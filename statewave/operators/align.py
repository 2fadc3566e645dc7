"""Label alignment: crosstab against a reference method and the best one-to-one matching."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.functions.assignment import best_matching
from statewave.operators.blocks import REC


@dataclass
class Alignment:
    mapping: DataFrame  # recording_id, method, label, aligned_label
    labels: DataFrame  # recording_id, window_index, method, label, aligned_label
    before: DataFrame  # recording_id, method, ref_label, label, n (full k x k grid)
    after: DataFrame


def confusion(labels: DataFrame, reference: str, k: int, column: str = "label") -> DataFrame:
    """Full k x k crosstab of every method against ``reference``."""
    ref = labels.filter(F.col("method") == reference).select(
        REC, "window_index", F.col("label").alias("ref_label"))
    counts = labels.select(REC, "window_index", "method", F.col(column).alias("label")).join(
        ref, [REC, "window_index"]).groupBy(REC, "method", "ref_label", "label").agg(
        F.count(F.lit(1)).alias("n"))
    side = F.sequence(F.lit(0), F.lit(k - 1))
    grid = (
        counts.select(REC, "method").distinct()
        .withColumn("ref_label", F.explode(side)).withColumn("label", F.explode(side))
    )
    return grid.join(counts, [REC, "method", "ref_label", "label"], "left").fillna(0, ["n"])


def matching(crosstab: DataFrame, reference: str, k: int) -> DataFrame:
    """Aligned label of every label: ``recording_id, method, label, aligned_label``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for cells in batches:
            flat = cells.flatten().to_numpy(zero_copy_only=False).reshape(-1, k, k)
            yield pa.array([best_matching(c) for c in flat], type=pa.list_(pa.int32()))

    packed = crosstab.groupBy(REC, "method").agg(
        F.sort_array(F.collect_list(F.struct("ref_label", "label", "n"))).alias("c"))
    matched = packed.withColumn("to", F.arrow_udf(run, "array<int>")("c.n"))
    identity = F.sequence(F.lit(0), F.lit(k - 1))
    return matched.select(REC, "method", F.posexplode(
        F.when(F.col("method") == reference, identity).otherwise(F.col("to"))
    ).alias("label", "aligned_label"))


def align_cluster_labels(labels: DataFrame, k: int, reference: str, methods: list[str]) -> Alignment:
    if reference not in methods:
        raise ValueError(f"Unknown alignment reference: {reference}")
    before = confusion(labels, reference, k)
    mapping = matching(before, reference, k)
    aligned = labels.join(mapping, [REC, "method", "label"], "left").select(
        REC, "window_index", "method", "label",
        F.coalesce("aligned_label", "label").alias("aligned_label"))
    moved = before.join(mapping, [REC, "method", "label"]).groupBy(
        REC, "method", "ref_label", F.col("aligned_label").alias("label")).agg(
        F.sum("n").alias("n"))
    return Alignment(mapping, aligned, before, moved)
