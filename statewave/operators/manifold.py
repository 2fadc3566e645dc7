"""Low-dimensional embeddings: PCA from a distributed covariance and diffusion maps."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.config import ManifoldConfig
from statewave.functions.arrays import list_column, rows_of
from statewave.operators import kernel
from statewave.operators.blocks import REC, Blocks, sum_vectors
from statewave.operators.kmeans import explode_labels
from statewave.session import cut_lineage, maybe_broadcast


@dataclass
class Manifold:
    method_requested: str
    method_used: str
    embedding: DataFrame  # recording_id, window_index, dim_1 ... dim_C
    eigenvalues: DataFrame | None  # recording_id, eigenvalues
    metadata: dict = field(default_factory=dict)


def _fixed_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry by size is positive."""
    at = np.abs(vectors).argmax(axis=0)
    sign = np.sign(vectors[at, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1.0, sign)


def covariance(blocks: Blocks) -> DataFrame:
    """``recording_id, mean, cov`` (flattened sample covariance), two passes of partial sums."""
    width = blocks.width

    def total(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield list_column([x.reshape(-1, width).sum(axis=0) for x in rows_of(col)])

    def gram(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for col, mean in batches:
            out = []
            for x, m in zip(rows_of(col), rows_of(mean)):
                gap = x.reshape(-1, width) - m
                out.append((gap.T @ gap).ravel())
            yield list_column(out)

    sums = blocks.df.select(REC, F.arrow_udf(total, "array<double>")("x").alias("v"))
    means = sum_vectors(sums, "v").join(blocks.lengths, REC).select(
        REC, "n_rows", F.transform("stats", lambda s: s / F.col("n_rows")).alias("mean"))
    grams = blocks.with_state(means.select(REC, "mean"), 8 * width + 64).select(
        REC, F.arrow_udf(gram, "array<double>")("x", "mean").alias("v"))
    return sum_vectors(grams, "v").join(means, REC).select(
        REC, "mean", F.transform(
            "stats", lambda s: s / F.greatest(F.col("n_rows") - 1, F.lit(1))).alias("cov"))


def pca(blocks: Blocks, n_components: int) -> tuple[DataFrame, DataFrame]:
    """Embedding and eigenvalues; only the small covariance meets in one task."""
    width = blocks.width

    def axes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for cov in batches:
            vectors, values = [], []
            for c in rows_of(cov):
                w, v = np.linalg.eigh(c.reshape(width, width))
                pick = np.argsort(-w, kind="stable")[:n_components]
                values.append(np.maximum(w[pick], 0.0))
                vectors.append(_fixed_signs(v[:, pick]).ravel())
            yield pa.StructArray.from_arrays([list_column(vectors), list_column(values)],
                                             names=["axes", "eigenvalues"])

    def project(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for col, mean, axes_col in batches:
            yield list_column([
                ((x.reshape(-1, width) - m) @ a.reshape(width, -1)).ravel()
                for x, m, a in zip(rows_of(col), rows_of(mean), rows_of(axes_col))])

    model = cut_lineage(covariance(blocks).select(REC, "mean", F.arrow_udf(
        axes, "struct<axes:array<double>, eigenvalues:array<double>>")("cov").alias("a")).select(
        REC, "mean", "a.*"))
    flat = blocks.with_state(model.select(REC, "mean", "axes"), 8 * width * (n_components + 1) + 64)
    coords = flat.select(REC, "start_idx", F.arrow_udf(project, "array<double>")(
        "x", "mean", "axes").alias("e"))
    return _wide(coords, min(n_components, width)), model.select(REC, "eigenvalues")


def _wide(coords: DataFrame, c: int) -> DataFrame:
    """Flat row-major coordinates per block as one row per window."""
    rows = coords.withColumn("rows", F.transform(
        F.sequence(F.lit(0), F.expr(f"int(size(e) / {c}) - 1")),
        lambda i: F.slice("e", i * c + 1, F.lit(c))))
    return explode_labels(rows, "rows", "row").select(
        REC, "window_index", *[F.col("row")[i].alias(f"dim_{i + 1}") for i in range(c)])


def kernel_row_sums(blocks: Blocks, epsilon: float | None = None) -> DataFrame:
    """``recording_id, window_index, epsilon, row_sum`` of the diffusion kernel."""
    width = blocks.width

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.asarray(pdf["x"].iloc[0]).reshape(-1, width)
        scale = max(kernel.median_of(x) if epsilon is None else epsilon, 1e-6)
        sums = kernel.kernel_times(x, [x], [np.ones((len(x), 1))], scale)
        return pd.DataFrame({REC: [pdf[REC].iloc[0]], "start_idx": [0], "e": [sums.ravel()], "epsilon": [scale]})

    frame = blocks.short().df.select(REC, "x").groupBy(REC).applyInPandas(
        measure, f"{REC} string, start_idx bigint, e array<double>, epsilon double")
    if blocks.n_long:
        long = blocks.long()
        packed = kernel.sides(long)
        scales, sums = kernel.scales_and_sums(long, packed, epsilon)
        sums = sums.join(maybe_broadcast(scales, long.n_recordings, 64), REC)
        frame = frame.unionByName(sums.select(REC, (F.col("block") * blocks.size).alias("start_idx"),
                                              F.col("row_sum").alias("e"), "epsilon"))
    return frame.select(REC, "epsilon", "start_idx", F.posexplode("e").alias("at", "row_sum")).select(
        REC, (F.col("start_idx") + F.col("at")).alias("window_index"), "epsilon", "row_sum")


def diffusion(blocks: Blocks, n_components: int, epsilon: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Coordinates of the random walk with a Gaussian kernel, and its eigenvalues, for any length.

    A recording with no more than ``n_components`` windows has as many coordinates as eigenvectors
    beside the constant one; the others are 0.
    """
    c, width = n_components, blocks.width

    def embed(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.asarray(pdf["x"].iloc[0]).reshape(-1, width)
        psi, values, _ = kernel.local_walk(x, c, epsilon)
        psi = _fixed_signs(psi / np.maximum(np.linalg.norm(psi, axis=0), 1e-300)) * values
        out = np.zeros((len(x), c))
        out[:, :psi.shape[1]] = psi
        return pd.DataFrame({REC: [pdf[REC].iloc[0]], "start_idx": [0], "e": [out.ravel()], "eigenvalues": [values]})

    frame = cut_lineage(blocks.short().df.select(REC, "x").groupBy(REC).applyInPandas(
        embed, f"{REC} string, start_idx bigint, e array<double>, eigenvalues array<double>"))
    coords, eigenvalues = frame.select(REC, "start_idx", "e"), frame.select(REC, "eigenvalues")
    if blocks.n_long:
        long, more = long_diffusion(blocks.long(), c, epsilon)
        coords, eigenvalues = coords.unionByName(long), eigenvalues.unionByName(more)
    return _wide(coords, c), eigenvalues


def long_diffusion(blocks: Blocks, c: int, epsilon: float | None) -> tuple[DataFrame, DataFrame]:
    """The same for recordings of several blocks, as flat arrays per block."""
    psi, values = kernel.Walk(blocks, c, epsilon).run()
    psi, size = cut_lineage(psi), blocks.size

    def squares(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield list_column([(a.reshape(-1, c) ** 2).sum(axis=0) for a in rows_of(col)])

    def peaks(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Per column: largest size, minus its row, its sign; an array of three for each column."""
        for col, block in batches:
            out = []
            for a, b in zip(rows_of(col), block.to_pylist()):
                a = a.reshape(-1, c)
                at = np.abs(a).argmax(axis=0)
                top = a[at, np.arange(c)]
                out.append(np.stack([np.abs(top), -(at + b * size), np.where(top < 0, -1.0, 1.0)], axis=1).ravel())
            yield list_column(out)

    norms = sum_vectors(psi.select(REC, F.arrow_udf(squares, "array<double>")("psi").alias("v")), "v")
    each = psi.select(REC, F.arrow_udf(peaks, "array<double>")("psi", "block").alias("p")).select(
        REC, F.explode(F.expr(f"transform(sequence(0, {c - 1}), k -> struct(k, slice(p, 3 * k + 1, 3) as top))")).alias("p"))
    signs = each.groupBy(REC, F.col("p.k").alias("k")).agg(F.max("p.top").alias("top")).groupBy(REC).agg(
        F.sort_array(F.collect_list(F.struct("k", F.col("top")[2].alias("sign")))).alias("signs"))
    factor = F.expr("""transform(sequence(0, size(stats) - 1),
        k -> signs[k].sign * eigenvalues[k] / sqrt(greatest(stats[k], 1e-300D)))""")
    state = norms.join(signs, REC).join(values, REC).select(REC, factor.alias("factor"))

    def scale(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for col, by in batches:
            yield list_column([(a.reshape(-1, c) * f).ravel() for a, f in zip(rows_of(col), rows_of(by))])

    coords = psi.join(maybe_broadcast(state, blocks.n_recordings, 8 * c + 64), REC).select(
        REC, (F.col("block") * blocks.size).alias("start_idx"), F.arrow_udf(scale, "array<double>")("psi", "factor").alias("e"))
    return coords, values


def manifold(blocks: Blocks, config: ManifoldConfig | None = None) -> Manifold:
    cfg = config or ManifoldConfig()
    c, meta = cfg.n_components, {"n_components": cfg.n_components}
    if cfg.method == "pca":
        embedding, values = pca(blocks, c)
        return Manifold("pca", "pca", embedding, values, meta)
    if cfg.method not in ("diffusion", "umap"):
        raise ValueError(f"Unknown manifold method: {cfg.method}")
    embedding, values = diffusion(blocks, c, cfg.diffusion_epsilon)
    used = "diffusion" if cfg.method == "diffusion" else "diffusion_fallback"
    return Manifold(cfg.method, used, embedding, values, meta)
