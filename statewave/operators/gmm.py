"""Diagonal-covariance Gaussian mixtures started from k-means."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.config import ClusterConfig
from statewave.functions.arrays import list_column, rows_of
from statewave.functions.semiring import logsumexp
from statewave.operators.blocks import REC, Blocks, sum_vectors
from statewave.operators.em import STATE, run_passes, settle, summed
from statewave.operators.kmeans import explode_labels, sq_distances
from statewave.session import cut_lineage, maybe_broadcast

# Floors and start offsets of the mixture fit.
VARIANCE_FLOOR = 1e-6
WEIGHT_FLOOR = 1e-12
START_VARIANCE = 1e-3
MASS_OFFSET = 1e-12


def unpack(p: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return p[:k], p[k: k + k * width].reshape(k, width), p[k + k * width:].reshape(k, width)


def log_density(x: np.ndarray, means: np.ndarray, variances: np.ndarray, floor: float) -> np.ndarray:
    """``rows x components`` log density of diagonal Gaussians."""
    v = np.maximum(variances, floor)
    out = np.empty((len(x), len(means)))
    for j in range(len(means)):
        gap = x - means[j]
        out[:, j] = -0.5 * (np.log(2 * np.pi * v[j]).sum() + (gap * gap / v[j]).sum(axis=1))
    return out


def responsibilities(x: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    w, mu, var = unpack(p, k, x.shape[1])
    joint = log_density(x, mu, var, VARIANCE_FLOOR) + np.log(np.maximum(w, WEIGHT_FLOOR))
    norm = logsumexp(joint, axis=1)
    return np.exp(joint - norm[:, None]), float(norm.sum())


def _moments(x: np.ndarray, weight: np.ndarray, about: np.ndarray) -> np.ndarray:
    """Weights, first and second moments about ``about``, flattened in that order."""
    first, second = [], []
    for j in range(len(about)):
        gap = x - about[j]
        first.append(weight[:, j] @ gap)
        second.append(weight[:, j] @ (gap * gap))
    return np.concatenate([weight.sum(axis=0), *first, *second])


def start_sums(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    label = sq_distances(x, centroids).argmin(axis=1)
    member = (label[:, None] == np.arange(len(centroids))).astype(float)
    return _moments(x, member, centroids)


def start_parameters(centroids: np.ndarray, stat: np.ndarray) -> np.ndarray:
    k, width = centroids.shape
    n, first, second = stat[:k], stat[k: k + k * width], stat[k + k * width:]
    safe = np.maximum(n, 1)[:, None]
    spread = second.reshape(k, width) / safe - (first.reshape(k, width) / safe) ** 2
    var = np.where(n[:, None] > 0, np.maximum(spread, 0) + START_VARIANCE, 1.0)
    return np.concatenate([n / n.sum(), centroids.ravel(), var.ravel()])


def em_sums(x: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    """One block's share of the M-step: moments about the current means, then the likelihood."""
    resp, ll = responsibilities(x, p, k)
    return np.concatenate([_moments(x, resp, unpack(p, k, x.shape[1])[1]), [ll]])


def em_update(p: np.ndarray, aux: np.ndarray, stat: np.ndarray, k: int, width: int,
              tolerance: float, n_rows: float) -> tuple[np.ndarray, np.ndarray]:
    _, mu, _ = unpack(p, k, width)
    mass, ll = stat[:k], stat[-1:]
    first = stat[k: k + k * width].reshape(k, width)
    second = stat[k + k * width: -1].reshape(k, width)
    nk = (mass + MASS_OFFSET)[:, None]
    fresh = (first + mu * mass[:, None]) / nk
    shift = fresh - mu
    var = (second - 2 * shift * first + shift * shift * mass[:, None]) / nk
    was_done, aux = settle(ll, aux, tolerance)
    new = np.concatenate([nk.ravel() / n_rows, fresh.ravel(), np.maximum(var, VARIANCE_FLOOR).ravel()])
    return (p if was_done[0] else new), aux


@dataclass
class GMMFit:
    model: DataFrame  # recording_id, weights, means, variances, log_likelihood, aic, bic
    labels: DataFrame  # recording_id, window_index, label


def gmm(blocks: Blocks, centroids: DataFrame, config: ClusterConfig | None = None) -> GMMFit:
    """Fit from the k-means ``centroids``.

    Every restart would begin at the same k-means solution, so one fit gives the result of
    all of them.
    """
    cfg = config or ClusterConfig()
    k, width = cfg.n_clusters, blocks.width
    tol, iterations = cfg.gmm_tolerance, cfg.gmm_iterations
    row_bytes = 8 * (2 * k * width + k) * 2 + 64

    def whole(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x_col, c_col in batches:
            ps, prevs, lls = [], [], []
            for x, c in zip(rows_of(x_col), rows_of(c_col)):
                x, c = x.reshape(-1, width), c.reshape(k, width)
                p = prev = start_parameters(c, start_sums(x, c))
                aux = np.array([-np.inf, 0.0])
                for _ in range(iterations):
                    prev = p
                    p, aux = em_update(p, aux, em_sums(x, p, k), k, width, tol, len(x))
                    if aux[1]:
                        break
                ps.append(p)
                prevs.append(prev)
                lls.append(aux)
            yield pa.StructArray.from_arrays(
                [list_column(ps), list_column(prevs), list_column(lls)], names=["p", "prev", "aux"])

    fit_schema = "struct<p:array<double>, prev:array<double>, aux:array<double>>"
    rows = blocks.short().df.select(REC, "x")
    if blocks.n_long > blocks.n_vast:
        rows = rows.unionByName(blocks.gathered()[0].select(REC, "x"))
    fits = rows.join(maybe_broadcast(centroids, blocks.n_recordings, row_bytes), REC).select(
        REC, F.arrow_udf(whole, fit_schema)("x", "centroids").alias("f")).select(REC, "f.*")
    if blocks.n_vast:
        vast = blocks.vast()
        starts = centroids.join(maybe_broadcast(vast.lengths.select(REC), vast.n_recordings, 64), REC, "left_semi")
        fits = fits.unionByName(_by_passes(vast, starts, k, tol, iterations, row_bytes))
    fits = cut_lineage(fits)

    def label(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x_col, p_col in batches:
            yield list_column([
                responsibilities(x.reshape(-1, width), p, k)[0].argmax(axis=1)
                for x, p in zip(rows_of(x_col), rows_of(p_col))]).cast(pa.list_(pa.int32()))

    # labels come from the responsibilities that the last update was computed from
    tagged = blocks.with_state(fits.select(REC, "prev"), row_bytes).select(
        REC, "start_idx", F.arrow_udf(label, "array<int>")("x", "prev").alias("l"))
    n_params = (k - 1) + 2 * k * width
    ll = F.col("aux")[0]
    model = fits.join(blocks.lengths, REC).select(
        REC,
        F.slice("p", 1, k).alias("weights"),
        F.slice("p", k + 1, k * width).alias("means"),
        F.slice("p", k + k * width + 1, k * width).alias("variances"),
        ll.alias("log_likelihood"),
        (-2.0 * ll + 2.0 * n_params).alias("aic"),
        (-2.0 * ll + float(n_params) * F.log(F.col("n_rows").cast("double"))).alias("bic"),
    )
    return GMMFit(model, explode_labels(tagged, "l", "label"))


def _by_passes(blocks: Blocks, centroids: DataFrame, k: int, tol: float, iterations: int,
               row_bytes: int) -> DataFrame:
    width = blocks.width

    def begin(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x_col, c_col in batches:
            yield list_column([start_sums(x.reshape(-1, width), c.reshape(k, width))
                               for x, c in zip(rows_of(x_col), rows_of(c_col))])

    def first(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for c_col, s_col in batches:
            yield list_column([start_parameters(c.reshape(k, width), s)
                               for c, s in zip(rows_of(c_col), rows_of(s_col))])

    def update(p: np.ndarray, aux: np.ndarray, stat: np.ndarray) -> dict:
        new, after = em_update(p, aux, stat, k, width, tol, round(stat[:k].sum()))
        return {"p": new, "prev": p, "aux": after}

    sums = F.arrow_udf(begin, "array<double>")
    starts = blocks.with_state(centroids, row_bytes).select(REC, sums("x", "centroids").alias("v"))
    p0 = F.arrow_udf(first, "array<double>")("centroids", "stats")
    state = cut_lineage(
        centroids.join(sum_vectors(starts, "v"), REC).select(REC, p0.alias("p"))
        .withColumn("prev", F.col("p"))
        .withColumn("aux", F.array(F.lit(float("-inf")), F.lit(0.0))))

    def step(current: DataFrame) -> DataFrame:
        rows = blocks.with_state(current.select(REC, "p", "aux"), row_bytes)
        return summed(rows, ["x", "p"], lambda x, p: em_sums(x.reshape(-1, width), p, k), ["p", "aux"], update, STATE)

    return run_passes(state, step, iterations)
