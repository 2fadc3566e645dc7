"""Gaussian hidden Markov models over the ordered windows of every recording.

All state counts and restarts are fitted together on a leading model axis. A recording of
one block is fitted where the block lies, one of a few blocks in tasks with a share of the models
each. For longer ones the forward and backward messages
cross block borders through ``block_scan``; a pass then needs two small vectors per block.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.config import HMMConfig
from statewave.functions.arrays import list_column, rows_of
from statewave.functions.semiring import logsumexp, product
from statewave.operators.blocks import REC, Blocks, sum_vectors
from statewave.operators.em import STATE, run_passes, settle, summed
from statewave.operators.index import run_lengths
from statewave.operators.kmeans import Starts, explode_labels, fit_in_block, fit_kmeans, sq_distances
from statewave.operators.scan import FANOUT, block_scan, both_ways
from statewave.session import cut_lineage, maybe_broadcast

# Numeric floors of the model.
DENSITY_FLOOR = 1e-12
PROBABILITY_FLOOR = 1e-300
MASS_OFFSET = 1e-12
#: Models whose messages a task holds at a time.
MODELS_AT_A_TIME = 5


@dataclass(frozen=True)
class Family:
    """Models that are fitted together, padded to the largest state count."""

    ks: tuple[int, ...]
    width: int
    pseudocount: float = 1e-3
    regularization: float = 1e-3
    tolerance: float = 1e-4

    @property
    def m(self) -> int:
        return len(self.ks)

    @property
    def k(self) -> int:
        return max(self.ks)

    @property
    def mask(self) -> np.ndarray:
        return np.arange(self.k) < np.array(self.ks)[:, None]

    @property
    def size(self) -> int:
        return self.m * self.k * (1 + self.k + 2 * self.width)

    def unpack(self, p: np.ndarray):
        m, k, f = self.m, self.k, self.width
        cuts = np.cumsum([m * k, m * k * k, m * k * f])
        pi, a, mu, var = np.split(p, cuts)
        return pi.reshape(m, k), a.reshape(m, k, k), mu.reshape(m, k, f), var.reshape(m, k, f)

    def pack(self, pi, a, mu, var) -> np.ndarray:
        return np.concatenate([pi.ravel(), a.ravel(), mu.ravel(), var.ravel()])


def emissions(x: np.ndarray, mu: np.ndarray, var: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """``rows x models x states`` log densities, -inf for padding."""
    out = np.full((len(x), *mask.shape), -np.inf)
    for m, k in zip(*np.nonzero(mask)):
        v = np.maximum(var[m, k], DENSITY_FLOOR)
        gap = x - mu[m, k]
        out[:, m, k] = -0.5 * (np.log(2 * np.pi * v).sum() + (gap * gap / v).sum(axis=1))
    return out


def _scaled(log_e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = log_e.max(axis=2, keepdims=True)
    return np.exp(log_e - top), top[:, :, 0]


def _unit(log_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised probabilities and log mass of a message along the last axis."""
    mass = logsumexp(log_v, axis=-1)
    return np.exp(log_v - mass[..., None]), mass


def _filter(e: np.ndarray, a: np.ndarray, now: np.ndarray):
    """Filtered probabilities row by row along the second axis of ``e``: segments x rows."""
    out = np.empty_like(e)
    scale = np.empty(e.shape[:3])
    for t in range(e.shape[1]):
        now = np.matmul(now[:, :, None, :], a)[:, :, 0, :] * e[:, t]
        s = now.sum(axis=2)
        now = now / s[:, :, None]
        out[:, t], scale[:, t] = now, s
    return out, np.log(scale).sum(axis=(0, 1))


def _smooth(e: np.ndarray, a: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Backward messages (any scale) along the second axis, ``now`` at the last rows."""
    out = np.empty_like(e)
    out[:, -1] = now
    for t in range(e.shape[1] - 2, -1, -1):
        now = np.matmul(a, (e[:, t + 1] * now)[:, :, :, None])[:, :, :, 0]
        now = now / now.max(axis=2, keepdims=True)
        out[:, t] = now
    return out


def _segments(e: np.ndarray, a: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Cut rows into about sqrt(n) segments of equal length and multiply each one up.

    All segments advance together, so a pass takes about sqrt(n) array steps instead of n.
    Returns the segment count and length, the transfer matrices and their log scales.
    """
    n, m, k = e.shape
    length = max(1, int(np.sqrt(n)))
    count = n // length
    parts = e[: count * length].reshape(count, length, m, k)
    out = np.broadcast_to(np.eye(k), (count, m, k, k))
    mass = np.zeros((count, m, k))
    for t in range(length):
        out = np.matmul(out, a) * parts[:, t, :, None, :]
        s = out.sum(axis=3)
        safe = np.where(s > 0, s, 1.0)
        out, mass = out / safe[..., None], mass + np.log(safe)
    # rows share one scale per segment and model, so a vector can be moved with one product
    peak = mass.max(axis=2, keepdims=True)
    return count, length, out * np.exp(mass - peak)[..., None], peak[:, :, 0]


def forward(e: np.ndarray, top: np.ndarray, a: np.ndarray, enter: np.ndarray, first: bool,
            cuts=None):
    """Filtered state probabilities per row and the log mass gained.

    ``enter`` is the initial distribution for a first block, else the filtered probabilities
    of the row before it.
    """
    gain = top.sum(axis=0)
    parts = []
    if first:
        now = enter * e[0]
        s = now.sum(axis=1)
        enter, gain, e = now / s[:, None], gain + np.log(s), e[1:]
        parts.append(enter[None])
    if len(e):
        count, length, hops, _ = cuts or _segments(e, a)
        starts = np.empty((count, *enter.shape))
        now = enter
        for i in range(count):
            starts[i] = now
            now = np.matmul(now[:, None, :], hops[i])[:, 0, :]
            now = now / now.sum(axis=1, keepdims=True)
        body = e[: count * length].reshape(count, length, *e.shape[1:])
        out, mass = _filter(body, a, starts)
        gain = gain + mass
        parts.append(out.reshape(-1, *e.shape[1:]))
        if len(e) > count * length:
            out, mass = _filter(e[None, count * length:], a, parts[-1][None, -1])
            gain = gain + mass
            parts.append(out[0])
    return np.concatenate(parts), gain


def backward(e: np.ndarray, a: np.ndarray, leave: np.ndarray, first: bool, cuts) -> np.ndarray:
    """Backward messages per row; ``leave`` is the one at the last row."""
    inner = e[1:] if first else e
    if not len(inner):
        return leave[None]
    count, length, hops, _ = cuts
    parts = []
    now = leave
    rest = inner[count * length:]
    if len(rest):
        tail = _smooth(rest[None], a, now[None])[0]
        parts.append(tail)
        now = np.matmul(a, (rest[0] * tail[0])[:, :, None])[:, :, 0]
    ends = np.empty((count, *now.shape))
    for i in range(count - 1, -1, -1):
        ends[i] = now = now / now.max(axis=1, keepdims=True)
        now = np.matmul(hops[i], now[:, :, None])[:, :, 0]
    body = inner[: count * length].reshape(count, length, *inner.shape[1:])
    parts.append(_smooth(body, a, ends).reshape(-1, *inner.shape[1:]))
    if first:
        parts.append((now / now.max(axis=1, keepdims=True))[None])
    return np.concatenate(parts[::-1])


def block_sums(x: np.ndarray, p: np.ndarray, fam: Family, enter: np.ndarray, leave: np.ndarray,
               first: bool) -> np.ndarray:
    """Expected counts and moments of one block, then the log mass it adds.

    ``leave`` is the backward message (any scale) at the last row.
    """
    pi, a, mu, var = fam.unpack(p)
    e, top = _scaled(emissions(x, mu, var, fam.mask))
    inner = e[1:] if first else e
    cuts = _segments(inner, a) if len(inner) else None
    alpha, gain = forward(e, top, a, enter, first, cuts)
    beta = backward(e, a, leave, first, cuts)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    ahead = e * beta
    before = alpha[:-1]
    after = ahead[1:]
    if not first:
        before = np.concatenate([enter[None], before])
        after = ahead
    # pairs: before[t, i] * a[i, j] * after[t, j], normalised per row
    mass = np.einsum("tmi,mij,tmj->tm", before, a, after, optimize=True)
    pairs = a * np.einsum("tmi,tmj->mij", before / mass[:, :, None], after, optimize=True)
    g1 = np.empty_like(mu)
    g2 = np.empty_like(mu)
    for m, k in zip(*np.nonzero(fam.mask)):
        gap = x - mu[m, k]
        g1[m, k] = gamma[:, m, k] @ gap
        g2[m, k] = gamma[:, m, k] @ (gap * gap)
    g1[~fam.mask] = g2[~fam.mask] = 0.0
    start = gamma[0] if first else np.zeros_like(gamma[0])
    return np.concatenate([start.ravel(), gamma.sum(axis=0).ravel(), pairs.ravel(), g1.ravel(),
                           g2.ravel(), gain])


def update(p: np.ndarray, aux: np.ndarray, stat: np.ndarray, fam: Family):
    m, k, f = fam.m, fam.k, fam.width
    cuts = np.cumsum([m * k, m * k, m * k * k, m * k * f, m * k * f])
    g0, g, pairs, g1, g2, ll = np.split(stat, cuts)
    mask, c = fam.mask, fam.pseudocount
    pi = np.where(mask, np.maximum(g0.reshape(m, k), c), 0.0)
    pi /= pi.sum(axis=1, keepdims=True)
    both = mask[:, :, None] & mask[:, None, :]
    a = np.where(both, pairs.reshape(m, k, k) + c, 0.0)
    a = np.divide(a, a.sum(axis=2, keepdims=True), out=np.zeros_like(a), where=both)
    _, _, mu, _ = fam.unpack(p)
    mass = g.reshape(m, k, 1)
    first, second = g1.reshape(m, k, f), g2.reshape(m, k, f)
    nk = mass + MASS_OFFSET
    fresh = (first + mu * mass) / nk
    shift = fresh - mu
    var = np.maximum((second - 2 * shift * first + shift * shift * mass) / nk, fam.regularization)
    old = fam.unpack(p)
    was_done, aux = settle(ll, aux, fam.tolerance)
    keep = lambda new, was: np.where(was_done.reshape(-1, *[1] * (new.ndim - 1)), was, new)
    return fam.pack(*[keep(n, o) for n, o in zip((pi, a, fresh, var), old)]), aux


def start_sums(x: np.ndarray, c: np.ndarray, prev_label: np.ndarray | None, fam: Family,
               starts: Starts) -> np.ndarray:
    """One block's share of the start: state counts, transitions, moments and first states."""
    m, k, f = fam.m, fam.k, fam.width
    d = sq_distances(x, c)
    n = np.zeros((m, k))
    hops = np.zeros((m, k, k))
    g1, g2 = np.zeros((m, k, f)), np.zeros((m, k, f))
    first = np.zeros((m, k))
    for i in range(m):
        slots = list(starts.slots(i))
        label = d[:, slots].argmin(axis=1)
        if prev_label is None:
            first[i, label[0]] = 1.0
            chain = label
        else:
            chain = np.concatenate([[int(prev_label[i])], label])
        np.add.at(hops[i], (chain[:-1], chain[1:]), 1.0)
        for s in range(starts.ks[i]):
            gap = x[label == s] - c[slots[s]]
            n[i, s] = len(gap)
            g1[i, s], g2[i, s] = gap.sum(axis=0), (gap * gap).sum(axis=0)
    return np.concatenate([first.ravel(), n.ravel(), hops.ravel(), g1.ravel(), g2.ravel()])


def start_parameters(c: np.ndarray, stat: np.ndarray, fam: Family, starts: Starts) -> np.ndarray:
    m, k, f = fam.m, fam.k, fam.width
    cuts = np.cumsum([m * k, m * k, m * k * k, m * k * f])
    first, n, hops, g1, g2 = np.split(stat, cuts)
    mask = fam.mask
    pi = np.where(mask, first.reshape(m, k) + fam.pseudocount, 0.0)
    pi /= pi.sum(axis=1, keepdims=True)
    both = mask[:, :, None] & mask[:, None, :]
    a = np.where(both, hops.reshape(m, k, k) + fam.pseudocount, 0.0)
    a = np.divide(a, a.sum(axis=2, keepdims=True), out=np.zeros_like(a), where=both)
    n = n.reshape(m, k, 1)
    safe = np.maximum(n, 1)
    spread = g2.reshape(m, k, f) / safe - (g1.reshape(m, k, f) / safe) ** 2
    reg = fam.regularization
    var = np.where(n > 0, np.maximum(np.maximum(spread, 0) + reg, reg), 1.0 + reg)
    mu = np.zeros((m, k, f))
    for i in range(m):
        mu[i, : fam.ks[i]] = c[list(starts.slots(i))]
    return fam.pack(pi, a, mu, var)


def fit_whole(x: np.ndarray, fam: Family, starts: Starts, iterations: int):
    """Fit all models of a recording whose rows are all here: parameters and likelihoods."""
    c = fit_in_block(x, starts, 50)
    p = start_parameters(c, start_sums(x, c, None, fam, starts), fam, starts)
    parts = [v.copy() for v in fam.unpack(p)]
    before, active = np.full(fam.m, -np.inf), np.arange(fam.m)
    for _ in range(iterations):
        # converged models drop out, the others keep their arrays and their own state count
        sub = replace(fam, ks=tuple(fam.ks[i] for i in active))
        k = sub.k
        mine = [v[active, :k] for v in parts]
        mine[1] = mine[1][:, :, :k]
        q = sub.pack(*mine)
        stat = block_sums(x, q, sub, mine[0], np.ones((sub.m, k)), True)
        q, aux = update(q, np.concatenate([before[active], np.zeros(sub.m)]), stat, sub)
        pi, a, mu, var = sub.unpack(q)
        parts[0][active, :k], parts[2][active, :k], parts[3][active, :k] = pi, mu, var
        parts[1][active, :k, :k] = a
        before[active] = aux[: sub.m]
        active = active[aux[sub.m:] == 0]
        if not len(active):
            break
    pi, a, mu, var = parts
    _, ll = forward(*_scaled(emissions(x, mu, var, fam.mask)), a, pi, True)
    return fam.pack(*parts), ll


def _floor_log(v: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(v, PROBABILITY_FLOOR))


def transfer(x: np.ndarray, p: np.ndarray, fam: Family, first: bool, best: bool) -> np.ndarray:
    """Block matrix: log mass (or best score) from the state before the block to its last row.

    A first block counts from the state of its own first row.
    """
    pi, a, mu, var = fam.unpack(p)
    log_e = emissions(x, mu, var, fam.mask)
    k = fam.k
    if best:
        log_a = _floor_log(a)
        now = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(fam.m, 0)
        for t, e in enumerate(log_e):
            if not (first and t == 0):
                now = (now[:, :, :, None] + log_a[:, None, :, :]).max(axis=2)
            now = now + e[:, None, :]
        return now
    e, top = _scaled(log_e)
    now = np.eye(k)[None].repeat(fam.m, 0)
    mass = np.zeros((fam.m, k)) + top.sum(axis=0)[:, None]
    if first:
        now, e = now * e[0][:, None, :], e[1:]

    def rescale(now, mass):
        s = now.sum(axis=2)
        safe = np.where(s > 0, s, 1.0)
        return now / safe[:, :, None], mass + np.log(safe)

    if len(e):
        count, length, hops, scale = _segments(e, a)
        for hop, extra in zip(hops, scale):
            now, mass = rescale(np.matmul(now, hop), mass + extra[:, None])
        for row in e[count * length:]:
            now, mass = rescale(np.matmul(now, a) * row[:, None, :], mass)
    with np.errstate(divide="ignore"):
        return np.log(now) + mass[:, :, None]


def _viterbi_forward(log_e: np.ndarray, log_a: np.ndarray, enter: np.ndarray, first: bool):
    """Best scores at the last row and back pointers per row (-1 on a very first row)."""
    n, m, k = log_e.shape
    back = np.full((n, m, k), -1)
    now = enter
    for t in range(n):
        if first and t == 0:
            now = now + log_e[0]
            continue
        paths = now[:, :, None] + log_a
        back[t] = paths.argmax(axis=1)
        now = paths.max(axis=1) + log_e[t]
    return now, back


def _trace(back: np.ndarray, end: np.ndarray) -> np.ndarray:
    """States per row, walking the pointers down from the last row's states."""
    n, m, _ = back.shape
    out = np.empty((n, m), dtype=int)
    out[-1] = end
    pick = np.arange(m)
    for t in range(n - 2, -1, -1):
        out[t] = back[t + 1, pick, out[t + 1]]
    return out


def stationary_distribution(a: np.ndarray) -> np.ndarray:
    """Long-run state shares: the eigenvector of the transposed matrix at eigenvalue 1.

    Its sign is arbitrary, so it is turned positive before rounding noise is clipped.
    """
    values, vectors = np.linalg.eig(a.T)
    v = np.real(vectors[:, np.abs(values - 1.0).argmin()])
    v = np.maximum(v if v.sum() >= 0 else -v, 0.0)
    return v / v.sum() if v.sum() > 0 else np.full(len(a), 1.0 / len(a))


@dataclass
class HMMFit:
    models: DataFrame  # one row per recording and state count
    states: DataFrame  # recording_id, n_states, window_index, hidden_state
    runs: DataFrame  # recording_id, n_states, state, run_start, run_length, duration_sec


MODEL_SCHEMA = (
    "array<struct<n_states:int, log_likelihood:double, bic:double, initial:array<double>, "
    "stationary:array<double>, transition:array<array<double>>, means:array<array<double>>, "
    "variances:array<array<double>>, mean_self_transition:double>>"
)


def hmm_analysis(blocks: Blocks, window_sec: float, config: HMMConfig | None = None) -> HMMFit:
    """Fit every state count, keep the likeliest restart of each, decode states and runs."""
    cfg = config or HMMConfig()
    if cfg.covariance_type != "diag":
        raise ValueError("Only diagonal-covariance Gaussian HMM is currently implemented.")
    if any(k <= 1 for k in cfg.state_counts):
        raise ValueError("Each HMM state count must be greater than 1.")
    if blocks.lengths.agg(F.min("n_rows")).first()[0] < 2:
        raise ValueError("At least two time windows are required for HMM analysis.")
    width, counts, tries = blocks.width, tuple(cfg.state_counts), cfg.n_restarts
    ks = tuple(k for k in counts for _ in range(tries))
    seeds = tuple(cfg.random_seed + 1000 * i + r for i in range(len(counts)) for r in range(tries))
    fam = Family(ks, width, cfg.transition_pseudocount, cfg.regularization, cfg.tolerance)
    starts = Starts(ks, seeds, shared=False)
    iterations = cfg.max_iterations

    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x_col in batches:
            fits = [fit_whole(x.reshape(-1, width), fam, starts, iterations) for x in rows_of(x_col)]
            yield pa.StructArray.from_arrays(
                [list_column([f[0] for f in fits]), list_column([f[1] for f in fits])],
                names=["p", "ll"])

    fits = blocks.short().df.select(REC, F.arrow_udf(
        whole, "struct<p:array<double>, ll:array<double>>")("x").alias("f")).select(REC, "f.*")
    if blocks.n_long > blocks.n_vast:
        fits = fits.unionByName(_by_shares(blocks, fam, starts, iterations))
    if blocks.n_vast:
        fits = fits.unionByName(_by_passes(blocks.vast(), fam, starts, iterations))
    fits = cut_lineage(fits)

    chosen = Family(counts, width)

    def select_best(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for p_col, ll_col, n_col in batches:
            rows, flat = [], []
            for p, ll, n in zip(rows_of(p_col), rows_of(ll_col), n_col.to_pylist()):
                pi, a, mu, var = fam.unpack(p)
                cells, pads = [], [np.zeros((chosen.m, chosen.k, *s)) for s in
                                   ((), (chosen.k,), (width,), (width,))]
                for i, k in enumerate(counts):
                    m = i * tries + int(np.argmax(ll[i * tries: (i + 1) * tries]))
                    n_params = (k - 1) + k * (k - 1) + 2 * k * width
                    cells.append({
                        "n_states": k, "log_likelihood": ll[m],
                        "bic": -2.0 * ll[m] + n_params * np.log(n),
                        "initial": pi[m, :k].tolist(),
                        "stationary": stationary_distribution(a[m, :k, :k]).tolist(),
                        "transition": a[m, :k, :k].tolist(), "means": mu[m, :k].tolist(),
                        "variances": var[m, :k].tolist(),
                        "mean_self_transition": float(np.diag(a[m])[:k].mean())})
                    for pad, source in zip(pads, (pi, a, mu, var)):
                        pad[i] = source[m]
                rows.append(cells)
                flat.append(chosen.pack(*pads))
            kind = pa.struct([
                ("n_states", pa.int32()), ("log_likelihood", pa.float64()), ("bic", pa.float64()),
                ("initial", pa.list_(pa.float64())), ("stationary", pa.list_(pa.float64())),
                ("transition", pa.list_(pa.list_(pa.float64()))),
                ("means", pa.list_(pa.list_(pa.float64()))),
                ("variances", pa.list_(pa.list_(pa.float64()))),
                ("mean_self_transition", pa.float64())])
            yield pa.StructArray.from_arrays(
                [pa.array(rows, type=pa.list_(kind)), list_column(flat)], names=["models", "p"])

    best = cut_lineage(fits.join(blocks.lengths, REC).select(REC, F.arrow_udf(
        select_best, f"struct<models:{MODEL_SCHEMA}, p:array<double>>")("p", "ll", "n_rows")
        .alias("b")).select(REC, "b.*"))
    models = best.select(REC, F.explode("models").alias("m")).select(REC, "m.*")
    states = decode(blocks, best.select(REC, "p"), chosen)
    keyed = states.select(
        F.concat_ws("\u0001", REC, F.col("n_states").cast("string")).alias("_key"),
        "window_index", F.col("hidden_state").alias("state"))
    parts = F.split("_key", "\u0001")
    runs = run_lengths(keyed, "_key", "window_index", "state").select(
        parts[0].alias(REC), parts[1].cast("int").alias("n_states"), "state", "run_start",
        "run_length", (F.col("run_length") * F.lit(float(window_sec))).alias("duration_sec"))
    return HMMFit(models, states, runs)


def decode(blocks: Blocks, params: DataFrame, fam: Family) -> DataFrame:
    """Most likely state paths: ``recording_id, n_states, window_index, hidden_state``."""
    width, row_bytes = blocks.width, 8 * fam.size + 64

    def whole(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x_col, p_col in batches:
            out = []
            for x, p in zip(rows_of(x_col), rows_of(p_col)):
                pi, a, mu, var = fam.unpack(p)
                log_e = emissions(x.reshape(-1, width), mu, var, fam.mask)
                score, back = _viterbi_forward(log_e, _floor_log(a), _floor_log(pi), True)
                out.append(_trace(back, score.argmax(axis=1)).ravel())
            yield list_column(out).cast(pa.list_(pa.int32()))

    paths = blocks.short().with_state(params, row_bytes).select(
        REC, "start_idx", F.arrow_udf(whole, "array<int>")("x", "p").alias("path"))
    if blocks.n_long:
        paths = paths.unionByName(_decode_passes(blocks.long(), params, fam, row_bytes))
    flat = explode_labels(paths.withColumn("start_idx", F.col("start_idx") * fam.m), "path",
                          "hidden_state")
    which = F.array(*[F.lit(k) for k in fam.ks])
    return flat.select(
        REC, which[(F.col("window_index") % fam.m).cast("int")].alias("n_states"),
        F.expr(f"window_index div {fam.m}").alias("window_index"), "hidden_state")


def _transfers(fam: Family, best: bool):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for x_col, p_col, b_col in batches:
            ahead, back = [], []
            for x, p, b in zip(rows_of(x_col), rows_of(p_col), b_col.to_pylist()):
                t = transfer(x.reshape(-1, fam.width), p, fam, b == 0, best)
                ahead.append(t.ravel())
                back.append(np.swapaxes(t, 1, 2).ravel())
            yield pa.StructArray.from_arrays([list_column(ahead), list_column(back)],
                                             names=["ahead", "back"])

    return F.arrow_udf(run, "struct<ahead:array<double>, back:array<double>>")


def _log_initial(fam: Family):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p_col in batches:
            yield list_column([np.where(fam.mask, _floor_log(fam.unpack(p)[0]), -np.inf).ravel()
                               for p in rows_of(p_col)])

    return F.arrow_udf(run, "array<double>")


def _messages(blocks: Blocks, state: DataFrame, fam: Family, row_bytes: int, best: bool = False):
    """Forward messages into every block and, for sums, backward messages out of it."""
    if not best and blocks.max_blocks <= FANOUT:
        hops = blocks.with_state(state.select(REC, "p"), row_bytes).select(
            REC, "block", F.when(F.col("block") == 0, _log_initial(fam)("p")).alias("start"),
            _transfers(fam, False)("x", "p", "block")["ahead"].alias("m"))
        return both_ways(hops, (fam.m,), fam.k, "log")
    hops = cut_lineage(blocks.with_state(state.select(REC, "p"), row_bytes).select(
        REC, "block", "n_rows", F.when(F.col("block") == 0, _log_initial(fam)("p")).alias("start"),
        _transfers(fam, best)("x", "p", "block").alias("t")).select(
        REC, "block", "n_rows", "start", "t.*"))
    algebra = "max" if best else "log"
    ahead = block_scan(hops.select(REC, "block", "start", F.col("ahead").alias("m")),
                       (fam.m,), fam.k, algebra, blocks.max_blocks)
    if best:
        return ahead
    last = F.col("block") == F.expr(f"(n_rows - 1) div {blocks.size}")
    ones = F.array_repeat(F.lit(0.0), fam.m * fam.k)
    back = block_scan(
        hops.select(REC, "block", F.when(last, ones).alias("start"), F.col("back").alias("m")),
        (fam.m,), fam.k, algebra, blocks.max_blocks, reverse=True)
    return ahead.withColumnRenamed("carry", "enter").join(
        back.withColumnRenamed("carry", "leave"), [REC, "block"])


def _by_shares(blocks: Blocks, fam: Family, starts: Starts, iterations: int) -> DataFrame:
    """Recordings that are fitted in tasks, a share of the models in each, a few at a time."""
    width = blocks.width
    rows, shares = blocks.gathered(fam.m)

    def some(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x_col, share in batches:
            ps, lls = [], []
            for x, i in zip(rows_of(x_col), share.to_pylist()):
                parts = [np.zeros_like(v) for v in fam.unpack(np.zeros(fam.size))]
                ll = np.full(fam.m, np.nan)
                mine = list(range(i, fam.m, shares))
                for at in range(0, len(mine), MODELS_AT_A_TIME):
                    own = mine[at:at + MODELS_AT_A_TIME]
                    sub = replace(fam, ks=tuple(fam.ks[m] for m in own))
                    p, ll[own] = fit_whole(x.reshape(-1, width), sub, Starts(
                        sub.ks, tuple(starts.seeds[m] for m in own), starts.shared), iterations)
                    pi, a, mu, var = sub.unpack(p)
                    k = sub.k
                    parts[0][own, :k], parts[2][own, :k], parts[3][own, :k] = pi, mu, var
                    parts[1][own, :k, :k] = a
                ps.append(fam.pack(*parts))
                lls.append(ll)
            yield pa.StructArray.from_arrays([list_column(ps), list_column(lls)], names=["p", "ll"])

    def collect(pdf: pd.DataFrame) -> pd.DataFrame:
        # models that another share fits are zeros in p and NaN in ll
        p, ll = np.sum(np.stack(pdf["p"].to_list()), axis=0), np.stack(pdf["ll"].to_list())
        return pd.DataFrame({REC: pdf[REC].iloc[:1].to_list(), "p": [p], "ll": [ll[np.arange(fam.m) % shares, np.arange(fam.m)]]})

    fits = rows.select(REC, "share", F.arrow_udf(some, "struct<p:array<double>, ll:array<double>>")("x", "share").alias("f"))
    return fits.select(REC, "share", "f.*").groupBy(REC).applyInPandas(
        lambda pdf: collect(pdf.sort_values("share")), f"{REC} string, p array<double>, ll array<double>")


def _by_passes(blocks: Blocks, fam: Family, starts: Starts, iterations: int) -> DataFrame:
    width, row_bytes = blocks.width, 8 * fam.size + 64
    centers = cut_lineage(fit_kmeans(blocks, starts, 50))

    def last_label(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x_col, c_col in batches:
            out = []
            for x, c in zip(rows_of(x_col), rows_of(c_col)):
                d = sq_distances(x[-width:].reshape(1, width), c.reshape(-1, width))[0]
                out.append(np.array([float(d[list(starts.slots(i))].argmin())
                                     for i in range(fam.m)]))
            yield list_column(out)

    def begin(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for x_col, c_col, l_col in batches:
            yield list_column([
                start_sums(x.reshape(-1, width), c.reshape(-1, width), l if len(l) else None,
                           fam, starts)
                for x, c, l in zip(rows_of(x_col), rows_of(c_col), rows_of(l_col))])

    def first(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for c_col, s_col in batches:
            yield list_column([start_parameters(c.reshape(-1, width), s, fam, starts)
                               for c, s in zip(rows_of(c_col), rows_of(s_col))])

    with_c = blocks.with_state(centers, 8 * width * sum(fam.ks) + 64)
    borders = with_c.select(REC, (F.col("block") + 1).alias("block"),
                            F.arrow_udf(last_label, "array<double>")("x", "c").alias("before"))
    nothing = F.array().cast("array<double>")
    sums = with_c.join(borders, [REC, "block"], "left").select(REC, F.arrow_udf(
        begin, "array<double>")("x", "c", F.coalesce("before", nothing)).alias("v"))
    state = cut_lineage(
        centers.join(sum_vectors(sums, "v"), REC)
        .select(REC, F.arrow_udf(first, "array<double>")("c", "stats").alias("p"))
        .withColumn("prev", F.col("p"))
        .withColumn("aux", F.concat(F.array_repeat(F.lit(float("-inf")), fam.m),
                                    F.array_repeat(F.lit(0.0), fam.m))))

    def answer(x, p, b, n, e, l) -> np.ndarray:
        enter, mass = _unit(e.reshape(fam.m, fam.k))
        leave = _unit(l.reshape(fam.m, fam.k))[0]
        stat = block_sums(x.reshape(-1, width), p, fam, fam.unpack(p)[0] if b == 0 else enter, leave, b == 0)
        # the log mass up to the last row is the likelihood; other blocks add nothing
        whole = (mass if b else 0.0) + stat[-fam.m:]
        stat[-fam.m:] = whole if (n - 1) // blocks_size == b else 0.0
        return stat

    def move(p: np.ndarray, aux: np.ndarray, stat: np.ndarray) -> dict:
        new, after = update(p, aux, stat, fam)
        return {"p": new, "prev": p, "aux": after}

    blocks_size, message_bytes = blocks.size, 16 * fam.m * fam.k + 64

    def over(current: DataFrame, carried: list[str], finish, schema: str) -> DataFrame:
        """A pass over all blocks of the recordings that are still open."""
        messages = _messages(blocks, current, fam, row_bytes)
        rows = blocks.with_state(current.select(REC, *carried), row_bytes).join(
            maybe_broadcast(messages, blocks.n_recordings * blocks.max_blocks, message_bytes), [REC, "block"])
        return summed(rows, ["x", "p", "block", "n_rows", "enter", "leave"], answer, carried, finish, schema)

    done = cut_lineage(run_passes(state, lambda now: over(now, ["p", "aux"], move, STATE), iterations))
    # likelihood under the final parameters
    return over(done, ["p"], lambda p, stat: {"p": p, "ll": stat[-fam.m:]}, "p array<double>, ll array<double>")


def log_emissions(blocks: Blocks, params: DataFrame, fam: Family) -> DataFrame:
    """Log density of every window under every state of every model."""
    width = blocks.width

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x_col, p_col in batches:
            out = []
            for x, p in zip(rows_of(x_col), rows_of(p_col)):
                _, _, mu, var = fam.unpack(p)
                out.append(emissions(x.reshape(-1, width), mu, var, fam.mask).ravel())
            yield list_column(out)

    per_row = fam.m * fam.k
    flat = blocks.with_state(params, 8 * fam.size + 64).select(
        REC, (F.col("start_idx") * per_row).alias("start_idx"),
        F.arrow_udf(run, "array<double>")("x", "p").alias("e"))
    ks = F.array(*[F.lit(k) for k in fam.ks])
    cells = explode_labels(flat, "e", "log_density")
    spot = F.col("window_index") % per_row
    return cells.select(
        REC, ks[F.floor(spot / fam.k).cast("int")].alias("n_states"),
        (spot % fam.k).cast("int").alias("state"),
        F.expr(f"window_index div {per_row}").alias("window_index"), "log_density",
    ).filter(F.col("state") < F.col("n_states"))


def log_likelihood(blocks: Blocks, params: DataFrame, fam: Family) -> DataFrame:
    """Forward likelihood under given parameters: ``recording_id, n_states, log_likelihood``."""
    shape = (fam.m, fam.k)

    def close(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for m_col, c_col in batches:
            yield list_column([
                logsumexp(product(c.reshape(shape), m.reshape(*shape, fam.k), "log"), axis=-1)
                for m, c in zip(rows_of(m_col), rows_of(c_col))])

    row_bytes = 8 * fam.size + 64
    hops = cut_lineage(blocks.with_state(params, row_bytes).select(
        REC, "block", "n_rows", F.when(F.col("block") == 0, _log_initial(fam)("p")).alias("start"),
        _transfers(fam, False)("x", "p", "block").alias("t")).select(
        REC, "block", "n_rows", "start", F.col("t.ahead").alias("m")))
    # a single block is entered in its start state; only longer recordings need the scan
    carry = hops.filter(F.col("n_rows") <= blocks.size).select(
        REC, "block", F.col("start").alias("carry"))
    if blocks.n_long:
        carry = carry.unionByName(block_scan(
            hops.filter(F.col("n_rows") > blocks.size).select(REC, "block", "start", "m"),
            (fam.m,), fam.k, "log", blocks.max_blocks))
    last = F.col("block") == F.expr(f"(n_rows - 1) div {blocks.size}")
    ks = F.array(*[F.lit(k) for k in fam.ks])
    return hops.filter(last).join(carry, [REC, "block"]).select(REC, F.posexplode(
        F.arrow_udf(close, "array<double>")("m", "carry")).alias("i", "log_likelihood")).select(
        REC, ks[F.col("i")].alias("n_states"), "log_likelihood")


def _decode_passes(blocks: Blocks, params: DataFrame, fam: Family, row_bytes: int) -> DataFrame:
    """Best paths of long recordings: scores forward, then back pointers composed per block."""
    width, m, k, size = blocks.width, fam.m, fam.k, blocks.size
    scores = cut_lineage(_messages(blocks, params, fam, row_bytes, best=True))
    ready = blocks.with_state(params, row_bytes).join(scores, [REC, "block"])

    def pointers(x, p, b, carry):
        pi, a, mu, var = fam.unpack(p)
        log_e = emissions(x.reshape(-1, width), mu, var, fam.mask)
        return _viterbi_forward(log_e, _floor_log(a), carry.reshape(m, k), b == 0)

    def compose(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        """Matrix that turns the state at a block's last row into the one before the block."""
        for x_col, p_col, b_col, n_col, c_col in batches:
            maps, ends = [], []
            for x, p, b, n, c in zip(rows_of(x_col), rows_of(p_col), b_col.to_pylist(),
                                     n_col.to_pylist(), rows_of(c_col)):
                score, back = pointers(x, p, b, c)
                hop = np.full((m, k, k), -np.inf)
                for s in range(k):
                    head = _trace(back, np.full(m, s))[0]
                    to = head if b == 0 else back[0][np.arange(m), head]
                    hop[np.arange(m), s, to] = 0.0
                maps.append(hop.ravel())
                end = np.full((m, k), -np.inf)
                end[np.arange(m), score.argmax(axis=1)] = 0.0
                ends.append(end.ravel() if (n - 1) // size == b else np.empty(0))
            yield pa.StructArray.from_arrays([list_column(maps), list_column(ends)],
                                             names=["m", "end"])

    def paths(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for x_col, p_col, b_col, c_col, e_col in batches:
            out = []
            for x, p, b, c, e in zip(rows_of(x_col), rows_of(p_col), b_col.to_pylist(),
                                     rows_of(c_col), rows_of(e_col)):
                _, back = pointers(x, p, b, c)
                out.append(_trace(back, e.reshape(m, k).argmax(axis=1)).ravel())
            yield list_column(out).cast(pa.list_(pa.int32()))

    hops = cut_lineage(ready.select(REC, "block", F.arrow_udf(
        compose, "struct<m:array<double>, end:array<double>>")(
        "x", "p", "block", "n_rows", "carry").alias("h")).select(
        REC, "block", "h.m", F.when(F.size("h.end") > 0, F.col("h.end")).alias("start")))
    ends = block_scan(hops, (m,), k, "max", blocks.max_blocks, reverse=True)
    return ready.withColumnRenamed("carry", "score").join(ends, [REC, "block"]).select(
        REC, "start_idx", F.arrow_udf(paths, "array<int>")(
            "x", "p", "block", "score", "carry").alias("path"))
