"""Kernels, walks and trees of recordings of many blocks against one block and plain matrices."""

import numpy as np
import pytest
from tests.conftest import feature_frame

from statewave.config import ClusterConfig
from statewave.functions import linkage
from statewave.operators import blocks as B
from statewave.operators import kernel, manifold
from statewave.operators.hierarchical import hierarchical
from statewave.session import cut_lineage


@pytest.fixture(scope="module")
def clumps(rng):
    """Two long recordings with repeated rows and one short one."""
    centre = rng.normal(size=(7, 4)) * 6
    x = centre[rng.integers(0, 7, 600)] + rng.normal(size=(600, 4)) * rng.uniform(0.3, 1.5, size=(600, 1))
    x[100:110] = x[50]
    return {"a": x, "b": x[:333] * 2, "c": x[:40]}


def packed(spark, table, size):
    return B.feature_blocks(feature_frame(spark, **table), "window_index", [f"f{i}" for i in range(4)], size=size)


def plain_kernel(x, epsilon=None):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    epsilon = epsilon or np.median(d[d > 0])
    return np.exp(-d / epsilon), epsilon


@pytest.mark.parametrize("size", [64, 4096])
def test_row_sums(spark, clumps, size):
    got = manifold.kernel_row_sums(packed(spark, clumps, size)).orderBy("recording_id", "window_index").toPandas()
    for name, x in clumps.items():
        k, epsilon = plain_kernel(x)
        part = got[got["recording_id"] == name]
        assert part["window_index"].tolist() == list(range(len(x)))
        np.testing.assert_allclose(part["row_sum"], k.sum(1), rtol=1e-10)
        np.testing.assert_allclose(part["epsilon"], epsilon, rtol=1e-12)


def test_median_of_equal_rows(spark):
    got = manifold.kernel_row_sums(packed(spark, {"a": np.ones((90, 4)), "b": np.ones((9, 4))}, 32)).toPandas()
    assert (got["epsilon"] == 1.0).all() and set(got["row_sum"]) == {90.0, 9.0}


@pytest.mark.parametrize("size", [150, 4096])
def test_diffusion(spark, clumps, size):
    clumps = {"a": clumps["a"][:260], "c": clumps["c"]}
    embedding, values = manifold.diffusion(packed(spark, clumps, size), 3)
    got = embedding.orderBy("recording_id", "window_index").toPandas()
    values = {r["recording_id"]: r["eigenvalues"] for r in values.collect()}
    for name, x in clumps.items():
        k, _ = plain_kernel(x)
        w, v = np.linalg.eig(k / k.sum(1, keepdims=True))
        order = np.argsort(-w.real)[1:4]
        np.testing.assert_allclose(values[name], w.real[order], atol=1e-9)
        want = v.real[:, order] * w.real[order]
        have = got[got["recording_id"] == name][["dim_1", "dim_2", "dim_3"]].to_numpy()
        np.testing.assert_allclose(np.abs(have), np.abs(want), atol=1e-7)


def test_tiny_recordings(spark):
    embedding, _ = manifold.diffusion(packed(spark, {"a": np.arange(8.0).reshape(2, 4), "b": np.ones((1, 4))}, 32), 2)
    rows = embedding.toPandas()
    assert len(rows) == 3 and np.isfinite(rows[["dim_1", "dim_2"]].to_numpy()).all()


def test_squared_distances_of_near_rows(rng):
    x = rng.normal(size=(50, 4)) + 1e4
    y = np.concatenate([x[:5], x[:5] + 1e-7])
    want = ((x[:, None] - y[None]) ** 2).sum(-1)
    got = kernel.squared(x, y)
    assert (got[range(5), range(5)] == 0).all()
    np.testing.assert_allclose(got[range(5), range(5, 10)], want[range(5), range(5, 10)], rtol=1e-9)


def partition(labels):
    return [np.flatnonzero(labels == k).tolist() for k in range(labels.max() + 1)]


@pytest.mark.parametrize("method", ["ward", "average", "complete"])
@pytest.mark.parametrize("size, k", [(100, 5)])
def test_trees(spark, clumps, method, size, k):
    """Many blocks and one task give the same clusters under the same numbers."""
    out = hierarchical(packed(spark, clumps, size), ClusterConfig(n_clusters=k, hierarchical_linkage=method))
    got = out.orderBy("recording_id", "window_index").toPandas()
    for name, x in clumps.items():
        part = got[got["recording_id"] == name]
        assert part["window_index"].tolist() == list(range(len(x)))
        assert partition(part["label"].to_numpy()) == partition(linkage.flat_clusters(x, k, method)), name


def test_tree_order():
    clusters = [(0, 4), (1, 0.5, 1), (1, 0.2, 0), (0, 9)]
    assert linkage.in_tree_order(clusters, [(0, 3), (1, 2), (0, 1)]) == [0, 3, 2, 1]
    assert linkage.in_tree_order([(1, 3.0, 0)], []) == [0]


def test_tiles_take_few_copies(spark, rng):
    """However small the blocks, a row travels to a bounded number of tiles, and every pair meets once."""
    packed_ = packed(spark, {"a": rng.normal(size=(700, 4))}, 4)  # 175 blocks
    tiles = kernel.tiled(packed_, None, lambda own, band: own.iloc[:1].assign(
        pairs=len(own) * len(band), rows=len(own) + len(band))[["i", "j", "pairs", "rows"]],
        "i int, j int, pairs long, rows long").toPandas()
    assert tiles["rows"].sum() <= 16 * 175
    assert (tiles["pairs"] * np.where(tiles["i"] == tiles["j"], 1, 2)).sum() == 175 ** 2


def test_tiles_need_no_dealing_shuffle(spark, rng):
    """Two groups meet where they lie: a pass over the packed groups has no shuffle."""
    packed_ = packed(spark, {"a": rng.normal(size=(700, 4))}, 4)
    sides = kernel.sides(packed_)
    assert sides.count() <= 16
    tiles = kernel.tiled(packed_, None, lambda own, band: own.iloc[:1][["i", "j"]], "i int, j int", packed=sides)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_guessed_sizes_stay_small(spark):
    """Passes that join a state with what was made from it do not square the optimizer's guess of its size."""
    state = spark.range(4).selectExpr("id", "id as v")
    for _ in range(8):
        state = cut_lineage(state.join(state.selectExpr("id", "v as w"), "id").selectExpr("id", "v + w as v"))
    assert state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
    assert sorted(r.v for r in state.collect()) == [0, 256, 512, 768]


def test_digits_of_positive_numbers():
    """A pass takes out only the numbers that have its prefix; the counts are those of their bits."""
    d = np.array([[0.0, 5e-324, 1e-300, 1.0, 1.0 + 2**-40], [np.inf, 3.5, np.nan, 1.7e308, 1.0 + 2**-52]])
    bits = d[d > 0].view(np.uint64)
    for step in range(4):
        for prefix in {int(b) >> (64 - 16 * step) if step else 0 for b in bits}:
            here = [int(b) >> (48 - 16 * step) & 0xFFFF for b in bits if not step or int(b) >> (64 - 16 * step) == prefix]
            assert (kernel.digits_of(d, step, prefix) == np.bincount(here, minlength=1 << 16)).all()


def counted(monkeypatch, name):
    """Calls of a step of the kernel module, as a list that grows."""
    calls, step = [], getattr(kernel, name)
    monkeypatch.setattr(kernel, name, lambda *a, **k: (calls.append(name), step(*a, **k))[1])
    return calls


def test_row_sums_take_few_passes(spark, rng, monkeypatch):
    """The exact median and the sums take two passes over all pairs, after a look at some."""
    tables = {"a": rng.normal(size=(500, 4)), "b": rng.normal(size=(303, 4)) * 3}  # odd numbers of positive distances
    tables["a"][100:110] = tables["a"][50]
    monkeypatch.setattr(kernel, "NARROW", 1e-4, raising=False)  # so few rows have wide bins
    tiles = counted(monkeypatch, "tiled")
    got = manifold.kernel_row_sums(packed(spark, tables, 96)).toPandas()
    assert len(tiles) <= 3
    for name in "ab":
        k, epsilon = plain_kernel(tables[name])
        part = got[got["recording_id"] == name].sort_values("window_index")
        np.testing.assert_allclose(part["epsilon"], epsilon, rtol=1e-13)
        np.testing.assert_allclose(part["row_sum"], k.sum(1), rtol=1e-8)


def walk_of(spark, clumps):
    out = manifold.diffusion(packed(spark, {"a": clumps["a"], "b": clumps["b"]}, 150), 2)
    return out[0].orderBy("recording_id", "window_index").toPandas(), {r["recording_id"]: r["eigenvalues"] for r in out[1].collect()}


def held_against_plain(found, clumps):
    got, values = found
    for name in "ab":
        k, _ = plain_kernel(clumps[name])
        w, v = np.linalg.eig(k / k.sum(1, keepdims=True))
        order = np.argsort(-w.real)[1:3]
        np.testing.assert_allclose(values[name], w.real[order], atol=1e-10)
        have = got[got["recording_id"] == name][["dim_1", "dim_2"]].to_numpy()
        np.testing.assert_allclose(np.abs(have), np.abs(v.real[:, order] * w.real[order]), atol=1e-8)


def test_walk_takes_few_passes(spark, clumps, monkeypatch):
    """Landmarks steer the search, so few images under the whole walk are needed."""
    images = counted(monkeypatch, "applied")
    found = walk_of(spark, clumps)
    assert len(images) <= 6
    held_against_plain(found, clumps)


def test_walk_with_poor_landmarks(spark, clumps, monkeypatch):
    """Landmarks that say little, and brackets that miss, cost passes and not exactness."""
    monkeypatch.setattr(kernel, "RIDGE", 1e3, raising=False)
    monkeypatch.setattr(kernel, "NARROW", 0.0, raising=False)
    tiles = counted(monkeypatch, "tiled")
    held_against_plain(walk_of(spark, clumps), clumps)
    assert len(tiles) > 10


def test_given_width(spark, clumps):
    got = manifold.kernel_row_sums(packed(spark, {"b": clumps["b"]}, 64), 7.5).orderBy("window_index").toPandas()
    assert (got["epsilon"] == 7.5).all()
    np.testing.assert_allclose(got["row_sum"], plain_kernel(clumps["b"], 7.5)[0].sum(1), rtol=1e-12)


@pytest.mark.parametrize("factor", [1.0, -0.3])
def test_products_of_near_rows(rng, factor):
    """Distances come out of one product with the norms; near rows are still taken from their differences."""
    x = rng.normal(size=(300, 4)) + 1e4
    y = np.concatenate([x[:5], x[:5] + 1e-7, rng.normal(size=(1200, 4)) * 1e4])
    want = factor * ((x[:, None] - y[None]) ** 2).sum(-1)
    got, zeros = np.empty(want.shape), 0
    for rows, k, d, n in kernel.products(x, kernel.chunks(y), factor):
        got[rows, k * kernel.CHUNK:k * kernel.CHUNK + d.shape[1]] = d
        zeros += n
    assert zeros == 5 and (got[range(5), range(5)] == 0).all()
    np.testing.assert_allclose(got, want, rtol=1e-8)


def test_bracket_holds_the_median(rng):
    """The bins hold the median of all numbers, drawn or not, also if most are equal; too few numbers give none."""
    for numbers in (rng.gamma(3.0, size=200001), np.where(rng.random(200001) < 0.9, 2.0, 5.0)):
        found = kernel.bracket_of(rng.choice(numbers, 4000))
        assert found["low"] <= np.median(numbers) < found["high"] and 0 < found["bins"] <= (1 << kernel.BINS) + 1
        bits = int(np.median(numbers).view(np.uint64)) >> found["shift"]
        assert 0 <= bits - found["base"] < found["bins"]
    assert kernel.bracket_of(rng.gamma(3.0, size=20)) is None
    assert kernel.bracket_of(np.zeros(0)) is None
