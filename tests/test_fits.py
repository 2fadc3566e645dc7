"""Fits of recordings of several blocks: in tasks with a share of the models, and by passes."""

import numpy as np
import pytest
from tests.conftest import feature_frame

from statewave.config import ClusterConfig, HMMConfig
from statewave.operators import blocks as B
from statewave.operators.gmm import gmm
from statewave.operators.hmm import hmm_analysis
from statewave.operators.kmeans import Starts, fit_in_block, fit_kmeans, kmeans

COLS = ["f0", "f1", "f2"]


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


@pytest.fixture(scope="module")
def packed(spark, two_recordings):
    """The same recordings: one of them short, one in blocks; one gathered and one long; all long."""
    table = feature_frame(spark, **two_recordings[0])
    return [B.feature_blocks(table, "window_index", COLS, 100, fit_rows=rows) for rows in (1000, 100)]


@pytest.mark.parametrize("starts", [Starts((3,) * 4, (5,) * 4, True), Starts((2, 4, 3), (1, 2, 3), False)])
def test_shares_of_models_draw_as_all_do(rng, starts):
    x = rng.normal(size=(90, 3))
    every = fit_in_block(x, starts, 30)
    for m in range(len(starts.ks)):
        np.testing.assert_array_equal(fit_in_block(x, starts, 30, [m]), every[list(starts.slots(m))])


def test_kmeans_and_mixture(packed):
    both = []
    for blocks in packed:
        fit = kmeans(blocks, ClusterConfig(kmeans_restarts=4))
        mixed = gmm(blocks, fit.model.select("recording_id", "centroids"))
        both.append([frame.orderBy("recording_id", *more).toPandas() for frame, *more in (
            (fit.model,), (fit.labels, "window_index"), (mixed.model,), (mixed.labels, "window_index"))])
    for one, other in zip(*both):
        for c in one.columns:
            if one[c].dtype == object and c != "recording_id":
                np.testing.assert_allclose(np.stack(one[c]), np.stack(other[c]), atol=1e-8)
            elif one[c].dtype == float:
                np.testing.assert_allclose(one[c], other[c], rtol=1e-9)
            else:
                assert one[c].tolist() == other[c].tolist()


def test_few_jobs(spark, packed):
    """What is fitted in tasks needs no job for a pass; passes need few."""
    cfg = HMMConfig(state_counts=(2, 3), n_restarts=2, max_iterations=12)
    counts, models = [], []
    for blocks in packed:
        before = jobs(spark)
        models.append(hmm_analysis(blocks, 30.0, cfg).models.orderBy("recording_id", "n_states").toPandas())
        counts.append(jobs(spark) - before)
    np.testing.assert_allclose(models[0].log_likelihood, models[1].log_likelihood, rtol=1e-9)
    np.testing.assert_allclose(np.concatenate([np.ravel(m.tolist()) for m in models[0].means]),
                               np.concatenate([np.ravel(m.tolist()) for m in models[1].means]), atol=1e-7)
    assert counts[0] < 40 and counts[1] < 300


def test_recordings_of_every_kind_together(spark, two_recordings):
    """Short, gathered and long recordings in one table equal fits of each alone."""
    x = two_recordings[0]["a"]
    starts = Starts((3, 2), (4, 9), False)
    data = {"short": x[:40], "some": x[:120], "long": x}
    packed = B.feature_blocks(feature_frame(spark, **data), "window_index", COLS, 50, fit_rows=150)
    got = {r["recording_id"]: np.array(r["c"]).reshape(-1, 3) for r in fit_kmeans(packed, starts, 30).collect()}
    for name, rows in data.items():
        np.testing.assert_allclose(got[name], fit_in_block(rows, starts, 30), atol=1e-10)
