"""Scans over many short recordings."""

import numpy as np
import pandas as pd
import pytest

from statewave.operators.scan import block_scan


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("fanout", [512, 3])
def test_many_recordings_in_a_task(spark, rng, reverse, fanout):
    m = rng.normal(size=(60, 7, 2, 2)) * 0.6
    length = rng.integers(1, 8, 60)
    rows, want = [], {}
    for r, n in enumerate(length):
        state = np.array([1.0, -0.5 * r])
        order = range(n)[::-1] if reverse else range(n)
        for b in order:
            rows.append((f"r{r}", b, [1.0, -0.5 * r] if b == order[0] else None, m[r, b].ravel().tolist()))
            want[f"r{r}", b] = state
            state = state @ m[r, b]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["recording_id", "block", "start", "m"]).sample(frac=1, random_state=3),
                                  "recording_id string, block bigint, start array<double>, m array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        out = block_scan(table, (), 2, "linear", 7, reverse, fanout)
        got = {(r["recording_id"], r["block"]): r["carry"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys()
    for key, state in want.items():
        np.testing.assert_allclose(got[key], state, rtol=1e-12)
    # a call for every recording costs more than its few blocks
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().simpleString() or fanout < 7
