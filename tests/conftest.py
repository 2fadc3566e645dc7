import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from statewave.session import get_spark

    session = get_spark("statewave-tests", cores="*", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rng():
    return np.random.default_rng(11)


def signal_frame(spark, **recordings):
    """Long signal from ``name=(eeg, emg)`` arrays."""
    parts = []
    for name, (eeg, emg) in recordings.items():
        parts.append(pd.DataFrame({"recording_id": name, "sample_idx": np.arange(len(eeg)),
                                   "eeg": eeg, "emg": emg}))
    return spark.createDataFrame(
        pd.concat(parts), "recording_id string, sample_idx bigint, eeg double, emg double")


def feature_frame(spark, **recordings):
    """Feature table from ``name=matrix``: columns f0, f1, ..."""
    parts = []
    for name, x in recordings.items():
        part = pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])])
        part.insert(0, "window_index", np.arange(len(x)))
        part.insert(0, "recording_id", name)
        parts.append(part)
    return spark.createDataFrame(pd.concat(parts))


@pytest.fixture(scope="session")
def two_recordings(rng):
    """Three drifting states; the second recording is the start of the first."""
    n = 260
    state = (np.arange(n) // 17) % 3
    x = rng.normal(size=(n, 3)) * (0.6 + 0.2 * state[:, None]) + state[:, None] * np.array([1.0, -0.5, 0.3])
    return {"a": x, "b": x[:90]}, state
