import numpy as np
import pytest

from statewave.config import FilterConfig
from statewave.functions import iir
from statewave.operators import blocks as B
from statewave.operators import filters
from statewave.operators.scan import block_scan
from tests.conftest import signal_frame


def one_way(sections, x, start):
    y = np.asarray(x, dtype=float)
    for (b0, b1, b2, _, a1, a2), (p, q) in zip(sections, start):
        out = np.empty_like(y)
        for i, u in enumerate(y):
            v = b0 * u + p
            p, q = b1 * u - a1 * v + q, b2 * u - a2 * v
            out[i] = v
        y = out
    return y


def both_ways(sections, x, pad):
    """Textbook forward-backward filtering with point-reflected edges."""
    rest, scale = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        g = (b0 + b1 + b2) / (1 + a1 + a2)
        q = b2 - a2 * g
        rest.append(np.array([b1 - a1 * g + q, q]) * scale)
        scale *= g
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    y = one_way(sections, e, [r * e[0] for r in rest])
    return one_way(sections, y[::-1], [r * y[-1] for r in rest])[::-1][pad:-pad]


CASES = [
    (iir.butterworth_bandpass(4, 0.5, 45, 128), iir.bandpass_filter(4, 0.5, 45, 128)),
    (iir.butterworth_bandpass(4, 10, 64 - 1e-3, 128), iir.bandpass_filter(4, 10, 100, 128)),
    (iir.butterworth_bandpass(3, 2, 20, 128), iir.bandpass_filter(3, 2, 20, 128)),
    (iir.notch_section(50, 30, 128), iir.notch_filter(50, 30, 128)),
]


def response(sections, hz, fs):
    z = np.exp(-2j * np.pi * np.asarray(hz) / fs)
    h = np.ones(len(z), complex)
    for b0, b1, b2, _, a1, a2 in sections:
        h *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return np.abs(h)


def test_design():
    for order, low, high in ((4, 0.5, 45), (3, 2, 20), (1, 5, 9)):
        s = iir.butterworth_bandpass(order, low, high, 128)
        edge = response(s, [low, high], 128)
        np.testing.assert_allclose(edge, 1 / np.sqrt(2), rtol=1e-6)
        assert response(s, [np.sqrt(low * high)], 128)[0] > 0.99
    n = iir.notch_section(50, 30, 128)
    assert response(n, [50], 128)[0] < 1e-9 and response(n, [10], 128)[0] > 0.999
    assert iir.bandpass_filter(4, 0, 64, 128) is None
    assert iir.notch_filter(50, 30, 100) is None and iir.notch_filter(None, 30, 100) is None
    with pytest.raises(ValueError):
        iir.bandpass_filter(4, 0, 20, 128)


@pytest.mark.parametrize("sections,flt,block", [(*CASES[0], 4096), (*CASES[1], 300), (*CASES[2], 300), (*CASES[3], 300)])
def test_zero_phase_equals_plain_loop(spark, rng, sections, flt, block):
    x = rng.normal(size=2117) + 3
    df = signal_frame(spark, a=(x, x), b=(x[:701], x[:701]))
    packed = B.signal_blocks(df, B.recording_lengths(df), 2, size=block)
    out = filters.unpack_blocks(filters.zero_phase(packed, "eeg", flt, 2117 // block + 1))
    got = out.orderBy("sample_idx").toPandas()
    for name, y in (("a", x), ("b", x[:701])):
        want = both_ways(sections, y, flt.pad)
        np.testing.assert_allclose(got[got.recording_id == name].eeg, want, atol=1e-8)


def test_block_and_pass_filters_agree(spark, rng):
    x, y = rng.normal(size=(2, 1500))
    df = signal_frame(spark, a=(x, y), b=(x[:200], y[:200]))
    lengths = B.recording_lengths(df)
    frames = []
    for size in (4096, 256):
        packed = B.signal_blocks(df, lengths, 2, size=size)
        out = filters.filter_blocks(packed, 128.0, max(1500 // size, 1), True, FilterConfig())
        frames.append(filters.unpack_blocks(out).orderBy("recording_id", "sample_idx").toPandas())
    np.testing.assert_allclose(frames[0].eeg, frames[1].eeg, atol=1e-8)
    np.testing.assert_allclose(frames[0].emg, frames[1].emg, atol=1e-8)


@pytest.mark.parametrize("algebra", ["linear", "log", "max"])
@pytest.mark.parametrize("reverse", [False, True])
def test_scan_levels_agree(spark, rng, algebra, reverse):
    import pandas as pd

    n, d = 23, 3
    m = rng.normal(size=(n, d, d)) * 0.6
    first = n - 1 if reverse else 0
    frame = pd.DataFrame({"recording_id": "a", "block": np.arange(n), "m": [v.ravel() for v in m]})
    frame["start"] = [rng.normal(size=d) if i == first else None for i in range(n)]
    df = spark.createDataFrame(frame, "recording_id string, block bigint, m array<double>, start array<double>")
    runs = [block_scan(df, (), d, algebra, n, reverse, fanout=f).orderBy("block").toPandas() for f in (512, 4, 2)]
    for other in runs[1:]:
        np.testing.assert_allclose(np.stack(runs[0].carry), np.stack(other.carry), rtol=1e-10)
