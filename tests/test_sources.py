import struct
import zlib

import numpy as np
import pandas as pd
import pytest

from statewave.config import InputConfig
from statewave.sources import arrays, csv, edf
from statewave.sources.demo import synthetic_arrays
from statewave.sources.files import load_signals
from statewave.sources.selectors import normalize_selector, resolve_channel

FS = 128.0
T = np.arange(256) / FS
EEG, EMG = np.sin(2 * np.pi * 5 * T), 0.3 * np.cos(2 * np.pi * 12 * T)


def write_edf(path, channels, seconds=1, records=None, declared=None):
    """``channels``: label -> (values, samples per record)."""
    n = records or len(next(iter(channels.values()))[0]) // next(iter(channels.values()))[1]
    pad = lambda v, w: str(v).ljust(w)[:w].encode("latin-1")
    k = len(channels)
    head = [pad("0", 8), pad("P", 80), pad("R", 80), pad("01.01.26", 8), pad("00.00.00", 8),
            pad(256 + 256 * k, 8), pad("", 44), pad(n if declared is None else declared, 8),
            pad(seconds, 8), pad(k, 4)]
    head += [pad(label, 16) for label in channels]
    for value, width in (("", 80), ("uV", 8), (-200.0, 8), (200.0, 8), (-32768, 8), (32767, 8), ("", 80)):
        head += [pad(value, width)] * k
    head += [pad(per, 8) for _, per in channels.values()] + [pad("", 32)] * k
    with open(path, "wb") as f:
        f.write(b"".join(head))
        for r in range(n):
            for values, per in channels.values():
                part = values[r * per:(r + 1) * per]
                f.write(np.round((part + 200) * 65535 / 400 - 32768).astype("<i2").tobytes())


def write_mat5(path, variables, compressed=False):
    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    with open(path, "wb") as f:
        f.write(b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM")
        for name, x in variables.items():
            x = np.atleast_2d(x)
            body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *x.shape))
            small = struct.pack("<HH", 1, len(name)) + name.encode().ljust(4, b"\0") if len(name) <= 4 else element(1, name.encode())
            body += small + element(9, x.astype("<f8").tobytes(order="F"))
            full = element(14, body)
            f.write(struct.pack("<II", 15, len(zlib.compress(full))) + zlib.compress(full) if compressed else full)


def values(signal):
    frame = signal.samples.orderBy("recording_id", "sample_idx").toPandas()
    assert frame.sample_idx.tolist() == list(range(len(frame)))
    return frame


def test_csv_with_header(spark, tmp_path):
    path = tmp_path / "s.csv"
    pd.DataFrame({"time": T, "EEG": EEG, "Emg": EMG}).to_csv(path, index=False)
    s = load_signals(spark, str(path), FS)
    got = values(s)
    np.testing.assert_allclose(got.eeg, EEG)
    np.testing.assert_allclose(got.emg, EMG)
    assert s.has_emg and s.fs == FS
    picked = load_signals(spark, str(path), FS, InputConfig(csv_eeg_column="emg", csv_emg_column="nope"))
    assert not picked.has_emg
    np.testing.assert_allclose(values(picked).eeg, EMG)
    with pytest.raises(ValueError):
        load_signals(spark, str(path), FS, InputConfig(csv_eeg_column="nope"))
    with pytest.raises(ValueError):
        load_signals(spark, str(path))


def test_csv_without_header_uses_first_column_twice(spark, tmp_path):
    path = tmp_path / "plain.csv"
    pd.DataFrame(EEG).to_csv(path, index=False, header=False)
    got = values(load_signals(spark, str(path), FS))
    np.testing.assert_allclose(got.eeg, EEG)
    np.testing.assert_allclose(got.emg, EEG)


def test_csv_holes_shift_channels(spark, tmp_path):
    path = tmp_path / "holes.csv"
    path.write_text("\neeg;emg\n1;10\nbad;20\n3;\n4;40\n5;50\n")
    got = values(load_signals(spark, str(path), FS))
    assert got.eeg.tolist() == [1, 3, 4, 5] and got.emg.tolist() == [10, 20, 40, 50]


def test_csv_positions(spark, tmp_path):
    path = tmp_path / "cols.csv"
    pd.DataFrame({0: T, 1: EEG, 2: EMG}).to_csv(path, index=False, header=False, sep="\t")
    got = values(load_signals(spark, str(path), FS, InputConfig(csv_eeg_column="1", csv_emg_column=2)))
    np.testing.assert_allclose(got.eeg, EEG)
    np.testing.assert_allclose(got.emg, EMG)


def test_sniffing():
    assert csv.sniff_separator(["", " a;b;c, "]) == ";"
    assert csv.sniff_separator(["1.0"]) == "," and csv.sniff_separator([]) == ","
    assert csv.sniff_separator(["a b,c"]) == ","
    assert csv.sniff_header(["eeg,emg", "1,2"], ",") and not csv.sniff_header(["1,2e-3"], ",")
    assert csv.sniff_header(["1,x"], ",")


def test_selectors():
    assert normalize_selector(" 3 ") == 3 and normalize_selector(" a ") == "a" and normalize_selector(None) is None
    labels = ["EOG", "EEG Fpz-Cz", "EEG", "EMG Chin"]
    assert resolve_channel(labels, None, "eeg", True) == 1
    assert resolve_channel(labels, "eeg", "eeg", True) == 2
    assert resolve_channel(labels, "chin", "emg", False) == 3
    assert resolve_channel(labels, "0", "eeg", True) == 0
    assert resolve_channel(["A", "B"], None, "eeg", True) == 0
    assert resolve_channel(["A", "B"], None, "emg", False) is None
    for bad in ("nope", 9):
        with pytest.raises(ValueError):
            resolve_channel(labels, bad, "eeg", True)


@pytest.mark.parametrize("compressed", [False, True])
def test_mat(spark, tmp_path, compressed):
    path = tmp_path / "s.mat"
    write_mat5(path, {"none": np.empty((0, 0)), "emg_signal": EEG, "x": EMG}, compressed)
    s = load_signals(spark, str(path), FS)
    np.testing.assert_allclose(values(s).eeg, EEG)
    assert not s.has_emg
    named = load_signals(spark, str(path), FS, InputConfig(mat_variable="x"))
    np.testing.assert_allclose(values(named).eeg, EMG)
    with pytest.raises(ValueError):
        load_signals(spark, str(path), FS, InputConfig(mat_variable="nope"))


def test_mat_level4_and_73(tmp_path):
    path = tmp_path / "old.mat"
    path.write_bytes(struct.pack("<5i", 0, 1, 256, 0, 4) + b"eeg\0" + EEG.astype("<f8").tobytes())
    np.testing.assert_allclose(arrays.read_mat(str(path), None), EEG)
    new = tmp_path / "new.mat"
    new.write_bytes(b"MATLAB 7.3 MAT-file".ljust(512))
    with pytest.raises((ValueError, OSError)):
        arrays.read_mat(str(new), None)


@pytest.mark.parametrize("writer", [np.savez, np.savez_compressed])
def test_npz_rate_wins(spark, tmp_path, writer):
    path = tmp_path / "s.npz"
    writer(path, eeg=EEG[None, :], emg=EMG.astype("float32"), fs=64.0)
    s = load_signals(spark, str(path), 999.0)
    assert s.fs == 64.0 and s.has_emg
    got = values(s)
    np.testing.assert_allclose(got.eeg, EEG)
    np.testing.assert_allclose(got.emg, EMG.astype("float32"))


def test_npy_in_ranges(spark, tmp_path):
    path = tmp_path / "s.npy"
    np.save(path, (EEG * 1000).astype("int16"))
    from statewave.sources.files import RecordingSource

    spark.dataSource.register(RecordingSource)
    df = spark.read.format("recording").options(path=str(path), samplesPerTask="100").load()
    assert df.rdd.getNumPartitions() == 3
    got = df.orderBy("sample_idx").toPandas()
    assert got.eeg.tolist() == (EEG * 1000).astype("int16").tolist() and got.emg.isna().all()


def test_edf(spark, tmp_path):
    path = tmp_path / "s.edf"
    write_edf(path, {"EEG Fpz-Cz": (EEG, 128), "EMG Chin": (EMG, 128)})
    s = load_signals(spark, str(path))
    got = values(s)
    assert s.fs == FS and s.has_emg and len(got) == 256
    np.testing.assert_allclose(got.eeg, EEG, atol=0.004)
    np.testing.assert_allclose(got.emg, EMG, atol=0.004)
    head = edf.read_header(str(path))
    np.testing.assert_array_equal(edf.read_samples(str(path), head, 0, 100, 200), got.eeg[100:200])
    write_edf(path, {"EEG": (EEG, 128)}, declared=-1)
    assert edf.read_header(str(path)).records == 2
    write_edf(path, {"EEG": (EEG, 128)}, declared=5)
    with pytest.raises(ValueError):
        edf.read_header(str(path))


def test_edf_two_rates(spark, tmp_path):
    path = tmp_path / "two.edf"
    slow = 0.5 * np.sin(2 * np.pi * 3 * np.arange(640) / 64.0)
    long = np.sin(2 * np.pi * 5 * np.arange(1280) / 128.0)
    write_edf(path, {"EEG": (long, 128), "EMG": (slow, 64)}, records=10)
    got = values(load_signals(spark, str(path)))
    want = 0.5 * np.sin(2 * np.pi * 3 * np.arange(1280) / 128.0)
    assert len(got) == 1280
    np.testing.assert_allclose(got.emg[60:-60], want[60:-60], atol=0.01)
    x = np.random.default_rng(0).normal(size=500)
    r = edf.Resampler(100, 64)
    n = r.length(500)
    whole = r.outputs(x, 0, 0, n)
    parts = []
    for a in range(0, n, 97):
        b = min(a + 97, n)
        i, j = r.needs(a, b)
        parts.append(r.outputs(x[i:min(j, 500)], i, a, b))
    np.testing.assert_allclose(np.concatenate(parts), whole, atol=1e-12)
    assert r.outputs(np.ones(500), 0, 200, 400) == pytest.approx(np.ones(200), abs=5e-3)


def test_formats(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("1")
    with pytest.raises(ValueError):
        load_signals(spark, str(path), 1.0)


def test_several_files_are_several_recordings(spark, tmp_path):
    for i in range(3):
        np.savez(tmp_path / f"r{i}.npz", eeg=EEG * i, fs=FS)
    s = load_signals(spark, str(tmp_path / "r*.npz"))
    counts = s.samples.groupBy("recording_id").count().orderBy("recording_id").collect()
    assert [(r[0], r[1]) for r in counts] == [(f"r{i}.npz", 256) for i in range(3)]
    np.savez(tmp_path / "r9.npz", eeg=EEG, fs=1.0)
    with pytest.raises(ValueError):
        load_signals(spark, str(tmp_path / "r*.npz"))


def test_equal_names_in_two_folders(spark, tmp_path):
    for k, folder in enumerate(("s1", "s2")):
        (tmp_path / folder).mkdir()
        np.savez(tmp_path / folder / "rec.npz", eeg=np.arange(50.0) + k, fs=10.0)
        (tmp_path / folder / "rec.csv").write_text("eeg,emg\n" + "\n".join(f"{i + k},{i}" for i in range(20)))
    rows = load_signals(spark, str(tmp_path / "*" / "rec.npz")).samples.groupBy("recording_id").count().collect()
    assert sorted(map(tuple, rows)) == [("s1/rec.npz", 50), ("s2/rec.npz", 50)]
    rows = csv.read_csv(spark, str(tmp_path / "*" / "rec.csv")).groupBy("recording_id").count().collect()
    assert sorted(map(tuple, rows)) == [("s1/rec.csv", 20), ("s2/rec.csv", 20)]


def test_demo_is_seeded():
    eeg, emg = synthetic_arrays(128.0, 30.0, 7)
    again, _ = synthetic_arrays(128.0, 30.0, 7)
    assert len(eeg) == len(emg) == 3840 and (eeg == again).all()
    rng = np.random.default_rng(7)
    first = rng.standard_normal(1280)
    assert eeg[0] == pytest.approx(0.15 * first[0])
    rng.standard_normal(2560)
    assert emg[0] == pytest.approx(0.15 * rng.standard_normal(1280)[0])
