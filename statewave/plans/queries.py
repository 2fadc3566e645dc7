"""Named queries over the given tables, one per operator.

The signal is the events table: ``value`` as EEG and ``props.k`` as EMG at 10 samples per
second, either as one recording or as one recording per user. The embeddings table serves
as a ready-made feature matrix with reference labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statewave.config import ClusterConfig, ExplainConfig, FeatureConfig, FilterConfig, HMMConfig
from statewave.functions.iir import bandpass_filter, notch_filter
from statewave.operators import (align, blocks as B, explain as X, features as FT, filters, gmm as G,
                                 hierarchical as H, hmm as M, index, kmeans as K, manifold as P,
                                 metrics, scaling, summary, timedomain, windows)
from statewave.sources.csv import pair_channels
from statewave.sources.events import EVENT_FS, events_signal

FS = EVENT_FS
PLAN = windows.plan_windows(10.0, 5.0, FS)  # 100 samples, hop 50
REC = B.REC
DIMS = 64
EMB = [f"d{i}" for i in range(DIMS)]
STATES = 3
# Fixed model for the scoring queries: three states on a standardised signal.
MODEL_MEANS = (-1.0, 0.0, 1.0)
MODEL_VARIANCE = 0.5
MODEL_STAY, MODEL_MOVE = 0.8, 0.1
# Filters of the per-user filter queries, inside the 5 Hz Nyquist limit of the events.
QUERY_BAND = (0.5, 4.0)
QUERY_NOTCH, QUERY_QUALITY = 2.5, 30.0
# Block sizes of the queries named *_blocks: they run what recordings of many blocks run.
FEW_ROWS, FEW_STEPS, FEW_SAMPLES = 48, 16, 28


def r(column, digits: int = 6):
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def signal(spark: SparkSession, d: str) -> DataFrame:
    return events_signal(spark, d)


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embedding vectors as one column per dimension."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.lit("all").alias(REC), F.col("vec_id").alias("window_index"),
                    F.col("label").cast("int").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(EMB)])


def embedding_blocks(spark: SparkSession, d: str, size: int = B.ROW_BLOCK) -> B.Blocks:
    return B.feature_blocks(embeddings(spark, d), "window_index", EMB, size)


def embedding_labels(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).select(REC, "window_index", F.lit("given").alias("method"), "label")


def features(spark: SparkSession, d: str, mode: str = "full", scaling_: str = "zscore",
             materialise=None) -> FT.Features:
    cut = windows.window_arrays(signal(spark, d), PLAN)
    cfg = FeatureConfig(mode=mode, scaling=scaling_)
    return FT.extract_features(cut, PLAN, FS, 1, cfg, has_emg=True, materialise=materialise)


def scaled_features(spark: SparkSession, d: str) -> FT.Features:
    return features(spark, d, materialise=B.cut_lineage)


def feature_matrix(spark: SparkSession, d: str) -> B.Blocks:
    f = scaled_features(spark, d)
    return B.feature_blocks(f.scaled, "window_index", f.names)


def time_table(spark: SparkSession, d: str) -> DataFrame:
    return timedomain.time_features(signal(spark, d), PLAN, FS, "eeg")


def window_labels(spark: SparkSession, d: str) -> DataFrame:
    """Two simple labellings of the windows, from the peak counts of both channels."""
    eeg = time_table(spark, d).select(
        REC, "window_index", F.lit("kmeans").alias("method"),
        (F.col("eeg_peak_count").cast("int") % STATES).alias("label"))
    emg = timedomain.time_features(signal(spark, d), PLAN, FS, "emg").select(
        REC, "window_index", F.lit("gmm").alias("method"),
        (F.col("emg_peak_count").cast("int") % STATES).alias("label"))
    return eeg.unionByName(emg)


# --- sources and signal -----------------------------------------------------------------

def csv_channels(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    text = e.select(
        F.lit("all").alias(REC), "event_id",
        F.when(F.col("event_id") % 7 == 3, "n/a").otherwise(F.col("value").cast("string")).alias("a"),
        F.when(F.col("event_id") % 5 == 2, "").otherwise(F.get_json_object("props", "$.k")).alias("b"))
    return rounded(pair_channels(text, "event_id", F.col("a"), F.col("b")), ["eeg", "emg"])


def signal_zscore(spark, d):
    return rounded(scaling.zscore_signal(signal(spark, d), ["eeg", "emg"], 1), ["eeg", "emg"])


def signal_by_user(spark, d):
    return rounded(events_signal(spark, d, by="user"), ["eeg"])


def _user_filter(spark, d, flt, size=B.SIGNAL_BLOCK):
    s = B.cut_lineage(events_signal(spark, d, by="user"))
    lengths = B.cut_lineage(B.recording_lengths(s))
    n, top = lengths.agg(F.count(F.lit(1)), F.max("n_rows")).first()
    packed = B.cut_lineage(B.signal_blocks(s, lengths, n, size))
    out = filters.apply_filters(packed, {"eeg": [flt]}, max(top // size, 1), B.cut_lineage)
    return out.select(REC, "start_idx", F.posexplode("eeg").alias("i", "v")).select(
        REC, (F.col("start_idx") + F.col("i")).alias("sample_idx"), r("v", 5).alias("eeg"))


def filter_bandpass(spark, d):
    return _user_filter(spark, d, bandpass_filter(4, *QUERY_BAND, FS))


def filter_notch(spark, d):
    return _user_filter(spark, d, notch_filter(QUERY_NOTCH, QUERY_QUALITY, FS))


def filter_bandpass_blocks(spark, d):
    return _user_filter(spark, d, bandpass_filter(4, *QUERY_BAND, FS), FEW_SAMPLES)


def filter_notch_blocks(spark, d):
    return _user_filter(spark, d, notch_filter(QUERY_NOTCH, QUERY_QUALITY, FS), FEW_SAMPLES)


def signal_preprocess(spark, d):
    s = signal(spark, d)
    lengths = B.cut_lineage(B.recording_lengths(s))
    top = lengths.agg(F.max("n_rows")).first()[0]
    packed = B.cut_lineage(B.signal_blocks(s, lengths, 1))
    cfg = FilterConfig(eeg_band=QUERY_BAND, emg_band=(1.0, 100.0), notch_freq=QUERY_NOTCH)
    out = filters.filter_blocks(packed, FS, max(top // B.SIGNAL_BLOCK, 1), True, cfg, B.cut_lineage)
    flat = filters.unpack_blocks(out)
    return scaling.zscore_signal(flat, ["eeg", "emg"], 1)


# --- windows ------------------------------------------------------------------------------

def _window_ranges(spark, d, plan):
    return (
        windows.assign_windows(signal(spark, d), plan).groupBy("window_index")
        .agg(F.min("sample_idx").alias("start_idx"), F.max("sample_idx").alias("end_idx"),
             F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == plan.size)
        .withColumn("start_time_sec", r(F.col("start_idx") / FS))
    )


def windows_tumbling(spark, d):
    return _window_ranges(spark, d, windows.plan_windows(10.0, 0.0, FS))


def windows_overlapping(spark, d):
    return _window_ranges(spark, d, PLAN)


def windows_spaced(spark, d):
    return _window_ranges(spark, d, windows.plan_windows(4.0, -3.0, FS))


def windows_auto(spark, d):
    size = F.least(F.floor(F.col("n_rows") / 20), F.lit(int(FS * 0.1)))
    return B.recording_lengths(signal(spark, d)).select(
        "n_rows", size.cast("bigint").alias("window_size"),
        F.floor(size * 0.25).cast("bigint").alias("overlap"))


def window_metadata(spark, d):
    index_ = time_table(spark, d).select(REC, "window_index")
    return rounded(windows.window_times(index_, PLAN, FS, 10.0),
                   ["start_time_sec", "end_time_sec"])


def window_matrix(spark, d):
    """Windows as arrays, checked through position-weighted sums."""
    cut = windows.window_arrays(signal(spark, d), PLAN)
    weigh = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0),
                                  lambda a, v: a + v)
    return cut.select("window_index", F.size("eeg").alias("size"), r(weigh("eeg"), 3).alias("eeg"),
                      r(weigh("emg"), 3).alias("emg"))


# --- features -----------------------------------------------------------------------------

def time_features_eeg(spark, d):
    t = time_table(spark, d)
    return rounded(t, t.columns[2:])


def time_features_emg(spark, d):
    t = timedomain.time_features(signal(spark, d), PLAN, FS, "emg")
    return rounded(t, t.columns[2:])


def spectrum_power(spark, d):
    f = features(spark, d)
    return f.spectra.select("window_index", F.posexplode("power").alias("bin", "power")).select(
        "window_index", F.col("bin").cast("bigint").alias("bin"),
        r(F.col("bin") * (FS / PLAN.size)).alias("freq"), r("power", 4).alias("power"))


def spectrum_features(spark, d):
    f = features(spark, d)
    names = ["eeg_total_power", "eeg_dominant_frequency", "eeg_spectral_entropy"]
    return rounded(f.raw.select("window_index", *names), names, 5)


def band_features(spark, d):
    f = features(spark, d)
    names = [n for n in f.names if n.endswith(("_ratio",)) or "_power" in n and n != "eeg_total_power"]
    return rounded(f.raw.select("window_index", *names), names, 5)


def features_full_zscore(spark, d):
    f = features(spark, d)
    return rounded(f.scaled.drop(REC), f.names, 5)


def features_full_minmax(spark, d):
    f = features(spark, d, scaling_="minmax")
    return rounded(f.scaled.drop(REC), f.names, 5)


def features_legacy_minmax(spark, d):
    f = features(spark, d, mode="legacy", scaling_="minmax")
    return rounded(f.scaled.drop(REC), f.names, 5)


def features_inverse_scaling(spark, d):
    f = features(spark, d)
    joined = f.scaled.join(f.scaler, REC)
    names = [n for n in f.names if n.endswith(("_energy", "_peak_to_peak"))]
    return joined.select("window_index", *[
        r(scaling.inverse_scale(F.col(n), F.col(f"center_{n}"), F.col(f"scale_{n}")), 6).alias(n)
        for n in names])


# --- clustering ---------------------------------------------------------------------------

def _first_rows_model(b: B.Blocks, k: int = STATES) -> DataFrame:
    """Centres taken from the first ``k`` rows, as a fixed model."""
    return b.df.filter("block = 0").select(REC, F.slice("x", 1, k * b.width).alias("centroids"))


def nearest_centroid(spark, d):
    b = embedding_blocks(spark, d)
    return K.assign_rows(b, _first_rows_model(b), STATES).drop(REC)


def _one_step(b: B.Blocks) -> DataFrame:
    starts = K.Starts((STATES,), (0,), shared=True)
    nothing = F.array().cast("array<double>")
    state = _first_rows_model(b).select(REC, F.col("centroids").alias("c"))
    parts = b.with_state(state, 8 * b.width * STATES).select(
        REC, K._lloyd(starts, b.width)("x", "c", nothing).alias("v"))
    return state.join(B.sum_vectors(parts, "v"), REC).select(REC, K._recentre(starts, b.width)(
        "c", F.array(F.lit(0.0)), "stats", nothing).alias("n")).select(REC, "n.c")


def lloyd_step(spark, d, size=B.ROW_BLOCK):
    b = embedding_blocks(spark, d, size)
    return _one_step(b).select(F.posexplode("c").alias("p", "value")).select(
        F.floor(F.col("p") / DIMS).cast("bigint").alias("cluster"),
        (F.col("p") % DIMS).cast("bigint").alias("dim"), r("value").alias("value"))


def lloyd_step_blocks(spark, d):
    return lloyd_step(spark, d, FEW_ROWS)


def kmeans_inertia(spark, d, size=B.ROW_BLOCK):
    b = embedding_blocks(spark, d, size)
    fits = _first_rows_model(b).select(REC, F.col("centroids").alias("c"))
    return K.best_restart(b, fits, K.Starts((STATES,), (0,), shared=True)).select(
        r("inertia", 4).alias("inertia"))


def kmeans_inertia_blocks(spark, d):
    return kmeans_inertia(spark, d, FEW_ROWS)


def _gmm_one_step(spark, d, size=B.ROW_BLOCK) -> tuple[DataFrame, B.Blocks]:
    b = embedding_blocks(spark, d, size)
    cfg = ClusterConfig(n_clusters=STATES, gmm_iterations=1)
    return G.gmm(b, _first_rows_model(b), cfg).model, b


def gmm_em_step(spark, d, size=B.ROW_BLOCK):
    model, _ = _gmm_one_step(spark, d, size)
    both = F.arrays_zip(F.col("means").alias("mean"), F.col("variances").alias("variance"))
    return model.select("weights", F.posexplode(both).alias("p", "v")).select(
        F.floor(F.col("p") / DIMS).cast("bigint").alias("component"),
        (F.col("p") % DIMS).cast("bigint").alias("dim"),
        r(F.col("weights")[F.floor(F.col("p") / DIMS).cast("int")]).alias("weight"),
        r("v.mean").alias("mean"), r("v.variance").alias("variance"))


def gmm_em_step_blocks(spark, d):
    return gmm_em_step(spark, d, FEW_ROWS)


def gmm_information_criteria(spark, d):
    model, _ = _gmm_one_step(spark, d)
    return rounded(model.select("log_likelihood", "aic", "bic"), ["log_likelihood", "aic", "bic"], 3)


def kmeans_fit(spark, d):
    fit = K.kmeans(feature_matrix(spark, d))
    return fit.labels


def gmm_fit(spark, d):
    b = feature_matrix(spark, d)
    fit = K.kmeans(b)
    return G.gmm(b, fit.model.select(REC, "centroids")).labels


def hierarchical_fit(spark, d):
    return H.hierarchical(feature_matrix(spark, d))


# --- cluster quality ----------------------------------------------------------------------

def silhouette(spark, d):
    e = embeddings(spark, d)
    return rounded(metrics.full_silhouette(e, EMB, embedding_labels(spark, d)).drop(REC), ["silhouette"])


def davies_bouldin(spark, d):
    return rounded(metrics.davies_bouldin(embeddings(spark, d).drop("label"), EMB,
                                          embedding_labels(spark, d)).drop(REC), ["davies_bouldin"])


def balance_entropy(spark, d):
    return rounded(metrics.balance_entropy(embedding_labels(spark, d)).drop(REC),
                   ["balance_entropy"])


def average_spectra(spark, d):
    f = features(spark, d)
    out = metrics.average_spectra(f.spectra, window_labels(spark, d), STATES)
    return out.select("method", "label", F.col("bin").cast("bigint").alias("bin"),
                      r("power", 4).alias("power"))


# --- alignment ----------------------------------------------------------------------------

def _alignment(spark, d):
    return align.align_cluster_labels(window_labels(spark, d), STATES, "kmeans", ["kmeans", "gmm"])


def label_confusion(spark, d):
    return _alignment(spark, d).before.drop(REC)


def label_matching(spark, d):
    """The matched crosstab's trace, which is unique even where the matching is not."""
    after = _alignment(spark, d).after
    return after.filter("ref_label = label").groupBy("method").agg(F.sum("n").alias("agreement"))


def label_relabel(spark, d):
    a = _alignment(spark, d)
    return a.labels.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("aligned_label").alias("labels"))


# --- hidden Markov models -----------------------------------------------------------------

def _user_model(spark, d, size=B.ROW_BLOCK) -> tuple[B.Blocks, DataFrame, M.Family]:
    raw = B.cut_lineage(events_signal(spark, d, by="user"))
    s = scaling.zscore_signal(raw, ["eeg"], raw.select(REC).distinct().count())
    b = B.feature_blocks(s, "sample_idx", ["eeg"], size)
    fam = M.Family((STATES,), 1)
    a = np.full((1, STATES, STATES), MODEL_MOVE) + np.eye(STATES) * (MODEL_STAY - MODEL_MOVE)
    p = fam.pack(np.full((1, STATES), 1.0 / STATES), a, np.array(MODEL_MEANS).reshape(1, STATES, 1),
                 np.full((1, STATES, 1), MODEL_VARIANCE))
    return b, b.lengths.select(REC, F.array(*[F.lit(float(v)) for v in p]).alias("p")), fam


def hmm_log_emission(spark, d):
    b, p, fam = _user_model(spark, d)
    return M.log_emissions(b, p, fam).select(
        REC, F.col("window_index").alias("sample_idx"), "state", r("log_density").alias("log_density"))


def hmm_forward_likelihood(spark, d, size=B.ROW_BLOCK):
    b, p, fam = _user_model(spark, d, size)
    return rounded(M.log_likelihood(b, p, fam).drop("n_states"), ["log_likelihood"], 5)


def hmm_forward_blocks(spark, d):
    return hmm_forward_likelihood(spark, d, FEW_STEPS)


def hmm_viterbi(spark, d, size=B.ROW_BLOCK):
    b, p, fam = _user_model(spark, d, size)
    return M.decode(b, p, fam).select(REC, F.col("window_index").alias("sample_idx"),
                                      F.col("hidden_state").alias("state"))


def hmm_viterbi_blocks(spark, d):
    return hmm_viterbi(spark, d, FEW_STEPS)


def _level(spark, d) -> DataFrame:
    """A coarse state per sample of the whole signal."""
    return signal(spark, d).select(REC, "sample_idx", F.when(F.col("eeg") < 20, 0).when(
        F.col("eeg") < 60, 1).otherwise(2).alias("state"))


def hmm_run_lengths(spark, d):
    return index.run_lengths(_level(spark, d), REC, "sample_idx", "state").drop(REC)


def hmm_durations(spark, d):
    runs = index.run_lengths(_level(spark, d), REC, "sample_idx", "state")
    return runs.groupBy("state").agg(
        F.count(F.lit(1)).alias("runs"), r(F.avg(F.col("run_length") / FS)).alias("mean_duration_sec"),
        r(F.max(F.col("run_length") / FS)).alias("longest_sec"))


def hmm_transitions(spark, d):
    return rounded(index.transition_matrix(_level(spark, d), REC, "sample_idx", "state")
                   .drop(REC), ["probability"])


def hmm_self_transition(spark, d):
    t = index.transition_matrix(_level(spark, d), REC, "sample_idx", "state", n_states=STATES)
    return t.filter("from_state = to_state").agg(r(F.avg("probability")).alias("mean_self_transition"))


def hmm_bic(spark, d):
    b, p, fam = _user_model(spark, d)
    n_params = (STATES - 1) + STATES * (STATES - 1) + 2 * STATES * b.width
    ll = M.log_likelihood(b, p, fam).join(b.lengths, REC)
    bic = -2.0 * F.col("log_likelihood") + float(n_params) * F.log(F.col("n_rows").cast("double"))
    return ll.select(REC, "n_states", r(bic, 4).alias("bic"))


def hmm_fit_compare(spark, d):
    fit = M.hmm_analysis(feature_matrix(spark, d), 10.0, HMMConfig())
    return fit.models.select("n_states", "log_likelihood", "bic", "mean_self_transition").orderBy(
        "n_states")


# --- embeddings ---------------------------------------------------------------------------

def pca_covariance(spark, d, size=B.ROW_BLOCK):
    cov = P.covariance(embedding_blocks(spark, d, size))
    return cov.select(F.posexplode("cov").alias("p", "value")).select(
        F.floor(F.col("p") / DIMS).cast("bigint").alias("i"),
        (F.col("p") % DIMS).cast("bigint").alias("j"), r("value", 8).alias("value"))


def pca_covariance_blocks(spark, d):
    return pca_covariance(spark, d, FEW_ROWS)


def pca_embedding(spark, d):
    return P.pca(feature_matrix(spark, d), 2)[0]


def diffusion_kernel(spark, d, size=B.ROW_BLOCK):
    return rounded(P.kernel_row_sums(embedding_blocks(spark, d, size)).drop(REC), ["epsilon", "row_sum"])


def diffusion_kernel_blocks(spark, d):
    return diffusion_kernel(spark, d, FEW_ROWS)


def diffusion_embedding(spark, d):
    return P.manifold(feature_matrix(spark, d)).embedding


# --- explanations -------------------------------------------------------------------------

def _explain_rows(spark, d) -> DataFrame:
    return embeddings(spark, d).select(
        REC, "window_index", F.lit("given").alias("method"), "label",
        F.array(*EMB).alias("x"), F.lit("").alias("path"))


CLASSES = 10


def _root_counts(spark, d):
    rows = _explain_rows(spark, d)
    n = rows.count()
    return rows, X.binned_counts(rows, CLASSES, ExplainConfig().threshold_candidates, n)


def split_candidates(spark, d):
    _, counts = _root_counts(spark, d)
    order = W.partitionBy("f").orderBy("threshold")  # at most 32 rows
    return counts.select(F.concat(F.lit("d"), "f").alias("feature"),
                         (F.row_number().over(order) - 1).cast("bigint").alias("i"), r("threshold").alias("threshold"))


def best_split(spark, d):
    rows, counts = _root_counts(spark, d)
    nodes = X.node_counts(rows, CLASSES)
    return X.best_splits(counts, nodes, CLASSES, 10).select(
        F.col("f").cast("bigint").alias("feature"), r("threshold").alias("threshold"),
        r("gain").alias("gain"))


def f1_thresholds(spark, d):
    rows, counts = _root_counts(spark, d)
    return X.f1_thresholds(counts, X.node_counts(rows, CLASSES), CLASSES).select(
        F.col("cluster").cast("bigint").alias("cluster"), F.col("f").cast("bigint").alias("feature"),
        "direction", r("threshold").alias("threshold"), r("score").alias("score_f1"))


def _explain(spark, d, depth: int):
    e = embeddings(spark, d).drop("label")
    scaler = scaling.fit_scaler(e, EMB)
    scaled = scaling.apply_scaler(e, scaler, EMB, 1)
    return X.explain(e, scaled, scaler, EMB, embedding_labels(spark, d), CLASSES,
                     ExplainConfig(max_depth=depth))


def tree_stump_predictions(spark, d):
    return _explain(spark, d, 1).predictions.select("window_index", "label", "predicted")


def tree_stump_fidelity(spark, d):
    return rounded(_explain(spark, d, 1).fidelity.select("fidelity"), ["fidelity"])


def tree_nodes(spark, d):
    return _explain(spark, d, 3).nodes.drop("gain")


def tree_thresholds(spark, d):
    return _explain(spark, d, 1).thresholds


# --- summaries ----------------------------------------------------------------------------

def minmax_pyramid(spark, d):
    s = signal(spark, d)
    n = s.agg(F.max("sample_idx") + 1).first()[0]
    return rounded(summary.minmax_pyramid(s, "eeg", summary.pyramid_blocks(n, 2000)).drop(REC),
                   ["low", "high"])


def quantised_signal(spark, d):
    s = signal(spark, d)
    return summary.quantise_column(s, ["eeg"], "eeg", s, 1).select("sample_idx", "eeg")


def feature_histograms(spark, d):
    t = time_table(spark, d)
    cells = summary.unpivot(t, t.columns[2:], [REC])
    return summary.histogram(cells, ["feature"], "value", 30)


def feature_box_stats(spark, d):
    t = time_table(spark, d)
    names = t.columns[2:]
    labels = window_labels(spark, d).filter("method = 'kmeans'").select(REC, "window_index", "label")
    cells = summary.unpivot(t.join(labels, [REC, "window_index"]), names, ["label"])
    out = summary.box_stats(cells, ["feature", "label"], "value", t.count())
    return rounded(out, out.columns[2:], 8)


def _threshold_table(spark, d):
    rows, counts = _root_counts(spark, d)
    return X.f1_thresholds(counts, X.node_counts(rows, CLASSES), CLASSES).select(
        "cluster", F.concat(F.lit("d"), F.col("f")).alias("feature"),
        F.col("threshold").alias("threshold_raw"))


def threshold_summary(spark, d):
    return rounded(summary.threshold_summary(_threshold_table(spark, d), []), ["mean_abs_threshold"])


def threshold_pivot(spark, d):
    out = summary.threshold_pivot(_threshold_table(spark, d), [], EMB)
    return rounded(out.withColumn("cluster", F.col("cluster").cast("bigint")), EMB)


def method_metrics(spark, d):
    """Per-method metrics side by side; measures a method lacks stay null."""
    labels = window_labels(spark, d)
    balance = metrics.balance_entropy(labels).drop(REC)
    size = labels.filter("method = 'gmm'").groupBy("method").agg(
        F.countDistinct("label").alias("classes"))
    return rounded(balance.join(size, "method", "left"), ["balance_entropy"])


def top_windows(spark, d):
    """The eight windows with the most energy."""
    return time_table(spark, d).select("window_index", r("eeg_energy").alias("eeg_energy")).orderBy(
        F.desc("eeg_energy"), "window_index").limit(8)


def signal_opening(spark, d):
    """The first 20 seconds, as the trace figure shows them."""
    return rounded(signal(spark, d).filter(F.col("sample_idx") / FS < 20).select(
        "sample_idx", "eeg", "emg"), ["eeg"])


def window_stride(spark, d):
    return rounded(summary.every_nth(time_table(spark, d), "window_index", 5).select(
        "window_index", "eeg_zcr"), ["eeg_zcr"])


def transition_edges(spark, d):
    t = index.transition_matrix(_level(spark, d), REC, "sample_idx", "state")
    return rounded(summary.transition_edges(t, 0.3).drop(REC), ["probability"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        csv_channels, signal_by_user, signal_zscore, filter_bandpass, filter_notch,
        signal_preprocess, windows_tumbling, windows_overlapping, windows_spaced, windows_auto,
        window_metadata, window_matrix, time_features_eeg, time_features_emg, spectrum_power,
        spectrum_features, band_features, features_full_zscore, features_full_minmax,
        features_legacy_minmax, features_inverse_scaling, nearest_centroid, lloyd_step,
        kmeans_inertia, gmm_em_step, gmm_information_criteria, kmeans_fit, gmm_fit,
        hierarchical_fit, silhouette, davies_bouldin, balance_entropy, average_spectra,
        label_confusion, label_matching, label_relabel, hmm_log_emission, hmm_forward_likelihood,
        hmm_viterbi, hmm_run_lengths, hmm_durations, hmm_transitions, hmm_self_transition, hmm_bic,
        hmm_fit_compare, pca_covariance, pca_embedding, diffusion_kernel, diffusion_embedding,
        split_candidates, best_split, f1_thresholds, tree_stump_predictions, tree_stump_fidelity,
        tree_nodes, tree_thresholds, minmax_pyramid, quantised_signal, feature_histograms,
        feature_box_stats, threshold_summary, threshold_pivot, method_metrics, top_windows,
        signal_opening, window_stride, transition_edges, filter_bandpass_blocks,
        filter_notch_blocks, lloyd_step_blocks, kmeans_inertia_blocks, gmm_em_step_blocks,
        hmm_forward_blocks, hmm_viterbi_blocks, pca_covariance_blocks, diffusion_kernel_blocks,
    )
}
