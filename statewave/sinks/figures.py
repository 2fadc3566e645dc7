"""Figures of one recording, drawn from the bounded parts of ``session_tables``."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from statewave.operators.scaling import feature_subset
from statewave.sinks import svg
from statewave.sinks.session_tables import GRID
from statewave.sinks.svg import Chart, colour

ARROWS = 120


@dataclass
class Session:
    """What every drawing of a run has in common, and one recording's parts."""

    names: list[str]
    freqs: np.ndarray
    fs: float
    step: int
    window_sec: float
    has_emg: bool
    n_clusters: int
    top_features: int
    methods: list[str]
    manifold_used: str
    parts: dict[str, pd.DataFrame] = field(default_factory=dict)

    @property
    def hop(self) -> float:
        return self.step / self.fs

    def of(self, part: str, **keys) -> pd.DataFrame:
        """Rows of a part with the given values; without rows, an empty frame."""
        frame = self.parts.get(part, pd.DataFrame())
        for name, value in keys.items():
            frame = frame[frame[name] == value] if len(frame) else frame
        return frame


def _span(values) -> tuple[float, float]:
    values = np.asarray(values, dtype=float)
    return (float(values.min()), float(values.max())) if len(values) else (0.0, 1.0)


def signal_figures(x: Session) -> dict[str, str]:
    opening = {name: x.of(name).iloc[0] for name in ("raw", "clean", "boundary")}
    t = np.asarray(opening["raw"]["at"]) / x.fs
    panels = []
    for channel in ["eeg", "emg"] if x.has_emg else ["eeg"]:
        for title, name, c in (("raw", "raw", 0), ("filtered", "clean", 2)):
            values = np.asarray(opening[name][channel], dtype=float)
            panels.append(Chart(f"{channel.upper()} {title}", _span(t), _span(values), "Time (s)", size=(900, 220)).line(
                t, values, colour(c)))
    head = opening["boundary"]
    t, values = np.asarray(head["at"]) / x.fs, np.asarray(head["eeg"], dtype=float)
    chart = Chart("Window boundaries", _span(t), _span(values), "Time (s)", "EEG", (900, 300)).line(t, values, colour(0), 0.6)
    for start in np.arange(0, chart.x1 + x.hop / 2, x.hop):
        chart.rule(min(start, chart.x1), colour(2))
    return {"signal_comparison": svg.page(panels), "window_boundaries": svg.page([chart])}


def _histograms(x: Session, part: str, ranges: str, keys: list[str], bins: int) -> dict:
    """Edges and counts by key."""
    out = {}
    for row in x.of(ranges).to_dict(orient="records"):
        a, b = (row["low"] - 0.5, row["low"] + 0.5) if row["low"] == row["high"] else (row["low"], row["high"])
        n, mine = np.zeros(bins), x.of(part, **{k: row[k] for k in keys})
        n[mine["bin"].astype(int)] = mine["n"]
        out[tuple(row[k] for k in keys)] = (np.linspace(a, b, bins + 1), n)
    return out


def feature_figures(x: Session, hists: dict) -> dict[str, str]:
    first = np.asarray(x.of("first").iloc[0]["power"], dtype=float)
    one = Chart("EEG spectrum of the first window", _span(x.freqs), _span(first), "Frequency (Hz)", "Power").line(
        x.freqs, first, colour(0))
    grid = x.of("grid")
    image = np.zeros((int(grid["row"].max()) + 1, int(grid["column"].max()) + 1))
    image[grid["row"], grid["column"]] = np.log1p(grid["p"])
    heat = svg.heat_map("EEG spectral heat map (log power)", image[::-1], [], [], numbers=False)
    shown = feature_subset(x.names, 8)
    return {"features_single_spectrum": svg.page([one]), "features_spectrum_heatmap": svg.page([heat]),
            "features_distributions": svg.page([svg.histogram(n, *hists[(n,)]) for n in shown])}


def _timeline(title: str, states: pd.DataFrame, stride: int, hop: float) -> Chart:
    """States of columns of ``stride`` windows as boxes."""
    states = states.sort_values("column")
    chart = Chart(title, (0, (states["column"].max() + 1) * stride * hop), (0, float(states["state"].max()) + 1), "Time (s)",
                  "State", (900, 220))
    for column, state in zip(states["column"], states["state"]):
        chart.box(column * stride * hop, (column + 1) * stride * hop, state, state + 1, colour(state))
    return chart


def cluster_figures(x: Session, method: str) -> dict[str, str]:
    k, stride = x.n_clusters, int(x.of("stride").iloc[0]["stride"])
    out = {f"{method}_timeline": svg.page([_timeline(f"{method} states", x.of("timeline", series=method), stride, x.hop)])}
    panels = []
    for name in feature_subset(x.names, 4):
        mine = x.of("boxes", feature=name, method=method)
        chart = Chart(f"{name} by state", (0, k), (mine["low"].min(), mine["high"].max()), "State")
        for row in mine.itertuples():
            s = int(row.aligned_label)
            chart.line([s + 0.5] * 2, [row.low, row.high], "#444")
            chart.box(s + 0.2, s + 0.8, row.q1, row.q3, colour(s))
            chart.line([s + 0.2, s + 0.8], [row.median] * 2, "#fff", 2)
        panels.append(chart)
    out[f"{method}_boxplots"] = svg.page(panels)
    spectra = x.of("spectra", method=method)
    chart = Chart(f"{method} mean spectra", _span(x.freqs), _span(spectra["power"]), "Frequency (Hz)", "Power")
    for label, mine in spectra.groupby("label"):
        chart.line(x.freqs, mine.sort_values("bin")["power"], colour(label))
    out[f"{method}_mean_spectra"] = svg.page([chart])
    row = x.of("metrics", method=method).iloc[0]
    names = ["silhouette", "davies_bouldin", "balance_entropy"]
    out[f"{method}_metrics"] = svg.page([svg.bars(f"{method} quality", names, [row[n] for n in names])])
    states = [f"S{i}" for i in range(k)]
    for phase in ("before", "after"):
        counts, image = x.of(phase, method=method), np.zeros((k, k))
        if len(counts):
            image[counts["ref_label"].astype(int), counts["label"].astype(int)] = counts["n"]
        out[f"{method}_alignment_{phase}"] = svg.page([svg.heat_map(
            f"{method} against reference, {phase} alignment", image, states, states, fmt=".0f")])
    return out


def explain_figures(x: Session, method: str, hists: dict) -> dict[str, str]:
    nodes = x.of("nodes", method=method).set_index("path")
    depth = int(nodes["depth"].max())
    chart = Chart(f"{method} decision tree", (0, 1), (-depth - 0.5, 0.5), size=(900, 120 * (depth + 2)))
    chart.items = chart.items[:1]

    def place(path: str) -> tuple[float, float]:
        low, high = 0.0, 1.0
        for step in path:
            low, high = (low, (low + high) / 2) if step == "L" else ((low + high) / 2, high)
        return (low + high) / 2, -float(len(path))

    for path in nodes.index:
        if path:
            chart.line(*zip(place(path[:-1]), place(path)), "#999")
    for path, node in nodes.iterrows():
        leaf = node["feature"] is None or pd.isna(node["feature"])
        chart.text(*place(path), f"state {int(node['predicted_class'])} (n={int(node['n_samples'])})" if leaf
                   else f"{node['feature']} <= {node['threshold_raw']:.3g}")
    ranked = x.of("importance", method=method).sort_values(["importance", "f"], ascending=[False, True]).head(x.top_features)
    shown = list(ranked["feature"])
    rules = x.of("thresholds", method=method)
    pivot = rules.pivot_table(index="cluster", columns="feature", values="threshold_raw", aggfunc="first").reindex(columns=shown)
    return {
        f"{method}_decision_tree": svg.page([chart]),
        f"{method}_threshold_heatmap": svg.page([svg.heat_map(
            f"{method} thresholds", pivot.to_numpy(dtype=float), [f"S{int(i)}" for i in pivot.index], shown, fmt=".3g")]),
        f"{method}_feature_importance": svg.page([svg.bars(f"{method} feature importance", shown, ranked["importance"])]),
        f"{method}_threshold_overlays": svg.page([
            svg.histogram(n, *hists[(n,)], rules[rules["feature"] == n]["threshold_raw"].dropna()) for n in shown])}


def _models(x: Session) -> pd.DataFrame:
    return x.of("models").sort_values("n_states")


def hmm_figures(x: Session) -> dict[str, str]:
    out, stride = {}, int(x.of("stride").iloc[0]["stride"])
    durations = _histograms(x, "runs", "run_ranges", ["n_states", "state"], 20)
    for model in _models(x).itertuples():
        k, name = int(model.n_states), f"gaussian_hmm_{int(model.n_states)}_state"
        out[f"{name}_states"] = svg.page([_timeline(f"{name} hidden states", x.of("timeline", series=f"hmm{k}"), stride, x.hop)])
        a, ids = np.array(list(map(list, model.transition)), dtype=float), [f"S{i}" for i in range(k)]
        out[f"{name}_transitions"] = svg.page([svg.heat_map(f"{name} transitions", a, ids, ids)])
        chart = Chart(f"{name} transition graph", (-1.4, 1.4), (-1.4, 1.4), size=(520, 520))
        chart.items = chart.items[:1]
        spot = [(np.cos(2 * np.pi * i / k), np.sin(2 * np.pi * i / k)) for i in range(k)]
        for i, j in zip(*np.nonzero((a >= 0.05) & ~np.eye(k, dtype=bool))):
            chart.arrow(np.array(spot[i]) * 0.95, np.array(spot[j]) * 0.9, "#B80C09", 1 + 4 * a[i, j])
        chart.dots(*zip(*spot), [colour(i) for i in range(k)], 22)
        for i, at in enumerate(spot):
            chart.text(*at, f"S{i} {a[i, i]:.2f}", "#fff")
        out[f"{name}_graph"] = svg.page([chart])
        out[f"{name}_durations"] = svg.page([svg.histogram(f"State {int(s)} duration (s)", *durations[(n, s)])
                                             for n, s in sorted(durations) if n == k])
    m = _models(x)
    names = [str(k) for k in m["n_states"]]
    return out | {"hmm_model_comparison": svg.page([
        svg.bars("Log likelihood", names, m["log_likelihood"]), svg.bars("BIC", names, m["bic"]),
        svg.bars("Mean self transition", names, m["mean_self_transition"])])}


def manifold_figures(x: Session) -> dict[str, str]:
    extent, path = x.of("extent").iloc[0], x.of("path").sort_values("column")
    low, high = (extent["x_low"], extent["y_low"]), (extent["x_high"], extent["y_high"])
    out, panels = {}, []
    for method in x.methods:
        cells = x.of("cells", method=method)
        at = [a + (cells[c] + 0.5) / n * (b - a) for a, b, c, n in zip(low, high, ("cx", "cy"), GRID)]
        fills = [colour(s) for s in cells["state"]]
        base = lambda title: Chart(title, (low[0], high[0]), (low[1], high[1]), "Dim 1", "Dim 2", (560, 480))
        panels.append(base(f"{method} manifold ({x.manifold_used})").dots(*at, fills))
        out[f"{method}_manifold_scatter"] = svg.page([panels[-1]])
        out[f"{method}_manifold_trajectory"] = svg.page([base(f"{method} trajectory").line(
            path["x"], path["y"], "#6D7278", 0.8).dots(*at, fills, 3)])
        chart = base(f"{method} transition arrows").dots(*at, fills, 2.5)
        spots = path[["x", "y"]].to_numpy()
        hop = max(len(spots) // ARROWS, 1)
        for a, b in zip(spots[::hop], spots[hop::hop]):
            chart.arrow(a, b, "#B80C09", 0.8)
        out[f"{method}_manifold_arrows"] = svg.page([chart])
    return out | {"manifold_method_comparison": svg.page(panels)}


def comparison_figures(x: Session) -> dict[str, str]:
    m = x.of("metrics").set_index("method").reindex(x.methods)
    chains = []
    for model in _models(x).itertuples():
        ids = [f"S{i}" for i in range(int(model.n_states))]
        chains.append(svg.heat_map(f"{int(model.n_states)}-state transitions", np.array(list(map(list, model.transition)), dtype=float), ids, ids))
    s = x.of("threshold_summary").pivot(index="method", columns="feature", values="mean_abs_threshold")
    return {
        "comparison_quality": svg.page([svg.bars(n, x.methods, m[n]) for n in (
            "silhouette", "davies_bouldin", "balance_entropy", "explain_fidelity")]),
        "comparison_transitions": svg.page(chains),
        "comparison_thresholds": svg.page([svg.heat_map(
            "Mean absolute thresholds", s.to_numpy(dtype=float), list(s.index), list(s.columns), numbers=False)])}


def session_figures(x: Session) -> dict[str, str]:
    """Drawings by file name."""
    hists = _histograms(x, "histograms", "ranges", ["feature"], 30)
    out = signal_figures(x) | feature_figures(x, hists)
    for method in x.methods:
        out |= cluster_figures(x, method) | explain_figures(x, method, hists)
    out |= hmm_figures(x) | manifold_figures(x) | comparison_figures(x)
    return {f"figures/{name}.svg": text for name, text in out.items()}
