"""JSON records and the Markdown report."""

from __future__ import annotations

import json
import math
from pathlib import Path

import numpy as np
import pandas as pd

from statewave.config import PipelineConfig


def plain(value):
    """Anything the result tables hold as JSON types."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, np.ndarray)):
        return [plain(v) for v in value]
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float) and math.isnan(value):
        return None
    return str(value) if isinstance(value, Path) else value


def json_text(payload) -> str:
    return json.dumps(plain(payload), indent=2, ensure_ascii=False)


def markdown_table(frame: pd.DataFrame) -> str:
    """Numbers with four decimals; columns as wide as their widest cell."""
    columns = []
    for name in frame.columns:
        cells = [format(v, ".4f") if isinstance(v, float) else str(v) for v in frame[name]]
        width = max(map(len, [name, "---", *cells]))
        columns.append([c.ljust(width) for c in (name, "-" * width, *cells)])
    return "\n".join(f"| {' | '.join(row)} |" for row in zip(*columns))


def report_text(config: PipelineConfig, metrics: pd.DataFrame, chains: pd.DataFrame,
                rules: dict[str, tuple[float, str]], manifold_used: str, runtime: dict) -> str:
    facts = [
        ("Window length", f"{config.windowing.window_sec:.1f} s"),
        ("Overlap", f"{config.windowing.overlap_sec:.1f} s"),
        ("Number of clusters", config.clustering.n_clusters),
        ("Manifold method requested", config.manifold.method),
        ("Manifold method used", manifold_used),
        ("Acceleration backend used", runtime["backend_used"]),
        ("Acceleration device used", runtime["device_used"]),
        ("Acceleration note", runtime["reason"]),
    ]
    parts = ["# Unsupervised State Analysis Report", "", "## Configuration"]
    parts += [f"- {name}: {value}" for name, value in facts]
    parts += ["", "## Clustering Summary", markdown_table(metrics), "",
              "## Gaussian HMM Model Comparison", markdown_table(chains), "", "## Explainability"]
    for method, (fidelity, text) in rules.items():
        parts += [f"### {method}", f"- Decision-tree fidelity: {fidelity:.3f}", "", "```text", text,
                  "```", ""]
    return "\n".join(parts)
