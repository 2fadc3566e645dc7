"""Everything a run leaves on disk.

Tables are written by Spark, for several recordings partitioned by them. Report, JSON records,
figures and page of every recording are drawn in tasks, one recording at a time, from bounded
aggregates, and written by the tasks: nothing of a session passes through the driver. One
recording's files lie in the output folder, those of several in a folder for each.
"""

from __future__ import annotations

from dataclasses import replace
from hashlib import md5
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.operators.blocks import REC
from statewave.operators.windows import window_times
from statewave.plans.stages import METHODS
from statewave.session import cut_lineage
from statewave.sinks.figures import Session, session_figures
from statewave.sinks.files import write_files
from statewave.sinks.report import json_text, report_text
from statewave.sinks.session_tables import as_rows, frames_of, session_tables
from statewave.sinks.tables import write_table
from statewave.sinks.viewer import epoch_files, page_data, page_text


def _matrix_rows(models: DataFrame, column: str, names: list[str] | None) -> DataFrame:
    """One row per state from an array-of-arrays column."""
    rows = models.select(REC, F.posexplode(column).alias("state", "row"))
    width = names or [str(i) for i in range(len(models.select(column).first()[0]))]
    return rows.select(REC, "state", *[F.col("row")[i].alias(n) for i, n in enumerate(width)])


def with_frequencies(spectra: DataFrame, freqs) -> DataFrame:
    """Average spectra with the frequency of every bin."""
    hz = F.array(*[F.lit(float(v)) for v in freqs])
    return spectra.withColumn("frequency_hz", F.get(hz, F.col("bin").cast("int")))


def write_window_tables(result, out: Path, single: bool) -> list[Path]:
    f, cut = result.features, result.windows
    spark = f.raw.sparkSession
    axis = spark.createDataFrame([(i, float(v)) for i, v in enumerate(f.freqs)], "bin int, frequency_hz double")
    axis.coalesce(1).write.mode("overwrite").option("header", True).csv(str(out / "frequencies.csv"))
    save = lambda df, name, order, fmt="csv": write_table(df, out / name, order, fmt, single)
    paths = [
        save(f.raw if not single else f.raw.select(REC, "window_index", *f.names), "features_raw.csv",
             ["window_index"]),
        save(f.scaled, "features_scaled.csv", ["window_index"]),
        save(window_times(f.raw, cut.plan, result.preprocess.fs, cut.window_sec),
             "window_metadata.csv", ["window_index"]),
        save(f.spectra, "spectra.parquet", ["window_index"], "parquet"),
        save(result.manifold.embedding, "manifold_embedding.csv", ["window_index"]),
    ]
    for method in METHODS:
        mine = lambda df: df.filter(F.col("method") == method).drop("method")
        paths += [
            save(mine(result.alignment.labels), f"{method}_labels.csv", ["window_index"]),
            save(with_frequencies(mine(result.clustering.average_spectra), f.freqs), f"{method}_average_spectra.parquet",
                 ["label", "bin"], "parquet"),
            save(mine(result.explain.importance).select(REC, "feature", "importance", "f").orderBy(
                F.desc("importance"), "f").drop("f"), f"{method}_feature_importance.csv",
                [] if single else ["feature"]),
            save(mine(result.explain.thresholds), f"{method}_thresholds.csv", ["cluster", "f"]),
        ]
    for k in result.config.hmm.state_counts:
        name = f"gaussian_hmm_{k}_state"
        models = result.hmm.models.filter(F.col("n_states") == k)
        paths += [
            save(result.hmm.states.filter(F.col("n_states") == k).drop("n_states"),
                 f"{name}_hidden_states.csv", ["window_index"]),
            save(result.hmm.runs.filter(F.col("n_states") == k).select(
                REC, "state", "run_start", "duration_sec"), f"{name}_durations.csv",
                ["state", "run_start"]),
            save(_matrix_rows(models, "transition", None), f"{name}_transition_matrix.csv", ["state"]),
            save(_matrix_rows(models, "means", f.names), f"{name}_means.csv", ["state"]),
            save(_matrix_rows(models, "variances", f.names), f"{name}_variances.csv", ["state"]),
        ]
    compare = result.hmm.models.select(REC, "n_states", "log_likelihood", "bic", "mean_self_transition")
    metrics = result.clustering.metrics.join(
        result.explain.fidelity.withColumnRenamed("fidelity", "explain_fidelity"), [REC, "method"])
    return paths + [out / "frequencies.csv", save(compare, "hmm_model_comparison.csv", ["n_states"]),
                    save(metrics, "method_comparison_metrics.csv", ["method"])]


def session_of(result, recording_id: str):
    """The same result restricted to one recording, with its own output folder."""
    def one(df: DataFrame) -> DataFrame:
        return df.filter(F.col(REC) == recording_id)

    def narrow(part, **extra):
        frames = {k: one(v) for k, v in vars(part).items()
                  if isinstance(v, DataFrame) and REC in v.columns}
        return replace(part, **frames, **extra)

    longest = one(result.preprocess.lengths).first()["n_rows"]
    space = result.manifold
    return replace(
        result, output_dir=result.output_dir / recording_id,
        preprocess=narrow(result.preprocess, n_recordings=1, longest=longest),
        windows=narrow(result.windows), features=narrow(result.features),
        clustering=narrow(result.clustering), alignment=narrow(result.alignment),
        hmm=narrow(result.hmm), explain=narrow(result.explain),
        manifold=narrow(space))


def folder_of(recording_id: str) -> str:
    """A folder name for a recording; one that had to be changed gets a mark of its own."""
    from statewave.plans.run import sanitize_session_name

    name = sanitize_session_name(recording_id)
    return name if name == recording_id else f"{name}-{md5(recording_id.encode()).hexdigest()[:8]}"


def session_texts(x: Session, config, runtime: dict, meta: dict, title: str, source: str) -> dict[str, str]:
    """Contents of one recording's files by name."""
    metrics = x.of("metrics").set_index("method").reindex(x.methods)
    out = {"config.json": json_text(config.to_dict()), "acceleration.json": json_text(runtime)}
    rules = {}
    keep = ["node_id", "depth", "predicted_class", "n_samples", "impurity", "feature", "threshold_scaled", "threshold_raw", "class_counts"]
    for method in x.methods:
        row, text = metrics.loc[method], x.of("rules", method=method).iloc[0]["rules_text"]
        out[f"{method}_metrics.json"] = json_text({k: v for k, v in row.items() if k != "explain_fidelity" and not pd.isna(v)})
        rules[method] = (float(row["explain_fidelity"]), text)
        nodes = x.of("nodes", method=method).sort_values("node_id")[keep].astype(object)
        out[f"{method}_explain.json"] = json_text({"fidelity": rules[method][0], "rules_text": text,
                                                   "nodes": nodes.where(nodes.notna(), None).to_dict(orient="records")})
    models = x.of("models").sort_values("n_states")
    for m in models.to_dict(orient="records"):
        out[f"gaussian_hmm_{int(m['n_states'])}_state_summary.json"] = json_text({
            **{k: m[k] for k in ("n_states", "log_likelihood", "bic")},
            "initial_distribution": m["initial"], "stationary_distribution": m["stationary"]})
    values = x.of("eigenvalues")
    out["manifold_meta.json"] = json_text({**meta, "eigenvalues": values.iloc[0]["eigenvalues"] if len(values) else None})
    out["report.md"] = report_text(config, metrics.reset_index(), models[["n_states", "log_likelihood", "bic", "mean_self_transition"]],
                                   rules, x.manifold_used, runtime)
    out["session_view.html"] = page_text(page_data(x, title, source, config.clustering.alignment_reference))
    return out | session_figures(x)


def session_rows(result, single: bool) -> DataFrame:
    """``name, content`` of the files of all recordings."""
    f, config, runtime, space = result.features, result.config, dict(result.runtime_info), result.manifold
    blank = Session(f.names, f.freqs, result.preprocess.fs, result.windows.plan.step, result.windows.window_sec,
                    result.preprocess.has_emg, config.clustering.n_clusters, config.explain.top_features_to_plot, METHODS, space.method_used)
    meta = {"method_requested": space.method_requested, "method_used": space.method_used, "metadata": space.metadata}
    session, source = Path(result.output_dir).name, config.input.filename

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        recording = pdf[REC].iloc[0]
        title = session if single else f"{session}: {recording}"
        texts = session_texts(replace(blank, parts=frames_of(pdf)), config, runtime, meta, title, source if single and source else recording)
        return pd.DataFrame({REC: recording, "name": list(texts), "content": list(texts.values())})

    drawn = as_rows(session_tables(result)).groupBy(REC).applyInPandas(render, f"{REC} string, name string, content string")
    rows = drawn.unionByName(epoch_files(result, METHODS))
    folder = F.udf(folder_of)
    return rows if single else rows.withColumn("name", F.concat_ws("/", folder(REC), "name"))


def write_sessions(result, out: Path, single: bool) -> dict[str, list[Path]]:
    """Report, JSON records, figures and page of every recording."""
    names = write_files(session_rows(result, single), str(out))
    ends = {"report": "report.md", "figures": ".svg", "interactive": "session_view.html", "epochs": ".js", "records": ".json"}
    return {kind: [out / n for n in names if n.endswith(end)] for kind, end in ends.items()}


def write_session(result, out: Path) -> dict[str, list[Path]]:
    """The files of a one-recording result."""
    return write_sessions(result, Path(out), True)


def export_result(result) -> dict[str, list[Path]]:
    """Write all tables and the session files of every recording."""
    out = Path(result.output_dir)
    single = result.preprocess.n_recordings == 1
    for part, names in ((result.clustering, ["average_spectra"]),
                        (result.explain, ["thresholds", "importance", "fidelity", "rules"]),
                        (result.hmm, ["models", "states", "runs"]),
                        (result.alignment, ["before", "after"]), (result.manifold, ["embedding"])):
        for name in names:
            setattr(part, name, cut_lineage(getattr(part, name)))
    paths = {"tables": write_window_tables(result, out, single)}
    return paths | write_sessions(result, out, single)
