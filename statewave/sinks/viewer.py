"""Interactive session page, one per recording, with its epochs in files of their own.

The page holds what has a bounded size: min/max pyramids of the signals, states by columns, the
occupied cells of the embedding, mean spectra. Epochs with their labels, coordinates and spectra
lie in ``epochs/000000.js`` and so on, ``CHUNK`` to a file, written by Spark in parallel; the page
loads the files that it shows.
"""

from __future__ import annotations

import base64
import json
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.operators.blocks import REC
from statewave.sinks.figures import Session
from statewave.sinks.session_tables import GRID
from statewave.sinks.svg import PALETTE

MAX_BINS = 160
CHUNK = 2048


def spectrum_bins(n: int, limit: int = MAX_BINS) -> np.ndarray:
    """Bins shown in the spectrum panel."""
    return np.arange(n) if n <= limit else np.unique(np.linspace(0, n - 1, limit, dtype=int))


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/")


def epoch_files(result, methods: list[str]) -> DataFrame:
    """``recording_id, name, content``: a script for each run of ``CHUNK`` epochs."""
    f = result.features
    keep = spectrum_bins(len(f.freqs))
    power = F.transform(F.array(*[F.lit(int(i)) for i in keep]), lambda i: F.round(F.col("power")[i], 6))
    points = result.manifold.embedding
    labels = result.alignment.labels.groupBy(REC, "window_index").pivot("method", methods).agg(F.first("aligned_label"))
    y = F.col("dim_2") if "dim_2" in points.columns else F.lit(0.0)
    rows = f.spectra.select(REC, "window_index", power.alias("power")).join(
        points.select(REC, "window_index", F.round("dim_1", 6).alias("x"), F.round(y, 6).alias("y")), [REC, "window_index"]).join(
        labels, [REC, "window_index"]).withColumn("chunk", F.expr(f"window_index div {CHUNK}"))

    def script(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window_index")
        chunk = int(pdf["chunk"].iloc[0])
        data = {"xy": pdf[["x", "y"]].to_numpy().tolist(), "state": {m: pdf[m].astype(int).tolist() for m in methods},
                "power": [list(map(float, p)) for p in pdf["power"]]}
        return pd.DataFrame({REC: [pdf[REC].iloc[0]], "name": [f"epochs/{chunk:06d}.js"],
                             "content": [f"epochs({chunk},{compact(data)});\n"]})

    return rows.groupBy(REC, "chunk").applyInPandas(script, f"{REC} string, name string, content string")


def trace(x: Session, channel: str) -> dict:
    """One channel's ranges of every pyramid level, as 16-bit codes."""
    pack = lambda v: base64.b64encode(np.asarray(v, dtype="<i2").tobytes()).decode("ascii")
    bounds = x.of("channels", channel=channel).iloc[0]
    steps = x.of("levels", channel=channel).sort_values("block_size")
    return {"name": channel.upper(), "range": [bounds["low"], bounds["high"]],
            "zoom": [{"every": int(r.block_size), "floor": pack(r.low), "roof": pack(r.high)} for r in steps.itertuples()]}


def page_data(x: Session, title: str, source: str, reference: str) -> dict:
    size, extent = x.of("size").iloc[0], x.of("extent").iloc[0]
    keep = spectrum_bins(len(x.freqs))
    states = {}
    for m in x.methods:
        columns = x.of("timeline", series=m).sort_values("column")
        means = x.of("spectra", method=m).pivot(index="label", columns="bin", values="power")
        cells = x.of("cells", method=m)
        states[m] = {"column": columns["state"].astype(int).tolist(),
                     "mean": {str(int(k)): row.to_numpy(dtype=float)[keep].round(6).tolist() for k, row in means.iterrows()},
                     "cell": cells[["cx", "cy", "state", "n", "first"]].astype(int).to_numpy().tolist()}
    return {"title": title, "source": source, "rate": x.fs, "samples": int(size["n_rows"]), "epochs": int(size["n_windows"]),
            "length": x.window_sec, "hop": x.hop, "chunk": CHUNK, "stride": int(x.of("stride").iloc[0]["stride"]),
            "space": {"method": x.manifold_used, "grid": GRID, "x": [extent["x_low"], extent["x_high"]],
                      "y": [extent["y_low"], extent["y_high"]]},
            "reference": reference, "states": states, "palette": PALETTE, "hz": x.freqs[keep].round(6).tolist(),
            "traces": [trace(x, c) for c in (["eeg", "emg"] if x.has_emg else ["eeg"])]}


PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>@TITLE@</title><style>
body{font:14px system-ui,sans-serif;margin:16px;background:#f4f6f7;color:#1b2a33}
h1{font-size:20px;margin:0 0 4px}.row{display:flex;gap:12px;flex-wrap:wrap}
.card{background:#fff;border:1px solid #d5dde2;border-radius:8px;padding:10px;margin-bottom:12px}
canvas{display:block;width:100%;touch-action:none}h2{font-size:14px;margin:0 0 6px}
.note{color:#5d6b75}button,select{font:inherit}</style></head><body>
<h1>@TITLE@</h1><p class="note" id="about"></p>
<div class="card">Colour by <select id="method"></select>
<button id="zoom-in">+</button> <button id="zoom-out">-</button> <button id="reset">Whole recording</button>
<button id="prev">Previous epoch</button> <button id="next">Next epoch</button>
<span id="where" class="note"></span></div>
<div class="card"><h2>Overview</h2><canvas id="overview-canvas" height="60"></canvas></div>
<div class="card"><h2>EEG</h2><canvas id="eeg-canvas" height="170"></canvas></div>
<div class="card" id="emg-card"><h2>EMG</h2><canvas id="emg-canvas" height="170"></canvas></div>
<div class="row"><div class="card" style="flex:1 1 380px"><h2>Manifold</h2>
<canvas id="manifold-canvas" height="420"></canvas></div>
<div class="card" style="flex:1 1 380px"><h2>Selected epoch spectrum</h2>
<canvas id="spectrum-canvas" height="420"></canvas></div></div>
<script>
const D = @DATA@;
const el = id => document.getElementById(id), total = D.samples / D.rate, loaded = new Map(), asked = new Set();
const start = i => i * D.hop, centre = i => start(i) + D.length / 2;
const codes = text => new Int16Array(Uint8Array.from(atob(text), c => c.charCodeAt(0)).buffer);
for (const t of D.traces) for (const z of t.zoom) { z.floor = codes(z.floor); z.roof = codes(z.roof); }
let method = D.reference, from = 0, to = total, chosen = 0;
function epochs(chunk, data) { loaded.set(chunk, data); draw(); }
function want(chunk) { if (chunk < 0 || chunk * D.chunk >= D.epochs || asked.has(chunk)) return; asked.add(chunk);
  const s = document.createElement("script"); s.src = "epochs/" + String(chunk).padStart(6, "0") + ".js"; document.head.append(s); }
function epoch(i) { const chunk = Math.floor(i / D.chunk), c = loaded.get(chunk), k = i - chunk * D.chunk; want(chunk);
  return c && { xy: c.xy[k], power: c.power[k], state: c.state[method][k] }; }
const stateOf = i => { const e = loaded.has(Math.floor(i / D.chunk)) && epoch(i); return e ? e.state : D.states[method].column[Math.floor(i / D.stride)]; };
const paint = s => D.palette[s % D.palette.length];
for (const m of Object.keys(D.states)) el("method").add(new Option(m, m, m === method, m === method));
el("about").textContent = `${D.source} - ${D.rate} Hz, ${D.epochs} epochs, embedding: ${D.space.method}`;
if (D.traces.length < 2) el("emg-card").remove();
function sheet(id) { const c = el(id); c.width = c.clientWidth; const g = c.getContext("2d"); g.font = "11px sans-serif"; return { g, w: c.width, h: c.height }; }
function stripes({ g, w, h }, a, b) {
  const first = Math.max(0, Math.floor((a - D.length) / D.hop)), last = Math.min(D.epochs - 1, Math.ceil(b / D.hop));
  const every = Math.max(1, Math.floor((last - first) / (2 * w)));
  if (last - first < 2 * D.chunk) for (let c = Math.floor(first / D.chunk); c * D.chunk <= last; c++) want(c);
  for (let i = first; i <= last; i += every) { g.globalAlpha = i === chosen ? 0.55 : 0.2; g.fillStyle = paint(stateOf(i));
    const left = (start(i) - a) / (b - a) * w; g.fillRect(left, 0, Math.max(1, Math.max(D.length, every * D.hop) / (b - a) * w), h); }
  g.globalAlpha = 1; }
function signal(id, t, a, b) { const s = sheet(id), { g, w, h } = s; stripes(s, a, b);
  const z = t.zoom.findLast(l => (b - a) * D.rate / l.every >= 2 * w) || t.zoom[0], x = k => (k * z.every / D.rate - a) / (b - a) * w, y = v => (1 - (v + 32768) / 65535) * (h - 4) + 2;
  g.strokeStyle = "#12303f"; g.beginPath();
  for (let k = Math.max(0, Math.floor(a * D.rate / z.every)); k < z.floor.length && x(k) <= w; k++) { g.lineTo(x(k), y(z.floor[k])); g.lineTo(x(k), y(z.roof[k])); }
  g.stroke(); g.fillStyle = "#333"; g.fillText(`${a.toFixed(2)} s`, 4, h - 4); g.fillText(`${b.toFixed(2)} s`, w - 60, h - 4); return s; }
let spots = [];
function plane() { const { g, w, h } = sheet("manifold-canvas"), [nx, ny] = D.space.grid, put = (u, v) => [12 + u * (w - 24), h - 12 - v * (h - 24)];
  spots = D.states[method].cell.map(([cx, cy, s, n, i]) => ({ at: put((cx + 0.5) / nx, (cy + 0.5) / ny), s, n, i }));
  for (const p of spots) { g.globalAlpha = Math.min(1, 0.5 + 0.1 * Math.log2(p.n)); g.fillStyle = paint(p.s); g.beginPath(); g.arc(...p.at, 3, 0, 7); g.fill(); }
  g.globalAlpha = 1; const e = epoch(chosen); if (!e) return;
  const rel = (v, [a, b]) => (v - a) / (b - a || 1); g.strokeStyle = "#000"; g.lineWidth = 2; g.beginPath(); g.arc(...put(rel(e.xy[0], D.space.x), rel(e.xy[1], D.space.y)), 7, 0, 7); g.stroke(); }
function spectrum() { const { g, w, h } = sheet("spectrum-canvas"), e = epoch(chosen); if (!e) return;
  const mean = D.states[method].mean[e.state] || [], top = Math.max(...e.power, ...mean) || 1, end = D.hz[D.hz.length - 1] || 1;
  for (const [v, c] of [[mean, paint(e.state)], [e.power, "#12303f"]]) { g.strokeStyle = c; g.lineWidth = 1.6; g.beginPath();
    v.forEach((p, k) => g.lineTo(34 + D.hz[k] / end * (w - 44), h - 22 - p / top * (h - 34))); g.stroke(); }
  g.fillStyle = "#333"; g.fillText("0 Hz", 30, h - 6); g.fillText(`${end.toFixed(1)} Hz`, w - 50, h - 6); }
function draw() { D.traces.forEach((t, k) => signal(k ? "emg-canvas" : "eeg-canvas", t, from, to));
  const { g, w, h } = signal("overview-canvas", D.traces[0], 0, total); g.strokeStyle = "#B80C09"; g.lineWidth = 2;
  g.strokeRect(from / total * w, 1, Math.max(2, (to - from) / total * w), h - 2); plane(); spectrum();
  el("where").textContent = `Epoch at ${start(chosen).toFixed(2)} s, ${method} state ${stateOf(chosen)}`; }
function show(a, n) { n = Math.min(Math.max(n, 4 / D.rate), total); from = Math.min(Math.max(a, 0), total - n); to = from + n; draw(); }
const zoom = (k, at) => show(at - (at - from) * k, (to - from) * k), middle = () => (from + to) / 2;
function choose(i, follow) { chosen = Math.min(Math.max(i, 0), D.epochs - 1); const c = centre(chosen), n = to - from;
  if (follow && (c < from || c > to)) show(c - n / 2, n); else draw(); }
for (const id of ["eeg-canvas", "emg-canvas"]) { const c = el(id); if (!c) continue; let held = null;
  const time = e => from + e.offsetX / c.clientWidth * (to - from);
  c.onwheel = e => { e.preventDefault(); zoom(e.deltaY < 0 ? 0.75 : 1.35, time(e)); };
  c.onpointerdown = e => { held = { x: e.offsetX, from }; c.setPointerCapture(e.pointerId); };
  c.onpointermove = e => { if (held) show(held.from + (held.x - e.offsetX) / c.clientWidth * (to - from), to - from); };
  c.onpointerup = () => { held = null; }; c.ondblclick = e => choose(Math.floor(time(e) / D.hop), false); }
el("overview-canvas").onclick = e => { const n = to - from; show(e.offsetX / e.target.clientWidth * total - n / 2, n); };
el("manifold-canvas").onclick = e => { const away = p => (p.at[0] - e.offsetX) ** 2 + (p.at[1] - e.offsetY) ** 2;
  const near = spots.reduce((a, b) => a && away(a) <= away(b) ? a : b, null); if (near && away(near) <= 324) choose(near.i, true); };
el("method").onchange = e => { method = e.target.value; draw(); };
el("zoom-in").onclick = () => zoom(0.75, middle()); el("zoom-out").onclick = () => zoom(1.35, middle());
el("reset").onclick = () => show(0, total); el("prev").onclick = () => choose(chosen - 1, true); el("next").onclick = () => choose(chosen + 1, true);
window.onresize = draw; draw();
</script></body></html>
"""


def page_text(data: dict) -> str:
    return PAGE.replace("@TITLE@", escape(str(data["title"]))).replace("@DATA@", compact(data))
