"""Small vector charts."""

from __future__ import annotations

from html import escape

import numpy as np

# One colour per state, repeated beyond the list.
PALETTE = ["#0B4F6C", "#01BAEF", "#B80C09", "#F2A541", "#4C956C", "#6D597A", "#E56B6F", "#355070"]
RAMP = np.array([[68, 1, 84], [59, 82, 139], [33, 145, 140], [94, 201, 98], [253, 231, 37]], float)


def colour(i: int) -> str:
    return PALETTE[int(i) % len(PALETTE)]


def shade(t: float) -> str:
    t = min(max(float(t), 0.0), 1.0) * (len(RAMP) - 1)
    low = min(int(t), len(RAMP) - 2)
    r, g, b = RAMP[low] + (RAMP[low + 1] - RAMP[low]) * (t - low)
    return f"rgb({r:.0f},{g:.0f},{b:.0f})"


class Chart:
    """One panel with linear axes."""

    def __init__(self, title: str, x: tuple[float, float], y: tuple[float, float],
                 x_label: str = "", y_label: str = "", size: tuple[int, int] = (760, 340)):
        self.w, self.h = size
        self.x0, self.x1 = x if x[1] > x[0] else (x[0] - 0.5, x[0] + 0.5)
        self.y0, self.y1 = y if y[1] > y[0] else (y[0] - 0.5, y[0] + 0.5)
        self.left, self.right, self.top, self.bottom = 70, self.w - 20, 36, self.h - 48
        self.items = [
            f'<text x="{self.w / 2}" y="22" text-anchor="middle" font-size="15">{escape(title)}</text>',
            f'<text x="{self.w / 2}" y="{self.h - 8}" text-anchor="middle">{escape(x_label)}</text>',
            f'<text transform="translate(16,{self.h / 2}) rotate(-90)" text-anchor="middle">{escape(y_label)}</text>',
            f'<rect x="{self.left}" y="{self.top}" width="{self.right - self.left}" '
            f'height="{self.bottom - self.top}" fill="none" stroke="#888"/>']
        for t in np.linspace(0, 1, 5):
            v, u = self.x0 + t * (self.x1 - self.x0), self.y0 + t * (self.y1 - self.y0)
            self.items.append(f'<text x="{self.px(v):.1f}" y="{self.bottom + 16}" text-anchor="middle">{v:.4g}</text>')
            self.items.append(f'<text x="{self.left - 6}" y="{self.py(u) + 4:.1f}" text-anchor="end">{u:.4g}</text>')

    def px(self, v: float) -> float:
        return self.left + (v - self.x0) / (self.x1 - self.x0) * (self.right - self.left)

    def py(self, v: float) -> float:
        return self.bottom - (v - self.y0) / (self.y1 - self.y0) * (self.bottom - self.top)

    def line(self, xs, ys, stroke: str, width: float = 1.2) -> "Chart":
        points = " ".join(f"{self.px(a):.1f},{self.py(b):.1f}" for a, b in zip(xs, ys))
        self.items.append(f'<polyline points="{points}" fill="none" stroke="{stroke}" stroke-width="{width}"/>')
        return self

    def dots(self, xs, ys, fills, radius: float = 3.5) -> "Chart":
        self.items += [f'<circle cx="{self.px(a):.1f}" cy="{self.py(b):.1f}" r="{radius}" fill="{c}" '
                       f'fill-opacity="0.8"/>' for a, b, c in zip(xs, ys, fills)]
        return self

    def box(self, a: float, b: float, low: float, high: float, fill: str, label: str = "") -> "Chart":
        x, y = self.px(a), self.py(high)
        self.items.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="{max(self.px(b) - x, 0.5):.1f}" '
                          f'height="{max(self.py(low) - y, 0.5):.1f}" fill="{fill}"/>')
        if label:
            self.text((a + b) / 2, (low + high) / 2, label, "#fff")
        return self

    def text(self, x: float, y: float, label: str, fill: str = "#222") -> "Chart":
        self.items.append(f'<text x="{self.px(x):.1f}" y="{self.py(y) + 4:.1f}" text-anchor="middle" '
                          f'fill="{fill}">{escape(label)}</text>')
        return self

    def rule(self, x: float, stroke: str, dash: str = "4 3") -> "Chart":
        self.items.append(f'<line x1="{self.px(x):.1f}" x2="{self.px(x):.1f}" y1="{self.top}" y2="{self.bottom}" '
                          f'stroke="{stroke}" stroke-dasharray="{dash}"/>')
        return self

    def arrow(self, a, b, stroke: str, width: float = 1.0) -> "Chart":
        self.items.append(f'<line x1="{self.px(a[0]):.1f}" y1="{self.py(a[1]):.1f}" x2="{self.px(b[0]):.1f}" '
                          f'y2="{self.py(b[1]):.1f}" stroke="{stroke}" stroke-width="{width}" '
                          f'marker-end="url(#tip)"/>')
        return self


def page(charts: list[Chart]) -> str:
    """Panels stacked in one drawing."""
    width, height = max(c.w for c in charts), sum(c.h for c in charts)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" '
           'font-family="sans-serif" font-size="11"><rect width="100%" height="100%" fill="#fff"/>'
           '<defs><marker id="tip" viewBox="0 0 8 8" refX="7" refY="4" markerWidth="6" markerHeight="6" '
           'orient="auto"><path d="M0,0L8,4L0,8z" fill="#B80C09"/></marker></defs>']
    y = 0
    for c in charts:
        out.append(f'<g transform="translate(0,{y})">' + "".join(c.items) + "</g>")
        y += c.h
    return "\n".join(out) + "\n</svg>\n"


def heat_map(title: str, values: np.ndarray, rows: list[str], columns: list[str],
             numbers: bool = True, fmt: str = ".2f") -> Chart:
    values = np.asarray(values, dtype=float)
    n, m = values.shape
    chart = Chart(title, (0, m), (0, n))
    chart.items = chart.items[:4]
    low, high = np.nanmin(values), np.nanmax(values)
    span = high - low if high > low else 1.0
    for i in range(n):
        for j in range(m):
            chart.box(j, j + 1, n - 1 - i, n - i, shade((values[i, j] - low) / span),
                      format(values[i, j], fmt) if numbers else "")
        if rows:
            chart.items.append(f'<text x="{chart.left - 6}" y="{chart.py(n - i - 0.5) + 4:.1f}" '
                               f'text-anchor="end">{escape(rows[i])}</text>')
    for j, name in enumerate(columns):
        chart.items.append(f'<text x="{chart.px(j + 0.5):.1f}" y="{chart.bottom + 16}" '
                           f'text-anchor="middle">{escape(name)}</text>')
    return chart


def bars(title: str, names: list[str], values, x_label: str = "", y_label: str = "") -> Chart:
    values = np.nan_to_num(np.asarray(values, dtype=float))
    chart = Chart(title, (0, max(len(names), 1)), (min(0.0, *values, 0.0), max(0.0, *values, 1e-9)),
                  x_label, y_label)
    for i, (name, v) in enumerate(zip(names, values)):
        chart.box(i + 0.15, i + 0.85, min(v, 0.0), max(v, 0.0), colour(0))
        chart.text(i + 0.5, max(v, 0.0), f"{name} {v:.3g}")
    return chart


def histogram(title: str, edges, counts, lines=()) -> Chart:
    chart = Chart(title, (edges[0], edges[-1]), (0, max([*counts, 1])), title, "Count")
    for a, b, n in zip(edges[:-1], edges[1:], counts):
        if n:
            chart.box(a, b, 0, n, colour(1))
    for i, v in enumerate(lines):
        chart.rule(v, colour(i))
    return chart
