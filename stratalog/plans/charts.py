"""SVG charts of benchmark aggregates. Spark reduces the rows; what is drawn is a few points."""

from __future__ import annotations

import math
from html import escape

from pyspark.sql import DataFrame

WIDTH, HEIGHT, MARGIN = 720, 360, 60


def bounds(values: list[float]) -> tuple[float, float]:
    """From zero or below to the maximum; a degenerate range is widened by one, and values that
    are not finite give (0, 1)."""
    if not values or not all(map(math.isfinite, values)):
        return 0.0, 1.0
    lo, hi = min(0.0, min(values)), max(values)
    return (lo, hi) if hi > lo else (lo, lo + 1)


def line_chart(title: str, x_labels: list[str], series: dict[str, list[float]]) -> str:
    """One polyline a series, points at equal steps; equal input in any order gives equal bytes."""
    lo, hi = bounds([v for own in series.values() for v in own])
    step = (WIDTH - 2 * MARGIN) / max(1, len(x_labels) - 1)
    x = lambda i: MARGIN + i * step
    y = lambda v: HEIGHT - MARGIN - (v - lo) / (hi - lo) * (HEIGHT - 2 * MARGIN)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}">', f'<text x="{MARGIN}" y="24">{escape(title)}</text>']
    out += [f'<text x="{x(i):.3f}" y="{HEIGHT - 24}">{escape(label)}</text>' for i, label in enumerate(x_labels)]
    out += [f'<text x="4" y="{y(v):.3f}">{v:.3f}</text>' for v in (lo, hi)]
    for k, (name, values) in enumerate(sorted(series.items())):
        points = " ".join(f"{x(i):.3f},{y(v):.3f}" for i, v in enumerate(values))
        hue = 360 * k // max(1, len(series))
        out.append(f'<polyline fill="none" stroke="hsl({hue},60%,40%)" points="{points}"/>')
        out.append(f'<text x="{WIDTH - MARGIN}" y="{40 + 16 * k}">{escape(name)}</text>')
    return "\n".join([*out, "</svg>"])


def chart(rows: DataFrame, x: str, value: str, series: str | None, title: str) -> str:
    """A chart of aggregated rows: (x, series, value)."""
    found = rows.select(*([x, value] + [series] * (series is not None))).collect()  # a point a row
    labels = sorted({r[x] for r in found})
    names = sorted({r[series] for r in found}, key=str) if series else [value]
    at = {(r[series] if series else value, r[x]): float(r[value]) for r in found}
    lines = {str(n): [at[n, label] for label in labels if (n, label) in at] for n in names}
    return line_chart(title, [str(label) for label in labels], lines)
