"""Bar charts and reports of small results, as text."""

from __future__ import annotations

import colorsys
import os
from datetime import datetime
from html import escape

from pyspark.sql import DataFrame

from foliant.operators.analytics import bar_heights, benchmark_report, sizes_present


def svg_bars(df: DataFrame, label: str, value: str, title: str, width: int = 1000, height: int = 600, padding: int = 60) -> str:
    """An SVG bar chart of a few rows, in their order."""
    rows = [(str(r[label]), r[value], r["bar"]) for r in bar_heights(df, value, height, padding).collect()]
    step = (width - 2 * padding) / max(1, len(rows))
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="{width / 2}" y="30" text-anchor="middle">{escape(title)}</text>']
    for k, (name, number, bar) in enumerate(rows):
        red, green, blue = (int(255 * c) for c in colorsys.hsv_to_rgb(k / len(rows), 0.7, 0.9))
        x = padding + k * step
        parts.append(f'<rect x="{x:.1f}" y="{height - padding - bar}" width="{step * 0.8:.1f}" height="{bar}" fill="rgb({red},{green},{blue})"/>')
        parts.append(f'<text x="{x:.1f}" y="{height - padding - bar - 4}" font-size="10">{number:g}</text><text x="{x:.1f}" y="{height - padding + 14}" font-size="10">{escape(name)}</text>')
    return "".join(parts) + "</svg>"


def benchmark_chart(times: DataFrame, size: int) -> str:
    """The chart of one size's timings; a message where that size isn't there."""
    if sizes_present(times).where(f"size = {int(size)}").isEmpty():
        return f"no timings of size {size}"
    return svg_bars(benchmark_report(times, size), "method", "time_ms", f"Sorting {size} integers (ms)")


def save_benchmark_chart(times: DataFrame, size: int, folder: str) -> str | None:
    """The chart as ``benchmark_general_<size>.svg`` in a folder, and its path; None where that size isn't there."""
    chart = benchmark_chart(times, size)
    if not chart.startswith("<svg"):
        return None
    path = os.path.join(folder, f"benchmark_general_{size}.svg")
    with open(path, "w", encoding="utf-8") as f:
        f.write(chart)
    return path


def report(stats: DataFrame, status: str = "COMPLETED", started: datetime | None = None, ended: datetime | None = None, authors: DataFrame | None = None, times: DataFrame | None = None) -> str:
    """What a run came to: its statistics and, where given, its times, the author ranking and the timings of sorts."""
    r = stats.first()
    lines = [
        f"status: {status}", f"records: {r.total_records}", f"unique: {r.unique_records}", f"duplicates: {r.duplicates_found}",
        f"from DBLP: {r.dblp_records}", f"from OpenAlex: {r.openalex_records}", f"duplicates in percent: {r.duplicate_percentage:.2f}%",
    ]
    lines += [f"{name}: {at:%Y-%m-%d %H:%M:%S}" for name, at in (("started", started), ("ended", ended)) if at]
    if started and ended:
        lines.append(f"seconds: {(ended - started).total_seconds():.3f}")
    if authors is not None:
        lines += ["top authors:", *(f"{k}. {a.author}: {a.appearances}" for k, a in enumerate(authors.collect(), 1))]  # a ranking is short
    if times is not None:
        lines += ["sorts:", *(f"{t['method']}: {t['time_ms']:.4f} ms" for t in times.collect())]
    return "\n".join(lines)
