"""Small standalone HTML charts of aggregated results (SVG, no scripts)."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

import numpy as np


def _page(title: str, body: str, width: int, height: int) -> str:
    return f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h2>{escape(title)}</h2><svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{height}' font-family='sans-serif' font-size='12'>{body}</svg>"


def heat_map(title: str, names: Sequence[str], values: np.ndarray, columns: Sequence[str] | None = None) -> str:
    """Correlation or confusion matrix."""
    columns, values = list(columns or names), np.asarray(values, float)
    low, high = float(np.nanmin(values)), float(np.nanmax(values))
    cells = []
    for i, row in enumerate(values):
        cells.append(f"<text x='4' y='{64 + 40 * i}'>{escape(str(names[i]))}</text>")
        for j, v in enumerate(row):
            share = 0.0 if high == low else (v - low) / (high - low)
            cells.append(f"<rect x='{120 + 60 * j}' y='{40 + 40 * i}' width='58' height='38' fill='rgb({int(255 - 200 * share)},{int(255 - 120 * share)},255)'/><text x='{132 + 60 * j}' y='{64 + 40 * i}'>{v:.3g}</text>")
    heads = "".join(f"<text x='{124 + 60 * j}' y='30'>{escape(str(c))}</text>" for j, c in enumerate(columns))
    return _page(title, heads + "".join(cells), 140 + 60 * len(columns), 60 + 40 * len(names))


def line(title: str, xs: Sequence[float], ys: Sequence[float]) -> str:
    """ROC or precision-recall curve on [0, 1]."""
    points = " ".join(f"{40 + 300 * x:.1f},{320 - 300 * y:.1f}" for x, y in zip(xs, ys, strict=True))
    return _page(title, f"<rect x='40' y='20' width='300' height='300' fill='none' stroke='#999'/><polyline points='{points}' fill='none' stroke='#2563eb' stroke-width='2'/>", 360, 340)


def bars(title: str, values: dict[str, float]) -> str:
    """Feature importances, the largest first."""
    top = max([abs(v) for v in values.values()] or [1]) or 1
    rows = sorted(values.items(), key=lambda x: -abs(x[1]))
    body = "".join(f"<text x='4' y='{34 + 24 * i}'>{escape(k)}</text><rect x='140' y='{20 + 24 * i}' width='{300 * abs(v) / top:.1f}' height='18' fill='#2563eb'/><text x='{146 + 300 * abs(v) / top:.1f}' y='{34 + 24 * i}'>{v:.4g}</text>" for i, (k, v) in enumerate(rows))
    return _page(title, body, 540, 40 + 24 * len(rows))
