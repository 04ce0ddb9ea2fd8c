"""SVG charts of small aggregated results."""

from __future__ import annotations

from html import escape

from ..functions.scalars import HEAT_END

WIDTH, HEIGHT, MARGIN = 960, 540, 70
COLORS = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#ff7f0e", "#8c564b", "#17becf", "#7f7f7f")


def _page(title: str, parts: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="12"><rect width="100%" height="100%" fill="white"/>'
    return "\n".join([head, f'<text x="{WIDTH / 2}" y="28" text-anchor="middle" font-size="18">{escape(title)}</text>', *parts, "</svg>"])


def _text(x: float, y: float, s: str, anchor: str = "middle", turn: int = 0) -> str:
    rotate = f' transform="rotate({turn} {x:.1f} {y:.1f})"' if turn else ""
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}"{rotate}>{escape(s)}</text>'


def bar_chart(title: str, pairs: list[tuple[str, float]], y_label: str) -> str:
    """Labelled bars with a tenth of headroom."""
    top = max((v for _, v in pairs), default=0) * 1.1 or 1.0
    slot, floor = (WIDTH - 2 * MARGIN) / max(len(pairs), 1), HEIGHT - MARGIN
    parts = [_text(20, HEIGHT / 2, y_label, turn=-90)]
    for i, (name, v) in enumerate(pairs):
        h, x = v / top * (HEIGHT - 2 * MARGIN), MARGIN + i * slot
        parts += [f'<rect x="{x + slot * 0.1:.1f}" y="{floor - h:.1f}" width="{slot * 0.8:.1f}" height="{h:.1f}" fill="{COLORS[0]}"/>', _text(x + slot / 2, floor + 14, name, "end", -35), _text(x + slot / 2, floor - h - 4, f"{v:g}")]
    return _page(title, parts)


def histogram_chart(title: str, bins: list[tuple[float, int]], width: float, y_label: str = "count") -> str:
    """Bars of (bin start, count); without bins there is nothing to draw."""
    return bar_chart(title, [(f"{b:g}-{b + width:g}", n) for b, n in bins], y_label) if bins else ""


def line_chart(title: str, series: list[tuple[str, list[tuple[float, float]]]], x_label: str, y_label: str) -> str:
    """Lines over shared axes, with a legend."""
    points = [p for _, ps in series for p in ps]
    if not points:
        return ""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    x0, x1, pad = min(xs), max(xs), max(max(ys) - min(ys), 1.0) * 0.05
    y0, y1 = min(ys) - pad, max(ys) + pad
    px = lambda x: MARGIN + (x - x0) / ((x1 - x0) or 1.0) * (WIDTH - 2 * MARGIN)
    py = lambda y: HEIGHT - MARGIN - (y - y0) / (y1 - y0) * (HEIGHT - 2 * MARGIN)
    parts = [_text(WIDTH / 2, HEIGHT - 20, x_label), _text(20, HEIGHT / 2, y_label, turn=-90)]
    for x in (x0, (x0 + x1) / 2, x1):
        parts.append(_text(px(x), HEIGHT - MARGIN + 16, f"{x:g}"))
    for y in (y0, (y0 + y1) / 2, y1):
        parts.append(_text(MARGIN - 6, py(y), f"{y:.3g}", "end"))
    for i, (name, ps) in enumerate(series):
        color = COLORS[i % len(COLORS)]
        parts.append(f'<polyline fill="none" stroke="{color}" points="{" ".join(f"{px(x):.1f},{py(y):.1f}" for x, y in ps)}"/>')
        parts += [f'<rect x="{WIDTH - MARGIN - 120}" y="{MARGIN + 18 * i - 9}" width="12" height="12" fill="{color}"/>', _text(WIDTH - MARGIN - 102, MARGIN + 18 * i + 1, name, "start")]
    return _page(title, parts)


def cell_color(share: float) -> str:
    f = min(max(share, 0.0), 1.0)
    return "#" + "".join(f"{int(255 + (c - 255) * f + 0.5):02x}" for c in HEAT_END)


def heatmap(title: str, labels: list[str], matrix: list[list[int]]) -> str:
    """A confusion matrix; cells are colored by their share of the row, empty rows stay white."""
    side = min(WIDTH, HEIGHT) - 2 * MARGIN
    step, parts = side / max(len(labels), 1), []
    for i, (name, row) in enumerate(zip(labels, matrix, strict=True)):
        total = sum(row)
        parts += [_text(MARGIN - 6, MARGIN + (i + 0.6) * step, name, "end"), _text(MARGIN + (i + 0.5) * step, MARGIN + side + 14, name, "end", -45)]
        for j, n in enumerate(row):
            share = n / total if total else 0.0
            parts.append(f'<rect x="{MARGIN + j * step:.1f}" y="{MARGIN + i * step:.1f}" width="{step:.1f}" height="{step:.1f}" fill="{cell_color(share)}" stroke="#ccc"/>')
            if n:
                parts.append(_text(MARGIN + (j + 0.5) * step, MARGIN + (i + 0.6) * step, str(n)))
    return _page(title, parts)
