"""Charts as SVG text from a few rows each: bars, columns, points, a network."""

from __future__ import annotations

import math
from html import escape

COLORS = ("#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#ff8ab7", "#a463f2", "#97bbf5")


def canvas(width: int, height: int, parts: list[str], title: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img" aria-label="{escape(title, True)}">{"".join(parts)}</svg>'


def text(x: float, y: float, content: str, anchor: str = "start") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" font-size="12">{escape(content)}</text>'


def clipped(label: str, most: int = 24) -> str:
    return label if len(label) <= most else label[: most - 1] + "…"


def bar(x: float, y: float, width: float, height: float, color: str, hint: str) -> str:
    return f'<rect x="{x:.1f}" y="{y:.1f}" width="{max(width, 1):.1f}" height="{max(height, 1):.1f}" rx="3" fill="{color}"><title>{escape(hint)}</title></rect>'


def bars(rows: list[tuple[str, float]], title: str, width: int = 640) -> str:
    """Horizontal bars, one line each."""
    top, parts = max((v for _, v in rows), default=0) or 1, []
    for i, (label, value) in enumerate(rows):
        y = 6 + i * 24
        parts += [text(0, y + 14, clipped(label)), bar(190, y, (width - 250) * value / top, 18, COLORS[0], f"{label}: {value:g}"), text(196 + (width - 250) * value / top, y + 14, f"{value:g}")]
    return canvas(width, 12 + 24 * len(rows), parts, title)


def columns(rows: list[tuple[str, float]], title: str, width: int = 640, height: int = 220) -> str:
    """Upright columns over their labels."""
    top, step, parts = max((v for _, v in rows), default=0) or 1, width / max(1, len(rows)), []
    for i, (label, value) in enumerate(rows):
        tall = (height - 50) * value / top
        parts += [bar(i * step + 4, height - 26 - tall, step - 8, tall, COLORS[0], f"{label}: {value:g}"), text((i + 0.5) * step, height - 8, clipped(label, 10), "middle"), text((i + 0.5) * step, height - 32 - tall, f"{value:g}", "middle")]
    return canvas(width, height, parts, title)


def groups(names: list[str]) -> dict[str, str]:
    """A color for each name, in order of names; colors come again after the last."""
    return {name: COLORS[i % len(COLORS)] for i, name in enumerate(sorted(set(names)))}


def points(rows: list[tuple[str, str, float, float]], title: str, size: int = 480) -> str:
    """(label, group, x, y) with x and y in -1..1; a legend names up to as many groups as there are colors."""
    color = groups([r[1] for r in rows])
    at = lambda v: 16 + (v + 1) / 2 * (size - 32)
    parts = [f'<circle cx="{at(x):.1f}" cy="{size - at(y):.1f}" r="4" fill="{color[group]}"><title>{escape(label)}</title></circle>' for label, group, x, y in rows]
    for i, (name, shade) in enumerate(list(color.items())[: len(COLORS)]):
        parts += [bar(size + 8, 8 + i * 20, 12, 12, shade, name), text(size + 26, 18 + i * 20, clipped(name))]
    return canvas(size + 220, size, parts, title)


def network(links: list[tuple[str, str, int, str]], title: str, size: int = 480) -> str:
    """(first, second, strength, hint): documents on a circle, links as wide as they are strong."""
    names = sorted({n for link in links for n in link[:2]})
    place = {n: (size / 2 + (size / 2 - 90) * math.cos(2 * math.pi * i / len(names)), size / 2 + (size / 2 - 40) * math.sin(2 * math.pi * i / len(names))) for i, n in enumerate(names)}
    parts = []
    for a, b, strength, hint in links:
        (x1, y1), (x2, y2) = place[a], place[b]
        parts.append(f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="#999" stroke-width="{min(8, strength)}"><title>{escape(hint)}</title></line>')
    for name, (x, y) in place.items():
        parts += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="6" fill="{COLORS[0]}"/>', text(x, y - 10, clipped(name), "middle")]
    return canvas(size, size, parts, title)
