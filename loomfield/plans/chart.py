"""The saturation curve as a picture: new insights as bars, all insights so far as a line, in SVG."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

WIDTH, HEIGHT, EDGE = 720, 360, 40


def saturation_chart(curve: DataFrame, path: str, title: str = "Insight saturation") -> str:
    """Writes an SVG of (participant_ord, participant, new_insights, total_insights): a row a participant, few enough to be seen, comes to the driver."""
    rows = curve.orderBy("participant_ord").collect()
    most = max((r["total_insights"] for r in rows), default=1) or 1
    step = (WIDTH - 2 * EDGE) / max(1, len(rows))
    height = lambda n: round(n / most * (HEIGHT - 2 * EDGE), 2)
    parts, points = [], []
    for i, r in enumerate(rows):
        left, bar = EDGE + i * step, height(r["new_insights"])
        parts.append(f'<rect x="{left + step * 0.2:.2f}" y="{HEIGHT - EDGE - bar:.2f}" width="{step * 0.6:.2f}" height="{bar:.2f}" fill="#9EC5E8"><title>{escape(str(r["participant"]))}: {r["new_insights"]} new</title></rect>')
        parts.append(f'<text x="{left + step / 2:.2f}" y="{HEIGHT - EDGE + 16}" text-anchor="middle" font-size="11">{escape(str(r["participant"]))}</text>')
        points.append(f"{left + step / 2:.2f},{HEIGHT - EDGE - height(r['total_insights']):.2f}")
    axis = f'<path d="M{EDGE} {EDGE}V{HEIGHT - EDGE}H{WIDTH - EDGE}" fill="none" stroke="#555"/><text x="{EDGE - 6}" y="{EDGE + 4}" text-anchor="end" font-size="11">{most}</text>'
    line = f'<polyline points="{" ".join(points)}" fill="none" stroke="#1F4E78" stroke-width="2"/>'
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif"><text x="{EDGE}" y="22" font-size="15">{escape(title)}</text>{axis}{"".join(parts)}{line}</svg>')
    return path
