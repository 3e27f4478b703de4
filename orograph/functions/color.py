"""Colours: hex parsing, gradients, vertex colours and the named tables."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named gradients as (position, colour).
GRADIENTS = {
    "Jet": [(0, "#000080"), (0.25, "#00ffff"), (0.5, "#00ff00"), (0.75, "#ff8800"), (1, "#800000")],
    "Classic": [(0, "#1a1a2e"), (0.5, "#888888"), (1, "#ffffff")],
    "Fire": [(0, "#1a0000"), (0.4, "#ff4400"), (0.7, "#ffaa00"), (1, "#ffffff")],
    "Ocean": [(0, "#001433"), (0.5, "#0066cc"), (1, "#00eeff")],
    "Topo": [(0, "#0d3b00"), (0.3, "#5a8c00"), (0.6, "#c8a800"), (0.85, "#8b4513"), (1, "#ffffff")],
    "Cyber": [(0, "#0d0221"), (0.5, "#b000ff"), (1, "#00ffe7")],
    "Sunset": [(0, "#0a0020"), (0.4, "#c62a6b"), (0.7, "#ff7b3a"), (1, "#ffe066")],
    "Halloween": [(0, "#0a0005"), (0.25, "#3d0066"), (0.5, "#b5000a"), (0.75, "#ff6600"), (1, "#ffcc00")],
}
# SVG dash patterns, and dash and gap sizes of drawn lines.
DASH_SVG = {"solid": "", "dashed": "3 2", "dotted": "2 5", "long-dash": "16 6"}
DASH_SIZES = {"solid": None, "dashed": (4, 3), "dotted": (1.5, 4), "long-dash": (12, 5)}

Stops = list[tuple[float, str]]


def parse_hex(color: str | None) -> tuple[float, float, float]:
    """Red, green and blue from 0 to 1; nothing is black."""
    n = int((color or "#000000").lstrip("#"), 16)
    return tuple((n >> s & 255) / 255 for s in (16, 8, 0))


def hex_channels(color: Column) -> Column:
    """The same for a column, as a struct r, g, b."""
    text = F.coalesce(color, F.lit("#000000"))
    part = lambda at: F.conv(F.substring(text, at, 2), 16, 10).cast("double") / 255
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def _rgb(values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(n) for v, n in zip(values, "rgb")])


def lerp(a, b, t: Column):
    return [x + (y - x) * t for x, y in zip(a, b)]


def gradient(stops: Stops, t: Column) -> Column:
    """The colour at t of a gradient of any number of stops, in any order."""
    if not stops:
        return _rgb((1, 1, 1))
    ordered = sorted(stops, key=lambda s: s[0])  # keeps the order of equals
    colors = [parse_hex(c) for _, c in ordered]
    if len(stops) == 1:
        return _rgb(colors[0])
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    out = F.when(t <= float(ordered[0][0]), _rgb(colors[0])).when(t >= float(ordered[-1][0]), _rgb(colors[-1]))
    for (p0, _), (p1, _), c0, c1 in zip(ordered, ordered[1:], colors, colors[1:]):
        if p1 > p0:
            out = out.when(t <= float(p1), _rgb(lerp(c0, c1, (t - float(p0)) / (float(p1) - float(p0)))))
    return out.otherwise(_rgb(colors[-1]))


def vertex_color(elevation: Column, slope: Column, aspect: Column, *, color="#000000", hypsometric=False, mode="elevation", banded=False, interval=10.0, stops: Stops | None = None) -> Column:
    """A vertex's colour: one colour, or a gradient over normalised elevation or slope, or
    over the aspect (radians), in bands of ``interval`` hundredths if wanted."""
    if not hypsometric or not stops or len(stops) < 2:
        return _rgb(parse_hex(color))
    value = {"slope": slope, "aspect": aspect / (math.pi * 2) + 0.5}.get(mode, elevation)
    if banded:
        steps = 100 / (interval or 10)
        value = F.floor(value * steps) / steps
    return gradient(stops, value)


def luminance(color: Column) -> Column:
    """Of a hex colour, from 0 to 255."""
    c = hex_channels(color)
    return (c["r"] * 299 + c["g"] * 587 + c["b"] * 114) * 255 / 1000


def dash_svg(name: Column) -> Column:
    """The SVG pattern of a dash name; an unknown one is solid."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DASH_SVG.items() for x in kv]), name), F.lit(""))


def edit_gradient(stops: Column, *, add: tuple | None = None, remove=None, move: tuple | None = None, near: float = 0.02) -> Column:
    """An array of (pos, color) with a stop added (unless one is ``near``), removed or
    moved; places, colours and numbers may be columns. The stops at 0 and 1 stay where they
    are."""
    anchor = lambda s: (s["pos"] == 0) | (s["pos"] == 1)
    if add is not None:
        pos, color = add
        new = F.struct(F.lit(pos).cast("double").alias("pos"), F.lit(color).alias("color"))
        stops = F.when(F.exists(stops, lambda s: F.abs(s["pos"] - pos) < near), stops).otherwise(F.array_sort(F.concat(stops, F.array(new))))
    if remove is not None:
        stops = F.filter(stops, lambda s, i: anchor(s) | (i != remove))
    if move is not None:
        at, to = move
        to = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.lit(to).cast("double")))
        stops = F.array_sort(F.transform(stops, lambda s, i: F.when((i == at) & ~anchor(s), F.struct(to.alias("pos"), s["color"].alias("color"))).otherwise(s)))
    return stops
