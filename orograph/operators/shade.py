"""Surface shading as column functions of brightness b and the unit normal (x, y, z)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orograph import params
from orograph.functions.color import Stops, gradient, parse_hex

# Fixed value: pi as the shading has it.
PI = 3.14159265
RGB = "rgb"


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rgb(values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(n) for v, n in zip(values, RGB)])


def parts(color: Column) -> list[Column]:
    return [color[n] for n in RGB]


def mix(a: Column, b: Column, t) -> Column:
    return rgb([x * (1 - t) + y * t for x, y in zip(parts(a), parts(b))])


def brightness_cut(b: Column, low: float = 0, high: float = 100) -> Column:
    """H1: whether a fragment stays; hundredths of the whole range. 0 as the upper limit
    means 100."""
    return b.between((low or 0) / 100, (high or 100) / 100)


def mode_value(b: Column, nx: Column, ny: Column, nz: Column, mode: str = "elevation") -> Column:
    """H2: what the gradient is looked up by."""
    return {"slope": clamp(1 - ny), "aspect": F.atan2(nz, nx) / PI * 0.5 + 0.5}.get(mode, b)


def banded(value: Column, b: Column, mode: str = "elevation", interval: float = 10, elev_scale: float = 1) -> Column:
    """H3, H9: the value at the lower end of its band. A scale of 0 means 1."""
    elev_scale = elev_scale or 1
    if mode == "elevation":
        e = (b - 0.5) * 100.0 * elev_scale
        return clamp(F.floor(e / float(interval)) * float(interval) / (100.0 * elev_scale) + 0.5)
    steps = 100.0 / interval
    return clamp(F.floor(value * steps) / steps)


def raw_light(nx: Column, ny: Column, nz: Column) -> Column:
    """H4: the light of two fixed lamps and the surroundings."""
    def lamp(x, y, z, strength):
        s = math.sqrt(x * x + y * y + z * z)
        return F.greatest(F.lit(0.0), nx * (x / s) + ny * (y / s) + nz * (z / s)) * strength

    return lamp(1.0, 2.0, 1.5, 0.7) + lamp(-0.5, 0.5, -1.0, 0.15) + 0.2


def ramp(stops: Stops, value: Column, texels: int = 256) -> Column:
    """H5: the gradient as a table of 8-bit colours."""
    at = F.floor(clamp(value) * (texels - 1) + 0.5) / (texels - 1)
    c = gradient(stops, at)
    return rgb([F.floor(c[n] * 255 + 0.5) / 255 for n in RGB])


def blend(base: Column, texture: Column, mode: str = "normal", opacity: float = 1.0, alpha=1.0) -> Column:
    """H6: a texture over a colour: normal, multiply, screen, overlay, soft-light, add."""

    def one(a: Column, t: Column) -> Column:
        if mode == "multiply":
            return a * t
        if mode == "screen":
            return 1 - (1 - a) * (1 - t)
        if mode == "overlay":
            return F.when(a >= 0.5, 1 - (1 - a) * 2 * (1 - t)).otherwise(a * 2 * t)
        if mode == "soft-light":
            return F.when(t >= 0.5, a + (t * 2 - 1) * (F.sqrt(a) - a)).otherwise(a - (1 - t * 2) * a * (1 - a))
        if mode == "add":
            return clamp(a + t)
        return t

    blended = rgb([one(a, t) for a, t in zip(parts(base), parts(texture))])
    return mix(base, blended, (alpha if isinstance(alpha, Column) else F.lit(float(alpha))) * opacity)


def hillshade(base: Column, nx: Column, ny: Column, nz: Column, *, azimuth=315.0, altitude=45.0, intensity=1.0, opacity=0.6, exaggeration=2.0, highlight="#ffffff", shadow="#000000") -> Column:
    """H7: light from one direction; azimuth 0 is the +x axis. With the normal of the world
    the result doesn't depend on a camera; for that of a camera see ``view.view_normal``."""
    az, alt = azimuth * PI / 180, altitude * PI / 180
    light = (math.cos(az) * math.cos(alt), math.sin(alt), math.sin(az) * math.cos(alt))
    size = math.sqrt(sum(x * x for x in light))
    ex, ez = nx * exaggeration, nz * exaggeration
    length = F.sqrt(ex * ex + ny * ny + ez * ez)
    dot = (ex * (light[0] / size) + ny * (light[1] / size) + ez * (light[2] / size)) / length
    shade = clamp(dot) * intensity
    return mix(base, mix(rgb(parse_hex(shadow)), rgb(parse_hex(highlight)), shade), F.lit(float(opacity)))


def slope_shade(base: Column, ny: Column, *, opacity=0.75, low="#86efac", high="#dc2626") -> Column:
    """H8: the steeper, the more of the steep colour."""
    s = clamp(1 - ny)
    return mix(base, mix(rgb(parse_hex(low)), rgb(parse_hex(high)), s), s * opacity)


def surface(style: dict, b: Column, nx: Column, ny: Column, nz: Column, *, terrain: dict | None = None, raw: bool = False, texture: Column | None = None, alpha=1.0) -> Column:
    """H9: the colour (r, g, b) of a surface by flat style parameters: the fill or gradient
    (H2, H3, H5), the raw light (H4), texture (H6), hillshade (H7) and slope shade (H8), one
    over the other. Null where the elevation band of ``terrain`` cuts the surface away, and
    everywhere if neither fill nor shade is shown. What a style lacks, or gives as None, is
    the default; an interval, a scale or an upper limit of 0 counts as not given, and an
    unknown blend or colour mode as the first. The normal is that of the world or, by
    ``view.view_normal``, that of a camera, as the original has it. Lines between bands
    aren't drawn."""
    t = params.TERRAIN | {k: v for k, v in (terrain or {}).items() if v is not None}
    p = params.style_defaults() | {k: v for k, v in style.items() if v is not None}
    if not (p["showFill"] or raw or p["showHillshade"] or p["showSlopeShade"]):
        return F.lit(None).cast("struct<r: double, g: double, b: double>")
    color = rgb(parse_hex(p["fillColor"]))
    if p["fillHypsometric"]:
        value = mode_value(b, nx, ny, nz, p["fillHypsoMode"])
        if p["fillBanded"]:
            value = banded(value, b, p["fillHypsoMode"] if p["fillHypsoMode"] in ("slope", "aspect") else "elevation", p["fillHypsoInterval"] or 10, t["elevScale"])
        stops = p["gradientStops"] if len(p["gradientStops"]) > 1 else [(0, "#ffffff"), (1, "#ffffff")]
        color = ramp(stops, value)
    if raw:
        color = rgb([x * raw_light(nx, ny, nz) for x in parts(color)])
    if p["showTexture"] and texture is not None:
        color = blend(color, texture, {"softlight": "soft-light"}.get(p["textureBlendMode"], p["textureBlendMode"]), p["textureOpacity"], alpha)
    if p["showHillshade"]:
        color = hillshade(
            color, nx, ny, nz, azimuth=p["hillshadeAzimuth"], altitude=p["hillshadeAltitude"], intensity=p["hillshadeIntensity"], opacity=p["hillshadeOpacity"],
            exaggeration=p["hillshadeExaggeration"], highlight=p["hillshadeHighlightColor"], shadow=p["hillshadeShadowColor"],
        )
    if p["showSlopeShade"]:
        color = slope_shade(color, ny, opacity=p["slopeShadeOpacity"], low=p["slopeColorLow"], high=p["slopeColorHigh"])
    return F.when(brightness_cut(b, t["elevMinCut"], t["elevMaxCut"]), color)
