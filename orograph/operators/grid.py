"""From pixels to a terrain: blur, sampling, levels, slope, and functions of cells.

Pixels are (r, c, raw, valid), one row for each place of a dense raster, raw from 0 to 1.
Cells are (r, c, h, valid, slope). Places without data stay as rows with h = 0, since
neighbourhood operators read them. Neighbours come from windows over rows and over
columns, in blocks of BLOCK cells that overlap as far as an operator looks: two shuffles,
whatever the number of operators on top, and no group that grows with the raster. A
terrain's cells are written once. What describes all of it is one row; it is computed
once and goes into later plans as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orograph.functions.numeric import half_up, value_noise
from orograph.shared import cut_seeing


#: Cells of a row or column that a window's group has, beside its overlap.
BLOCK = 2048


def along(df: DataFrame, axis: str, made, reach: int = 1) -> DataFrame:
    """What ``made`` (of a frame and a window) makes of ``df``, with windows along rows (axis
    c) or columns (axis r) that see ``reach`` cells to either side."""
    block = lambda x: F.floor(x / BLOCK).cast("int")
    dealt = df.withColumn("_b", F.explode(F.sequence(block(F.col(axis) - reach), block(F.col(axis) + reach))))
    window = Window.partitionBy("r" if axis == "c" else "c", "_b").orderBy(axis)
    return made(dealt, window).where(block(F.col(axis)) == F.col("_b")).drop("_b")


@dataclass(frozen=True)
class Meta:
    rows: int
    cols: int
    scl: int
    elev_scale: float
    min_z: float
    max_z: float
    half_w: float
    half_h: float
    max_slope: float


@dataclass(frozen=True)
class Terrain:
    cells: DataFrame
    meta: Meta


def box_blur(df: DataFrame, value: str, radius: float, out: str) -> DataFrame:
    """Adds the mean of ``value`` over the square of side 2 * round(radius) + 1, cut off at
    the raster's edge, in single precision; places without data count with their value. Each axis is a
    difference of prefix sums, so the cost doesn't depend on the radius."""
    k = half_up(radius)
    if radius <= 0 or k == 0:
        return df.withColumn(out, F.col(value))

    names = ["_s", "_n"]

    def sums(df: DataFrame, window, order: str) -> DataFrame:
        so_far = window.rowsBetween(Window.unboundedPreceding, 0)
        summed = df.withColumns({f"_p{n}": F.sum(n).over(so_far) for n in names})
        # the prefix k places on (or the last there is) less the one k + 1 places back
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ends = summed.withColumns({f"_t{n}": F.max(F.struct(order, f"_p{n}")).over(whole)[f"_p{n}"] for n in names})
        reach = {n: F.coalesce(F.lead(f"_p{n}", k).over(window), F.col(f"_t{n}")) - F.coalesce(F.lag(f"_p{n}", k + 1).over(window), F.lit(0)) for n in names}
        return ends.withColumns(reach).drop(*[f"_{x}{n}" for n in names for x in "pt"])

    summed = df.withColumns({"_s": F.col(value).cast("double"), "_n": F.lit(1).cast("long")})
    for axis in "cr":
        summed = along(summed, axis, lambda d, w, order=axis: sums(d, w, order), k)
    return summed.withColumn(out, (F.col("_s") / F.col("_n")).cast("float").cast("double")).drop(*names)


def stride_sample(pixels: DataFrame, width: int, height: int, scl: int = 1, off_x: float = 0, off_y: float = 0):
    """Every scl-th pixel from the offsets on: (pixels with new r and c, rows, cols)."""
    ox, oy = math.floor(off_x), math.floor(off_y)
    cols, rows = max(0, (width - ox) // scl), max(0, (height - oy) // scl)
    r, c = F.col("r") - oy, F.col("c") - ox
    kept = pixels.where((r >= 0) & (c >= 0) & (r % scl == 0) & (c % scl == 0))
    moved = kept.withColumns({"r": (r / scl).cast("int"), "c": (c / scl).cast("int")})
    return moved.where((F.col("r") < rows) & (F.col("c") < cols)), rows, cols


def levels(raw: Column, black: float = 0, white: float = 255) -> Column:
    """Stretches what lies between the black and the white point (of 255) to 0..1."""
    b, w = black / 255, white / 255
    return (F.greatest(F.lit(b), F.least(F.lit(w), raw)) - b) / max(1e-6, w - b)


def with_slope(cells: DataFrame) -> DataFrame:
    """Adds the forward-difference slope of h. A neighbour that isn't there or holds no
    data counts as the cell itself."""

    def ahead(window):
        return F.coalesce(F.when(F.lead("valid").over(window), F.lead("h").over(window)), F.col("h"))

    seen = along(along(cells, "c", lambda d, w: d.withColumn("_e", ahead(w))), "r", lambda d, w: d.withColumn("_s", ahead(w)))
    dx, dy = F.col("_e") - F.col("h"), F.col("_s") - F.col("h")
    return seen.withColumn("slope", F.when(F.col("valid"), F.sqrt(dx * dx + dy * dy)).otherwise(0.0)).drop("_e", "_s")


def build_terrain(pixels: DataFrame, width: int, height: int, *, resolution: int = 1, blur: float = 0, off_x: float = 0, off_y: float = 0, black: float = 0, white: float = 255, elev_scale: float = 1.0) -> Terrain:
    """The terrain of a raster. Heights and slopes are stored in single precision, as
    doubles; the elevation range is that before storing."""
    if elev_scale <= 0:
        raise ValueError("the vertical scale must be positive")
    blurred = box_blur(pixels, "raw", blur, "raw") if blur else pixels
    sampled, rows, cols = stride_sample(blurred, width, height, resolution, off_x, off_y)
    norm = levels(F.col("raw").cast("double"), black, white)
    cells = sampled.select("r", "c", F.when(F.col("valid"), norm).alias("norm"), "valid")
    sloped = with_slope(cells.withColumn("h", F.coalesce(F.col("norm"), F.lit(0.0)).cast("float").cast("double")))
    data = lambda x: F.when(F.col("valid"), F.col(x))
    ends = [F.min(data(x)).alias(f"lo_{x}") for x in ("norm", "c", "r")] + [F.max(data(x)).alias(f"hi_{x}") for x in ("norm", "c", "r", "slope")]
    cells, m = cut_seeing(sloped, *ends)
    some = m["lo_norm"] is not None
    z = lambda b: (b - 0.5) * 100 * elev_scale
    middle = lambda lo, hi, n: (lo + hi) * resolution / 2 if some else (n - 1) * resolution / 2
    meta = Meta(
        rows, cols, resolution, float(elev_scale), z(min(1.0, m["lo_norm"]) if some else 1.0), z(max(0.0, m["hi_norm"]) if some else 0.0),
        float(middle(m["lo_c"], m["hi_c"], cols)), float(middle(m["lo_r"], m["hi_r"], rows)), m["hi_slope"] or 0.0,
    )
    return Terrain(cells.select("r", "c", "h", "valid", F.col("slope").cast("float").cast("double").alias("slope")), meta)


def elevation(t: Terrain, h="h", r="r", c="c", jitter: float = 0.0) -> Column:
    """World elevation of a height, with noise of ``jitter`` units at most."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    e = (col(h) - 0.5) * 100 * t.meta.elev_scale
    if jitter > 0:
        e = e + (value_noise(col(c) * 0.15, col(r) * 0.15) - 0.5) * jitter * 2
    return e


def norm_elevation(m: Meta, e: Column) -> Column:
    """Where an elevation lies in the terrain's range, from 0 to 1."""
    return (e - m.min_z) / (m.max_z - m.min_z) if m.max_z > m.min_z else F.lit(0.0)


def in_band(m: Meta, e: Column, low: float = 0, high: float = 100) -> Column:
    """Whether an elevation lies in a band given in hundredths of the range."""
    return norm_elevation(m, e).between(low / 100, high / 100)


def world_x(m: Meta, c) -> Column:
    return (F.col(c) if isinstance(c, str) else c) * m.scl - m.half_w


def world_z(m: Meta, r) -> Column:
    return (F.col(r) if isinstance(r, str) else r) * m.scl - m.half_h


def neighbours(df: DataFrame, *names: str) -> DataFrame:
    """Adds the eight neighbours as structs of ``names``: nw n ne w e sw s se; null
    outside the raster."""
    own = F.struct(*names)
    row = along(df, "c", lambda d, w: d.withColumns({"_w": F.lag(own).over(w), "_e": F.lead(own).over(w)}))
    three = F.struct(F.col("_w").alias("w"), own.alias("m"), F.col("_e").alias("e"))
    both = along(row, "r", lambda d, w: d.withColumns({"_n": F.lag(three).over(w), "_s": F.lead(three).over(w)}))
    place = {"nw": "_n.w", "n": "_n.m", "ne": "_n.e", "w": "_w", "e": "_e", "sw": "_s.w", "s": "_s.m", "se": "_s.e"}
    return both.select(*df.columns, *[F.col(v).alias(k) for k, v in place.items()])


def squares(cells: DataFrame, corner: Column) -> DataFrame:
    """Adds to each cell the corners (``corner`` of a cell) of the square that it begins: tl,
    tr, bl, br; null outside the raster."""
    right = along(cells.withColumn("tl", corner), "c", lambda d, w: d.withColumn("tr", F.lead("tl").over(w)))
    low = along(right, "r", lambda d, w: d.withColumn("_low", F.lead(F.struct("tl", "tr")).over(w)))
    return low.withColumns({"bl": F.col("_low.tl"), "br": F.col("_low.tr")}).drop("_low")


def mirror_raster(pixels: DataFrame, size: int, axis: str) -> DataFrame:
    """A raster twice as wide (axis c) or high (axis r): its mirror image, then itself."""
    return pixels.withColumn(axis, F.lit(size - 1) - F.col(axis)).unionByName(pixels.withColumn(axis, F.col(axis) + size)).withColumn(axis, F.col(axis).cast("int"))


def histogram(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """(bin, n, share): pixels by brightness, all of them; share is of the fullest bin
    but the first and last, 1 at most."""
    top = bins - 1
    counted = pixels.groupBy(F.least(F.lit(top), F.floor(F.col("raw") * top)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    full = pixels.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").fillna(0, ["n"])
    inner = counted.where((F.col("bin") > 0) & (F.col("bin") < top)).agg(F.max("n").alias("most"))  # one row
    return full.crossJoin(F.broadcast(inner)).select("bin", "n", F.least(F.lit(1.0), F.col("n") / F.greatest(F.coalesce("most", F.lit(1)), F.lit(1))).alias("share"))


def auto_resolution(width: int, height: int, target: int = 1024) -> int:
    return min(20, max(1, math.ceil(max(width, height) / target)))


def safe_resolution(resolution: int, width: int, height: int, most: int = 1000) -> int:
    return max(resolution, math.ceil(max(width, height) / most))


def auto_zoom(width: int, height: int) -> float:
    return min(4.0, max(0.05, 500 / max(width, height)))


def suggested_scale(value_range: float, pixel_size: float | None) -> float | None:
    """A vertical scale for a raster whose values and pixels have the same unit; pixels of
    less than one unit are taken for degrees."""
    if not pixel_size:
        return None
    px = abs(pixel_size)
    px = px * 111_320 if px < 1 else px
    return min(50.0, max(0.1, half_up(value_range / (px * 100) * 100) / 100))


def percent_to_metres(percent: float, low: float, high: float) -> float:
    return low + (high - low) * percent / 100


def metres_to_percent(metres: float, low: float, high: float) -> float:
    return (metres - low) / (high - low) * 100 if high > low else 0.0
