"""The twelve feature extractors: from a terrain to line segments.

A segment has its end points (x0, y0, z0, x1, y1, z1) and what its colours depend on:
normalised elevations n0 and n1, slopes s0 and s1 (of the steepest), and the aspect. All
but the flow lines and closed contours are projections over windows, generators and
joins; nothing is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.color import vertex_color
from orograph.functions.numeric import half_up, uniform
from orograph.operators.grid import Terrain, along, box_blur, elevation, in_band, neighbours, norm_elevation, squares, world_x, world_z

POINTS = ["x0", "y0", "z0", "x1", "y1", "z1"]
BAND = (0, 100)


def step_of(t: Terrain, spacing: float) -> int:
    return max(1, half_up(spacing / t.meta.scl))


def steepness(t: Terrain, slope="slope") -> Column:
    return (F.col(slope) if isinstance(slope, str) else slope) / (t.meta.max_slope or 1.0)


def _segment(t: Terrain, ends: list[Column], s0, s1, aspect, *more: Column) -> list[Column]:
    number = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    named = [number(e).alias(n) for e, n in zip(ends, POINTS)]
    return [*named, norm_elevation(t.meta, ends[1]).alias("n0"), norm_elevation(t.meta, ends[4]).alias("n1"), number(s0).alias("s0"), number(s1).alias("s1"), number(aspect).alias("aspect"), *more]


def every(column: str, step: int, start: int = 0) -> Column:
    return (F.col(column) >= start) & ((F.col(column) - start) % step == 0)


def ridgelines(t: Terrain, *, along_columns: bool = False, spacing: float = 4, shift: float = 0, band=BAND, jitter: float = 0) -> DataFrame:
    """M1, M2: every step-th row (or column) as a line through consecutive cells with
    data in the band."""
    step = step_of(t, spacing)
    outer, inner = ("c", "r") if along_columns else ("r", "c")
    ahead = F.struct("r", "c", "h", "valid", "slope")
    lines = along(t.cells.where(every(outer, step, int(shift) % step)), inner, lambda d, w: d.withColumn("b", F.lead(ahead).over(w))).where(F.col("valid") & F.col("b.valid"))
    e0, e1 = elevation(t, jitter=jitter), elevation(t, "b.h", "b.r", "b.c", jitter)
    kept = lines.where(in_band(t.meta, e0, *band) & in_band(t.meta, e1, *band))
    ends = [world_x(t.meta, "c"), e0, world_z(t.meta, "r"), world_x(t.meta, "b.c"), e1, world_z(t.meta, "b.r")]
    return kept.select(*_segment(t, ends, steepness(t), steepness(t, "b.slope"), math.pi if along_columns else math.pi / 2))


def crosshatch(t: Terrain, *, spacing: float = 4, **options) -> DataFrame:
    """M3: the rows' lines and the columns' lines."""
    return ridgelines(t, spacing=spacing, **options).unionByName(ridgelines(t, along_columns=True, spacing=spacing, **options))


def pillars(t: Terrain, *, spacing: float = 8, gap: float = 0, depth: float = 0, style: str = "line", size: float = 0.8, sides: int = 8, band=BAND, jitter: float = 0) -> DataFrame:
    """M4: a line, box or cylinder from below the terrain up to each step-th cell."""
    return _pillar_parts(t, spacing, gap, depth, style, size, sides, band, jitter, lids=False)


def pillar_lids(t: Terrain, *, spacing: float = 8, gap: float = 0, depth: float = 0, style: str = "cuboid", size: float = 0.8, sides: int = 8, band=BAND, jitter: float = 0) -> DataFrame:
    """The tops of boxes and cylinders as triangles: r, c, part, and a, b, c corners as
    structs x, y, z."""
    return _pillar_parts(t, spacing, gap, depth, style, size, sides, band, jitter, lids=True)


def _pillar_parts(t, spacing, gap, depth, style, size, sides, band, jitter, lids):
    step, m = step_of(t, spacing), t.meta
    e, bottom = elevation(t, jitter=jitter), m.min_z - depth
    p = (
        t.cells.where(every("r", step) & every("c", step) & F.col("valid")).withColumn("e", e).where(in_band(m, F.col("e"), *band))
        .select("r", "c", "slope", world_x(m, "c").alias("x"), (F.col("e") - gap).alias("top"), world_z(m, "r").alias("z")).where(F.col("top") > bottom)
    )
    half, n = size * step * m.scl * 0.5, max(3, half_up(sides))
    if style == "cuboid":
        ring = [(-half, -half), (half, -half), (half, half), (-half, half)]
    elif style == "cylinder":
        turn = lambda i: i / n * math.pi * 2
        ring = [(half * math.cos(turn(i)), half * math.sin(turn(i))) for i in range(n)]
        # the last side ends where the turn is full, not on the first corner's own number
        closing = (half * math.cos(turn(n)), half * math.sin(turn(n)))
    else:
        if lids:
            raise ValueError("lines have no lids")
        ring = None
    point = lambda xz, y: F.struct((F.col("x") + xz[0]).alias("x"), y.alias("y"), (F.col("z") + xz[1]).alias("z"))
    top, base = F.col("top"), F.lit(float(bottom))
    if lids:
        if style == "cuboid":
            faces = [(ring[0], ring[1], ring[2]), (ring[0], ring[2], ring[3])]
        else:
            faces = [((0.0, 0.0), ring[i], ring[(i + 1) % n]) for i in range(n)]
        made = F.array(*[F.struct(*[point(k, top).alias(name) for k, name in zip(f, ("a", "b", "c_"))]) for f in faces])
        return p.select("r", "c", "slope", "top", F.posexplode(made).alias("part", "f")).select("r", "c", "slope", "top", "part", F.col("f.a").alias("p0"), F.col("f.b").alias("p1"), F.col("f.c_").alias("p2"))
    if ring is None:
        edges = [((0.0, 0.0), base, (0.0, 0.0), top)]
    else:
        following = ring[1:] + [ring[0] if style == "cuboid" else closing]
        edges = [(a, y, b, y) for a, b in zip(ring, following) for y in (top, base)] + [(a, base, a, top) for a in ring]
    ends = F.array(*[F.struct(point(a, ya).alias("a"), point(b, yb).alias("b")) for a, ya, b, yb in edges])
    s = p.select("slope", "top", F.explode(ends).alias("s"))
    steep = lambda y: F.when(y == F.col("top"), steepness(t)).otherwise(0.0)
    return s.select(*_segment(t, [F.col(f"s.{p_}.{a}") for p_ in "ab" for a in "xyz"], steep(F.col("s.a.y")), steep(F.col("s.b.y")), 0.0))


# Which edges (0 top, 1 right, 2 bottom, 3 left) a contour joins, by the
# corners at or above the level (8 top left, 4 top right, 2 bottom right, 1 bottom left).
MARCHING = {1: [3, 2], 2: [2, 1], 3: [3, 1], 4: [0, 1], 5: [0, 3, 2, 1], 6: [0, 2], 7: [0, 3], 8: [0, 3], 9: [0, 2], 10: [0, 1, 2, 3], 11: [0, 1], 12: [3, 1], 13: [2, 1], 14: [3, 2]}
BELOW = 1e-7


def contour_crossings(t: Terrain, *, interval: float = 4, band=BAND) -> DataFrame:
    """Marching squares: (r, c, i, elev, part, c0, r0, c1, r1) of each crossing of a square
    (top left r, c) by level i, in grid coordinates. Each square meets only the levels in
    its own range; a corner without data lies just below any level, so squares with one
    meet all up to their highest."""
    m = t.meta
    first = math.ceil((m.min_z - 1e-7) / interval) * interval
    count = max(0, math.floor((math.ceil(m.max_z / interval) * interval - first) / interval) + 1)
    some = F.col("br").isNotNull() & (F.col("tl.valid") | F.col("tr.valid") | F.col("bl.valid") | F.col("br.valid"))
    corners = squares(t.cells, F.struct("h", "valid")).select("r", "c", "tl", "tr", "bl", "br").where(some)
    names = ["tl", "tr", "br", "bl"]
    z = lambda h: (h - 0.5) * 100 * m.elev_scale
    heights = [F.when(F.col(f"{n}.valid"), F.col(f"{n}.h")) for n in names]
    whole = F.col("tl.valid") & F.col("tr.valid") & F.col("bl.valid") & F.col("br.valid")
    # one level more on either side; the corners decide
    low = F.when(whole, F.greatest(F.lit(0), F.floor((z(F.least(*heights)) - first) / interval) - 1)).otherwise(0)
    high = F.least(F.lit(count - 1), F.ceil((z(F.greatest(*heights)) - first) / interval) + 1)
    met = corners.withColumns({"lo": low.cast("int"), "hi": high.cast("int")}).where("lo <= hi").withColumn("i", F.explode(F.sequence("lo", "hi")))
    elev = F.lit(float(first)) + F.col("i") * F.lit(float(interval))
    leveled = met.withColumn("elev", elev).where(in_band(m, F.col("elev"), *band)).withColumn("level", F.col("elev") / (100 * m.elev_scale) + 0.5)
    value = {n: F.when(F.col(f"{n}.valid"), F.col(f"{n}.h")).otherwise(F.col("level") - BELOW) for n in names}
    v = leveled.withColumns({f"v{n}": e for n, e in value.items()})
    index = sum((F.when(F.col(f"v{n}") >= F.col("level"), bit).otherwise(0) for n, bit in zip(names, (8, 4, 2, 1))), F.lit(0))
    table = F.array(*[F.array(*[F.lit(x) for x in MARCHING.get(k, [])]).cast("array<int>") for k in range(16)])
    crossing = v.withColumn("idx", index).where("idx > 0 and idx < 15").withColumn("e", F.element_at(table, F.col("idx") + 1))
    parts = crossing.withColumn("part", F.explode(F.sequence(F.lit(0), (F.size("e") / 2 - 1).cast("int"))))

    def between(a, b):
        d = F.col(f"v{b}") - F.col(f"v{a}")
        return F.when(F.abs(d) < 1e-10, 0.5).otherwise((F.col("level") - F.col(f"v{a}")) / d)

    at = lambda c, r: F.struct(c.cast("double").alias("c"), r.cast("double").alias("r"))
    c, r = F.col("c"), F.col("r")
    edges = F.array(at(c + between("tl", "tr"), r), at(c + 1, r + between("tr", "br")), at(c + between("bl", "br"), r + 1), at(c, r + between("tl", "bl")))
    end = lambda k: F.element_at(F.col("edges"), F.element_at("e", F.col("part") * 2 + k) + 1)
    both = parts.withColumn("edges", edges).select("r", "c", "i", "elev", "part", end(1).alias("a"), end(2).alias("b"))
    return both.select("r", "c", "i", "elev", "part", F.col("a.c").alias("c0"), F.col("a.r").alias("r0"), F.col("b.c").alias("c1"), F.col("b.r").alias("r1"))


def is_major(i: Column, every_: int, offset: int = 1) -> Column:
    """Whether level i (from 0) is a major one; every_ 0: none, 1: all."""
    if every_ > 1:
        return (i + (every_ - offset)) % every_ == 0
    return F.lit(every_ == 1)


def contours(t: Terrain, *, interval: float = 4, major: int = 10, offset: int = 1, close: bool = False, band=BAND) -> DataFrame:
    """M5: contour segments in layers Contours-Minor and Contours-Major; with ``close``,
    open ends on the raster's border are joined along it."""
    from orograph.operators.sequential import close_rings

    lines = contour_crossings(t, interval=interval, band=band)
    if close:
        lines = close_rings(lines, t.meta.rows, t.meta.cols)
    layer = F.when(is_major(F.col("i"), major, offset), "Contours-Major").otherwise("Contours-Minor").alias("layer")
    m, e = t.meta, F.col("elev")
    ends = [world_x(m, "c0"), e, world_z(m, "r0"), world_x(m, "c1"), e, world_z(m, "r1")]
    return lines.select(*_segment(t, ends, 0.0, 0.0, 0.0, F.col("i"), layer))


def hachure(t: Terrain, *, spacing: float = 4, length: float = 1, band=BAND, jitter: float = 0) -> DataFrame:
    """M6: a stroke across the gradient, the longer the steeper, on each step-th cell."""
    step, m = step_of(t, spacing), t.meta
    around = neighbours(t.cells, "h", "valid").where(every("r", step) & every("c", step) & F.col("valid"))
    h = lambda n: F.coalesce(F.when(F.col(f"{n}.valid"), F.col(f"{n}.h")), F.col("h"))
    g = around.withColumns({"e": elevation(t, jitter=jitter), "gx": (h("e") - h("w")) * 50 * m.elev_scale, "gz": (h("s") - h("n")) * 50 * m.elev_scale})
    g = g.withColumn("mag", F.sqrt(F.col("gx") * F.col("gx") + F.col("gz") * F.col("gz"))).where(in_band(m, F.col("e"), *band) & (F.col("mag") >= 0.005))
    tick = F.col("mag") * length * m.scl
    dx, dz = -F.col("gz") / F.col("mag") * tick * 0.5, F.col("gx") / F.col("mag") * tick * 0.5
    x, z = world_x(m, "c"), world_z(m, "r")
    return g.select(*_segment(t, [x - dx, F.col("e"), z - dz, x + dx, F.col("e"), z + dz], steepness(t), steepness(t), F.atan2("gz", "gx")))


def drainage(t: Terrain) -> DataFrame:
    """M8: (r, c, h, slope, dr, dc, dh): each cell with data and its lowest strictly lower
    neighbour, the first in reading order of equals. Cells without one are left out."""
    around = neighbours(t.cells, "h", "valid")
    # reading order is the order of (dr, dc), so the least struct is the first of the lowest
    places = [("nw", -1, -1), ("n", -1, 0), ("ne", -1, 1), ("w", 0, -1), ("e", 0, 1), ("sw", 1, -1), ("s", 1, 0), ("se", 1, 1)]
    options = F.array(*[F.when(F.col(f"{n}.valid") & (F.col(f"{n}.h") < F.col("h")), F.struct(F.col(f"{n}.h").alias("h"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"))) for n, dr, dc in places])
    best = around.where("valid").withColumn("to", F.array_min(F.array_compact(options))).where(F.col("to").isNotNull())
    return best.select("r", "c", "h", "slope", (F.col("r") + F.col("to.dr")).alias("dr"), (F.col("c") + F.col("to.dc")).alias("dc"), F.col("to.h").alias("dh"))


def streams(t: Terrain, *, threshold: float = 2, band=BAND) -> DataFrame:
    """Drainage of cells whose stream order reaches the threshold."""
    from orograph.operators.sequential import stream_order

    edges = drainage(t)
    order = stream_order(edges).where(F.col("ord") >= max(1, half_up(threshold)))
    m, e0 = t.meta, elevation(t)
    kept = edges.join(order, ["r", "c"]).where(in_band(m, e0, *band))
    ends = [world_x(m, "c"), e0, world_z(m, "r"), world_x(m, "dc"), elevation(t, "dh"), world_z(m, "dr")]
    return kept.select(*_segment(t, ends, steepness(t), steepness(t), F.atan2((F.col("dr") - F.col("r")).cast("double"), (F.col("dc") - F.col("c")).cast("double"))))


def pencil(t: Terrain, *, spacing: float = 4, threshold: float = 0.5, band=BAND, jitter: float = 0) -> DataFrame:
    """M9: crosses on convex cells, the larger the sharper."""
    step, m = step_of(t, spacing), t.meta
    inner = every("r", step, step) & every("c", step, step) & (F.col("r") < m.rows - step) & (F.col("c") < m.cols - step) & (F.col("r") < m.rows - 1) & (F.col("c") < m.cols - 1)
    curved = neighbours(t.cells, "h").where(inner & F.col("valid"))
    curve = -(F.col("n.h") + F.col("s.h") + F.col("w.h") + F.col("e.h") - F.col("h") * 4) * 100
    p = curved.withColumns({"curv": curve, "elev": elevation(t, jitter=jitter)}).where((F.col("curv") >= threshold) & in_band(m, F.col("elev"), *band))
    size, x, z, y = F.least(F.lit(2.0 * m.scl), F.col("curv") * 0.5) * 0.7, world_x(m, "c"), world_z(m, "r"), F.col("elev")
    return p.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).select(*_segment(t, [x - size, y, z - size * F.col("sign"), x + size, y, z + size * F.col("sign")], 0.0, 0.0, 0.0))


def ridges(t: Terrain, *, spacing: float = 1, radius: float = 1, threshold: float = 0.1, band=BAND, jitter: float = 0) -> DataFrame:
    """Joins cells whose smoothed surface bends down sharply (the lower eigenvalue of
    the Hessian) to neighbours to the east and below that do, too."""
    step, m = step_of(t, spacing), t.meta
    s = neighbours(box_blur(t.cells, "h", radius, "b"), "b")
    b = lambda n: F.col(f"{n}.b")
    hxx, hyy = b("e") + b("w") - F.col("b") * 2, b("s") + b("n") - F.col("b") * 2
    hxy = (b("se") - b("sw") - b("ne") + b("nw")) / 4
    trace, det = F.col("hxx") + F.col("hyy"), F.col("hxx") * F.col("hyy") - F.col("hxy") * F.col("hxy")
    bend = -(trace - F.sqrt(F.greatest(F.lit(0.0), trace * trace - det * 4))) / 2
    inner = F.col("valid") & F.col("r").between(1, m.rows - 2) & F.col("c").between(1, m.cols - 2)
    curved = s.withColumns({"hxx": hxx, "hyy": hyy, "hxy": hxy}).withColumn("ridge", F.coalesce(inner & (bend > threshold * 0.1), F.lit(False)))
    linked = neighbours(curved.select("r", "c", "h", "slope", "ridge"), "h", "ridge").where(F.col("ridge") & every("r", step, 1) & every("c", step, 1))
    to = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.col(f"{n}.h").alias("h"), F.col(f"{n}.ridge").alias("ridge")) for n, dr, dc in (("e", 0, 1), ("sw", 1, -1), ("s", 1, 0), ("se", 1, 1))])
    joined = linked.withColumn("to", F.explode(to)).where("to.ridge")
    r1, c1 = F.col("r") + F.col("to.dr"), F.col("c") + F.col("to.dc")
    e0, e1 = elevation(t, jitter=jitter), elevation(t, "to.h", r1, c1, jitter)
    ends = [world_x(m, "c"), e0, world_z(m, "r"), world_x(m, c1), e1, world_z(m, r1)]
    return joined.where(in_band(m, e0, *band) & in_band(m, e1, *band)).select(*_segment(t, ends, steepness(t), steepness(t), 0.0))


def position_marks(t: Terrain, *, spacing: float = 2, radius: float = 2, threshold: float = 0.5, ridge: bool = False, band=BAND, jitter: float = 0) -> DataFrame:
    """Marks on cells well below (or, with ``ridge``, above) the mean around them."""
    step, m = step_of(t, spacing), t.meta
    p = box_blur(t.cells, "h", radius, "b").where(F.col("valid") & every("r", step) & every("c", step)).withColumn("tpi", F.col("h") - F.col("b"))
    p = p.where((F.col("tpi") > threshold * 0.05) if ridge else (F.col("tpi") < -threshold * 0.05)).withColumn("elev", elevation(t, jitter=jitter)).where(in_band(m, F.col("elev"), *band))
    size, x, z, y = F.abs("tpi") * 50 * m.scl, world_x(m, "c"), world_z(m, "r"), F.col("elev")
    return p.select(*_segment(t, [x - size, y, z, x + size, y, z], steepness(t), steepness(t), 0.0))


def stipple(t: Terrain, *, spacing: float = 0.5, density: str = "slope", gamma: float = 1.2, scatter: float = 0.8, seed: int = 1, band=BAND, jitter: float = 0) -> DataFrame:
    """Short marks scattered around each step-th cell, the denser the steeper (or
    flatter, higher, lower: slope, invSlope, elevation, invElev). The random numbers are
    functions of cell and seed, so a run can be repeated."""
    step, m = step_of(t, spacing), t.meta
    eps, amount = max(0.001, m.scl * 0.003), scatter * step
    u = lambda k: uniform(F.col("r"), F.col("c"), seed * 3 + k)
    marks = t.cells.where(every("r", step) & every("c", step)).select(
        (F.col("r") + (u(0) - 0.5) * amount).alias("jr"), (F.col("c") + (u(1) - 0.5) * amount).alias("jc"), u(2).alias("draw")
    )
    inside = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x))).cast("int")
    at = marks.withColumns({"r": inside(F.col("jr"), m.rows), "c": inside(F.col("jc"), m.cols)}).join(t.cells.where("valid"), ["r", "c"])
    p = at.withColumn("elev", elevation(t, jitter=jitter)).where(in_band(m, F.col("elev"), *band))
    n = norm_elevation(m, F.col("elev"))
    d = {"elevation": n, "invElev": 1 - n, "invSlope": 1 - steepness(t)}.get(density, steepness(t))
    kept = p.where(F.col("draw") <= F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)), F.lit(float(gamma))))
    x, z, y = F.col("jc") * m.scl - m.half_w, F.col("jr") * m.scl - m.half_h, F.col("elev")
    return kept.select(*_segment(t, [x - eps, y, z, x + eps, y, z], steepness(t), steepness(t), 0.0))


def colored(segments: DataFrame, **style) -> DataFrame:
    """Adds the colours of both ends (structs color0 and color1); ``style`` as for
    ``vertex_color``."""
    return segments.withColumns({f"color{k}": vertex_color(F.col(f"n{k}"), F.col(f"s{k}"), F.col("aspect"), **style) for k in (0, 1)})


def colored_layers(segments: DataFrame, coloring: dict[str, dict]) -> DataFrame:
    """The same for segments of several layers, each with the style of its mode."""
    mode = F.regexp_extract("layer", "^[^-]*", 0)  # the contours' two layers have one style

    def color(k: int) -> Column:
        out = F.lit(None)
        for name, style in coloring.items():
            out = F.when(mode == name, vertex_color(F.col(f"n{k}"), F.col(f"s{k}"), F.col("aspect"), **style)).otherwise(out)
        return out

    return segments.withColumns({f"color{k}": color(k) for k in (0, 1)})


def flow_lines(t: Terrain, **options) -> DataFrame:
    """M7: see ``sequential.flow_lines``."""
    from orograph.operators.sequential import flow_lines as traced

    return traced(t, **options)


#: Mode id -> extractor, in drawing order.
MODES = {
    "X": ridgelines, "Y": lambda t, **o: ridgelines(t, along_columns=True, **o), "Cross": crosshatch, "Pillars": pillars, "Contours": contours, "Hachure": hachure,
    "Flow": flow_lines, "Dag": streams, "Pencil": pencil, "Ridge": ridges, "Valley": position_marks, "Stipple": stipple,
}


def draw(t: Terrain, modes: dict[str, dict]) -> DataFrame:
    """Segments of several modes (id -> options) with their layer; contours come in two."""
    out = None
    for mode in MODES:
        if mode in modes:
            made = MODES[mode](t, **modes[mode])
            layer = made["layer"] if "layer" in made.columns else F.lit(mode)
            made = made.select(layer.alias("layer"), *POINTS, "n0", "n1", "s0", "s1", "aspect")
            out = made if out is None else out.unionByName(made)
    if out is None:
        raise ValueError("no mode is enabled")
    return out
