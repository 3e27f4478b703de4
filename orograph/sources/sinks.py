"""Sinks: SVG, heightmap pixels, PNG and STL bytes, presets."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.color import DASH_SVG, gradient
from orograph.functions.numeric import half_up
from orograph.operators.grid import Terrain
from orograph.operators.modes import MODES
from orograph.operators.view import Camera, bounds

#: Most pixels or triangles that one file's bytes are put together from.
BOUND = 20_000_000


def heightmap_pixels(t: Terrain) -> DataFrame:
    """K4: (r, c, v) of the box around all heights above 0 (all, if there are none), v
    from 0 to 255."""
    box = t.cells.where("h > 0").agg(*[f(k).alias(n + k) for k in "rc" for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    b = t.cells.crossJoin(F.broadcast(box))
    inside = lambda k: F.col(k).between(F.coalesce(f"lo{k}", F.col(k)), F.coalesce(f"hi{k}", F.col(k)))
    return b.where(inside("r") & inside("c")).select((F.col("r") - F.coalesce("lor", F.lit(0))).alias("r"), (F.col("c") - F.coalesce("loc", F.lit(0))).alias("c"), F.floor(F.col("h") * 255 + 0.5).cast("int").alias("v"))


def trimmed(pixels: DataFrame, margin: int = 16, above: int = 5) -> DataFrame:
    """K2: pixels (r, c, alpha and others) of the box around all that are opaque enough,
    with a margin, from 0, 0 on."""
    box = pixels.where(F.col("alpha") > above).agg(*[f(k).alias(n + k) for k in "rc" for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    low = lambda k: F.greatest(F.lit(0), F.col(f"lo{k}") - margin)
    b = pixels.crossJoin(F.broadcast(box)).where(" and ".join(f"{k} between greatest(0, lo{k} - {margin}) and hi{k} + {margin}" for k in "rc"))
    return b.select((F.col("r") - low("r")).alias("r"), (F.col("c") - low("c")).alias("c"), *[x for x in pixels.columns if x not in ("r", "c")])


def stats(t: Terrain, segments: DataFrame) -> DataFrame:
    """K8: one row: segments, their vertices, the surface's triangles, the grid's size and
    the range of elevations."""
    from orograph.operators.mesh import triangles

    m = t.meta
    both = segments.agg(F.count("*").alias("segments")).crossJoin(triangles(t).agg(F.count("*").alias("triangles")))  # one row each
    return both.select("segments", (F.col("segments") * 2).alias("vertices"), "triangles", F.lit(f"{m.cols}×{m.rows}").alias("grid"), F.lit(m.max_z - m.min_z).alias("height"))


def grey_png(pixels: DataFrame, bound: int = BOUND) -> bytes:
    """A greyscale PNG of (r, c, v). An image is one stream of bytes, so its pixels come
    together; more than ``bound`` are refused."""
    size = pixels.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    if size.r is None or (size.r + 1) * (size.c + 1) > bound:
        raise ValueError("an image of no pixels, or of too many")
    rows = pixels.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("p")).orderBy("r").select(F.transform("p", lambda x: x["v"]).alias("v"))
    data = b"".join(b"\0" + bytes(r.v) for r in rows.toLocalIterator())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", size.c + 1, size.r + 1, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def stl_bytes(faces: DataFrame, title: str = "terrain", bound: int = BOUND) -> bytes:
    """K3: a binary STL of triangles with normals (``mesh.with_normal``). The format
    begins with their number, so they come together; more than ``bound`` are refused."""
    n = faces.count()
    if n > bound:
        raise ValueError("too many triangles for one file")
    numbers = faces.select("nx", "ny", "nz", *[F.col(f"{k}.{a}").alias(f"{k}{a}") for k in "abc" for a in "xyz"])
    body = b"".join(struct.pack("<12fH", *r, 0) for r in numbers.toLocalIterator())
    return title.encode()[:80].ljust(80, b"\0") + struct.pack("<I", n) + body


#: Layers in drawing order; any others come last.
LAYERS = [x for mode in MODES for x in (("Contours-Minor", "Contours-Major") if mode == "Contours" else (mode,))]


def svg_box(runs: DataFrame, circles: DataFrame | None = None) -> DataFrame:
    """One row, the box of lines and circles with a margin: vx, vy, vw, vh."""
    ends = runs.select("x0", "y0", "x1", "y1")
    if circles is not None:
        r = F.col("radius")
        ends = ends.unionByName(circles.select((F.col("cx") - r).alias("x0"), (F.col("cy") - r).alias("y0"), (F.col("cx") + r).alias("x1"), (F.col("cy") + r).alias("y1")))
    return bounds(ends)


def _of_layer(values: dict[str, object] | None, default) -> Column:
    """A layer's own value, or the default."""
    given = {k: v for k, v in (values or {}).items() if v is not None}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col("layer")], F.lit(default)) if given else F.lit(default)


def _fixed(v: Column, places: int) -> Column:
    ten = 10**places
    return F.format_string(f"%.{places}f", F.floor(v * ten + 0.5) / ten)


def _channels(c: str) -> Column:
    return F.concat(F.lit("rgb("), F.concat_ws(",", *[F.floor(F.col(f"{c}.{k}") * 255 + 0.5).cast("string") for k in "rgb"]), F.lit(")"))


def svg_elements(
    runs: DataFrame, camera: Camera, *, weights: dict[str, float] | None = None, dashes: dict[str, str] | None = None, opacities: dict[str, float] | None = None, hidden: str = "#a80000", ghost_opacity: float = 1.0,
    polygons: DataFrame | None = None, stops=None, circles: DataFrame | None = None, point_color: str = "#000000",
) -> DataFrame:
    """(section, rank, part, place, layer, ghost, element), in whose order the
    elements are painted: fill polygons (1; ``stops`` colour them by brightness), the
    farthest first; a group for each layer (2) with its hidden lines (part 2) in front of
    the visible ones (5), each group with its width, opacity and dash; circles (3)."""
    box = svg_box(runs, circles)  # one row
    on = lambda df: df.crossJoin(F.broadcast(box))
    at = lambda a, v: _fixed(F.col(a) - F.col(v), 1)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def rows(df: DataFrame, section: int, rank, part, place, layer, ghost, element) -> DataFrame:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        named = {"section": F.lit(section), "rank": lit(rank).cast("int"), "part": lit(part).cast("int"), "place": lit(place).cast("double"), "layer": lit(layer).cast("string"), "ghost": lit(ghost), "element": lit(element)}
        return df.select(*[v.alias(k) for k, v in named.items()])

    rank = _of_layer({k: i for i, k in enumerate(LAYERS)}, len(LAYERS))
    ghost = ~F.col("visible")
    stroke = F.when(F.col("visible"), _channels("color0")).otherwise(hidden)
    line = text('<line x1="', at("x0", "vx"), '" y1="', at("y0", "vy"), '" x2="', at("x1", "vx"), '" y2="', at("y1", "vy"), '" stroke="', stroke, '"/>')
    made = [rows(on(runs), 2, rank, F.when(ghost, 2).otherwise(5), 0.0, F.col("layer"), ghost, line)]
    used = runs.select("layer", "visible").distinct()  # two rows a layer
    mark = _of_layer({k: DASH_SVG[v] for k, v in (dashes or {}).items() if DASH_SVG[v]}, "")
    opacity = _of_layer({k: float(v) for k, v in (opacities or {}).items()}, 1.0) * F.when(ghost, float(ghost_opacity)).otherwise(1.0)
    style = text(
        '<g stroke-width="', _fixed(_of_layer({k: float(v) for k, v in (weights or {}).items()}, 1.0) * 0.5, 3), '"', F.when(mark != "", text(' stroke-dasharray="', mark, '"')).otherwise(""),
        ' opacity="', _fixed(opacity, 3), '" stroke-linecap="round" stroke-linejoin="round">',
    )
    label = F.trim(F.regexp_replace("layer", "([A-Z])", " $1"))
    whole = used.select("layer").distinct()
    made.append(rows(used, 2, rank, F.when(ghost, 1).otherwise(4), 0.0, F.col("layer"), ghost, style))
    made.append(rows(used, 2, rank, F.when(ghost, 3).otherwise(6), 0.0, F.col("layer"), ghost, "</g>"))
    made.append(rows(whole, 2, rank, 0, 0.0, F.col("layer"), False, text('<g id="layer-', F.col("layer"), '" inkscape:groupmode="layer" inkscape:label="', label, '">')))
    made.append(rows(whole, 2, rank, 7, 0.0, F.col("layer"), False, "</g>"))
    one = runs.sparkSession.range(1)
    if polygons is not None:
        corners = F.concat_ws(" ", *[text(at(f"sx_{k}", "vx"), ",", at(f"sy_{k}", "vy")) for k in "abc"])
        filled = on(polygons).withColumn("k", gradient(stops, F.col("b"))) if stops else on(polygons)
        made.append(rows(filled, 1, 0, 5, F.col("depth"), None, False, text('<polygon points="', corners, '" fill="', _channels("k") if stops else F.lit("#ffffff"), '" stroke="none"/>')))
        made += [rows(one, 1, 0, 0, 0.0, None, False, "<g>"), rows(one, 1, 0, 7, 0.0, None, False, "</g>")]
    if circles is not None:
        fill = F.when(F.col("visible"), point_color).otherwise(hidden)
        circle = text('<circle cx="', at("cx", "vx"), '" cy="', at("cy", "vy"), '" r="', _fixed(F.col("radius"), 2), '" fill="', fill, '" opacity="', _fixed(F.when(F.col("visible"), 1.0).otherwise(float(ghost_opacity)), 3), '"/>')
        made.append(rows(on(circles), 3, 0, 5, 0.0, None, ghost, circle))
        made += [rows(one, 3, 0, 0, 0.0, None, False, '<g stroke="none">'), rows(one, 3, 0, 7, 0.0, None, False, "</g>")]
    every = made[0]
    for m in made[1:]:
        every = every.unionByName(m)
    return every


def write_svg(elements: DataFrame, box: DataFrame, path: str, parts: int = 8, background: str = "#ffffff", background_stops=None) -> None:
    """An SVG as text files which, put one after the other by name, are the document:
    header, elements in order, end. No task holds it whole."""
    b = box.first()
    spark = elements.sparkSession
    size = f'viewBox="0 0 {b.vw:.1f} {b.vh:.1f}" width="{b.vw:.0f}" height="{b.vh:.0f}"'
    names = 'xmlns="http://www.w3.org/2000/svg" xmlns:inkscape="http://www.inkscape.org/namespaces/inkscape"'
    defs = ""
    if background_stops and len(background_stops) > 1:
        stops = "".join(f'<stop offset="{half_up(pos * 100)}%" stop-color="{color}"/>' for pos, color in background_stops)
        defs, background = f'<defs><linearGradient id="bg-grad" x1="0" y1="0" x2="0" y2="1">{stops}</linearGradient></defs>', "url(#bg-grad)"
    ends = spark.createDataFrame([(0, f'<svg {names} {size}>{defs}<rect width="100%" height="100%" fill="{background}"/>'), (4, "</svg>")], "section int, value string")
    every = ends.selectExpr("section", "0 rank", "0 part", "0D place", "value").unionByName(elements.select("section", "rank", "part", "place", F.col("element").alias("value")))
    order = ["section", "rank", "part", "place", F.xxhash64("value")]
    every.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("value").write.text(path)
