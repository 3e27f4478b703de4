"""Projection through a camera, the depth buffer, and what of the lines is visible."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.shared import cut

SAMPLES = 64
MARGIN = 20


@dataclass(frozen=True)
class Camera:
    """V1: a camera that looks at a point of the ground from a distance, by tilt (0: from
    above) and rotation in degrees."""

    tilt: float = 40
    rotation: float = 0
    zoom: float = 1
    fov: float = 60
    orthographic: bool = False
    pan_x: float = 0
    pan_y: float = 0
    width: int = 320
    height: int = 240

    def axes(self):
        """Position, and the right, up and back directions."""
        d = 800 if self.orthographic else 800 / self.zoom
        phi, theta = math.radians(max(self.tilt, 0.001)), math.radians(self.rotation)
        back = (math.sin(phi) * math.sin(theta), math.cos(phi), math.sin(phi) * math.cos(theta))
        position = (self.pan_x + d * back[0], d * back[1], self.pan_y + d * back[2])
        size = math.hypot(back[2], back[0])
        right = (back[2] / size, 0.0, -back[0] / size)
        up = (back[1] * right[2] - back[2] * right[1], back[2] * right[0] - back[0] * right[2], back[0] * right[1] - back[1] * right[0])
        return position, right, up, back

    def project(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """V3: pixel x and y and depth (negative in front of the camera)."""
        at, *axes = self.axes()
        dx, dy, dz = x - at[0], y - at[1], z - at[2]
        vx, vy, vz = (dx * a[0] + dy * a[1] + dz * a[2] for a in axes)
        if self.orthographic:
            sx, sy = 2 * self.zoom * 2 / self.width, 2 * self.zoom * 2 / self.height
            nx, ny = vx * sx, vy * sy
        else:
            f = 1 / math.tan(math.radians(self.fov) / 2)
            nx, ny = vx * (f * self.height / self.width) / -vz, vy * f / -vz
        return (nx + 1) * 0.5 * self.width, (1 - ny) * 0.5 * self.height, vz


def view_normal(camera: Camera, nx: Column, ny: Column, nz: Column) -> tuple[Column, Column, Column]:
    """A direction of the world as the camera has it: right, up, and towards it."""
    return tuple(nx * a[0] + ny * a[1] + nz * a[2] for a in camera.axes()[1:])


def clip(x: Column, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x + 0.5))).cast("int")


def project_triangles(faces: DataFrame, camera: Camera, *keep: str) -> DataFrame:
    """Corners a, b, c of faces as sx, sy, sz of each (structs pa, pb, pc)."""
    def seen(k):
        return F.struct(*[v.alias(n) for v, n in zip(camera.project(F.col(f"{k}.x"), F.col(f"{k}.y"), F.col(f"{k}.z")), ("sx", "sy", "sz"))])

    return faces.select(*keep, *[seen(k).alias(f"p{k}") for k in "abc"])


def brightness_filter(low: float = 0, high: float = 100) -> Column:
    """Of faces by the mean of their corners' heights; 0 as the upper limit means 100."""
    return ((F.col("a.h") + F.col("b.h") + F.col("c.h")) / 3).between((low or 0) / 100, (high or 100) / 100)


def depth_buffer(projected: DataFrame, camera: Camera) -> DataFrame:
    """V4: (px, py, inv) the nearest (greatest 1 / distance) of all triangles at each pixel
    they cover. Scanlines and pixels are generated; the maximum is a partial
    aggregation, so a pixel that many triangles cover is no hot spot."""
    w, h = camera.width, camera.height
    corner = lambda k: F.struct(F.col(f"p{k}.sy").alias("y"), F.lit("abc".index(k)).alias("n"), F.col(f"p{k}.sx").alias("x"), (F.lit(1.0) / -F.col(f"p{k}.sz")).alias("d"))
    # corners from top to bottom; of equals, the first comes first
    t = projected.select(F.array_sort(F.array(*[corner(k) for k in "abc"])).alias("v")).select(*[F.col("v")[i][n].alias(f"{n}{i}") for i in range(3) for n in "xyd"])
    c = {n: F.col(n) for n in ("x0", "y0", "d0", "x1", "y1", "d1", "x2", "y2", "d2")}
    rows = t.where(c["y2"] - c["y0"] >= 0.5).withColumns({"ya": F.greatest(F.lit(0), F.ceil("y0")).cast("int"), "yb": F.least(F.lit(h - 1), F.floor("y2")).cast("int")}).where("ya <= yb").withColumn("py", F.explode(F.sequence("ya", "yb")))

    def along(a, b, v):
        dy = F.col(f"y{b}") - F.col(f"y{a}")
        s = F.when(dy > 0, (F.col("py") - F.col(f"y{a}")) / dy).otherwise(0.0)
        return F.col(f"{v}{a}") + (F.col(f"{v}{b}") - F.col(f"{v}{a}")) * s

    other = lambda v: F.when(F.col("py") <= F.col("y1"), along(0, 1, v)).otherwise(along(1, 2, v))
    e = rows.select("py", along(0, 2, "x").alias("lx"), along(0, 2, "d").alias("ld"), other("x").alias("rx"), other("d").alias("rd"))
    swap = F.col("lx") <= F.col("rx")
    e = e.select("py", F.when(swap, F.col("lx")).otherwise(F.col("rx")).alias("xl"), F.when(swap, F.col("rx")).otherwise(F.col("lx")).alias("xr"), F.when(swap, F.col("ld")).otherwise(F.col("rd")).alias("dl"), F.when(swap, F.col("rd")).otherwise(F.col("ld")).alias("dr"))
    e = e.withColumns({"xa": F.greatest(F.lit(0), F.ceil("xl")).cast("int"), "xb": F.least(F.lit(w - 1), F.floor("xr")).cast("int")}).where("xa <= xb").withColumn("px", F.explode(F.sequence("xa", "xb")))
    dx = F.col("xr") - F.col("xl")
    inv = F.col("dl") + (F.col("dr") - F.col("dl")) * F.when(dx > 0, (F.col("px") - F.col("xl")) / dx).otherwise(0.0)
    return e.select("px", "py", inv.alias("inv")).where("inv > 0").groupBy("px", "py").agg(F.max("inv").alias("inv"))


def visible_runs(segments: DataFrame, camera: Camera, depth: DataFrame | None, *, bias: float = 1.0, ghosts: bool = False, keep: tuple = ("layer",)) -> DataFrame:
    """V5-V7: (seg, run, x0, y0, x1, y1, visible) of segments on the screen. With a depth
    buffer each segment is probed at 65 places and cut where visibility changes; hidden
    runs stay only with ``ghosts``; runs shorter than a tenth of a pixel go."""
    p = [F.col(n) for n in ("x0", "y0", "z0", "x1", "y1", "z1")]
    if depth is None:
        a, b = camera.project(*p[:3]), camera.project(*p[3:])
        flat = segments.select(*keep, F.lit(0).alias("run"), a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"), F.lit(True).alias("visible"))
        return flat.where(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= 0.1)
    numbered = cut(segments.select(*keep, *p, F.monotonically_increasing_id().alias("seg")))  # stored, so a number stays with its segment
    f = F.col("t") / SAMPLES
    places = numbered.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES))))
    sx, sy, sz = camera.project(*[F.col(f"{k}0") + (F.col(f"{k}1") - F.col(f"{k}0")) * f for k in "xyz"])
    probes = places.select("seg", *keep, "t", sx.alias("sx"), sy.alias("sy"), sz.alias("sz")).withColumns({"px": clip(F.col("sx"), camera.width), "py": clip(F.col("sy"), camera.height)})
    # a depth buffer has a row for each pixel at most
    seen = probes.join(depth, ["px", "py"], "left").withColumn("visible", F.col("inv").isNull() | (F.col("sz") >= F.lit(-1.0) / F.col("inv") - bias))
    lines = seen.groupBy("seg", *keep).agg(F.sort_array(F.collect_list(F.struct("t", "sx", "sy", "visible"))).alias("s"))  # 65 each
    turns = F.filter(F.sequence(F.lit(1), F.lit(SAMPLES)), lambda k: F.element_at("s", k + 1)["visible"] != F.element_at("s", k)["visible"])
    stops = F.concat(F.array(F.lit(0)), turns, F.array(F.lit(SAMPLES)))
    runs = F.transform(F.sequence(F.lit(1), F.size("stops") - 1), lambda k: F.struct(F.element_at("stops", k).alias("a"), F.element_at("stops", k + 1).alias("b")))
    cutted = lines.withColumn("stops", stops).select("seg", *keep, "s", F.posexplode(runs).alias("run", "r"))
    at = lambda which: F.element_at("s", F.col(f"r.{which}") + 1)
    out = cutted.select("seg", *keep, "run", at("a")["sx"].alias("x0"), at("a")["sy"].alias("y0"), at("b")["sx"].alias("x1"), at("b")["sy"].alias("y1"), at("a")["visible"].alias("visible"))
    return out.where((F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= 0.1) & (F.col("visible") | F.lit(ghosts)))


def fill_polygons(faces: DataFrame, camera: Camera, *, low: float = 0, high: float = 100) -> DataFrame:
    """V8: triangles on the screen with their brightness and mean depth; painted in order
    of depth, the farthest first."""
    p = project_triangles(faces.where(brightness_filter(low, high)), camera, "r", "col", "part", ((F.col("a.h") + F.col("b.h") + F.col("c.h")) / 3).alias("b"))
    return p.select("r", "col", "part", "b", *[F.col(f"p{k}.{n}").alias(f"{n}_{k}") for k in "abc" for n in ("sx", "sy")], ((F.col("pa.sz") + F.col("pb.sz") + F.col("pc.sz")) / 3).alias("depth"))


def particle_circles(points: DataFrame, camera: Camera, depth: DataFrame | None = None, *, size: float = 4, bias: float = 1.0, ghosts: bool = False) -> DataFrame:
    """V9: circles of points in front of the camera, the larger the nearer."""
    sx, sy, sz = camera.project(F.col("x"), F.col("y"), F.col("z"))
    p = points.select("r", "c", sx.alias("cx"), sy.alias("cy"), sz.alias("sz")).where("sz < 0").withColumn("radius", F.lit(size * 300.0) / -F.col("sz") * 0.5)
    if depth is None:
        return p.select("r", "c", "cx", "cy", "radius", F.lit(True).alias("visible"))
    q = p.withColumns({"px": clip(F.col("cx"), camera.width), "py": clip(F.col("cy"), camera.height)}).join(depth, ["px", "py"], "left")
    shown = q.select("r", "c", "cx", "cy", "radius", (F.col("inv").isNull() | (F.col("sz") >= F.lit(-1.0) / F.col("inv") - bias)).alias("visible"))
    return shown if ghosts else shown.where("visible")


def bounds(lines: DataFrame) -> DataFrame:
    """One row, the box around all ends with a margin: vx, vy, vw, vh."""
    m = lines.agg(*[f(g("%s0" % k, "%s1" % k)).alias(f"{n}{k}") for k in "xy" for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))])
    return m.select(*[(F.col(f"lo{k}") - MARGIN).alias(f"v{k}") for k in "xy"], (F.col("hix") - F.col("lox") + 2 * MARGIN).alias("vw"), (F.col("hiy") - F.col("loy") + 2 * MARGIN).alias("vh"))
