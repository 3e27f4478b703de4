"""Surfaces and what is built from segments: meshes, normals, mirrors, curtains, solids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.operators.grid import Terrain, elevation, squares, world_x, world_z

ABYSS = -10000.0


def octants(plus_x=True, minus_x=False, plus_y=True, minus_y=False, plus_z=True, minus_z=False) -> list[tuple[int, int, int]]:
    """The signs of the copies that mirroring makes; none if an axis has neither side."""
    sides = [[s for s, on in ((1, p), (-1, m)) if on] for p, m in ((plus_x, minus_x), (plus_y, minus_y), (plus_z, minus_z))]
    return [(x, y, z) for x in sides[0] for y in sides[1] for z in sides[2]]


def _copies(signs: list[tuple[int, int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("copy"), F.lit(x).alias("sx"), F.lit(y).alias("sy"), F.lit(z).alias("sz")) for k, (x, y, z) in enumerate(signs)]))


def mirrored(segments: DataFrame, signs: list[tuple[int, int, int]]) -> DataFrame:
    """A copy of each segment for each octant."""
    if not signs:
        return segments.withColumn("copy", F.lit(0)).limit(0)
    made = segments.withColumn("o", _copies(signs))
    moved = {f"{a}{k}": F.col(f"{a}{k}") * F.col(f"o.s{a}") for a in "xyz" for k in (0, 1)}
    return made.withColumns(moved).withColumn("copy", F.col("o.copy")).drop("o")


def mirrored_triangles(triangles: DataFrame, signs: list[tuple[int, int, int]], corners=("a", "b", "c")) -> DataFrame:
    """Triangles (corner structs x, y, z) in each octant; where an odd number of
    axes is turned, the second and third corner change places, so faces keep their side."""
    if not signs:
        return triangles.withColumn("copy", F.lit(0)).limit(0)
    made = triangles.withColumn("o", _copies(signs))
    flip = F.col("o.sx") * F.col("o.sy") * F.col("o.sz") < 0
    turned = {c: F.struct(*[(F.col(f"{c}.{a}") * F.col(f"o.s{a}")).alias(a) for a in "xyz"]) for c in corners}
    a, b, c = corners
    return made.withColumns({a: turned[a], b: F.when(flip, turned[c]).otherwise(turned[b]), c: F.when(flip, turned[b]).otherwise(turned[c]), "copy": F.col("o.copy")}).drop("o")


def curtains(segments: DataFrame, min_z: float, drop: float = 500) -> DataFrame:
    """Two triangles from each segment that isn't a point down to below the terrain:
    part and corners a, b, c; other columns stay."""
    floor = F.lit(float(min_z - drop))
    long_ = (F.abs(F.col("x0") - F.col("x1")) >= 1e-4) | (F.abs(F.col("y0") - F.col("y1")) >= 1e-4) | (F.abs(F.col("z0") - F.col("z1")) >= 1e-4)
    p = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    c = {n: F.col(n) for n in ("x0", "y0", "z0", "x1", "y1", "z1")}
    q = [p(c["x0"], c["y0"], c["z0"]), p(c["x1"], c["y1"], c["z1"]), p(c["x1"], floor, c["z1"]), p(c["x0"], floor, c["z0"])]
    both = F.array(*[F.struct(q[i].alias("a"), q[j].alias("b"), q[k].alias("c")) for i, j, k in ((0, 1, 2), (0, 2, 3))])
    return segments.where(long_).select("*", F.posexplode(both).alias("part", "t")).select(*[x for x in segments.columns if x not in c], "part", "t.a", "t.b", "t.c")


def layer_styles(segments: DataFrame, styles: DataFrame) -> DataFrame:
    """Segments with their layer's weight, opacity and dash (``styles``: a row for
    each layer; Contours-Major has its own)."""
    return segments.join(styles, "layer", "left")


def vertices(t: Terrain, jitter: float = 0) -> DataFrame:
    """(vid, r, c, x, y, z, b, u, v) of every cell; those without data lie far
    below."""
    m = t.meta
    return t.cells.select(
        (F.col("r").cast("long") * m.cols + F.col("c")).alias("vid"), "r", "c", world_x(m, "c").alias("x"),
        F.when(F.col("valid"), elevation(t, jitter=jitter)).otherwise(ABYSS).alias("y"), world_z(m, "r").alias("z"), F.when(F.col("valid"), F.col("h")).otherwise(0.0).alias("b"),
        (F.col("c") / max(1, m.cols - 1)).alias("u"), (1 - F.col("r") / max(1, m.rows - 1)).alias("v"),
    )


def triangles(t: Terrain, jitter: float = 0) -> DataFrame:
    """Two triangles of each square whose corners all hold data: r, c, part and the
    corners a, b, c as structs vid, x, y, z, h."""
    m = t.meta
    corner = F.struct(
        (F.col("r").cast("long") * m.cols + F.col("c")).alias("vid"), world_x(m, "c").alias("x"), elevation(t, jitter=jitter).alias("y"), world_z(m, "r").alias("z"), F.col("h"), F.col("valid")
    )
    whole = squares(t.cells, corner).where("tl.valid and tr.valid and bl.valid and br.valid")
    faces = F.array(F.struct(F.col("tl").alias("a"), F.col("bl").alias("b"), F.col("tr").alias("c")), F.struct(F.col("tr").alias("a"), F.col("bl").alias("b"), F.col("br").alias("c")))
    return whole.select("r", F.col("c").alias("col"), F.posexplode(faces).alias("part", "f")).select("r", "col", "part", "f.a", "f.b", "f.c")


def cross(a: str, b: str, c: str) -> list[Column]:
    """(b - a) x (c - a)."""
    e = {k: F.col(f"{b}.{k}") - F.col(f"{a}.{k}") for k in "xyz"}
    f = {k: F.col(f"{c}.{k}") - F.col(f"{a}.{k}") for k in "xyz"}
    return [e["y"] * f["z"] - e["z"] * f["y"], e["z"] * f["x"] - e["x"] * f["z"], e["x"] * f["y"] - e["y"] * f["x"]]


def normals(faces: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz), the direction of the sum of the faces at a vertex, each
    weighted by its area. A vertex has six faces at most on a grid."""
    face = faces.select(*[n.alias(f"n{k}") for k, n in zip("xyz", cross("a", "b", "c"))], F.explode(F.array("a.vid", "b.vid", "c.vid")).alias("vid"))
    summed = face.groupBy("vid").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"])
    size = F.sqrt(sum((F.col(f"n{k}") * F.col(f"n{k}") for k in "xyz"), F.lit(0.0)))
    return summed.select("vid", *[F.when(size > 0, F.col(f"n{k}") / size).otherwise(0.0).alias(f"n{k}") for k in "xyz"])


def solid(t: Terrain) -> DataFrame:
    """K3: the triangles of a printable solid (kind, corners a, b, c as structs x, y, z; z
    is up): surface, walls around it, and a base plate two units below the lowest
    vertex. Cells without data stand at the bottom, as in the surface's vertices."""
    m = t.meta
    up = lambda s: F.struct(F.col(f"{s}.x").alias("x"), (-F.col(f"{s}.z")).alias("y"), F.col(f"{s}.y").alias("z"))
    top = triangles(t).select(F.lit("surface").alias("kind"), up("a").alias("a"), up("b").alias("b"), up("c").alias("c"))
    v = vertices(t)
    lowest = v.agg((F.min("y") - 2).alias("base"))  # one row
    r, c, rows, cols = F.col("r"), F.col("c"), m.rows, m.cols
    # places along the border, clockwise: top, right, bottom, left
    n = 2 * (rows + cols) - 4
    place = (
        F.when(r == 0, c).when(c == cols - 1, cols - 1 + r).when(r == rows - 1, (cols - 1) + (rows - 1) + (cols - 1 - c)).otherwise(2 * (cols - 1) + (rows - 1) + (rows - 1 - r))
    )
    edge = v.where((r == 0) | (c == 0) | (r == rows - 1) | (c == cols - 1)).select(place.alias("k"), F.struct("x", (-F.col("z")).alias("y"), F.col("y").alias("z")).alias("p"))
    following = edge.select(F.pmod(F.col("k") - 1, F.lit(n)).alias("k"), F.col("p").alias("q"))
    sides = edge.join(following, "k").crossJoin(F.broadcast(lowest))
    down = lambda s: F.struct(F.col(f"{s}.x").alias("x"), F.col(f"{s}.y").alias("y"), F.col("base").alias("z"))
    middle = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("base").alias("z"))
    tri = lambda kind, a, b, c: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"))
    p, q = F.col("p"), F.col("q")
    around = sides.select(F.explode(F.array(tri("wall", p, q, down("p")), tri("wall", q, down("q"), down("p")), tri("base", middle, down("p"), down("q")))).alias("t")).select("t.*")
    return top.unionByName(around)


def with_normal(faces: DataFrame) -> DataFrame:
    """Triangles with their unit normal (nx, ny, nz; zero for degenerate ones)."""
    n = faces.withColumns({f"n{k}": x for k, x in zip("xyz", cross("a", "b", "c"))})
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return n.withColumn("_s", size).withColumns({f"n{k}": F.when(F.col("_s") > 0, F.col(f"n{k}") / F.col("_s")).otherwise(F.col(f"n{k}")) for k in "xyz"}).drop("_s")
