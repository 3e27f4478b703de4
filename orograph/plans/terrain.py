"""Queries of the terrain operators on rasters made from the tables, with their oracles.

Rasters: E (vectors; dense and rough), N (events by user and day; holes), P (prices by
quantity and month; a trend). Results are rounded to millionths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions.color import GRADIENTS
from orograph.functions.numeric import micro, uniform, value_noise
from orograph.operators import grid, lines, mesh, modes, points, sequential, shade, view
from orograph.plans import duck as D
from orograph.plans.catalog import query
from orograph.shared import folder_of
from orograph.sources.rasters import RASTERS, is_nodata
from orograph.sources.versions import History

POINTS = modes.POINTS
CAMERA = view.Camera(tilt=40, rotation=30, zoom=3, width=160, height=120)


def raster(spark, sf_dir, name):
    return RASTERS[name](spark, sf_dir)


def terrain(spark, sf_dir, name, **options) -> grid.Terrain:
    r = raster(spark, sf_dir, name)
    return grid.build_terrain(r.pixels, r.width, r.height, **options)


def tidy(df: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` as they are, the others rounded."""
    kinds = dict(df.dtypes)
    return df.select(*[micro(F.col(c)).alias(c) if kinds[c] == "double" and c not in keep else F.col(c) for c in df.columns])


def ends_of(df: DataFrame, *keep: str) -> DataFrame:
    return tidy(df.select(*keep, *POINTS), *keep)


# --- sources and grid -----------------------------------------------------------------


@query("S3_nodata", f"""SELECT count(*) AS n, count(*) FILTER (NOT isfinite(value) OR value IS NULL OR value IN (-9999, -32767, -32768, 3.4028234663852886e38) OR value = 50) AS missing FROM events""")
def s3(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.agg(F.count("*").alias("n"), F.count_if(is_nodata(F.col("value"), 50)).alias("missing"))


for _n in "ENP":

    @query(f"S4_raster_{_n}", f"WITH {D.pixels(_n)} SELECT r, c, raw, valid FROM px")
    def s4(spark, sf_dir, name=_n):
        return raster(spark, sf_dir, name).pixels

    @query(f"G5_terrain_{_n}", f"WITH {D.terrain(_n)} SELECT rows, cols, {D.r6('min_z')} AS min_z, {D.r6('max_z')} AS max_z, {D.r6('half_w')} AS half_w, {D.r6('half_h')} AS half_h, {D.r6('max_slope')} AS max_slope FROM m")
    def g5(spark, sf_dir, name=_n):
        m = terrain(spark, sf_dir, name).meta
        one = spark.range(1).select(F.lit(m.rows).alias("rows"), F.lit(m.cols).alias("cols"), *[F.lit(float(getattr(m, k))).alias(k) for k in ("min_z", "max_z", "half_w", "half_h", "max_slope")])
        return tidy(one)

    @query(f"G6_slope_{_n}", f"WITH {D.terrain(_n)} SELECT r, c, valid, {D.r6('h')} AS h, {D.r6('slope')} AS slope FROM cells")
    def g6(spark, sf_dir, name=_n):
        return tidy(terrain(spark, sf_dir, name).cells.select("r", "c", "valid", "h", "slope"))


@query("G1_box_blur", f"WITH {D.pixels('N')}, {D.blurred('px', 'raw', 2, 'bl')} SELECT r, c, {D.r6('b')} AS b FROM bl")
def g1(spark, sf_dir):
    return tidy(grid.box_blur(raster(spark, sf_dir, "N").pixels, "raw", 2, "b").select("r", "c", "b"))


@query("G2_stride_levels", f"WITH {D.terrain('E', scl=3, off_x=2, off_y=1, black=40, white=200, scale=1.5)} SELECT r, c, valid, {D.r6('h')} AS h, {D.r6('slope')} AS slope FROM cells")
def g2(spark, sf_dir):
    return tidy(terrain(spark, sf_dir, "E", resolution=3, off_x=2, off_y=1, black=40, white=200, elev_scale=1.5).cells.select("r", "c", "valid", "h", "slope"))


@query("G8_jitter", f"WITH {D.terrain('N')} SELECT r, c, {D.r6(D.elev('h') + ' + (' + D.noise('(c * CAST(0.15 AS DOUBLE))', '(r * CAST(0.15 AS DOUBLE))') + ' - 0.5) * 3 * 2')} AS e FROM cells, m WHERE valid")
def g8(spark, sf_dir):
    t = terrain(spark, sf_dir, "N")
    return tidy(t.cells.where("valid").select("r", "c", grid.elevation(t, jitter=3).alias("e")))


@query("G10_band", f"WITH {D.terrain('P')} SELECT r, c, {D.r6(D.norm(D.elev('h')))} AS n FROM cells, m WHERE valid AND {D.in_band(D.elev('h'), 20, 70)}")
def g10(spark, sf_dir):
    t = terrain(spark, sf_dir, "P")
    e = grid.elevation(t)
    return tidy(t.cells.where("valid").where(grid.in_band(t.meta, e, 20, 70)).select("r", "c", grid.norm_elevation(t.meta, e).alias("n")))


for _axis, _size in (("c", "width"), ("r", "height")):
    _other = "r" if _axis == "c" else "c"

    @query(
        f"G15_mirror_{_axis}",
        f"WITH {D.pixels('N')} SELECT {_other}, CAST({_size} - 1 - {_axis} AS INTEGER) AS {_axis}, raw, valid FROM px, lim UNION ALL SELECT {_other}, CAST({_axis} + {_size} AS INTEGER), raw, valid FROM px, lim",
    )
    def g15(spark, sf_dir, axis=_axis, size=_size):
        r = raster(spark, sf_dir, "N")
        return grid.mirror_raster(r.pixels, getattr(r, size), axis)


@query(
    "G16_histogram",
    f"""WITH {D.pixels('N')}, n AS (SELECT CAST(least(255, floor(raw * 255)) AS INTEGER) AS bin, count(*) AS n FROM px GROUP BY 1), top AS (SELECT max(n) AS most FROM n WHERE bin BETWEEN 1 AND 254)
SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, least(1, CAST(coalesce(n, 0) AS DOUBLE) / greatest(coalesce(most, 1), 1)) AS share FROM range(256) t(b) LEFT JOIN n ON bin = b, top""",
)
def g16(spark, sf_dir):
    return grid.histogram(raster(spark, sf_dir, "N").pixels)


@query(
    "G12_scalars",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS name, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, CAST(least(20, greatest(1, ceil(greatest(width, height) / CAST(64 AS DOUBLE)))) AS INTEGER) AS auto_resolution,
CAST(greatest(2, ceil(greatest(width, height) / CAST(20 AS DOUBLE))) AS INTEGER) AS safe_resolution, {D.r6('least(4, greatest(CAST(0.05 AS DOUBLE), CAST(500 AS DOUBLE) / greatest(width, height)))')} AS auto_zoom,
{D.r6('least(50, greatest(CAST(0.1 AS DOUBLE), floor((hi - lo) / (CAST(30 AS DOUBLE) * 100) * 100 + 0.5) / 100))')} AS scale FROM (WITH {D.pixels(n)} SELECT * FROM lim)"""
        for n in "ENP"
    ),
)
def g12(spark, sf_dir):
    """Automatic resolution, zoom and vertical scale of each raster."""
    rows = []
    for n in "ENP":
        r = raster(spark, sf_dir, n)
        rows.append((n, r.width, r.height, grid.auto_resolution(r.width, r.height, 64), grid.safe_resolution(2, r.width, r.height, 20), grid.auto_zoom(r.width, r.height), grid.suggested_scale(r.high - r.low, 30)))
    return tidy(spark.createDataFrame(rows, "name string, width int, height int, auto_resolution int, safe_resolution int, auto_zoom double, scale double"))


@query("G17_cut_labels", f"WITH {D.pixels('N')} SELECT r, c, {D.r6('lo + (hi - lo) * (raw * 100) / 100')} AS metres, {D.r6('(lo + (hi - lo) * (raw * 100) / 100 - lo) / (hi - lo) * 100')} AS percent FROM px, lim WHERE valid")
def g17(spark, sf_dir):
    """Heights in metres, and those in hundredths of the range."""
    x = raster(spark, sf_dir, "N")
    metres = grid.percent_to_metres(F.col("raw") * 100, x.low, x.high)
    return tidy(x.pixels.where("valid").select("r", "c", metres.alias("metres")).withColumn("percent", grid.metres_to_percent(F.col("metres"), x.low, x.high)))


# --- modes ----------------------------------------------------------------------------


def _ridge_sql(name: str, along_columns: bool, step: int, shift: int = 0, more: str = "") -> str:
    outer, dr, dc = ("c", 1, 0) if along_columns else ("r", 0, 1)
    return f"""SELECT {D.ends(D.wx('a.c'), D.elev('a.h'), D.wz('a.r'), D.wx('b.c'), D.elev('b.h'), D.wz('b.r'))}{more} FROM cells a JOIN cells b ON b.r = a.r + {dr} AND b.c = a.c + {dc}, m
WHERE a.valid AND b.valid AND a.{outer} >= {shift} AND (a.{outer} - {shift}) % {step} = 0 AND {D.in_band(D.elev('a.h'), 5, 95)} AND {D.in_band(D.elev('b.h'), 5, 95)}"""


@query("M1_ridgelines_x", f"WITH {D.terrain('N')} {_ridge_sql('N', False, 4, 1)}")
def m1(spark, sf_dir):
    return ends_of(modes.ridgelines(terrain(spark, sf_dir, "N"), shift=5, band=(5, 95)))


@query("M2_ridgelines_y", f"WITH {D.terrain('E')} {_ridge_sql('E', True, 4)}")
def m2(spark, sf_dir):
    return ends_of(modes.ridgelines(terrain(spark, sf_dir, "E"), along_columns=True, band=(5, 95)))


@query("M3_crosshatch", f"WITH {D.terrain('P')} {_ridge_sql('P', False, 4)} UNION ALL {_ridge_sql('P', True, 4)}")
def m3(spark, sf_dir):
    return ends_of(modes.crosshatch(terrain(spark, sf_dir, "P"), band=(5, 95)))


def _pillar_sql(depth: float) -> str:
    return f"SELECT r, c, {D.wx('c')} AS x, {D.elev('h')} - 2 AS t, {D.wz('r')} AS z, m.min_z - {depth} AS b FROM cells, m WHERE valid AND r % 3 = 0 AND c % 3 = 0 AND {D.in_band(D.elev('h'))} AND {D.elev('h')} - 2 > m.min_z - {depth}"


@query("M4_pillars_line", f"WITH {D.terrain('N')}, p AS ({_pillar_sql(1)}) SELECT {D.ends('x', 'b', 'z', 'x', 't', 'z')} FROM p")
def m4(spark, sf_dir):
    return ends_of(modes.pillars(terrain(spark, sf_dir, "N"), spacing=3, gap=2, depth=1))


_BOX = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
_BOX_EDGES = [(_BOX[i], y, _BOX[(i + 1) % 4], y) for i in range(4) for y in "tb"] + [(_BOX[i], "b", _BOX[i], "t") for i in range(4)]
_HALF = 0.8 * 3 * 1 * 0.5


@query(
    "M4_pillars_cuboid",
    f"WITH {D.terrain('N')}, p AS ({_pillar_sql(1)}) "
    + " UNION ALL ".join(f"SELECT {D.ends(f'x + {a[0]} * CAST({_HALF!r} AS DOUBLE)', ya, f'z + {a[1]} * CAST({_HALF!r} AS DOUBLE)', f'x + {b[0]} * CAST({_HALF!r} AS DOUBLE)', yb, f'z + {b[1]} * CAST({_HALF!r} AS DOUBLE)')} FROM p" for a, ya, b, yb in _BOX_EDGES),
)
def m4_cuboid(spark, sf_dir):
    return ends_of(modes.pillars(terrain(spark, sf_dir, "N"), spacing=3, gap=2, depth=1, style="cuboid"))


@query("R4_lids", f"WITH {D.terrain('N')}, p AS ({_pillar_sql(1)}) SELECT r, c, k AS part, {D.r6('t')} AS y, {D.r6(f'CAST({2 * _HALF * 2 * _HALF / 2!r} AS DOUBLE)')} AS area FROM p, (VALUES (0), (1)) t(k)")
def r4(spark, sf_dir):
    lids = modes.pillar_lids(terrain(spark, sf_dir, "N"), spacing=3, gap=2, depth=1, style="cuboid")
    area = F.abs((F.col("p1.x") - F.col("p0.x")) * (F.col("p2.z") - F.col("p0.z")) - (F.col("p2.x") - F.col("p0.x")) * (F.col("p1.z") - F.col("p0.z"))) / 2
    return tidy(lids.select("r", "c", "part", F.col("p0.y").alias("y"), area.alias("area")))


@query("M4_pillars_cylinder", f"WITH {D.terrain('N')}, p AS ({_pillar_sql(1)}), s AS (SELECT *, k FROM p, range(8) t(k)) SELECT {D.r6('x')} AS x, {D.r6('z')} AS z, CAST(3 AS BIGINT) * count(*) AS n, {D.r6('sum(t + b)')} AS heights FROM s GROUP BY x, z")
def m4_cylinder(spark, sf_dir):
    s = modes.pillars(terrain(spark, sf_dir, "N"), spacing=3, gap=2, depth=1, style="cylinder")
    # pillars stand three apart; a third of a pillar's segments are upright
    upright = s.where("x0 = x1 and z0 = z1").select((F.col("y0") + F.col("y1")).alias("h"), "x0", "z0")
    t = terrain(spark, sf_dir, "N").meta
    near = lambda a, half: F.floor((F.col(a) + half) / 3 + 0.5) * 3 - half
    grouped = upright.select(near("x0", t.half_w).alias("x"), near("z0", t.half_h).alias("z"), "h").groupBy("x", "z").agg((F.count("*") * 3).alias("n"), F.sum("h").alias("heights"))
    return tidy(grouped)


def contour_sql(name: str, interval: float, extra: str = "") -> str:
    """Every level against every square, as brute force has it."""
    v = lambda n: f"CASE WHEN {n}.valid THEN {n}.h ELSE level - 1e-7 END AS v{n}"
    lerp = lambda a, b: f"(CASE WHEN abs(v{b} - v{a}) < 1e-10 THEN CAST(0.5 AS DOUBLE) ELSE (level - v{a}) / (v{b} - v{a}) END)"
    cases = " ".join(f"WHEN {k} THEN {p}" for k, p in modes.MARCHING.items())
    edge = lambda k: f"(CASE e[2 * part + {k}] WHEN 0 THEN {{'c': c + {lerp('tl', 'tr')}, 'r': CAST(r AS DOUBLE)}} WHEN 1 THEN {{'c': CAST(c + 1 AS DOUBLE), 'r': r + {lerp('tr', 'br')}}} WHEN 2 THEN {{'c': c + {lerp('bl', 'br')}, 'r': CAST(r + 1 AS DOUBLE)}} ELSE {{'c': CAST(c AS DOUBLE), 'r': r + {lerp('tl', 'bl')}}} END)"
    return f"""{D.terrain(name)},
lev AS (SELECT i, ceil((min_z - 1e-7) / {interval}) * {interval} + i * CAST({interval} AS DOUBLE) AS elev
  FROM m, range(CAST(floor((ceil(max_z / {interval}) * {interval} - ceil((min_z - 1e-7) / {interval}) * {interval}) / {interval}) + 1 AS BIGINT)) t(i)),
levels AS (SELECT i, elev, elev / (100 * m.scale) + 0.5 AS level FROM lev, m WHERE {D.in_band('elev')}),
quads AS (SELECT tl.r, tl.c, i, elev, level, {v('tl')}, {v('tr')}, {v('bl')}, {v('br')} FROM cells tl JOIN cells tr ON tr.r = tl.r AND tr.c = tl.c + 1
  JOIN cells bl ON bl.r = tl.r + 1 AND bl.c = tl.c JOIN cells br ON br.r = tl.r + 1 AND br.c = tl.c + 1, levels WHERE tl.valid OR tr.valid OR bl.valid OR br.valid),
idx AS (SELECT *, CASE (vtl >= level)::INT * 8 + (vtr >= level)::INT * 4 + (vbr >= level)::INT * 2 + (vbl >= level)::INT {cases} END AS e FROM quads),
parts AS (SELECT *, unnest(range(len(e) // 2)) AS part FROM idx WHERE e IS NOT NULL),
seg AS (SELECT r, c, i, elev, part, {edge(1)} AS a, {edge(2)} AS b FROM parts){extra}"""


for _n in "NP":

    @query(f"M5_contours_{_n}", f"WITH {contour_sql(_n, 4)} SELECT CAST(i AS INTEGER) AS i, CASE WHEN (i + 9) % 10 = 0 THEN 'Contours-Major' ELSE 'Contours-Minor' END AS layer, {D.ends(D.wx('a.c'), 'elev', D.wz('a.r'), D.wx('b.c'), 'elev', D.wz('b.r'))} FROM seg, m")
    def m5(spark, sf_dir, name=_n):
        return ends_of(modes.contours(terrain(spark, sf_dir, name)), "i", "layer")


@query(
    "M5_contours",
    f"WITH {contour_sql('E', 4)} SELECT CASE WHEN (i + 9) % 10 = 0 THEN 'Contours-Major' ELSE 'Contours-Minor' END AS layer, count(*) AS segments, {D.r6('round(sum(sqrt((a.c - b.c) * (a.c - b.c) + (a.r - b.r) * (a.r - b.r))), 5)')} AS length FROM seg GROUP BY 1",
)
def m5_flagship(spark, sf_dir):
    """Contour lines of the vectors' raster: segments and length by layer."""
    s = modes.contours(terrain(spark, sf_dir, "E"))
    dx, dz = F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0")
    return tidy(s.groupBy("layer").agg(F.count("*").alias("segments"), F.round(F.sum(F.sqrt(dx * dx + dz * dz)), 5).alias("length")))


@query(
    "M5b_majors",
    f"WITH {contour_sql('P', 2)} SELECT CAST(i AS INTEGER) AS i, {D.r6('elev')} AS elev, (i + 2) % 5 = 0 AS major, count(*) AS segments FROM seg GROUP BY i, elev",
)
def m5b(spark, sf_dir):
    s = modes.contour_crossings(terrain(spark, sf_dir, "P"), interval=2)
    return tidy(s.groupBy("i", "elev").agg(F.count("*").alias("segments")).withColumn("major", modes.is_major(F.col("i"), 5, 3)))


def _closing_sql(name: str, interval: float) -> str:
    """Border walks between open ends, in pairs, clockwise from the top left."""
    w, h = "CAST(m.cols - 1 AS DOUBLE)", "CAST(m.rows - 1 AS DOUBLE)"
    return contour_sql(
        name, interval,
        f""",
tips AS (SELECT i, elev, p.c AS c, p.r AS r FROM (SELECT i, elev, unnest([a, b]) AS p FROM seg)),
loose AS (SELECT i, elev, c, r FROM tips GROUP BY ALL HAVING count(*) = 1),
rim AS (SELECT i, elev, c, r, CASE WHEN r <= 1e-9 THEN c / {w} WHEN c >= {w} - 1e-9 THEN 1 + r / {h} WHEN r >= {h} - 1e-9 THEN 2 + (1 - c / {w}) ELSE 3 + (1 - r / {h}) END AS pos
  FROM loose, m WHERE c <= 1e-9 OR r <= 1e-9 OR c >= {w} - 1e-9 OR r >= {h} - 1e-9),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY pos, c, r) AS k, count(*) OVER (PARTITION BY i) AS n FROM rim),
stops AS (SELECT i, elev, (k + 1) // 2 AS pair, pos, c, r FROM ranked WHERE n % 2 = 0
  UNION ALL SELECT x.i, x.elev, (x.k + 1) // 2, q.pos, q.c, q.r FROM ranked x JOIN ranked y ON y.i = x.i AND y.k = x.k + 1, (
    SELECT 0 AS pos, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS r UNION ALL SELECT 1, {w}, 0 FROM m UNION ALL SELECT 2, {w}, {h} FROM m UNION ALL SELECT 3, 0, {h} FROM m) q
    WHERE x.n % 2 = 0 AND x.k % 2 = 1 AND q.pos > x.pos + 1e-9 AND q.pos < y.pos - 1e-9),
walks AS (SELECT i, elev, c AS c0, r AS r0, lead(c) OVER o AS c1, lead(r) OVER o AS r1 FROM stops WINDOW o AS (PARTITION BY i, pair ORDER BY pos, c, r)),
closed AS (SELECT i, elev, a.c AS c0, a.r AS r0, b.c AS c1, b.r AS r1 FROM seg UNION ALL SELECT i, elev, c0, r0, c1, r1 FROM walks WHERE c1 IS NOT NULL)""",
    )


@query(
    "M5c_closed_contours",
    f"WITH {_closing_sql('P', 8)} SELECT CAST(i AS INTEGER) AS i, CASE WHEN (i + 9) % 10 = 0 THEN 'Contours-Major' ELSE 'Contours-Minor' END AS layer, {D.ends(D.wx('c0'), 'elev', D.wz('r0'), D.wx('c1'), 'elev', D.wz('r1'))} FROM closed, m",
)
def m5c(spark, sf_dir):
    return ends_of(modes.contours(terrain(spark, sf_dir, "P"), interval=8, close=True), "i", "layer")


def _polyline_sql(contours: str) -> str:
    """Crossings chained one after the other: from open ends, and around from each crossing
    as long as no smaller number comes, so that rings are those that come back."""
    return f"""WITH RECURSIVE {contours},
num AS MATERIALIZED (SELECT i, (CAST(r AS BIGINT) * cols + c) * 2 + part AS id, a, b FROM seg, m),
tip AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY i, p.c, p.r ORDER BY id, e) AS k FROM (SELECT i, id, 0 AS e, a AS p FROM num UNION ALL SELECT i, id, 1, b FROM num)),
nxt AS MATERIALIZED (SELECT x.i, x.id, x.e, y.id AS id2, 1 - y.e AS e2 FROM tip x JOIN tip y ON x.i = y.i AND x.p.c = y.p.c AND x.p.r = y.p.r AND y.k = CASE WHEN x.k % 2 = 1 THEN x.k + 1 ELSE x.k - 1 END),
loose AS (SELECT i, id, 1 - e AS e FROM tip ANTI JOIN nxt USING (i, id, e)),
walk AS (SELECT i, id AS s, e AS se, id, e, 0 AS pos FROM loose UNION ALL SELECT w.i, s, se, id2, e2, pos + 1 FROM walk w JOIN nxt n ON n.i = w.i AND n.id = w.id AND n.e = w.e),
far AS (SELECT i, s, se, max(pos) AS last_, arg_max(id, pos) AS z FROM walk GROUP BY i, s, se),
lines AS MATERIALIZED (SELECT i, s AS line, id, e, pos, false AS closed FROM walk JOIN far USING (i, s, se) WHERE s < z OR (s = z AND se = 1)),
turn AS (SELECT i, id AS s, id, e, 0 AS pos FROM (SELECT i, id, 1 AS e FROM num) ANTI JOIN lines USING (i, id)
  UNION ALL SELECT w.i, s, id2, e2, pos + 1 FROM turn w JOIN nxt n ON n.i = w.i AND n.id = w.id AND n.e = w.e WHERE id2 > s),
back AS (SELECT w.i, w.s FROM turn w JOIN nxt n ON n.i = w.i AND n.id = w.id AND n.e = w.e WHERE n.id2 = w.s AND n.e2 = 1),
every_ AS (SELECT * FROM lines UNION ALL SELECT i, s, id, e, pos, true FROM turn SEMI JOIN back USING (i, s))
SELECT CAST(i AS INTEGER) AS i, line, CAST(pos AS BIGINT) AS "at", closed, id AS crossing, {D.r6('CASE e WHEN 1 THEN a.c ELSE b.c END')} AS c0, {D.r6('CASE e WHEN 1 THEN a.r ELSE b.r END')} AS r0,
  {D.r6('CASE e WHEN 1 THEN b.c ELSE a.c END')} AS c1, {D.r6('CASE e WHEN 1 THEN b.r ELSE a.r END')} AS r1 FROM every_ JOIN num USING (i, id)"""


def _polylines(t: grid.Terrain, interval: float) -> DataFrame:
    chained = lines.polylines(modes.contour_crossings(t, interval=interval), t.meta.rows, t.meta.cols)
    number = (F.col("r").cast("long") * t.meta.cols + F.col("c")) * 2 + F.col("part")
    return tidy(chained.select("i", "line", "at", "closed", number.alias("crossing"), "c0", "r0", "c1", "r1"))


for _n, _i in (("E", 8), ("N", 4), ("P", 4)):

    @query(f"M5c_polylines_{_n}", _polyline_sql(contour_sql(_n, _i)))
    def m5c_lines(spark, sf_dir, name=_n, interval=_i):
        return _polylines(terrain(spark, sf_dir, name), interval)


@query("M5c_polylines_steps", _polyline_sql(contour_sql("P", 6.25).replace(D.pixels("P"), D.pixels("P").replace("px AS (", "px AS (SELECT r, c, floor(raw * 16 + 0.5) / 16 AS raw, valid FROM (") + ")")))
def m5c_steps(spark, sf_dir):
    """Heights in sixteenths: every level passes through places of the grid."""
    r = raster(spark, sf_dir, "P")
    stepped = r.pixels.withColumn("raw", F.floor(F.col("raw") * 16 + 0.5) / 16)
    return _polylines(grid.build_terrain(stepped, r.width, r.height), 6.25)


def _around(*names: str) -> str:
    place = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
    return " ".join(f"LEFT JOIN {{t}} {k} ON {k}.r = a.r + {place[k][0]} AND {k}.c = a.c + {place[k][1]}" for k in names)


def _hach(k: str) -> str:
    return f"coalesce(CASE WHEN {k}.valid THEN {k}.h END, a.h)"


_TICK = "mag * 1 * m.scl"
_NX, _NZ = f"-gz / mag * ({_TICK}) * 0.5", f"gx / mag * ({_TICK}) * 0.5"


@query(
    "M6_hachure",
    f"""WITH {D.terrain('N')}, g AS (SELECT a.r, a.c, a.h, ({_hach('e')} - {_hach('w')}) * 50 * m.scale AS gx, ({_hach('s')} - {_hach('n')}) * 50 * m.scale AS gz
  FROM cells a {_around('n', 'w', 'e', 's').format(t='cells')}, m WHERE a.valid AND a.r % 2 = 0 AND a.c % 2 = 0 AND {D.in_band(D.elev('a.h'))}),
s AS (SELECT *, sqrt(gx * gx + gz * gz) AS mag FROM g)
SELECT {D.ends(f"{D.wx('c')} - ({_NX})", D.elev('h'), f"{D.wz('r')} - ({_NZ})", f"{D.wx('c')} + ({_NX})", D.elev('h'), f"{D.wz('r')} + ({_NZ})")}, {D.r6('atan2(gz, gx)')} AS aspect FROM s, m WHERE mag >= 0.005""",
)
def m6(spark, sf_dir):
    return tidy(modes.hachure(terrain(spark, sf_dir, "N"), spacing=2).select(*POINTS, "aspect"))


@query("M7_flow_lines")
def m7(spark, sf_dir):
    return ends_of(modes.flow_lines(terrain(spark, sf_dir, "E"), spacing=5), "seed", "step")


@query("M7_flow_lines_dense")
def m7_dense(spark, sf_dir):
    """A seed in every cell, so that most lines end at an earlier one."""
    return ends_of(modes.flow_lines(terrain(spark, sf_dir, "P"), spacing=1, band=(10, 90)), "seed", "step")


_D8 = """d8 AS (SELECT a.r, a.c, a.h, a.slope, b.r AS dr, b.c AS dc, b.h AS dh FROM cells a JOIN cells b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1
  WHERE a.valid AND b.valid AND b.h < a.h QUALIFY row_number() OVER (PARTITION BY a.r, a.c ORDER BY b.h, b.r, b.c) = 1)"""
#: Strahler orders by rounds that carry all edges along; the last round has the result.
_ORDER = """o AS (SELECT 0 AS k, r, c, dr, dc, 1 AS ord FROM d8
  UNION ALL SELECT * FROM (WITH f AS (SELECT dr AS r, dc AS c, max(ord) AS top, count(*) FILTER (ord = t) AS n FROM (SELECT *, max(ord) OVER (PARTITION BY dr, dc) AS t FROM o) GROUP BY ALL)
    SELECT k + 1, o.r, o.c, o.dr, o.dc, CAST(coalesce(CASE WHEN f.n > 1 THEN f.top + 1 ELSE f.top END, 1) AS INTEGER) FROM o LEFT JOIN f ON f.r = o.r AND f.c = o.c WHERE k < 40)),
ords AS (SELECT r, c, ord FROM o WHERE k = 40)"""


@query("M8_drainage", f"WITH {D.terrain('E')}, {_D8} SELECT r, c, dr, dc FROM d8")
def m8(spark, sf_dir):
    return modes.drainage(terrain(spark, sf_dir, "E")).select("r", "c", F.col("dr").cast("int").alias("dr"), F.col("dc").cast("int").alias("dc"))


for _n in "NP":

    @query(f"M8a_strahler_{_n}", f"WITH RECURSIVE {D.terrain(_n)}, {_D8}, {_ORDER} SELECT r, c, ord FROM ords")
    def m8a(spark, sf_dir, name=_n):
        return sequential.stream_order(modes.drainage(terrain(spark, sf_dir, name)))


@query("M8b_streams", f"WITH RECURSIVE {D.terrain('P')}, {_D8}, {_ORDER} SELECT {D.ends(D.wx('c'), D.elev('h'), D.wz('r'), D.wx('dc'), D.elev('dh'), D.wz('dr'))} FROM d8 JOIN ords USING (r, c), m WHERE ord >= 2 AND {D.in_band(D.elev('h'))}")
def m8b(spark, sf_dir):
    return ends_of(modes.streams(terrain(spark, sf_dir, "P")))


_PEN = "least(CAST(2 AS DOUBLE) * m.scl, curv * 0.5) * CAST(0.7 AS DOUBLE)"


@query(
    "M9_pencil",
    f"""WITH {D.terrain('E')}, k AS (SELECT a.r, a.c, a.h, -(n.h + s.h + w.h + e.h - a.h * 4) * 100 AS curv FROM cells a {_around('n', 's', 'w', 'e').format(t='cells')}, m
  WHERE a.valid AND a.r >= 2 AND a.c >= 2 AND a.r % 2 = 0 AND a.c % 2 = 0 AND a.r < m.rows - 2 AND a.c < m.cols - 2)
SELECT {D.ends(f"{D.wx('c')} - {_PEN}", D.elev('h'), f"{D.wz('r')} - {_PEN} * g", f"{D.wx('c')} + {_PEN}", D.elev('h'), f"{D.wz('r')} + {_PEN} * g")} FROM k, (VALUES (1), (-1)) t(g), m WHERE curv >= 0.5 AND {D.in_band(D.elev('h'))}""",
)
def m9(spark, sf_dir):
    return ends_of(modes.pencil(terrain(spark, sf_dir, "E"), spacing=2))


_HXX, _HYY, _HXY = "(e.b + w.b - a.b * 2)", "(s.b + n.b - a.b * 2)", "((se.b - sw.b - ne.b + nw.b) / 4)"


@query(
    "M10_ridges",
    f"""WITH {D.terrain('E')}, {D.blurred('cells', 'h', 1, 'bl')},
hess AS (SELECT a.r, a.c, {_HXX} AS hxx, {_HYY} AS hyy, {_HXY} AS hxy FROM bl a {_around('nw', 'n', 'ne', 'w', 'e', 'sw', 's', 'se').format(t='bl')}),
rid AS (SELECT x.r, x.c, x.h FROM hess JOIN cells x USING (r, c), m WHERE x.valid AND x.r BETWEEN 1 AND m.rows - 2 AND x.c BETWEEN 1 AND m.cols - 2
  AND -((hxx + hyy) - sqrt(greatest(0, (hxx + hyy) * (hxx + hyy) - (hxx * hyy - hxy * hxy) * 4))) / 2 > CAST(0.1 AS DOUBLE) * CAST(0.1 AS DOUBLE))
SELECT {D.ends(D.wx('a.c'), D.elev('a.h'), D.wz('a.r'), D.wx('b.c'), D.elev('b.h'), D.wz('b.r'))} FROM rid a JOIN rid b ON (b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1), m
WHERE {D.in_band(D.elev('a.h'))} AND {D.in_band(D.elev('b.h'))}""",
)
def m10(spark, sf_dir):
    return ends_of(modes.ridges(terrain(spark, sf_dir, "E")))


for _id, _sign in (("M11_valleys", False), ("M11r_peaks", True)):
    _size = "abs(h - b) * 50 * m.scl"

    @query(
        _id,
        f"""WITH {D.terrain('E')}, {D.blurred('cells', 'h', 2, 'bl')} SELECT {D.ends(f"{D.wx('c')} - {_size}", D.elev('h'), D.wz('r'), f"{D.wx('c')} + {_size}", D.elev('h'), D.wz('r'))}
FROM cells JOIN bl USING (r, c), m WHERE valid AND r % 2 = 0 AND c % 2 = 0 AND {'h - b > CAST(0.5 * 0.05 AS DOUBLE)' if _sign else 'h - b < -CAST(0.5 * 0.05 AS DOUBLE)'} AND {D.in_band(D.elev('h'))}""",
    )
    def m11(spark, sf_dir, ridge=_sign):
        return ends_of(modes.position_marks(terrain(spark, sf_dir, "E"), ridge=ridge))


_JR, _JC = f"(r + ({D.uniform('r', 'c', 3)} - 0.5) * CAST(0.8 AS DOUBLE))", f"(c + ({D.uniform('r', 'c', 4)} - 0.5) * CAST(0.8 AS DOUBLE))"


@query(
    "M12_stipple",
    f"""WITH {D.terrain('N')}, j AS (SELECT {_JR} AS jr, {_JC} AS jc, {D.uniform('r', 'c', 5)} AS draw FROM cells),
at_ AS (SELECT *, CAST(greatest(0, least(m.rows - 1, floor(jr))) AS INTEGER) AS r, CAST(greatest(0, least(m.cols - 1, floor(jc))) AS INTEGER) AS c FROM j, m)
SELECT {D.ends('jc * m.scl - m.half_w - CAST(0.003 AS DOUBLE)', D.elev('h'), 'jr * m.scl - m.half_h', 'jc * m.scl - m.half_w + CAST(0.003 AS DOUBLE)', D.elev('h'), 'jr * m.scl - m.half_h')}
FROM at_ JOIN cells USING (r, c), m WHERE valid AND {D.in_band(D.elev('h'))} AND draw <= pow(greatest(0, least(1, slope / m.max_slope)), CAST(1.2 AS DOUBLE))""",
)
def m12(spark, sf_dir):
    return ends_of(modes.stipple(terrain(spark, sf_dir, "N")))


@query(
    "M0_dispatch",
    f"WITH {D.terrain('N')}, s AS (SELECT 'X' AS layer, * FROM ({_ridge_sql('N', False, 4).replace('0.05', '0.0').replace('0.95', '1.0')}) UNION ALL SELECT 'Y', * FROM ({_ridge_sql('N', True, 4).replace('0.05', '0.0').replace('0.95', '1.0')})) SELECT layer, count(*) AS segments FROM s GROUP BY layer",
)
def m0(spark, sf_dir):
    """K8 counts by layer of the two line modes."""
    return modes.draw(terrain(spark, sf_dir, "N"), {"X": {}, "Y": {}}).groupBy("layer").agg(F.count("*").alias("segments"))


# --- colours and functions -------------------------------------------------------------

_TOPO = GRADIENTS["Topo"]


@query(
    "F5_gradient",
    f"WITH {D.pixels('N')} SELECT r, c, " + ", ".join(f"{D.r6(x)} AS {n}" for n, x in zip("xyz", D.gradient(_TOPO, "raw"))) + " FROM px WHERE valid",
)
def f5(spark, sf_dir):
    from orograph.functions.color import gradient

    p = raster(spark, sf_dir, "N").pixels.where("valid").withColumn("k", gradient(_TOPO, F.col("raw")))
    return tidy(p.select("r", "c", F.col("k.r").alias("x"), F.col("k.g").alias("y"), F.col("k.b").alias("z")))


_BANDED = "least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), floor({n} * (CAST(100 AS DOUBLE) / 10)) / (CAST(100 AS DOUBLE) / 10)))"
_S0 = _BANDED.format(n="(a.slope / m.max_slope)")


@query(
    "F6_vertex_color",
    f"WITH {D.terrain('N')} " + _ridge_sql("N", False, 4, more=", " + ", ".join(f"{D.r6(x)} AS {n}" for n, x in zip(("cr", "cg", "cb"), D.gradient(_TOPO, _S0)))),
)
def f6(spark, sf_dir):
    s = modes.colored(modes.ridgelines(terrain(spark, sf_dir, "N"), band=(5, 95)), hypsometric=True, mode="slope", banded=True, interval=10, stops=_TOPO)
    return tidy(s.select(*POINTS, *[F.col(f"color0.{k}").alias(f"c{k}") for k in "rgb"]))


@query("F3_noise", f"WITH {D.pixels('P')} SELECT r, c, {D.r6(D.noise('(c * CAST(3.7 AS DOUBLE) - 90)', '(r * CAST(1.3 AS DOUBLE) - 20)'))} AS n, {D.r6(D.uniform('r', 'c', 9))} AS u FROM px")
def f3(spark, sf_dir):
    p = raster(spark, sf_dir, "P").pixels
    return tidy(p.select("r", "c", value_noise(F.col("c") * 3.7 - 90, F.col("r") * 1.3 - 20).alias("n"), uniform(F.col("r"), F.col("c"), 9).alias("u")))


#: The named gradients, written out once more for SQL.
_STOPS_SQL = """stops(name, pos, color) AS (VALUES
  ('Jet', 0.0, '#000080'), ('Jet', 0.25, '#00ffff'), ('Jet', 0.5, '#00ff00'), ('Jet', 0.75, '#ff8800'), ('Jet', 1.0, '#800000'),
  ('Classic', 0.0, '#1a1a2e'), ('Classic', 0.5, '#888888'), ('Classic', 1.0, '#ffffff'),
  ('Fire', 0.0, '#1a0000'), ('Fire', 0.4, '#ff4400'), ('Fire', 0.7, '#ffaa00'), ('Fire', 1.0, '#ffffff'),
  ('Ocean', 0.0, '#001433'), ('Ocean', 0.5, '#0066cc'), ('Ocean', 1.0, '#00eeff'),
  ('Topo', 0.0, '#0d3b00'), ('Topo', 0.3, '#5a8c00'), ('Topo', 0.6, '#c8a800'), ('Topo', 0.85, '#8b4513'), ('Topo', 1.0, '#ffffff'),
  ('Cyber', 0.0, '#0d0221'), ('Cyber', 0.5, '#b000ff'), ('Cyber', 1.0, '#00ffe7'),
  ('Sunset', 0.0, '#0a0020'), ('Sunset', 0.4, '#c62a6b'), ('Sunset', 0.7, '#ff7b3a'), ('Sunset', 1.0, '#ffe066'),
  ('Halloween', 0.0, '#0a0005'), ('Halloween', 0.25, '#3d0066'), ('Halloween', 0.5, '#b5000a'), ('Halloween', 0.75, '#ff6600'), ('Halloween', 1.0, '#ffcc00')),
g AS (SELECT name, CAST(pos AS DOUBLE) AS pos, color, CAST(row_number() OVER (PARTITION BY name ORDER BY pos) - 1 AS INTEGER) AS i FROM stops)"""
_PART = "CAST(CAST('0x' || substr({1}, {0}, 2) AS INTEGER) AS DOUBLE) / 255"
_BETWEEN = lambda at: f"{_PART.format(at, 'a.color')} + ({_PART.format(at, 'b.color')} - {_PART.format(at, 'a.color')}) * ((raw - a.pos) / (b.pos - a.pos))"


@query(
    "F8_gradient_table",
    f"""WITH {D.pixels('N')}, {_STOPS_SQL} SELECT r, c, a.name, {', '.join(D.r6(_BETWEEN(at)) + ' AS k' + n for at, n in ((2, 'r'), (4, 'g'), (6, 'b')))}
FROM px, g a JOIN g b ON b.name = a.name AND b.i = a.i + 1 WHERE valid AND (raw > a.pos OR (a.i = 0 AND raw = 0)) AND raw <= b.pos""",
)
def f8(spark, sf_dir):
    """Every named gradient at every place of a raster."""
    from orograph.functions.color import gradient

    p = raster(spark, sf_dir, "N").pixels.where("valid")
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), gradient(s, F.col("raw")).alias("k")) for n, s in GRADIENTS.items()]))
    return tidy(p.select("r", "c", named.alias("g")).select("r", "c", "g.name", *[F.col(f"g.k.{n}").alias(f"k{n}") for n in "rgb"]))


@query(
    "F9_gradient_edit",
    f"""WITH {D.pixels('N')}, {_STOPS_SQL}, low AS (SELECT r, min(raw) AS lo, max(raw) AS hi FROM px WHERE valid GROUP BY r), gr AS (SELECT g.*, low.* FROM g, low),
made AS (SELECT 'add' AS edit, r, name, pos, color FROM gr
  UNION ALL SELECT DISTINCT 'add', r, name, lo, '#123456' FROM gr WHERE NOT EXISTS (SELECT 1 FROM g n WHERE n.name = gr.name AND abs(n.pos - lo) < CAST(0.02 AS DOUBLE))
  UNION ALL SELECT 'remove', r, name, pos, color FROM gr WHERE i <> r % 5 OR pos IN (0, 1)
  UNION ALL SELECT 'move', r, name, CASE WHEN i = 1 AND pos NOT IN (0, 1) THEN least(CAST(0.99 AS DOUBLE), greatest(CAST(0.01 AS DOUBLE), hi)) ELSE pos END, color FROM gr)
SELECT edit, r, name, CAST(row_number() OVER (PARTITION BY edit, r, name ORDER BY pos, color) - 1 AS INTEGER) AS i, {D.r6('pos')} AS pos, color FROM made""",
)
def f9(spark, sf_dir):
    """In every gradient and for each row of a raster: a stop added at its least height, one
    removed, one moved to its greatest; the ends stay."""
    from orograph.functions.color import edit_gradient

    known = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.struct(F.lit(float(p)).alias("pos"), F.lit(c).alias("color")) for p, c in s]).alias("stops")) for n, s in GRADIENTS.items()]))
    rows = raster(spark, sf_dir, "N").pixels.where("valid").groupBy("r").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).select("*", known.alias("g"))
    stops = F.col("g.stops")
    edits = {"add": edit_gradient(stops, add=(F.col("lo"), "#123456")), "remove": edit_gradient(stops, remove=F.col("r") % 5), "move": edit_gradient(stops, move=(1, F.col("hi")))}
    made = rows.select("r", "g.name", F.explode(F.create_map(*[x for k, e in edits.items() for x in (F.lit(k), e)])).alias("edit", "stops"))
    return tidy(made.select("edit", "r", "name", F.posexplode(F.array_sort("stops")).alias("i", "s")).select("edit", "r", "name", "i", "s.pos", "s.color"))


_AS_HEX = "lower(printf('#%06x', CAST(floor(raw * 16777215) AS BIGINT)))"


@query(
    "F1_hex_colors",
    f"""WITH {D.pixels('N')}, t AS (SELECT r, c, {_AS_HEX} AS color FROM px WHERE valid)
SELECT r, c, color, {', '.join(D.r6(_PART.format(a, 'color')) + ' AS k' + n for a, n in ((2, 'r'), (4, 'g'), (6, 'b')))}, {D.r6('(' + _PART.format(2, 'color') + ' * 299 + ' + _PART.format(4, 'color') + ' * 587 + ' + _PART.format(6, 'color') + ' * 114) * 255 / 1000')} AS light FROM t""",
)
def f1(spark, sf_dir):
    """channels and luminance of heights as hex colours."""
    from orograph.functions.color import hex_channels, luminance

    k = hex_channels(F.col("color"))
    heights = raster(spark, sf_dir, "N").pixels.where("valid").select("r", "c", F.format_string("#%06x", F.floor(F.col("raw") * 16777215)).alias("color"))
    return tidy(heights.select("r", "c", "color", *[k[n].alias(f"k{n}") for n in "rgb"], luminance(F.col("color")).alias("light")))


@query(
    "F7_dashes",
    f"""WITH {D.pixels('N')} SELECT r, c, CASE CAST(floor(raw * 5) AS INTEGER) WHEN 1 THEN '3 2' WHEN 2 THEN '2 5' WHEN 3 THEN '16 6' ELSE '' END AS svg FROM px WHERE valid""",
)
def f7(spark, sf_dir):
    """Dash patterns by name, one for each fifth of the heights; the last name is unknown."""
    from orograph.functions.color import dash_svg

    names = F.array(*[F.lit(n) for n in ("solid", "dashed", "dotted", "long-dash", "wavy", "wavy")])
    return raster(spark, sf_dir, "N").pixels.where("valid").select("r", "c", dash_svg(F.element_at(names, F.floor(F.col("raw") * 5).cast("int") + 1)).alias("svg"))


# --- meshes and mirrors ----------------------------------------------------------------


@query("U1_vertices", f"WITH {D.terrain('N')} SELECT CAST(r AS BIGINT) * m.cols + c AS vid, {D.r6(D.wx('c'))} AS x, {D.r6('CASE WHEN valid THEN ' + D.elev('h') + ' ELSE CAST(-10000 AS DOUBLE) END')} AS y, {D.r6(D.wz('r'))} AS z, {D.r6('CASE WHEN valid THEN h ELSE 0 END')} AS b, {D.r6('CAST(c AS DOUBLE) / (m.cols - 1)')} AS u, {D.r6('1 - CAST(r AS DOUBLE) / (m.rows - 1)')} AS v FROM cells, m")
def u1(spark, sf_dir):
    return tidy(mesh.vertices(terrain(spark, sf_dir, "N")).drop("r", "c"))


_TRI = """tri AS (SELECT tl.r, tl.c, k AS part, CASE k WHEN 0 THEN tl ELSE tr END AS a, bl AS b, CASE k WHEN 0 THEN tr ELSE br END AS c3
  FROM v tl JOIN v tr ON tr.r = tl.r AND tr.c = tl.c + 1 JOIN v bl ON bl.r = tl.r + 1 AND bl.c = tl.c JOIN v br ON br.r = tl.r + 1 AND br.c = tl.c + 1, (VALUES (0), (1)) t(k)
  WHERE tl.valid AND tr.valid AND bl.valid AND br.valid)"""


def mesh_sql(name: str) -> str:
    return f"{D.terrain(name)}, v AS (SELECT r, c, valid, h, CAST(r AS BIGINT) * m.cols + c AS vid, {D.wx('c')} AS x, {D.elev('h')} AS y, {D.wz('r')} AS z FROM cells, m), {_TRI}"


@query("U2_triangles", f"WITH {mesh_sql('N')} SELECT r, c AS col, part, a.vid AS va, b.vid AS vb, c3.vid AS vc FROM tri")
def u2(spark, sf_dir):
    return mesh.triangles(terrain(spark, sf_dir, "N")).select("r", "col", "part", *[F.col(f"{k}.vid").alias(f"v{k}") for k in "abc"])


_SIGNS = mesh.octants(minus_x=True, minus_y=True)
_SIGN_ROWS = ", ".join(f"({k}, {x}, {y}, {z})" for k, (x, y, z) in enumerate(_SIGNS))


@query(
    "U3_mirrored_surface",
    f"""WITH {mesh_sql('N')}, o AS (SELECT * FROM (VALUES {_SIGN_ROWS}) t(copy, sx, sy, sz))
SELECT r, c AS col, part, copy, a.vid AS va, CASE WHEN sx * sy * sz < 0 THEN c3.vid ELSE b.vid END AS vb, CASE WHEN sx * sy * sz < 0 THEN b.vid ELSE c3.vid END AS vc, {D.r6('a.x * sx')} AS x, {D.r6('a.y * sy')} AS y, {D.r6('a.z * sz')} AS z FROM tri, o""",
)
def u3(spark, sf_dir):
    f = mesh.triangles(terrain(spark, sf_dir, "N")).select("r", "col", "part", "a", "b", "c", *[F.col(f"{k}.vid").alias(f"v{k}") for k in "abc"])
    m = mesh.mirrored_triangles(f, _SIGNS)
    flip = F.col("copy").isin([k for k, (x, y, z) in enumerate(_SIGNS) if x * y * z < 0])
    return tidy(m.select("r", "col", "part", "copy", "va", F.when(flip, F.col("vc")).otherwise(F.col("vb")).alias("vb"), F.when(flip, F.col("vb")).otherwise(F.col("vc")).alias("vc"), "a.x", "a.y", "a.z"))


_CROSS = ["(b.y - a.y) * (c3.z - a.z) - (b.z - a.z) * (c3.y - a.y)", "(b.z - a.z) * (c3.x - a.x) - (b.x - a.x) * (c3.z - a.z)", "(b.x - a.x) * (c3.y - a.y) - (b.y - a.y) * (c3.x - a.x)"]
_NORMAL_SQL = f"""face AS (SELECT {', '.join(f'{e} AS f{k}' for k, e in zip('xyz', _CROSS))}, unnest([a.vid, b.vid, c3.vid]) AS vid FROM tri),
sums AS (SELECT vid, sum(fx) AS sx, sum(fy) AS sy, sum(fz) AS sz FROM face GROUP BY vid),
nrm AS (SELECT vid, {', '.join(f'CASE WHEN sx * sx + sy * sy + sz * sz > 0 THEN s{k} / sqrt(sx * sx + sy * sy + sz * sz) ELSE 0 END AS n{k}' for k in 'xyz')} FROM sums)"""


@query("U5_normals", f"WITH {mesh_sql('N')}, {_NORMAL_SQL} SELECT vid, round(nx, 4) + 0.0 AS nx, round(ny, 4) + 0.0 AS ny, round(nz, 4) + 0.0 AS nz FROM nrm")
def u5(spark, sf_dir):
    return mesh.normals(mesh.triangles(terrain(spark, sf_dir, "N"))).select("vid", *[(F.round(f"n{k}", 4) + 0.0).alias(f"n{k}") for k in "xyz"])


@query("R1_mirror", f"WITH {D.terrain('N')}, s AS ({_ridge_sql('N', False, 4)}), o AS (SELECT * FROM (VALUES {_SIGN_ROWS}) t(copy, sx, sy, sz)) SELECT copy, " + ", ".join(f"{D.r6(f'{a}{k} * s{a}')} AS {a}{k}" for a in "xyz" for k in (0, 1)) + " FROM s, o")
def r1(spark, sf_dir):
    s = modes.ridgelines(terrain(spark, sf_dir, "N"), band=(5, 95)).select(*POINTS)
    return tidy(mesh.mirrored(tidy(s), _SIGNS).select("copy", *POINTS))


@query(
    "R3_curtains",
    f"""WITH {D.terrain('N')}, s AS ({_ridge_sql('N', False, 4)}) SELECT part, {D.r6('x0')} AS xa, {D.r6('y0')} AS ya, {D.r6('z0')} AS za, {D.r6('x1')} AS xb, {D.r6('CASE part WHEN 0 THEN y1 ELSE m.min_z - 500 END')} AS yb, {D.r6('CASE part WHEN 0 THEN x1 ELSE x0 END')} AS xc, {D.r6('m.min_z - 500')} AS yc
FROM s, (VALUES (0), (1)) t(part), m WHERE abs(x0 - x1) >= 1e-4 OR abs(y0 - y1) >= 1e-4 OR abs(z0 - z1) >= 1e-4""",
)
def r3(spark, sf_dir):
    t = terrain(spark, sf_dir, "N")
    c = mesh.curtains(tidy(modes.ridgelines(t, band=(5, 95)).select(*POINTS)), t.meta.min_z)
    return tidy(c.select("part", F.col("a.x").alias("xa"), F.col("a.y").alias("ya"), F.col("a.z").alias("za"), F.col("b.x").alias("xb"), F.col("b.y").alias("yb"), F.col("c.x").alias("xc"), F.col("c.y").alias("yc")))


@query("R5_layers", f"WITH {D.terrain('N')}, s AS ({_ridge_sql('N', False, 4)}) SELECT 'X' AS layer, CAST(1 AS DOUBLE) AS weight, CAST(0.5 AS DOUBLE) AS opacity, 'dashed' AS dash, count(*) AS n FROM s")
def r5(spark, sf_dir):
    styles = spark.createDataFrame([("X", 1.0, 0.5, "dashed"), ("Y", 2.0, 1.0, "solid")], "layer string, weight double, opacity double, dash string")
    s = modes.draw(terrain(spark, sf_dir, "N"), {"X": {"band": (5, 95)}})
    return mesh.layer_styles(s, styles).groupBy("layer", "weight", "opacity", "dash").agg(F.count("*").alias("n"))


@query("K3_solid", f"WITH {mesh_sql('P')}, n AS (SELECT 2 * (rows + cols) - 4 AS n FROM m) SELECT 'surface' AS kind, count(*) AS triangles FROM tri UNION ALL SELECT 'wall', CAST(2 * n AS BIGINT) FROM n UNION ALL SELECT 'base', CAST(n AS BIGINT) FROM n")
def k3(spark, sf_dir):
    return mesh.with_normal(mesh.solid(terrain(spark, sf_dir, "P"))).groupBy("kind").agg(F.count("*").alias("triangles"))


def _normal_of(a: str, b: str, c: str) -> list[str]:
    """The cross product of a face's edges."""
    e = {k: f"({b}{k} - {a}{k})" for k in "xyz"}
    f = {k: f"({c}{k} - {a}{k})" for k in "xyz"}
    return [f"({e['y']} * {f['z']} - {e['z']} * {f['y']})", f"({e['z']} * {f['x']} - {e['x']} * {f['z']})", f"({e['x']} * {f['y']} - {e['y']} * {f['x']})"]


_N3 = _normal_of("p", "q", "w")
_N3_SIZE = f"sqrt({' + '.join(f'{n} * {n}' for n in _N3)})"


@query(
    "K3_solid_faces",
    f"""WITH {mesh_sql('P')}, bv AS (SELECT r, c, x, -z AS y, CASE WHEN valid THEN y ELSE CAST(-10000 AS DOUBLE) END AS z FROM v), plate AS (SELECT min(z) - 2 AS low FROM bv),
rim AS (SELECT CASE WHEN r = 0 THEN c WHEN c = m.cols - 1 THEN m.cols - 1 + r WHEN r = m.rows - 1 THEN 2 * (m.cols - 1) + m.rows - 1 - c ELSE 2 * (m.cols - 1) + 2 * (m.rows - 1) - r END AS k, x, y, z
  FROM bv, m WHERE r IN (0, m.rows - 1) OR c IN (0, m.cols - 1)),
side AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, low FROM rim a JOIN rim b ON b.k = (a.k + 1) % (SELECT 2 * (rows + cols) - 4 FROM m), plate),
face AS (SELECT 'surface' AS kind, a.x AS px, -a.z AS py, a.y AS pz, b.x AS qx, -b.z AS qy, b.y AS qz, c3.x AS wx, -c3.z AS wy, c3.y AS wz FROM tri
  UNION ALL SELECT 'wall', ax, ay, az, bx, by_, bz, ax, ay, low FROM side UNION ALL SELECT 'wall', bx, by_, bz, bx, by_, low, ax, ay, low FROM side
  UNION ALL SELECT 'base', 0, 0, low, ax, ay, low, bx, by_, low FROM side)
SELECT kind, {', '.join(f'{D.r6(k + a)} AS {k}{a}' for k in 'pqw' for a in 'xyz')}, {', '.join(f'round(CASE WHEN {_N3_SIZE} > 0 THEN {n} / {_N3_SIZE} ELSE {n} END, 4) + 0.0 AS n{k}' for k, n in zip('xyz', _N3))} FROM face""",
)
def k3_faces(spark, sf_dir):
    """K3: corners and normals of the printable solid."""
    f = mesh.with_normal(mesh.solid(terrain(spark, sf_dir, "P")))
    corners = f.select("kind", *[F.col(f"{k}.{a}").alias(f"{n}{a}") for k, n in zip("abc", "pqw") for a in "xyz"], *[(F.round(f"n{k}", 4) + 0.0).alias(f"n{k}") for k in "xyz"])
    return tidy(corners, "nx", "ny", "nz")


@query("K4_heightmap", f"WITH {D.terrain('N')}, b AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM cells WHERE h > 0) SELECT r - r0 AS r, c - c0 AS c, CAST(floor(h * 255 + 0.5) AS INTEGER) AS v FROM cells, b WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1")
def k4(spark, sf_dir):
    from orograph.sources.sinks import heightmap_pixels

    return heightmap_pixels(terrain(spark, sf_dir, "N"))


@query("K2_trim", f"WITH {D.pixels('N')}, a AS (SELECT r, c, CAST(floor(raw * 255) AS INTEGER) AS alpha FROM px), b AS (SELECT greatest(0, min(r) - 2) AS r0, max(r) + 2 AS r1, greatest(0, min(c) - 2) AS c0, max(c) + 2 AS c1 FROM a WHERE alpha > 5) SELECT r - r0 AS r, c - c0 AS c, alpha FROM a, b WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1")
def k2(spark, sf_dir):
    from orograph.sources.sinks import trimmed

    p = raster(spark, sf_dir, "N").pixels
    return trimmed(p.select("r", "c", F.floor(F.col("raw") * 255).cast("int").alias("alpha")), margin=2)


@query("K8_stats", f"WITH {mesh_sql('N')}, s AS ({_ridge_sql('N', False, 4)}) SELECT (SELECT count(*) FROM s) AS segments, (SELECT 2 * count(*) FROM s) AS vertices, (SELECT count(*) FROM tri) AS triangles, (SELECT cols || '×' || rows FROM m) AS grid, {D.r6('(SELECT max_z - min_z FROM m)')} AS height")
def k8(spark, sf_dir):
    from orograph.sources.sinks import stats

    t = terrain(spark, sf_dir, "N")
    return tidy(stats(t, modes.ridgelines(t, band=(5, 95))))


# --- shading ---------------------------------------------------------------------------


def _shaded(spark, sf_dir):
    t = terrain(spark, sf_dir, "N")
    v = mesh.vertices(t).select("vid", "b")
    return mesh.normals(mesh.triangles(t)).join(v, "vid")


def _rough(df: DataFrame, column: str) -> DataFrame:
    """Colours to four decimals: sums of normals may differ in the last place."""
    return df.select("vid", *[(F.round(F.col(column)[k], 4) + 0.0).alias(k) for k in "rgb"])


_SHADE_BASE = f"WITH {mesh_sql('N')}, {_NORMAL_SQL}, shaded AS (SELECT nrm.*, v.h AS b FROM nrm JOIN v USING (vid))"
_LIGHT = "least(1, greatest(0, (nx * 2 * {0} + ny * {1} + nz * 2 * {2}) / sqrt(nx * 2 * nx * 2 + ny * ny + nz * 2 * nz * 2)))"


def _light_sql() -> str:
    import math

    az, alt = 315 * shade.PI / 180, 45 * shade.PI / 180
    light = [math.cos(az) * math.cos(alt), math.sin(alt), math.sin(az) * math.cos(alt)]
    size = math.sqrt(sum(x * x for x in light))
    return _LIGHT.format(*[f"CAST({x / size!r} AS DOUBLE)" for x in light])


@query("H7_hillshade", f"{_SHADE_BASE} SELECT vid, " + ", ".join(f"round(1 * (1 - 0.6) + ({_light_sql()}) * CAST(0.6 AS DOUBLE), 4) + 0.0 AS {k}" for k in "rgb") + " FROM shaded")
def h7(spark, sf_dir):
    s = _shaded(spark, sf_dir)
    return _rough(s.withColumn("k", shade.hillshade(shade.rgb((1, 1, 1)), F.col("nx"), F.col("ny"), F.col("nz"))), "k")


def _slope_sql() -> str:
    from orograph.functions.color import parse_hex

    low, high, s = parse_hex("#86efac"), parse_hex("#dc2626"), "least(1, greatest(0, 1 - ny))"
    return ", ".join(f"round(1 * (1 - {s} * 0.75) + (CAST({a!r} AS DOUBLE) * (1 - {s}) + CAST({b!r} AS DOUBLE) * {s}) * ({s} * 0.75), 4) + 0.0 AS {k}" for a, b, k in zip(low, high, "rgb"))


@query("H8_slope_shade", f"{_SHADE_BASE} SELECT vid, {_slope_sql()} FROM shaded")
def h8(spark, sf_dir):
    s = _shaded(spark, sf_dir)
    return _rough(s.withColumn("k", shade.slope_shade(shade.rgb((1, 1, 1)), F.col("ny"))), "k")


_SURFACE = {"fillHypsometric": True, "fillBanded": True, "fillHypsoInterval": 8, "gradientStops": GRADIENTS["Ocean"], "showHillshade": True, "hillshadeIntensity": None, "showSlopeShade": True}


def _surface_sql() -> str:
    """Written out for CAMERA and _SURFACE: normals seen by the camera, bands of 8 through a
    table of 256 colours, the light from the north-west, and green to red by slope."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    band = f"least(1, greatest(0, floor((b - 0.5) * 100 / {d(8)}) * 8 / {d(100)} + 0.5))"
    ocean = D.gradient([(0, "#001433"), (0.5, "#0066cc"), (1, "#00eeff")], f"(floor({band} * 255 + 0.5) / 255)")
    slope = "least(1, greatest(0, 1 - wy))"
    colors = ", ".join(
        f"round((k{n} * {d(0.4)} + light * {d(0.6)}) * (1 - {slope} * 0.75) + ({d(low)} / 255 * (1 - {slope}) + {d(high)} / 255 * {slope}) * {slope} * 0.75, 4) + 0.0 AS {n}"
        for n, low, high in (("r", 0x86, 0xDC), ("g", 0xEF, 0x26), ("b", 0xAC, 0x26))
    )
    tilt, turn = "radians(40)", "radians(30)"
    return f"""{_SHADE_BASE}, seen AS (SELECT vid, b, nx * cos({turn}) - nz * sin({turn}) AS wx,
 -nx * cos({tilt}) * sin({turn}) + ny * sin({tilt}) - nz * cos({tilt}) * cos({turn}) AS wy, nx * sin({tilt}) * sin({turn}) + ny * cos({tilt}) + nz * sin({tilt}) * cos({turn}) AS wz FROM shaded),
lit AS (SELECT vid, b, wy, least(1, greatest(0, (wx * 2 * 0.5 + wy * sqrt({d(0.5)}) - wz * 2 * 0.5) / sqrt(4 * wx * wx + wy * wy + 4 * wz * wz))) AS light, {", ".join(f"floor(({x}) * 255 + 0.5) / 255 AS k{n}" for n, x in zip("rgb", ocean))} FROM seen
 WHERE b BETWEEN {d(0.05)} AND {d(0.9)})
SELECT vid, {colors} FROM lit"""


@query("H9_surface", _surface_sql())
def h9(spark, sf_dir):
    """All layers of the surface as a camera sees it, from a style that leaves things out."""
    s = _shaded(spark, sf_dir)
    normal = view.view_normal(CAMERA, F.col("nx"), F.col("ny"), F.col("nz"))
    return _rough(s.withColumn("k", shade.surface(_SURFACE, F.col("b"), *normal, terrain={"elevMinCut": 5, "elevMaxCut": 90})).where("k IS NOT NULL"), "k")


@query("H2_modes", f"{_SHADE_BASE} SELECT vid, round(b, 4) + 0.0 AS elevation, round(least(1, greatest(0, 1 - ny)), 4) + 0.0 AS slope, round(atan2(nz, nx) / CAST({shade.PI!r} AS DOUBLE) * 0.5 + 0.5, 4) + 0.0 AS aspect FROM shaded WHERE abs(nx) + abs(nz) > 1e-6")
def h2(spark, sf_dir):
    """What the gradient is looked up by in each colour mode, where the aspect is defined."""
    s = _shaded(spark, sf_dir).where(F.abs("nx") + F.abs("nz") > 1e-6)
    return s.select("vid", *[(F.round(shade.mode_value(F.col("b"), F.col("nx"), F.col("ny"), F.col("nz"), m), 4) + 0.0).alias(m) for m in ("elevation", "slope", "aspect")])


@query("H1_brightness_cut", f"WITH {D.terrain('N')} SELECT r, c, {D.r6('h')} AS h FROM cells WHERE valid AND h BETWEEN CAST(0.2 AS DOUBLE) AND CAST(0.8 AS DOUBLE)")
def h1(spark, sf_dir):
    return tidy(terrain(spark, sf_dir, "N").cells.where("valid").where(shade.brightness_cut(F.col("h"), 20, 80)).select("r", "c", "h"))


_BAND_B = "least(1, greatest(0, floor(((h - 0.5) * 100) / CAST(8 AS DOUBLE)) * CAST(8 AS DOUBLE) / CAST(100 AS DOUBLE) + 0.5))"


@query("H3_bands", f"WITH {D.terrain('P')} SELECT r, c, {D.r6(_BAND_B)} AS b, " + ", ".join(f"{D.r6(f'floor(({x}) * 255 + 0.5) / 255')} AS k{n}" for n, x in zip("rgb", D.gradient(_TOPO, f"(floor({_BAND_B} * 255 + 0.5) / 255)"))) + " FROM cells WHERE valid")
def h3(spark, sf_dir):
    """H2, H3, H5: banded elevation through the gradient's table."""
    b = shade.banded(F.col("h"), F.col("h"), interval=8)
    p = terrain(spark, sf_dir, "P").cells.where("valid").withColumn("b", b).withColumn("k", shade.ramp(_TOPO, F.col("b")))
    return tidy(p.select("r", "c", "b", *[F.col(f"k.{n}").alias(f"k{n}") for n in "rgb"]))


_TEX = "(CAST(r % 7 AS DOUBLE) / 6)"
_BLENDS = {
    "normal": _TEX, "multiply": f"h * {_TEX}", "screen": f"1 - (1 - h) * (1 - {_TEX})", "overlay": f"CASE WHEN h >= 0.5 THEN 1 - (1 - h) * 2 * (1 - {_TEX}) ELSE h * 2 * {_TEX} END",
    "soft-light": f"CASE WHEN {_TEX} >= 0.5 THEN h + ({_TEX} * 2 - 1) * (sqrt(h) - h) ELSE h - (1 - {_TEX} * 2) * h * (1 - h) END", "add": f"least(1, greatest(0, h + {_TEX}))",
}


@query("H6_blend", f"WITH {D.terrain('P')} SELECT r, c, " + ", ".join(f"{D.r6(f'h * (1 - CAST(0.7 AS DOUBLE)) + ({x}) * CAST(0.7 AS DOUBLE)')} AS {n.replace('-', '_')}" for n, x in _BLENDS.items()) + " FROM cells WHERE valid")
def h6(spark, sf_dir):
    tex = shade.rgb([(F.col("r") % 7).cast("double") / 6] * 3)
    cells = terrain(spark, sf_dir, "P").cells.where("valid")
    return tidy(cells.select("r", "c", *[shade.blend(shade.rgb([F.col("h")] * 3), tex, n, 0.7)["r"].alias(n.replace("-", "_")) for n in _BLENDS]))


@query("H4_raw_light", f"{_SHADE_BASE} SELECT vid, round(greatest(0, (nx * 1 + ny * 2 + nz * 1.5) / sqrt(7.25)) * 0.7 + greatest(0, (nx * -0.5 + ny * 0.5 + nz * -1) / sqrt(1.5)) * 0.15 + 0.2, 4) + 0.0 AS light FROM shaded")
def h4(spark, sf_dir):
    return _shaded(spark, sf_dir).select("vid", (F.round(shade.raw_light(F.col("nx"), F.col("ny"), F.col("nz")), 4) + 0.0).alias("light"))


# --- points, erosion, view -------------------------------------------------------------


@query("P1_points", f"WITH {D.terrain('N')} SELECT r, c, {D.r6(D.wx('c'))} AS x, {D.r6(D.elev('h'))} AS y, {D.r6(D.wz('r'))} AS z FROM cells, m WHERE valid")
def p1(spark, sf_dir):
    return tidy(points.all_points(terrain(spark, sf_dir, "N")))


for _id, _by, _along in (("P2_row_extremes", "r", "c"), ("P3_column_extremes", "c", "r")):

    @query(
        _id,
        f"""WITH {D.terrain('N')}, e AS (SELECT r, c, {D.elev('h')} AS y FROM cells, m WHERE valid AND {_by} % 3 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY {_by} ORDER BY y DESC, {_along}) AS hi, row_number() OVER (PARTITION BY {_by} ORDER BY y, {_along}) AS lo FROM e)
SELECT 'peak' AS kind, r, c, {D.r6(D.wx('c'))} AS x, {D.r6('y')} AS y, {D.r6(D.wz('r'))} AS z FROM k, m WHERE hi = 1
UNION ALL SELECT 'valley', r, c, {D.r6(D.wx('c'))}, {D.r6('y')}, {D.r6(D.wz('r'))} FROM k, m WHERE lo = 1 AND hi > 1""",
    )
    def p2(spark, sf_dir, by=_by):
        return tidy(points.extremes(terrain(spark, sf_dir, "N"), step=3, by=by))


@query("P4_floor", f"WITH {D.terrain('N')} SELECT {D.r6('min(' + D.elev('h') + ')')} AS floor FROM cells, m WHERE valid")
def p4(spark, sf_dir):
    return tidy(points.all_points(terrain(spark, sf_dir, "N")).agg(F.min("y").alias("floor")))


_REST = f"s0 AS (SELECT r, c, {D.wx('c')} AS x, {D.elev('h')} AS y, {D.wz('r')} AS z, CAST(0 AS DOUBLE) AS vx, CAST(0 AS DOUBLE) AS vy, CAST(0 AS DOUBLE) AS vz, {D.wx('c')} AS hx, {D.elev('h')} AS hy, {D.wz('r')} AS hz FROM cells, m WHERE valid)"


def _spring_sql(k: int) -> str:
    v = ", ".join(f"(v{a} + (h{a} - {a}) * CAST(0.04 AS DOUBLE) + ({D.uniform('r', 'c', 1 + 3 * k + i)} - 0.5) * CAST(0.4 AS DOUBLE)) * CAST(0.92 AS DOUBLE) AS w{a}" for i, a in enumerate("xyz"))
    return f"t{k} AS (SELECT *, {v} FROM s{k}), s{k + 1} AS (SELECT r, c, {', '.join(f'{a} + w{a} AS {a}' for a in 'xyz')}, {', '.join(f'w{a} AS v{a}' for a in 'xyz')}, hx, hy, hz FROM t{k})"


def _fall_sql(k: int) -> str:
    pull = {"x": "0", "y": "CAST(0.04 AS DOUBLE)", "z": "0"}
    v = ", ".join(f"CASE WHEN down THEN 0 ELSE (v{a} - {pull[a]}) * CAST(0.97 AS DOUBLE) END AS w{a}" for a in "xyz")
    return f"""d{k} AS (SELECT s{k}.*, m.min_z, y <= m.min_z AND vy <= 0 AS down FROM s{k}, m), t{k} AS (SELECT *, {v} FROM d{k}),
s{k + 1} AS (SELECT r, c, x + wx AS x, CASE WHEN NOT down AND y + wy < min_z THEN min_z ELSE y + wy END AS y, z + wz AS z, wx AS vx, CASE WHEN NOT down AND y + wy < min_z THEN 0 ELSE wy END AS vy, wz AS vz, hx, hy, hz FROM t{k})"""


_XYZ = f"SELECT r, c, {D.r6('x')} AS x, {D.r6('y')} AS y, {D.r6('z')} AS z"


@query("P5_spring", f"WITH {D.terrain('N')}, {_REST}, {', '.join(map(_spring_sql, range(4)))} {_XYZ} FROM s4")
def p5(spark, sf_dir):
    p = points.at_rest(points.all_points(terrain(spark, sf_dir, "N")))
    return tidy(points.advanced(p, 4, points.spring()).select("r", "c", "x", "y", "z"))


@query("P6_gravity", f"WITH {D.terrain('N')}, {_REST}, {', '.join(map(_fall_sql, range(6)))} {_XYZ} FROM s6")
def p6(spark, sf_dir):
    t = terrain(spark, sf_dir, "N")
    p = points.at_rest(points.all_points(t))
    return tidy(points.advanced(p, 6, points.gravity(t.meta.min_z)).select("r", "c", "x", "y", "z"))


@query(
    "E1_brush",
    f"""WITH {D.pixels('P')}, b AS (SELECT y, x, sqrt(x * x + y * y) AS d FROM range(-3, 4) p(y), range(-3, 4) q(x)), w AS (SELECT y, x, 1 - d / 3 AS w FROM b WHERE d <= 3),
n AS (SELECT y, x, w / (SELECT sum(w) FROM w) AS w FROM w) SELECT a.r, a.c, {D.r6('sum(o.raw * w)')} AS amount FROM px a, n JOIN px o ON o.r = a.r + y AND o.c = a.c + x GROUP BY a.r, a.c""",
)
def e1(spark, sf_dir):
    """The erosion brush laid over every place of a raster."""
    return tidy(sequential.brushed(raster(spark, sf_dir, "P").pixels, 3))


@query("E9_undo", f"WITH {D.pixels('N')} SELECT r, c, {D.r6('raw')} AS raw, valid, {D.r6('CASE WHEN valid THEN 1 - raw ELSE raw END')} AS turned FROM px")
def e9(spark, sf_dir):
    """A raster after a step that was taken back, beside the same step made again."""
    history = History(spark, folder_of(spark))
    history.save(raster(spark, sf_dir, "N"))
    history.apply(lambda px, *size: px.withColumn("raw", F.when(F.col("valid"), 1 - F.col("raw")).otherwise(F.col("raw"))), "turned")
    history.undo()
    now = history.raster()
    history.redo()
    return tidy(now.pixels.join(history.raster().pixels.select("r", "c", F.col("raw").alias("turned")), ["r", "c"]))


@query("E3_erosion")
def e3(spark, sf_dir):
    r = raster(spark, sf_dir, "E")
    return tidy(sequential.erode(r.pixels, r.width, r.height))


def _seen(t: grid.Terrain):
    return view.project_triangles(mesh.triangles(t), CAMERA)


def project_sql(x: str, y: str, z: str) -> tuple[str, str, str]:
    import math

    at, *axes = CAMERA.axes()
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    vx, vy, vz = (f"((({x}) - {d(at[0])}) * {d(a[0])} + (({y}) - {d(at[1])}) * {d(a[1])} + (({z}) - {d(at[2])}) * {d(a[2])})" for a in axes)
    f = 1 / math.tan(math.radians(CAMERA.fov) / 2)
    return (
        f"(({vx} * {d(f * CAMERA.height / CAMERA.width)} / -{vz} + 1) * 0.5 * {CAMERA.width})",
        f"((1 - {vy} * {d(f)} / -{vz}) * 0.5 * {CAMERA.height})", vz,
    )


def _project_cte(name: str) -> str:
    sx, sy, sz = project_sql("x", "y", "z")
    return f"{mesh_sql(name)}, s AS (SELECT r, c, vid, h, valid, {sx} AS sx, {sy} AS sy, {sz} AS sz FROM v)"


@query("V3_project", f"WITH {_project_cte('N')} SELECT r, c, {D.r6('sx')} AS sx, {D.r6('sy')} AS sy, {D.r6('sz')} AS sz FROM s WHERE valid")
def v3(spark, sf_dir):
    p = points.all_points(terrain(spark, sf_dir, "N"))
    return tidy(p.select("r", "c", *[e.alias(n) for e, n in zip(CAMERA.project(F.col("x"), F.col("y"), F.col("z")), ("sx", "sy", "sz"))]))


def _along_sql(a: int, b: int, v: str) -> str:
    return f"({v}{a} + ({v}{b} - {v}{a}) * (CASE WHEN y{b} - y{a} > 0 THEN (py - y{a}) / (y{b} - y{a}) ELSE 0 END))"


ZBUFFER = f"""corners AS (SELECT tri.r, tri.c, tri.part, n, s.sx AS x, s.sy AS y, 1 / -s.sz AS d FROM (SELECT r, c, part, unnest([a.vid, b.vid, c3.vid]) AS vid, unnest([0, 1, 2]) AS n FROM tri) tri JOIN s USING (vid)),
sorted AS (SELECT r, c, part, list({{'y': y, 'x': x, 'd': d}} ORDER BY y, n) AS k FROM corners GROUP BY ALL),
flat AS (SELECT k[1].x AS x0, k[1].y AS y0, k[1].d AS d0, k[2].x AS x1, k[2].y AS y1, k[2].d AS d1, k[3].x AS x2, k[3].y AS y2, k[3].d AS d2 FROM sorted),
lines AS (SELECT *, unnest(range(CAST(greatest(0, ceil(y0)) AS INTEGER), CAST(least({CAMERA.height - 1}, floor(y2)) AS INTEGER) + 1)) AS py FROM flat WHERE y2 - y0 >= 0.5),
ed AS (SELECT py, {_along_sql(0, 2, 'x')} AS lx, {_along_sql(0, 2, 'd')} AS ld, CASE WHEN py <= y1 THEN {_along_sql(0, 1, 'x')} ELSE {_along_sql(1, 2, 'x')} END AS rx, CASE WHEN py <= y1 THEN {_along_sql(0, 1, 'd')} ELSE {_along_sql(1, 2, 'd')} END AS rd FROM lines),
sp AS (SELECT py, least(lx, rx) AS xl, greatest(lx, rx) AS xr, CASE WHEN lx <= rx THEN ld ELSE rd END AS dl, CASE WHEN lx <= rx THEN rd ELSE ld END AS dr FROM ed),
pxs AS (SELECT *, unnest(range(CAST(greatest(0, ceil(xl)) AS INTEGER), CAST(least({CAMERA.width - 1}, floor(xr)) AS INTEGER) + 1)) AS px FROM sp),
zb AS MATERIALIZED (SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, max(dl + (dr - dl) * (CASE WHEN xr - xl > 0 THEN (px - xl) / (xr - xl) ELSE 0 END)) AS inv FROM pxs GROUP BY ALL)"""


@query("V4_depth_buffer", f"WITH {_project_cte('P')}, {ZBUFFER} SELECT px, py, {D.r6('inv * 1000')} AS inv FROM zb")
def v4(spark, sf_dir):
    return tidy(view.depth_buffer(_seen(terrain(spark, sf_dir, "P")), CAMERA).withColumn("inv", F.col("inv") * 1000))


_F = "(CAST(t AS DOUBLE) / 64)"
_PROBE = project_sql(*[f"{k}0 + ({k}1 - {k}0) * {_F}" for k in "xyz"])
_RUNS = f"""ln AS MATERIALIZED (SELECT row_number() OVER () AS seg, * FROM ({_ridge_sql('P', False, 8)})),
pr AS (SELECT seg, t, {_PROBE[0]} AS sx, {_PROBE[1]} AS sy, {_PROBE[2]} AS sz FROM ln, range(65) g(t)),
probe AS MATERIALIZED (SELECT *, CAST(greatest(0, least({CAMERA.width - 1}, floor(sx + 0.5))) AS INTEGER) AS px, CAST(greatest(0, least({CAMERA.height - 1}, floor(sy + 0.5))) AS INTEGER) AS py FROM pr),
vis AS MATERIALIZED (SELECT seg, t, sx, sy, sz, inv IS NULL OR sz >= -1 / inv - 1 AS visible FROM probe LEFT JOIN zb USING (px, py)),
isl AS (SELECT *, sum(CASE WHEN visible = prev THEN 0 ELSE 1 END) OVER (PARTITION BY seg ORDER BY t) AS run FROM (SELECT *, lag(visible, 1, visible) OVER (PARTITION BY seg ORDER BY t) AS prev FROM vis)),
runs AS (SELECT seg, run, any_value(visible) AS visible, arg_min(sx, t) AS x0, arg_min(sy, t) AS y0, max(t) AS last_t FROM isl GROUP BY seg, run),
cutt AS (SELECT runs.*, e.sx AS x1, e.sy AS y1 FROM runs JOIN vis e ON e.seg = runs.seg AND e.t = least(64, last_t + 1)),
kept AS (SELECT * FROM cutt WHERE sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) >= 0.1)"""


def _stored(sql: str) -> str:
    """The shared relations are worked out once, whatever plan is chosen."""
    for name in ("px", "cells", "v", "s", "tri", "flat"):
        sql = sql.replace(f"\n{name} AS (", f"\n{name} AS MATERIALIZED (").replace(f", {name} AS (", f", {name} AS MATERIALIZED (")
    return sql


@query("V7_visible_runs", _stored(f"WITH {_project_cte('P')}, {ZBUFFER}, {_RUNS}") + f" SELECT CAST(run AS INTEGER) AS run, visible, {D.r6('x0')} AS x0, {D.r6('y0')} AS y0, {D.r6('x1')} AS x1, {D.r6('y1')} AS y1 FROM kept")
def v7(spark, sf_dir):
    t = terrain(spark, sf_dir, "P")
    depth = view.depth_buffer(_seen(t), CAMERA)
    s = tidy(modes.ridgelines(t, spacing=8, band=(5, 95)).select(*POINTS))
    return tidy(view.visible_runs(s, CAMERA, depth, ghosts=True, keep=()).drop("seg"))


@query("V8_fill", f"WITH {_project_cte('P')} SELECT tri.r, tri.c AS col, part, {D.r6('(a.h + b.h + c3.h) / 3')} AS b, {D.r6('(sa.sz + sb.sz + sc.sz) / 3')} AS depth FROM tri JOIN s sa ON sa.vid = a.vid JOIN s sb ON sb.vid = b.vid JOIN s sc ON sc.vid = c3.vid WHERE (a.h + b.h + c3.h) / 3 BETWEEN CAST(0.1 AS DOUBLE) AND CAST(0.9 AS DOUBLE)")
def v8(spark, sf_dir):
    f = view.fill_polygons(mesh.triangles(terrain(spark, sf_dir, "P")), CAMERA, low=10, high=90)
    return tidy(f.select("r", "col", "part", "b", "depth"))


@query("V9_particles", f"WITH {_project_cte('N')} SELECT r, c, {D.r6('sx')} AS cx, {D.r6('sy')} AS cy, {D.r6('1200 / -sz * 0.5')} AS radius, TRUE AS visible FROM s WHERE valid AND sz < 0")
def v9(spark, sf_dir):
    return tidy(view.particle_circles(points.all_points(terrain(spark, sf_dir, "N")), CAMERA))


@query("V10_bounds", f"WITH {_project_cte('P')}, {ZBUFFER}, {_RUNS} SELECT {D.r6('min(least(x0, x1)) - 20')} AS vx, {D.r6('min(least(y0, y1)) - 20')} AS vy, {D.r6('max(greatest(x0, x1)) - min(least(x0, x1)) + 40')} AS vw, {D.r6('max(greatest(y0, y1)) - min(least(y0, y1)) + 40')} AS vh FROM kept WHERE visible")
def v10(spark, sf_dir):
    t = terrain(spark, sf_dir, "P")
    depth = view.depth_buffer(_seen(t), CAMERA)
    s = tidy(modes.ridgelines(t, spacing=8, band=(5, 95)).select(*POINTS))
    return tidy(view.bounds(view.visible_runs(s, CAMERA, depth, keep=())))


_ONE = lambda v, n=1: f"printf('%.{n}f', floor(({v}) * {10**n} + 0.5) / {10**n})"
_SVG_COLOR = " || ',' || ".join(f"CAST(CAST(floor(({x}) * 255 + 0.5) AS BIGINT) AS VARCHAR)" for x in D.gradient(_TOPO, "pg.b"))
_SVG_SQL = f"""WITH {_project_cte('P')}, {ZBUFFER}, {_RUNS.replace(_ridge_sql('P', False, 8), _ridge_sql('P', False, 8).replace('0.05', '0.0').replace('0.95', '1.0'))},
shown AS MATERIALIZED (SELECT CAST(visible AS BOOLEAN) AS visible, x0, y0, x1, y1 FROM kept),
pg AS MATERIALIZED (SELECT (a.h + b.h + c3.h) / 3 AS b, sa.sx AS xa, sa.sy AS ya, sb.sx AS xb, sb.sy AS yb, sc.sx AS xc, sc.sy AS yc, (sa.sz + sb.sz + sc.sz) / 3 AS depth
  FROM tri JOIN s sa ON sa.vid = a.vid JOIN s sb ON sb.vid = b.vid JOIN s sc ON sc.vid = c3.vid WHERE (a.h + b.h + c3.h) / 3 BETWEEN CAST(0.1 AS DOUBLE) AND CAST(0.9 AS DOUBLE)),
ci AS MATERIALIZED (SELECT sx AS cx, sy AS cy, 1200 / -sz * 0.5 AS radius, inv IS NULL OR sz >= -1 / inv - 1 AS visible FROM s
  LEFT JOIN zb ON px = CAST(greatest(0, least({CAMERA.width - 1}, floor(sx + 0.5))) AS INTEGER) AND py = CAST(greatest(0, least({CAMERA.height - 1}, floor(sy + 0.5))) AS INTEGER) WHERE valid AND sz < 0),
ends AS (SELECT x0, y0, x1, y1 FROM shown UNION ALL SELECT cx - radius, cy - radius, cx + radius, cy + radius FROM ci),
box AS MATERIALIZED (SELECT min(least(x0, x1)) - 20 AS vx, min(least(y0, y1)) - 20 AS vy FROM ends),
used AS (SELECT DISTINCT visible FROM shown)
SELECT 1 AS section, 5 AS part, {D.r6('depth')} AS place, CAST(NULL AS VARCHAR) AS layer, FALSE AS ghost, '<polygon points="' || {" || ' ' || ".join(f"{_ONE(f'x{k} - vx')} || ',' || {_ONE(f'y{k} - vy')}" for k in 'abc')} || '" fill="rgb(' || {_SVG_COLOR} || ')" stroke="none"/>' AS element FROM pg, box
UNION ALL SELECT * FROM (VALUES (1, 0, CAST(0 AS DOUBLE), NULL, FALSE, '<g>'), (1, 7, 0, NULL, FALSE, '</g>'), (3, 0, 0, NULL, FALSE, '<g stroke="none">'), (3, 7, 0, NULL, FALSE, '</g>'))
UNION ALL SELECT 2, CASE WHEN visible THEN 5 ELSE 2 END, 0, 'X', NOT visible, '<line x1="' || {_ONE('x0 - vx')} || '" y1="' || {_ONE('y0 - vy')} || '" x2="' || {_ONE('x1 - vx')} || '" y2="' || {_ONE('y1 - vy')} || '" stroke="' || CASE WHEN visible THEN 'rgb(0,0,0)' ELSE '#a80000' END || '"/>' FROM shown, box
UNION ALL SELECT 2, CASE WHEN visible THEN 4 ELSE 1 END, 0, 'X', NOT visible, '<g stroke-width="1.000" stroke-dasharray="3 2" opacity="' || CASE WHEN visible THEN '0.800' ELSE '0.200' END || '" stroke-linecap="round" stroke-linejoin="round">' FROM used
UNION ALL SELECT 2, CASE WHEN visible THEN 6 ELSE 3 END, 0, 'X', NOT visible, '</g>' FROM used
UNION ALL SELECT 2, 0, 0, 'X', FALSE, '<g id="layer-X" inkscape:groupmode="layer" inkscape:label="X">' FROM (SELECT 1 FROM shown LIMIT 1)
UNION ALL SELECT 2, 7, 0, 'X', FALSE, '</g>' FROM (SELECT 1 FROM shown LIMIT 1)
UNION ALL SELECT 3, 5, 0, NULL, NOT visible, '<circle cx="' || {_ONE('cx - vx')} || '" cy="' || {_ONE('cy - vy')} || '" r="' || {_ONE('radius', 2)} || '" fill="' || CASE WHEN visible THEN '#000000' ELSE '#a80000' END || '" opacity="' || CASE WHEN visible THEN '1.000' ELSE '0.250' END || '"/>' FROM ci, box"""


@query("K1_svg", _SVG_SQL)
def k1(spark, sf_dir):
    """Fill polygons, lines in their layer's groups and circles."""
    from orograph.sources.sinks import svg_elements

    t = terrain(spark, sf_dir, "P")
    faces = mesh.triangles(t)
    depth = view.depth_buffer(view.project_triangles(faces, CAMERA), CAMERA)
    s = modes.colored(modes.draw(t, {"X": {"spacing": 8}}))
    s = s.select("layer", "color0", *[micro(F.col(p)).alias(p) for p in POINTS])
    runs = view.visible_runs(s, CAMERA, depth, ghosts=True, keep=("layer", "color0"))
    dots = view.particle_circles(points.all_points(t), CAMERA, depth, ghosts=True)
    made = svg_elements(runs, CAMERA, weights={"X": 2}, dashes={"X": "dashed"}, opacities={"X": 0.8}, ghost_opacity=0.25, polygons=view.fill_polygons(faces, CAMERA, low=10, high=90), stops=_TOPO, circles=dots)
    return tidy(made.select("section", "part", "place", "layer", "ghost", "element"))
