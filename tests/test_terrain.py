"""Operators on small hand-made grids against brute force, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.operators import grid, mesh, modes, points, sequential, view
from orograph.sources.rasters import NoElevation, normalised


def pixels(spark, values, valid=None):
    a = np.asarray(values, float)
    ok = np.ones(a.shape, bool) if valid is None else np.asarray(valid, bool)
    rows = [(r, c, float(a[r, c]), bool(ok[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "r int, c int, raw double, valid boolean")


def terrain(spark, values, valid=None, **options):
    h, w = np.shape(values)
    return grid.build_terrain(pixels(spark, values, valid), w, h, **options)


def segments(df):
    return sorted(tuple(round(x, 6) for x in r) for r in df.select(*modes.POINTS).collect())


PEAK = [[0, 0, 0, 0, 0], [0, 0.3, 0.4, 0.3, 0], [0, 0.4, 1, 0.4, 0], [0, 0.3, 0.4, 0.3, 0], [0, 0, 0, 0, 0]]
HOLED = np.ones((5, 5), bool)
HOLED[1, 3] = False


@pytest.mark.parametrize("size,resolution,expected", [(500, 2, 250), (500, 1, 500), (500, 4, 125)])
def test_grid_sizes(spark, size, resolution, expected):
    none = spark.createDataFrame([], "r int, c int, raw double, valid boolean")
    _, rows, cols = grid.stride_sample(none, size, size, resolution)
    assert (rows, cols) == (expected, expected)


@pytest.mark.parametrize("radius", [0, 0.4, 1, 2, 9])
def test_box_blur(spark, radius):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1000, (7, 9)) / 1024
    k = math.floor(radius + 0.5)
    got = {(r.r, r.c): r.b for r in grid.box_blur(pixels(spark, a), "raw", radius, "b").collect()}
    for r in range(7):
        for c in range(9):
            assert got[r, c] == pytest.approx(a[max(0, r - k) : r + k + 1, max(0, c - k) : c + k + 1].mean(), abs=1e-6)


def test_constant_and_empty_terrains(spark):
    flat = terrain(spark, np.full((5, 5), 0.5))
    assert flat.meta.max_slope == 0 and flat.meta.min_z == flat.meta.max_z == 0
    assert modes.hachure(flat).count() == modes.drainage(flat).count() == 0
    none = terrain(spark, np.zeros((3, 3)), np.zeros((3, 3), bool))
    assert (none.meta.min_z, none.meta.max_z, none.meta.half_w) == (50, -50, 1)
    assert modes.contours(none).count() == points.all_points(none).count() == mesh.triangles(none).count() == 0
    with pytest.raises(NoElevation):
        normalised(spark, spark.createDataFrame([(0, 0, 5.0), (0, 1, -9999.0)], "r int, c int, v double"))
    with pytest.raises(ValueError):
        terrain(spark, PEAK, elev_scale=0)


def test_single_row_and_column(spark):
    line = terrain(spark, [[0, 0.5, 1]])
    assert len(segments(modes.ridgelines(line, spacing=1))) == 2
    assert modes.ridgelines(line, along_columns=True, spacing=1).count() == 0
    assert len(segments(modes.ridgelines(terrain(spark, [[0], [0.5], [1]]), along_columns=True, spacing=1))) == 2


def test_slope_reads_missing_neighbours_as_the_cell(spark):
    t = terrain(spark, PEAK, HOLED)
    s = {(r.r, r.c): r.slope for r in t.cells.collect()}
    assert s[1, 2] == pytest.approx(math.hypot(0, 1 - 0.4), abs=1e-6)
    assert s[1, 3] == 0


def brute_contours(a, ok, level):
    """Segments of one level, in grid coordinates, end by end."""
    out = []
    for r in range(a.shape[0] - 1):
        for c in range(a.shape[1] - 1):
            k = [(r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c)]
            if not any(ok[p] for p in k):
                continue
            v = [a[p] if ok[p] else level - 1e-7 for p in k]
            index = sum(bit for x, bit in zip(v, (8, 4, 2, 1)) if x >= level)
            lerp = lambda i, j: 0.5 if abs(v[j] - v[i]) < 1e-10 else (level - v[i]) / (v[j] - v[i])  # noqa: B023, E731
            edges = [(c + lerp(0, 1), r), (c + 1, r + lerp(1, 2)), (c + lerp(3, 2), r + 1), (c, r + lerp(0, 3))] if 0 < index < 15 else []
            pairs = modes.MARCHING.get(index, [])
            out += [(edges[pairs[i]], edges[pairs[i + 1]]) for i in range(0, len(pairs), 2)]
    return out


@pytest.mark.parametrize("values,valid", [(PEAK, None), (PEAK, HOLED), ([[1, 0], [0, 1]], None), ([[0, 1], [1, 0]], None)])
def test_contours(spark, values, valid):
    t = terrain(spark, values, valid)
    a = np.asarray(values, np.float32).astype(float)
    ok = np.ones(a.shape, bool) if valid is None else valid
    got: dict = {}
    for x in modes.contour_crossings(t, interval=7).collect():
        got.setdefault(x.elev, []).append(((x.c0, x.r0), (x.c1, x.r1)))
    e = math.ceil((t.meta.min_z - 1e-7) / 7) * 7
    while e <= t.meta.max_z + 7:
        inside = t.meta.min_z <= e <= t.meta.max_z
        wanted = brute_contours(a, ok, e / 100 + 0.5) if inside else []
        near = lambda s: sorted(tuple(np.round(p, 6).ravel()) for p in s)
        assert near(got.get(e, [])) == near(wanted)
        e += 7


def test_closed_contours_have_no_open_ends(spark):
    rng = np.random.default_rng(5)
    t = terrain(spark, rng.random((9, 11)))
    closed = sequential.close_rings(modes.contour_crossings(t, interval=10), 9, 11)
    ends = closed.select("i", F.explode(F.array(F.struct("c0", "r0"), F.struct(F.col("c1").alias("c0"), F.col("r1").alias("r0")))).alias("p"))
    odd = ends.groupBy("i", "p").count().where("count % 2 = 1")
    assert odd.count() == 0
    assert closed.where("r = -1").count() > 0


def test_ties_in_drainage_go_to_the_first_in_reading_order(spark):
    t = terrain(spark, [[0.2, 0.2, 0.2], [0.2, 1, 0.2], [0.2, 0.2, 0.2]])
    assert [(r.r, r.c, r.dr, r.dc) for r in modes.drainage(t).collect()] == [(1, 1, 0, 0)]


def test_stream_order(spark):
    # two sources meet (order 2), then one more source of order 1 (stays 2)
    edges = spark.createDataFrame([(0, 0, 1, 1), (0, 2, 1, 1), (1, 1, 2, 1), (2, 0, 3, 1), (2, 1, 3, 1), (3, 1, 4, 1)], "r int, c int, dr int, dc int")
    order = {(r.r, r.c): r.ord for r in sequential.stream_order(edges).collect()}
    assert order == {(0, 0): 1, (0, 2): 1, (1, 1): 2, (2, 0): 1, (2, 1): 2, (3, 1): 2}


def brute_order(edges):
    """Orders from the sources down."""
    import functools
    import sys

    sys.setrecursionlimit(20_000)
    up = {}
    for r, c, dr, dc in edges:
        up.setdefault((dr, dc), []).append((r, c))

    @functools.cache
    def order(cell):
        tops = sorted((order(x) for x in up.get(cell, [])), reverse=True)
        return 1 if not tops else tops[0] + (len(tops) > 1 and tops[0] == tops[1])

    return {(r, c): order((r, c)) for r, c, _, _ in edges}


@pytest.mark.parametrize("kind", ["raster", "path", "comb"])
def test_stream_order_against_brute_force(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    if kind == "raster":
        smooth = np.add.outer(np.linspace(2, 0, 40), np.abs(np.linspace(-1, 1, 30))) + rng.random((40, 30)) * 0.1
        edges = [(r.r, r.c, r.dr, r.dc) for r in modes.drainage(terrain(spark, smooth / smooth.max())).collect()]
    else:  # a path of a thousand cells; with single cells and pairs that flow in
        edges = [(0, c, 0, c + 1) for c in range(1000)]
        if kind == "comb":
            for c in range(1, 1000):
                edges += [(1, c, 0, c)]
                if rng.random() < 0.3:
                    edges += [(2, c, 1, c), (3, c, 1, c)]
    cuts = []
    monkeypatch.setattr(sequential, "cut", lambda d, real=sequential.cut: (cuts.append(1), real(d))[1])
    got = {(r.r, r.c): r.ord for r in sequential.stream_order(spark.createDataFrame(edges, "r int, c int, dr int, dc int")).collect()}
    assert got == brute_order(edges)
    assert len(cuts) < 50  # rounds of three


def test_stream_order_refuses_a_cycle(spark):
    with pytest.raises(ValueError):
        sequential.stream_order(spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 0)], "r int, c int, dr int, dc int"))


@pytest.mark.parametrize("block", [3, 2048])
def test_blocks_of_windows(spark, block, monkeypatch):
    """Neighbours, blur and squares don't depend on how rows and columns are cut."""
    monkeypatch.setattr(grid, "BLOCK", block)
    rng = np.random.default_rng(11)
    a = rng.integers(0, 1000, (13, 10)) / 1024
    px = pixels(spark, a)
    for k in (1, 4, 7):
        got = {(r.r, r.c): r.b for r in grid.box_blur(px, "raw", k, "b").collect()}
        assert len(got) == 130 and all(got[r, c] == pytest.approx(a[max(0, r - k) : r + k + 1, max(0, c - k) : c + k + 1].mean(), abs=1e-6) for r, c in got)
    at = lambda r, c: a[r, c] if 0 <= r < 13 and 0 <= c < 10 else None
    n = {(r.r, r.c): r for r in grid.neighbours(px, "raw").collect()}
    assert all((n[r, c].nw and n[r, c].nw.raw, n[r, c].e and n[r, c].e.raw, n[r, c].s and n[r, c].s.raw) == (at(r - 1, c - 1), at(r, c + 1), at(r + 1, c)) for r, c in n) and len(n) == 130
    s = {(r.r, r.c): (r.tl, r.tr, r.bl, r.br) for r in grid.squares(px, F.col("raw")).collect()}
    assert all(s[r, c] == (at(r, c), at(r, c + 1), at(r + 1, c), at(r + 1, c + 1) if c < 9 else None) for r, c in s if c < 9) and len(s) == 130


def test_strahler_grows_along_edges(spark):
    rng = np.random.default_rng(2)
    t = terrain(spark, rng.random((12, 12)))
    edges = modes.drainage(t)
    assert edges.where("dh >= h").count() == 0
    order = sequential.stream_order(edges)
    both = edges.join(order, ["r", "c"]).join(order.select(F.col("r").alias("dr"), F.col("c").alias("dc"), F.col("ord").alias("next")), ["dr", "dc"])
    assert both.where("next < ord").count() == 0


def test_flow_lines_keep_to_their_cells(spark):
    rng = np.random.default_rng(4)
    a = np.add.outer(np.linspace(1, 0, 20), np.linspace(0.5, 0, 20)) / 1.5 + rng.random((20, 20)) * 0.01
    t = terrain(spark, a)
    one = modes.flow_lines(t, spacing=3)
    tiles = modes.flow_lines(t, spacing=3, tile=7)
    assert one.count() > 10 and segments(one) == segments(tiles)
    assert one.groupBy("seed", "step").count().where("count > 1").count() == 0
    # down the slope all the way
    assert one.where("y1 > y0 + 1e-9").count() <= one.count() * 0.2


def brute_flow_lines(t, spacing, band=(0, 100), longest=100):
    """Lines drawn one after the other over one mask of reached cells."""
    m = t.meta
    h, ok, reached = np.zeros((m.rows, m.cols)), np.zeros((m.rows, m.cols), bool), np.zeros((m.rows, m.cols), bool)
    for x in t.cells.collect():
        h[x.r, x.c], ok[x.r, x.c] = x.h, x.valid
    near = lambda v: math.floor(v + 0.5)
    height = lambda r, c: float(sequential.bilinear(h, np.array([r]), np.array([c]))[0])
    shown = lambda v: band[0] / 100 <= (((v - 0.5) * 100 * m.elev_scale - m.min_z) / (m.max_z - m.min_z) if m.max_z > m.min_z else 0.0) <= band[1] / 100
    out = []
    for seed in ((r, c) for r in range(0, m.rows, spacing) for c in range(0, m.cols, spacing)):
        if not ok[seed] or reached[seed]:
            continue
        r, c = map(float, seed)
        for k in range(longest):
            if not (0.5 <= r <= m.rows - 1.5 and 0.5 <= c <= m.cols - 1.5) or not ok[near(r), near(c)]:
                break
            reached[near(r), near(c)] = True
            gx, gz = height(r, c + 0.5) - height(r, c - 0.5), height(r + 0.5, c) - height(r - 0.5, c)
            size = math.sqrt(gx * gx + gz * gz)
            if size < 0.0005:
                break
            nr, nc = r - gz / size, c - gx / size
            if reached[near(nr), near(nc)] or not ok[near(nr), near(nc)]:
                break
            ends = shown(height(r, c)), shown(height(nr, nc))
            if all(ends):
                out.append((seed[0] * m.cols + seed[1], k))
            elif not any(ends):
                break
            r, c = nr, nc
    return sorted(out)


@pytest.mark.parametrize(("name", "spacing", "band"), [("E", 1, (0, 100)), ("E", 4, (0, 100)), ("N", 1, (0, 100)), ("N", 2, (20, 60)), ("P", 1, (0, 100)), ("P", 1, (30, 70)), ("P", 2, (0, 100))])
def test_flow_lines_are_those_drawn_one_after_the_other(spark, name, spacing, band):
    from orograph.plans.terrain import terrain as of_tables
    from tests.conftest import SMALL

    t = of_tables(spark, SMALL if name == "E" else "/root/testdata/sf0.01", name)
    got = sorted((r.seed, r.step) for r in modes.flow_lines(t, spacing=spacing, band=band).select("seed", "step").collect())
    assert got == brute_flow_lines(t, spacing, band) and len(got) > 5


def test_mirrors_multiply_and_turn_faces(spark):
    t = terrain(spark, PEAK)
    s, signs = modes.ridgelines(t, spacing=1), mesh.octants(minus_x=True, minus_z=True)
    assert mesh.mirrored(s, signs).count() == s.count() * 4
    assert mesh.mirrored(s, mesh.octants(plus_x=False)).count() == 0
    faces = mesh.mirrored_triangles(mesh.triangles(t).select("a", "b", "c"), mesh.octants(minus_x=True))
    up = mesh.with_normal(faces)
    assert up.where("ny <= 0").count() == 0


def test_crosshatch_is_rows_and_columns(spark):
    t = terrain(spark, PEAK, HOLED)
    both = segments(modes.ridgelines(t, spacing=2)) + segments(modes.ridgelines(t, along_columns=True, spacing=2))
    assert segments(modes.crosshatch(t, spacing=2)) == sorted(both)


def test_solid_is_watertight(spark):
    t = terrain(spark, np.random.default_rng(1).random((6, 8)))
    faces = mesh.solid(t)
    p = lambda k: F.struct(*[F.round(f"{k}.{x}", 4).alias(x) for x in "xyz"])
    edges = faces.select(F.explode(F.array(*[F.struct(p(i).alias("u"), p(j).alias("v")) for i, j in ("ab", "bc", "ca")])).alias("e")).select("e.u", "e.v")
    pairs = edges.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), (F.col("u") < F.col("v")).cast("int").alias("way")).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.sum("way").alias("ways"))
    # each edge twice, once each way
    assert pairs.where("n <> 2 or ways <> 1").count() == 0


def test_pillar_shapes(spark):
    t = terrain(spark, PEAK)
    n = modes.pillars(t, spacing=2).count()
    assert modes.pillars(t, spacing=2, style="cuboid").count() == 12 * n
    assert modes.pillars(t, spacing=2, style="cylinder", sides=5).count() == 15 * n
    assert modes.pillar_lids(t, spacing=2, style="cylinder", sides=5).count() == 5 * n
    with pytest.raises(ValueError):
        modes.pillar_lids(t, style="line")


def test_erosion(spark):
    rng = np.random.default_rng(8)
    px = pixels(spark, rng.random((30, 30)))
    run = lambda **o: {(r.r, r.c): r.raw for r in sequential.erode(px, 30, 30, droplets=200, batches=2, **o).collect()}
    a, b = run(), run()
    assert a == b and len(a) == 900 and all(0 <= v <= 1 for v in a.values())
    assert a != run(seed=2)
    tiled = run(tile=16)
    assert max(abs(a[k] - tiled[k]) for k in a) < 1e-9
    assert sum(w for *_, w in sequential.erosion_brush(3)) == pytest.approx(1)


def brute_droplets(h, drops, p):
    """Droplets one after the other, each over the map that the ones before it left."""
    h = h.copy()
    rows, cols = h.shape

    def corners(x, y):
        j, i = math.floor(x), math.floor(y)
        u, v = x - j, y - i
        return ((i, j, (1 - u) * (1 - v)), (i, j + 1, u * (1 - v)), (i + 1, j, (1 - u) * v), (i + 1, j + 1, u * v)), u, v

    def look(x, y):
        places, u, v = corners(x, y)
        a, b, c, d = (h[i, j] for i, j, _ in places)
        return sum(h[i, j] * w for i, j, w in places), (b - a) * (1 - v) + (d - c) * v, (c - a) * (1 - u) + (d - b) * u

    def settle(x, y, amount):
        for i, j, w in corners(x, y)[0]:
            h[i, j] += amount * w

    for x, y in drops:
        dx = dy = load = 0.0
        speed = water = 1.0
        for _ in range(p["lifetime"]):
            old, gx, gy = look(x, y)
            dx, dy = dx * p["inertia"] - gx * (1 - p["inertia"]), dy * p["inertia"] - gy * (1 - p["inertia"])
            size = math.hypot(dx, dy)
            if size:
                dx, dy = dx / size, dy / size
            nx, ny = x + dx, y + dy
            if not (0 <= nx < cols - 1 and 0 <= ny < rows - 1):
                settle(x, y, load)
                break
            rise = look(nx, ny)[0] - old
            room = max(-rise, p["least_capacity"]) * speed * water * p["capacity"]
            if load > room or rise > 0:
                amount = min(rise, load) if rise > 0 else (load - room) * p["deposit"]
                load -= amount
                settle(x, y, amount)
            else:
                amount = min((room - load) * p["erode"], -rise)
                for di, dj, w in sequential.erosion_brush(p["radius"]):
                    i, j = math.floor(y) + di, math.floor(x) + dj
                    if 0 <= i < rows and 0 <= j < cols:
                        h[i, j] -= min(h[i, j], amount * w)
                load += amount
            speed = math.sqrt(max(0.0, speed * speed + rise * p["gravity"]))
            water *= 1 - p["evaporate"]
            x, y = nx, ny
    return np.clip(h, 0, 1)


def fallen(spark, seed, n, width, height):
    """Where a first batch's droplets fall."""
    u = spark.range(n).select(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(0), F.lit(k), "id"), F.lit(1 << 40)).cast("double") for k in (0, 1)], "id").orderBy("id").collect()
    return [(r[0] / (1 << 40) * (width - 1), r[1] / (1 << 40) * (height - 1)) for r in u]


@pytest.mark.parametrize(("seed", "n"), [(1, 1), (2, 1), (3, 40)])
def test_droplets_against_brute_force(spark, seed, n, monkeypatch):
    rng = np.random.default_rng(seed)
    a = np.add.outer(np.linspace(0.8, 0.2, 24), np.linspace(0.1, 0, 20)) + rng.random((24, 20)) * 0.05
    wanted = brute_droplets(a, fallen(spark, seed, n, 20, 24), sequential.EROSION)
    got = {(r.r, r.c): r.raw for r in sequential.erode(pixels(spark, a), 20, 24, droplets=n, batches=1, seed=seed, tile=9).collect()}
    assert max(abs(got[r, c] - wanted[r, c]) for r in range(24) for c in range(20)) < 1e-9


def test_tiles_of_droplets_run_as_if_one_by_one(spark, monkeypatch):
    """Over several tiles: the same as one by one, colour by colour and tile by tile."""
    rng = np.random.default_rng(4)
    options = {"lifetime": 6, "radius": 2}
    a = rng.random((50, 45)) * 0.3 + 0.4
    drops = fallen(spark, 5, 300, 45, 50)
    tile = 20  # twice the margin
    order = sorted(range(300), key=lambda k: ((drops[k][1] // tile) % 2, (drops[k][0] // tile) % 2, k))
    wanted = brute_droplets(a, [drops[k] for k in order], sequential.EROSION | options)
    got = {(r.r, r.c): r.raw for r in sequential.erode(pixels(spark, a), 45, 50, droplets=300, batches=1, seed=5, tile=1, **options).collect()}
    assert max(abs(got[r, c] - wanted[r, c]) for r in range(50) for c in range(45)) < 1e-9


def test_all_droplets_fall(spark, monkeypatch):
    asked = []
    real = type(spark).range
    monkeypatch.setattr(type(spark), "range", lambda self, n, *a: (asked.append(n), real(self, n, *a))[1])
    px = pixels(spark, np.random.default_rng(1).random((6, 6)))
    for droplets in (7, 3):
        asked.clear()
        done = []
        assert sequential.erode(px, 6, 6, droplets=droplets, batches=5, progress=done.append).count() == 36 and sum(asked) == droplets
        assert done == [20, 40, 60, 80, 100]


def test_erosion_query_runs_the_whole_job(spark, monkeypatch):
    import __spark_entry__ as entry
    from tests.conftest import SMALL

    given = {}
    monkeypatch.setattr(sequential, "erode", lambda px, *size, **options: given.update(options) or px)
    entry.queries()["E3_erosion"](spark, SMALL)
    assert given.get("droplets", 50_000) == 50_000 and given.get("batches", 5) == 5


def test_particles(spark):
    t = terrain(spark, PEAK)
    p = points.at_rest(points.all_points(t))
    still = points.spring_step(p, noise=0)
    assert still.where("abs(x - hx) + abs(y - hy) + abs(z - hz) > 0").count() == 0
    fallen = points.animate(p, 300, lambda q, k: points.gravity_step(q, t.meta.min_z))
    assert fallen.where(F.abs(F.col("y") - t.meta.min_z) > 1e-9).count() == 0
    once = {(r.r, r.c): (r.x, r.y, r.z) for r in points.spring_step(p, 3).collect()}
    assert once == {(r.r, r.c): (r.x, r.y, r.z) for r in points.spring_step(p.repartition(7), 3).collect()}


def test_extremes_take_the_first_of_equals(spark):
    t = terrain(spark, [[0, 1, 1, 0], [0.5, 0.5, 0.5, 0.5]])
    got = sorted((r.kind, r.r, r.c) for r in points.extremes(t, step=1).collect())
    assert got == [("peak", 0, 1), ("peak", 1, 0), ("valley", 0, 0)]


def test_near_hides_far(spark):
    camera = view.Camera(tilt=89, zoom=4, width=64, height=48)
    wall = spark.createDataFrame([((-30.0, -30.0, 20.0), (30.0, -30.0, 20.0), (0.0, 60.0, 20.0))], "a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>, c struct<x:double,y:double,z:double>")
    depth = view.depth_buffer(view.project_triangles(wall, camera), camera)
    lines = spark.createDataFrame([("front", -10.0, 0.0, 40.0, 10.0, 0.0, 40.0), ("behind", -4.0, 0.0, -40.0, 4.0, 0.0, -40.0), ("across", -60.0, 0.0, -10.0, 60.0, 0.0, -10.0)], "layer string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    seen = {}
    for r in view.visible_runs(lines, camera, depth, ghosts=True).collect():
        seen.setdefault(r.layer, []).append(r.visible)
    assert seen["front"] == [True] and seen["behind"] == [False] and sorted(seen["across"]) == [False, True, True]
    assert view.visible_runs(lines, camera, None).count() == 3


def test_scalars():
    assert [grid.auto_resolution(w, 100) for w in (500, 1024, 1025, 50_000)] == [1, 1, 2, 20]
    assert grid.safe_resolution(1, 2000, 10) == 2
    assert grid.auto_zoom(500, 100) == 1 and grid.auto_zoom(1, 1) == 4
    assert grid.suggested_scale(1000, 10) == 1 and grid.suggested_scale(1e9, 1) == 50 and grid.suggested_scale(5, None) is None
    assert grid.suggested_scale(3000, 1 / 3600) == pytest.approx(0.97)
    assert grid.metres_to_percent(grid.percent_to_metres(30, 5, 25), 5, 25) == pytest.approx(30)
