"""Operators that are sequential by nature, re-aimed so that no task gets a whole raster:
stream order by rounds of joins, closed contours by pairing border ends (``lines`` chains
them), and flow lines
and erosion over tiles with a margin as wide as a path is long.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.operators.grid import Meta, Terrain
from orograph.shared import cut


#: Orders up to which functions of an order are tabled: a cell of order k has 2^(k - 1)
#: sources above it.
ORDERS = 48


def stream_order(edges: DataFrame) -> DataFrame:
    """Strahler order (r, c, ord) of the cells of a drainage (r, c, dr, dc): 1 at a
    source; else the highest order that flows in, one more if it does so twice.

    Cells wait for their inflows. In each round those with all inflows known are settled.
    A cell with one unknown inflow is a function of that one's order, kept as a table of
    ORDERS values with a pointer to it; pointers jump over others of the kind, whose
    functions they take in, so a path of any length is settled in rounds that go with its
    logarithm. Only cells that aren't settled go on."""
    place = lambda r, c: F.shiftleft(F.col(r).cast("long"), 32).bitwiseOR(F.col(c).cast("long"))
    cells = cut(edges.select(place("r", "c").alias("id"), place("dr", "dc").alias("out")))
    inflows = cells.groupBy("out").agg(F.count("*").cast("int").alias("wait"))
    begun = cells.join(inflows.withColumnRenamed("out", "id"), "id", "left")
    new = cut(begun.where("wait is null").select("id", "out", F.lit(1).alias("ord")))
    left = cut(begun.where("wait is not null").select("id", "out", F.lit(0).alias("top"), F.lit(0).alias("same"), "wait", F.lit(None).cast("long").alias("ptr"), F.lit(None).cast("array<int>").alias("f")))
    settled = [new]
    while not left.isEmpty():
        if new.isEmpty():
            raise ValueError("the drainage has a cycle")
        by_order = new.groupBy("out", "ord").agg(F.count("*").cast("int").alias("n")).groupBy("out").agg(F.max(F.struct("ord", "n")).alias("m"), F.sum("n").cast("int").alias("all"))
        come = by_order.select(F.col("out").alias("id"), F.col("m.ord").alias("o"), F.col("m.n").alias("n"), "all")
        met = left.join(come, "id", "left").select(
            "id", "out", F.greatest("top", F.coalesce("o", F.lit(0))).alias("top"),
            F.when(F.col("o") > F.col("top"), F.col("n")).when(F.col("o") == F.col("top"), F.col("same") + F.col("n")).otherwise(F.col("same")).alias("same"),
            (F.col("wait") - F.coalesce("all", F.lit(0))).alias("wait"), "ptr", "f",
        )
        own = F.col("top") + F.when(F.col("same") > 1, 1).otherwise(0)
        met = cut(met.withColumn("ord", F.when(F.col("wait") == 0, own)))
        # cells that now have one unknown inflow begin to point to it
        child = met.select(F.col("out").alias("id"), F.col("id").alias("child"))
        table = F.transform(F.sequence(F.lit(1), F.lit(ORDERS)), lambda x: F.when(x > F.col("top"), x).when(x == F.col("top"), x + 1).otherwise(own))
        single = met.where("wait = 1 and ptr is null").join(child, "id").select(*met.columns, F.col("child").alias("p"), table.alias("t"))
        rest = met.where("wait != 1 or ptr is not null").select(*met.columns, F.col("ptr").alias("p"), F.col("f").alias("t"))
        pointed = single.unionByName(rest).drop("ptr", "f").withColumnsRenamed({"p": "ptr", "t": "f"})
        known = new.select(F.col("id").alias("ptr"), F.col("ord").alias("k")).unionByName(met.where("ord is not null").select(F.col("id").alias("ptr"), F.col("ord").alias("k")))
        seen = cut(pointed.join(known, "ptr", "left").withColumn("ord", F.coalesce("ord", F.when(F.col("k").isNotNull(), F.element_at("f", F.col("k"))))).drop("k"))
        new = seen.where("ord is not null").select("id", "out", "ord")
        settled.append(new)
        further = seen.where("ord is null and ptr is not null").select(F.col("id").alias("ptr"), F.col("ptr").alias("p"), F.col("f").alias("g"))
        open_ = seen.where("ord is null").join(further, "ptr", "left")
        both = F.transform("g", lambda x: F.element_at("f", F.least(x, F.lit(ORDERS))))
        left = cut(open_.select("id", "out", "top", "same", "wait", F.coalesce("p", "ptr").alias("ptr"), F.when(F.col("p").isNotNull(), both).otherwise(F.col("f")).alias("f")))
    every = settled[0]
    for s in settled[1:]:
        every = every.unionByName(s)
    return every.select(F.shiftright("id", 32).cast("int").alias("r"), F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("c"), "ord")


def close_rings(crossings: DataFrame, rows: int, cols: int) -> DataFrame:
    """Contour crossings and, for each level, walks along the raster's border from one
    open end to the next, clockwise from the top left, in pairs. A level whose open ends
    on the border are fewer than two or of odd number gets none. Crossings that end at the
    same point go on in pairs, so open ends are points where an odd number of them end; a
    level has no more of them than the border has edges."""
    eps = 1e-9
    ends = crossings.select("i", "elev", F.explode(F.array(F.struct(F.col("c0").alias("c"), F.col("r0").alias("r")), F.struct(F.col("c1").alias("c"), F.col("r1").alias("r")))).alias("p"))
    w, h = float(cols - 1), float(rows - 1)
    c, r = F.col("p.c"), F.col("p.r")
    place = F.when(r <= eps, c / w).when(c >= w - eps, 1 + r / h).when(r >= h - eps, 2 + (1 - c / w)).otherwise(3 + (1 - r / h))
    border = (c <= eps) | (r <= eps) | (c >= w - eps) | (r >= h - eps)
    open_ = ends.groupBy("i", "elev", "p").agg(F.count("*").alias("n")).where((F.col("n") % 2 == 1) & border).withColumn("pos", place)
    level = Window.partitionBy("i").orderBy("pos", "p")
    ranked = open_.withColumns({"k": F.row_number().over(level), "all": F.count("*").over(Window.partitionBy("i")), "q": F.lead(F.struct("p", "pos")).over(level)})
    pairs = ranked.where((F.col("all") % 2 == 0) & (F.col("k") % 2 == 1))
    at = lambda x, y: F.struct(F.lit(x).alias("c"), F.lit(y).alias("r"))
    corners = F.array(*[F.struct(F.lit(float(k)).alias("pos"), at(*p).alias("p")) for k, p in enumerate(((0.0, 0.0), (w, 0.0), (w, h), (0.0, h)))])
    between = F.filter(corners, lambda x: (x["pos"] > F.col("pos") + eps) & (x["pos"] < F.col("q.pos") - eps))
    walk = F.concat(F.array("p"), F.transform(between, lambda x: x["p"]), F.array("q.p"))
    steps = pairs.withColumn("walk", walk).select("i", "elev", F.posexplode(F.arrays_zip(F.slice("walk", F.lit(1), F.size("walk") - 1).alias("a"), F.slice("walk", F.lit(2), F.size("walk") - 1).alias("b"))).alias("part", "s"))
    walked = steps.select(F.lit(-1).alias("r"), F.lit(-1).alias("c"), "i", "elev", "part", F.col("s.a.c").alias("c0"), F.col("s.a.r").alias("r0"), F.col("s.b.c").alias("c1"), F.col("s.b.r").alias("r1"))
    return crossings.unionByName(walked)


def tiled(cells: DataFrame, size: int, margin: int, *columns: str) -> DataFrame:
    """Cells with the tile (tr, tc) they belong to, and again for each further tile whose
    margin they lie in."""
    reach = lambda x: F.sequence(F.floor((F.col(x) - margin) / size).cast("int"), F.floor((F.col(x) + margin) / size).cast("int"))
    return cells.select("r", "c", *columns, F.explode(reach("r")).alias("tr")).withColumn("tc", F.explode(reach("c"))).where("tr >= 0 and tc >= 0")


def _patch(table: pa.Table, *columns: str):
    """A tile with its margin as dense arrays, with the row and column of their corner."""
    r, c = np.asarray(table.column("r")), np.asarray(table.column("c"))
    r0, c0 = int(r.min()), int(c.min())
    out = []
    for name in columns:
        v = np.asarray(table.column(name))
        a = np.zeros((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), v.dtype)
        a[r - r0, c - c0] = v
        out.append(a)
    return r0, c0, out


def bilinear(grid: np.ndarray, fr: np.ndarray, fc: np.ndarray) -> np.ndarray:
    """Heights between cells; places outside are drawn to the nearest cell's square."""
    n, m = grid.shape
    r, c = np.clip(np.floor(fr), 0, n - 1).astype(int), np.clip(np.floor(fc), 0, m - 1).astype(int)
    r1, c1, dr, dc = np.minimum(n - 1, r + 1), np.minimum(m - 1, c + 1), fr - r, fc - c
    return grid[r, c] * (1 - dr) * (1 - dc) + grid[r, c1] * (1 - dr) * dc + grid[r1, c] * dr * (1 - dc) + grid[r1, c1] * dr * dc


PATHS = "seed long, step int, cell long, to long, shown boolean, r0 double, c0 double, r1 double, c1 double, h0 double, h1 double, gx double, gz double"


def _trace(meta: Meta, tile: int, stride: int, step: float, longest: int, band, table: pa.Table) -> pa.Table:
    """Steepest descent from a tile's seeds, all at once: unit steps against the gradient.
    A row for each cell that a line reaches, with the step from there, if it takes one."""
    r_at, c_at, (h, ok) = _patch(table, "h", "valid")
    tr, tc = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
    first = lambda t: -(-t * tile // stride) * stride
    sr, sc = np.meshgrid(np.arange(first(tr), min((tr + 1) * tile, meta.rows), stride), np.arange(first(tc), min((tc + 1) * tile, meta.cols), stride), indexing="ij")
    sr, sc = sr.ravel(), sc.ravel()
    seed = sr.astype(np.int64) * meta.cols + sc
    near = lambda x: np.floor(x + 0.5).astype(np.int64)
    data = lambda r, c: ok[np.clip(r - r_at, 0, ok.shape[0] - 1), np.clip(c - c_at, 0, ok.shape[1] - 1)] & (r >= 0) & (c >= 0) & (r < meta.rows) & (c < meta.cols)
    height = lambda r, c: bilinear(h, r - r_at, c - c_at)
    span = meta.max_z - meta.min_z

    def in_range(v):
        share = ((v - 0.5) * 100 * meta.elev_scale - meta.min_z) / span if span > 0 else np.zeros(len(v))
        return (share >= band[0] / 100) & (share <= band[1] / 100)

    alive = np.flatnonzero(data(sr, sc))
    fr, fc = sr.astype(float), sc.astype(float)
    been = np.full((len(seed), longest + 1), -1, np.int64)
    rows = []
    eps = 0.5
    for k in range(longest):
        r, c = fr[alive], fc[alive]
        inside = (r >= eps) & (r <= meta.rows - 1 - eps) & (c >= eps) & (c <= meta.cols - 1 - eps)
        alive, r, c = alive[inside], r[inside], c[inside]
        on = data(near(r), near(c))
        alive, r, c = alive[on], r[on], c[on]
        if not len(alive):
            break
        cell = near(r) * meta.cols + near(c)
        been[alive, k] = cell
        gx, gz = height(r, c + eps) - height(r, c - eps), height(r + eps, c) - height(r - eps, c)
        size = np.sqrt(gx * gx + gz * gz)
        some = np.where(size > 0, size, 1.0)
        nr, nc = r - gz / some * step, c - gx / some * step
        to = near(nr) * meta.cols + near(nc)
        h0, h1 = height(r, c), height(nr, nc)
        shown = in_range(h0), in_range(h1)
        go = (size >= 0.0005) & data(near(nr), near(nc)) & ~(been[alive, : k + 1] == to[:, None]).any(1) & (shown[0] | shown[1])
        rows.append((seed[alive], np.full(len(alive), k), cell, np.where(go, to, -1), shown[0] & shown[1] & go, r, c, nr, nc, h0, h1, gx, gz))
        alive = alive[go]
        fr[alive], fc[alive] = nr[go], nc[go]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), *[pa.float64()] * 8]
    cols = [np.concatenate(x) for x in zip(*rows)] if rows else [np.zeros(0)] * 13
    return pa.table([pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(cols, kinds)], [n.split()[0] for n in PATHS.split(", ")])


def _ends(paths: DataFrame) -> DataFrame:
    """(seed, end): the first step that a line can't take, since an earlier seed's line
    has reached the cell; -1 if that is the seed itself.

    Paths don't depend on each other, only where they end does. Lines are held between two
    bounds: cells that earlier lines reach for sure end a line at the latest, and cells
    that they may reach end it at the earliest. Both are found anew from each other's
    bounds until they agree; each round settles at least the first line that isn't."""
    never = 1 << 30
    reached = paths.select("seed", "step", "cell")
    asked = paths.where("to >= 0").select("seed", "step", F.col("to").alias("cell")).unionByName(paths.where("step = 0").select("seed", F.lit(-1).alias("step"), "cell"))
    least = paths.select("seed").distinct().select("seed", F.lit(-1).alias("early"), F.lit(never).alias("late"))
    while True:
        # a line reaches what lies up to its end
        held = reached.join(least, "seed").groupBy("cell").agg(F.min(F.when(F.col("step") <= F.col("early"), F.col("seed"))).alias("sure"), F.min(F.when(F.col("step") <= F.col("late"), F.col("seed"))).alias("maybe"))
        met = asked.join(held, "cell").groupBy("seed").agg(
            F.min(F.when(F.col("maybe") < F.col("seed"), F.col("step"))).alias("early"), F.min(F.when(F.col("sure") < F.col("seed"), F.col("step"))).alias("late")
        )
        least = cut(met.select("seed", F.coalesce("early", F.lit(never)).alias("early"), F.coalesce("late", F.lit(never)).alias("late")))
        if least.where("early != late").isEmpty():
            return least.select("seed", F.col("late").alias("end"))


def flow_lines(t: Terrain, *, spacing: float = 10, step: float = 1, longest: int = 100, band=(0, 100), tile: int = 256) -> DataFrame:
    """M7: lines of steepest descent from each step-th cell, as if drawn one after the
    other: a line ends before a cell that an earlier one has reached, and a seed in such
    a cell draws none. A line that leaves the elevation band ends."""
    from orograph.operators.grid import world_x, world_z
    from orograph.operators.modes import _segment, step_of

    m, stride = t.meta, step_of(t, spacing)
    margin = math.ceil(longest * step) + 2
    patches = tiled(t.cells.where((F.col("r") < m.rows) & (F.col("c") < m.cols)), tile, margin, "h", "valid").where((F.col("tr") <= (m.rows - 1) // tile) & (F.col("tc") <= (m.cols - 1) // tile))
    paths = cut(patches.groupBy("tr", "tc").applyInArrow(lambda table: _trace(m, tile, stride, step, longest, band, table), PATHS))
    kept = paths.where("shown").join(_ends(paths), "seed").where(F.col("step") < F.col("end"))
    z = lambda h: (F.col(h) - 0.5) * 100 * m.elev_scale
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gz") * F.col("gz"))
    steep = F.least(F.lit(1.0), size / (m.max_slope or 0.02))
    ends = [world_x(m, "c0"), z("h0"), world_z(m, "r0"), world_x(m, "c1"), z("h1"), world_z(m, "r1")]
    return kept.select(*_segment(t, ends, steep, steep, F.atan2("gz", "gx"), F.col("seed"), F.col("step")))


def erosion_brush(radius: int) -> list[tuple[int, int, float]]:
    """(row, column, weight) of an erosion's brush: nearer places count more, all to one."""
    places = [(dy, dx, math.sqrt(dx * dx + dy * dy)) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
    weights = [(dy, dx, 1 - d / radius) for dy, dx, d in places if d <= radius]
    total = sum(w for *_, w in weights)
    return [(dy, dx, w / total) for dy, dx, w in weights]


def brushed(pixels: DataFrame, radius: int) -> DataFrame:
    """(r, c, amount): the sum of an erosion brush over the heights of each place; what of
    it lies outside the raster adds nothing."""
    brush = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, dx, w in erosion_brush(radius)])
    each = pixels.select("r", "c", "raw", F.explode(brush).alias("b"))
    share = each.select((F.col("r") - F.col("b.dy")).alias("r"), (F.col("c") - F.col("b.dx")).alias("c"), (F.col("raw") * F.col("b.w")).alias("part"))
    return share.groupBy("r", "c").agg(F.sum("part").alias("amount")).join(pixels.select("r", "c"), ["r", "c"])


# Parameters of the erosion and their defaults.
EROSION = {"radius": 3, "inertia": 0.05, "capacity": 4.0, "least_capacity": 0.01, "erode": 0.3, "deposit": 0.3, "evaporate": 0.01, "gravity": 4.0, "lifetime": 30}


def _rain(width: int, height: int, tile: int, p: dict, table: pa.Table) -> pa.Table:
    """What the droplets of a tile change: one after the other, in the order of their
    numbers, each over the map that those before it left."""
    drops = table.filter(pa.compute.field("drop") >= 0).sort_by("drop")
    r_at, c_at, (h,) = _patch(table.filter(pa.compute.field("drop") < 0), "raw")
    rows, cols = h.shape
    flat = h.ravel().tolist()
    brush = [(di, dj, di * cols + dj, w) for di, dj, w in erosion_brush(p["radius"])]
    inertia, least, capacity, erode_, settle, gravity = (p[k] for k in ("inertia", "least_capacity", "capacity", "erode", "deposit", "gravity"))
    rest, radius, east, south = 1 - p["evaporate"], p["radius"], width - 1 - c_at, height - 1 - r_at
    turn = 1 - inertia

    def drop_load(x, y, amount):
        j, i = int(x), int(y)
        u, v, at = x - j, y - i, i * cols + j
        flat[at] += amount * (1 - u) * (1 - v)
        flat[at + 1] += amount * u * (1 - v)
        flat[at + cols] += amount * (1 - u) * v
        flat[at + cols + 1] += amount * u * v

    for x, y in zip((np.asarray(drops.column("x")) - c_at).tolist(), (np.asarray(drops.column("y")) - r_at).tolist()):
        dx = dy = load = 0.0
        speed = water = 1.0
        for _ in range(p["lifetime"]):
            j, i = int(x), int(y)
            u, v, at = x - j, y - i, i * cols + j
            a, b, c, d = flat[at], flat[at + 1], flat[at + cols], flat[at + cols + 1]
            old = a * (1 - u) * (1 - v) + b * u * (1 - v) + c * (1 - u) * v + d * u * v
            dx = dx * inertia - ((b - a) * (1 - v) + (d - c) * v) * turn
            dy = dy * inertia - ((c - a) * (1 - u) + (d - b) * u) * turn
            size = math.sqrt(dx * dx + dy * dy)
            if size > 0:
                dx, dy = dx / size, dy / size
            nx, ny = x + dx, y + dy
            if nx + c_at < 0 or nx >= east or ny + r_at < 0 or ny >= south:
                drop_load(x, y, load)
                break
            k, m = int(nx), int(ny)
            u, v, to = nx - k, ny - m, m * cols + k
            rise = flat[to] * (1 - u) * (1 - v) + flat[to + 1] * u * (1 - v) + flat[to + cols] * (1 - u) * v + flat[to + cols + 1] * u * v - old
            room = max(-rise, least) * speed * water * capacity
            if load > room or rise > 0:
                amount = min(rise, load) if rise > 0 else (load - room) * settle
                drop_load(x, y, amount)
                load -= amount
            else:
                taken = min((room - load) * erode_, -rise)
                if radius <= i < rows - radius and radius <= j < cols - radius:
                    for _, _, step, w in brush:
                        flat[at + step] = max(flat[at + step] - taken * w, 0.0)
                else:  # the patch ends where the raster does
                    for di, dj, step, w in brush:
                        if 0 <= i + di < rows and 0 <= j + dj < cols:
                            flat[at + step] = max(flat[at + step] - taken * w, 0.0)
                load += taken
            speed = math.sqrt(max(0.0, speed * speed + rise * gravity))
            water *= rest
            x, y = nx, ny
    after = np.array(flat).reshape(h.shape)
    i, j = np.nonzero(after != h)
    return pa.table([pa.array(i + r_at, pa.int32()), pa.array(j + c_at, pa.int32()), pa.array(after[i, j])], ["r", "c", "new"])


def erode(pixels: DataFrame, width: int, height: int, *, droplets: int = 50_000, batches: int = 5, seed: int = 1, tile: int = 256, progress=None, **options) -> DataFrame:
    """E: hydraulic erosion of (r, c, raw, valid) by droplets that each change the map under
    the next. They are dealt to tiles by where they fall. Tiles of one colour of a
    chessboard of four lie farther apart than droplets run, so they are worked on side by
    side, and one colour after the other. The result is exactly that of all droplets one by
    one, by batch, colour and number. ``batches`` spread the colours over the rain.
    Tiles are at least as wide as that needs. No cell falls below 0, and all end within
    0..1. Where droplets fall depends on the seed alone. A last row or column can't be
    entered, as in the original. Only cells that change are written, and only tiles that
    rain falls on are worked on. ``progress`` is told the hundredths done after each batch;
    the raster given stays as it was."""
    p = EROSION | options
    margin = p["lifetime"] + p["radius"] + 2
    tile = max(tile, 2 * margin)
    spark, base = pixels.sparkSession, cut(pixels.select("r", "c", F.col("raw").cast("double").alias("raw"), "valid"))
    edits: list[DataFrame] = []  # (r, c, new, n): cells that colour n changed, which alone are written

    def latest(cells: DataFrame) -> DataFrame:
        """``cells`` (with r, c, raw) as the edits so far leave them."""
        if not edits:
            return cells
        new = reduce(DataFrame.unionByName, edits).groupBy("r", "c").agg(F.max_by("new", "n").alias("new"))
        return cells.join(new, ["r", "c"], "left").withColumn("raw", F.coalesce("new", "raw")).drop("new")

    tasks = max(1, min(-(-height // tile) * -(-width // tile), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    colours = [(i, j) for i in range(min(2, -(-height // tile))) for j in range(min(2, -(-width // tile)))]
    drawn = lambda b, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(b), F.lit(k), "id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    for b in range(batches):
        drops = spark.range(droplets // batches + (b < droplets % batches)).select((drawn(b, 0) * (width - 1)).alias("x"), (drawn(b, 1) * (height - 1)).alias("y"), "id")
        fallen = drops.select(
            F.floor("y").cast("int").alias("r"), F.floor("x").cast("int").alias("c"), F.lit(0.0).alias("raw"), F.floor(F.col("y") / tile).cast("int").alias("tr"), F.floor(F.col("x") / tile).cast("int").alias("tc"),
            F.col("id").alias("drop"), "x", "y",
        )
        for n, (i, j) in enumerate(colours):
            colour = (F.col("tr") % 2 == i) & (F.col("tc") % 2 == j)
            here = fallen.where(colour)
            reached = tiled(base, tile, margin, "raw").where(colour).join(here.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
            patch = latest(reached).select("r", "c", "raw", "tr", "tc", F.lit(-1).cast("long").alias("drop"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
            # a tile is much work on few bytes, so small shuffles aren't to be put together
            rained = here.unionByName(patch.select(*fallen.columns)).repartition(tasks, "tr", "tc")
            changed = rained.groupBy("tr", "tc").applyInArrow(lambda table: _rain(width, height, tile, p, table), "r int, c int, new double")
            edits.append(cut(changed.withColumn("n", F.lit(b * len(colours) + n))))
        if len(edits) > 4:  # one row for each changed cell again
            edits = [cut(reduce(DataFrame.unionByName, edits).groupBy("r", "c").agg(F.max_by("new", "n").alias("new"), F.max("n").alias("n")))]
        if progress:
            progress(100 * (b + 1) // batches)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw")))
    return latest(base).select("r", "c", clamped.alias("raw"), "valid")
