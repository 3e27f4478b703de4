"""Polylines against chaining one crossing after the other; tiles, rings, empty rasters."""

import numpy as np
import pytest

from orograph.operators import grid, lines, modes


def terrain(spark, rows, cols, seed, steps=None, holes=0.05):
    """A raster of random hills; ``steps``: of random heights in so many steps, so that
    levels pass through places of the grid."""
    rng = np.random.default_rng(seed)
    h = rng.random((rows, cols)) if steps else np.cumsum(np.cumsum(rng.normal(size=(rows, cols)), 0), 1)
    h = (h - h.min()) / (h.max() - h.min())
    if steps:
        h = np.round(h * steps) / steps
    return grid.build_terrain(spark.createDataFrame([(r, c, float(h[r, c]), bool(rng.random() >= holes)) for r in range(rows) for c in range(cols)], "r int, c int, raw double, valid boolean"), cols, rows)


def chained(crossings, cols):
    """(level, crossing, ends in the line's direction, line, at, closed) of each crossing."""
    rows = [(r.i, (r.r * cols + r.c) * 2 + r.part, (r.c0, r.r0), (r.c1, r.r1)) for r in crossings]
    out = []
    for level in {r[0] for r in rows}:
        segs = sorted(r[1:] for r in rows if r[0] == level)
        at, other, seen = {}, {}, set()
        for k, (_, *ends) in enumerate(segs):
            for e, p in enumerate(ends):
                at.setdefault(p, []).append((k, e))
        for meeting in at.values():
            for u, v in zip(meeting[::2], meeting[1::2]):
                other[u], other[v] = v, u

        def walk(k, e):
            path = [(k, e)]
            while path[-1] in other:
                k2, e2 = other[path[-1]]
                if (k2, 1 - e2) == path[0]:
                    return path, True
                path.append((k2, 1 - e2))
            return path, False

        for k in range(len(segs)):
            if k in seen:
                continue
            path, ring = walk(k, 1)
            if not ring:
                path = [(a, 1 - e) for a, e in reversed(walk(k, 0)[0])][:-1] + path
                if path[0][0] > path[-1][0]:
                    path = [(a, 1 - e) for a, e in reversed(path)]
            seen |= {a for a, _ in path}
            for n, (a, e) in enumerate(path):
                out.append((level, segs[a][0], *segs[a][2 - e], *segs[a][1 + e], segs[path[0][0]][0], n, ring))
    return sorted(out)


@pytest.mark.parametrize("rows, cols, steps, tile", [(9, 11, None, 3), (30, 25, None, 7), (20, 20, 8, 256), (20, 20, 8, 5), (33, 17, 4, 1), (3, 40, 2, 2)])
def test_polylines_against_chaining_in_order(spark, rows, cols, steps, tile):
    t = terrain(spark, rows, cols, rows, steps)
    crossings = modes.contour_crossings(t, interval=100 / (2 * steps) if steps else 7)
    got = lines.polylines(crossings, rows, cols, tile)
    assert got.columns == [*crossings.columns, "line", "at", "closed"]
    found = sorted((r.i, (r.r * cols + r.c) * 2 + r.part, r.c0, r.r0, r.c1, r.r1, r.line, r["at"], r.closed) for r in got.collect())
    assert found == chained(crossings.collect(), cols) and found


def test_a_long_ring_over_many_tiles(spark):
    """A cone: one ring for each level, through dozens of tiles; its ends join in order."""
    n = 61
    rows = [(r, c, max(0.0, 1 - ((r - 30) ** 2 + (c - 30) ** 2) ** 0.5 / 29.7), True) for r in range(n) for c in range(n)]
    t = grid.build_terrain(spark.createDataFrame(rows, "r int, c int, raw double, valid boolean"), n, n)
    got = sorted(lines.polylines(modes.contour_crossings(t, interval=20), n, n, 4).collect(), key=lambda r: (r.i, r.line, r["at"]))
    rings = {}
    for r in got:
        rings.setdefault((r.i, r.line), []).append(r)
    assert all(r.closed for r in got) and len({k[0] for k in rings}) == len(rings) and max(map(len, rings.values())) > 150
    for ring in rings.values():
        assert [r["at"] for r in ring] == list(range(len(ring)))
        assert all((a.c1, a.r1) == (b.c0, b.r0) for a, b in zip(ring, ring[1:] + ring[:1]))


def test_no_crossings(spark):
    flat = grid.build_terrain(spark.createDataFrame([(r, c, 0.5, True) for r in range(4) for c in range(4)], "r int, c int, raw double, valid boolean"), 4, 4)
    assert lines.polylines(modes.contour_crossings(flat, interval=30), 4, 4).count() == 0
