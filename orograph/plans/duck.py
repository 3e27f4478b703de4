"""DuckDB SQL of the base relations that the terrain oracles share.

``px`` holds the pixels of a raster, ``cells`` and ``m`` its terrain. Neighbours are found
by joins on places here, while the Spark side uses windows.
"""

from __future__ import annotations

_VALUES = {
    "E": "SELECT CAST(vec_id AS INTEGER) AS r, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "N": """SELECT CAST(user_id AS INTEGER) AS r, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS c,
      CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL""",
    "P": """SELECT CAST(l_quantity - 1 AS INTEGER) AS r, CAST(mon - min(mon) OVER () AS INTEGER) AS c, v FROM (
      SELECT l_quantity, year(l_shipdate) * 12 + month(l_shipdate) AS mon, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS v
      FROM lineitem GROUP BY ALL)""",
}


def pixels(raster: str) -> str:
    return f"""vals AS ({_VALUES[raster]}),
lim AS (SELECT min(v) AS lo, max(v) AS hi, max(r) + 1 AS height, max(c) + 1 AS width FROM vals),
q AS (SELECT r, c, CAST(CAST(floor((v - lo) / (hi - lo) * 1e6 + 0.5) AS BIGINT) AS DOUBLE) / 1e6 AS raw FROM vals, lim),
px AS (SELECT g.r, g.c, coalesce(q.raw, CAST(0 AS DOUBLE)) AS raw, q.raw IS NOT NULL AS valid
  FROM (SELECT CAST(i // width AS INTEGER) AS r, CAST(i % width AS INTEGER) AS c FROM lim, range(CAST(width * height AS BIGINT)) t(i)) g LEFT JOIN q USING (r, c))"""


def blurred(source: str, value: str, k: int, out: str) -> str:
    """``source`` with the mean of ``value`` over a clipped square, in single precision."""
    return f"""{out} AS (SELECT a.r, a.c, CAST(CAST(sum(b.{value}) / count(*) AS FLOAT) AS DOUBLE) AS b
  FROM {source} a JOIN {source} b ON b.r BETWEEN a.r - {k} AND a.r + {k} AND b.c BETWEEN a.c - {k} AND a.c + {k} GROUP BY a.r, a.c)"""


def terrain(raster: str, scl: int = 1, off_x: int = 0, off_y: int = 0, black: float = 0, white: float = 255, scale: float = 1.0) -> str:
    """CTEs up to cells(r, c, h, valid, slope) and m(rows, cols, min_z, ...), to follow WITH."""
    bp, wp = black / 255, white / 255
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    return f"""{pixels(raster)},
dims AS (SELECT CAST((height - {off_y}) // {scl} AS INTEGER) AS rows, CAST((width - {off_x}) // {scl} AS INTEGER) AS cols FROM lim),
sampled AS (SELECT CAST((r - {off_y}) // {scl} AS INTEGER) AS r, CAST((c - {off_x}) // {scl} AS INTEGER) AS c, valid,
    CASE WHEN valid THEN (greatest({d(bp)}, least({d(wp)}, raw)) - {d(bp)}) / {d(max(1e-6, wp - bp))} END AS norm
  FROM px, dims WHERE r >= {off_y} AND c >= {off_x} AND (r - {off_y}) % {scl} = 0 AND (c - {off_x}) % {scl} = 0 AND (r - {off_y}) // {scl} < rows AND (c - {off_x}) // {scl} < cols),
base AS (SELECT r, c, valid, norm, CAST(CAST(coalesce(norm, 0) AS FLOAT) AS DOUBLE) AS h FROM sampled),
sloped AS (SELECT a.r, a.c, a.valid, a.norm, a.h, CASE WHEN a.valid THEN sqrt((coalesce(e.h, a.h) - a.h) * (coalesce(e.h, a.h) - a.h) + (coalesce(s.h, a.h) - a.h) * (coalesce(s.h, a.h) - a.h)) ELSE CAST(0 AS DOUBLE) END AS sl
  FROM base a LEFT JOIN base e ON e.r = a.r AND e.c = a.c + 1 AND e.valid LEFT JOIN base s ON s.r = a.r + 1 AND s.c = a.c AND s.valid),
cells AS (SELECT r, c, valid, h, CAST(CAST(sl AS FLOAT) AS DOUBLE) AS slope FROM sloped),
m AS (SELECT any_value(rows) AS rows, any_value(cols) AS cols, {scl} AS scl, {d(float(scale))} AS scale,
    (least(1, coalesce(min(norm) FILTER (valid), 1)) - 0.5) * 100 * {d(float(scale))} AS min_z, (greatest(0, coalesce(max(norm) FILTER (valid), 0)) - 0.5) * 100 * {d(float(scale))} AS max_z,
    CAST(coalesce((min(c) FILTER (valid) + max(c) FILTER (valid)) * {scl}, (any_value(cols) - 1) * {scl}) AS DOUBLE) / 2 AS half_w,
    CAST(coalesce((min(r) FILTER (valid) + max(r) FILTER (valid)) * {scl}, (any_value(rows) - 1) * {scl}) AS DOUBLE) / 2 AS half_h,
    coalesce(max(sl) FILTER (valid), 0) AS max_slope FROM sloped, dims)"""


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def elev(h: str) -> str:
    return f"(({h} - 0.5) * 100 * m.scale)"


def norm(e: str) -> str:
    return f"(CASE WHEN m.max_z > m.min_z THEN ({e} - m.min_z) / (m.max_z - m.min_z) ELSE CAST(0 AS DOUBLE) END)"


def in_band(e: str, low: float = 0, high: float = 100) -> str:
    return f"({norm(e)} BETWEEN CAST({low / 100!r} AS DOUBLE) AND CAST({high / 100!r} AS DOUBLE))"


def wx(c: str) -> str:
    return f"({c} * m.scl - m.half_w)"


def wz(r: str) -> str:
    return f"({r} * m.scl - m.half_h)"


def ends(*six: str) -> str:
    return ", ".join(f"{r6(e)} AS {n}" for e, n in zip(six, ("x0", "y0", "z0", "x1", "y1", "z1")))


def hash01(a: str, b: str) -> str:
    """The portable hash; a and b are whole numbers."""
    n = f"((CAST({a} AS BIGINT) * 1031 + CAST({b} AS BIGINT) * 2999) & 4294967295)"
    n = f"xor({n}, {n} >> 13)"
    n = f"(CAST(CAST(CASE WHEN {n} >= 2147483648 THEN {n} - 4294967296 ELSE {n} END AS DOUBLE) * 73244475e0 AS BIGINT) & 4294967295)"
    return f"(CAST(xor({n}, {n} >> 16) & 65535 AS DOUBLE) / 65535)"


def uniform(r: str, c: str, seed: int) -> str:
    return hash01(f"({c} * 7919 + {seed * 104729})", r)


def noise(x: str, y: str) -> str:
    ix, iy = f"CAST(floor({x}) AS BIGINT)", f"CAST(floor({y}) AS BIGINT)"
    fade = lambda f: f"(({f}) * ({f}) * ({f}) * (({f}) * (({f}) * 6 - 15) + 10))"
    ux, uy = fade(f"{x} - floor({x})"), fade(f"{y} - floor({y})")
    return f"({hash01(ix, iy)} * (1 - {ux}) * (1 - {uy}) + {hash01(ix + ' + 1', iy)} * {ux} * (1 - {uy}) + {hash01(ix, iy + ' + 1')} * (1 - {ux}) * {uy} + {hash01(ix + ' + 1', iy + ' + 1')} * {ux} * {uy})"


def gradient(stops, t: str) -> list[str]:
    """Red, green and blue of a gradient at t."""
    channel = lambda color, k: int(color[1 + 2 * k : 3 + 2 * k], 16) / 255
    d = lambda x: f"CAST({float(x)!r} AS DOUBLE)"
    out = []
    for k in range(3):
        cases = [f"WHEN {t} <= {d(stops[0][0])} THEN {d(channel(stops[0][1], k))}", f"WHEN {t} >= {d(stops[-1][0])} THEN {d(channel(stops[-1][1], k))}"]
        for (p0, a), (p1, b) in zip(stops, stops[1:]):
            va, vb = channel(a, k), channel(b, k)
            cases.append(f"WHEN {t} <= {d(p1)} THEN {d(va)} + {d(vb - va)} * (({t} - {d(p0)}) / {d(float(p1) - float(p0))})")
        out.append(f"CASE {' '.join(cases)} END")
    return out
