"""Polylines: contour crossings chained where they end at the same point.

At each point the crossings of a level that end there go on in pairs, in the order of
(square, part, end); an odd one out is an open end. That cuts the crossings into open lines
and rings, each crossing in one of them.

Tiles of TILE x TILE squares chain their own crossings, each tile and level by itself, so
no group grows with the raster. What crosses tiles is chained between their pieces by list
ranking: each end of a piece points to the piece that follows, and in each round pointers
jump over as much as they passed so far. Rounds go with the logarithm of the pieces in a
line; a ring is known by its least piece, which its pointers meet after a whole turn.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.shared import cut

TILE = 256
_PIECES = "i int, id long, piece long, pos long, size long, closed boolean, flip boolean"


def _jumped(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pointers (those to themselves end a list): where each list ends, and the steps
    there. For places in a cycle these mean nothing."""
    to, hops = step.copy(), (step != np.arange(len(step))).astype(np.int64)
    for _ in range(len(step).bit_length()):
        hops += hops[to]
        to = to[to]
    return to, hops


def _chained(tile: int, table: pa.Table) -> pa.Table:
    """The pieces of a tile and level. Places are ends of crossings, 2k + e for end e of
    crossing k; a place stands for leaving the crossing through that end."""
    table = table.sort_by("id")
    i, ident = table.column("i")[0].as_py(), np.asarray(table.column("id"))
    x, y = (np.stack([np.asarray(table.column(f"{a}{e}")) for e in (0, 1)], 1).ravel() for a in "cr")
    n = len(x)
    # crossings meet at equal points; those on a tile's edge wait for the other tiles
    order = np.lexsort((np.arange(n), y, x))
    sx, sy = x[order], y[order]
    new = np.concatenate(([True], (sx[1:] != sx[:-1]) | (sy[1:] != sy[:-1])))
    rank = np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1]
    pair = np.flatnonzero((rank[1:] % 2 == 1) & ~new[1:]) if n > 1 else np.zeros(0, int)
    pair = pair[(sx[pair] % tile != 0) & (sy[pair] % tile != 0)]
    other = np.full(n, -1)
    other[order[pair]], other[order[pair + 1]] = order[pair + 1], order[pair]
    here = np.arange(n)
    step = np.where(other >= 0, other ^ 1, here)
    self_ring = (other >= 0) & (step == here)
    to, hops = _jumped(step)
    in_ring = (step[to] != to) | self_ring
    # rings begin with their least crossing, from its first end to its second
    least = here.copy()
    jump = step.copy()
    for _ in range(n.bit_length()):
        least = np.minimum(least, least[jump])
        jump = jump[jump]
    broken = np.where(in_ring & (step == least), here, step)
    ring_to, ring_hops = _jumped(broken)
    first = np.where(in_ring, least, to[here ^ 1] ^ 1)
    size = np.where(in_ring, ring_hops[least] + 1, hops + hops[here ^ 1] + 1)
    pos = np.where(in_ring, size - 1 - ring_hops, hops[here ^ 1])
    last = np.where(in_ring, ring_to, to)
    mine = np.where(in_ring, least % 2 == 1, (first // 2 < last // 2) | ((first // 2 == last // 2) & (here % 2 == 1)))
    k = np.flatnonzero(mine)
    cols = [pa.array(np.full(len(k), i, np.int32)), pa.array(ident[k // 2]), pa.array(2 * ident[first[k] // 2] + first[k] % 2), *map(pa.array, (pos[k], size[k], in_ring[k], k % 2 == 0))]
    return pa.Table.from_arrays(cols, [c.split()[0] for c in _PIECES.split(", ")])


def _ranked(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``places``: (i, d, step, ahead, tip): a list's places with the next one (null at the
    end), the crossings there, and the crossing at the place's own end. Returns
    (i, d, after, tip) with the crossings behind each place of a list and the last one, and
    (i, d, ring) of those that are in a ring, with its least place."""
    now = cut(places.select("i", "d", F.col("step").alias("to"), F.coalesce("ahead", F.lit(0)).cast("long").alias("after"), F.col("step").alias("least"), "tip", F.col("step").isNull().alias("done")))
    rings = []
    while not (left := now.where("not done")).isEmpty():
        far = now.select("i", F.col("d").alias("to"), F.col("to").alias("to2"), F.col("after").alias("after2"), F.col("least").alias("least2"), F.col("tip").alias("tip2"), F.col("done").alias("done2"))
        gone = left.join(far, ["i", "to"]).select(
            "i", "d", F.when(F.col("done2"), None).otherwise(F.col("to2")).alias("to"), (F.col("after") + F.col("after2")).alias("after"), F.least("least", "least2").alias("least"),
            F.when(F.col("done2"), F.col("tip2")).otherwise(F.col("tip")).alias("tip"), F.col("done2").alias("done"),
        )
        moved = cut(gone)
        turned = cut(moved.where("not done and least = d").select("i", F.col("d").alias("least")))
        if not turned.isEmpty():
            rings.append(moved.where("not done").join(turned, ["i", "least"]).select("i", "d", F.col("least").alias("ring")))
            moved = moved.join(turned, ["i", "least"], "left_anti")
        now = cut(now.where("done").unionByName(moved))
    found = places.sparkSession.createDataFrame([], "i int, d long, ring long")
    for r in rings:
        found = found.unionByName(r)
    return now.select("i", "d", "after", "tip"), found


def polylines(crossings: DataFrame, rows: int, cols: int, tile: int = TILE) -> DataFrame:
    """Crossings (of ``modes.contour_crossings``) with line, at and closed, their ends in
    the direction of the line: line is the number of its first crossing (square * 2 + part,
    squares by rows), at counts from 0. An open line begins with the one of its two outer
    crossings that has the smaller number, a ring with its smallest, both ends of which keep
    their order; so does a line of one crossing."""
    number = (F.col("r").cast("long") * cols + F.col("c")) * 2 + F.col("part")
    own = cut(crossings.withColumn("id", number))
    square = lambda x: F.floor(F.col(x) / tile)
    keyed = own.select("i", "id", "c0", "r0", "c1", "r1", square("r").alias("tr"), square("c").alias("tc"))
    pieces = cut(keyed.groupBy("i", "tr", "tc").applyInArrow(lambda table: _chained(tile, table), _PIECES))
    lined = own.join(pieces, ["i", "id"])
    # ends of open pieces on edges of tiles: 0 before the first crossing, 1 after the last
    outer = lined.where("not closed and (pos = 0 or pos = size - 1)")
    begin, end = (F.struct(F.when(F.col("flip"), F.col(f"c{e}")).otherwise(F.col(f"c{1 - e}")).alias("c"), F.when(F.col("flip"), F.col(f"r{e}")).otherwise(F.col(f"r{1 - e}")).alias("r")) for e in (1, 0))
    side = lambda e, p: F.struct(F.lit(e).alias("e"), p.alias("p"), (F.col("id") * 2 + F.when(F.col("flip"), 1 - e).otherwise(e)).alias("code"))
    sides = F.array_compact(F.array(F.when(F.col("pos") == 0, side(0, begin)), F.when(F.col("pos") == F.col("size") - 1, side(1, end))))
    tips = outer.select("i", "piece", "size", "id", F.explode(sides).alias("s")).select("i", (F.col("piece") * 2 + F.col("s.e")).alias("d"), "size", F.col("id").alias("tip"), "s.p", "s.code")
    on_edge = (F.col("p.c") % tile == 0) | (F.col("p.r") % tile == 0)
    meet = Window.partitionBy("i", "p").orderBy("code")
    ranked = tips.where(on_edge).withColumns({"n": F.row_number().over(meet), "after": F.lead(F.struct("d", "size")).over(meet), "before": F.lag(F.struct("d", "size")).over(meet)})
    met = ranked.select("i", "d", F.when(F.col("n") % 2 == 1, F.col("after")).otherwise(F.col("before")).alias("q"))
    joined = cut(tips.select("i", "d", "size", "tip").join(met, ["i", "d"], "left").select("i", "d", "size", "tip", F.col("q.d").bitwiseXOR(F.lit(1).cast("long")).alias("step"), F.col("q.size").alias("ahead")))
    alone = joined.where("step is null").select("i", F.shiftright("d", 1).alias("piece")).groupBy("i", "piece").agg(F.count("*").alias("n")).where("n = 2").select("i", "piece")
    chained = cut(joined.withColumn("piece", F.shiftright("d", 1)).join(alone, ["i", "piece"], "left_anti"))
    placed = _placed(own, pieces, chained) if not chained.isEmpty() else None
    lined = lined.select(*own.columns, "piece", "pos", "size", "closed", "flip")
    first = F.shiftright("piece", 1)
    if placed is None:
        made = lined.select(*own.columns, first.alias("line"), F.col("pos").alias("at"), "closed", "flip")
    else:
        both = lined.join(placed, ["i", "piece"], "left")
        moved = F.col("start").isNotNull()
        along = F.when(F.col("back"), F.col("size") - 1 - F.col("pos")).otherwise(F.col("pos")) + F.col("start")
        turn = F.when(F.col("total").isNull(), along).when(F.col("reverse"), F.pmod(F.col("shift") - along, F.col("total"))).otherwise(F.pmod(along - F.col("shift"), F.col("total")))
        flip = F.col("flip") != (F.col("back") != F.coalesce("reverse", F.lit(False)))
        made = both.select(
            *own.columns, F.when(moved, F.col("first")).otherwise(first).alias("line"), F.when(moved, turn).otherwise(F.col("pos")).alias("at"),
            (F.col("closed") | F.col("total").isNotNull()).alias("closed"), F.when(moved, flip).otherwise(F.col("flip")).alias("flip"),
        )
    ends = {f"{a}{e}": F.when(F.col("flip"), F.col(f"{a}{1 - e}")).otherwise(F.col(f"{a}{e}")) for a in "cr" for e in (0, 1)}
    return made.select(*[ends.get(c, F.col(c)).alias(c) for c in crossings.columns], "line", "at", "closed")


def _placed(own: DataFrame, pieces: DataFrame, chained: DataFrame) -> DataFrame:
    """Of each piece that meets others: the first crossing of its line, the crossings before
    it (start), whether it is passed backwards (back); in a ring of ``total`` crossings also
    the place of the first one (shift) and whether the ring runs backwards (reverse)."""
    lists, rings = _ranked(chained)
    lists, rings = cut(lists), cut(rings)
    side = F.col("d").bitwiseAND(F.lit(1).cast("long"))
    # a line is seen from both sides; it runs from the smaller outer crossing to the larger
    seen = lists.select("i", F.shiftright("d", 1).alias("piece"), side.alias("e"), "after", "tip")
    two = seen.groupBy("i", "piece").agg(*[F.max(F.when(F.col("e") == e, F.col(c))).alias(f"{c}{e}") for e in (0, 1) for c in ("after", "tip")])
    ahead = F.col("tip0") < F.col("tip1")
    open_ = two.select("i", "piece", F.least("tip0", "tip1").alias("first"), F.when(ahead, F.col("after0")).otherwise(F.col("after1")).alias("start"), (~ahead).alias("back"))
    none = {c: F.lit(None).cast(k).alias(c) for c, k in (("total", "long"), ("shift", "long"), ("reverse", "boolean"))}
    open_ = open_.select("*", *none.values())
    if rings.isEmpty():
        return cut(open_)
    # of a ring's two directions one, cut open in front of its least place
    one = rings.where("ring % 2 = 1").join(chained, ["i", "d"])
    cut_open = cut(one.select("i", "d", "ring", "size", "tip", F.when(F.col("step") != F.col("ring"), F.col("step")).alias("step"), F.when(F.col("step") != F.col("ring"), F.col("ahead")).alias("ahead")))
    ranks, _ = _ranked(cut_open)
    laid = cut_open.select("i", "d", "ring", "size").join(ranks.select("i", "d", "after"), ["i", "d"])
    total = laid.where("d = ring").select("i", "ring", (F.col("after") + F.col("size")).alias("total"))
    laid = cut(laid.join(total, ["i", "ring"]).select("i", F.shiftright("d", 1).alias("piece"), "ring", "total", (F.col("total") - F.col("after") - F.col("size")).alias("start"), (F.col("d") % 2 == 0).alias("back")))
    # the ring's least crossing: where it stands, and in which direction it is passed
    members = pieces.join(laid, ["i", "piece"])
    at = F.col("start") + F.when(F.col("back"), F.col("size") - 1 - F.col("pos")).otherwise(F.col("pos"))
    least = members.groupBy("i", "ring").agg(F.min(F.struct("id", at.alias("shift"), (F.col("flip") != F.col("back")).alias("reverse"))).alias("m"))
    closed = laid.join(least, ["i", "ring"]).select("i", "piece", F.col("m.id").alias("first"), "start", "back", "total", "m.shift", "m.reverse")
    return cut(open_.unionByName(closed))
