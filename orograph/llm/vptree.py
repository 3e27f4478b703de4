"""Operator 4: approximate nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to length one; there the Euclidean distance is a metric in the order
of the cosine. Tables of over SHARD vectors are dealt into cells around pivots (CELLS at
most, a bounded sample by hash), each vector to its nearest pivot, and cells by hash into
shards of about SHARD vectors. Each shard is a tree: a node takes a vantage point and
halves its vectors by their distance to it. A half is skipped for a query if, by the
triangle inequality, all of it lies farther than the query's k-th best so far; ``factor``
relaxes that bound to factor * k-th best, so that less is searched below one. Factor one
is exact search and is what the query uses.

The same inequality, with the same factor, keeps queries from cells: each query is first
searched in its own cell, and then goes only to those whose pivot and radius leave room
for something nearer than its k-th best. Vectors travel once, queries once for each cell
they must see. A task takes a shard's vectors, builds its tree, and streams the shard's
queries through it; past SLICE queries the shard is dealt to several tasks. Vectors
without any clusters leave exact search little to skip; for such data at large sizes
choose a factor below one.

Equal vectors are searched once. Of each distinct vector the k + 1 smallest ids are kept
beside it: ties go to smaller ids, so no answer can need more (k, and the query itself).
They are found by a ranked window whose limit Spark applies before the shuffle, so a
vector that holds a third of all rows is no hot spot. Distinct query vectors are searched
once, too, and each query then leaves itself out. Of vectors with equal scores, such as
parallel ones, a shard returns no more than k + 1 ids.

Scores are the cosine of the original vectors in double precision, summed in one order,
so equal pairs tie; vectors are brought near one by a power of two first, so squares
neither overflow nor vanish.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, neither do rows without an id; vectors are compared with those of their
own length; a row that repeats an id and its vector counts once, and ids that carry
different vectors are candidates with each (also for each other, never for themselves by
id); fewer candidates than k give fewer rows; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.llm.common import cut

K = 5
EVERY = 50
SHARD = 16_384
CELLS = 4_096
LEAF = 128
#: Queries that a task searches at once, and most that one task gets of a shard.
BLOCK, SLICE = 512, 65_536
#: Bytes of vectors that a shard, all pivots, and a step's distances to cells may take.
SHARD_BYTES, PIVOT_BYTES, STEP_BYTES = 64 << 20, 64 << 20, 32 << 20
FOUND = "query array<double>, hits array<struct<vec_id: long, score: double>>"
DEALT = "size int, cell int, d double, v array<double>"


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("v"))  # -0 is 0
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    )


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): each distinct vector with its ``most`` smallest ids."""
    first = Window.partitionBy("v").orderBy("vec_id")
    ranked = rows.select("vec_id", "v").withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= most)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


class Tree:
    """A vantage-point tree over unit vectors."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.points, self.leaf = points, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, index: np.ndarray):
        if len(index) <= self.leaf:
            return index
        at = self.rng.integers(len(index))
        vantage = index[at]
        d = distances(self.points[vantage : vantage + 1], self.points[index])[0]
        order = np.argsort(d, kind="stable")
        half = len(order) // 2
        near, far = order[:half], order[half:]
        # bounds of each half's distances to the vantage point
        return (vantage, (d[near].min(), d[near].max(), self._build(index[near])), (d[far].min(), d[far].max(), self._build(index[far])))

    def search(self, queries: np.ndarray, weight: np.ndarray, k: int, factor: float = 1.0):
        """For each query: the least distances found, as (distance, point) arrays that
        hold all points up to the k-th weighted one (``weight``: ids of a point)."""
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
        bound = np.full(len(queries), np.inf)

        def visit(node, rows):
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                d = distances(queries[rows], self.points[node])
                near_enough = d <= bound[rows, None] + SLACK
                for i in np.flatnonzero(near_enough.any(1)).tolist():
                    r, keep = rows[i], near_enough[i]
                    dist, at = np.concatenate((best[r][0], d[i][keep])), np.concatenate((best[r][1], node[keep]))
                    order = np.argsort(dist, kind="stable")
                    dist, at = dist[order], at[order]
                    full = np.searchsorted(np.cumsum(weight[at]), k)
                    if full < len(dist):
                        bound[r] = dist[full]
                        last = np.searchsorted(dist, dist[full] + SLACK, "right")
                        dist, at = dist[:last], at[:last]
                    best[r] = (dist, at)
                return
            vantage, near, far = node
            d = distances(queries[rows], self.points[vantage : vantage + 1])[:, 0]
            inside = d <= near[1]
            for first in (True, False):  # each query sees its own side first
                for lo, hi, child in (near, far):
                    mine = inside if child is near[2] else ~inside
                    rest = np.maximum(np.maximum(lo - d, d - hi), 0)
                    go = (mine if first else ~mine) & (rest <= factor * bound[rows] + SLACK)
                    visit(child, rows[go])

        visit(self.root, np.arange(len(queries)))
        return best


#: Room for rounding in distances of unit vectors; what lies within it is told apart by
#: the exact score.
SLACK = 1e-6


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def near_one(m: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near one."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(1, keepdims=True))[1])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of a with rows of b, each summed in the same order."""
    a, b = near_one(a), near_one(b)
    total = lambda x: np.cumsum(x, axis=1)[:, -1]  # noqa: E731  from the first component to the last
    return total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten(), float)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def unit(m: np.ndarray) -> np.ndarray:
    m = near_one(m)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _deal(pivots: dict[int, np.ndarray], batches):
    """The nearest pivot (cell) of each vector among those of its size, and the distance."""
    for batch in batches:
        size = np.asarray(batch.column("v").value_lengths())
        cell, d = np.zeros(len(size), np.int32), np.zeros(len(size))
        for n in set(size.tolist()) & set(pivots):
            rows = np.flatnonzero(size == n)
            for i in range(0, len(rows), 4096):
                part = rows[i : i + 4096]
                far = distances(unit(_matrix(batch.column("v").take(pa.array(part)))), pivots[n])
                cell[part] = far.argmin(1)
                d[part] = far[np.arange(len(part)), cell[part]]
        more = [c for c in batch.schema.names if c != "v"]
        yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int32)), pa.array(cell), pa.array(d), batch.column("v"), *(batch.column(c) for c in more)], ["size", "cell", "d", "v", *more])


def _far(held, factor: float, batches):
    """The other cells that each query (size, cell, v, bound) must see, a few queries at a
    time: where little can be skipped, pairs are many."""
    for batch in batches:
        size, own, bound = (np.asarray(batch.column(c)) for c in ("size", "cell", "bound"))
        for n in set(size.tolist()) & set(held.value):
            pivots, nearest, farthest = held.value[n]
            rows, step = np.flatnonzero(size == n), max(1, STEP_BYTES // (8 * len(pivots)))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                d = distances(unit(_matrix(batch.column("v").take(pa.array(part)))), pivots)
                go = np.maximum(nearest - d, d - farthest) <= factor * bound[part, None] + SLACK
                go[np.arange(len(part)), own[part]] = False
                q, c = np.nonzero(go)
                some = max(1, STEP_BYTES // (8 * n))
                for j in range(0, len(q), some):
                    at = pa.array(part[q[j : j + some]])
                    yield pa.RecordBatch.from_arrays([batch.column("size").take(at), pa.array(c[j : j + some].astype(np.int32)), batch.column("v").take(at)], ["size", "cell", "v"])


def _answers(tree: Tree, points: np.ndarray, weight: np.ndarray, every: np.ndarray, asked: np.ndarray, most: int, factor: float) -> pa.RecordBatch:
    """FOUND of some queries; ``weight``: ids of each point, ``every``: all of them in order."""
    owner, ends = np.repeat(np.arange(len(weight)), weight), np.cumsum(weight)
    out = []
    for q, (_, at) in enumerate(tree.search(unit(asked), weight, most, factor)):
        score = cosine(points[at], np.broadcast_to(asked[q], points[at].shape))
        rows = np.concatenate([np.arange(ends[p] - weight[p], ends[p]) for p in at.tolist()])
        of = dict(zip(at.tolist(), score.tolist()))
        s = np.array([of[p] for p in owner[rows].tolist()])
        first = np.lexsort((every[rows], -s))[:most]
        out.append([{"vec_id": i, "score": x} for i, x in zip(every[rows[first]].tolist(), s[first].tolist())])
    kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
    query = pa.ListArray.from_arrays(pa.array(np.arange(len(asked) + 1, dtype=np.int32) * asked.shape[1]), pa.array(asked.ravel()))
    return pa.RecordBatch.from_arrays([query, pa.array(out, kind)], ["query", "hits"])


def _stream(most: int, factor: float, batches):
    """Rows come by shard, a shard's vectors (with ids) before its queries (without). Only
    a shard's vectors are held, as numbers."""
    now, held, ids, shard = None, [], [], None
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(c)) for c in ("size", "cell", "part", "slice")], 1)
        asking = np.asarray(batch.column("ids").is_null())
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1) | (asking[1:] != asking[:-1])))[: len(keys)])
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
            if tuple(keys[i]) != now:
                now, held, ids, shard = tuple(keys[i]), [], [], None
            if not asking[i]:
                held.append(_matrix(batch.column("v").slice(i, j - i)))
                ids.append(batch.column("ids").slice(i, j - i))
                continue
            if not held:
                continue
            if shard is None:
                points, every = np.concatenate(held), pa.chunked_array(ids)
                held = [points]
                shard = Tree(unit(points)), points, np.concatenate([np.asarray(x.value_lengths()) for x in ids]), np.asarray(every.combine_chunks().flatten())
            for k in range(i, j, BLOCK):
                yield _answers(*shard, _matrix(batch.column("v").slice(k, min(BLOCK, j - k))), most, factor)


def _searched(candidates: DataFrame, parts: DataFrame, routed: DataFrame, most: int, factor: float) -> DataFrame:
    """FOUND of the queries ``routed`` (size, cell, v) among the candidates of their cells.
    ``parts``: (size, cell, parts), the shards of each cell."""
    key = ["size", "cell"]
    slices = cut(routed.groupBy(*key).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")).join(parts, key))
    deal = lambda c, n: F.pmod(F.xxhash64(F.lit(c), F.col("v")), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = candidates.join(slices, key).withColumn("part", deal("part", "parts")).withColumn("slice", all_of("slices")).select(*key, "part", "slice", "v", "ids")
    right = routed.join(slices, key).withColumn("part", all_of("parts")).withColumn("slice", deal("slice", "slices")).select(*key, "part", "slice", "v", F.lit(None).cast("array<long>").alias("ids"))
    place = [*key, "part", "slice"]
    dealt = left.unionByName(right).repartition(*map(F.col, place)).sortWithinPartitions(*place, F.col("ids").isNull(), F.xxhash64("v"))
    return dealt.mapInArrow(partial(_stream, most, factor), FOUND)


def _best(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best hits of each query vector."""
    each = found.select("query", F.explode("hits").alias("h")).select("query", "h.vec_id", "h.score")
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= most)
    return ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("hits"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = 1.0, vector: str = "embedding", shard: int = SHARD, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` to each of
    ``queries`` (both vec_id and the vector), by cosine, without rows of the query's id."""
    most = k + 1
    distinct = cut(distinct_vectors(usable(vectors, vector), most).withColumn("size", F.size("v")))
    asking = cut(usable(queries, vector).distinct())
    # pivots for the sizes of over a shard of vectors: cells at most for all of them
    total = distinct.count()
    sizes = distinct.groupBy("size").agg(F.count("*").alias("n")).where(F.col("n") > shard)
    share = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / shard), F.floor(F.col("n") * F.least(F.lit(cells), PIVOT_BYTES / (8 * F.col("size"))) / total)))
    ranked = distinct.join(F.broadcast(sizes.select("size", share.alias("share"))), "size").withColumn("rank", F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("v"), "v")))
    chosen: dict[int, list] = {}
    for r in ranked.where((F.col("rank") <= cells) & (F.col("rank") <= F.col("share"))).select("size", "v").collect():
        chosen.setdefault(r["size"], []).append(r.v)
    pivots = {n: unit(np.array(v, float)) for n, v in chosen.items()}
    candidates = cut(distinct.select("v", "ids").mapInArrow(partial(_deal, pivots), DEALT + ", ids array<long>"))
    stats = cut(candidates.groupBy("size", "cell").agg(F.min("d").alias("nearest"), F.max("d").alias("farthest"), F.ceil(F.count("*") / F.least(F.lit(shard), F.greatest(F.lit(1), F.floor(SHARD_BYTES / (8 * F.col("size")))))).cast("int").alias("parts")))
    parts = stats.select("size", "cell", "parts")
    routed = cut(asking.select("v").distinct().mapInArrow(partial(_deal, pivots), DEALT).select("size", "cell", "v"))
    found = _searched(candidates, parts, routed, most, factor)
    if pivots:
        found = cut(found)
        known: dict[int, tuple] = {n: (p, np.full(len(p), np.inf), np.full(len(p), -np.inf)) for n, p in pivots.items()}
        for r in stats.where(F.col("size").isin([int(n) for n in pivots])).collect():
            known[r["size"]][1][r.cell], known[r["size"]][2][r.cell] = r.nearest, r.farthest
        own = _best(found, most).select("query", F.when(F.size("hits") >= most, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.element_at("hits", -1)["score"]))).alias("bound"))
        bounded = routed.join(own, routed["v"] == own["query"], "left").select("size", "cell", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        farther = cut(bounded.mapInArrow(partial(_far, vectors.sparkSession.sparkContext.broadcast(known), factor), "size int, cell int, v array<double>"))
        found = found.unionByName(_searched(candidates, parts, farther, most, factor))
    top = _best(found, most)
    named = asking.join(top, asking["v"] == top["query"]).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("vec_id")), 1, k).alias("hits"))
    return named.select("query_id", F.posexplode("hits").alias("at", "h")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "h.vec_id", "h.score")


def neighbour_rows(vectors: DataFrame) -> DataFrame:
    """The rows of the contract: queries are the rows whose vec_id is divisible by EVERY."""
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


#: DuckDB: brute force in double precision.
ORACLE = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT DISTINCT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= {K}
"""
