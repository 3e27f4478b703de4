"""Operator 13: clusters around centroids by Lloyd's algorithm, in whole numbers.

Vectors become integers, floor(256 * x) of each component, and are written once. In each
round the centroids are broadcast; ``mapInPandas`` works out every vector's integer squared
distance to each of them in NumPy, and the least one, of equals the one with the smallest
number, takes the vector. A task adds its vectors up as it goes and gives one row for each
centroid and component; ``groupBy`` merges these integer sums, so the result doesn't depend
on the order of rows, the number of tasks or lost executors. Only the k centroids ever
reach the driver: k times the number of components, whatever the number of vectors.

Defined results: vectors that are null, of another length, or hold a null or non-finite
component take no part, nor do those with a component beyond 2^19 in size, whose distances
a long couldn't hold; a null id counts as an empty one in the order of first centroids;
repeated rows count one by one, also as first centroids (of equal centroids the smaller
number takes all); fewer vectors than centroids give fewer centroids; a centroid without
vectors stays where it is; sums of distances end at the largest long; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import cut

#: Of the query: components of a vector, centroids, rounds, parts of one, seed.
DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Most a component may be, as an integer: 64 squares of twice as much fit a long.
LARGEST = 1 << 27
#: Rows and centroids' distances that are worked on at once.
BLOCK = 4096
_LONG = (1 << 63) - 1


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<int>) of the vectors that take part."""
    value = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= LARGEST))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("x")).where(F.col("x").isNotNull() & (F.size("x") == dimensions) & fine)
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each vector, and the squared distance."""
    d = np.empty((len(v), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        diff = v - c
        d[:, k] = np.einsum("ij,ij->i", diff, diff)
    cluster = d.argmin(1)
    return cluster, d[np.arange(len(v)), cluster]


def _blocks(frame: pd.DataFrame):
    for i in range(0, len(frame), BLOCK):
        part = frame.iloc[i : i + BLOCK]
        yield part, np.stack(part["v"].to_numpy()).astype(np.int64)


def _sums(held, frames):
    """Of a task's vectors: their number and sum, by centroid and component."""
    centroids = held.value
    total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
    for frame in frames:
        for _, v in _blocks(frame):
            cluster, _ = nearest(v, centroids)
            order = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            total[cluster[order][first]] += np.add.reduceat(v[order], first)
            count += np.bincount(cluster, minlength=len(centroids))
    k, at = np.nonzero(np.broadcast_to(count[:, None] > 0, total.shape))
    yield pd.DataFrame({"cluster": k.astype(np.int32), "at": at.astype(np.int32), "total": total[k, at], "n": count[k]})


def _assigned(held, frames):
    for frame in frames:
        for part, v in _blocks(frame):
            cluster, d = nearest(v, held.value)
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": cluster.astype(np.int32), "distance": d})


def lloyd(kept: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after so many rounds over ``kept`` (of ``integers``)."""
    centroids = centroids.copy()
    for _ in range(rounds if len(centroids) else 0):
        held = kept.sparkSession.sparkContext.broadcast(centroids)
        sums = kept.select("v").mapInPandas(partial(_sums, held), "cluster int, at int, total long, n long")
        merged = sums.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in merged.collect():  # a row for each centroid and component
            centroids[r["cluster"], r["at"]] = r["total"] // r["n"]  # rounds down
        held.destroy()
    return centroids


def first_centroids(kept: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the k smallest digests, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of each vector that takes part, and (cluster, centroid,
    size, inertia) of each centroid; a distance is squared, an inertia the sum of them."""
    spark = vectors.sparkSession
    kept = cut(integers(vectors, dimensions, vector=vector))
    centroids = lloyd(kept, first_centroids(kept, k, seed), rounds)
    rows = cut(kept.mapInPandas(partial(_assigned, spark.sparkContext.broadcast(centroids)), "vec_id long, cluster int, distance long")) if len(centroids) else spark.createDataFrame([], "vec_id long, cluster int, distance long")
    known = spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "cluster int, centroid array<long>")
    sums = rows.groupBy("cluster").agg(F.count("*").alias("size"), _total("distance").alias("inertia"))
    return rows, known.join(sums, "cluster", "left").select("cluster", "centroid", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("inertia", F.lit(0)).cast("long").alias("inertia"))


def _total(column: str) -> F.Column:
    """A sum of longs that stops at the largest long."""
    return F.least(F.sum(F.col(column).cast("decimal(20,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")


def cluster_rows(vectors: DataFrame) -> DataFrame:
    """The rows of the contract."""
    rows, found = cluster(vectors)
    known = found.collect()  # at most CENTROIDS rows
    total = min(sum(r.inertia for r in known), _LONG)
    digests = [(r["cluster"], r.inertia, total, hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest()) for r in known]
    named = vectors.sparkSession.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """DuckDB: the rounds one after the other, a row for each centroid and component."""
    near = f"""(SELECT vec_id, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS n FROM (
      SELECT vec_id, c, sum((x - y) * (x - y)) AS d FROM p JOIN c{{0}} USING (i) GROUP BY vec_id, c)) WHERE n = 1)"""
    rounds = [
        f"""a{k} AS MATERIALIZED {near.format(k)},
s{k} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{k} JOIN p USING (vec_id) GROUP BY c, i),
c{k + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{k} LEFT JOIN s{k} USING (c, i))"""
        for k in range(ROUNDS)
    ]
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
k AS (SELECT vec_id, e FROM v WHERE len(e) = {DIMENSIONS} AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) * {SCALE} > {LARGEST})) = 0),
p AS MATERIALIZED (SELECT vec_id, i, CAST(floor({SCALE} * e[i]) AS BIGINT) AS x FROM (SELECT vec_id, e, unnest(range(1, {DIMENSIONS + 1})) AS i FROM k)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM k),
c0 AS MATERIALIZED (SELECT c, i, x AS y FROM f JOIN p USING (vec_id) WHERE c < {CENTROIDS}),
{', '.join(rounds)},
z AS MATERIALIZED {near.format(ROUNDS)},
h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM z JOIN h USING (c)
"""


ORACLE = _oracle()
