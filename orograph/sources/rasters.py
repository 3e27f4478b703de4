"""Rasters: NoData, normalisation, dense grids, and rasters made from other tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What stands for NoData in elevation rasters.
SENTINELS = (-9999.0, -32767.0, -32768.0, 3.4028234663852886e38)


class NoElevation(ValueError):
    """A raster without a range of elevations."""


@dataclass(frozen=True)
class Raster:
    pixels: DataFrame
    width: int
    height: int
    low: float | None = None
    high: float | None = None


def is_nodata(v: Column, declared: float | None = None) -> Column:
    """True for null, infinite, not-a-number and sentinel values, and the declared one."""
    v = v.cast("double")
    out = v.isNull() | F.isnan(v) | (F.abs(v) == math.inf) | v.isin(*SENTINELS)
    return out if declared is None else out | (v == float(declared))


def dense(spark: SparkSession, values: DataFrame, width: int, height: int) -> DataFrame:
    """(r, c, raw, valid) for every place; places that ``values`` (r, c, raw) lacks hold
    no data."""
    places = spark.range(width * height).select((F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    return places.join(values.select("r", "c", "raw"), ["r", "c"], "left").select("r", "c", F.coalesce("raw", F.lit(0.0)).alias("raw"), F.col("raw").isNotNull().alias("valid"))


def normalised(spark: SparkSession, values: DataFrame, declared: float | None = None, steps: int | None = None, width: int | None = None, height: int | None = None) -> Raster:
    """A raster of (r, c, v): heights stretched to 0..1 over the range of the values that
    are data; ``steps`` quantises them."""
    data = values.where(~is_nodata(F.col("v"), declared)).select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v"))
    held = F.when(~is_nodata(F.col("v"), declared), F.col("v").cast("double"))
    m = values.agg(F.min(held).alias("lo"), F.max(held).alias("hi"), F.max("r").alias("r"), F.max("c").alias("c")).first()
    if m.lo is None or not m.hi > m.lo:
        raise NoElevation("the raster holds no range of elevations")
    raw = (F.col("v") - m.lo) / (m.hi - m.lo)
    if steps:
        raw = F.floor(raw * float(steps) + 0.5).cast("double") / float(steps)
    width, height = width or int(m.c) + 1, height or int(m.r) + 1
    return Raster(dense(spark, data.select("r", "c", raw.alias("raw")), width, height), width, height, m.lo, m.hi)


def from_vectors(spark: SparkSession, sf_dir: str) -> Raster:
    """A row for each vector, a column for each component."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "v"))
    return normalised(spark, v, steps=1_000_000)


def _mean_of_cents(df: DataFrame, value: str) -> DataFrame:
    cents = F.sum(F.floor(F.col(value) * 100 + 0.5))
    return df.groupBy("r", "c").agg((cents.cast("double") / F.count("*").cast("double")).alias("v"))


def from_events(spark: SparkSession, sf_dir: str) -> Raster:
    """Mean value of a user's events by day; days without events hold no data."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("r"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("c"), "value")
    return normalised(spark, _mean_of_cents(e, "value"), steps=1_000_000)


def from_lineitems(spark: SparkSession, sf_dir: str) -> Raster:
    """Mean price by quantity and month of shipping."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") - 1).cast("int").alias("r"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month"), "l_extendedprice")
    first = items.agg(F.min("month")).first()[0]
    return normalised(spark, _mean_of_cents(items.select("r", (F.col("month") - first).alias("c"), "l_extendedprice"), "l_extendedprice"), steps=1_000_000)


RASTERS = {"E": from_vectors, "N": from_events, "P": from_lineitems}
