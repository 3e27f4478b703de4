"""Shared plumbing: row keys, shared-folder tables and Arrow batch helpers."""

from __future__ import annotations

import sys
from types import ModuleType

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orograph.shared import cut, shared_folder  # noqa: F401  operators take them from here

NULL_ID = -(2**63)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, dkey, tkey, text): dkey is doc_id with null as the smallest long, tkey
    tells apart texts that share an id. Other columns are left behind."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("dkey"),
        F.xxhash64("text").alias("tkey"),
        F.col("text").cast("string").alias("text"),
    )


def held_out(col) -> F.Column:
    """True where crc32 of the id, as text, leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 3 == 1, F.lit(False))


def let(value: F.Column, body) -> F.Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.transform(F.array(value), body)[0]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null as empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def annotate(docs: DataFrame, fn, fields: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns, or ``keep``) in a struct ``row``, so that no column of theirs can clash,
    beside the columns ``fields`` (DDL) that ``fn`` makes: it gets the UTF-8 texts of a
    batch (null as empty) and returns an Arrow array for each field."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(text).cast("string").alias("t"))
    made = StructType.fromDDL(fields)
    names = ["row", *made.names]

    def run(batches):
        for batch in batches:
            raw = raw_texts(batch, "t")
            for i, j in spans([len(t) for t in raw], 8 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), *fn(raw[i:j])], names)

    return packed.mapInArrow(run, StructType([packed.schema["row"], *made.fields]))


def per_worker(name: str, make):
    """What ``make`` returns, made once in each Python worker and kept between its tasks.
    Only for caches: results must not depend on it."""
    held = sys.modules.setdefault("orograph_worker_cache", ModuleType("orograph_worker_cache")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spans(sizes: list[int], limit: int):
    """Consecutive (from, to) index ranges of at most ``limit`` bytes (or one item)."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)

