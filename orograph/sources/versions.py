"""Versions of a raster, with steps that can be taken back and made again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.sources.rasters import Raster

LOG = "seq long, version long, parent long, width int, height int, low double, high double, note string"


class History:
    """The versions of a raster in a folder that all executors share: each one a table, and a
    log of one small row for each step, whose last row tells what holds now. A step back is
    a row too, so nothing is copied or lost by it. A version is logged only once its table is
    whole; one that was being written when a job died is never seen. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def log(self) -> DataFrame:
        """(seq, version, parent, width, height, low, high, note): a row for each step."""
        path = f"{self.folder}/log"
        return self.spark.read.schema(LOG).parquet(path) if self._exists(path) else self.spark.createDataFrame([], LOG)

    def _last(self):
        return self.log().orderBy(F.desc("seq")).first()

    def _row_of(self, version: int):
        return self.log().where(F.col("version") == version).orderBy("seq").first()

    def _append(self, *values) -> None:
        self.spark.createDataFrame([values], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def save(self, raster: Raster, note: str = "") -> int:
        """The raster as the next version, which holds from now on."""
        last, numbers = self._last(), self.log().agg(F.max("version").alias("n")).first()
        version = 0 if numbers.n is None else numbers.n + 1
        raster.pixels.select("r", "c", "raw", "valid").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/version={version}")
        self._append(last.seq + 1 if last else 0, version, last.version if last else None, raster.width, raster.height, raster.low, raster.high, note)
        return version

    def raster(self, version: int | None = None) -> Raster:
        """A version; without a number the one that holds."""
        row = self._last() if version is None else self._row_of(version)
        if row is None:
            raise ValueError("no such version")
        return Raster(self.spark.read.schema("r int, c int, raw double, valid boolean").parquet(f"{self.folder}/version={row.version}"), row.width, row.height, row.low, row.high)

    def apply(self, change: Callable[[DataFrame, int, int], DataFrame], note: str = "") -> int:
        """What ``change`` (such as ``sequential.erode``) makes of the pixels, width and
        height, as the next version."""
        now = self.raster()
        return self.save(Raster(change(now.pixels, now.width, now.height), now.width, now.height, now.low, now.high), note)

    def _to(self, version: int, note: str) -> bool:
        row, last = self._row_of(version), self._last()
        self._append(last.seq + 1, version, row.parent, row.width, row.height, row.low, row.high, note)
        return True

    def undo(self) -> bool:
        """Back to the version that the one that holds was made of; False if there is none."""
        last = self._last()
        return self._to(last.parent, "undo") if last and last.parent is not None else False

    def redo(self) -> bool:
        """On to the latest version made of the one that holds; False if there is none."""
        last = self._last()
        made = self.log().where((F.col("parent") == last.version) & (F.col("version") != last.version)).agg(F.max("version").alias("n")).first() if last else None
        return self._to(made.n, "redo") if made and made.n is not None else False
