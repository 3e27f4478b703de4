"""Large GeoTIFF files, read by many tasks: a Spark data source whose partitions are runs of
strips or tiles.

The driver reads a file's header only. A task reads its blocks by ranges of bytes, so no
task and no row ever holds a file. Conditions on r and c that Spark pushes down, or a
window, choose the blocks; what lies in a chosen block beyond them is left to Spark's
filter. Paths are paths or URIs that all executors see and Arrow's file systems know.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from orograph.sources.images import PIXELS, Tiff, tiff_header

#: Values of a partition's blocks, about, and of a batch of rows.
VALUES, BATCH = 1 << 22, 1 << 16
_END = (1 << 31) - 1


@dataclass
class Blocks(InputPartition):
    """Blocks of a file: numbers, places and sizes."""

    path: str
    head: Tiff | None
    numbers: np.ndarray
    offsets: np.ndarray
    counts: np.ndarray


def _open(path: str):
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def files(path: str) -> list[str]:
    """A file, or those of a folder that are named as TIFF files."""
    store, place = fs.FileSystem.from_uri(path)
    if store.get_file_info(place).type == fs.FileType.File:
        return [path]
    names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(place)) if x.extension.lower() in ("tif", "tiff", "geotiff"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


class TiffReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.values = options["path"], int(options.get("values", VALUES))
        self.low = {k: int(options.get(f"{k}0", 0)) for k in "rc"}
        self.high = {k: int(options.get(f"{k}1", _END)) for k in "rc"}  # the last one

    def pushFilters(self, filters):
        """Narrows the window; Spark tests the rows again."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in ("r", "c") and (v := getattr(f, "value", None)) is not None:
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low[name] = max(self.low[name], v + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high[name] = min(self.high[name], v - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Blocks]:
        out = []
        for path in files(self.path):
            with _open(path) as file:
                t = tiff_header(lambda at, n: file.read_at(n, at))
            rows = np.arange(max(0, self.low["r"]) // t.block_h, min(t.height - 1, self.high["r"]) // t.block_h + 1)
            cols = np.arange(max(0, self.low["c"]) // t.block_w, min(t.width - 1, self.high["c"]) // t.block_w + 1)
            chosen = (rows[:, None] * t.across + cols).ravel()
            some = max(1, self.values // (t.block_w * t.block_h))
            head = replace(t, offsets=None, counts=None)
            out += [Blocks(path, head, k, t.offsets[k], t.counts[k]) for k in (chosen[i : i + some] for i in range(0, len(chosen), some))]
        none = np.zeros(0, np.int64)
        return out or [Blocks(self.path, None, none, none, none)]

    def read(self, part: Blocks):
        if not len(part.numbers):
            return
        with _open(part.path) as file:
            for k, offset, count in zip(part.numbers.tolist(), part.offsets.tolist(), part.counts.tolist()):
                v = part.head.block(k, file.read_at(count, offset))
                top, left = part.head.corner(k)
                step = max(1, BATCH // v.shape[1])
                for i in range(0, v.shape[0], step):
                    values = v[i : i + step].astype(float)
                    r, c = np.indices(values.shape)
                    valid = np.ones(values.size, bool) if part.head.nodata is None else (values != part.head.nodata).ravel()
                    columns = [pa.array([part.path]).take(pa.array(np.zeros(values.size, np.int32))), pa.array((r + top + i).ravel().astype(np.int32)), pa.array((c + left).ravel().astype(np.int32)), pa.array(values.ravel()), pa.array(valid)]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "r", "c", "v", "valid"])


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orograph_tiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def tiff_values(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, values: int = VALUES) -> DataFrame:
    """(path, r, c, v, valid) of a GeoTIFF, or of those in a folder, by blocks; v is the
    value of band 0. ``window``: first row and column and last row and column. Turns on the
    session's push-down of conditions to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    options = dict(zip(("r0", "c0", "r1", "c1"), window)) if window else {}
    rows = spark.read.format("orograph_tiff").options(path=path, values=values, **options).load()
    if window:
        rows = rows.where(F.col("r").between(window[0], window[2]) & F.col("c").between(window[1], window[3]))
    return rows
