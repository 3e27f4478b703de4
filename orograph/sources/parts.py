"""Files of bytes in ordered parts: binary STL and greyscale PNG, as a Spark data source.

Each task turns its partition into one part. What only the whole can say (the number of
triangles, the check sum of all pixels) is put together from what tasks report when the job
commits: a few numbers for each task, no bytes. The parts of a folder, in the order of
their names (``cat folder/part-*``), are the file; there is no bound on its size. Folders
are paths or URIs that all executors see and Arrow's file systems know.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_ADLER = 65521


def adler_joined(a: int, b: int, length: int) -> int:
    """Adler-32 of two byte strings one after the other; ``length``: of the second."""
    low = ((a & 0xFFFF) + (b & 0xFFFF) - 1) % _ADLER
    high = ((a >> 16) + (b >> 16) + length * ((a & 0xFFFF) - 1)) % _ADLER
    return high << 16 | low


def png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


@dataclass
class Part(WriterCommitMessage):
    """What a task tells: its part's place and name, things in it, its check sum."""

    place: int
    name: str
    count: int
    size: int = 0
    check: int = 1


class _Stl:
    """Records of 50 bytes: twelve numbers and two bytes of zero."""

    KIND = np.dtype([("v", "<f4", 12), ("more", "<u2")])

    def __init__(self, options):
        self.title = options.get("title", "terrain")

    def pieces(self, batches, told: Part):
        for batch in batches:
            rows = np.zeros(batch.num_rows, self.KIND)
            for k, column in enumerate(batch.columns):
                rows["v"][:, k] = np.asarray(column)
            told.count += len(rows)
            yield rows.tobytes()

    def around(self, told: list[Part]) -> tuple[bytes, bytes]:
        return self.title.encode()[:80].ljust(80, b"\0") + struct.pack("<I", sum(t.count for t in told)), b""


class _Png:
    """Rows of pixels as deflated blocks that end at bytes, in a chunk for each part."""

    def __init__(self, options):
        self.width, self.height = int(options["width"]), int(options["height"])

    def pieces(self, batches, told: Part):
        packer = zlib.compressobj(wbits=-15)
        for batch in batches:
            new = np.asarray(batch.column("c")) == 0
            rows = np.zeros(batch.num_rows + int(new.sum()), np.uint8)  # a filter byte in front of each row
            rows[np.arange(batch.num_rows) + np.cumsum(new)] = np.asarray(batch.column("v"))
            raw = rows.tobytes()
            told.check, told.size, told.count = zlib.adler32(raw, told.check), told.size + len(raw), told.count + int(new.sum())
            if packed := packer.compress(raw):
                yield png_chunk(b"IDAT", packed)
        yield png_chunk(b"IDAT", packer.flush(zlib.Z_FULL_FLUSH))

    def around(self, told: list[Part]) -> tuple[bytes, bytes]:
        if sum(t.size for t in told) != self.height * (self.width + 1):
            raise ValueError("pixels are missing or repeated")
        check = 1
        for t in told:
            check = adler_joined(check, t.check, t.size)
        head = b"\x89PNG\r\n\x1a\n" + png_chunk(b"IHDR", struct.pack(">IIBBBBB", self.width, self.height, 8, 0, 0, 0, 0)) + png_chunk(b"IDAT", b"\x78\x9c")
        return head, png_chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", check)) + png_chunk(b"IEND", b"")


FORMATS = {"stl": _Stl, "png": _Png}


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.options = dict(options)
        self.form = FORMATS[self.options["kind"]](self.options)

    def store(self):
        return fs.FileSystem.from_uri(self.options["path"])

    def write(self, iterator) -> Part:
        task = TaskContext.get()
        store, folder = self.store()
        told = Part(task.partitionId(), f"{folder}/_task-{task.partitionId()}-{task.taskAttemptId()}", 0)
        with store.open_output_stream(told.name) as out:
            for piece in self.form.pieces(iterator, told):
                out.write(piece)
        return told

    def commit(self, messages: list) -> None:
        """Names the parts by their order, and adds what stands before and behind them."""
        told = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        store, folder = self.store()
        head, tail = self.form.around(told)
        for place, body in ((0, head), (len(told) + 1, tail)):
            with store.open_output_stream(f"{folder}/part-{place:06d}") as out:
                out.write(body)
        for k, t in enumerate(told):
            store.move(t.name, f"{folder}/part-{k + 1:06d}")
        for x in store.get_file_info(fs.FileSelector(folder)):
            if x.base_name.startswith("_task-"):  # of attempts that were lost or came second
                store.delete_file(x.path)

    def abort(self, messages: list) -> None:
        store, _ = self.store()
        for m in messages:
            if m is not None and store.get_file_info(m.name).type == fs.FileType.File:
                store.delete_file(m.name)


class Parts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orograph_parts"

    def writer(self, schema, overwrite) -> PartsWriter:
        return PartsWriter(self.options)


def _write(rows: DataFrame, path: str, **options) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(Parts)
    store, folder = fs.FileSystem.from_uri(path)
    if store.get_file_info(folder).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    store.create_dir(folder)
    rows.write.format("orograph_parts").options(path=path, **options).mode("append").save()


def write_stl(faces: DataFrame, path: str, title: str = "terrain") -> None:
    """K3: triangles with normals (``mesh.with_normal``) as a binary STL in parts."""
    numbers = [F.col(c).cast("float").alias(c) for c in ("nx", "ny", "nz")] + [F.col(f"{k}.{a}").cast("float").alias(f"{k}{a}") for k in "abc" for a in "xyz"]
    _write(faces.select(*numbers), path, kind="stl", title=title)


def write_png(pixels: DataFrame, path: str) -> None:
    """K4: pixels (r, c, v) of a whole rectangle as a greyscale PNG in parts. A row of
    pixels is in one part; an image of no pixels is refused."""
    size = pixels.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    if size.r is None:
        raise ValueError("an image of no pixels")
    rows = pixels.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("short").alias("v"))
    _write(rows.repartitionByRange("r").sortWithinPartitions("r", "c"), path, kind="png", width=size.c + 1, height=size.r + 1)


def joined(path: str) -> bytes:
    """The bytes of a folder of parts, for small files."""
    store, folder = fs.FileSystem.from_uri(path)
    names = sorted(x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.base_name.startswith("part-"))
    return b"".join(store.open_input_file(n).read() for n in names)
