"""GeoTIFF files by blocks: equal to the whole read, only the blocks that are asked for."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.sources import images, scan


def tiff(path, a, block, tiled, compression=8, predictor=1, big=False, order="<", repeat=None):
    """Writes a TIFF of strips or tiles. ``repeat``: (height, width) of a raster whose tiles
    are all the one tile ``a``."""
    h, w = repeat or a.shape
    bh, bw = block if tiled else (block[0], w)
    blocks = []
    for r in range(0, h, bh):
        for c in range(0, w, bw):
            if repeat and blocks:
                blocks.append(None)
                continue
            part = a[r : r + bh, c : c + bw]
            part = np.pad(part, ((0, bh - part.shape[0] if tiled else 0), (0, bw - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part.dtype.type(0))
            raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
            blocks.append(zlib.compress(raw) if compression == 8 else raw)
    word, at, offsets, counts = ("Q" if big else "I"), 16, [], []
    for b in blocks:
        offsets.append(offsets[-1] if b is None else at)
        counts.append(counts[-1] if b is None else len(b))
        at += len(b or b"")
    n = len(blocks)
    lists = struct.pack(f"{order}{n}{word}", *offsets), struct.pack(f"{order}{n}{word}", *counts)
    kind = 16 if big else 4
    size = [(322, 4, 1, bw), (323, 4, 1, bh)] if tiled else [(278, 4, 1, bh)]
    places = (324, 325) if tiled else (273, 279)
    form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8 * a.dtype.itemsize), (259, 3, 1, compression), (277, 3, 1, 1), (317, 3, 1, predictor), (339, 3, 1, form), *size, (places[0], kind, n, at), (places[1], kind, n, at + len(lists[0])), (42113, 2, 2, None)]
    held = 8 if big else 4

    def value(tag, kind, count, v):
        if v is None:
            return b"7\0".ljust(held, b"\0")
        if count == 1 and tag in places:
            v = {places[0]: offsets, places[1]: counts}[tag][0]
        short = kind == 3
        return struct.pack(order + ("H" if short else "I" if kind == 4 else "Q"), v).ljust(held, b"\0")

    entries = b"".join(struct.pack(f"{order}HH{word}", t, k, c) + value(t, k, c, v) for t, k, c, v in sorted(tags))
    directory = struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + struct.pack(order + word, 0)
    start = at + len(lists[0]) + len(lists[1])
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, start) if big else struct.pack(order + "HI", 42, start) + bytes(8))
    path.write_bytes(head + b"".join(b or b"" for b in blocks) + lists[0] + lists[1] + directory)


@pytest.mark.parametrize("tiled, kind, predictor, big, order", [(True, "<f4", 1, False, "<"), (True, "<u2", 2, True, "<"), (False, "<i2", 2, False, ">"), (False, "<f8", 1, True, "<"), (True, "|u1", 2, False, ">")])
def test_blocks_give_the_whole(spark, tmp_path, tiled, kind, predictor, big, order):
    a = np.random.default_rng(3).integers(0, 50, (75, 61)).astype(kind)
    tiff(tmp_path / "a.tif", a, (16, 32), tiled, predictor=predictor, big=big, order=order)
    whole, nodata, _ = images.read_tiff((tmp_path / "a.tif").read_bytes())
    assert np.array_equal(whole, a) and nodata == 7
    got = scan.tiff_values(spark, str(tmp_path), values=600)
    assert got.rdd.getNumPartitions() >= 5
    rows = {(r.r, r.c): (r.v, r.valid) for r in got.collect()}
    assert rows == {(r, c): (float(a[r, c]), a[r, c] != 7) for r in range(75) for c in range(61)}
    same = images.tiff_values(spark, str(tmp_path))
    assert got.drop("path").exceptAll(same.drop("path")).isEmpty()


def test_a_window_of_a_large_file_reads_its_tiles_only(spark, tmp_path):
    """20,000 x 20,000 values in tiles of 256."""
    tile = np.arange(65_536, dtype="<u2").reshape(256, 256)
    tiff(tmp_path / "a.tif", tile, (256, 256), True, repeat=(20_000, 20_000))
    path = str(tmp_path / "a.tif")
    reader = scan.TiffReader({"path": path})
    every = reader.partitions()
    assert sum(len(p.numbers) for p in every) == 79 * 79 and len(every) > 90
    reader = scan.TiffReader({"path": path, "r0": 5000, "c0": 19_900, "r1": 5300, "c1": 30_000})
    assert sum(len(p.numbers) for p in reader.partitions()) == 2 * 2
    got = scan.tiff_values(spark, path, (5000, 19_900, 5300, 30_000))
    assert got.count() == 301 * 100
    assert got.agg(F.sum("v")).first()[0] == sum(float(tile[r % 256, c % 256]) for r in range(5000, 5301) for c in range(19_900, 20_000))
    pushed = scan.tiff_values(spark, path).where("r >= 5000 and r < 5301 and c > 19899")
    assert pushed.rdd.getNumPartitions() == 1 and pushed.count() == 301 * 100
    assert scan.tiff_values(spark, path).where("r > 20000").count() == 0


def test_filters_and_folders(spark, tmp_path):
    a = np.arange(40 * 40, dtype="<f4").reshape(40, 40)
    for n in ("a.tif", "b.TIFF"):
        tiff(tmp_path / n, a, (16, 16), True)
    (tmp_path / "c.txt").write_text("x")
    got = scan.tiff_values(spark, str(tmp_path))
    assert sorted({r.path.rsplit("/", 1)[1] for r in got.select("path").distinct().collect()}) == ["a.tif", "b.TIFF"] and got.count() == 3200
    assert [r.v for r in got.where("r = 17 and c = 3 and path like '%a.tif'").collect()] == [17 * 40 + 3]
    assert got.where("v > 1590 and r <= 39").count() == 18
    (tmp_path / "none").mkdir()
    assert scan.tiff_values(spark, str(tmp_path / "none")).count() == 0
