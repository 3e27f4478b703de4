"""Files in parts: the same bytes as in one piece, check sums, failures."""

import os
import zlib

import numpy as np
import pytest

from orograph.operators import grid, mesh
from orograph.sources import images, parts, sinks


def terrain(spark, rows, cols):
    rng = np.random.default_rng(rows)
    return grid.build_terrain(spark.createDataFrame([(r, c, float(rng.random()), True) for r in range(rows) for c in range(cols)], "r int, c int, raw double, valid boolean").repartition(5), cols, rows)


def test_sums_of_joined_strings():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.bytes(int(rng.integers(0, 9000))), rng.bytes(int(rng.integers(0, 200_000)))
        assert parts.adler_joined(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_stl_in_parts(spark, tmp_path):
    faces = mesh.with_normal(mesh.solid(terrain(spark, 9, 7)))
    parts.write_stl(faces.repartition(4), str(tmp_path / "a"), "hills")
    got, want = parts.joined(str(tmp_path / "a")), sinks.stl_bytes(faces, "hills")
    records = lambda b: sorted(b[84 + 50 * k : 134 + 50 * k] for k in range((len(b) - 84) // 50))
    assert got[:84] == want[:84] and len(got) == len(want) and records(got) == records(want)
    assert sorted(os.listdir(tmp_path / "a"))[0] == "part-000000" and not [n for n in os.listdir(tmp_path / "a") if n.startswith("_task")]
    with pytest.raises(FileExistsError):
        parts.write_stl(faces, str(tmp_path / "a"))


@pytest.mark.parametrize("size", [(9, 7), (1, 1), (300, 40)])
def test_png_in_parts(spark, tmp_path, size):
    pixels = sinks.heightmap_pixels(terrain(spark, *size))
    parts.write_png(pixels, str(tmp_path / "a"))
    data = parts.joined(str(tmp_path / "a"))
    assert np.array_equal(images.read_png(data), images.read_png(sinks.grey_png(pixels)))
    body, at = b"", 8
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        body += data[at + 8 : at + 8 + n] * (data[at + 4 : at + 8] == b"IDAT")
        at += 12 + n
    assert len(zlib.decompress(body)) == size[0] * (size[1] + 1)  # its check sum is that of all rows


def test_missing_pixels_leave_no_file(spark, tmp_path):
    pixels = sinks.heightmap_pixels(terrain(spark, 9, 7))
    with pytest.raises(Exception, match="missing or repeated"):
        parts.write_png(pixels.where("r <> 3 or c <> 2"), str(tmp_path / "a"))
    assert not [n for n in os.listdir(tmp_path / "a") if n.startswith("part-")]
    with pytest.raises(ValueError):
        parts.write_png(pixels.limit(0), str(tmp_path / "b"))
