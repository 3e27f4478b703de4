"""Raster files: PNG and JPEG images and GeoTIFF grids, decoded in tasks, a file at a time.

The formats are compressed streams; Spark's binary reader bounds a file to 2 GB. Many
files are read in parallel, and a file's pixels leave its task in batches of rows. JPEG
images and textures come through Spark's own image source.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.operators.grid import suggested_scale
from orograph.sources.rasters import NoElevation, Raster, is_nodata, normalised

PIXELS = "path string, r int, c int, v double, valid boolean"
ROWS_AT_ONCE = 64
CHANNELS = ("red", "green", "blue", "alpha")


class TooLarge(MemoryError):
    """A raster that one task can't hold."""


def read_png(data: bytes) -> np.ndarray:
    """Rows x columns x (red, green, blue, alpha) of an 8-bit, not interlaced PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, palette, alpha = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit images that aren't interlaced")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    before = np.zeros(width * n, np.int64)
    for y, line in enumerate(lines):
        kind, x = line[0], line[1:].astype(np.int64)
        if kind == 1:  # each channel is a running sum
            x = np.cumsum(x.reshape(-1, n), axis=0).ravel()
        elif kind == 2:
            x = x + before
        elif kind in (3, 4):
            for i in range(len(x)):
                left, up, corner = (x[i - n] if i >= n else 0), before[i], (before[i - n] if i >= n else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    far = [(abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner)]
                    guess = min(far)[2]
                x[i] = (x[i] + guess) & 255
        before = x & 255
        out[y] = before
    px = out.reshape(height, width, n)
    full = np.full((height, width, 1), 255, np.uint8)
    if color == 3:
        tail = np.full(256, 255, np.uint8)
        if alpha is not None:
            tail[: len(alpha)] = alpha
        return np.concatenate([palette[px[..., 0]], tail[px[..., 0]][..., None]], axis=2)
    grey = lambda a: np.repeat(a, 3, axis=2)
    return {0: lambda: np.concatenate([grey(px), full], 2), 2: lambda: np.concatenate([px, full], 2), 4: lambda: np.concatenate([grey(px[..., :1]), px[..., 1:]], 2), 6: lambda: px}[color]()


# TIFF field types (size, format) and tags.
_FIELD = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 284: "planar", 317: "predictor", 322: "tile_w", 323: "tile_h", 324: "offsets", 325: "counts", 339: "format", 33550: "scale", 42113: "nodata"}


def unpack_bits(data: bytes) -> bytes:
    """Runs and literals: a count from 0 on announces literals, a negative one a run."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, that grow an entry early; 256 begins a new
    table, 257 ends."""
    bits, held, at = 0, 0, 0
    table: list[bytes] = []
    out, last, width = [], b"", 9
    while True:
        while bits < width and at < len(data):
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFFFF, bits + 8, at + 1
        if bits < width:
            break
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


#: How the strips of each kind of compression are read.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


@dataclass
class Tiff:
    """The first image of a TIFF: its size, the size of its blocks (strips or tiles), how
    they are stored and where."""

    width: int
    height: int
    block_w: int
    block_h: int
    kind: str
    bands: int
    compression: int
    predictor: int
    nodata: float | None
    scale: float | None
    offsets: np.ndarray | None = None
    counts: np.ndarray | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_w)

    def corner(self, k: int) -> tuple[int, int]:
        """Row and column of a block's first value."""
        return k // self.across * self.block_h, k % self.across * self.block_w

    def block(self, k: int, part: bytes) -> np.ndarray:
        """Band 0 of a block, without what lies beyond the image."""
        top, left = self.corner(k)
        block = np.frombuffer(UNPACK[self.compression](part), self.kind)
        row = self.block_w * self.bands
        block = block[: len(block) // row * row].reshape(-1, self.block_w, self.bands)
        if self.predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        return block[: self.height - top, : self.width - left, 0]


def tiff_header(read) -> Tiff:
    """The header of a TIFF or BigTIFF; ``read`` returns (from, number) bytes of it."""
    start = read(0, 16)
    order = {b"II": "<", b"MM": ">"}[start[:2]]
    one = lambda form, data: struct.unpack(order + form, data)
    big = one("H", start[2:4])[0] == 43
    word, number, entry, held = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    at = one(word, start[8:16] if big else start[4:8])[0]
    n = struct.calcsize(number)
    total = one(number, read(at, n))[0]
    directory = read(at + n, entry * total)
    tags: dict = {}
    for k in range(total):
        item = directory[entry * k : entry * (k + 1)]
        tag, kind, count = one("HH" + word, item[: entry - held])
        if tag in _TAGS and kind in _FIELD:
            size, form = _FIELD[kind]
            raw = item[entry - held :] if size * count <= held else read(one(word, item[entry - held :])[0], size * count)
            raw = raw[: size * count]
            tags[_TAGS[tag]] = raw.rstrip(b"\0 ").decode() if kind == 2 else np.frombuffer(raw, f"{order}u4" if form == "II" else order + np.dtype(form).str[1:])
    get = lambda name, default: int(tags[name][0]) if name in tags else default
    width, height = get("width", 0), get("height", 0)
    kind = {1: "u", 2: "i", 3: "f"}[get("format", 1)] + str(get("bits", 8) // 8)
    compression, predictor = get("compression", 1), get("predictor", 1)
    if compression not in UNPACK or predictor not in (1, 2):
        raise ValueError("a kind of compression that isn't known")
    tiled = "tile_w" in tags
    return Tiff(
        width, height, get("tile_w", 0) if tiled else width, get("tile_h", 0) if tiled else min(height, get("rows", height)), order + kind, get("samples", 1) if get("planar", 1) == 1 else 1,
        compression, predictor, float(tags["nodata"]) if tags.get("nodata") else None, float(tags["scale"][0]) if "scale" in tags else None, tags["offsets"], tags["counts"],
    )


def read_tiff(data: bytes) -> tuple[np.ndarray, float | None, float | None]:
    """Band 0 of the first image, the declared NoData value and the pixel's width. Strips
    or tiles that are not compressed, deflated, or packed by LZW or PackBits."""
    t = tiff_header(lambda at, n: data[at : at + n])
    if t.width * t.height > 1 << 30:
        raise TooLarge("the raster is too large for one task")
    out = np.zeros((t.height, t.width))
    for k, (offset, count) in enumerate(zip(t.offsets.tolist(), t.counts.tolist())):
        top, left = t.corner(k)
        if top >= t.height:
            break  # further bands
        block = t.block(k, data[offset : offset + count])
        out[top : top + block.shape[0], left : left + block.shape[1]] = block
    return out, t.nodata, t.scale


def _rows(path: str, v: np.ndarray, valid: np.ndarray):
    for top in range(0, v.shape[0], ROWS_AT_ONCE):
        part, ok = v[top : top + ROWS_AT_ONCE], valid[top : top + ROWS_AT_ONCE]
        r, c = np.indices(part.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array([path] * part.size), pa.array((r + top).ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.array(part.ravel().astype(float)), pa.array(ok.ravel())],
            ["path", "r", "c", "v", "valid"],
        )


def _pngs(batches):
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            px = read_png(data).astype(float)
            yield from _rows(path, px[..., :3].sum(axis=2) / (3 * 255), px[..., 3] >= 128)


def _tiffs(batches):
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            v, nodata, _ = read_tiff(data)
            yield from _rows(path, v, np.ones(v.shape, bool) if nodata is None else v != nodata)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def png_pixels(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(path, r, c, v, valid) of images; v is the mean of the colours, and pixels of
    less than half opacity hold no data."""
    return _files(spark, path, pattern).mapInArrow(_pngs, PIXELS)


def tiff_values(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff,geotiff}") -> DataFrame:
    """The same of GeoTIFF files; v is the value of band 0."""
    return _files(spark, path, pattern).mapInArrow(_tiffs, PIXELS)


def _decoded(batches):
    """Colours of Spark's image rows, which are stored blue first."""
    for batch in batches:
        for x in batch.column("image").to_pylist():
            px = np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], x["nChannels"])
            px = np.repeat(px, 3, axis=2) if x["nChannels"] == 1 else px
            alpha = px[..., 3:] if px.shape[2] == 4 else np.full((*px.shape[:2], 1), 255, np.uint8)
            colors = np.concatenate([px[..., 2::-1], alpha], axis=2) / 255
            for top in range(0, px.shape[0], ROWS_AT_ONCE):
                part = colors[top : top + ROWS_AT_ONCE]
                r, c = np.indices(part.shape[:2])
                columns = [pa.array((r + top).ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), *(pa.array(part[..., k].ravel()) for k in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array([x["origin"]] * len(columns[0])), *columns], ["path", "r", "c", "red", "green", "blue", "alpha"])


def colored_pixels(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """(path, r, c, red, green, blue, alpha), each from 0 to 1, of images."""
    images = spark.read.format("image").option("pathGlobFilter", pattern).load(path)
    return images.mapInArrow(_decoded, "path string, r int, c int, red double, green double, blue double, alpha double")


def jpeg_pixels(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg}") -> DataFrame:
    """(path, r, c, v, valid) of JPEG images, as of PNG ones."""
    px = colored_pixels(spark, path, pattern)
    return px.select("path", "r", "c", ((F.col("red") + F.col("green") + F.col("blue")) / 3).alias("v"), (F.col("alpha") >= 128 / 255).alias("valid"))


def embedded_pixels(presets: DataFrame, key: str = "heightmapDataURL") -> DataFrame:
    """The pixels of the PNG that a preset (name, document) carries; path is its name."""
    url = F.get_json_object("document", f"$.{key}")
    held = presets.where(url.startswith("data:image/png;base64,")).select(F.col("name").alias("path"), F.unbase64(F.substring_index(url, ",", -1)).alias("content"))
    return held.mapInArrow(_pngs, PIXELS)


def raster_of(px: DataFrame) -> Raster:
    """The pixels (path, r, c, v, valid) of one image as a raster; those of several are
    refused, since they would lie on each other."""
    size = px.agg((F.max("c") + 1).alias("w"), (F.max("r") + 1).alias("h"), F.min("path").alias("a"), F.max("path").alias("b")).first()
    if size.w is None:
        raise NoElevation("no image")
    if size.a != size.b:
        raise ValueError("more than one image")
    return Raster(px.select("r", "c", F.col("v").alias("raw"), "valid"), size.w, size.h)


def image_raster(spark: SparkSession, path: str) -> Raster:
    """One PNG or JPEG as a raster."""
    return raster_of(png_pixels(spark, path).unionByName(jpeg_pixels(spark, path)))


def textured(vertices: DataFrame, pixels: DataFrame, width: int, height: int, scale: float = 1, shift_x: float = 0, shift_y: float = 0) -> DataFrame:
    """``vertices`` (with u, v from 0 to 1) with the struct texture (r, g, b) and its alpha:
    the pixel of an image (r, c, red, green, blue, alpha) there. The image is repeated;
    a larger scale draws it larger; v runs up."""
    turn = lambda x, shift: F.pmod(F.col(x) / float(scale or 1) + float(shift), F.lit(1.0))
    at = lambda x, n: F.least(F.lit(n - 1), F.floor(x * n)).cast("int")
    placed = vertices.withColumns({"_c": at(turn("u", shift_x), width), "_r": height - 1 - at(turn("v", shift_y), height)})
    image = pixels.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.struct(F.col("red").alias("r"), F.col("green").alias("g"), F.col("blue").alias("b")).alias("texture"), "alpha")
    return placed.join(image, ["_r", "_c"]).drop("_r", "_c")


def _level(pixels: DataFrame, width: int, height: int, k: int) -> tuple[DataFrame, int, int]:
    """An image at a level: each pixel the mean of those that fall to it when sizes are
    halved ``k`` times; what is left over at an end belongs to the last."""
    r, c = F.col("r"), F.col("c")
    for _ in range(k):
        width, height = max(1, width // 2), max(1, height // 2)
        r, c = F.least(F.lit(height - 1), F.shiftright(r, 1)), F.least(F.lit(width - 1), F.shiftright(c, 1))
    if not k:
        return pixels.select("r", "c", *CHANNELS), width, height
    return pixels.select(r.alias("r"), c.alias("c"), *CHANNELS).groupBy("r", "c").agg(*[F.avg(n).alias(n) for n in CHANNELS]), width, height


def _four_taps(level: DataFrame, width: int, height: int) -> DataFrame:
    """(r, c, taps): a pixel, the one to its right, and the two below, around the ends."""
    taps = F.array(*[F.struct(F.pmod(F.col("r") - i, F.lit(height)).alias("r"), F.pmod(F.col("c") - j, F.lit(width)).alias("c"), F.lit(2 * i + j).alias("n")) for i in (0, 1) for j in (0, 1)])
    each = level.select(F.struct(*CHANNELS).alias("p"), F.explode(taps).alias("t"))
    return each.groupBy("t.r", "t.c").agg(*[F.max(F.when(F.col("t.n") == n, F.col("p"))).alias(f"p{n}") for n in range(4)])


def smoothly_textured(vertices: DataFrame, pixels: DataFrame, width: int, height: int, scale: float = 1, shift_x: float = 0, shift_y: float = 0, *, apart: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``textured``, but by the weighted mean of the four pixels around a place. If vertices
    lie more than a pixel apart (``apart``: the differences of u and of v from one to the
    next), it is taken from smaller levels of the image, and between the two that are
    nearest in size. A join for each level, and the image is aggregated once for it; Spark
    broadcasts small images."""
    scale = float(scale or 1)
    step = max(abs(apart[0]) / abs(scale) * width, abs(apart[1]) / abs(scale) * height)
    detail = min(max(0.0, math.log2(step)) if step > 0 else 0.0, math.floor(math.log2(max(width, height))))
    low = math.floor(detail)
    shares = [(low, 1 - (detail - low))] + ([(low + 1, detail - low)] if detail > low else [])
    placed, sums = vertices, {n: F.lit(0.0) for n in CHANNELS}
    for k, share in shares:
        level, w, h = _level(pixels, width, height, k)
        x = (F.col("u") / scale + float(shift_x)) * w - 0.5
        y = (1 - (F.col("v") / scale + float(shift_y))) * h - 0.5
        placed = placed.withColumns({"_c": F.pmod(F.floor(x), F.lit(w)).cast("int"), "_r": F.pmod(F.floor(y), F.lit(h)).cast("int"), f"_x{k}": x - F.floor(x), f"_y{k}": y - F.floor(y)})
        taps = _four_taps(level, w, h).select(F.col("r").alias("_r"), F.col("c").alias("_c"), *[F.col(f"p{n}").alias(f"_p{k}{n}") for n in range(4)])
        placed = placed.join(taps, ["_r", "_c"]).drop("_r", "_c")
        fx, fy = F.col(f"_x{k}"), F.col(f"_y{k}")
        for name in CHANNELS:
            p = [F.col(f"_p{k}{n}")[name] for n in range(4)]
            sums[name] = sums[name] + ((p[0] * (1 - fx) + p[1] * fx) * (1 - fy) + (p[2] * (1 - fx) + p[3] * fx) * fy) * share
    texture = F.struct(*[sums[n].alias(n[0]) for n in CHANNELS[:3]]).alias("texture")
    return placed.select(*vertices.columns, texture, sums["alpha"].alias("alpha"))


def elevation_raster(spark: SparkSession, path: str) -> tuple[Raster, float | None]:
    """One GeoTIFF as a raster, and a suggested vertical scale."""
    values = tiff_values(spark, path)
    if values.select("path").distinct().count() > 1:
        raise ValueError("more than one raster")
    r = normalised(spark, values.select("r", "c", F.when(F.col("valid") & ~is_nodata(F.col("v")), F.col("v")).alias("v")))
    width = _files(spark, path, "*.{tif,tiff,geotiff}").mapInArrow(_scales, "w double").first()
    return r, suggested_scale(r.high - r.low, width.w if width else None)


def _scales(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([read_tiff(d)[2] for d in batch.column("content").to_pylist()], pa.float64())], ["w"])


def explain(error: Exception) -> str:
    """What to tell a user about a raster that can't be loaded."""
    if isinstance(error, (TooLarge, MemoryError)):
        return "The raster is too large."
    if isinstance(error, NoElevation):
        return "The raster holds no elevations."
    return f"The raster can't be read: {error}"
