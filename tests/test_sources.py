"""Files, presets, colours, parameters and the stream."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph import params
from orograph.functions import color
from orograph.operators import mesh, modes, view
from orograph.sources import images, presets, sinks
from orograph.streaming import rasters as streaming
from tests.conftest import SMALL
from tests.test_terrain import PEAK, terrain


def png(px: np.ndarray, filters) -> bytes:
    """An RGBA image whose lines use the given filters in turn."""
    h, w, n = px.shape
    flat = px.reshape(h, w * n).astype(int)
    body = b""
    for y in range(h):
        kind = filters[y % len(filters)]
        line = []
        for i in range(w * n):
            left, up = (flat[y, i - n] if i >= n else 0), (flat[y - 1, i] if y else 0)
            corner = flat[y - 1, i - n] if y and i >= n else 0
            near = left + up - corner
            paeth = min((abs(near - left), 0, left), (abs(near - up), 1, up), (abs(near - corner), 2, corner))[2]
            line.append((flat[y, i] - [0, left, up, (left + up) // 2, paeth][kind]) & 255)
        body += bytes([kind, *line])
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def tiff(a: np.ndarray, nodata: str, deflate: bool) -> bytes:
    data = a.astype("<f4").tobytes()
    data = zlib.compress(data) if deflate else data
    text, scale = nodata.encode() + b"\0", struct.pack("<3d", 10, 10, 0)
    text += b"\0" * (len(text) % 2)
    at = 8
    places = {}
    blob = b""
    for name, part in (("data", data), ("text", text), ("scale", scale)):
        places[name] = at + len(blob)
        blob += part
    h, w = a.shape
    tags = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 1, 32), (259, 3, 1, 8 if deflate else 1), (273, 4, 1, places["data"]), (277, 3, 1, 1), (278, 3, 1, h), (279, 4, 1, len(data)), (339, 3, 1, 3), (33550, 12, 3, places["scale"]), (42113, 2, len(text), places["text"])]
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + len(blob)) + blob + directory


def test_png(spark, tmp_path):
    px = np.random.default_rng(1).integers(0, 256, (9, 7, 4))
    (tmp_path / "a.png").write_bytes(png(px, [0, 1, 2, 3, 4]))
    r = images.image_raster(spark, str(tmp_path))
    assert (r.width, r.height) == (7, 9)
    for p in r.pixels.collect():
        assert p.raw == pytest.approx(px[p.r, p.c, :3].sum() / 765) and p.valid == (px[p.r, p.c, 3] >= 128)


@pytest.mark.parametrize("deflate", [False, True])
def test_tiff(spark, tmp_path, deflate):
    a = np.arange(30, dtype=float).reshape(5, 6) * 20
    a[2, 3], a[0, 0], a[4, 5] = -5, np.nan, -9999
    (tmp_path / "a.tif").write_bytes(tiff(a, "-5.0000", deflate))
    r, scale = images.elevation_raster(spark, str(tmp_path))
    assert (r.low, r.high, r.width, r.height) == (20, 560, 6, 5) and scale == pytest.approx(0.54)
    got = {(p.r, p.c): (p.raw, p.valid) for p in r.pixels.collect()}
    assert not any(got[k][1] for k in ((2, 3), (0, 0), (4, 5))) and got[0, 1] == (0.0, True) and got[4, 4] == (1.0, True)


def pack_lzw(data: bytes) -> bytes:
    table, codes, width = {bytes([i]): i for i in range(256)}, [(256, 9)], 9
    after, have = 258, b""
    for k in range(len(data)):
        more = have + data[k : k + 1]
        if more in table:
            have = more
            continue
        codes.append((table[have], width))
        table[more], after = after, after + 1
        if after + 1 > 4095:
            codes.append((256, width))
            table, after, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = max(9, after.bit_length())
        have = data[k : k + 1]
    codes += [(table[have], width), (257, max(9, (after + 1).bit_length()))]
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_packed_strips():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"aaaa" * 900, bytes(rng.integers(0, 3, 20_000, np.uint8)), bytes(rng.integers(0, 256, 9_000, np.uint8))):
        if data:
            assert images.unpack_lzw(pack_lzw(data)) == data
    assert images.unpack_bits(bytes([2, 1, 2, 3, 253, 9, 128, 0, 7])) == bytes([1, 2, 3, 9, 9, 9, 9, 7])


def test_jpeg_texture_and_several_images(spark, tmp_path):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(8, 6, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for r in range(6):
        for c in range(8):
            image.setRGB(c, r, 0x404040 if c < 4 else 0xC0C0C0)
    (tmp_path / "a").mkdir()
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "a" / "x.jpg")))
    raster = images.image_raster(spark, str(tmp_path / "a"))
    got = {(p.r, p.c): p.raw for p in raster.pixels.collect()}
    assert (raster.width, raster.height, len(got)) == (8, 6, 48) and all(abs(v - (0x40 if c < 4 else 0xC0) / 255) < 0.05 for (_, c), v in got.items())
    px = np.zeros((2, 4, 4), int)
    px[..., 0], px[1, :, 1], px[..., 3] = np.arange(4) * 60, 200, 255
    (tmp_path / "a" / "y.png").write_bytes(png(px, [0]))
    with pytest.raises(ValueError):
        images.image_raster(spark, str(tmp_path / "a"))
    places = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.3, 0.9), (2, 1.0, 1.0), (3, 0.99, 0.4)], "vid int, u double, v double")
    seen = {r.vid: r for r in images.textured(places, images.colored_pixels(spark, str(tmp_path / "a"), "*.png"), 4, 2).collect()}
    assert seen[0].texture.r == 0 and seen[0].texture.g == 200 / 255 and seen[1].texture.r == 60 / 255 and seen[1].texture.g == 0
    # the image repeats from one on
    assert seen[2].texture == seen[0].texture and seen[3].texture.r == 180 / 255 and seen[3].texture.g == 200 / 255
    half = {r.vid: r.texture.r for r in images.textured(places, images.colored_pixels(spark, str(tmp_path / "a"), "*.png"), 4, 2, scale=2, shift_x=0.5).collect()}
    assert half[0] == 120 / 255 and half[2] == 0


def test_a_preset_draws_its_raster(spark):
    import base64

    rng = np.random.default_rng(3)
    px = np.full((12, 10, 4), 255)
    px[..., :3] = rng.integers(0, 256, (12, 10, 1))
    url = "data:image/png;base64," + base64.b64encode(png(px, [0, 1])).decode()
    document = json.dumps({"terrain": {"resolution": 1, "elevScale": 0.5, "elevMinCut": 20, "elevMaxCut": 70, "jitterAmt": 2}, "style": {"enabledX": True, "spacingX": 2, "enabledContours": True, "intervalContours": 10, "hypsoX": True, "colorContours": "#ff0000"}, presets.EMBEDDED: url})
    raster = images.raster_of(images.embedded_pixels(spark.createDataFrame([("a", document), ("b", "{}")], "name string, document string")))
    assert (raster.width, raster.height) == (10, 12)
    p = presets.merged(document)
    t, s = presets.drawn(p, raster)
    assert t.meta.elev_scale == 1.5
    plain = modes.colored(modes.ridgelines(t, spacing=2, band=(20, 70), jitter=2), hypsometric=True, stops=p["style"]["gradientStops"])
    key = lambda d: sorted((round(r.x0, 6), round(r.y0, 6), round(r.z0, 6), round(r.color0.r, 6), round(r.color1.b, 6)) for r in d.collect())
    assert key(s.where("layer = 'X'")) == key(plain) != []
    assert {tuple(r.color0) for r in s.where("layer like 'Contours%'").collect()} == {(1.0, 0.0, 0.0)}


def test_load_errors():
    assert "large" in images.explain(MemoryError()) and "no elevations" in images.explain(images.NoElevation("x"))
    with pytest.raises(ValueError):
        images.read_png(b"no image")


def test_image_and_solid_files(spark, tmp_path):
    t = terrain(spark, PEAK)
    back = images.read_png(sinks.grey_png(sinks.heightmap_pixels(t)))
    assert back.shape == (3, 3, 4) and back[1, 1, 0] == 255 and back[0, 1, 0] == 102
    data = sinks.stl_bytes(mesh.with_normal(mesh.solid(t)))
    n = struct.unpack("<I", data[80:84])[0]
    assert n == 32 + 3 * 16 and len(data) == 84 + 50 * n
    with pytest.raises(ValueError):
        sinks.stl_bytes(mesh.with_normal(mesh.solid(t)), bound=3)


def test_svg(spark, tmp_path):
    t, camera = terrain(spark, PEAK), view.Camera(zoom=60, width=200, height=150)
    s = modes.colored(modes.draw(t, {"X": {"spacing": 1}}))
    runs = view.visible_runs(s, camera, view.depth_buffer(view.project_triangles(mesh.triangles(t), camera), camera), keep=("layer", "color0"))
    sinks.write_svg(sinks.svg_elements(runs, camera, weights={"X": 2}, dashes={"X": "dashed"}), view.bounds(runs), str(tmp_path / "svg"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "svg").glob("part-*")))
    assert text.startswith("<svg") and text.rstrip().endswith("</svg>") and text.count("<line") == runs.count() > 5
    assert 'stroke-width="1.000" stroke-dasharray="3 2"' in text


def test_presets(spark, tmp_path):
    one = {"terrain": {"blurRadius": 3}, "style": {"enabledY": True, "spacingY": 7}, "gradientStops": [{"pos": 0, "color": "#000000"}, {"pos": 1, "color": "#ffffff"}], presets.EMBEDDED: "data:x"}
    (tmp_path / "in").mkdir()
    for name in ("A B.json", "C.json"):
        (tmp_path / "in" / name).write_text(json.dumps(one))
    (tmp_path / "in" / "manifest.json").write_text(json.dumps(["A B.json"]))
    read = presets.read_presets(spark, str(tmp_path / "in"))
    assert [r.name for r in read.collect()] == ["A B"]
    done = json.loads(presets.migrated(read).first().document)
    assert done["terrain"]["blurRadius"] == 3 and done["terrain"]["whitePoint"] == 255 and done["style"]["spacingY"] == 7 and presets.EMBEDDED not in done
    assert presets.merged(json.dumps(one), ("style",))["terrain"]["blurRadius"] == 0
    assert presets.merged(presets.preset(presets.merged(json.dumps(one)))) == presets.merged(json.dumps(one))
    presets.write_presets(presets.migrated(read), str(tmp_path / "out"))
    assert (tmp_path / "out").exists()


def test_presets_keep_the_background_gradient():
    stops = [{"pos": 0, "color": "#102030"}, {"pos": 1, "color": "#405060"}]
    done = json.loads(presets.preset(presets.merged(json.dumps({"bgGradientStops": stops}))))
    assert done["bgGradientStops"] == stops and "bgGradientStops" not in done["style"]


def test_parameters(spark):
    style = params.style_defaults()
    assert len(style) > 150 and style["enabledX"] and not style["enabledFlow"] and style["weightStipple"] == 4 and style["majorWeightContours"] == 2
    assert params.drawing({}) == {"X": {"spacing": 4, "shift": 0}}
    with pytest.raises(ValueError):
        params.validated({"resolution": 0})
    with pytest.raises(ValueError):
        params.validated({"blackPoint": 200, "whitePoint": 201})
    t = terrain(spark, PEAK)
    every = {f"enabled{m}": True for m in params.MODES} | {f"spacing{m}": 1 for m in ("X", "Y", "Cross", "Pillars", "Hachure", "Flow", "Pencil")} | {"thresholdDag": 1}
    drawn = modes.draw(t, params.drawing(every))
    styled = mesh.layer_styles(drawn, spark.createDataFrame(params.layer_styles(every), "layer string, weight double, opacity double, dash string"))
    assert styled.where("weight is null").count() == 0 and {"X", "Y", "Cross", "Pillars", "Contours-Minor", "Dag"} <= {r.layer for r in styled.select("layer").distinct().collect()}


def test_colors(spark):
    one = spark.range(1)
    at = lambda e: one.select(e.alias("k")).first().k
    assert color.parse_hex("#ff8000") == (1, 128 / 255, 0) and color.parse_hex(None) == (0, 0, 0)
    assert tuple(at(color.hex_channels(F.lit("#ff8000")))) == (1, 128 / 255, 0)
    stops = [(1, "#ffffff"), (0, "#000000")]
    assert tuple(at(color.gradient(stops, F.lit(0.25)))) == (0.25,) * 3 and tuple(at(color.gradient(stops, F.lit(9.0)))) == (1, 1, 1)
    assert tuple(at(color.gradient([], F.lit(0.2)))) == (1, 1, 1) and tuple(at(color.gradient(stops[:1], F.lit(0.2)))) == (1, 1, 1)
    assert at(color.luminance(F.lit("#ffffff"))) == pytest.approx(255)
    given = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(c).alias("color")) for p, c in ((0.0, "#000000"), (0.5, "#888888"), (1.0, "#ffffff"))])
    pos = lambda e: [s.pos for s in at(e)]
    assert pos(color.edit_gradient(given, add=(0.25, "#111111"))) == [0, 0.25, 0.5, 1] and pos(color.edit_gradient(given, add=(0.505, "#111111"))) == [0, 0.5, 1]
    assert pos(color.edit_gradient(given, remove=1)) == [0, 1] and pos(color.edit_gradient(given, remove=0)) == [0, 0.5, 1]
    assert pos(color.edit_gradient(given, move=(1, 5.0))) == [0, 0.99, 1]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    late = events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))  # moves the watermark past all
    late.write.parquet(str(tmp_path / "in" / "b"))
    stream = streaming.event_stream(spark, str(tmp_path / "in" / "*"), 1)
    streaming.write_cells(streaming.cell_means(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.r, r.c): r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    e = events.withColumn("c", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    wanted = {(r.user_id, r.c): r.v for r in e.groupBy("user_id", "c").agg((F.sum(F.floor(F.col("value") * 100 + 0.5)).cast("double") / F.count("*")).alias("v")).collect()}
    assert got == wanted


def test_shared_tables(spark, monkeypatch):
    import os

    from pyspark import cloudpickle

    from orograph import shared

    kept = shared.cut(spark.range(5).groupBy((F.col("id") % 2).alias("k")).count())
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 2 and os.path.exists(path)
    assert spark.conf.get(shared._DROP_SHUFFLES, "false") == shared._state.before
    # functions that name the module's state go to tasks without it
    cloudpickle.dumps(shared)
    here, shared._state.written = shared._state.written, [shared._state.written[-1]]
    shared.clear(spark)
    assert not os.path.exists(path)
    shared._state.written = here

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://a"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        shared.shared_folder(Cluster)
