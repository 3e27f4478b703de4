"""Smooth textures, the surface's parameters, particles by rules, presets by variants, versions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph import params
from orograph.operators import grid, points, sequential, shade, view
from orograph.sources import images, presets
from orograph.sources.rasters import Raster
from orograph.sources.versions import History


def _levels(image):
    """An image and its smaller levels, each pixel the mean of those that fall to it."""
    h, w = image.shape[:2]
    place = [np.arange(h), np.arange(w)]
    out = [image]
    while max(h, w) > 1:
        h, w = max(1, h // 2), max(1, w // 2)
        place = [np.minimum(p // 2, n - 1) for p, n in zip(place, (h, w))]
        level = np.zeros((h, w, 4))
        for i in range(h):
            for j in range(w):
                level[i, j] = image[place[0] == i][:, place[1] == j].reshape(-1, 4).mean(axis=0)
        out.append(level)
    return out


def _tap(level, u, v):
    h, w = level.shape[:2]
    x, y = u * w - 0.5, (1 - v) * h - 0.5
    j, i = math.floor(x), math.floor(y)
    at = lambda a, b: level[a % h, b % w]
    return (at(i, j) * (1 - x + j) + at(i, j + 1) * (x - j)) * (1 - y + i) + (at(i + 1, j) * (1 - x + j) + at(i + 1, j + 1) * (x - j)) * (y - i)


@pytest.mark.parametrize("scale", [0.3, 1, 3])
@pytest.mark.parametrize("shape", [(5, 8), (1, 3)])
def test_smooth_texture(spark, scale, shape):
    h, w = shape
    image = np.random.default_rng(h).integers(0, 256, (h, w, 4)) / 255
    px = spark.createDataFrame([(r, c, *map(float, image[r, c])) for r in range(h) for c in range(w)], "r int, c int, red double, green double, blue double, alpha double")
    rows, cols = 4, 5
    at = {r * cols + c: (c / (cols - 1), 1 - r / (rows - 1)) for r in range(rows) for c in range(cols)}
    vertices = spark.createDataFrame([(k, *map(float, uv)) for k, uv in at.items()], "vid int, u double, v double")
    apart = (1 / (cols - 1), 1 / (rows - 1))
    got = {r.vid: r for r in images.smoothly_textured(vertices, px, w, h, scale, 0.1, -0.2, apart=apart).collect()}
    assert got.keys() == at.keys()
    detail = max(0.0, math.log2(max(apart[0] * w, apart[1] * h) / scale))
    levels = _levels(image)
    detail = min(detail, len(levels) - 1)
    low = math.floor(detail)
    for vid, (u, v) in at.items():
        place = (u / scale + 0.1, v / scale - 0.2)
        wanted = _tap(levels[low], *place) * (1 - detail + low) + (_tap(levels[low + 1], *place) * (detail - low) if detail > low else 0)
        assert np.allclose([*got[vid].texture, got[vid].alpha], wanted, atol=1e-12)


def test_smooth_texture_in_the_middle_of_a_pixel_is_the_nearest(spark):
    px = spark.createDataFrame([(r, c, r / 2, c / 4, 0.5, 1.0) for r in range(2) for c in range(4)], "r int, c int, red double, green double, blue double, alpha double")
    v = spark.createDataFrame([(c, (c + 0.5) / 4, 0.25) for c in range(4)], "vid int, u double, v double")
    near, smooth = ({r.vid: r.texture for r in f(v, px, 4, 2).collect()} for f in (images.textured, images.smoothly_textured))
    assert near == smooth


def _color(spark, style, b=0.62, n=(0.6, 0.0, 0.8), **options):
    row = spark.range(1).select(shade.surface(style, F.lit(b), *map(F.lit, map(float, n)), **options).alias("k")).first()
    return None if row.k is None else tuple(row.k)


def test_surface_parameters(spark):
    assert _color(spark, {}) is None
    assert _color(spark, {"showFill": True, "fillColor": "#ff0000"}) == (1, 0, 0)
    assert _color(spark, {"showFill": True, "fillColor": None}) == (1, 1, 1)
    # an upper limit of 0 is none
    assert _color(spark, {"showFill": True}, terrain={"elevMaxCut": 0}) == (1, 1, 1)
    assert _color(spark, {"showFill": True}, terrain={"elevMaxCut": 60}) is None
    ramp = {"showFill": True, "fillHypsometric": True, "gradientStops": [(0, "#000000"), (1, "#ffffff")]}
    assert _color(spark, ramp) == (158 / 255,) * 3
    # an interval of 0 is 10
    assert _color(spark, ramp | {"fillBanded": True, "fillHypsoInterval": 0}) == _color(spark, ramp | {"fillBanded": True, "fillHypsoInterval": 10}) == (153 / 255,) * 3
    assert _color(spark, ramp | {"gradientStops": [(0, "#000000")]}) == (1, 1, 1)
    assert _color(spark, ramp | {"fillHypsoMode": "slope"}) == (1, 1, 1)
    steep = _color(spark, {"showFill": True, "showSlopeShade": True})
    assert steep == pytest.approx([0.25 + 0.75 * x for x in (220 / 255, 38 / 255, 38 / 255)])
    tex = shade.rgb((0.2, 0.4, 0.8))
    assert _color(spark, {"showFill": True, "showTexture": True, "textureBlendMode": "multiply", "textureOpacity": 0.5}, texture=tex) == pytest.approx((0.6, 0.7, 0.9))
    assert _color(spark, {"showFill": True, "showTexture": True, "textureBlendMode": "?"}, texture=tex, alpha=0.5) == pytest.approx((0.6, 0.7, 0.9))
    soft = [_color(spark, {"showFill": True, "fillColor": "#808080", "showTexture": True, "textureBlendMode": m}, texture=tex) for m in ("softlight", "soft-light")]
    assert soft[0] == soft[1]
    up = _color(spark, {"showFill": True}, n=(0, 1, 0), raw=True)
    assert up == pytest.approx((0.7 * 2 / math.sqrt(7.25) + 0.15 * 0.5 / math.sqrt(1.5) + 0.2,) * 3)


def test_a_camera_from_above_has_the_ground_towards_it(spark):
    seen = view.view_normal(view.Camera(tilt=0, rotation=0), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    row = spark.range(1).select(*[x.alias(n) for x, n in zip(seen, "xyz")]).first()
    assert row.z > 0.999 and abs(row.x) < 1e-9 and abs(row.y) < 1e-4


def test_many_steps_in_one_plan(spark):
    p = spark.createDataFrame([(r, c, float(r), 5.0 + c, float(c)) for r in range(4) for c in range(3)], "r int, c int, x double, y double, z double")
    rest = points.at_rest(p)
    far = points.advanced(rest, 500, points.spring())
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(far) - size(points.advanced(rest, 5, points.spring())) < 10
    key = lambda df: {(r.r, r.c): r for r in df.collect()}
    # the same as step by step, also from the middle on
    by_step = points.animate(rest, 24, lambda q, k: points.spring_step(q, k))
    assert key(points.advanced(rest, 24, points.spring())) == key(by_step) == key(points.advanced(points.advanced(rest, 10, points.spring()), 14, points.spring(), 10))
    # 500 steps against numbers drawn one by one
    draws = {(r.r, r.c, r.k): r.u for r in p.crossJoin(spark.range(1, 1501).withColumnRenamed("id", "k")).select("r", "c", "k", points.uniform(F.col("r"), F.col("c"), F.col("k")).alias("u")).collect()}
    for at, row in key(far).items():
        home = [float(at[0]), 5.0 + at[1], float(at[1])]
        x, v = list(home), [0.0] * 3
        for step in range(500):
            for i in range(3):
                v[i] = (v[i] + (home[i] - x[i]) * 0.04 + (draws[(*at, 1 + 3 * step + i)] - 0.5) * 0.4) * 0.92
                x[i] += v[i]
        assert [row.x, row.y, row.z] == x
    assert points.advanced(rest, 0, points.spring()) is rest
    assert points.advanced(rest, 400, points.gravity(-1.0)).where("y != -1 OR vy != 0").isEmpty()


def test_presets_by_variants(spark):
    given = {
        "lacks all": "{}", "none": None, "empty parts": json.dumps({"terrain": None, "style": {}, "gradientStops": []}),
        "own": json.dumps({"terrain": {"blurRadius": 3, "other": [1, {"a": None}]}, "style": {"colorX": None, "weightX": 2.5, "enabledY": True}, "points": {"pointColor": 'a"b'}, "extra": 1}),
        "stops": json.dumps({"gradientStops": [{"pos": 0, "color": "#000000", "id": 7}, {"pos": 0.125, "color": "#ffffff"}], "bgGradientStops": [{"pos": 1, "color": "#010203"}], presets.EMBEDDED: "data:x"}),
    }
    df = spark.createDataFrame(list(given.items()), "name string, document string")
    for only in (tuple(presets.PARTS), ("style",)):
        done = presets.with_defaults(df, only)
        assert "Python" not in done._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
        for row in done.collect():
            d = given[row.name]
            assert (d is None and row.document is None) or json.loads(row.document) == json.loads(presets.preset(presets.merged(d, only)))
    with pytest.raises(Exception):
        presets.migrated(spark.createDataFrame([("x", "{")], "name string, document string")).collect()
    assert presets.migrated(df.limit(0)).count() == 0
    assert set(params.POINTS) == set(json.loads(presets.migrated(df.where("name = 'lacks all'")).first().document)["points"])


def _heights(raster):
    return {(p.r, p.c): p.raw for p in raster.pixels.collect()}


def test_erode_undo_erode(spark, tmp_path):
    px = spark.createDataFrame([(r, c, (r * 31 + c * 17) % 23 / 23, True) for r in range(12) for c in range(10)], "r int, c int, raw double, valid boolean")
    history = History(spark, f"file://{tmp_path}/history")
    assert not history.undo() and not history.redo() and history.log().count() == 0
    with pytest.raises(ValueError):
        history.raster()
    history.save(Raster(px, 10, 12, -5.0, 95.0))
    start = _heights(history.raster())
    assert not history.undo()
    rain = lambda px, w, h: sequential.erode(px, w, h, droplets=60, batches=2)
    assert history.apply(rain, "rain") == 1
    once = _heights(history.raster())
    history.apply(rain)
    twice = _heights(history.raster())
    assert start != once != twice
    assert history.undo() and _heights(history.raster()) == once
    assert history.undo() and _heights(history.raster()) == start and not history.undo()
    assert history.redo() and _heights(history.raster()) == once
    assert history.redo() and _heights(history.raster()) == twice and not history.redo()
    # a step after a step back is another branch; what was taken back stays
    history.undo(), history.undo()
    assert history.apply(rain) == 3 and _heights(history.raster()) == once
    assert _heights(history.raster(2)) == twice and (history.raster().low, history.raster().high) == (-5.0, 95.0)
    # another session sees the same; a table without a row in the log is not a version
    px.write.parquet(f"file://{tmp_path}/history/version=4")
    assert _heights(History(spark, f"file://{tmp_path}/history").raster()) == once
    with pytest.raises(ValueError):
        history.raster(4)


def test_terrain_of_nothing(spark):
    """The range is taken while cells are written, also where there are none."""
    kind = "r int, c int, raw double, valid boolean"
    for rows, size in (([], 0), ([(0, 0, 0.0, False), (0, 1, 0.0, False)], 2)):
        t = grid.build_terrain(spark.createDataFrame(rows, kind), size, min(size, 1))
        assert t.cells.count() == size and t.meta.max_slope == 0 and (t.meta.min_z, t.meta.max_z) == (50, -50)
