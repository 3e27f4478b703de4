"""Presets: parameter documents in JSON, by file, merged with defaults, written back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph import params
from orograph.operators import modes
from orograph.operators.grid import Terrain, build_terrain
from orograph.sources.rasters import Raster

PARTS = {"terrain": params.TERRAIN, "style": None, "points": params.POINTS, "view": params.VIEW}
EMBEDDED = "heightmapDataURL"
GRADIENT_KEYS = ("gradientStops", "bgGradientStops")
STOPS = "array<struct<pos: variant, color: variant>>"
BACKGROUND = [(0, "#ffffff"), (1, "#cccccc")]


def read_presets(spark: SparkSession, folder: str, manifest: str | None = "manifest.json") -> DataFrame:
    """(name, document) of the presets that a manifest lists, or of all JSON files."""
    if manifest:
        names = spark.read.text(f"{folder}/{manifest}", wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("file"))
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("document"))
    # names in a file's path are encoded
    files = files.withColumn("file", F.url_decode(F.regexp_replace("file", r"\+", "%2B")))
    listed = files.join(names, "file", "left_semi") if manifest else files
    return listed.select(F.regexp_replace("file", r"\.json$", "").alias("name"), "document")


def merged(document: str, only: tuple[str, ...] = tuple(PARTS)) -> dict:
    """A preset's parameters over the defaults. A gallery applies style and
    gradients alone (``only`` = ("style",))."""
    given = json.loads(document)
    out = {}
    for part, defaults in PARTS.items():
        base = params.style_defaults() if defaults is None else defaults
        out[part] = base | (given.get(part) or {} if part in only else {})
    stops = given.get("gradientStops")
    if stops:
        out["style"]["gradientStops"] = [(s["pos"], s["color"]) for s in stops]
    stops = given.get("bgGradientStops")
    out["style"]["bgGradientStops"] = [(s["pos"], s["color"]) for s in stops] if stops else BACKGROUND
    return out


def preset(p: dict, image_url: str | None = None) -> str:
    """K6: a preset of parameters (as of ``merged``)."""
    stops = {k: [{"pos": a, "color": c} for a, c in p["style"].get(k, BACKGROUND)] for k in GRADIENT_KEYS}
    style = {k: v for k, v in p["style"].items() if k not in stops}
    made = {"terrain": p["terrain"], "style": style, "points": p["points"], "view": p["view"]} | stops
    return json.dumps(made | ({EMBEDDED: image_url} if image_url else {}), indent=2)


def with_defaults(presets: DataFrame, only: tuple[str, ...] = tuple(PARTS)) -> DataFrame:
    """(name, document) of presets over the defaults, as ``preset(merged(...))`` makes
    one, by Spark's variants alone. What a preset has beside its parts and gradients goes,
    the embedded image too. No document (null) stays none; one that isn't JSON is refused."""
    given, objects = F.parse_json("document"), "map<string,variant>"
    literal = lambda value, kind: F.variant_get(F.parse_json(F.lit(json.dumps(value))), "$", kind)
    parts = []
    for part, defaults in PARTS.items():
        base = literal(params.style_defaults() if defaults is None else defaults, objects)
        if part in only:
            own = F.coalesce(F.try_variant_get(given, f"$.{part}", objects), literal({}, objects))
            base = F.map_zip_with(base, own, lambda k, default, value: F.coalesce(value, default))
        if part == "style":
            base = F.map_filter(base, lambda k, v: ~k.isin(*GRADIENT_KEYS))
        parts.append(base.alias(part))
    for key, stops in zip(GRADIENT_KEYS, (params.style_defaults()["gradientStops"], BACKGROUND)):
        own = F.try_variant_get(given, f"$.{key}", STOPS)
        parts.append(F.when(F.size(own) > 0, own).otherwise(literal([{"pos": a, "color": c} for a, c in stops], STOPS)).alias(key))
    return presets.select("name", F.when(F.col("document").isNotNull(), F.to_json(F.struct(*parts))).alias("document"))


def migrated(presets: DataFrame) -> DataFrame:
    """K7: presets with what they lack filled in and no embedded image."""
    return with_defaults(presets)


def drawn(p: dict, raster: Raster, base_scale: float = 1.0) -> tuple[Terrain, DataFrame]:
    """The terrain and the coloured segments that a preset (as of ``merged``) makes of a
    raster: its levels, blur, scale, elevation band, jitter, modes and colours."""
    t = build_terrain(raster.pixels, raster.width, raster.height, **params.terrain_options(p["terrain"], base_scale))
    return t, modes.colored_layers(modes.draw(t, params.drawing(p["style"], p["terrain"])), params.coloring(p["style"]))


def write_presets(presets: DataFrame, folder: str) -> None:
    """A folder of text files for each preset (name=...)."""
    presets.select("name", F.col("document").alias("value")).write.partitionBy("name").text(folder)
