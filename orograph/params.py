"""Parameters: defaults, domains and validation."""

from __future__ import annotations

from orograph.functions.color import GRADIENTS

# Defaults of the terrain, points and view, and of what all modes share.
TERRAIN = {"resolution": 2, "elevScale": 0, "blurRadius": 0, "gridOffsetX": 0, "gridOffsetY": 0, "elevMinCut": 0, "elevMaxCut": 100, "blackPoint": 0, "whitePoint": 255, "jitterAmt": 0}
POINTS = {"showPoints": False, "pointColor": "#000000", "pointSize": 4, "particlePeaksOnly": False, "animateParticles": False, "particleNoise": 1, "particleDamping": 0.92, "particleGravity": False, "particleGravityStr": 1}
VIEW = {"tilt": 40, "rotation": 0, "zoom": 1, "fov": 60, "orthographic": False, "panX": 0, "panY": 0, "autoRotate": False, "autoRotateSpeed": 0.2, "autoRotateAxis": "Y", "autoRotateDir": 1, "showGuides": False, "showRawTerrain": False}
# What the surface and the modes have; of each mode what is its own.
SURFACE = {
    "showFill": False, "fillColor": "#ffffff", "fillHypsometric": False, "fillBanded": False, "fillHypsoInterval": 10, "fillHypsoWeight": 1.5, "fillHypsoMode": "elevation",
    "showMesh": False, "meshColor": "#888888", "bgColor": "#ffffff", "bgGradient": False, "depthOcclusion": True, "occlusionBias": 1.0, "occlusionColor": "#a80000", "occlusionOpacity": 0.0,
    "showTexture": False, "textureScale": 1, "textureShiftX": 0, "textureShiftY": 0, "textureBlendMode": "normal", "textureOpacity": 1,
    "showHillshade": False, "hillshadeAzimuth": 315, "hillshadeAltitude": 45, "hillshadeIntensity": 1.0, "hillshadeOpacity": 0.6, "hillshadeExaggeration": 2.0, "hillshadeHighlightColor": "#ffffff", "hillshadeShadowColor": "#000000",
    "showSlopeShade": False, "slopeShadeOpacity": 0.75, "slopeColorLow": "#86efac", "slopeColorHigh": "#dc2626", "showLines": True,
}
MODE = {"color": "#000000", "weight": 1, "opacity": 1, "dash": "solid", "hypso": False, "hypsoMode": "elevation", "hypsoBanded": False, "hypsoInterval": 10}
#: Of each mode: its own parameters (name before the mode's id, but for those of _WHOLE),
#: and where it differs from MODE.
MODES = {
    "X": {"enabled": True, "spacing": 4, "shift": 0}, "Y": {"spacing": 4, "shift": 0}, "Cross": {"spacing": 4}, "Pillars": {"spacing": 8},
    "Contours": {"interval": 4, "majorInterval": 10, "majorWeight": 2, "majorOffset": 1, "closeRings": False}, "Hachure": {"spacing": 4, "length": 1},
    "Flow": {"spacing": 10, "step": 1, "maxLen": 100}, "Dag": {"threshold": 2}, "Pencil": {"spacing": 4, "threshold": 0.5}, "Ridge": {"spacing": 1, "radius": 1, "threshold": 0.1},
    "Valley": {"spacing": 2, "radius": 2, "threshold": 0.5}, "Stipple": {"spacing": 0.5, "weight": 4, "opacity": 0.85, "color": "#1a1a1a"},
}
# Parameters of modes under names of their own.
_WHOLE = {"pillarGap": 0, "pillarDepth": 0, "pillarStyle": "line", "pillarSize": 0.8, "pillarSegments": 8, "pillarLidColor": "#ffffff", "stippleDensityMode": "slope", "stippleGamma": 1.2, "stippleJitter": 0.8}


def style_defaults() -> dict:
    """All style parameters by name, such as spacingX or hypsoModeContours."""
    out = dict(SURFACE) | {f"showMirror{side}{axis}": side == "Plus" for axis in "XYZ" for side in ("Plus", "Minus")}
    for mode, own in MODES.items():
        out |= {f"{name}{mode}": value for name, value in ({"enabled": False} | MODE | own).items()}
    return out | _WHOLE | {"gradientStops": GRADIENTS["Jet"]}


# Least and greatest value of terrain parameters.
DOMAINS = {"resolution": (1, 20), "elevScale": (-5, 5), "blurRadius": (0, 10), "jitterAmt": (0, 20), "elevMinCut": (0, 100), "elevMaxCut": (0, 100), "blackPoint": (0, 254), "whitePoint": (1, 255)}
#: The black and the white point stay this far apart.
LEVEL_GAP = 2


def validated(terrain: dict) -> dict:
    """Terrain parameters with defaults; values outside their domain are refused."""
    p = TERRAIN | terrain
    unknown = set(p) - set(TERRAIN)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    for name, (low, high) in DOMAINS.items():
        if not low <= p[name] <= high:
            raise ValueError(f"{name} must lie in {low}..{high}")
    if p["whitePoint"] - p["blackPoint"] < LEVEL_GAP:
        raise ValueError("the white point must lie above the black point")
    return p


def terrain_options(terrain: dict, base_scale: float = 1.0) -> dict:
    """From terrain parameters to options of ``build_terrain``. The vertical scale is an
    offset to that of the raster (``base_scale``)."""
    p = validated(terrain)
    names = {"resolution": "resolution", "blurRadius": "blur", "gridOffsetX": "off_x", "gridOffsetY": "off_y", "blackPoint": "black", "whitePoint": "white"}
    return {names[k]: p[k] for k in names} | {"elev_scale": base_scale + p["elevScale"]}


#: Modes whose places may be moved up and down by noise.
JITTERED = ("X", "Y", "Cross", "Pillars", "Hachure", "Pencil", "Ridge", "Valley", "Stipple")


def drawing(style: dict, terrain: dict | None = None) -> dict[str, dict]:
    """From flat style parameters to options of ``modes.draw`` for the enabled modes; with
    terrain parameters also the elevation band and the jitter."""
    names = {
        "spacing": "spacing", "shift": "shift", "interval": "interval", "majorInterval": "major", "majorOffset": "offset", "closeRings": "close", "length": "length",
        "step": "step", "maxLen": "longest", "threshold": "threshold", "radius": "radius",
    }
    p = style_defaults() | style
    out = {}
    for mode, own in MODES.items():
        if p[f"enabled{mode}"]:
            out[mode] = {names[k]: p[f"{k}{mode}"] for k in own if k in names}
    if "Pillars" in out:
        out["Pillars"] |= {"gap": p["pillarGap"], "depth": p["pillarDepth"], "style": p["pillarStyle"], "size": p["pillarSize"], "sides": p["pillarSegments"]}
    if "Stipple" in out:
        out["Stipple"] |= {"density": p["stippleDensityMode"], "gamma": p["stippleGamma"], "scatter": p["stippleJitter"]}
    if terrain is not None:
        t = TERRAIN | terrain
        for mode, options in out.items():
            options["band"] = (t["elevMinCut"], t["elevMaxCut"])
            if mode in JITTERED:
                options["jitter"] = t["jitterAmt"]
    return out


def coloring(style: dict) -> dict[str, dict]:
    """Of each mode, the options of ``color.vertex_color``."""
    p = style_defaults() | style
    return {
        mode: {"color": p[f"color{mode}"], "hypsometric": p[f"hypso{mode}"], "mode": p[f"hypsoMode{mode}"], "banded": p[f"hypsoBanded{mode}"], "interval": p[f"hypsoInterval{mode}"], "stops": p["gradientStops"]}
        for mode in MODES
    }


def layer_styles(style: dict) -> list[tuple[str, float, float, str]]:
    """(layer, weight, opacity, dash) of each mode; contours have two layers."""
    p = style_defaults() | style
    rows = []
    for mode in MODES:
        shared = (float(p[f"opacity{mode}"]), p[f"dash{mode}"])
        if mode == "Contours":
            rows.append(("Contours-Minor", float(p["weightContours"]), *shared))
            rows.append(("Contours-Major", float(p["majorWeightContours"]), *shared))
        else:
            rows.append((mode, float(p[f"weight{mode}"]), *shared))
    return rows
