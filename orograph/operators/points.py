"""Point clouds: all cells, or the highest and lowest of a row; and their movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.numeric import uniform
from orograph.operators.grid import Terrain, elevation, world_x, world_z
from orograph.shared import cut

SPRING, PULL, DRAG = 0.04, 0.04, 0.97


def all_points(t: Terrain, jitter: float = 0) -> DataFrame:
    """(r, c, x, y, z) of every cell with data."""
    return t.cells.where("valid").select("r", "c", world_x(t.meta, "c").alias("x"), elevation(t, jitter=jitter).alias("y"), world_z(t.meta, "r").alias("z"))


def extremes(t: Terrain, *, step: int = 4, by: str = "r", jitter: float = 0) -> DataFrame:
    """(kind, r, c, x, y, z): peak and valley of each step-th row (or column,
    ``by`` c), the first of equals; no valley where it is the peak."""
    along = "c" if by == "r" else "r"
    e = t.cells.where("valid").where(F.col(by) % step == 0).select(by, along, elevation(t, jitter=jitter).alias("y"))
    found = e.groupBy(by).agg(F.max(F.struct("y", (-F.col(along)).alias("k"))).alias("hi"), F.min(F.struct("y", F.col(along).alias("k"))).alias("lo"))
    kinds = F.array(F.struct(F.lit("peak").alias("kind"), F.col("hi.y").alias("y"), (-F.col("hi.k")).alias("k")), F.struct(F.lit("valley").alias("kind"), F.col("lo.y").alias("y"), F.col("lo.k").alias("k")))
    rows = found.select(by, F.explode(F.when(-F.col("hi.k") != F.col("lo.k"), kinds).otherwise(F.slice(kinds, 1, 1))).alias("p")).select("p.kind", by, F.col("p.k").alias(along), F.col("p.y").alias("y"))
    return rows.select("kind", "r", "c", world_x(t.meta, "c").alias("x"), "y", world_z(t.meta, "r").alias("z"))


def at_rest(points: DataFrame) -> DataFrame:
    """Particles (id, position, velocity 0, home) of points (r, c, x, y, z)."""
    return points.select("r", "c", "x", "y", "z", *[F.lit(0.0).alias(f"v{k}") for k in "xyz"], *[F.col(k).alias(f"h{k}") for k in "xyz"])


STATE = ("x", "y", "z", "vx", "vy", "vz")


def _state(values: dict[str, Column]) -> Column:
    return F.struct(*[values[k].alias(k) for k in STATE])


def spring(noise: float = 1, damping: float = 0.92, seed: int = 1):
    """P5: the rule of particles that are pulled home and shaken."""

    def rule(s: Column, step) -> Column:
        draw = lambda i: uniform(F.col("r"), F.col("c"), seed + 3 * step + i)
        v = {k: (s[f"v{k}"] + (F.col(f"h{k}") - s[k]) * SPRING + (draw(i) - 0.5) * (noise * 0.4)) * damping for i, k in enumerate("xyz")}
        return _state({k: s[k] + v[k] for k in "xyz"} | {f"v{k}": v[k] for k in "xyz"})

    return rule


def gravity(floor: float, strength: float = 1):
    """The rule of particles that fall and stay on the floor."""
    low, pull = F.lit(float(floor)), {"x": F.lit(0.0), "y": F.lit(PULL * strength), "z": F.lit(0.0)}

    def rule(s: Column, step) -> Column:
        down = (s["y"] <= low) & (s["vy"] <= 0)
        v = {k: F.when(down, 0.0).otherwise((s[f"v{k}"] - pull[k]) * DRAG) for k in "xyz"}
        at = {k: F.when(down, s[k]).otherwise(s[k] + v[k]) for k in "xyz"}
        through = ~down & (at["y"] < low)
        return _state(at | {"y": F.when(through, low).otherwise(at["y"])} | {f"v{k}": v[k] for k in "xz"} | {"vy": F.when(through, 0.0).otherwise(v["y"])})

    return rule


def advanced(p: DataFrame, steps: int, rule, first: int = 0) -> DataFrame:
    """Particles after ``steps`` steps of a rule, the first of which has the number
    ``first``. A particle needs none but itself, so all steps are one fold inside its
    row: the plan doesn't grow with them, and nothing is shuffled or written."""
    if steps < 1:
        return p
    start = F.struct(*STATE)
    end = rule(start, F.lit(first)) if steps == 1 else F.aggregate(F.sequence(F.lit(first), F.lit(first + steps - 1)), start, rule)
    return p.withColumn("_s", end).withColumns({k: F.col("_s")[k] for k in STATE}).drop("_s")


def spring_step(p: DataFrame, step: int = 0, *, noise: float = 1, damping: float = 0.92, seed: int = 1) -> DataFrame:
    """One step of ``spring``."""
    return advanced(p, 1, spring(noise, damping, seed), step)


def gravity_step(p: DataFrame, floor: float, *, strength: float = 1) -> DataFrame:
    """One step of ``gravity``."""
    return advanced(p, 1, gravity(floor, strength))


def animate(p: DataFrame, steps: int, step, every: int = 20) -> DataFrame:
    """``steps`` steps of ``step(particles, number)``, any function of a table; the plan is
    cut now and then. For rules see ``advanced``."""
    for k in range(steps):
        p = step(p, k)
        if k % every == every - 1:
            p = cut(p)
    return p
