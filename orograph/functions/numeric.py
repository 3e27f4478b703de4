"""Number helpers: rounding, the value noise and portable uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW32 = 0xFFFFFFFF
# The factors of the hash, of its two numbers and of the mixing.
_A, _B, _MIX = 1031, 2999, 0x45D9F3B


def half_up(x: float) -> int:
    """The nearest whole number; halves go up."""
    import math

    return math.floor(x + 0.5)


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def micro(x: Column) -> Column:
    """To six decimals, halves up, and no negative zero: the same on any engine that has
    IEEE doubles."""
    return F.floor(x * 1e6 + 0.5).cast("double") / 1e6


def hash01(a: Column, b: Column) -> Column:
    """A fixed pseudo-random number from 0 to 1 for whole numbers a and b: 32-bit integer
    mixing whose product is taken in double precision."""
    low = F.lit(_LOW32)
    n = (a.cast("long") * _A + b.cast("long") * _B).bitwiseAND(low)
    n = n.bitwiseXOR(F.shiftright(n, 13))
    signed = F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)
    n = (signed.cast("double") * float(_MIX)).cast("long").bitwiseAND(low)
    return n.bitwiseXOR(F.shiftright(n, 16)).bitwiseAND(F.lit(0xFFFF)).cast("double") / 65535


def value_noise(x: Column, y: Column) -> Column:
    """Smooth noise from 0 to 1 between the hashes of the four whole points around."""
    ix, iy = F.floor(x), F.floor(y)
    fx, fy = x - ix, y - iy
    # fixed values: the polynomial of the fade
    fade = lambda f: f * f * f * (f * (f * 6 - 15) + 10)
    ux, uy = fade(fx), fade(fy)
    return (
        hash01(ix, iy) * (1 - ux) * (1 - uy) + hash01(ix + 1, iy) * ux * (1 - uy)
        + hash01(ix, iy + 1) * (1 - ux) * uy + hash01(ix + 1, iy + 1) * ux * uy
    )


def uniform(r: Column, c: Column, seed: int) -> Column:
    """A number from 0 to 1 for each cell and seed. Unlike rand(seed), it doesn't depend
    on partitions."""
    return hash01(c.cast("long") * 7919 + F.lit(seed).cast("long") * 104_729, r)
