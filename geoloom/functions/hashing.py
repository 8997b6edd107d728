"""Coordinate hashes with wrapping integers, as expressions that stay within ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32, TWO31 = 1 << 32, 1 << 31
#: Fixed values of the hashes.
SEED_X, SEED_Z, SEED_SQUARE, SEED_LINEAR = 3129871, 116129781, 42317861, 11
UNIT_X, UNIT_Z = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MIX64_1, MIX64_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
HASH32_X, HASH32_Z, HASH32_SEED, HASH32_1, HASH32_2 = 0x1F1F1F1F, 0x9E3779B9, 0x27D4EB2D, 0x85EBCA6B, 0xC2B2AE35
WARP_SEED_X, WARP_SEED_Z = 0x243F6A8885A308D3, 0x13198A2E03707344
WARP_AMPLITUDE_M, WARP_WAVELENGTH_M = 800.0, 12000.0
LCG_FACTOR, LCG_ADD = 0x5DEECE66D, 0xB


def signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def wrap64(c: Column) -> Column:
    """Low 64 bits of a decimal, as bigint."""
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    low = F.pmod(c, two64)
    return F.when(low >= F.lit("9223372036854775808").cast("decimal(20,0)"), low - two64).otherwise(low).cast("bigint")


def mul64(a: Column, b: Column | int) -> Column:
    b = F.lit(signed(b, 64)) if isinstance(b, int) else b
    return wrap64(a.cast("decimal(20,0)") * b.cast("decimal(20,0)"))


def add64(a: Column, b: Column) -> Column:
    return wrap64(a.cast("decimal(20,0)") + b.cast("decimal(20,0)"))


def wrap32(c: Column) -> Column:
    """Low 32 bits of a bigint, as a signed value in a bigint."""
    return F.pmod(c + F.lit(TWO31), F.lit(TWO32)) - F.lit(TWO31)


def seed_from_coords(x: Column, y: Column | int, z: Column) -> Column:
    y = F.lit(y) if isinstance(y, int) else y
    s = wrap32(x.cast("bigint") * SEED_X).bitwiseXOR(z.cast("bigint") * SEED_Z).bitwiseXOR(y.cast("bigint"))
    return F.shiftright(add64(mul64(mul64(s, s), SEED_SQUARE), mul64(s, SEED_LINEAR)), 16)


def mix64(v: Column) -> Column:
    z = mul64(v.bitwiseXOR(F.shiftrightunsigned(v, 33)), MIX64_1)
    z = mul64(z.bitwiseXOR(F.shiftrightunsigned(z, 33)), MIX64_2)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 33))


def hash_unit(x: Column, z: Column, seed: int) -> Column:
    """A double in [0, 1) for each pair of integers."""
    h = F.lit(signed(seed, 64)).bitwiseXOR(mul64(x.cast("bigint"), UNIT_X)).bitwiseXOR(mul64(z.cast("bigint"), UNIT_Z))
    return F.shiftrightunsigned(mix64(h), 11) * F.lit(2.0**-53)


def value_noise(x: Column, z: Column, seed: int) -> Column:
    """Smooth noise in -1 to 1 through hashed corners."""
    x0, z0 = F.floor(x), F.floor(z)
    fade = lambda t: t * t * t * (t * (t * 6.0 - 15.0) + 10.0)
    u, v = fade(x - x0), fade(z - z0)
    corner = lambda i, j: hash_unit(x0 + i, z0 + j, seed)
    # each corner is named once: the hashes are long expressions
    near, far = (corner(0, j) * (1.0 - u) + corner(1, j) * u for j in (0, 1))
    return (near * (1.0 - v) + far * v) * 2.0 - 1.0


def domain_warp(x: Column, z: Column, scale: float) -> tuple[Column, Column]:
    """Block coordinates moved by noise; unmoved where the noise is under half a block or too fine."""
    x, z = x.cast("double"), z.cast("double")
    if scale <= 0 or WARP_AMPLITUDE_M / scale < 0.5 or WARP_WAVELENGTH_M / scale <= 1:
        return x, z
    reach, wave = WARP_AMPLITUDE_M / scale, WARP_WAVELENGTH_M / scale
    return x + value_noise(x / wave, z / wave, WARP_SEED_X) * reach, z + value_noise(x / wave + 37.0, z / wave - 59.0, WARP_SEED_Z) * reach


def mix_hash32(x: Column, z: Column, seed: int) -> Column:
    """A 32-bit hash, signed, in a bigint."""
    shift = lambda h, n: F.shiftrightunsigned(h.cast("int"), n).cast("bigint")
    times = lambda c, k: wrap32(c.cast("bigint") * F.lit(signed(k, 32)))
    h = times(x, HASH32_X).bitwiseXOR(times(z, HASH32_Z)).bitwiseXOR(F.lit(signed(seed * HASH32_SEED, 32)))
    h = times(h.bitwiseXOR(shift(h, 15)), HASH32_1)
    h = times(h.bitwiseXOR(shift(h, 13)), HASH32_2)
    return h.bitwiseXOR(shift(h, 16))


def percent_roll(h: Column, percent: Column | int) -> Column:
    """Whether the top byte of a 32-bit hash falls under a percentage."""
    percent = F.lit(percent) if isinstance(percent, int) else percent
    return F.shiftrightunsigned(h.cast("int"), 24) < F.floor(percent * 255 / 100)


def lcg_next_int(seed: Column, n: int) -> Column:
    """First draw below ``n`` of the 48-bit linear congruential generator of the Java library."""
    two48 = F.lit(1 << 48).cast("decimal(20,0)")
    start = F.pmod(seed.cast("bigint"), F.lit(1 << 48)).bitwiseXOR(F.lit(LCG_FACTOR))
    state = F.pmod(start.cast("decimal(20,0)") * F.lit(LCG_FACTOR).cast("decimal(20,0)") + F.lit(LCG_ADD), two48).cast("bigint")
    bits = F.shiftright(state, 17)
    return F.shiftright(bits * n, 31) if n & (n - 1) == 0 else bits % n


def seeded_choice(seed: Column, bounds: tuple[tuple[int, str], ...], n: int) -> Column:
    """The first name whose bound exceeds the draw; the last name takes the rest."""
    roll, out = lcg_next_int(seed, n), None
    for bound, name in bounds[:-1]:
        out = (F if out is None else out).when(roll < bound, F.lit(name))
    return out.otherwise(F.lit(bounds[-1][1]))
