"""Test signals of whole numbers: noise that can begin at any sample, and cosines from a quarter-wave table."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier, step and modulus of the noise: fixed values.
FACTOR, STEP, MODULUS = 314_159, 1, 1 << 32
#: Bits of a full turn's angle, and of what lies between two entries of the table.
TURN, BETWEEN = 16, 7
#: A quarter wave of 15 bits in 128 steps, and a last one that nothing goes beyond.
QUARTER = [round(32_768 * math.cos(math.pi * i / 256)) for i in range(129)] + [0]


def affine_power(n: int) -> tuple[int, int]:
    """(a, c): n steps of the noise at once are x * a + c."""
    a, c, power = 1, 0, (FACTOR, STEP)
    while n:
        if n & 1:
            a, c = a * power[0] % MODULUS, (c * power[0] + power[1]) % MODULUS
        power = power[0] * power[0] % MODULUS, (power[1] * power[0] + power[1]) % MODULUS
        n >>= 1
    return a, c


def _step(x: Column, a: Column, c: Column) -> Column:
    """x * a + c, modulo 2^32, of numbers below it; the product is made in halves."""
    high = F.floor(a / 65_536).cast("long")
    return (((high * x) % MODULUS) * 65_536 + (a % 65_536) * x + c) % MODULUS


def state_at(n: Column, seed: int = 1, bits: int = 48) -> Column:
    """The noise's state after n steps from a seed: the steps of n's set bits, 2^k at once."""
    powers = F.array(*[F.struct(F.lit(1 << k).alias("bit"), *[F.lit(v).cast("long").alias(x) for v, x in zip(affine_power(1 << k), "ac", strict=True)]) for k in range(bits)])
    return F.aggregate(powers, F.lit(seed).cast("long"), lambda x, p: F.when(F.floor(n / p["bit"]) % 2 == 1, _step(x, p["a"], p["c"])).otherwise(x))


def noise_from(state: Column, count: int, range_: int) -> Column:
    """``count`` samples after a state, from -range / 2 on."""
    powers = F.array(*[F.struct(*[F.lit(v).cast("long").alias(x) for v, x in zip(affine_power(i), "ac", strict=True)]) for i in range(1, count + 1)])
    return F.transform(powers, lambda p: _step(state, p["a"], p["c"]) % range_ - range_ // 2)


def cosine(angle: Column) -> Column:
    """The cosine of an angle (2^16 is a turn) in 16 bits, between the entries of the table by a straight line."""
    one = 1 << TURN
    a = F.pmod(angle, F.lit(one))
    a = F.when(a >= one // 2, one - a).otherwise(a)
    low = a > one // 4
    a = F.when(low, one // 2 - a).otherwise(a)
    table, at = F.array(*map(F.lit, QUARTER)), F.floor(a / (1 << BETWEEN)).cast("int")
    p, q = F.get(table, at), F.get(table, at + 1)
    v = p + F.floor(((q - p) * (a % (1 << BETWEEN)) + (1 << (BETWEEN - 1))) / (1 << BETWEEN))
    return (F.when(low, -v).otherwise(v) * 2).cast("long")
