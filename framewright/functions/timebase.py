"""Exact rational time: pairs of whole numbers, and ticks in a time base."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole numbers; of 0 and 0 it is 0. As many steps as the smaller number's size allows at most, so that small numbers take few."""
    pair = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    small = F.greatest(F.least(F.abs(a), F.abs(b)), F.lit(1)).cast("double")
    steps = (F.floor(F.log(small) / math.log((1 + 5**0.5) / 2)) + 3).cast("int")
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), steps), pair, step, lambda s: s["a"])


def reduce(num: Column, den: Column) -> Column:
    """(num, den) in lowest terms, the sign on the numerator; 0/0 stays."""
    g = F.greatest(gcd(num, den), F.lit(1))
    sign = F.when((num < 0) != (den < 0), -1).otherwise(1)
    return F.struct((sign * F.abs(num) / g).cast("long").alias("num"), F.floor(F.abs(den) / g).cast("long").alias("den"))


def compare(an: Column, ad: Column, bn: Column, bd: Column) -> Column:
    """-1, 0 or 1; null where the two have no order (0/0)."""
    t = an.cast(WIDE) * bd.cast(WIDE) - bn.cast(WIDE) * ad.cast(WIDE)
    flip = F.when((ad < 0) != (bd < 0), -1).otherwise(1)
    return F.when(t != 0, F.signum(t).cast("int") * flip).when((ad != 0) & (bd != 0), 0).when((an != 0) & (bn != 0), F.signum(an).cast("int") - F.signum(bn).cast("int"))


def rescale(a: Column, b: Column, c: Column, mode: str = "near") -> Column:
    """a * b / c, rounded as ``mode`` says: zero, inf (both by magnitude), down, up or near (halves away from zero); null if c is not positive or b negative."""
    wide = F.abs(a).cast(WIDE) * b.cast(WIDE)
    more = {"zero": F.lit(0), "inf": c - 1, "near": F.floor(c / 2)}
    if mode in ("down", "up"):
        add = F.when((a < 0) == (mode == "down"), c - 1).otherwise(F.lit(0))
    else:
        add = more[mode]
    whole = _div(wide + add.cast(WIDE), c) * F.when(a < 0, -1).otherwise(1)
    return F.when((c > 0) & (b >= 0), whole.cast("long"))


def _div(a: Column, c: Column) -> Column:
    """Whole part of a decimal over a positive whole number, exactly."""
    rest = a % F.when(c == 0, 1).otherwise(c).cast(WIDE)
    return ((a - rest) / F.when(c == 0, 1).otherwise(c).cast(WIDE)).cast(WIDE)


def seconds(ticks: Column, num: Column, den: Column) -> Column:
    """Ticks as seconds; 0 for negative ticks and degenerate bases."""
    return F.when((ticks >= 0) & (den != 0), ticks.cast("double") * num / den).otherwise(F.lit(0.0))


def clock(us: Column) -> Column:
    """Microseconds as hours, minutes and seconds to the millisecond (cut, not rounded)."""
    ms = F.floor(us / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def round_div(a: Column, b: Column) -> Column:
    """a / b to the nearest whole number, halves away from zero."""
    return F.when(a >= 0, F.floor((a + F.floor(b / 2)) / b)).otherwise(-F.floor((-a + F.floor(b / 2)) / b)).cast("long")
