"""Scalar Column functions: angles, geometry, guarded arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wrap_angle(c: Column, m: int = 1) -> Column:
    """To [-pi/m, pi/m)."""
    half = math.pi / m
    return F.pmod(c + half, F.lit(2 * half)) - half


def dtheta(a: Column, b: Column | None = None, m: int = 1, sign: bool = False) -> Column:
    """m-fold wrapped difference of two angles, absolute unless signed; m = 0 leaves it as it is."""
    d = a if b is None else a - b
    d = wrap_angle(d, m) if m else d
    return d if sign else F.abs(d)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """A vector turned by +angle."""
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def project(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """A vector's components along and across a direction."""
    return x * F.cos(angle) + y * F.sin(angle), y * F.cos(angle) - x * F.sin(angle)


def circle_through(ax, ay, bx, by, cx, cy) -> Column:
    """struct(x, y, r) of the circle through three points; NULL for points on a line."""
    ax, ay, bx, by, cx, cy = map(col, (ax, ay, bx, by, cx, cy))
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    sq = [x * x + y * y for x, y in ((ax, ay), (bx, by), (cx, cy))]
    ux = F.try_divide(sq[0] * (by - cy) + sq[1] * (cy - ay) + sq[2] * (ay - by), d)
    uy = F.try_divide(sq[0] * (cx - bx) + sq[1] * (ax - cx) + sq[2] * (bx - ax), d)
    return F.when(d != 0, F.struct(ux.alias("x"), uy.alias("y"), F.hypot(ux - ax, uy - ay).alias("r")))


def capacity(margin: float, radius: float) -> float:
    """Particles of unit side that fit a disk without its margin."""
    return math.pi * (radius - margin) ** 2


def decade(c: Column) -> Column:
    """Largest power of ten not above a positive number."""
    return F.when(c > 0, F.pow(F.lit(10.0), F.floor(F.log10(c))))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def parse_value(c: Column) -> Column:
    """A metadata value's text without quotes; the literal None is NULL."""
    return F.when(c != "None", F.regexp_replace(F.trim(c), r"^'(.*)'$|^\"(.*)\"$", "$1$2"))


def replace_all(c: Column, old: str, new: str) -> Column:
    """Every character of old becomes new."""
    for x in old:
        c = F.replace(c, F.lit(x), F.lit(new))
    return c


def typed_value(c: Column) -> Column:
    """struct(int, float, bool, text) of a metadata value: the first kind it can be read as is set, text always; all NULL for the literal None."""
    text = parse_value(c)
    quoted = F.trim(c).rlike(r"^(['\"]).*\1$")
    plain = F.when(~quoted, text)
    whole = plain.try_cast("bigint")
    number = F.when(whole.isNull(), plain.try_cast("double"))
    truth = F.when(plain.isin("True", "False"), plain == "True")
    return F.struct(whole.alias("int"), number.alias("float"), truth.alias("bool"), text.alias("text"))


def common_pattern(a: Column, b: Column) -> Column:
    """The wildcard that two texts share: ? where characters of equally long ones differ, else their common beginning and end around a *."""
    n, m = F.length(a), F.length(b)
    chars = lambda c: F.split(c, "")
    same = F.array_join(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, x).otherwise("?")), "")
    least = F.least(n, m)
    length_of = lambda x, y, k: F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= k) & (F.substr(x, i, F.lit(1)) == F.substr(y, i, F.lit(1))), i).otherwise(acc))
    start = length_of(a, b, least)
    end = length_of(F.reverse(a), F.reverse(b), least - start)
    return F.when(a == b, a).when(n == m, same).otherwise(F.concat(F.substr(a, F.lit(1), start), F.lit("*"), F.substr(a, n - end + 1, end)))


def with_error(value: Column, error: Column) -> Column:
    """value +- error as text, both to the place of the error's first digit."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(error))))
    show = lambda v: (F.rint(v / scale) * scale).cast("decimal(38,12)").cast("double").cast("string")
    return F.when(error > 0, F.concat(show(value), F.lit(" +- "), show(error))).otherwise(value.cast("string"))
