"""Vector and image functions on array columns: Catalyst expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u * v))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda u: F.transform(b, lambda v: u * v))


def sqnorm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def norm(x: Column) -> Column:
    return F.sqrt(sqnorm(x))


def let(value: Column, body) -> Column:
    """body(v) with v computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(x: Column, eps: float = EPS) -> Column:
    return let(norm(x), lambda n: F.transform(x, lambda v: v / (n + eps)))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def center(x: Column) -> Column:
    """The vector less its own mean."""
    return let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def spread(x: Column) -> Column:
    """Population standard deviation of the elements."""
    return F.sqrt(sqnorm(center(x)) / F.size(x))


def contrast_normalize(x: Column) -> Column:
    return let(center(x), normalize)


def scale(x: Column, by: float = 255.0) -> Column:
    return F.transform(x, lambda v: v / by)


def scale_image(x: Column) -> Column:
    """Divided by 255 if any value is above 1."""
    return F.when(F.array_max(x) > 1, scale(x)).otherwise(x)


def mse(a: Column, b: Column) -> Column:
    return total(F.zip_with(scale_image(a), scale_image(b), lambda u, v: (u - v) * (u - v))) / F.size(a)


def psnr(a: Column, b: Column, most: float = 1.0) -> Column:
    return 20 * F.log10(F.lit(float(most))) - 10 * F.log10(mse(a, b))


def to_uint8(x: Column) -> Column:
    """Clipped to 0..255 and truncated."""
    return F.transform(x, lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)).cast("int"))


def flip_horizontal(px: Column, w: int, c: int = 1) -> Column:
    """Rows of w pixels of c channels, mirrored."""
    rows = F.sequence(F.lit(0), (F.size(px) / (w * c)).cast("int") - 1)
    cols = F.sequence(F.lit(w - 1), F.lit(0))
    return F.flatten(F.transform(rows, lambda r: F.flatten(F.transform(cols, lambda k: F.slice(px, (r * w + k) * c + 1, c)))))


def soft_threshold(z: Column, lam: float) -> Column:
    return F.transform(z, lambda v: F.signum(v) * F.greatest(F.abs(v) - lam, F.lit(0.0)))


def sign_split(z: Column) -> Column:
    """[max(z, 0); max(-z, 0)]"""
    return F.concat(F.transform(z, lambda v: F.greatest(v, F.lit(0.0))), F.transform(z, lambda v: F.greatest(-v, F.lit(0.0))))


def n_patches(h: Column, w: Column, patch: tuple[int, int], step: tuple[int, int], padding: bool = False) -> Column:
    one = lambda n, p, s: F.floor((n - p + (p // 2 if padding else 0)) / s) + 1
    return F.greatest(one(h, patch[0], step[0]), F.lit(0)) * F.greatest(one(w, patch[1], step[1]), F.lit(0))


def grid_places(h: Column, w: Column, patch: tuple[int, int], step: tuple[int, int]) -> Column:
    """Array of (py, px), row by row; empty if the patch doesn't fit."""
    ys, xs = F.sequence(F.lit(0), h - patch[0], F.lit(step[0])), F.sequence(F.lit(0), w - patch[1], F.lit(step[1]))
    out = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.cast("int").alias("py"), x.cast("int").alias("px")))))
    return F.when((h >= patch[0]) & (w >= patch[1]), out).otherwise(F.array().cast("array<struct<py:int,px:int>>"))


def cut_patch(px: Column, w: Column, c: Column, py: Column, x: Column, patch: tuple[int, int]) -> Column:
    """The patch's pixels in row, column, channel order."""
    rows = F.sequence(F.lit(0), F.lit(patch[0] - 1))
    return F.flatten(F.transform(rows, lambda r: F.slice(px, (((py + r) * w + x) * c + 1).cast("int"), (F.lit(patch[1]) * c).cast("int"))))
