"""Image sizes, token estimates and boxes as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ResizeParams:
    factor: int = 28
    patch: int = 14
    min_pixels: int = 100352
    max_pixels: int = 351232


def smart_resize(height: Column, width: Column, p: ResizeParams = ResizeParams()) -> Column:
    """struct(height, width), multiples of ``factor`` with an area within the bounds; halves round to even."""
    f = float(p.factor)
    h, w = height.cast("double"), width.cast("double")
    hb, wb = F.greatest(F.lit(f), F.rint(h / f) * f), F.greatest(F.lit(f), F.rint(w / f) * f)
    shrink, grow = F.sqrt(h * w / p.max_pixels), F.sqrt(F.lit(float(p.min_pixels)) / (h * w))
    pick = lambda x, near: (
        F.when(hb * wb > p.max_pixels, F.greatest(F.lit(f), F.floor(x / shrink / f) * f)).when(hb * wb < p.min_pixels, F.ceil(x * grow / f) * f).otherwise(near)
    )
    return F.struct(pick(h, hb).cast("int").alias("height"), pick(w, wb).cast("int").alias("width"))


def image_tokens(height: Column, width: Column, p: ResizeParams = ResizeParams()) -> Column:
    """Patches before merging of the resized image."""
    size = smart_resize(height, width, p)
    return (F.floor(size["height"] / p.patch) * F.floor(size["width"] / p.patch)).cast("int")


def fit_pixels(height: Column, width: Column, budget: int, least: int = 28) -> Column:
    """struct(height, width) scaled down to at most ``budget`` pixels, each side at least ``least``."""
    s = F.sqrt(F.lit(float(budget)) / (width * height))
    cut = lambda x: F.when(width * height > budget, F.greatest(F.lit(least), F.floor(x * s).cast("int"))).otherwise(x.cast("int"))
    return F.struct(cut(height).alias("height"), cut(width).alias("width"))


def grid(height: Column, width: Column, patch: int = 14) -> Column:
    """struct(gh, gw, merged): patch grid and merged tokens."""
    gh, gw = F.floor(height / patch).cast("int"), F.floor(width / patch).cast("int")
    return F.struct(gh.alias("gh"), gw.alias("gw"), F.floor(gh * gw / 4).cast("int").alias("merged"))


def patch_cell(index: Column, gw: Column, merge: int = 2) -> Column:
    """struct(row, col): the true place of the ``index``-th patch of a merge-grouped sequence."""
    per_band = gw * merge
    band, inside = F.floor(index / per_band), index % per_band
    block, cell = F.floor(inside / (merge * merge)), inside % (merge * merge)
    return F.struct((band * merge + F.floor(cell / merge)).cast("int").alias("row"), (block * merge + cell % merge).cast("int").alias("col"))


def box_cells(x1: Column, y1: Column, x2: Column, y2: Column, gw: Column, gh: Column) -> Column:
    """struct(c1, c2, r1, r2): the half-open cell range of a normalised box, never empty."""

    def span(lo: Column, hi: Column, n: Column) -> tuple[Column, Column]:
        a = F.least(F.greatest(F.floor(lo * n), F.lit(0)), n - 1).cast("int")
        return a, F.greatest(a + 1, F.least(F.floor(hi * n) + 1, n)).cast("int")

    c1, c2 = span(x1, x2, gw)
    r1, r2 = span(y1, y2, gh)
    return F.struct(c1.alias("c1"), c2.alias("c2"), r1.alias("r1"), r2.alias("r2"))


def normalise_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    return F.array(x1 / width, y1 / height, x2 / width, y2 / height)


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """Whole pixels of a normalised box."""
    return F.array(*[F.floor(F.get(box, F.lit(i)) * (width, height)[i % 2]).cast("int") for i in range(4)])
