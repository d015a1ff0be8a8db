"""Pooling, spatial pyramids and hierarchical pursuit features on long codes (img_id, py, px, k, z)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import images as I
from .encode import FeatureEncoder, SparseEncoder, long_codes
from .preprocess import preprocess

POOLS = ("absmax", "max", "sum", "avg")


def pool(codes: DataFrame, keys: list[str], how: str, members: DataFrame | None = None) -> DataFrame:
    """One value per keys and atom. ``members`` (keys, n) counts the pooled descriptors, of which those without an entry count as 0."""
    if how not in POOLS:
        raise ValueError(f"unknown pooling {how}")
    agg = {"absmax": F.max(F.abs("z")), "max": F.max("z"), "sum": F.sum("z"), "avg": F.sum("z")}[how]
    out = codes.groupBy(*keys, "k").agg(agg.alias("v"), F.count("*").alias("here"))
    if members is not None:
        out = out.join(members, keys)
        if how == "max":
            out = out.withColumn("v", F.when(F.col("here") < F.col("n"), F.greatest("v", F.lit(0.0))).otherwise(F.col("v")))
        elif how == "avg":
            out = out.withColumn("v", F.col("v") / F.col("n"))
    elif how == "avg":
        raise ValueError("average pooling needs the members' count")
    return out.select(*keys, "k", "v")


def cells(places: DataFrame, levels: tuple[int, ...], patch: tuple[int, int] | None = None) -> DataFrame:
    """Adds (level, cell) for each pyramid level to rows with py, px, h, w; centres are place + patch / 2 - 1/2 if a patch is given."""
    cy = F.col("py") + (patch[0] / 2 - 0.5 if patch else 0.0)
    cx = F.col("px") + (patch[1] / 2 - 0.5 if patch else 0.0)
    rows = places.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    lev: Column = F.col("level")
    cell = F.floor(cy / (F.col("h") / lev)) * lev + F.floor(cx / (F.col("w") / lev))
    return rows.withColumn("cell", cell.cast("int"))


def pyramid(codes: DataFrame, places: DataFrame, levels: tuple[int, ...] = (1, 2, 4), how: str = "absmax", patch: tuple[int, int] | None = None, normalise: bool = True) -> DataFrame:
    """(img_id, level, cell, k, v): pooled codes of each cell, each cell's vector scaled to unit norm; absent entries are 0.

    codes: (img_id, pos, k, z); places: (img_id, pos, py, px, h, w).
    """
    at = cells(places, levels, patch)
    keys = ["img_id", "level", "cell"]
    members = at.groupBy(*keys).agg(F.count("*").alias("n"))
    out = pool(codes.join(at.select(*keys, "pos"), ["img_id", "pos"]), keys, how, members)
    if not normalise:
        return out
    n = out.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return out.join(n, keys).select(*keys, "k", (F.col("v") / (F.col("n") + V.EPS)).alias("v"))


def pyramid_vector(features: DataFrame, images: DataFrame, n_atoms: int, levels: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """(id, x): the features of each image in order of level, cell and atom, zeros where a cell is empty."""
    start = {lev: sum(v * v for v in levels[:i]) for i, lev in enumerate(levels)}
    offset = F.element_at(F.create_map(*[F.lit(v) for p in start.items() for v in p]), F.col("level"))
    at = ((offset + F.col("cell")) * n_atoms + F.col("k")).cast("int")
    held = features.select("img_id", at.alias("at"), "v").groupBy("img_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    width = n_atoms * sum(v * v for v in levels)
    full = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return images.select("img_id").join(held, "img_id", "left").select(F.col("img_id").alias("id"), full.alias("x"))


def conv_pool(codes: DataFrame, ph: int, pw: int, size: int, stride: int) -> DataFrame:
    """(img_id, oy, ox, k, v): largest |z| in size x size windows of a ph x pw grid; each entry names the windows it is in."""
    def windows(p: Column, n: int) -> Column:
        low = F.greatest(F.ceil((p - size + 1) / stride), F.lit(0)).cast("int")
        high = F.least(F.floor(p / stride), F.lit((n - size) // stride)).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    rows = codes.withColumn("oy", F.explode(windows(F.col("py"), ph))).withColumn("ox", F.explode(windows(F.col("px"), pw)))
    return rows.groupBy("img_id", "oy", "ox", "k").agg(F.max(F.abs("z")).alias("v"))


class SpatialPyramid:
    """Descriptors -> codes -> pyramid features of each image."""

    def __init__(self, extractor: str, step: int, patch: int, coder: SparseEncoder, levels: tuple[int, ...] = (1, 2, 4), how: str = "absmax"):
        if extractor not in ("sift", "patches"):
            raise ValueError("extractor must be sift or patches")
        self.extractor, self.step, self.patch, self.coder, self.levels, self.how = extractor, step, patch, coder, levels, how

    def descriptors(self, images: DataFrame) -> DataFrame:
        out = I.sift(images, self.step, self.patch) if self.extractor == "sift" else I.grid_patches(images, (self.patch, self.patch), (self.step, self.step))
        return out.withColumn("id", F.col("img_id") * (1 << 24) + F.col("pos"))

    def learn(self, images: DataFrame, learner):
        return learner.fit(self.descriptors(images).select("id", "x"))

    def extract(self, images: DataFrame, D: np.ndarray) -> DataFrame:
        rows = self.descriptors(images)
        codes = long_codes(self.coder.encode(rows, D)).select(F.shiftright("id", 24).alias("img_id"), (F.col("id") % (1 << 24)).cast("int").alias("pos"), "k", "z")
        places = rows.select("img_id", "pos", "py", "px").join(images.select("img_id", "h", "w"), "img_id")
        return pyramid_vector(pyramid(codes, places, self.levels, self.how, (self.patch, self.patch)), images, len(D), self.levels)


class HMPLayer:
    """A layer of a hierarchical pursuit network: patches -> preprocessing -> codes -> pooled maps."""

    def __init__(self, patch: int, step: int, learner, encoder: SparseEncoder | FeatureEncoder, preprocessing: tuple[str, ...] = (), pool_size: int = 2, pool_stride: int = 2):
        self.patch, self.step, self.learner, self.encoder, self.pre, self.pool_size, self.pool_stride = patch, step, learner, encoder, preprocessing, pool_size, pool_stride

    def rows(self, images: DataFrame) -> DataFrame:
        out = I.grid_patches(images, (self.patch, self.patch), (self.step, self.step), native=False)
        out = out.withColumn("id", F.col("img_id") * (1 << 24) + F.col("pos"))
        for name in self.pre:
            x = preprocess(out.select("id", "x"), name)
            out = out.drop("x").join(x, "id")
        return out

    def learn(self, images: DataFrame) -> HMPLayer:
        self.learner.fit(self.rows(images).select("id", "x"))
        return self

    def maps(self, images: DataFrame) -> DataFrame:
        """(img_id, py, px, k, z) on the grid of patches."""
        rows = self.rows(images)
        codes = long_codes(self.encoder.encode(rows, self.learner.D))
        at = rows.select("id", "img_id", (F.col("py") / self.step).cast("int").alias("py"), (F.col("px") / self.step).cast("int").alias("px"))
        return codes.join(at, "id").select("img_id", "py", "px", "k", "z")

    def grid(self, h: int, w: int) -> tuple[int, int]:
        return (h - self.patch) // self.step + 1, (w - self.patch) // self.step + 1

    def pooled(self, images: DataFrame, h: int, w: int) -> DataFrame:
        """The pooled map of each image as the next layer's image, one channel an atom."""
        gh, gw = self.grid(h, w)
        oh, ow, n = (gh - self.pool_size) // self.pool_stride + 1, (gw - self.pool_size) // self.pool_stride + 1, len(self.learner.D)
        v = conv_pool(self.maps(images), gh, gw, self.pool_size, self.pool_stride)
        at = ((F.col("oy") * ow + F.col("ox")) * n + F.col("k")).cast("int")
        held = v.groupBy("img_id").agg(F.map_from_entries(F.collect_list(F.struct(at, "v"))).alias("m"))
        full = F.transform(F.sequence(F.lit(0), F.lit(oh * ow * n - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
        return images.select("img_id").join(held, "img_id", "left").select("img_id", F.lit(oh).alias("h"), F.lit(ow).alias("w"), F.lit(n).alias("c"), full.alias("px"))


class HMPNetwork:
    """Layers in turn; the last one's maps are pooled over a pyramid."""

    def __init__(self, layers: list[HMPLayer], levels: tuple[int, ...] = (1, 2, 4)):
        self.layers, self.levels = layers, levels

    def show(self) -> list[str]:
        return [f"layer {i}: {x.learner.n_atoms} atoms, {x.patch} x {x.patch} patches, step {x.step}" for i, x in enumerate(self.layers)]

    def build(self, images: DataFrame, h: int, w: int) -> DataFrame:
        """(id, x): features of each h x w image; every layer learns on the maps below it."""
        for i, layer in enumerate(self.layers):
            layer.learn(images)
            if i + 1 < len(self.layers):
                images = layer.pooled(images, h, w).persist()
                gh, gw = layer.grid(h, w)
                h, w = (gh - layer.pool_size) // layer.pool_stride + 1, (gw - layer.pool_size) // layer.pool_stride + 1
        last = self.layers[-1]
        gh, gw = last.grid(h, w)
        maps = last.maps(images).withColumn("pos", F.col("py") * gw + F.col("px"))
        places = images.select("img_id", F.explode(F.sequence(F.lit(0), F.lit(gh * gw - 1))).alias("pos")).select("img_id", "pos", F.floor(F.col("pos") / gw).cast("int").alias("py"), (F.col("pos") % gw).alias("px"), F.lit(gh).alias("h"), F.lit(gw).alias("w"))
        return pyramid_vector(pyramid(maps.select("img_id", "pos", "k", "z"), places, self.levels, normalise=False), images, len(last.learner.D), self.levels)
