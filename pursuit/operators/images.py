"""Image operators on (img_id, h, w, c, px): noise, patches, SIFT descriptors, resizing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..kernels import imaging as K

IMAGES = "img_id long, h int, w int, c int, px array<double>"
PATCHES = "img_id long, pos int, py int, px int, x array<double>"


def each_image(images: DataFrame, fn: Callable[[int, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``fn(img_id, array)`` gives for each image."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out = fn(r["img_id"], np.array(r["px"], float).reshape(r["h"], r["w"], r["c"]))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, t)) for t in out], schema=arrow_schema(schema))

    return images.select("img_id", "h", "w", "c", V.doubles(F.col("px")).alias("px")).mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def add_noise(images: DataFrame, std: float, normalized: bool = False, seed: int = 0) -> DataFrame:
    """Gaussian noise, seeded per image, then clipped to [0, 1] or [0, 255]."""
    top = 1.0 if normalized else 255.0
    return each_image(images, lambda i, a: [(i, *a.shape, np.clip(a + std * np.random.default_rng([seed, i]).standard_normal(a.shape), 0, top).ravel().tolist())], IMAGES)


def pepper(images: DataFrame, prob: float, seed: int = 0) -> DataFrame:
    """Exactly int(prob h w) pixels of each image are set to 0; mask is 1 where a pixel was left."""

    def one(i: int, a: np.ndarray) -> list[tuple]:
        h, w, c = a.shape
        gone = np.random.default_rng([seed, i]).permutation(h * w)[: int(prob * h * w)]
        mask = np.ones(h * w)
        mask[gone] = 0
        return [(i, h, w, c, (a.reshape(h * w, c) * mask[:, None]).ravel().tolist(), mask.tolist())]

    return each_image(images, one, IMAGES + ", mask array<double>")


def resize(images: DataFrame, scale: float | None = None, maxdim: int | None = None) -> DataFrame:
    def one(i: int, a: np.ndarray) -> list[tuple]:
        out = K.resize(a, scale, maxdim)
        return [(i, *out.shape, out.ravel().tolist())]

    return each_image(images, one, IMAGES)


def to_gray(images: DataFrame) -> DataFrame:
    """ITU-R 601 luma of RGB images, truncated as in 8-bit gray; gray ones stay."""
    def one(i: int, a: np.ndarray) -> list[tuple]:
        g = a[:, :, 0] if a.shape[2] < 3 else np.floor(a[:, :, :3] @ np.array([0.299, 0.587, 0.114]) + 1e-9)
        return [(i, a.shape[0], a.shape[1], 1, g.ravel().tolist())]

    return each_image(images, one, IMAGES)


def grid_patches(images: DataFrame, patch: tuple[int, int], step: tuple[int, int] = (1, 1), native: bool = True) -> DataFrame:
    """(img_id, pos, py, px, x): all patches of all images. native: array expressions; else a numpy kernel."""
    if not native:
        def one(i: int, a: np.ndarray) -> list[tuple]:
            at, rows = K.patches(a, patch, step)
            return [(i, n, int(y), int(x), r.tolist()) for n, ((y, x), r) in enumerate(zip(at, rows))]

        return each_image(images, one, PATCHES)
    rows = images.select("img_id", "w", "c", V.doubles(F.col("px")).alias("pixels"), F.posexplode(V.grid_places(F.col("h"), F.col("w"), patch, step)).alias("pos", "at"))
    x = V.cut_patch(F.col("pixels"), F.col("w"), F.col("c"), F.col("at.py"), F.col("at.px"), patch)
    return rows.select("img_id", "pos", F.col("at.py").alias("py"), F.col("at.px").alias("px"), x.alias("x"))


def sample_patches(images: DataFrame, patch: tuple[int, int], n_patches: int, seed: int = 0) -> DataFrame:
    """n_patches div images patches of each image, without replacement; all of an image that has fewer."""
    each = n_patches // max(1, images.count())

    def one(i: int, a: np.ndarray) -> list[tuple]:
        at, rows = K.patches(a, patch)
        some = np.sort(np.random.default_rng([seed, i]).permutation(len(at))[:each])
        return [(i, int(n), int(at[n][0]), int(at[n][1]), rows[n].tolist()) for n in some]

    return each_image(images, one, PATCHES)


def rebuild(patches: DataFrame, images: DataFrame, patch: tuple[int, int]) -> DataFrame:
    """(img_id, y, x, ch, v): the mean over all patches of each pixel they cover."""
    at = patches.join(images.select("img_id", "c"), "img_id").select("img_id", "py", F.col("px").alias("x0"), "c", F.posexplode("x").alias("p", "v"))
    ch, q = F.col("p") % F.col("c"), F.floor(F.col("p") / F.col("c"))
    return at.select("img_id", (F.col("py") + F.floor(q / patch[1])).cast("int").alias("y"), (F.col("x0") + q % patch[1]).cast("int").alias("x"), ch.cast("int").alias("ch"), "v").groupBy("img_id", "y", "x", "ch").agg(F.avg("v").alias("v"))


def sift(images: DataFrame, spacing: int, patch: int, normalise: bool = True) -> DataFrame:
    """Dense SIFT descriptors as (img_id, pos, py, px, x)."""
    def one(i: int, a: np.ndarray) -> list[tuple]:
        at, rows = K.Sift(spacing, patch).extract(a, normalise)
        return [(i, n, int(y), int(x), r.tolist()) for n, ((y, x), r) in enumerate(zip(at, rows))]

    return each_image(images, one, PATCHES)


def sift_dataset(images: DataFrame, n_descriptors: int, patch: int) -> DataFrame:
    """Normalised descriptors, spaced so that about n_descriptors come of the whole collection."""
    each = max(1, n_descriptors // max(1, images.count()))

    def one(i: int, a: np.ndarray) -> list[tuple]:
        at, rows = K.Sift(max(1, int(np.sqrt(a.shape[0] * a.shape[1] / each))), patch).extract(a)
        return [(i, n, int(y), int(x), r.tolist()) for n, ((y, x), r) in enumerate(zip(at, rows))]

    out = each_image(images, one, PATCHES)
    return out.withColumn("x", V.normalize(F.col("x")))


def normalize_sift(rows: DataFrame, contrast: float = 1.0, clip: float = 0.2) -> DataFrame:
    """The descriptor normalisation as expressions."""
    def one(x):
        clipped = lambda n: F.transform(x, lambda v: F.least(v / F.greatest(n, F.lit(contrast)), F.lit(clip)))
        again = lambda y: V.let(V.norm(y), lambda n: F.transform(y, lambda v: v / F.greatest(n, F.lit(V.EPS))))
        return V.let(V.norm(x), lambda n: F.when(n >= contrast, again(clipped(n))).otherwise(clipped(n)))

    return rows.withColumn("x", one(V.doubles(F.col("x"))))


def batch_ids(rows: DataFrame, batch_size: int, order: str = "id") -> DataFrame:
    """A batch number per row by rank; a report for small collections (learners use ``learn.batches``)."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / batch_size).cast("int"))
