"""Preprocessing of signal collections (id, x)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .encode import signals_of
from .learn import sums


def moments(signals: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and population standard deviation of each feature, in one pass of partial sums about one signal."""
    at = origin(signals)
    s = sums(signals, lambda X: {"n": np.array([len(X)]), "s": (X - at).sum(0), "q": ((X - at) ** 2).sum(0)}) if at is not None else {}
    if not s:
        return 0, np.zeros(0), np.zeros(0)
    n = s["n"][0]
    mean = s["s"] / n
    return int(n), at + mean, np.sqrt(np.maximum(s["q"] / n - mean * mean, 0))


def origin(signals: DataFrame) -> np.ndarray | None:
    """Some signal: sums of squares about it keep their digits when features lie far from zero."""
    row = signals.select(V.doubles(F.col("x")).alias("x")).first()
    return None if row is None else np.array(row["x"], float)


def preprocess(signals: DataFrame, name: str, bias: float = 0.1) -> DataFrame:
    """(id, x): global_centering, global_standarization, local_centering, contrast_normalization, normalization, scaling or whitening."""
    x = V.doubles(F.col("x"))
    local = {"local_centering": V.center, "contrast_normalization": V.contrast_normalize, "normalization": V.normalize, "scaling": V.scale}
    if name in local:
        return signals.withColumn("x", local[name](x))
    if name in ("global_centering", "global_standarization", "global_standardization"):
        _, mean, std = moments(signals)
        m, s = F.array(*[F.lit(float(v)) for v in mean]), F.array(*[F.lit(float(v) if v > 0 else 1.0) for v in std])
        centred = F.zip_with(x, m, lambda a, b: a - b)
        return signals.withColumn("x", centred if name == "global_centering" else F.zip_with(centred, s, lambda a, b: a / b))
    if name == "whitening":
        return whiten(signals, bias)
    raise ValueError(f"unknown preprocessing {name}")


def whiten(signals: DataFrame, bias: float = 0.1) -> DataFrame:
    """ZCA: centred, times E diag(l^-1/2) E^T of the covariance with bias on its diagonal."""
    at = origin(signals)
    s = sums(signals, lambda X: {"n": np.array([len(X)]), "s": (X - at).sum(0), "q": (X - at).T @ (X - at)}) if at is not None else {}
    if not s:
        return signals
    mean = s["s"] / s["n"][0]
    value, vector = np.linalg.eigh(s["q"] / s["n"][0] - np.outer(mean, mean) + bias * np.eye(len(mean)))
    held = signals.sparkSession.sparkContext.broadcast((at + mean, (vector / np.sqrt(value)) @ vector.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, W = held.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(((signals_of(b) - mean) @ W).tolist(), pa.list_(pa.float64()))], names=["id", "x"])

    return signals.select(F.col("id").cast("long"), V.doubles(F.col("x")).alias("x")).mapInArrow(run, "id long, x array<double>")


def local_contrast(signals: DataFrame) -> DataFrame:
    """Centred; divided by max(own deviation, (2 least + mean deviation) / 3)."""
    rows = signals.withColumn("x", V.center(V.doubles(F.col("x")))).withColumn("sd", V.spread(F.col("x")))
    floor = rows.agg(((2 * F.min("sd") + F.avg("sd")) / 3).alias("floor"))
    out = rows.crossJoin(F.broadcast(floor))  # one row
    return out.withColumn("x", V.let(F.greatest("sd", "floor"), lambda s: F.transform("x", lambda v: v / s))).drop("sd", "floor")
