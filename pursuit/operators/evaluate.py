"""Metrics, splits, linear SVM and grid search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .encode import signals_of
from .learn import BUDGET, sums


def class_accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("y_pred") == F.col("y")).cast("double")).alias("accuracy"))


def avg_class_accuracy(rows: DataFrame) -> DataFrame:
    """Mean of the classes' accuracies."""
    by = rows.groupBy("y").agg(F.avg((F.col("y_pred") == F.col("y")).cast("double")).alias("a"))
    return by.agg(F.avg("a").alias("accuracy"))


def average_precision(rows: DataFrame, n_pos: float | None = None, backwards: tuple[Column, ...] = ()) -> DataFrame:
    """Interpolated average precision of (rank, tp, fp) rows in order of rank: the envelope's area over recall.

    ``backwards`` are columns that put the last row first (by default rank, descending); n_pos is the sum
    of tp by default. Rows are dealt into ranges of that order and kept while each range gives its sums, its
    best precision and then its area, which needs the sums before it and the best precision after it. One
    row a range comes to the driver, where the result is made at once.
    """
    spark, order = rows.sparkSession, backwards or (F.desc("rank"),)
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("tp", "fp")}).persist()  # ranges are found by a pass of its own
    ranges = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    held = ranges.select(F.spark_partition_id().alias("range"), "tp", (F.col("tp") + F.col("fp")).alias("n")).persist()
    try:
        sums = np.array(sorted(map(tuple, held.groupBy("range").agg(F.sum("tp"), F.sum("n")).collect())), float).reshape(-1, 3)
        until = dict(zip(sums[:, 0].astype(int).tolist(), sums[::-1, 1:].cumsum(0)[::-1].tolist()))
        best = _areas(held, until, dict.fromkeys(until, 0.0))
        after = np.maximum.accumulate([0.0, *(best[k][0] for k in until)]).tolist()
        area = math.fsum(x for _, x in _areas(held, until, dict(zip(until, after))).values())
    finally:
        held.unpersist()
        rows.unpersist()
    n_pos = sums[:, 1].sum() if n_pos is None else n_pos
    ap = (area / n_pos if n_pos else math.nan) if until else None
    return spark.range(1).select(F.lit(ap).cast("double").alias("ap"))


def _areas(held: DataFrame, until: dict[int, list[float]], after: dict[int, float]) -> dict[int, tuple[float, float]]:
    """(best precision, sum of tp x envelope) by range, one range a partition, its last row first.

    until: sums of tp and of all rows up to the range's end; after: the best precision beyond it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, area = None, 0.0
        for b in batches:
            if b.num_rows:
                if key is None:
                    key = b.column(0)[0].as_py()
                    (tp_at, n_at), top = until[key], after[key]
                tp, n = b.column(1).to_numpy(), b.column(2).to_numpy()
                tps, ns = tp_at - np.r_[0.0, tp.cumsum()], n_at - np.r_[0.0, n.cumsum()]
                tops = np.maximum.accumulate(np.r_[top, tps[:-1] / np.maximum(ns[:-1], 1e-300)])
                tp_at, n_at, top, area = tps[-1], ns[-1], tops[-1], area + tp @ tops[1:]
        if key is not None:
            yield pa.RecordBatch.from_pydict({"range": pa.array([key], pa.int32()), "top": [float(top)], "area": [float(area)]})

    return {k: (top, area) for k, top, area in held.mapInArrow(run, "range int, top double, area double").collect()}


def split(signals: DataFrame, n_train: int, n_test: int | None = None, seed: int | None = 0) -> DataFrame:
    """Adds ``part``: train or test, so many rows of each class without replacement (by id if seed is None); others are left out."""
    order = [F.col("id")] if seed is None else [F.xxhash64(F.lit(seed), "id"), F.col("id")]
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    part = F.when(rank <= n_train, "train").when(rank <= (n_train + n_test if n_test is not None else F.lit(1 << 62)), "test")
    return signals.withColumn("part", part).where(F.col("part").isNotNull())


def folds(signals: DataFrame, k: int) -> DataFrame:
    """Adds ``fold``: the rows of each class dealt out in order of id."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1
    return signals.withColumn("fold", (rank % k).cast("int"))


class LinearSVM:
    """One-vs-rest squared-hinge SVM in the primal, by Newton steps on sums that workers add up.

    The steps solve with the classes' Hessians while those take up to ``hessian_bytes``; beyond, by
    conjugate gradients on Hessian-vector products, one pass each, so that no sum exceeds classes x width.
    Both end at the same weights. Features whose weights exceed the budget of a broadcast are refused.
    """

    def __init__(self, C: float = 1.0, steps: int = 30, hessian_bytes: int = 32 << 20):
        self.C, self.steps, self.hessian_bytes = C, steps, hessian_bytes

    def train(self, signals: DataFrame) -> LinearSVM:
        self.labels = [r[0] for r in signals.select("label").distinct().orderBy("label").collect()]
        rows = signals.select("id", F.concat(V.doubles(F.col("x")), F.array(F.lit(1.0), F.col("label").cast("double"))).alias("x")).persist()
        width = rows.select(F.size("x")).first()[0] - 1
        W, labels, C = np.zeros((len(self.labels), width)), np.array(self.labels, float), self.C
        if W.nbytes > BUDGET:
            raise ValueError("the weights are too large to broadcast")
        whole, context = W.nbytes * width <= self.hessian_bytes, signals.sparkSession.sparkContext
        reg = np.r_[np.ones(width - 1), 1e-8]

        def parts(A: np.ndarray, W: np.ndarray) -> dict[str, np.ndarray]:
            X, Y = A[:, :-1], np.where(A[:, -1:] == labels, 1.0, -1.0)
            slack = np.maximum(0, 1 - Y * (X @ W.T))
            out = {"grad": -2 * (Y * slack).T @ X}
            return out | {"hess": 2 * np.stack([X[on].T @ X[on] for on in slack.T > 0])} if whole else out

        def product(A: np.ndarray, W: np.ndarray, P: np.ndarray) -> dict[str, np.ndarray]:
            X, Y = A[:, :-1], np.where(A[:, -1:] == labels, 1.0, -1.0)
            return {"v": 2 * ((Y * (X @ W.T) < 1) * (X @ P.T)).T @ X}

        def curved(W: np.ndarray, P: np.ndarray) -> np.ndarray:
            held = context.broadcast((W, P))
            return P * reg + C * sums(rows, lambda A: product(A, *held.value))["v"]

        for _ in range(self.steps):
            held = context.broadcast(W)
            s = sums(rows, lambda A, held=held: parts(A, held.value))
            grad = W * reg + C * s["grad"]
            step = np.linalg.solve(np.diag(reg) + C * s["hess"], grad[..., None])[..., 0] if whole else _conjugate(lambda P, W=W: curved(W, P), grad)
            W = W - step
            if np.abs(step).max() < 1e-8 * (1 + np.abs(W).max()):
                break
        rows.unpersist()
        self.W = W
        return self

    def predict(self, signals: DataFrame) -> DataFrame:
        """(id, pred): the class with the largest score, the first of equal ones; the weights are broadcast."""
        held, labels = signals.sparkSession.sparkContext.broadcast(self.W), np.array(self.labels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    best = (signals_of(b) @ held.value[:, :-1].T + held.value[:, -1]).argmax(1)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels[best].astype(np.int32))], names=["id", "pred"])

        return signals.select(F.col("id").cast("long"), V.doubles(F.col("x")).alias("x")).mapInArrow(run, "id long, pred int")


def _conjugate(curved: Callable[[np.ndarray], np.ndarray], grad: np.ndarray, steps: int = 200, least: float = 1e-10) -> np.ndarray:
    """x with curved(x) = grad for each row (a class), all rows in the same passes."""
    x, r = np.zeros_like(grad), grad.copy()
    p, rr = r.copy(), (r * r).sum(1)
    end = least**2 * rr
    for _ in range(steps):
        open_ = rr > end
        if not open_.any():
            break
        q = curved(np.where(open_[:, None], p, 0.0))
        pq = (p * q).sum(1)
        a = np.where(open_, rr / np.where(open_, pq, 1.0), 0.0)[:, None]
        x, r = x + a * p, r - a * q
        new = np.where(open_, (r * r).sum(1), rr)
        p, rr = np.where(open_[:, None], r + (new / np.where(rr > 0, rr, 1.0))[:, None] * p, p), new
    return x


C_GRID = (1e-10, 1e-4, 1e-3, 1e-2, 5e-2, 1e-1, 1.0, 10.0)


def grid_search(signals: DataFrame, make: Callable[..., object], grid: dict[str, tuple], n_folds: int | None = None, n_train: int | None = None, n_test: int | None = None, n_tests: int = 1, refit: bool = True) -> tuple[dict, float, object | None]:
    """(best parameters, score, model refitted on all data): mean accuracy over folds or splits; the first best wins."""
    if (n_folds is None) == (n_train is None):
        raise ValueError("give n_folds or n_train")
    rows = folds(signals, n_folds).persist() if n_folds else None
    runs = [(rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)) for i in range(n_folds)] if n_folds else [(s.where("part = 'train'"), s.where("part = 'test'")) for s in (split(signals, n_train, n_test, seed) for seed in range(n_tests))]
    best: tuple[dict, float] = ({}, -1.0)
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        scores = [make(**params).train(a).predict(b).withColumnRenamed("pred", "y_pred").join(b.select("id", F.col("label").alias("y")), "id") for a, b in runs]
        score = float(np.mean([class_accuracy(s).first()[0] or 0.0 for s in scores]))
        if score > best[1]:
            best = (params, score)
    return (*best, make(**best[0]).train(signals) if refit else None)
