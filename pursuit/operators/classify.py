"""Sparse-representation classification: class errors, concentration index, predictions, features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .encode import SparseEncoder, long_codes, signals_of


def class_matrix(atoms: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = atoms.orderBy("k").select("d", "cls").collect()
    return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])


def class_table(signals: DataFrame, atoms: DataFrame, coder: SparseEncoder, local: bool = False) -> DataFrame:
    """(id, cls, err, nnz): squared error of each class's part of the code, and its non-zeros.

    global: one code over all atoms, of which each class keeps its block; local: a code over each class's own atoms.
    """
    D, cls = class_matrix(atoms)
    labels, kernel = np.unique(cls), coder.kernel()
    held = signals.sparkSession.sparkContext.broadcast((D, cls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        D, cls = held.value
        for b in batches:
            if not b.num_rows:
                continue
            X = signals_of(b)
            Z = None if local else kernel(X, D)
            for c in labels:
                on = cls == c
                z = kernel(X, D[on]) if local else Z[:, on]
                err = ((X - z @ D[on]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(c)] * len(X), pa.int32()), pa.array(err), pa.array((z != 0).sum(1), pa.int32())], names=["id", "cls", "err", "nnz"])

    return signals.select(F.col("id").cast("long"), V.doubles(F.col("x")).alias("x")).mapInArrow(run, "id long, cls int, err double, nnz int")


def predict(table: DataFrame, by: str = "err") -> DataFrame:
    """(id, pred): the class with the least error (``err``) or the sparsest code (``nnz``); ties go to the lower class."""
    return table.groupBy("id").agg(F.min(F.struct(by, "cls"))["cls"].alias("pred"))


def src_predict(signals: DataFrame, atoms: DataFrame, coder: SparseEncoder, method: str = "global") -> DataFrame:
    """Sparsity-constrained coders decide by error, tolerance-constrained ones by sparsity."""
    if method not in ("global", "local"):
        raise ValueError("method must be global or local")
    p = coder.params
    by = "nnz" if p.get("tol") is not None and p.get("n_nonzero_coefs") is None and p.get("n_groups") is None else "err"
    return predict(class_table(signals, atoms, coder, method == "local"), by)


def features(table: DataFrame) -> DataFrame:
    """(id, cls, f): the class errors of each signal scaled to unit norm."""
    n = table.groupBy("id").agg(F.sqrt(F.sum(F.col("err") * F.col("err"))).alias("n"))
    return table.join(n, "id").select("id", "cls", (F.col("err") / (F.col("n") + V.EPS)).alias("f"))


def sci(codes: DataFrame, atoms: DataFrame, reg: str = "l1") -> DataFrame:
    """(id, sci): (C max_c s_c / s - 1) / (C - 1) with s the l0 or l1 size of the code; codes without entries are left out. With one class it is 1."""
    if reg not in ("l0", "l1"):
        raise ValueError("reg must be l0 or l1")
    n = atoms.select(F.countDistinct("cls")).first()[0]
    if n == 1:
        return long_codes(codes).select("id", F.lit(1.0).alias("sci")).distinct()
    size = F.abs("z") if reg == "l1" else F.lit(1.0)
    by = long_codes(codes).join(F.broadcast(atoms.select("k", "cls")), "k").groupBy("id", "cls").agg(F.sum(size).alias("s"))
    return by.groupBy("id").agg(((n * F.max("s") / F.sum("s") - 1) / (n - 1)).alias("sci"))


class SRC:
    """``train`` takes a class dictionary or samples normalised datapoints per class; ``predict`` -> (id, pred)."""

    def __init__(self, coder: SparseEncoder, n_class_samples: int | None = None, learner=None, method: str = "global", seed: int = 0):
        if (n_class_samples is None) == (learner is None):
            raise ValueError("give n_class_samples or a class learner")
        self.coder, self.n, self.learner, self.method, self.seed = coder, n_class_samples, learner, method, seed

    def train(self, signals: DataFrame) -> SRC:
        self.atoms = self.learner.fit(signals) if self.learner else sample_atoms(signals, self.n, self.seed)
        return self

    def predict(self, signals: DataFrame) -> DataFrame:
        return src_predict(signals, self.atoms, self.coder, self.method)


def sample_atoms(signals: DataFrame, per_class: int, seed: int | None = 0) -> DataFrame:
    """(k, d, cls): so many normalised datapoints of each class, by hash (or by id if seed is None)."""


    order = [F.col("id")] if seed is None else [F.xxhash64(F.lit(seed), "id"), F.col("id")]
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    rows = signals.withColumn("rank", rank).where(F.col("rank") <= per_class)
    k = F.row_number().over(Window.orderBy("label", "rank")) - 1  # per_class rows a class
    return rows.select(k.cast("int").alias("k"), V.normalize(V.doubles(F.col("x"))).alias("d"), F.col("label").cast("int").alias("cls"))


class SRCFeatures:
    """Class errors as features of a linear SVM."""

    def __init__(self, src: SRC, svm):
        self.src, self.svm = src, svm

    def _table(self, signals: DataFrame) -> DataFrame:
        f = features(class_table(signals, self.src.atoms, self.src.coder, self.src.method == "local"))
        return f.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "f"))), lambda s: s["f"]).alias("x"))

    def train(self, signals: DataFrame) -> SRCFeatures:
        self.src.train(signals)
        self.svm.train(self._table(signals).join(signals.select("id", "label"), "id"))
        return self

    def predict(self, signals: DataFrame) -> DataFrame:
        return self.svm.predict(self._table(signals))
