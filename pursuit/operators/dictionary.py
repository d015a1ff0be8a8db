"""Dictionary operations on tables: initialisation, coherence, reconstruction error, replacement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..kernels import dictionaries as K

NONZERO = 1e-6


def nonzero(signals: DataFrame, x: str = "x") -> DataFrame:
    return signals.where(V.sqnorm(F.col(x)) > NONZERO)


def init_dictionary(signals: DataFrame, n_atoms: int, method: str = "data", normalize: bool = True, seed: int = 0) -> DataFrame:
    """(k, d): ``data`` (random non-zero datapoints), ``first`` (those with the smallest ids), ``svd`` or ``random``."""
    spark = signals.sparkSession
    if method in ("data", "first"):
        order = [F.xxhash64(F.lit(seed), "id"), F.col("id")] if method == "data" else [F.col("id")]
        rows = nonzero(signals).orderBy(*order).limit(n_atoms).select("id", "x")
        if rows.count() < n_atoms:
            raise ValueError(f"fewer than {n_atoms} non-zero datapoints")
        rank = (F.row_number().over(Window.orderBy(*order)) - 1).cast("int")  # n_atoms rows
        return rows.select(rank.alias("k"), (V.normalize(F.col("x")) if normalize else F.col("x")).alias("d"), "id")
    width = signals.select(F.size("x")).first()[0]
    if method == "svd":
        D = np.zeros((n_atoms, width))
        vectors = np.linalg.eigh(gram_of(signals))[1][:, ::-1].T[:n_atoms]
        D[: len(vectors)] = vectors
    elif method == "random":
        D = np.random.default_rng(seed).standard_normal((n_atoms, width))
        D = K.unit_rows(D) if normalize else D
    else:
        raise ValueError(f"unknown method {method}")
    return to_atoms(spark, D)


def to_atoms(spark, D: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, d.tolist()) for k, d in enumerate(D)], "k int, d array<double>")


def gram_of(signals: DataFrame) -> np.ndarray:
    """X^T X (features x features), summed in the workers."""
    from .learn import sums

    return sums(signals.select("id", "x"), lambda X: {"g": X.T @ X})["g"]


def unused_data(signals: DataFrame, atoms: DataFrame) -> DataFrame:
    """Datapoints that no atom was taken from (atoms with an id column)."""
    return nonzero(signals).join(atoms.select("id"), "id", "left_anti")


def gram(atoms: DataFrame) -> DataFrame:
    """(k1, k2, g) of all atom pairs; a dictionary is small, so it is broadcast to itself."""
    a, b = atoms.select(F.col("k").alias("k1"), F.col("d").alias("d1")), atoms.select(F.col("k").alias("k2"), F.col("d").alias("d2"))
    return a.crossJoin(F.broadcast(b)).select("k1", "k2", V.dot(F.col("d1"), F.col("d2")).alias("g"))


def mutual_coherence(atoms: DataFrame) -> DataFrame:
    """Mean absolute inner product of different atoms."""
    return gram(atoms).where("k1 <> k2").agg(F.avg(F.abs("g")).alias("coherence"))


def coherent_pairs(one: DataFrame, two: DataFrame, thresh: float | None = None, kappa: int | None = None) -> DataFrame:
    """(k, l, g) of atom pairs above a threshold, or the kappa most coherent ones."""
    a, b = one.select("k", F.col("d").alias("d1")), two.select(F.col("k").alias("l"), F.col("d").alias("d2"))
    pairs = a.crossJoin(F.broadcast(b)).select("k", "l", F.abs(V.dot(F.col("d1"), F.col("d2"))).alias("g"))
    if kappa is not None:
        return pairs.orderBy(F.col("g").desc(), "k", "l").limit(kappa)
    if thresh is None:
        raise ValueError("give thresh or kappa")
    return pairs.where(F.col("g") > thresh)


def unused_atoms(atoms: DataFrame, codes: DataFrame) -> DataFrame:
    """Atoms that no code uses."""
    used = codes.select(F.explode("idx").alias("k")).distinct()
    return atoms.join(used, "k", "left_anti")


def support(codes: DataFrame, k: int) -> DataFrame:
    return codes.where(F.array_contains("idx", k))


def class_atoms(n_class_atoms: list[int], cls: int) -> list[int]:
    """The atoms of a class, whose ranges follow each other."""
    start = sum(n_class_atoms[:cls])
    return list(range(start, start + n_class_atoms[cls]))


def reconstruct(codes: DataFrame, atoms: DataFrame) -> DataFrame:
    """(id, r): the sum of the atoms that each code weighs; the atoms are broadcast, the entries of a signal meet by id."""
    rows = codes.select("id", F.explode(F.arrays_zip("idx", "val")).alias("e")).join(F.broadcast(atoms.select(F.col("k").alias("idx"), "d")), F.col("e.idx") == F.col("idx"))
    parts = rows.select("id", F.posexplode(F.transform("d", lambda v: v * F.col("e.val"))).alias("p", "v")).groupBy("id", "p").agg(F.sum("v").alias("v"))
    return parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("r"))


def approx_error(signals: DataFrame, codes: DataFrame, atoms: DataFrame) -> DataFrame:
    """Squared Frobenius norm of what the codes leave."""
    back = signals.select("id", "x").join(reconstruct(codes, atoms), "id", "left")
    left = F.when(F.col("r").isNull(), V.sqnorm(F.col("x"))).otherwise(V.sqnorm(F.zip_with("x", "r", lambda a, b: a - b)))
    return back.agg(F.sum(left).alias("error"))


def force_incoherence(signals: DataFrame, D: np.ndarray, use: np.ndarray, eta: float, candidates: int = 100, seed: int = 0) -> np.ndarray:
    """Replaces atoms of coherent pairs by sampled datapoints that fit in better."""
    rows = nonzero(signals).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(candidates).select("x").collect()
    return K.replace_coherent(D, use, np.array([r[0] for r in rows], float), eta) if rows else D


def drop_coherent(atoms: DataFrame, thresh: float) -> DataFrame:
    """Atoms less those of a class that are coherent with an atom of an earlier class; each goes once."""
    a, b = atoms.select(F.col("d").alias("d1"), F.col("cls").alias("c1")), atoms.select("k", "d", "cls")
    bad = b.crossJoin(F.broadcast(a)).where((F.col("c1") < F.col("cls")) & (F.abs(V.dot(F.col("d1"), F.col("d"))) > thresh)).select("k").distinct()
    return atoms.join(bad, "k", "left_anti")
