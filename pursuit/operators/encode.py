"""Sparse and feature encoders: signals in, sparse codes out, no shuffle (but for grouped signals)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..kernels import coders

CODES = "id long, idx array<int>, val array<double>"
#: Signals per call of a kernel: a dense block of codes is rows x atoms doubles.
ROWS = 512
#: A dictionary is held by every worker; this many MB at most.
DICTIONARY_MB = 512

#: Parameters of each algorithm.
PARAMETERS: dict[str, set[str]] = {
    "omp": {"n_nonzero_coefs", "tol"}, "bomp": {"n_nonzero_coefs", "tol"}, "ormp": {"n_nonzero_coefs", "tol"}, "nnomp": {"n_nonzero_coefs", "tol"},
    "thresh": {"n_nonzero_coefs", "nonzero_percentage", "by"}, "iht": {"n_nonzero_coefs", "nonzero_percentage", "eta", "n_iter"},
    "group_omp": {"groups", "n_groups", "tol"}, "sparse_group_omp": {"groups", "n_groups", "n_nonzero_coefs"}, "somp": {"n_nonzero_coefs", "tol"},
    "llc": {"knn"}, "lasso": {"lambda"},
}


def matrix(atoms: DataFrame, key: str = "k", value: str = "d") -> np.ndarray:
    """The dictionary on the driver, atoms in order of ``key``; its size is checked first."""
    facts = atoms.agg(F.count("*").alias("n"), F.max(F.size(value)).alias("d")).first()
    if (facts["n"] or 0) * (facts["d"] or 0) * 8 > DICTIONARY_MB << 20:
        raise ValueError(f"a dictionary of {facts['n']} x {facts['d']} is larger than {DICTIONARY_MB} MB")
    return np.array([r[0] for r in atoms.orderBy(key).select(value).collect()], float)


def signals_of(batch: pa.RecordBatch, column: int = 1) -> np.ndarray:
    """The vectors of a batch as rows; nulls, NaN and uneven lengths are refused."""
    col = batch.column(column)
    if col.null_count or col.flatten().null_count:
        raise ValueError("signals must not be null or have null elements")
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    if not np.isfinite(flat).all():
        raise ValueError("signals must be finite")
    if len(batch) and len(flat) % len(batch):
        raise ValueError("signals must have one length")
    return flat.reshape(len(batch), -1)


def sparse_batch(ids: pa.Array, Z: np.ndarray) -> pa.RecordBatch:
    rows, cols = np.nonzero(Z)
    offsets = pa.array(np.searchsorted(rows, np.arange(len(Z) + 1)), pa.int32())
    idx = pa.ListArray.from_arrays(offsets, pa.array(cols, pa.int32()))
    val = pa.ListArray.from_arrays(offsets, pa.array(Z[rows, cols]))
    return pa.RecordBatch.from_arrays([ids, idx, val], names=["id", "idx", "val"])


class SparseEncoder:
    """``SparseEncoder(algorithm, params).encode(signals, D)`` -> (id, idx, val).

    Signals are rows (id, x); D is an (atoms, features) array or an ``atoms`` table (k, d). The
    dictionary is broadcast once; filters on signals belong before the call. Unknown algorithms and
    unknown, missing or wrong parameters raise ValueError at once.
    """

    def __init__(self, algorithm: str, params: dict | None = None):
        params = dict(params or {})
        if algorithm not in PARAMETERS:
            raise ValueError(f"unknown sparse coder {algorithm}")
        if extra := set(params) - PARAMETERS[algorithm]:
            raise ValueError(f"{algorithm} takes no {sorted(extra)}")
        need = {"bomp": ["n_nonzero_coefs"], "nnomp": ["n_nonzero_coefs"], "iht": ["eta", "n_iter"], "sparse_group_omp": ["n_groups", "n_nonzero_coefs", "groups"], "group_omp": ["groups"], "lasso": ["lambda"]}
        if missing := [p for p in need.get(algorithm, []) if params.get(p) is None]:
            raise ValueError(f"{algorithm} needs {missing}")
        if algorithm in ("omp", "ormp", "somp") and params.get("n_nonzero_coefs") is None and params.get("tol") is None:
            raise ValueError(f"{algorithm} needs n_nonzero_coefs or tol")
        if algorithm in ("thresh", "iht") and params.get("n_nonzero_coefs") is None and params.get("nonzero_percentage") is None:
            raise ValueError(f"{algorithm} needs n_nonzero_coefs or nonzero_percentage")
        if algorithm == "group_omp" and params.get("n_groups") is None and params.get("tol") is None:
            raise ValueError("group_omp needs n_groups or tol")
        if (params.get("n_nonzero_coefs") or 0) < 0 or (params.get("lambda") or 0) < 0:
            raise ValueError("numbers of atoms and lambda must not be negative")
        self.algorithm, self.params = algorithm, params

    def kernel(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        p, k = self.params, self.params.get("n_nonzero_coefs")
        share = lambda D: k if k is not None else int(p["nonzero_percentage"] * len(D))
        return {
            "omp": lambda X, D: coders.omp(X, D, k, p.get("tol")),
            "bomp": lambda X, D: coders.batch_omp(X, D, k, p.get("tol")),
            "ormp": lambda X, D: coders.ormp(X, D, k, p.get("tol")),
            "nnomp": lambda X, D: coders.nn_omp(X, D, k, p.get("tol") or 1e-10),
            "thresh": lambda X, D: coders.thresh(X, D, share(D), p.get("by") == "abs"),
            "iht": lambda X, D: coders.iht(X, D, share(D), p["eta"], p["n_iter"]),
            "group_omp": lambda X, D: coders.group_omp(X, D, p["groups"], p.get("n_groups"), p.get("tol")),
            "sparse_group_omp": lambda X, D: coders.sparse_group_omp(X, D, p["groups"], p["n_groups"], k),
            "somp": lambda X, D: coders.somp(X, D, k, p.get("tol")),
            "llc": lambda X, D: coders.llc(X, D, p.get("knn") or 5),
            "lasso": lambda X, D: coders.lasso(X, D, p["lambda"]),
        }[self.algorithm]

    def encode(self, signals: DataFrame, D: np.ndarray | DataFrame, id_col: str = "id", x_col: str = "x", group_col: str = "grp") -> DataFrame:
        D = matrix(D) if isinstance(D, DataFrame) else np.asarray(D, float)
        held, kernel = signals.sparkSession.sparkContext.broadcast(D), self.kernel()
        rows = signals.select(F.col(id_col).cast("long").alias("id"), V.doubles(F.col(x_col)).alias("x"), *([F.col(group_col).alias("grp")] if self.algorithm == "somp" else []))
        if self.algorithm == "somp":

            def joint(part: pa.Table) -> pa.Table:
                batch = part.select(["id", "x"]).combine_chunks().to_batches()[0]
                return pa.Table.from_batches([sparse_batch(batch.column(0), kernel(signals_of(batch), held.value))])

            return rows.groupBy("grp").applyInArrow(joint, CODES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    yield sparse_batch(part.column(0), kernel(signals_of(part), held.value))

        return rows.mapInArrow(run, CODES)


class FeatureEncoder:
    """``soft_thresholding`` keeps the largest signed correlations; ``sign_splitting`` splits codes of a sparse encoder by sign."""

    def __init__(self, algorithm: str = "soft_thresholding", params: dict | None = None, sparse_coder: SparseEncoder | None = None):
        if algorithm == "soft_thresholding":
            self.inner, self.split = SparseEncoder("thresh", params), False
        elif algorithm == "sign_splitting":
            if sparse_coder is None:
                raise ValueError("sign_splitting needs a sparse coder")
            self.inner, self.split = sparse_coder, True
        else:
            raise ValueError(f"unknown feature encoder {algorithm}")

    def encode(self, signals: DataFrame, D: np.ndarray | DataFrame, **columns: str) -> DataFrame:
        D = matrix(D) if isinstance(D, DataFrame) else np.asarray(D, float)
        out = self.inner.encode(signals, D, **columns)
        if not self.split:
            return out
        n = len(D)
        return out.select("id", F.zip_with("idx", "val", lambda i, v: F.when(v < 0, i + n).otherwise(i)).alias("idx"), F.transform("val", F.abs).alias("val"))


def long_codes(codes: DataFrame) -> DataFrame:
    """(id, k, z) of the non-zero entries."""
    return codes.select("id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("id", F.col("e.idx").alias("k"), F.col("e.val").alias("z"))


def dense(codes: DataFrame, n: int) -> DataFrame:
    """(id, z) with all n entries."""
    at = F.map_from_arrays("idx", "val")
    return codes.select("id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at(at, k), F.lit(0.0))).alias("z"))


def correlations(signals: DataFrame, atoms: DataFrame) -> DataFrame:
    """(id, k, a): inner products of signals and atoms. The atoms are broadcast once their size is checked."""
    few = atoms.select("k", "d")
    return signals.select("id", "x").crossJoin(_small(few)).select("id", "k", V.dot(F.col("x"), F.col("d")).alias("a"))


def grad_step(signals: DataFrame, atoms: DataFrame, codes: DataFrame, step: float) -> DataFrame:
    """(id, k, z): one gradient step on all coefficients of long codes (id, k, z), z + step D (x - z D).

    D x and D D^T are inner products, so signals never meet their reconstructions.
    """
    few = _small(atoms.select("k", "d"))
    pulls = F.broadcast(few.select(F.col("k").alias("used"), F.col("d").alias("e")).crossJoin(few).select("used", "k", V.dot(F.col("e"), F.col("d")).alias("g")))
    back = codes.join(pulls, codes["k"] == pulls["used"]).select("id", pulls["k"], (F.col("z") * F.col("g")).alias("back"), F.when(codes["k"] == pulls["k"], F.col("z")).otherwise(0.0).alias("z"))
    back = back.groupBy("id", "k").agg(F.sum("back").alias("back"), F.sum("z").alias("z"))
    rows = correlations(signals, atoms).join(back, ["id", "k"], "left")
    return rows.select("id", "k", (F.coalesce("z", F.lit(0.0)) + step * (F.col("a") - F.coalesce("back", F.lit(0.0)))).alias("z"))


def _small(atoms: DataFrame) -> DataFrame:
    facts = atoms.agg(F.count("*"), F.max(F.size("d"))).first()
    if (facts[0] or 0) * (facts[1] or 0) * 8 > DICTIONARY_MB << 20:
        raise ValueError("the dictionary is too large to broadcast")
    return F.broadcast(atoms)


def top_k(corr: DataFrame, k: int, by_abs: bool = False) -> DataFrame:
    """The k largest correlations of each signal, as (id, k, z); a ranking that Spark limits before it shuffles."""
    value: Column = F.abs("a") if by_abs else F.col("a")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(value.desc(), "k"))
    return corr.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "k", F.col("a").alias("z"))
