"""Dictionary learners.

Encoding is distributed. Online learning, projected gradient and the distributed form of approximate
K-SVD need only the sums Z^T Z and Z^T X, which workers add up per partition. The exact K-SVD sweep is
sequential over atoms on one residual; it runs on the driver for data under a checked budget.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..kernels import dictionaries as K
from .dictionary import force_incoherence, init_dictionary, to_atoms
from .encode import ROWS, SparseEncoder, matrix, signals_of

#: Data of an exact K-SVD must fit so many bytes on the driver.
BUDGET = 512 << 20
PATIENCE = 10
#: Numbers of a partial sum that travel in one row.
BLOCK = 4096


def sums(rows: DataFrame, parts: Callable[[np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Adds up arrays that ``parts`` makes of batches of (id, x).

    Each partition sends one set of sums in blocks of BLOCK numbers; the blocks of one place meet in
    one adder, which holds one sum for each place whatever the number of partitions.
    """
    columns = "name string, at long, v binary, shape array<int>"

    def blocks(total: dict[tuple[str, int, tuple[int, ...]], np.ndarray]) -> pa.RecordBatch:
        keys = list(total)
        values = pa.array([total[k].tobytes() for k in keys], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), values, pa.array([list(k[2]) for k in keys], pa.list_(pa.int32()))], names=["name", "at", "v", "shape"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for name, a in parts(signals_of(batch.slice(at, ROWS))).items():
                    total[name] = total[name] + a if name in total else np.asarray(a, float)
        yield blocks({(name, at, a.shape): a.ravel()[at : at + BLOCK] for name, a in total.items() for at in range(0, a.size, BLOCK)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int, tuple[int, ...]], np.ndarray] = {}
        for batch in batches:
            for name, at, v, shape in zip(*(c.to_pylist() for c in batch.columns)):
                key, a = (name, at, tuple(shape)), np.frombuffer(v)
                total[key] = total[key] + a if key in total else a
        yield blocks(total)

    done = rows.select("id", V.doubles(F.col("x")).alias("x")).mapInArrow(run, columns).repartition("name", "at").mapInArrow(add, columns)
    out: dict[str, np.ndarray] = {}
    for r in done.collect():
        v = np.frombuffer(r["v"])
        out.setdefault(r["name"], np.zeros(r["shape"])).reshape(-1)[r["at"] : r["at"] + len(v)] = v
    return out


def statistics(signals: DataFrame, D: np.ndarray, coder: SparseEncoder) -> dict[str, np.ndarray]:
    """A = Z^T Z, B = Z^T X, squared error and use of each atom, in one pass."""
    held, kernel = signals.sparkSession.sparkContext.broadcast(D), coder.kernel()

    def parts(X: np.ndarray) -> dict[str, np.ndarray]:
        Z = kernel(X, held.value)
        return {"A": Z.T @ Z, "B": Z.T @ X, "error": np.array([((X - Z @ held.value) ** 2).sum()]), "use": (Z != 0).sum(0)}

    zero = {"A": np.zeros((len(D), len(D))), "B": np.zeros_like(D), "error": np.zeros(1), "use": np.zeros(len(D))}
    return zero | sums(signals, parts)


def start(signals: DataFrame, n_atoms: int, init: np.ndarray | None, seed: int, method: str = "data") -> np.ndarray:
    return np.array(init, float) if init is not None else matrix(init_dictionary(signals, n_atoms, method, seed=seed).drop("id"))


class Learner:
    """``fit`` learns ``D``; ``encode`` codes signals over it; calling does both."""

    D: np.ndarray | None = None

    def __init__(self, n_atoms: int, sparse_coder: SparseEncoder, init: np.ndarray | None = None, seed: int = 0):
        if n_atoms < 1:
            raise ValueError("n_atoms must be positive")
        self.n_atoms, self.coder, self.init, self.seed = n_atoms, sparse_coder, init, seed
        self.errors: list[float] = []

    def encode(self, signals: DataFrame) -> DataFrame:
        if self.D is None:
            raise ValueError("fit first")
        return self.coder.encode(signals, self.D)

    def atoms(self, spark) -> DataFrame:
        return to_atoms(spark, self.D)

    def __call__(self, signals: DataFrame) -> DataFrame:
        return self.fit(signals).encode(signals)

    def fit(self, signals: DataFrame) -> Learner:
        raise NotImplementedError

    def _stalled(self) -> bool:
        """Whether the error hasn't improved for PATIENCE rounds."""
        return len(self.errors) > PATIENCE and min(self.errors[-PATIENCE:]) >= min(self.errors[:-PATIENCE])


class KSVD(Learner):
    """method: ``approx`` (default), ``ksvd`` or ``nn``; mode: ``exact`` (driver sweep, budgeted) or ``distributed`` (all atoms from one pass of sums, approx only)."""

    def __init__(self, n_atoms: int, sparse_coder: SparseEncoder, max_iter: int = 10, method: str = "approx", n_cycles: int = 1, eta: float | None = None, mode: str = "exact", **more):
        super().__init__(n_atoms, sparse_coder, **more)
        if method not in ("approx", "ksvd", "nn") or mode not in ("exact", "distributed") or mode == "distributed" and method != "approx":
            raise ValueError("unknown method or mode")
        self.max_iter, self.method, self.n_cycles, self.eta, self.mode = max_iter, method, n_cycles, eta, mode

    def fit(self, signals: DataFrame) -> KSVD:
        self.errors, D = [], start(signals, self.n_atoms, self.init, self.seed)
        if self.mode == "distributed":
            for i in range(self.max_iter):
                s = statistics(signals, D, self.coder)
                self.errors.append(float(s["error"][0]))
                R = s["B"] - s["A"] @ D + np.diag(s["A"])[:, None] * D
                used = np.linalg.norm(R, axis=1) > K.EPS
                D = np.where(used[:, None], K.unit_rows(R), D)
                D = force_incoherence(signals, D, s["use"], self.eta, seed=self.seed + i) if self.eta and i + 1 < self.max_iter else D
                if self._stalled():
                    break
            self.D = D
            return self
        n, width = signals.agg(F.count("*"), F.max(F.size("x"))).first()
        if (n or 0) * ((width or 0) + len(D)) * 8 > BUDGET:
            raise ValueError("too large for an exact sweep on the driver; use mode='distributed'")
        X = np.array([r[0] for r in signals.orderBy("id").select(V.doubles(F.col("x"))).collect()], float)
        self.D, self.Z, self.errors = fit_arrays(X, D, self.coder, self.max_iter, self.method, self.n_cycles, self.eta, self.seed)
        return self


def fit_arrays(X, D, coder, max_iter, method="approx", n_cycles=1, eta=None, seed=0):
    """K-SVD on arrays: encode, sweep, replace unused atoms by unused datapoints, optionally force incoherence."""
    rng, kernel, errors = np.random.default_rng(seed), coder.kernel(), []
    spare = list(rng.permutation(np.flatnonzero((X * X).sum(1) > 1e-6)))
    Z = np.zeros((len(X), len(D)))
    for i in range(max_iter):
        Z = kernel(X, D)
        D, Z, unused = K.sweep(X, D, Z, method, n_cycles)
        for k in sorted(unused):
            if spare:
                D[k] = K.unit_rows(X[[spare.pop()]])[0]
        if eta and i + 1 < max_iter:
            D = K.replace_coherent(D, np.linalg.norm(Z, axis=0), X[spare[:100]], eta)
        errors.append(float(((X - Z @ D) ** 2).sum()))
        if len(errors) > PATIENCE and min(errors[-PATIENCE:]) >= min(errors[:-PATIENCE]):
            break
    return D, Z, errors


class OnlineLearner(Learner):
    """Mini-batches by explicit batch id (rank of the id div batch_size); A and B decay by beta and are kept for the next fit."""

    def __init__(self, n_atoms: int, sparse_coder: SparseEncoder, batch_size: int | None = None, beta: float | None = None, n_epochs: int = 1, non_neg: bool = False, **more):
        super().__init__(n_atoms, sparse_coder, **more)
        self.batch_size, self.beta, self.n_epochs, self.non_neg = batch_size, beta, n_epochs, non_neg
        self.A: np.ndarray | None = None
        self.B: np.ndarray | None = None

    def step(self, batch: DataFrame, beta: float) -> None:
        s = statistics(batch, self.D, self.coder)
        first = self.A is None
        self.A = s["A"] if first else beta * self.A + s["A"]
        self.B = s["B"] if first else beta * self.B + s["B"]
        self.D = K.online_update(self.D, self.A, self.B, self.non_neg)
        self.errors.append(float(s["error"][0]))

    def fit(self, signals: DataFrame) -> OnlineLearner:
        self.D = start(signals, self.n_atoms, self.init, self.seed) if self.D is None else self.D
        batch, n = each_batch(signals, self.batch_size)
        for _ in range(self.n_epochs):
            for i, beta in enumerate(np.linspace(0, 1, n) if self.beta is None else [self.beta] * n):
                self.step(batch(i), float(beta))
        return self


class GradientLearner(Learner):
    """Projected gradient on mini-batches."""

    def __init__(self, n_atoms: int, sparse_coder: SparseEncoder, eta: float, mu: float = 0.0, batch_size: int | None = None, n_epochs: int = 1, non_neg: bool = False, **more):
        super().__init__(n_atoms, sparse_coder, **more)
        self.eta, self.mu, self.batch_size, self.n_epochs, self.non_neg = eta, mu, batch_size, n_epochs, non_neg

    def fit(self, signals: DataFrame) -> GradientLearner:
        self.D = start(signals, self.n_atoms, self.init, self.seed)
        batch, n = each_batch(signals, self.batch_size)
        for _ in range(self.n_epochs):
            for i in range(n):
                s = statistics(batch(i), self.D, self.coder)
                self.errors.append(float(s["error"][0]))
                self.D = K.gradient_step(self.D, s["A"], s["B"], self.eta, self.mu, self.non_neg)
            if self._stalled():
                break
        return self


def batch_bounds(signals: DataFrame, batch_size: int | None) -> list[int]:
    """The first id of each batch and one above the last id; empty without rows.

    Batches are ranges of ids, found from quantiles of the ids without ranking all rows in one task;
    with ids 0..n-1 each has exactly batch_size of them.
    """
    low, high, n = signals.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if not n:
        return []
    count = -(-n // batch_size) if batch_size else 1
    if high - low + 1 == n:
        edges = [low + k * batch_size for k in range(1, count)]
    else:
        edges = [int(e) for e in signals.approxQuantile("id", [k / count for k in range(1, count)], 0.0)] if count > 1 else []
    return [low, *edges, high + 1]


def each_batch(signals: DataFrame, batch_size: int | None) -> tuple[Callable[[int], DataFrame], int]:
    """A function that gives the i-th batch, and the number of batches; a batch's bounds reach the scan."""
    bounds = batch_bounds(signals, batch_size)
    return lambda i: signals.where((F.col("id") >= bounds[i]) & (F.col("id") < bounds[i + 1])), max(0, len(bounds) - 1)


def batches(signals: DataFrame, batch_size: int | None) -> tuple[DataFrame, int]:
    """Signals with a batch number, and the number of batches."""
    bounds = batch_bounds(signals, batch_size)
    edges = F.array(*[F.lit(e) for e in bounds[1:-1]]).cast("array<bigint>")
    return signals.withColumn("batch", F.size(F.filter(edges, lambda e: e <= F.col("id")))), max(0, len(bounds) - 1)



class ClassKSVD:
    """One dictionary per class, each learned in its own task; ``atoms`` has columns k, d, cls."""

    def __init__(self, n_class_atoms: int | list[int] | None = None, sparse_coder: SparseEncoder | None = None, atom_ratio: float | None = None, max_iter: int = 5, method: str = "approx", alpha: float | None = None, seed: int = 0):
        if (n_class_atoms is None) == (atom_ratio is None):
            raise ValueError("give n_class_atoms or atom_ratio")
        self.n, self.coder, self.ratio, self.max_iter, self.method, self.alpha, self.seed = n_class_atoms, sparse_coder or SparseEncoder("bomp", {"n_nonzero_coefs": 3}), atom_ratio, max_iter, method, alpha, seed

    def fit(self, signals: DataFrame) -> DataFrame:
        sizes = {r[0]: r[1] for r in signals.groupBy("label").count().orderBy("label").collect()}
        labels = sorted(sizes)
        want = {c: int(self.ratio * sizes[c]) if self.ratio else self.n if isinstance(self.n, int) else self.n[i] for i, c in enumerate(labels)}
        if few := [c for c in labels if want[c] > sizes[c] or want[c] < 1]:
            raise ValueError(f"classes {few} have too few datapoints")
        coder, max_iter, method, seed = self.coder, self.max_iter, self.method, self.seed

        def learn(part: pa.Table) -> pa.Table:
            c = part.column("label")[0].as_py()
            part = part.sort_by("id")
            X = signals_of(part.select(["id", "x"]).combine_chunks().to_batches()[0])
            rng = np.random.default_rng([seed, int(c)])
            some = rng.permutation(np.flatnonzero((X * X).sum(1) > 1e-6))[: want[c]]
            D, _, _ = fit_arrays(X, K.unit_rows(X[some]), coder, max_iter, method, seed=seed)
            return pa.table({"cls": pa.array([c] * len(D), pa.int32()), "j": pa.array(range(len(D)), pa.int32()), "d": pa.array(D.tolist(), pa.list_(pa.float64()))})

        rows = signals.select(F.col("label").cast("int").alias("label"), "id", V.doubles(F.col("x")).alias("x")).groupBy("label").applyInArrow(learn, "cls int, j int, d array<double>")
        offset, at = {}, 0
        for c in labels:
            offset[c], at = at, at + want[c]
        place = F.create_map(*[F.lit(v) for pair in offset.items() for v in pair])
        atoms = rows.select((F.element_at(place, F.col("cls")) + F.col("j")).cast("int").alias("k"), "d", "cls")
        if self.alpha is not None:
            from .dictionary import drop_coherent

            atoms = drop_coherent(atoms, self.alpha)
        return atoms


class LCKSVD:
    """Label-consistent K-SVD: signals, label blocks and class blocks are stacked; prediction is argmax W z."""

    def __init__(self, n_class_atoms: int, sparse_coder: SparseEncoder, alpha: float = 1.0, beta: float = 1.0, ridge: float = 1.0, max_iter: int = 5, seed: int = 0):
        self.n, self.coder, self.alpha, self.beta, self.ridge, self.max_iter, self.seed = n_class_atoms, sparse_coder, alpha, beta, ridge, max_iter, seed

    def fit(self, signals: DataFrame) -> LCKSVD:
        n, width, classes = signals.agg(F.count("*"), F.max(F.size("x")), F.countDistinct("label")).first()
        if n * (width + classes * (self.n + 1)) * 8 > BUDGET:
            raise ValueError("too large for an exact sweep on the driver")
        rows = signals.orderBy("id").select(V.doubles(F.col("x")), "label").collect()
        X, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
        self.labels = np.unique(y)
        rng, starts = np.random.default_rng(self.seed), []
        for c in self.labels:
            at = rng.permutation(np.flatnonzero((y == c) & ((X * X).sum(1) > 1e-6)))[: self.n]
            if len(at) < self.n:
                raise ValueError(f"class {c} has too few datapoints")
            starts.append(X[at])
        D, cls = K.unit_rows(np.concatenate(starts)), np.repeat(self.labels, self.n)
        Q, H = (y[:, None] == cls).astype(float), (y[:, None] == self.labels).astype(float)
        kernel = self.coder.kernel()
        Z = kernel(X, D)
        fit = lambda Y: np.linalg.solve(Z.T @ Z + self.ridge * np.eye(len(D)), Z.T @ Y)
        G, W = fit(Q), fit(H)
        a, b = np.sqrt(self.alpha), np.sqrt(self.beta)
        S, w = np.hstack([X, a * Q, b * H]), X.shape[1]
        for _ in range(self.max_iter):
            stacked = np.hstack([D, a * G, b * W])
            norms = np.maximum(np.linalg.norm(stacked, axis=1, keepdims=True), K.EPS)
            Z = kernel(S, stacked / norms)
            new, Z, _ = K.sweep(S, stacked / norms, Z, "approx")
            scale = np.maximum(np.linalg.norm(new[:, :w], axis=1, keepdims=True), K.EPS)
            new = new / scale
            D, G, W = new[:, :w], new[:, w : w + len(cls)] / max(a, K.EPS), new[:, w + len(cls) :] / max(b, K.EPS)
        self.D, self.W, self.cls = D, W, cls
        return self

    def predict(self, signals: DataFrame) -> DataFrame:
        """(id, pred)"""
        held, kernel, labels = signals.sparkSession.sparkContext.broadcast((self.D, self.W)), self.coder.kernel(), self.labels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            D, W = held.value
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels[(kernel(signals_of(b), D) @ W).argmax(1)], pa.int32())], names=["id", "pred"])

        return signals.select(F.col("id").cast("long"), V.doubles(F.col("x")).alias("x")).mapInArrow(run, "id long, pred int")

