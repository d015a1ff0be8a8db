"""Sparse coders over a batch of signals: X is (signals, features), D is (atoms, features); codes are (signals, atoms).

Ties go to the lowest atom. Inputs are never changed.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def solve_rows(gram: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many small systems, and which of them are not singular."""
    good = np.ones(len(rhs), bool)
    try:
        return np.linalg.solve(gram, rhs[..., None])[..., 0], good
    except np.linalg.LinAlgError:
        out = np.zeros_like(rhs)
        for i in range(len(rhs)):
            try:
                out[i] = np.linalg.solve(gram[i], rhs[i])
            except np.linalg.LinAlgError:
                good[i] = False
        return out, good


def omp(X: np.ndarray, D: np.ndarray, k: int | None = None, tol: float | None = None, allowed: np.ndarray | None = None, least: float = 1e-10) -> np.ndarray:
    """Orthogonal matching pursuit: up to k atoms, or until the residual norm is below tol; at most one of both rules counts (k first)."""
    if k is None and tol is None:
        raise ValueError("give n_nonzero_coefs or tol")
    m, n = len(X), len(D)
    stop = least if k is not None else tol
    most = n if k is None else min(k, n)
    G, A = D @ D.T, X @ D.T
    Z, support = np.zeros((m, n)), np.zeros((m, 0), int)
    live = np.arange(m)
    R = X.copy()
    for _ in range(most):
        live = live[np.linalg.norm(R[live], axis=1) > stop]
        if not len(live):
            break
        corr = np.abs(R[live] @ D.T)
        if allowed is not None:
            corr = np.where(allowed[live], corr, -1.0)
        pick = corr.argmax(1)
        fresh = (corr[np.arange(len(live)), pick] > 0) & ~(support[live] == pick[:, None]).any(1)
        wide = np.full((m, support.shape[1] + 1), -1)
        wide[:, :-1] = support
        live, pick = live[fresh], pick[fresh]
        wide[live, -1] = pick
        support = wide
        S = support[live]
        z, good = solve_rows(G[S[:, :, None], S[:, None, :]], np.take_along_axis(A[live], S, 1))
        live, S, z = live[good], S[good], z[good]
        Z[live] = 0
        _place(Z, live, S, z)
        R[live] = X[live] - Z[live] @ D
    return Z


def _place(Z: np.ndarray, rows: np.ndarray, S: np.ndarray, z: np.ndarray) -> None:
    Z[rows[:, None], S] = z


def batch_omp(X: np.ndarray, D: np.ndarray, k: int, tol: float | None = None, order_recursive: bool = False) -> np.ndarray:
    """OMP through the Gram matrix by a progressive Cholesky factor; atoms must have unit norm.

    With ``order_recursive`` (ORMP) atoms are chosen by correlation over the distance to the span chosen so far.
    """
    norms = np.linalg.norm(D, axis=1)
    if len(D) and np.abs(norms - 1).max() > 1e-6:
        raise ValueError("batch OMP needs unit-norm atoms")
    m, n = len(X), len(D)
    G, a = D @ D.T, X @ D.T
    k = min(k, n)
    W, V, S = np.zeros((m, k, n)), np.zeros((m, k)), np.zeros((m, k), int)
    used, left, size = np.zeros((m, n), bool), (X * X).sum(1), np.zeros(m, int)
    free = np.ones((m, n))
    live = np.arange(m)
    for t in range(k):
        if tol is not None:
            live = live[left[live] > tol * tol]
        score = np.abs(a[live])
        if order_recursive:
            score = np.where(free[live] > 1e-12, score / np.sqrt(np.maximum(free[live], 1e-12)), 0.0)
        score[used[live]] = -1.0
        pick = score.argmax(1)
        top = np.abs(a[live, pick])
        room = 1 - (W[live, :t, :][np.arange(len(live)), :, pick] ** 2).sum(1) if t else np.ones(len(live))
        go = (top > 1e-10) & (room > EPS) & ~used[live, pick]
        live, pick, room = live[go], pick[go], room[go]
        if not len(live):
            break
        delta = np.sqrt(room)
        mine = W[live, :t, :]
        w = (G[pick] - np.einsum("mt,mtn->mn", mine[np.arange(len(live)), :, pick], mine)) / delta[:, None]
        v = a[live, pick] / delta
        W[live, t], V[live, t], S[live, t] = w, v, pick
        a[live] -= w * v[:, None]
        free[live] -= w * w
        left[live] -= v * v
        used[live, pick] = True
        size[live] = t + 1
    Z = np.zeros((m, n))
    for t in range(1, k + 1):
        rows = np.flatnonzero(size == t)
        if len(rows):
            L = np.tril(np.take_along_axis(W[rows, :t], S[rows, None, :t], 2).transpose(0, 2, 1))
            z = np.linalg.solve(L.transpose(0, 2, 1), V[rows, :t, None])[..., 0]
            _place(Z, rows, S[rows, :t], z)
    return Z


def ormp(X: np.ndarray, D: np.ndarray, k: int | None = None, tol: float | None = None) -> np.ndarray:
    return batch_omp(X, D, len(D) if k is None else k, tol, order_recursive=True)


def nnls(A: np.ndarray, b: np.ndarray, most: int = 300) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson); A has one atom per row."""
    n = len(A)
    x, on = np.zeros(n), np.zeros(n, bool)
    G, c = A @ A.T, A @ b
    limit = 10 * EPS * max(1.0, np.abs(c).max(initial=0.0)) * max(1, n)
    for _ in range(most):
        w = c - G @ x
        w[on] = -np.inf
        j = int(w.argmax()) if n else 0
        if not n or w[j] <= limit:
            break
        on[j] = True
        while True:
            s = np.zeros(n)
            s[on] = np.linalg.lstsq(G[np.ix_(on, on)], c[on], rcond=None)[0]
            low = on & (s <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - s[low], EPS)).min()
            x = x + step * (s - x)
            on &= x > limit
            x[~on] = 0
        x = s
    return x


def nn_omp(X: np.ndarray, D: np.ndarray, k: int, tol: float = 1e-10) -> np.ndarray:
    """Non-negative OMP: the atom that lowers |r|^2 - max(<d, r>, 0)^2 / |d|^2 most, then NNLS on the support."""
    Z, sq = np.zeros((len(X), len(D))), np.maximum((D * D).sum(1), EPS)
    for i, x in enumerate(X):
        support: list[int] = []
        r = x
        for _ in range(min(k, len(D))):
            gain = np.maximum(D @ r, 0) ** 2 / sq
            j = int(gain.argmax())
            if np.linalg.norm(r) <= tol or gain[j] <= tol * tol or j in support:
                break
            support.append(j)
            z = nnls(D[support], x)
            r = x - z @ D[support]
        if support:
            Z[i, support] = nnls(D[support], x)
    return Z


def group_omp(X: np.ndarray, D: np.ndarray, groups: list[list[int]], n_groups: int | None = None, tol: float | None = None) -> np.ndarray:
    """Chooses the group with the largest norm of D_g r, then least squares on all atoms of the chosen groups."""
    Z, _ = _group_omp(X, D, groups, n_groups, tol)
    return Z


def _group_omp(X, D, groups, n_groups, tol):
    if n_groups is None and tol is None:
        raise ValueError("give n_groups or tol")
    stop = 1e-10 if n_groups is not None else tol
    Z, chosen = np.zeros((len(X), len(D))), [[] for _ in X]
    for i, x in enumerate(X):
        r, took = x, chosen[i]
        for _ in range(len(groups) if n_groups is None else min(n_groups, len(groups))):
            if np.linalg.norm(r) <= stop:
                break
            c = D @ r
            g = int(np.argmax([np.linalg.norm(c[list(g)]) for g in groups]))
            if g in took:
                break
            took.append(g)
            S = sorted({a for g in took for a in groups[g]})
            z = np.linalg.lstsq(D[S].T, x, rcond=None)[0]
            Z[i] = 0
            Z[i, S] = z
            r = x - z @ D[S]
    return Z, chosen


def sparse_group_omp(X: np.ndarray, D: np.ndarray, groups: list[list[int]], n_groups: int, k: int) -> np.ndarray:
    """Group OMP chooses groups; OMP then starts again inside their atoms."""
    _, chosen = _group_omp(X, D, groups, n_groups, None)
    allowed = np.zeros((len(X), len(D)), bool)
    for i, took in enumerate(chosen):
        for g in took:
            allowed[i, list(groups[g])] = True
    return omp(X, D, k, allowed=allowed, least=1e-20)


def somp(X: np.ndarray, D: np.ndarray, k: int | None = None, tol: float | None = None) -> np.ndarray:
    """One shared support for all signals of X: the atom with the largest norm of correlations, joint least squares."""
    if k is None and tol is None:
        raise ValueError("give n_nonzero_coefs or tol")
    Z, R, support = np.zeros((len(X), len(D))), X, []
    for _ in range(len(D) if k is None else min(k, len(D))):
        if np.linalg.norm(R) <= (1e-10 if k is not None else tol):
            break
        j = int(np.linalg.norm(R @ D.T, axis=0).argmax())
        if j in support:
            break
        support.append(j)
        z = np.linalg.lstsq(D[support].T, X.T, rcond=None)[0].T
        Z[:] = 0
        Z[:, support] = z
        R = X - z @ D[support]
    return Z


def top_k(A: np.ndarray, k: int, by_abs: bool = False) -> np.ndarray:
    """Keeps the k largest entries of each row (signed unless by_abs), the lower index first among equals."""
    k = min(max(k, 0), A.shape[1])
    at = np.argsort(-(np.abs(A) if by_abs else A), axis=1, kind="stable")[:, :k]
    out = np.zeros_like(A)
    np.put_along_axis(out, at, np.take_along_axis(A, at, 1), 1)
    return out


def thresh(X: np.ndarray, D: np.ndarray, k: int, by_abs: bool = False) -> np.ndarray:
    return top_k(X @ D.T, k, by_abs)


def iht(X: np.ndarray, D: np.ndarray, k: int, eta: float, n_iter: int) -> np.ndarray:
    """Iterative hard thresholding, started from the signed top k of the correlations."""
    Z = thresh(X, D, k)
    for _ in range(n_iter):
        Z = top_k(Z - eta * (Z @ D - X) @ D.T, k, by_abs=True)
    return Z


def llc(X: np.ndarray, D: np.ndarray, knn: int = 5) -> np.ndarray:
    """Locality-constrained codes: the knn nearest atoms, weights that sum to 1."""
    knn = min(knn, len(D))
    far = (X * X).sum(1)[:, None] - 2 * X @ D.T + (D * D).sum(1)
    S = np.argsort(far, axis=1, kind="stable")[:, :knn]
    diff = D[S] - X[:, None, :]
    C = diff @ diff.transpose(0, 2, 1)
    C = C + 1e-4 * np.maximum(np.trace(C, axis1=1, axis2=2), EPS)[:, None, None] * np.eye(knn)
    c = np.linalg.solve(C, np.ones((len(X), knn, 1)))[..., 0]
    Z = np.zeros((len(X), len(D)))
    _place(Z, np.arange(len(X)), S, c / c.sum(1, keepdims=True))
    return Z


def lasso(X: np.ndarray, D: np.ndarray, lam: float, most: int = 5000, tol: float = 1e-10) -> np.ndarray:
    """min 1/2 |x - D z|^2 + lam |z|_1, by cyclic coordinate descent over all signals at once."""
    if lam < 0:
        raise ValueError("lambda must not be negative")
    G, A = D @ D.T, X @ D.T
    Z, H = np.zeros_like(A), np.zeros_like(A)
    for _ in range(most):
        moved = 0.0
        for j in range(len(D)):
            if G[j, j] <= EPS:
                continue
            rho = A[:, j] - H[:, j] + G[j, j] * Z[:, j]
            z = np.sign(rho) * np.maximum(np.abs(rho) - lam, 0) / G[j, j]
            step = z - Z[:, j]
            if np.any(step):
                H += step[:, None] * G[j]
                Z[:, j] = z
                moved = max(moved, float(np.abs(step).max()))
        if moved <= tol:
            break
    return Z
