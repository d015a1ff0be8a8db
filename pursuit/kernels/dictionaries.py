"""Dictionary updates on arrays: X (signals, features), D (atoms, features), Z (signals, atoms)."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def unit_rows(D: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(D, axis=1, keepdims=True)
    return D / np.where(n > 0, n, 1.0)


def rank_one(R: np.ndarray, start: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) with R ~ u v^T and |v| = 1, by power steps on the smaller Gram matrix."""
    u, s, vt = np.linalg.svd(R, full_matrices=False) if min(R.shape) <= 64 else _power(R, start, rounds)
    v = vt[0]
    sign = 1.0 if v @ start >= 0 else -1.0
    return sign * u[:, 0] * s[0], sign * v


def _power(R: np.ndarray, start: np.ndarray, rounds: int):
    v = start / max(np.linalg.norm(start), EPS)
    for _ in range(rounds):
        v = R.T @ (R @ v)
        v /= max(np.linalg.norm(v), EPS)
    u = R @ v
    s = max(np.linalg.norm(u), EPS)
    return (u / s)[:, None], np.array([s]), v[None]


def sweep(X: np.ndarray, D: np.ndarray, Z: np.ndarray, method: str = "approx", n_cycles: int = 1) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """One pass over the atoms with a shared residual (ksvd, approx or nn): new D, new Z and the unused atoms."""
    D, Z, unused = D.copy(), Z.copy(), set()
    R = X - Z @ D
    for _ in range(n_cycles if method != "nn" else 1):
        for k in range(len(D)):
            on = np.flatnonzero(Z[:, k])
            if not len(on):
                unused.add(k)
                continue
            Rk, z = R[on] + np.outer(Z[on, k], D[k]), Z[on, k]
            if method == "ksvd":
                z, d = rank_one(Rk, D[k])
            elif method == "approx":
                d = Rk.T @ z
                norm = np.linalg.norm(d)
                if norm <= EPS:
                    continue
                d = d / norm
                z = Rk @ d
            elif method == "nn":
                z, d = rank_one(Rk, D[k])
                z, d = np.maximum(z, 0), np.maximum(d, 0)
                for _ in range(n_cycles):
                    if z @ z <= EPS:
                        break
                    d = np.maximum(Rk.T @ z, 0) / (z @ z)
                    if d @ d <= EPS:
                        break
                    z = np.maximum(Rk @ d, 0) / (d @ d)
                norm = np.linalg.norm(d)
                if norm <= EPS or z @ z <= EPS:
                    continue
                z, d = z * norm, d / norm
            else:
                raise ValueError(f"unknown update {method}")
            R[on] = Rk - np.outer(z, d)
            D[k], Z[on, k] = d, z
    return D, Z, unused


def online_update(D: np.ndarray, A: np.ndarray, B: np.ndarray, non_neg: bool = False) -> np.ndarray:
    """All atoms at once: d_k += (b_k - (A D)_k) / (A_kk + eps), then unit norm. A is Z^T Z, B is Z^T X."""
    D = D + (B - A @ D) / (np.diag(A)[:, None] + EPS)
    return unit_rows(np.maximum(D, 0) if non_neg else D)


def gradient_step(D: np.ndarray, A: np.ndarray, B: np.ndarray, eta: float, mu: float = 0.0, non_neg: bool = False) -> np.ndarray:
    """A step down 1/2 |X - Z D|^2 + mu |D D^T - I|^2, then unit norm."""
    grad = A @ D - B
    if mu:
        grad = grad + 4 * mu * (D @ D.T - np.eye(len(D))) @ D
    D = D - eta * grad
    return unit_rows(np.maximum(D, 0) if non_neg else D)


def replace_coherent(D: np.ndarray, use: np.ndarray, spare: np.ndarray, eta: float, most: int = 100) -> np.ndarray:
    """Replaces the less used atom of each pair with coherence eta or more by the least coherent spare datapoint, if that is an improvement."""
    D, left = D.copy(), list(range(len(spare)))
    spare = unit_rows(spare)
    for _ in range(most):
        C = np.abs(D @ D.T) - np.eye(len(D))
        i, j = np.unravel_index(int(C.argmax()), C.shape)
        if C[i, j] < eta or not left:
            break
        k = i if use[i] <= use[j] else j
        worth = [np.abs(np.delete(D, k, 0) @ spare[s]).max() for s in left]
        best = int(np.argmin(worth))
        if worth[best] >= C[i, j]:
            break
        D[k] = spare[left.pop(best)]
    return D
