"""Solver invariants on arrays."""

import numpy as np
import pytest

from pursuit.kernels import coders, dictionaries, imaging

RNG = np.random.default_rng(0)
D = dictionaries.unit_rows(RNG.standard_normal((24, 16)))
X = RNG.standard_normal((40, 16))


def nnz(Z):
    return (Z != 0).sum(1)


def test_omp_residual_is_orthogonal_to_the_support():
    Z = coders.omp(X, D, 4)
    R = X - Z @ D
    assert (nnz(Z) <= 4).all()
    assert max(np.abs(D[z != 0] @ r).max() for z, r in zip(Z, R)) < 1e-9


def test_batch_omp_equals_omp_and_k_may_exceed_the_atoms():
    for k in (0, 1, 3, 6):
        assert np.allclose(coders.omp(X, D, k), coders.batch_omp(X, D, k))
    assert (nnz(coders.batch_omp(X, D[:3], 10)) <= 3).all()
    with pytest.raises(ValueError):
        coders.batch_omp(X, 2 * D, 2)


def test_planted_supports_are_recovered():
    big = dictionaries.unit_rows(RNG.standard_normal((32, 200)))
    Z = np.zeros((30, 32))
    for z in Z:
        z[RNG.permutation(32)[:3]] = RNG.uniform(1, 2, 3) * RNG.choice([-1, 1], 3)
    for f in (coders.omp, coders.batch_omp, coders.ormp):
        assert np.allclose(f(Z @ big, big, 3), Z)


def test_tolerances():
    Z = coders.omp(X, D, tol=1.0)
    assert (np.linalg.norm(X - Z @ D, axis=1) <= 1.0 + 1e-9).all()
    assert (np.linalg.norm(X - coders.batch_omp(X, D, 16, tol=1.0) @ D, axis=1) <= 1.0 + 1e-6).all()
    assert not coders.omp(np.zeros((2, 16)), D, 3).any()
    with pytest.raises(ValueError):
        coders.omp(X, D)


def test_duplicate_atoms_are_harmless():
    twice = np.vstack([D, D])
    assert np.allclose(coders.omp(X, twice, 4) @ twice, coders.omp(X, D, 4) @ D)
    assert np.isfinite(coders.batch_omp(X, twice, 20)).all()


def test_non_negative():
    Z = coders.nn_omp(X, D, 4)
    assert (Z >= 0).all() and (nnz(Z) <= 4).all()
    A, b = np.abs(RNG.standard_normal((6, 10))), RNG.standard_normal(10)
    z = coders.nnls(A, b)
    w = A @ (b - z @ A)
    assert (z >= 0).all() and (w <= 1e-8).all() and np.abs(w[z > 0]).max(initial=0) < 1e-8


def test_groups():
    singles = [[k] for k in range(len(D))]
    assert np.allclose(coders.group_omp(X, D, singles, 3), coders.omp(X, D, 3))
    groups = [list(range(4 * g, 4 * g + 4)) for g in range(6)]
    Z = coders.sparse_group_omp(X, D, groups, 2, 3)
    assert (nnz(Z) <= 3).all() and all(len({k // 4 for k in np.flatnonzero(z)}) <= 2 for z in Z)


def test_somp_with_one_signal_is_omp_and_shares_supports():
    assert np.allclose(np.vstack([coders.somp(x[None], D, 3) for x in X]), coders.omp(X, D, 3))
    assert len({tuple(np.flatnonzero(z)) for z in coders.somp(X, D, 3)}) == 1


def test_llc_sums_to_one_and_lasso_meets_its_conditions():
    Z = coders.llc(X, D, 5)
    assert np.allclose(Z.sum(1), 1) and (nnz(Z) <= 5).all()
    Z = coders.lasso(X, D, 0.4)
    C = (X - Z @ D) @ D.T
    assert (np.abs(C) <= 0.4 + 1e-6).all() and np.allclose(C[Z != 0], 0.4 * np.sign(Z[Z != 0]), atol=1e-6)


def test_iht_keeps_k_and_ties_go_to_the_lower_atom():
    assert (nnz(coders.iht(X, D, 3, 0.3, 5)) <= 3).all()
    assert coders.top_k(np.array([[1.0, 2.0, 2.0, 2.0]]), 2).tolist() == [[0, 2, 2, 0]]


@pytest.mark.parametrize("method", ["ksvd", "approx", "nn"])
def test_sweeps_do_not_raise_the_error(method):
    Y, start = (np.abs(X), np.abs(D)) if method == "nn" else (X, D)
    start = dictionaries.unit_rows(start)
    Z = coders.nn_omp(Y, start, 3) if method == "nn" else coders.omp(Y, start, 3)
    new, Z2, unused = dictionaries.sweep(Y, start, Z, method, 2)
    assert ((Y - Z2 @ new) ** 2).sum() <= ((Y - Z @ start) ** 2).sum() + 1e-9
    assert np.allclose(np.linalg.norm(new, axis=1), 1) and ((Z2 != 0) <= (Z != 0)).all()
    assert unused == {k for k in range(len(D)) if not Z[:, k].any()} and (method != "nn" or (new >= 0).all())


def test_images():
    img = np.arange(5 * 7 * 2, dtype=float).reshape(5, 7, 2)
    at, rows = imaging.patches(img, (3, 2), (2, 3))
    assert all((img[y : y + 3, x : x + 2].ravel() == r).all() for (y, x), r in zip(at, rows)) and len(at) == 4
    assert len(imaging.patches(img, (6, 2))[1]) == 0
    at, rows = imaging.patches(img, (3, 2))
    assert np.allclose(imaging.rebuild(5, 7, 2, at, rows, (3, 2)), img)
    a, k = RNG.standard_normal((9, 8)), RNG.standard_normal((3, 3))
    want = [[sum(a[y + 1 - i, x + 1 - j] * k[i, j] for i in range(3) for j in range(3) if 0 <= y + 1 - i < 9 and 0 <= x + 1 - j < 8) for x in range(8)] for y in range(9)]
    assert np.allclose(imaging.convolve_same(a, k), want)
    assert imaging.resize(img, maxdim=9) is img and imaging.resize(img, scale=0.5).shape == (2, 3, 2)
    at, F = imaging.Sift(8, 16).extract(RNG.uniform(0, 255, (40, 48)))
    assert F.shape == (len(at), 128) and np.allclose(np.linalg.norm(F, axis=1), 1)
