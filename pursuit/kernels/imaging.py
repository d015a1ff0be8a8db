"""Image kernels: patches, resampling, convolution, dense SIFT."""

from __future__ import annotations

import numpy as np


def grid(h: int, w: int, patch: tuple[int, int], step: tuple[int, int]) -> np.ndarray:
    """Top-left places of patches, row by row."""
    ys, xs = np.arange(0, h - patch[0] + 1, step[0]), np.arange(0, w - patch[1] + 1, step[1])
    return np.stack(np.meshgrid(ys, xs, indexing="ij"), -1).reshape(-1, 2)


def patches(img: np.ndarray, patch: tuple[int, int], step: tuple[int, int] = (1, 1)) -> tuple[np.ndarray, np.ndarray]:
    """(places, patches as rows in row, column, channel order)."""
    img = img[:, :, None] if img.ndim == 2 else img
    h, w, c = img.shape
    if h < patch[0] or w < patch[1]:
        return np.zeros((0, 2), int), np.zeros((0, patch[0] * patch[1] * c))
    view = np.lib.stride_tricks.sliding_window_view(img, patch, axis=(0, 1))[:: step[0], :: step[1]]
    return grid(h, w, patch, step), view.transpose(0, 1, 3, 4, 2).reshape(-1, patch[0] * patch[1] * c).astype(float)


def rebuild(h: int, w: int, c: int, places: np.ndarray, rows: np.ndarray, patch: tuple[int, int]) -> np.ndarray:
    """The image whose pixels are the means of the patches over them; uncovered pixels are 0."""
    total, n = np.zeros((h, w, c)), np.zeros((h, w, 1))
    for (y, x), p in zip(places, rows):
        total[y : y + patch[0], x : x + patch[1]] += p.reshape(*patch, c)
        n[y : y + patch[0], x : x + patch[1]] += 1
    return total / np.maximum(n, 1)


def resize(img: np.ndarray, scale: float | None = None, maxdim: int | None = None) -> np.ndarray:
    """Bilinear resampling by a factor, or down to a largest side; unchanged if small enough."""
    h, w = img.shape[:2]
    if scale is None:
        if maxdim is None or max(h, w) <= maxdim:
            return img
        scale = maxdim / max(h, w)
    H, W = max(1, int(h * scale)), max(1, int(w * scale))

    def at(n: int, N: int):
        p = np.clip((np.arange(N) + 0.5) * n / N - 0.5, 0, n - 1)
        lo = np.floor(p).astype(int)
        return lo, np.minimum(lo + 1, n - 1), p - lo

    y0, y1, fy = at(h, H)
    x0, x1, fx = at(w, W)
    img = img.astype(float)
    fx = fx.reshape(1, -1, *([1] * (img.ndim - 2)))
    fy = fy.reshape(-1, 1, *([1] * (img.ndim - 2)))
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    low = img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def convolve_same(img: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """2-D convolution of the image's size, zeros outside."""
    kh, kw = kernel.shape
    top, left = (kh - 1) // 2, (kw - 1) // 2
    wide = np.pad(img, ((kh - 1 - top, top), (kw - 1 - left, left)))
    return np.einsum("yxij,ij->yx", np.lib.stride_tricks.sliding_window_view(wide, (kh, kw)), kernel[::-1, ::-1])


def gauss_derivatives(sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Filters for the derivatives of a Gaussian along x and y, absolute sums 2."""
    r = 2 * int(np.ceil(sigma))
    t = np.arange(-r, r + 1)
    g = np.exp(-(t[:, None] ** 2 + t**2) / (2.0 * sigma * sigma))
    gy, gx = np.gradient(g)
    return gx * 2 / np.abs(gx).sum(), gy * 2 / np.abs(gy).sum()


class Sift:
    """Dense SIFT: 8 angles by 4 x 4 bins, angle first."""

    angles, bins, power = 8, 4, 9

    def __init__(self, spacing: int, patch: int, contrast: float = 1.0, sigma: float = 0.8, clip: float = 0.2):
        self.spacing, self.patch, self.contrast, self.clip = spacing, patch, contrast, clip
        self.fx, self.fy = gauss_derivatives(sigma)
        at = np.arange(patch)
        centres = (np.arange(self.bins) + 0.5) * patch / self.bins - 0.5
        near = np.maximum(0, 1 - np.abs(at[None] - centres[:, None]) / (patch / self.bins))
        self.weights = np.einsum("iy,jx->ijyx", near, near).reshape(self.bins**2, patch * patch)

    def places(self, h: int, w: int) -> np.ndarray:
        """Centred grid; the height index varies fastest."""
        ys = np.arange(((h - self.patch) % self.spacing) // 2, h - self.patch + 1, self.spacing)
        xs = np.arange(((w - self.patch) % self.spacing) // 2, w - self.patch + 1, self.spacing)
        gx, gy = np.meshgrid(xs, ys, indexing="ij")
        return np.stack([gy.ravel(), gx.ravel()], 1)

    def extract(self, img: np.ndarray, normalise: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(places, descriptors); colour is averaged."""
        img = img.mean(2) if img.ndim == 3 else img.astype(float)
        at = self.places(*img.shape)
        if not len(at):
            return at, np.zeros((0, self.angles * self.bins**2))
        dx, dy = convolve_same(img, self.fx), convolve_same(img, self.fy)
        size, theta = np.hypot(dx, dy), np.arctan2(dy, dx)
        phi = 2 * np.pi * np.arange(self.angles) / self.angles
        maps = size[None] * np.maximum(np.cos(theta[None] - phi[:, None, None]) ** self.power, 0)
        cut = np.lib.stride_tricks.sliding_window_view(maps, (self.patch, self.patch), axis=(1, 2))[:, at[:, 0], at[:, 1]]
        out = np.einsum("anp,bp->nab", cut.reshape(self.angles, len(at), -1), self.weights).reshape(len(at), -1)
        return at, self.normalise(out) if normalise else out

    def normalise(self, F: np.ndarray) -> np.ndarray:
        """Divides by max(length, contrast) and clips; rows of enough contrast are scaled again."""
        length = np.linalg.norm(F, axis=1, keepdims=True)
        out = np.minimum(F / np.maximum(length, self.contrast), self.clip)
        again = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.finfo(float).eps)
        return out / np.where(length >= self.contrast, again, 1.0)
