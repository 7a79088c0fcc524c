"""Figures of decoded pixels, Arrow-batched with numpy: what arrives is a grid of numbers, never a file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

LUMA = np.array([0.299, 0.587, 0.114])
CANVAS, TILES, BINS = 64, 8, 8
DESCRIPTOR = StructType().add("sharpness", DoubleType()).add("exposure", DoubleType()).add("tiles", ArrayType(DoubleType())).add("hist", ArrayType(DoubleType()))
AGREEMENT = StructType().add("status", StringType()).add("ssim", DoubleType()).add("tile_ssim_min", DoubleType()).add("rgb_mad", DoubleType()).add("max_residual", DoubleType())
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def describe(rgb: np.ndarray) -> tuple[float, float, list[float], list[float]]:
    """Sharpness, exposure, tile luma and colour histogram of a height x width x 3 array."""
    h, w = rgb.shape[:2]
    luma = rgb @ LUMA
    rows, columns = (([k * n // TILES for k in range(TILES + 1)]) for n in (h, w))
    tiles = [float(luma[rows[i] : max(rows[i] + 1, rows[i + 1]), columns[j] : max(columns[j] + 1, columns[j + 1])].mean() / 255) for i in range(TILES) for j in range(TILES)]
    hist = [np.bincount(np.minimum(BINS - 1, rgb[..., c].astype(int).ravel() * BINS // 256), minlength=BINS) / (h * w) for c in range(3)]
    inner = luma[: h - 1, : w - 1]
    slope = np.abs(inner - luma[: h - 1, 1:]) + np.abs(inner - luma[1:, : w - 1]) if h > 1 and w > 1 else np.zeros(1)
    clipped = ((luma < 8) | (luma > 247)).mean()
    return float(np.clip(slope.mean() / 64, 0, 1)), float(np.clip(1 - clipped, 0, 1)), tiles, np.concatenate(hist).tolist()


def _pictures(raw: pd.Series, width: pd.Series, height: pd.Series):
    for r, w, h in zip(raw, width, height, strict=True):
        ok = r is not None and w and h and w > 0 and h > 0 and len(r) == w * h * 3
        yield np.frombuffer(r, np.uint8).reshape(int(h), int(w), 3).astype(float) if ok else None


@F.pandas_udf(DESCRIPTOR)
def descriptor(raw: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Descriptor of packed RGB bytes; all null where the bytes don't fit the size."""
    rows = [describe(p) if p is not None else (None, None, None, None) for p in _pictures(raw, width, height)]
    return pd.DataFrame(rows, columns=["sharpness", "exposure", "tiles", "hist"])


def _ssim(a: np.ndarray, b: np.ndarray) -> float:
    ma, mb = a.mean(), b.mean()
    shared = ((a - ma) * (b - mb)).mean()
    return float((2 * ma * mb + C1) * (2 * shared + C2) / ((ma * ma + mb * mb + C1) * (a.var() + b.var() + C2)))


def agree(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float, float]:
    """Similarity of structure as a whole and of the worst of 4 x 4 tiles, mean and largest difference of two arrays of one size."""
    ga, gb = a @ LUMA, b @ LUMA
    h, w = ga.shape
    edges = [[k * n // 4 for k in range(5)] for n in (h, w)]
    cut = [np.s_[edges[0][i] : edges[0][i + 1], edges[1][j] : edges[1][j + 1]] for i in range(4) for j in range(4)]
    return _ssim(ga, gb), min(_ssim(ga[k], gb[k]) for k in cut), float(np.abs(a - b).mean() / 255), float(np.abs(a - b).max() / 255)


@F.pandas_udf(AGREEMENT)
def pixel_agreement(a: pd.Series, aw: pd.Series, ah: pd.Series, b: pd.Series, bw: pd.Series, bh: pd.Series) -> pd.DataFrame:
    """computed, aspect_mismatch (sides differ by over 2 %), size_mismatch (not resized to one size) or unknown, and the figures."""
    out = []
    for p, q in zip(_pictures(a, aw, ah), _pictures(b, bw, bh), strict=True):
        if p is None or q is None or min(*p.shape[:2], *q.shape[:2]) < 4:
            out.append(("unknown", None, None, None, None))
            continue
        x, y = p.shape[1] / p.shape[0], q.shape[1] / q.shape[0]
        if abs(x - y) > 0.02 * x:
            out.append(("aspect_mismatch", None, None, None, None))
        elif p.shape != q.shape:
            out.append(("size_mismatch", None, None, None, None))
        else:
            out.append(("computed", *agree(p, q)))
    return pd.DataFrame(out, columns=["status", "ssim", "tile_ssim_min", "rgb_mad", "max_residual"])


@F.pandas_udf(DoubleType())
def laplacian_variance(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Variance of the Laplacian inside a grey picture (bytes); 0 for one of at most two pixels a side or of the wrong size."""
    out = []
    for g, w, h in zip(gray, width, height, strict=True):
        if g is None or w is None or h is None or w <= 2 or h <= 2 or len(g) != w * h:
            out.append(0.0)
            continue
        x = np.frombuffer(g, np.uint8).reshape(int(h), int(w)).astype(np.int64)
        lap = 4 * x[1:-1, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:] - x[:-2, 1:-1] - x[2:, 1:-1]
        out.append(float((lap * lap).mean() - lap.mean() ** 2))
    return pd.Series(out, dtype="float64")
