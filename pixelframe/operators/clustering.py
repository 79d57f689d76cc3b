"""k-means segmentation: every image has clusters of its own.

All images of a stack run at once and each until its centres rest; there is no
shuffle and no driver loop.  Centres start at the darkest pixel and then, one
by one, at the pixel farthest from those chosen (the first in order among
equals).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import whole
from ..functions.stacks import on_stacks, restored


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (images, points, centres)."""
    return np.stack([((points - centres[:, None, j]) ** 2).sum(axis=2) for j in range(centres.shape[1])], axis=2)


def starts(points: np.ndarray, k: int) -> np.ndarray:
    each = np.arange(len(points))
    length = (points**2).sum(axis=2)
    darkest = length == length.min(axis=1, keepdims=True)
    for values in np.moveaxis(points, 2, 0):  # the least values among equals, channel by channel
        darkest &= values == np.where(darkest, values, np.inf).min(axis=1, keepdims=True)
    centres = points[each, darkest.argmax(axis=1)][:, None]
    for _ in range(k - 1):
        gap = _distances(points, centres).min(axis=2)
        centres = np.concatenate((centres, points[each, gap.argmax(axis=1)][:, None]), axis=1)
    return centres


def _updated(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Mean of each centre's points, the first of the nearest; a centre without points stays."""
    labels, new = _distances(points, centres).argmin(axis=2), centres.copy()
    for j in range(centres.shape[1]):
        own = labels == j
        n, total = own.sum(axis=1), (points * own[:, :, None]).sum(axis=1)
        new[n > 0, j] = total[n > 0] / n[n > 0, None]
    return new


def segmented(x: np.ndarray, u8: bool, k: int, max_iter: int, tol: float) -> dict[str, np.ndarray]:
    points = x.reshape(len(x), -1, x.shape[3])
    now = starts(points, k)
    before, left = now.copy(), np.arange(len(x))
    for _ in range(max_iter):
        if not len(left):
            break
        before[left] = now[left]
        now[left] = _updated(points[left], now[left])
        left = left[np.sqrt(((now[left] - before[left]) ** 2).sum(axis=(1, 2))) >= tol]
    labels = _distances(points, before).argmin(axis=2)
    data = np.take_along_axis(now, labels[:, :, None], axis=1).reshape(x.shape)
    return {"labels": labels.astype(float), "centres": now, "data": restored(data, u8)}


def kmeans_segment(images: DataFrame, k: int = 3, max_iter: int = 100, tol: float = 1e-4) -> DataFrame:
    """Adds labels (before the last update) and centres; data becomes the updated centre of each pixel."""
    whole(k, "k", 1), whole(max_iter, "max_iter", 1)
    found = on_stacks(images, lambda u8, x: segmented(x, u8, k, max_iter, tol), adds=("labels", "centres", "data"))
    n = F.col("n_channels")
    centres = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.slice("centres", j * n + 1, n))
    return found.withColumn("labels", F.col("labels").cast("array<int>")).withColumn("centres", F.when(F.col("centres").isNotNull(), centres))
