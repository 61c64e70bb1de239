"""Tiles, boxes and small kernels of picture processing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where eyes, nose and corners of the mouth lie in an aligned face of 112 x 112.
FACE_TEMPLATE = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])


def tiles_per_axis(length: Column, edge: float, overlap: float, most: int) -> Column:
    """How many tiles of at most `edge` with an overlap cover a length."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.ceil((length / edge - overlap) / (1 - overlap)))).cast("int")


def tile_grid(photos: DataFrame, edge: float, overlap: float = 0.20, most: int = 4, least_side: int = 1600) -> DataFrame:
    """(photo_id, tx, ty, x0, y0, w, h) for photos (photo_id, width, height) that are large enough; one tile alone is none."""
    big = photos.where(F.least("width", "height") >= least_side)
    n = big.withColumn("nx", tiles_per_axis(F.col("width"), edge, overlap, most)).withColumn("ny", tiles_per_axis(F.col("height"), edge, overlap, most)).where("nx * ny > 1")

    def span(length: str, count: str):
        return F.ceil(F.col(length) / (F.col(count) - (F.col(count) - 1) * overlap)).cast("int")

    n = n.withColumn("w", span("width", "nx")).withColumn("h", span("height", "ny"))
    t = n.withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("ty", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))

    def start(i: str, count: str, size: str, length: str):  # the last tile is flush with the edge
        return F.when(F.col(i) == F.col(count) - 1, F.col(length) - F.col(size)).otherwise(F.floor(F.col(i) * F.col(size) * (1 - overlap))).cast("int")

    return t.select("photo_id", "tx", "ty", start("tx", "nx", "w", "width").alias("x0"), start("ty", "ny", "h", "height").alias("y0"), "w", "h")


def overlap_measures(a: tuple, b: tuple) -> tuple[Column, Column]:
    """IoU and containment (share of the smaller box) of two boxes (x0, y0, x1, y1)."""
    inter = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return inter / (area(a) + area(b) - inter), inter / F.least(area(a), area(b))


def suppress(boxes: DataFrame, iou: float = 0.40, containment: float = 0.80) -> DataFrame:
    """Greedy non-maximum suppression in each photo (photo_id, box_id, x0, y0, x1, y1, score); ties by box id, then place."""

    def keep(r: np.ndarray) -> list[int]:
        area = (r[:, 2] - r[:, 0]) * (r[:, 3] - r[:, 1])
        kept: list[int] = []
        for k in range(len(r)):
            o = r[kept]
            inter = np.clip(np.minimum(o[:, 2], r[k, 2]) - np.maximum(o[:, 0], r[k, 0]), 0, None) * np.clip(np.minimum(o[:, 3], r[k, 3]) - np.maximum(o[:, 1], r[k, 1]), 0, None)
            union = np.maximum(area[kept] + area[k] - inter, 1e-12)
            if not ((inter / union > iou) | (inter / np.maximum(np.minimum(area[kept], area[k]), 1e-12) > containment)).any():
                kept.append(k)
        return kept

    def run(batches):
        """Sorted rows: whole photos at a time, the last one of a batch waits for the next batch."""
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf["photo_id"].iloc[-1] if len(pdf) else None
            done = pdf["photo_id"] != last
            held = pdf[~done]
            if done.any():
                yield chosen(pdf[done])
        if held is not None and len(held):
            yield chosen(held)

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)
        photo = pdf["photo_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(photo[1:] != photo[:-1]) + 1).tolist(), len(r)]
        return pdf.iloc[[a + k for a, z in zip(cuts, cuts[1:]) for k in keep(r[a:z])]]

    placed = boxes.repartition("photo_id").sortWithinPartitions("photo_id", F.col("score").desc(), "box_id", "x0", "y0", "x1", "y1")
    return placed.mapInPandas(run, boxes.schema)


def inside_tile(clip: float = 0.12) -> Column:
    """Whether a box (x0, y0, x1, y1 in its tile of w, h at tx0, ty0) runs past no tile edge, unless that is a photo edge.

    A box may run over by `clip` of its own width or height (of 1 pixel at least)."""
    mx, my = (clip * F.greatest(F.lit(1.0), F.col(z) - F.col(a)) for a, z in (("x0", "x1"), ("y0", "y1")))
    left, top = (F.col("tx0") > 0) & (F.col("x0") < -mx), (F.col("ty0") > 0) & (F.col("y0") < -my)
    right = (F.col("tx0") + F.col("w") < F.col("width")) & (F.col("x1") > F.col("w") + mx)
    return ~(left | top | right | ((F.col("ty0") + F.col("h") < F.col("height")) & (F.col("y1") > F.col("h") + my)))


def on_photo(boxes: DataFrame) -> DataFrame:
    """Boxes of tiles moved to where the tile lies in the photo; those that a tile edge cuts are left out, the whole photo's tile is at 0, 0."""
    moved = {c: F.col(c) + F.col(t) for c, t in (("x0", "tx0"), ("y0", "ty0"), ("x1", "tx0"), ("y1", "ty0"))}
    return boxes.where(inside_tile()).withColumns(moved)


def within_photo(boxes: DataFrame) -> DataFrame:
    """Boxes cut to the photo (width, height); those of a pixel or less either way are left out."""
    cut = {"x0": F.greatest(F.lit(0.0), "x0"), "y0": F.greatest(F.lit(0.0), "y0"), "x1": F.least(F.col("width").cast("double"), "x1"), "y1": F.least(F.col("height").cast("double"), "y1")}
    return boxes.withColumns(cut).where("x1 - x0 > 1 and y1 - y0 > 1")


def decoded(cells: DataFrame, scale: Column, anchors: int = 2, threshold: float = 0.5, strides: tuple[int, ...] = (8, 16, 32)) -> DataFrame:
    """Boxes and landmarks from a detector's output rows (stride, columns of the grid, cell, score, box, points).

    `cell` numbers the anchors of a grid row by row, `anchors` to a place; `box` holds distances to
    the left, top, right and bottom and `points` offsets (x, y) of landmarks, all in strides.
    `scale` undoes the resizing of the photo."""
    place = F.floor(F.col("cell") / anchors)
    stride = F.col("stride").cast("double")
    x, y = (place % F.col("columns")) * stride, F.floor(place / F.col("columns")) * stride
    box = F.array(*[(c + sign * F.element_at("box", k) * stride) / scale for k, (c, sign) in enumerate(((x, -1), (y, -1), (x, 1), (y, 1)), 1)])
    points = F.transform("points", lambda v, k: (F.when(k % 2 == 0, x).otherwise(y) + v * stride) / scale)
    return cells.where((F.col("score") >= threshold) & F.col("stride").isin(*strides)).withColumn("box", box).withColumn("points", points)


def pad_to_stride(length: Column, stride: int) -> Column:
    return (F.ceil(length / stride) * stride).cast("int")


def resized(width: Column, height: Column, edge: int) -> tuple[Column, Column]:
    """Dimensions with the long edge at most `edge`, never enlarged."""
    k = F.least(F.lit(1.0), edge / F.greatest(width, height))
    return F.greatest(F.lit(1), F.bround(width * k)).cast("int"), F.greatest(F.lit(1), F.bround(height * k)).cast("int")


def yaw_from_nose(nose: Column, left: Column, right: Column) -> Column:
    """Fallback estimate from where the nose lies between the eyes; without a span: 90."""
    span = right - left
    return F.when(F.abs(span) < 1e-6, F.lit(90.0)).otherwise(((nose - left) / span - 0.5) * 180)


def similarity(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Least-squares similarity transform (2x3) of points; NaN if the points coincide."""
    ms, md = src.mean(axis=0), dst.mean(axis=0)
    a, b = src - ms, dst - md
    u, s, vt = np.linalg.svd(b.T @ a / len(src))
    sign = np.array([1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    var = (a**2).sum() / len(src)
    if var < 1e-12 or not s.any():
        return np.full((2, 3), np.nan)
    rot = u @ np.diag(sign) @ vt
    scale = (s * sign).sum() / var
    return np.hstack([scale * rot, (md - scale * rot @ ms)[:, None]])


def warped(image: np.ndarray, matrix: np.ndarray, size: int) -> np.ndarray:
    """The size x size picture whose pixel p is the image at inverse(matrix) p, interpolated from four neighbours; black outside."""
    full = np.vstack([matrix, [0, 0, 1]])
    y, x = np.mgrid[:size, :size]
    at = np.linalg.inv(full)[:2] @ np.stack([x.ravel(), y.ravel(), np.ones(size * size)])
    padded = np.pad(image.astype(float), ((1, 1), (1, 1), *[(0, 0)] * (image.ndim - 2)))
    u, v = (np.clip(c + 1, 0, n + 1 - 1e-9) for c, n in zip(at, (image.shape[1], image.shape[0])))
    i, j = v.astype(int), u.astype(int)
    fv, fu = ((w - k).reshape(-1, *[1] * (image.ndim - 2)) for w, k in ((v, i), (u, j)))
    out = (padded[i, j] * (1 - fu) + padded[i, j + 1] * fu) * (1 - fv) + (padded[i + 1, j] * (1 - fu) + padded[i + 1, j + 1] * fu) * fv
    return np.rint(out).astype(image.dtype).reshape(size, size, *image.shape[2:])


def aligned(image: np.ndarray, points: np.ndarray, template: np.ndarray = FACE_TEMPLATE, size: int = 112) -> tuple[np.ndarray | None, float]:
    """A face moved onto the template's landmarks, and the scale of that; (None, 0) if the points coincide.

    Where it shrinks to less than half, the part needed is first averaged in blocks, since
    interpolation alone would skip most of its pixels."""
    target = np.asarray(template, float) * (size / 112)
    m = similarity(np.asarray(points, float), target)
    if not np.isfinite(m).all():
        return None, 0.0
    scale = float(np.sqrt(abs(np.linalg.det(m[:, :2]))))
    if scale <= 0:
        return None, 0.0
    if scale >= 0.5:
        return warped(image, m, size), scale
    block = max(2, int(0.75 / scale))
    corners = np.linalg.inv(np.vstack([m, [0, 0, 1]]))[:2] @ np.array([[0, size, size, 0], [0, 0, size, size], [1, 1, 1, 1]], float)
    room = 0.15 * max(float(np.ptp(corners, axis=1).max()), 1.0)
    low = np.maximum(0, np.floor(corners.min(axis=1) - room)).astype(int)
    high = np.minimum(image.shape[1::-1], np.ceil(corners.max(axis=1) + room)).astype(int)
    w, h = (high - low) // block
    if w < 1 or h < 1:
        return warped(image, m, size), scale
    part = image[low[1] : low[1] + h * block, low[0] : low[0] + w * block].astype(float)
    means = part.reshape(h, block, w, block, *image.shape[2:]).mean(axis=(1, 3))
    # The middle of a block of pixels k .. k + block - 1 is (block - 1) / 2 behind its first.
    shrunk = similarity((np.asarray(points, float) - low - (block - 1) / 2) / block, target)
    return warped(np.rint(means).astype(image.dtype), shrunk, size), scale


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """A picture turned as its stored orientation (1 to 8) asks; other values leave it as it is."""
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return image[:, ::-1] if orientation in (2, 3, 6, 7) else image


def laplacian_variance(gray: np.ndarray) -> float:
    """Sharpness: variance of the 3x3 Laplacian."""
    g = np.pad(gray.astype(float), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())
