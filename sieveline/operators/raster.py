"""Raster operators on arrays: ink of text lines, boxes drawn around it, and regions blacked, pixelated or blurred.

These work pixel by pixel, which Spark's expressions can't; they run as Arrow functions over rows of (height, width, channels,
data), the columns of Spark's image source, an image at a time.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("black", "mosaic", "blur")


def to_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels).copy()


def gray(image: np.ndarray) -> np.ndarray:
    """Luminance of an image in the channel order of Spark's image source (blue first)."""
    if image.shape[2] == 1:
        return image[:, :, 0].astype(np.float32)
    return (image[:, :, :3] @ np.array([0.114, 0.587, 0.299], np.float32)).astype(np.float32)


def polygon_mask(height: int, width: int, polygon: np.ndarray) -> np.ndarray:
    """The pixels within a polygon, its edge included."""
    xs, ys = np.meshgrid(np.arange(width), np.arange(height))
    inside = np.zeros((height, width), bool)
    edge = np.zeros((height, width), bool)
    for (x0, y0), (x1, y1) in zip(polygon, np.roll(polygon, -1, axis=0), strict=True):
        if y0 != y1:
            at = x0 + (ys - y0) * (x1 - x0) / (y1 - y0)
            inside ^= ((y0 > ys) != (y1 > ys)) & (xs < at)
        length = max(np.hypot(x1 - x0, y1 - y0), 1e-9)
        away = np.abs((x1 - x0) * (ys - y0) - (y1 - y0) * (xs - x0)) / length
        within = ((xs - x0) * (x1 - x0) + (ys - y0) * (y1 - y0) >= -0.5 * length) & ((xs - x1) * (x0 - x1) + (ys - y1) * (y0 - y1) >= -0.5 * length)
        edge |= (away <= 0.5) & within
    return inside | edge


def _mosaic(image: np.ndarray, block: int) -> np.ndarray:
    h, w, _ = image.shape
    rows, cols = np.arange(h) // block, np.arange(w) // block
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.float64), np.arange(0, h, block), axis=0), np.arange(0, w, block), axis=1)
    counts = np.bincount(rows)[:, None] * np.bincount(cols)[None, :]
    return np.round(sums / counts[:, :, None]).astype(np.uint8)[rows][:, cols]


def _blur(image: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in range(3)], mode="edge")
        out = sum(k * np.take(padded, range(i, i + image.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return np.round(out).astype(np.uint8)


def redact(image: np.ndarray, boxes: list, mode: str = "black", block: int = 12, kernel: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """An image with its boxes hidden, and their mask (255 within). Boxes are clipped to the image; those of fewer than 3 points aren't drawn."""
    if mode not in MODES:
        raise ValueError(f"mode is none of {MODES}")
    h, w, _ = image.shape
    mask, out = np.zeros((h, w), bool), image.copy()
    for box in boxes:
        points = np.array([list(p) for p in box], float).reshape(-1, 2)
        if len(points) < 3:
            continue
        points = np.round(np.clip(points, 0, [w - 1, h - 1]))
        x0, y0 = points.min(axis=0).astype(int)
        x1, y1 = points.max(axis=0).astype(int) + 1
        part = polygon_mask(y1 - y0, x1 - x0, points - [x0, y0])
        mask[y0:y1, x0:x1] |= part
        region = image[y0:y1, x0:x1]
        filled = np.zeros_like(region) if mode == "black" else _mosaic(region, max(2, block)) if mode == "mosaic" else _blur(region, max(0.5, min(kernel / 6, (x1 - x0) / 3, (y1 - y0) / 3)))
        if mode == "black" and region.shape[2] == 4:
            filled[:, :, 3] = 255
        out[y0:y1, x0:x1][part] = filled[part]
    return out, mask.astype(np.uint8) * 255


def otsu(g: np.ndarray) -> int:
    """The gray level that parts an image best: the last of the darker side. -1 for a single level."""
    hist = np.bincount(g.astype(np.uint8).ravel(), minlength=256).astype(float)
    if np.count_nonzero(hist) < 2:
        return -1
    below = np.cumsum(hist)
    mass = np.cumsum(hist * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((mass[-1] * below / below[-1] - mass) ** 2 / (below * above))
    return int(between.argmax())


def ink(image: np.ndarray) -> np.ndarray:
    """The pixels of a line of text that aren't background, whichever of the two is dark: Otsu's threshold on a light background."""
    g = gray(image)
    border = np.concatenate([g[0], g[-1], g[:, 0], g[:, -1]])
    if np.median(border) < 128:
        g = 255 - g
    return g <= otsu(g)


def refine_by_columns(image: np.ndarray, low: float, high: float, reach: float = 0.06) -> tuple[float, float, float]:
    """Ends of a span, as shares of a line's width, moved to the emptiest column nearby; and how empty those are, 0 to 1."""
    columns = ink(image).sum(axis=0).astype(float)
    n = len(columns)
    if n < 3 or not columns.any():
        return low, high, 0.0
    smooth = np.convolve(np.pad(columns, 1, mode="edge"), np.ones(3) / 3, mode="valid")
    span = max(1, int(round(n * reach)))

    def gap(share: float) -> tuple[float, float]:
        if share <= 0 or share >= 1:
            return share, 1.0
        at = int(round(share * n))
        near = np.arange(max(0, at - span), min(n, at + span + 1))
        best = near[np.lexsort((np.abs(near - at), smooth[near]))[0]]
        return best / n, 1 - smooth[best] / max(smooth.max(), 1e-9)

    (a, ca), (b, cb) = gap(low), gap(high)
    return a, max(a, b), min(ca, cb)


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Bounding boxes and areas (x0, y0, x1, y1, area) of the 8-connected groups of pixels, left to right: runs of rows are united."""
    parent: list[int] = []
    runs: list[tuple[int, int, int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    last: list[int] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for x0, x1 in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            i = len(parent)
            parent.append(i)
            runs.append((y, x0, x1, i))
            now.append(i)
            for j in last:
                if runs[j][1] <= x1 and x0 <= runs[j][2]:
                    parent[root(j)] = root(i)
        last = now
    boxes: dict[int, list[int]] = {}
    for y, x0, x1, i in runs:
        b = boxes.setdefault(root(i), [x0, y, x1, y + 1, 0])
        b[:] = [min(b[0], x0), min(b[1], y), max(b[2], x1), max(b[3], y + 1), b[4] + x1 - x0]
    return sorted(tuple(b) for b in boxes.values())


def png(image: np.ndarray) -> bytes:
    """An image (blue first, or gray) as PNG."""
    h, w, c = image.shape
    shown = image if c == 1 else np.concatenate([image[:, :, 2::-1], image[:, :, 3:]], axis=2)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), shown.reshape(h, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def redact_images(df: DataFrame, *, mode: str = "black", boxes: str = "boxes", id_col: str = "image_id") -> DataFrame:
    """Rows (id, result, mask) as PNG of rows with height, width, channels, data and boxes; an image that can't be read gives nulls and an error."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames):
        for f in frames:
            for i, h, w, c, data, b in zip(f[id_col], f["height"], f["width"], f["channels"], f["data"], f[boxes], strict=True):
                try:
                    out, mask = redact(to_array(h, w, c, data), list(b) if b is not None else [], mode)
                    row = (i, png(out), png(mask[:, :, None]), None)
                except (ValueError, TypeError) as e:
                    row = (i, None, None, str(e))
                yield pd.DataFrame([row], columns=[id_col, "result", "mask", "error"])

    return df.select(id_col, "height", "width", "channels", "data", F.col(boxes)).mapInPandas(run, f"`{id_col}` {kind}, result binary, mask binary, error string")
