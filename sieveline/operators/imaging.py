"""Images before and after redaction: turned upright, made readable for OCR, shown small, and drawn over; text lines set straight.

Rows have (height, width, channels, data), blue first, as Spark's image source gives them. Pixels are worked on in Arrow functions.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster

#: What an EXIF orientation asks for: quarter turns against the clock, then a flip from left to right.
_TURNS = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (3, True), 6: (3, False), 7: (1, True), 8: (1, False)}
DARK, CONTRAST, CUTOFF = 70, 1.15, 0.01
MAX_SIDE, SHOWN_SIDE = 2400, 1440
RED = (0, 0, 255)


def orientation(raw: bytes) -> int:
    """The EXIF orientation of a JPEG file, 1 where it has none."""
    at = 2
    if raw[:2] != b"\xff\xd8":
        return 1
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if raw[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = "<" if tiff[:2] == b"II" else ">"
            try:
                start = struct.unpack_from(f"{order}I", tiff, 4)[0]
                for k in range(struct.unpack_from(f"{order}H", tiff, start)[0]):
                    tag, _, _, value = struct.unpack_from(f"{order}HHIH", tiff, start + 2 + 12 * k)
                    if tag == 0x0112:
                        return value if value in _TURNS else 1
            except struct.error:
                return 1
        at += 2 + size
    return 1


def upright(image: np.ndarray, turn: int) -> np.ndarray:
    """An image turned as its EXIF orientation asks."""
    turns, flip = _TURNS[turn]
    out = np.rot90(image, turns)
    return np.ascontiguousarray(out[:, ::-1] if flip else out)


def opaque(image: np.ndarray) -> np.ndarray:
    """An image of three channels; what is transparent shows white."""
    if image.shape[2] == 1:
        return np.repeat(image, 3, axis=2)
    if image.shape[2] == 3:
        return image
    alpha = image[:, :, 3:].astype(np.float32) / 255
    return np.round(image[:, :, :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)


def stretched(image: np.ndarray, cutoff: float = CUTOFF) -> np.ndarray:
    """Each channel over the whole range, without the darkest and the lightest hundredth."""
    out = np.empty_like(image)
    for c in range(image.shape[2]):
        low, high = np.quantile(image[:, :, c], [cutoff, 1 - cutoff])
        out[:, :, c] = image[:, :, c] if high <= low else np.clip((image[:, :, c] - low) * 255 / (high - low), 0, 255).astype(np.uint8)
    return out


def contrast(image: np.ndarray, by: float = CONTRAST) -> np.ndarray:
    mean = round(float(raster.gray(image).mean()))
    return np.clip(mean + (image.astype(np.float32) - mean) * by, 0, 255).astype(np.uint8)


def sharpened(image: np.ndarray, amount: float = 1.1, least: int = 3) -> np.ndarray:
    """What a blur of one pixel takes away is added, where it is more than ``least``."""
    change = image.astype(np.float32) - raster._blur(image, 1.0)
    return np.clip(np.where(np.abs(change) > least, image + amount * change, image), 0, 255).astype(np.uint8)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image at another size: means of what a new pixel covers, along each axis."""
    out = image.astype(np.float64)
    for axis, new in ((0, height), (1, width)):
        old = out.shape[axis]
        edges = np.linspace(0, old, new + 1)
        total = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)

        def upto(x: np.ndarray, total=total, old=old, axis=axis) -> np.ndarray:
            i = np.minimum(np.floor(x).astype(int), old - 1)
            shape = [-1 if a == axis else 1 for a in range(3)]
            part = (x - i).reshape(shape)
            return np.take(total, i, axis) * (1 - part) + np.take(total, i + 1, axis) * part

        out = (upto(edges[1:]) - upto(edges[:-1])) / (old / new)
    return np.round(out).clip(0, 255).astype(np.uint8)


def prepare(image: np.ndarray, turn: int = 1, *, max_side: int = MAX_SIDE, grayscale: bool = False, sharpen: bool = False, binarize: bool = False) -> dict:
    """An image as OCR wants it, and what came before: ``image``, ``original`` (upright and opaque), ``scale_x``, ``scale_y``, ``warnings``."""
    original = opaque(upright(image, turn))
    out, warnings = original, []
    try:
        if raster.gray(out).mean() < DARK:
            out = contrast(stretched(out))
        if grayscale:
            out = np.repeat(np.round(raster.gray(out)).astype(np.uint8)[:, :, None], 3, axis=2)
        if sharpen:
            out = sharpened(out)
        if binarize:
            g = np.round(raster.gray(out)).astype(np.uint8)
            out = np.repeat(np.where(g > raster.otsu(g), 255, 0).astype(np.uint8)[:, :, None], 3, axis=2)
    except (ValueError, IndexError):
        warnings.append("enhancement failed")
    h, w, _ = out.shape
    ratio = min(1.0, max_side / max(w, h)) if max_side > 0 else 1.0
    if ratio < 1:
        out = resized(out, max(1, round(w * ratio)), max(1, round(h * ratio)))
    return {"image": out, "original": original, "scale_x": w / out.shape[1], "scale_y": h / out.shape[0], "warnings": warnings}


def thumbnail(image: np.ndarray, side: int = SHOWN_SIDE) -> np.ndarray:
    """An image whose longer side is ``side`` at most."""
    h, w, _ = image.shape
    ratio = min(1.0, side / max(h, w))
    return image if ratio == 1 else resized(image, max(1, round(w * ratio)), max(1, round(h * ratio)))


def outlined(image: np.ndarray, boxes: list, colour: tuple[int, int, int] = RED, wide: int = 2) -> np.ndarray:
    """A preview: the outlines of polygons drawn over an image. Labels are for who shows it; there are no glyphs here."""
    out = image.copy()
    h, w, c = out.shape
    for box in boxes:
        points = np.array([list(p) for p in box], float).reshape(-1, 2)
        if len(points) < 3:
            continue
        points = np.clip(points, 0, [w - 1, h - 1])
        for (x0, y0), (x1, y1) in zip(points, np.roll(points, -1, axis=0), strict=True):
            n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
            xs, ys = np.round(np.linspace(x0, x1, n)).astype(int), np.round(np.linspace(y0, y1, n)).astype(int)
            for dx in range(wide):
                for dy in range(wide):
                    out[np.clip(ys + dy, 0, h - 1), np.clip(xs + dx, 0, w - 1), : min(c, 3)] = colour[: min(c, 3)]
    return out


def _projection(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The perspective that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def projected(points: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    p = np.column_stack([points, np.ones(len(points))]) @ matrix.T
    return p[:, :2] / p[:, 2:]


def rectified(image: np.ndarray, polygon: list) -> dict | None:
    """A text line set straight: ``warped``, its ``ink`` and the ``matrix`` that took it there; None if the polygon is no quadrilateral."""
    try:
        p = np.array([list(q) for q in polygon], float)[:4]
        edge = lambda a, b: np.hypot(*(p[a] - p[b]))
        w, h = max(2, round((edge(0, 1) + edge(3, 2)) / 2)), max(2, round((edge(0, 3) + edge(1, 2)) / 2))
        corners = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
        matrix = _projection(p, corners)
        xs, ys = np.meshgrid(np.arange(w), np.arange(h))
        at = projected(np.column_stack([xs.ravel(), ys.ravel()]), np.linalg.inv(matrix))
    except (ValueError, IndexError, np.linalg.LinAlgError):
        return None
    x, y = np.clip(at[:, 0], 0, image.shape[1] - 1), np.clip(at[:, 1], 0, image.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = (x - x0)[:, None], (y - y0)[:, None]
    shown = opaque(image).astype(np.float32)
    warped = (shown[y0, x0] * (1 - fx) * (1 - fy) + shown[y0, x1] * fx * (1 - fy) + shown[y1, x0] * (1 - fx) * fy + shown[y1, x1] * fx * fy).reshape(h, w, 3)
    warped = np.round(warped).astype(np.uint8)
    return {"warped": warped, "ink": local_ink(warped), "matrix": matrix, "width": w, "height": h}


def local_ink(image: np.ndarray, around: int = 15, offset: float = 5.0) -> np.ndarray:
    """Ink that both a threshold of the whole line and one of its surroundings find."""
    g = raster.gray(raster._blur(image, 0.8))
    if np.median(np.concatenate([g[0], g[-1], g[:, 0], g[:, -1]])) < 127:
        g = 255 - g
    near = raster._blur(np.round(g).astype(np.uint8)[:, :, None], around / 6)[:, :, 0]
    return raster.ink(image) & (g <= near - offset)


def ink_groups(mask: np.ndarray) -> list[tuple[int, int]]:
    """Horizontal extents of groups of components, left to right: specks go, and what overlaps or nearly touches is one."""
    h = mask.shape[0]
    parts = [c for c in raster.components(mask) if c[4] >= max(2, round(0.002 * mask.size)) or c[3] - c[1] >= 0.2 * h]
    groups: list[list[int]] = []
    for x0, _, x1, _, _ in parts:
        if groups and x0 <= groups[-1][1] + max(1, round(0.02 * h)):
            groups[-1][1] = max(groups[-1][1], x1)
        else:
            groups.append([x0, x1])
    return [tuple(g) for g in groups]


def refine_by_components(line: dict, low: float, high: float, expected: int, gap: float = 0.35) -> dict:
    """A span of a rectified line, as shares, moved to whole groups of ink: those that it covers mostly, and more beside it, nearest
    first and never across a wide gap, while there are fewer than the characters that are expected."""
    w, h = line["width"], line["height"]
    groups = ink_groups(line["ink"])
    a, b = low * w, high * w
    inside = [i for i, (x0, x1) in enumerate(groups) if min(b, x1) - max(a, x0) > 0.5 * (x1 - x0)]
    if not inside or expected <= 0:
        return {"success": False, "confidence": 0.0, "component_match_ratio": 0.0, "reason": "no_components", "start_ratio": low, "end_ratio": high}
    first, last = inside[0], inside[-1]
    while last - first + 1 < expected:
        before = groups[first][0] - groups[first - 1][1] if first else np.inf
        after = groups[last + 1][0] - groups[last][1] if last + 1 < len(groups) else np.inf
        if min(before, after) > gap * h:
            break
        first, last = (first - 1, last) if before < after else (first, last + 1)
    n = last - first + 1
    match = min(n, expected) / max(n, expected)
    return {"success": match >= 0.5, "confidence": match, "component_match_ratio": match, "reason": None if match >= 0.5 else "component_count_mismatch", "start_ratio": groups[first][0] / w, "end_ratio": groups[last][1] / w}


def refine_by_projection(line: dict, low: float, high: float, least: float = 0.25) -> dict:
    """A span of a rectified line moved to the emptiest columns nearby, if they are empty enough."""
    a, b, sure = raster.refine_by_columns(line["warped"], low, high)
    good = sure >= least and b > a
    return {"success": good, "confidence": sure, "reason": None if good else "weak_gaps", "start_ratio": a, "end_ratio": b}


def coverage(line: dict, polygon: list, entity_weight: float, block_weight: float, han: int) -> dict:
    """Whether a box on a line is wide enough for its text, and has no ink right outside both of its ends."""
    x = projected(np.array([list(p) for p in polygon], float), line["matrix"])[:, 0]
    left, right = max(0, round(float(x.min()))), min(line["width"], round(float(x.max())))
    wide = max(0, right - left)
    want = max(entity_weight / max(block_weight, 1e-9) * line["width"], han * line["height"] * 0.70)
    strip = max(1, round(line["height"] * 0.10))
    columns = line["ink"].any(axis=0)
    touch = (left > 0 and bool(columns[max(0, left - strip) : left].any()), right < line["width"] and bool(columns[right : right + strip].any()))
    ratio = wide / max(want, 1.0)
    valid = wide >= max(4, line["height"] * 0.45) and ratio >= 0.72 and not all(touch)
    return {"valid": valid, "confidence": min(1.0, max(0.0, ratio)), "width_ratio": ratio, "left_edge_ink": touch[0], "right_edge_ink": touch[1], "reason": None if valid else "possible_partial_entity_coverage"}


_OUT = "height int, width int, channels int, data binary, original binary, original_height int, original_width int, scale_x double, scale_y double, warnings array<string>, error string"


def prepared(df: DataFrame, id_col: str = "image_id", *, turn: str | None = None, **options) -> DataFrame:
    """Rows of images ready for OCR, with the upright originals; one that can't be read has nulls and an error. ``turn`` names a column of EXIF orientations."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                try:
                    made = prepare(raster.to_array(r[1], r[2], r[3], r[4]), int(r[5] or 1), **options)
                    out, first = made["image"], made["original"]
                    row = (r[0], *out.shape, out.tobytes(), first.tobytes(), first.shape[0], first.shape[1], made["scale_x"], made["scale_y"], made["warnings"], None)
                except (ValueError, TypeError) as e:
                    row = (r[0], *[None] * 10, f"image can't be read: {e}")
                yield pd.DataFrame([row], columns=[id_col, *[x.split()[0] for x in _OUT.split(", ")]])

    return df.select(id_col, "height", "width", "channels", "data", (F.col(turn) if turn else F.lit(1)).alias("turn")).mapInPandas(run, f"`{id_col}` {kind}, {_OUT}")


def previews(df: DataFrame, id_col: str = "image_id", boxes: str = "boxes", side: int = SHOWN_SIDE) -> DataFrame:
    """Rows (id, preview, thumbnail) as PNG: the image with its boxes outlined, and the image made small."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                image = raster.to_array(r[1], r[2], r[3], r[4])
                yield pd.DataFrame([(r[0], raster.png(outlined(image, list(r[5]) if r[5] is not None else [])), raster.png(thumbnail(image, side)))], columns=[id_col, "preview", "thumbnail"])

    return df.select(id_col, "height", "width", "channels", "data", boxes).mapInPandas(run, f"`{id_col}` {kind}, preview binary, thumbnail binary")
