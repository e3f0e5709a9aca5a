"""Statistics, masks and crops of images held as rows (id, width, height, pixels: RGB bytes, row by row)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAY, LUMA = np.array([0.299, 0.587, 0.114]), np.array([0.2126, 0.7152, 0.0722])
#: Distance from the background at which a soft mask begins, and the deviation of its blur in pixels.
THRESHOLD, SIGMA = 32.0, 2.0


def pixels(row) -> np.ndarray:
    return np.frombuffer(row.pixels, dtype=np.uint8).reshape(row.height, row.width, 3)


def each_image(images: DataFrame, f: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """id and what ``f`` makes of an image; an image whose bytes don't fit its size gets nulls."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                good = row.pixels is not None and row.width and row.height and len(row.pixels) == 3 * int(row.width) * int(row.height)
                out.append([row.id, *((f(pixels(row))[n] for n in names) if good else [None] * len(names))])
            yield pd.DataFrame(out, columns=["id", *names])

    return images.select("id", "width", "height", "pixels").mapInPandas(run, f"id long, {schema}")


def margin(h: int, w: int, fraction: float) -> int:
    return max(1, int(min(h, w) * fraction))


def border(a: np.ndarray, m: int) -> np.ndarray:
    """The pixels of four stripes, so corners count twice."""
    return np.concatenate([x.reshape(-1, 3) for x in (a[:m], a[-m:], a[:, :m], a[:, -m:])])


def image_stats(images: DataFrame, fraction: float = 0.08, edge: float = 16.0) -> DataFrame:
    """Extremes, mean and deviation of gray values, and those of the border with its edges."""

    def stats(a: np.ndarray) -> dict:
        x = a.astype(np.float64)
        m, gray = margin(*a.shape[:2], fraction), np.round(x @ GRAY, 9)
        stripes = [gray[:m], gray[-m:], gray[:, :m], gray[:, -m:]]
        jumps = np.concatenate([np.abs(np.diff(s, axis=k)).ravel() for s in stripes for k in (0, 1)])
        return {
            "low": int(a.min()), "high": int(a.max()), "mean": float(x.mean()), "std": float(x.std()), "border_margin": m, "border_std": float(border(x, m).std(axis=0).mean()),
            "border_edge_mean": float(jumps.mean()) if len(jumps) else 0.0, "border_edge_density": float((jumps > edge).mean()) if len(jumps) else 0.0,
        }

    return each_image(images, stats, "low int, high int, mean double, std double, border_margin int, border_std double, border_edge_mean double, border_edge_density double")


def regions(mask: np.ndarray) -> list[int]:
    """Sizes of the 4-connected parts of a mask."""
    left, found = mask.copy(), []
    for y, x in zip(*np.nonzero(mask)):
        if left[y, x]:
            left[y, x], todo, n = False, deque([(y, x)]), 0
            while todo:
                i, j = todo.popleft()
                n += 1
                for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and left[a, b]:
                        left[a, b] = False
                        todo.append((a, b))
            found.append(n)
    return found


def background(a: np.ndarray, fraction: float = 0.08) -> np.ndarray:
    return np.median(border(a.astype(np.float64), margin(*a.shape[:2], fraction)), axis=0)


def foreground_stats(images: DataFrame, threshold: float = 36.0, least: int = 12) -> DataFrame:
    """Parts of an image that differ from the border's median color: their number, area, and the largest one's share."""

    def stats(a: np.ndarray) -> dict:
        far = np.sqrt(((a - background(a)) ** 2).sum(axis=2)) > threshold
        sizes = [n for n in regions(far) if n >= least]
        total = sum(sizes)
        return {"components": len(sizes), "area": total, "largest": max(sizes, default=0), "ratio": max(sizes) / total if total else 1.0}

    return each_image(images, stats, "components int, area long, largest long, ratio double")


def image_metrics(images: DataFrame) -> DataFrame:
    """Brightness, contrast, saturation, edges, and shares of dark and light pixels."""

    def stats(a: np.ndarray) -> dict:
        x = a / 255.0
        luma, top = x @ LUMA, x.max(axis=2)
        steps = [float(np.abs(np.diff(luma, axis=k)).mean()) if luma.shape[k] > 1 else 0.0 for k in (0, 1)]
        saturation = np.divide(top - x.min(axis=2), top, out=np.zeros_like(top), where=top > 0)
        return {"brightness_mean": float(luma.mean()), "contrast_std": float(luma.std()), "saturation_mean": float(saturation.mean()), "edge_energy": sum(steps) / 2, "dark_fraction": float((luma < 0.08).mean()), "light_fraction": float((luma > 0.92).mean())}

    return each_image(images, stats, "brightness_mean double, contrast_std double, saturation_mean double, edge_energy double, dark_fraction double, light_fraction double")


def border_stats(images: DataFrame, edge: float = 16.0) -> DataFrame:
    """The second definition: each border pixel once, edges to its right and lower neighbours."""

    def stats(a: np.ndarray) -> dict:
        h, w = a.shape[:2]
        m, gray = max(2, min(8, min(h, w) // 16)), np.round(a @ LUMA, 9)
        ring = np.ones((h, w), bool)
        ring[m : h - m, m : w - m] = False
        right, down = np.abs(np.diff(gray, axis=1)), np.abs(np.diff(gray, axis=0))
        near = np.concatenate([right[ring[:, :-1]], down[ring[:-1]]])
        return {"border": m, "n": int(ring.sum()), "mean": float(gray[ring].mean()), "std": float(gray[ring].std()), "edges": float((near >= edge).mean()) if len(near) else 0.0}

    return each_image(images, stats, "border int, n long, mean double, std double, edges double")


def bbox(width: Column, height: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column, padding: float, least: int = 16) -> Column:
    """left, top, right, bottom of a padded box from 0 to 1 in whole pixels, cut off; a side under ``least`` makes it the whole image."""
    dx, dy = (xmax - xmin) * padding, (ymax - ymin) * padding
    low = lambda v, n: F.greatest(F.lit(0), (v * n).cast("int"))
    high = lambda v, n: F.least(n, (v * n).cast("int"))
    left, top, right, bottom = low(xmin - dx, width), low(ymin - dy, height), high(xmax + dx, width), high(ymax + dy, height)
    small = (right - left < least) | (bottom - top < least)
    whole = (F.lit(0), F.lit(0), width, height)
    return F.struct(*(F.when(small, w).otherwise(v).alias(n) for n, v, w in zip(("left", "top", "right", "bottom"), (left, top, right, bottom), whole)))


def center_crop(width: Column, height: Column, fraction: float, least: int = 16) -> Column:
    """left, top and side of the centered square; it reaches beyond images smaller than ``least``."""
    short = F.least(width, height)
    side = F.greatest(F.lit(least), F.least(short, (short * fraction).cast("int")))
    return F.struct(F.floor((width - side) / 2).cast("int").alias("left"), F.floor((height - side) / 2).cast("int").alias("top"), side.alias("side"))


#: Pixels of images that are worked on together: few, since a worker holds some ten arrays of doubles of them.
TOGETHER = 1 << 14


def each_stack(images: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """id and pixels of what ``f`` makes of stacks (n, height, width, 3) of images of one size; an image whose bytes don't
    fit its size gets null."""

    def run(batches):
        for batch in batches:
            made = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            size = batch["pixels"].map(lambda x: -1 if x is None else len(x))
            good = batch[(batch["width"] > 0) & (batch["height"] > 0) & (size == 3 * batch["width"].fillna(0).astype("int64") * batch["height"].fillna(0).astype("int64"))]
            for (h, w), some in good.groupby(["height", "width"]):
                h, w = int(h), int(w)
                step = max(1, TOGETHER // (h * w))
                for first in range(0, len(some), step):
                    part = some["pixels"].iloc[first : first + step]
                    out = f(np.frombuffer(b"".join(part), np.uint8).reshape(-1, h, w, 3).astype(np.float64))
                    made[part.index] = [x.tobytes() for x in np.clip(np.rint(out), 0, 255).astype(np.uint8)]
            yield pd.DataFrame({"id": batch["id"], "pixels": made})

    return images.select("id", "width", "height", "pixels").mapInPandas(run, "id long, pixels binary")


def _padded(x: np.ndarray, r: int) -> np.ndarray:
    return np.pad(x, [(0, 0), (r, r), (r, r)], mode="edge")


def box_mean(x: np.ndarray, r: int) -> np.ndarray:
    """Means of squares of 2r + 1 pixels of a stack of planes, edges repeated, from a summed-area table."""
    k, (_, h, w) = 2 * r + 1, x.shape
    area = np.pad(_padded(x, r).cumsum(axis=1).cumsum(axis=2), [(0, 0), (1, 0), (1, 0)])
    return (area[:, k:, k:] - area[:, :h, k:] - area[:, k:, :w] + area[:, :h, :w]) / k**2


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """A stack of planes blurred by rows and columns with weights up to four deviations off, edges repeated."""
    r = int(np.ceil(4 * sigma))
    weights = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    weights /= weights.sum()
    x = _padded(x, r)
    x = sum(c * x[:, i : i + x.shape[1] - 2 * r] for i, c in enumerate(weights))
    return sum(c * x[:, :, i : i + x.shape[2] - 2 * r] for i, c in enumerate(weights))


def smoothstep(low: float, high: float, x: np.ndarray) -> np.ndarray:
    t = np.clip((x - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


def flatten_background(images: DataFrame, threshold: float = THRESHOLD, sigma: float = SIGMA) -> DataFrame:
    """The image over a flat background of its border's median color; a blurred eight-bit mask of distances blends them.

    Where the border (12 % of the shorter side, two pixels at least) is wider than the image, it is all of it.
    """

    def flat(x: np.ndarray) -> np.ndarray:
        n, h, w, _ = x.shape
        m = max(2, int(min(h, w) * 0.12))
        color = np.median(np.concatenate([s.reshape(n, -1, 3) for s in (x[:, :m], x[:, -m:], x[:, :, :m], x[:, :, -m:])], axis=1), axis=1)[:, None, None]
        far = np.sqrt(((x - color) ** 2).sum(axis=3))
        mask = np.rint(255 * np.clip((far - threshold) / max(threshold, 1.0), 0, 1))
        mask = (np.rint(gaussian(mask, sigma)) if sigma > 0 else mask)[..., None]
        return (x * mask + np.rint(color) * (255 - mask)) / 255

    return each_stack(images, flat)


def background_estimate(x: np.ndarray) -> np.ndarray:
    """Each image's background color: the mean of the two corners most alike, then that of the border pixels near it.

    Corners are alike by the distance of their means and, to a lesser degree, their variances. Border pixels beyond the mean
    distance by 0.85 deviations (and beyond 14) are left out; if hardly any is left, the corners' color stays.
    """
    n, h, w, _ = x.shape
    patch, m = max(2, min(12, min(h, w) // 8)), max(2, min(8, min(h, w) // 16))
    corners = np.stack([x[:, ys, xs].reshape(n, -1, 3) for ys in (slice(patch), slice(h - patch, h)) for xs in (slice(patch), slice(w - patch, w))], axis=1)
    means, spread = corners.mean(axis=2), corners.var(axis=2).mean(axis=2)
    one, two = np.triu_indices(4, 1)
    unlike = np.sqrt(((means[:, one] - means[:, two]) ** 2).mean(axis=2)) + 0.15 * np.sqrt(spread[:, one] + spread[:, two])
    best = unlike.argmin(axis=1)
    at = np.arange(n)
    color = (means[at, one[best]] + means[at, two[best]]) / 2
    ring = np.ones((h, w), bool)
    ring[m : h - m, m : w - m] = False
    edge = x[:, ring]
    far = np.sqrt(((edge - color[:, None]) ** 2).mean(axis=2))
    near = far <= np.maximum(14, far.mean(axis=1) + 0.85 * far.std(axis=1))[:, None]
    kept = near.sum(axis=1)
    trimmed = (edge * near[..., None]).sum(axis=1) / np.maximum(kept, 1)[:, None]
    return np.where((kept < max(8, 0.12 * ring.sum()))[:, None], color, trimmed)


def denoise(images: DataFrame) -> DataFrame:
    """Smooths the background's brightness and color and draws both towards its estimate; objects and edges hardly change.

    Brightness is smoothed over 3 x 3 pixels, color over 5 x 5. What differs from the background in color, what lies beside
    it, and edges there count as foreground. Images with a side under three pixels stay as they are.
    """
    # --- the bounds and shares below are fixed values ---

    def smooth(x: np.ndarray) -> np.ndarray:
        if min(x.shape[1:3]) < 3:
            return x
        ground = background_estimate(x)
        split = lambda c: (c @ GRAY, c[..., 2] - c @ GRAY, c[..., 0] - c @ GRAY)
        y, cb, cr = split(x)
        y0, cb0, cr0 = (v[:, None, None] for v in split(ground))
        fore = smoothstep(18, 56, 0.68 * np.abs(y - y0) + 0.31 * (np.abs(cb - cb0) + np.abs(cr - cr0)))
        h, w = y.shape[1:]
        around = _padded(fore, 1)
        most = np.maximum.reduce([around[:, i : i + h, j : j + w] for i in range(3) for j in range(3)])
        beside = np.maximum(box_mean(fore, 1), 0.72 * most)
        by_row, by_column = (np.abs(np.diff(_padded(y, 1), axis=k)) for k in (1, 2))
        slope = by_row[:, :-1, 1:-1] + by_row[:, 1:, 1:-1] + by_column[:, 1:-1, :-1] + by_column[:, 1:-1, 1:]
        edge = np.minimum(1, slope / 128)
        object_ = np.minimum(1, np.maximum.reduce([fore, beside, smoothstep(34, 120, slope) * np.minimum(1, beside + 0.18)]))
        clean = ((1 - object_) * (1 - 0.55 * edge)) ** 2
        calm = object_ * (1 - edge)
        y = y + (box_mean(y, 1) - y) * (0.04 * calm + 0.64 * clean)
        y = y + (y0 - y) * 0.30 * clean
        red_blue = []
        for c, c0 in ((cr, cr0), (cb, cb0)):
            c = c + (box_mean(c, 2) - c) * (0.08 * calm + 0.84 * clean)
            red_blue.append(y + c + (c0 - c) * 0.52 * clean)
        red, blue = red_blue
        return np.stack([red, (y - GRAY[0] * red - GRAY[2] * blue) / GRAY[1], blue], axis=3)

    return each_stack(images, smooth)


def decode_ppm(files: DataFrame) -> DataFrame:
    """path, width, height, pixels of binary P6 files; others have nulls."""

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                head = bytes(content).split(None, 4) if content is not None else []
                width = height = body = None
                if len(head) == 5 and head[0] == b"P6" and head[1].isdigit() and head[2].isdigit():
                    width, height = int(head[1]), int(head[2])
                    n = 3 * width * height
                    body = bytes(content)[-n:] if n and len(content) > n else None
                out.append((path, width, height, body))
            yield pd.DataFrame(out, columns=["path", "width", "height", "pixels"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, pixels binary")


def from_vectors(vectors: DataFrame, row_id: str, vector: str, side: int = 8) -> DataFrame:
    """Square images from vectors of side x side numbers, by their sign and size: a table of images to work on."""

    def run(batches):
        for batch in batches:
            values = [np.clip(np.rint(128 + 400 * np.asarray(v, dtype=np.float64)), 0, 255).astype(np.uint8) for v in batch["v"]]
            yield pd.DataFrame({"id": batch["id"], "width": side, "height": side, "pixels": [np.repeat(v[: side * side], 3).tobytes() for v in values]}).astype({"width": "int32", "height": "int32"})

    some = vectors.where(F.size(vector) >= side * side).select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"))
    return some.mapInPandas(run, "id long, width int, height int, pixels binary")
