"""Image-quality metrics over decoded pixels (BGR, rows from the top), in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Thresholds of the reject rules, in percent unless they are pixel values.
GLARE_VALUE, GLARE_SATURATION = 245, 35
SCAN_VALUE, SCAN_SATURATION, SCAN_BRIGHT, SCAN_VERY_BRIGHT, SCAN_MEAN_SATURATION = 235, 45, 55.0, 30.0, 25.0
FLASH_VALUE, FLASH_PART, FLASH_WIDTH = 240, 2.0, 256


def value_and_saturation(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """V and S of HSV, 0 to 255; S is rounded to the nearest integer."""
    high = bgr.max(axis=2).astype(np.int32)
    spread = high - bgr.min(axis=2)
    saturation = np.where(high > 0, np.floor(spread * 255 / np.maximum(high, 1) + 0.5), 0)
    return high, saturation.astype(np.int32)


def largest_component(mask: np.ndarray) -> tuple[int, int]:
    """Pixels and bounding-box area of the largest 8-connected component: runs of each row, joined by union-find."""
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    above: list[int] = []
    for y in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(np.int8), [0]))))
        here = []
        at = 0
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            number = len(runs)
            runs.append((y, start, stop))
            parent.append(number)
            here.append(number)
            while at < len(above) and runs[above[at]][2] < start:
                at += 1
            k = at
            while k < len(above) and runs[above[k]][1] <= stop:
                a, b = find(number), find(above[k])
                parent[max(a, b)] = min(a, b)
                k += 1
        above = here
    best: dict[int, list[int]] = {}
    for number, (y, start, stop) in enumerate(runs):
        box = best.setdefault(find(number), [0, y, y, start, stop])
        box[0] += stop - start
        box[2], box[3], box[4] = y, min(box[3], start), max(box[4], stop)
    if not best:
        return 0, 0
    size, top, bottom, left, right = max(best.values(), key=lambda b: b[0])
    return size, (bottom - top + 1) * (right - left)


def glare(bgr: np.ndarray) -> dict[str, float | bool]:
    """Percent of glaring pixels, of the largest spot and of its box; localized if the box is at most 25 percent."""
    value, saturation = value_and_saturation(bgr)
    mask = (value >= GLARE_VALUE) & (saturation <= GLARE_SATURATION)
    spot, box = largest_component(mask)
    part = 100.0 / mask.size
    return {
        "glare_pct": round(float(mask.sum()) * part, 2),
        "spot_pct": round(spot * part, 2),
        "box_pct": round(box * part, 2),
        "localized": bool(spot and box * part <= 25.0),
    }


def scan_like(bgr: np.ndarray) -> dict[str, float | bool]:
    """Whether a picture looks like a flat scan: bright, hardly coloured."""
    value, saturation = value_and_saturation(bgr)
    bright = 100.0 * float(((value >= SCAN_VALUE) & (saturation <= SCAN_SATURATION)).mean())
    very = 100.0 * float((value >= GLARE_VALUE).mean())
    mean = float(saturation.mean())
    return {
        "bright_pct": round(bright, 2),
        "very_bright_pct": round(very, 2),
        "mean_saturation": round(mean, 2),
        "scan_like": bright >= SCAN_BRIGHT and very >= SCAN_VERY_BRIGHT and mean <= SCAN_MEAN_SATURATION,
    }


def flash_hint(bgr: np.ndarray) -> dict[str, float | bool]:
    """Percent of very bright grey pixels, sampled to at most 256 a side; flashy above 2 percent."""
    step = max(1, -(-max(bgr.shape[:2]) // FLASH_WIDTH))
    small = bgr[::step, ::step].astype(np.float64)
    grey = small @ np.array([0.114, 0.587, 0.299])
    part = 100.0 * float((grey > FLASH_VALUE).mean()) if grey.size else 0.0
    return {"bright_pct": round(part, 2), "flashy": part > FLASH_PART}


def image_metrics(images: DataFrame) -> DataFrame:
    """Metrics of (doc_id, height, width, data): data is BGR bytes, as the image source gives them.

    Rows whose data does not fit their size get nulls.
    """
    schema = (
        "doc_id long, glare_pct double, spot_pct double, box_pct double, localized boolean, scan_bright_pct double, "
        "very_bright_pct double, mean_saturation double, scan_like boolean, flash_pct double, flashy boolean"
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                data = np.frombuffer(row.data or b"", np.uint8)
                if not row.height or not row.width or len(data) != row.height * row.width * 3:
                    rows.append((row.doc_id, *[None] * 10))
                    continue
                bgr = data.reshape(row.height, row.width, 3)
                rows.append((row.doc_id, *glare(bgr).values(), *scan_like(bgr).values(), *flash_hint(bgr).values()))
            yield pd.DataFrame(rows, columns=names)

    return images.select("doc_id", "height", "width", "data").mapInPandas(run, schema)
