"""Geometry: baselines, gaps, blocks and reading order. A page is the unit of grouped functions, and pages are bounded."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds
from scriptorium.operators.columns import BOX, docstrum, insert_floating


def two_means_threshold(gaps: list[float], resolution: float = 0.05, separation: float = 2.0, rounds: int = 32, counts: list[int] | None = None) -> float | None:
    """The midpoint of two clusters of gaps (from the extremes; ties go low), or None if they aren't apart. A gap counts as often as ``counts`` says, or once."""
    known = [(g, c) for g, c in zip(gaps, [1] * len(gaps) if counts is None else counts, strict=True) if g is not None and c > 0]
    x, n = np.array(sorted(known), float).reshape(-1, 2).T
    if n.sum() < 2 or x[-1] - x[0] <= resolution:
        return None
    low, high = x[0], x[-1]
    for _ in range(rounds):
        is_low = np.abs(x - low) <= np.abs(x - high)
        if is_low.all() or not is_low.any():
            return None
        low, high = np.average(x[is_low], weights=n[is_low]), np.average(x[~is_low], weights=n[~is_low])
    spread = np.average(np.abs(x - np.where(is_low, low, high)), weights=n)
    return float((low + high) / 2) if (high - low) / max(spread, resolution) >= separation else None


def space_thresholds(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, threshold) of rows (keys, gap): a grouped function, after gaps are counted to a hundredth so that a group's size is bounded; counts are weights."""
    counted = gaps.where("gap >= 0").groupBy(*keys, F.round("gap", 2).alias("gap")).agg(F.count("*").alias("n"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = two_means_threshold(rows["gap"].tolist(), counts=rows["n"].tolist())
        return pd.DataFrame([[*key, int(rows["n"].sum()), found]], columns=[*keys, "n", "threshold"])

    schema = ", ".join(f"`{k}` {dict(gaps.dtypes)[k]}" for k in keys) + ", n bigint, threshold double"
    return counted.groupBy(*keys).applyInPandas(run, schema)


def cluster_baselines(items: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(page, id, line) of items (page, id, baseline, size): in the order of baselines, an item joins the line whose anchor is near; the anchor moves to the largest item."""
    ratio = t.line_baseline_tolerance_ratio

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["baseline", "id"], kind="stable")
        lines, line, anchor, size = [], -1, 0.0, 0.0
        for base, own in zip(rows["baseline"], rows["size"], strict=True):
            if line < 0 or abs(base - anchor) > ratio * max(size, own):
                line, anchor, size = line + 1, base, own
            elif own > size:
                anchor, size = base, own
            lines.append(line)
        return rows[["page", "id"]].assign(line=lines)

    return items.groupBy("page").applyInPandas(run, f"page {dict(items.dtypes)['page']}, id bigint, line int")


def _valley(low: np.ndarray, high: np.ndarray) -> tuple[float, np.ndarray | None]:
    """The widest empty band between intervals, and which of them begin before its end."""
    order = np.argsort(low, kind="stable")
    widths = low[order[1:]] - np.maximum.accumulate(high[order])[:-1]
    if not len(widths) or widths.max() <= 0:
        return 0.0, None
    return float(widths.max()), low < low[order[1:]][widths.argmax()]


def xy_order(boxes: np.ndarray, ids: np.ndarray, min_x: float, min_y: float) -> list[int]:
    """Ids in reading order: regions are split at the valley that is widest in units of what its direction needs (columns first on
    a tie); a region without a valley is read by top, then left edge, at a hundredth, then id."""
    out: list[int] = []
    todo = [np.arange(len(ids))]
    while todo:
        at = todo.pop()
        region = boxes[at]
        x, left = _valley(region[:, 0], region[:, 2])
        y, upper = _valley(region[:, 1], region[:, 3])
        x, y = x / min_x if x >= min_x else 0.0, y / min_y if y >= min_y else 0.0
        first = left if x and x >= y else upper if y else None
        if first is None:
            key = np.round(region * 100)
            out += ids[at[np.lexsort((ids[at], key[:, 0], key[:, 1]))]].tolist()
        else:
            todo += [at[~first], at[first]]
    return out


def reading_order(blocks: DataFrame, min_x: float, min_y: float) -> DataFrame:
    """(page, id, reading_index) of blocks (page, id, x0, y0, x1, y1): a permutation for each page. The least gaps of columns and rows are over 0.

    Blocks with a true column ``floats`` (titles over columns, images) are left out of the cuts and put back where they stand.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        floats = rows["floats"].to_numpy(bool) if "floats" in rows else np.zeros(len(rows), bool)
        boxes, ids = rows[BOX].to_numpy(float), rows["id"].to_numpy()
        at = {x: i for i, x in enumerate(ids.tolist())}
        order = [at[x] for x in xy_order(boxes[~floats], ids[~floats], min_x, min_y)]
        whole = [(float(boxes[:, 0].min()), float(boxes[:, 2].max()))]
        for i in np.flatnonzero(floats):
            order = insert_floating(order, boxes, int(i), whole)
        out = ids[order].tolist()
        return pd.DataFrame({"page": rows["page"].iloc[0], "id": out, "reading_index": range(len(out))})

    return blocks.groupBy("page").applyInPandas(run, f"page {dict(blocks.dtypes)['page']}, id bigint, reading_index int")


def docstrum_groups(lines: DataFrame, multiplier: float = 1.3) -> DataFrame:
    """(page, id, block): lines one above the other, horizontally overlapping, and no farther apart than the page's usual distance times a factor, are one block; block is its smallest line."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return rows[["page", "id"]].assign(block=rows["id"].to_numpy()[docstrum(rows[BOX].to_numpy(float), multiplier)])

    return lines.groupBy("page").applyInPandas(run, f"page {dict(lines.dtypes)['page']}, id bigint, block bigint")
