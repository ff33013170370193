"""Columns, blocks and what stands between them. A page is the unit of grouped functions; what is a rule on single boxes is an expression."""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds

BOX = ["x0", "y0", "x1", "y1"]


# --- boxes as expressions (structs x0, y0, x1, y1) ---


def horizontal_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))


def vertical_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))


def box_area(a: Column) -> Column:
    return F.greatest(a["x1"] - a["x0"], F.lit(0.0)) * F.greatest(a["y1"] - a["y0"], F.lit(0.0))


def intersection_over_union(a: Column, b: Column) -> Column:
    both = horizontal_overlap(a, b) * vertical_overlap(a, b)
    return F.when(both > 0, both / (box_area(a) + box_area(b) - both)).otherwise(0.0)


def union_of(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1): the box around all boxes of a key."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def median_heights(boxes: DataFrame) -> DataFrame:
    """(page, em): the upper median height of a page's lines, to a hundredth of a point."""
    h = F.array_sort(F.collect_list(F.round(F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0)) * 100)))
    return boxes.groupBy("page").agg(h.alias("h")).select("page", (F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int")) / 100).alias("em"))


def size_breaks(lines: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(page, group, line, part): a group's lines (page, group, line, size, y0, x0), top to bottom, cut where the size changes by more than a share of the larger."""
    w = Window.partitionBy("page", "group").orderBy(F.round(F.col("y0") * 100), F.round(F.col("x0") * 100), "line")
    was = F.lag("size").over(w)
    largest = F.greatest(was, F.col("size"))
    cut = F.coalesce((largest > 0) & (F.abs(was - F.col("size")) / largest > t.size_barrier_ratio), F.lit(False))
    return lines.withColumn("cut", cut.cast("int")).select("page", "group", "line", F.sum("cut").over(w).alias("part"))


def assign_columns(blocks: DataFrame, columns: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(page, id, column, floats) of blocks (page, id, x0, x1, ...) and columns (page, column, x0, x1): the column that holds most of a block, the first of several; a block that covers
    a good part of more than one floats (a title over columns). Pages have a few columns."""
    c = columns.select("page", "column", F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    over = F.greatest(F.least("x1", "c1") - F.greatest("x0", "c0"), F.lit(0.0))
    met = blocks.join(c, "page").withColumns({"over": over, "in": (over / F.greatest(F.col("c1") - F.col("c0"), F.lit(1.0))) >= t.column_span_share})
    best = met.groupBy("page", "id").agg(F.max(F.struct("over", (-F.col("column")).alias("less")))["less"].alias("less"), F.count_if("in").alias("within"))
    return best.select("page", "id", (-F.col("less")).alias("column"), (F.col("within") > 1).alias("floats"))


def split_lines(segments: DataFrame, columns: DataFrame) -> DataFrame:
    """(page, line, column, x0, y0, x1, y1, text) of line segments (page, line, seg, x0, y0, x1, y1, text): a line whose segments lie in several columns is one line for each of them.

    A line of one segment stays whole, whatever it covers.
    """
    s = segments.withColumn("id", F.struct("line", "seg"))
    at = assign_columns(s.select("page", "id", "x0", "x1"), columns).select("page", "id", "column")
    rows = s.join(at, ["page", "id"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("page", "line", "column").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")], text.alias("text"))


def anchor_images(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, image, reading_index): the first block in reading order that begins at or below an image's foot, else one after the last.

    A running minimum from the foot of the page up, so images and blocks of a page aren't paired.
    """
    rows = blocks.select("page", F.col("y0").alias("y"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("image"), F.col("reading_index").cast("bigint").alias("reading_index"))
    rows = rows.unionByName(images.select("page", F.col("y1").alias("y"), F.lit(1).alias("kind"), F.col("id").cast("bigint").alias("image"), F.lit(None).cast("bigint").alias("reading_index")))
    w = Window.partitionBy("page").orderBy(F.desc("y"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("reading_index").over(Window.partitionBy("page")) + 1
    return rows.withColumn("found", F.coalesce(F.min("reading_index").over(w), last, F.lit(0).cast("bigint"))).where("kind = 1").select("page", "image", F.col("found").alias("reading_index"))


def drop_caps(lines: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(page, line, text) of lines (page, line, text, x0, y0, x1, y1) that are one character, as high as two lines, with a line to their right at the same height. Few lines are one character."""
    em = median_heights(lines)
    tall = lines.join(em, "page").where((F.length(F.trim("text")) == 1) & (F.col("em") > 0) & (F.col("y1") - F.col("y0") >= t.dropcap_min_height_lines * F.col("em")))
    tall = tall.select("page", F.col("line").alias("cap"), F.trim("text").alias("letter"), F.struct(*BOX).alias("r"))
    beside = lines.join(tall, "page").where("line <> cap and x0 >= r.x1 and y1 > r.y0 and y0 < r.y1")
    return beside.select("page", F.col("cap").alias("line"), F.col("letter").alias("text")).distinct()


def column_retries(rates: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, attempt): which layout of a document is kept. ``rates``: doc, attempt (0, 1, ...: one column fewer each time), broken (share of page ends where text doesn't run on).

    The next is tried while the present one breaks too often, and kept only if it breaks less; the first that doesn't ends it.
    """
    w = Window.partitionBy("doc").orderBy("attempt")
    was = F.lag("broken").over(w)
    better = F.coalesce((was > t.continuity_break_max) & (F.col("broken") < was), F.lit(True))
    ok = rates.where(F.col("attempt") <= t.max_column_retries).withColumn("ok", better)
    return ok.withColumn("all_ok", F.every("ok").over(w)).where("all_ok").groupBy("doc").agg(F.max("attempt").alias("attempt"))


# --- one page in numpy ---


def nearest_rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(np.asarray(x) + 0.5)


def modal_distance(distances: np.ndarray) -> float:
    """The mean within the most frequent whole number of points, the smaller of two; 0 without distances."""
    d = np.asarray(distances, float)
    if not len(d):
        return 0.0
    bucket, count = np.unique(nearest_rounded(d), return_counts=True)
    return float(d[nearest_rounded(d) == bucket[count.argmax()]].mean())


def pair_geometry(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of boxes: horizontal and vertical overlap, horizontal gap, and distance of centres in height."""
    x0, y0, x1, y1 = b.T
    ox = np.maximum(np.minimum(x1[:, None], x1) - np.maximum(x0[:, None], x0), 0)
    oy = np.maximum(np.minimum(y1[:, None], y1) - np.maximum(y0[:, None], y0), 0)
    dx = np.where(ox > 0, 0, np.maximum(np.maximum(x0[None, :] - x1[:, None], x0[:, None] - x1[None, :]), 0))
    cy = (y0 + y1) / 2
    return ox, oy, dx, np.abs(cy[:, None] - cy)


def connected(joined: np.ndarray) -> np.ndarray:
    """The smallest index that each index is connected with."""
    root = np.arange(len(joined))
    while True:
        low = np.where(joined, root[None, :], len(joined)).min(1, initial=len(joined))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def docstrum(b: np.ndarray, multiplier: float = 1.3, angles: tuple[float, float] = (45.0, 135.0)) -> np.ndarray:
    """Groups of lines: those above each other, overlapping, and no farther apart than the page's usual distance of nearest lines times a factor."""
    ox, _, dx, dy = pair_geometry(b)
    angle = np.where((dx == 0) & (dy == 0), 90.0, np.degrees(np.arctan2(dy, dx)))
    upright = (angle >= angles[0]) & (angle <= angles[1]) & ~np.eye(len(b), dtype=bool)
    far = np.hypot(dx, dy)
    nearest = np.where(upright, far, np.inf).min(1, initial=np.inf)
    usual = modal_distance(nearest[np.isfinite(nearest)])
    return connected(upright & (ox > 0) & (far <= usual * multiplier))


def longest_free(covered: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """For each column of a (rows, columns) picture the longest window, from the top, whose covered share stays within the tolerance: first row and rows.

    The window's head moves down row by row; its tail follows as far as it has to.
    """
    rows, n = covered.shape
    sums = np.zeros((rows + 1, n), np.int64)
    np.cumsum(covered, 0, out=sums[1:])
    every = np.arange(n)
    tail, first, size = (np.zeros(n, np.int64) for _ in range(3))
    for head in range(1, rows + 1):
        while True:
            bad = (tail < head) & (sums[head] - sums[tail, every] > tolerance * (head - tail))
            if not bad.any():
                break
            tail[bad] += 1
        longer = head - tail > size
        first[longer], size[longer] = tail[longer], head - tail[longer]
    return first, size


def gutters(b: np.ndarray, em: float, t: Thresholds = DEFAULT) -> list[tuple[float, float, float]]:
    """(x0, x1, score) of valleys of a page's runs: strips a point wide that are free over most of the text's height and have text on both sides there, side by side for long enough."""
    if not len(b):
        return []
    left, top, right, foot = b[:, 0].min(), b[:, 1].min(), b[:, 2].max(), b[:, 3].max()
    n, rows = int(np.ceil(right - left)), int(np.ceil(foot - top))
    if n <= 0 or rows <= 0:
        return []
    ink = np.zeros((rows, n), bool)
    for x0, y0, x1, y1 in b - [left, top, left, top]:
        ink[max(0, int(np.floor(y0))) : int(np.ceil(y1)), max(0, int(np.floor(x0))) : int(np.ceil(x1))] = True
    first, size = longest_free(ink, max(0.0, 1 - t.gutter_emptiness_min))
    x, y = left + np.arange(n)[:, None], top + first[:, None]
    at_height = (b[:, 3] > y) & (b[:, 1] < y + size[:, None])
    flanked = (at_height & (b[:, 2] <= x) & (b[:, 0] < x)).any(1) & (at_height & (b[:, 0] >= x + 1) & (b[:, 2] > x + 1)).any(1)
    fits = np.concatenate([[False], (size / max(foot - top, 1.0) >= t.gutter_height_share_min) & flanked, [False]])
    edges = np.flatnonzero(np.diff(fits.astype(int)))
    found = []
    for a, z in edges.reshape(-1, 2):
        if z - a >= em * t.gutter_min_width_em:
            x0, x1 = left + a, left + z
            over = np.maximum(np.minimum(b[:, 2], x1) - np.maximum(b[:, 0], x0), 0) * (b[:, 3] - b[:, 1])
            found.append((float(x0), float(x1), float((z - a) * min(1.0, max(0.0, 1 - over.sum() / ((x1 - x0) * (foot - top)))))))
    return found


def column_bounds(b: np.ndarray, em: float, limit: int | None = None, t: Thresholds = DEFAULT) -> list[tuple[float, float]]:
    """(x0, x1) of a page's columns, at most ``limit``: the best valleys by width and emptiness part them."""
    if not len(b):
        return [(0.0, 0.0)]
    left, right = float(b[:, 0].min()), float(b[:, 2].max())
    found = [] if limit is not None and limit <= 1 else gutters(b, em, t)
    if limit is not None and len(found) + 1 > limit:
        found = sorted(sorted(found, key=lambda g: -g[2])[: limit - 1])
    edges = [left, *(x for g in found for x in g[:2]), right]
    return list(zip(edges[::2], edges[1::2], strict=True))


def detect_columns(boxes: DataFrame, limit: int | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """(page, column, x0, x1) of the boxes (page, x0, y0, x1, y1) of a page's runs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        b = rows[BOX].to_numpy(float)
        heights = np.sort(nearest_rounded(np.maximum(b[:, 3] - b[:, 1], 0) * 100))
        out = column_bounds(b, heights[len(heights) // 2] / 100, limit, t)
        return pd.DataFrame({"page": rows["page"].iloc[0], "column": range(len(out)), "x0": [x for x, _ in out], "x1": [x for _, x in out]})

    return boxes.groupBy("page").applyInPandas(run, f"page {dict(boxes.dtypes)['page']}, column int, x0 double, x1 double")


def free_rectangles(b: np.ndarray, t: Thresholds = DEFAULT, steps: int = 400_000) -> list[tuple[float, float, float, float]]:
    """White rectangles that reach across the text's area, largest first: the best-first search of a cover.

    A candidate without an obstacle is white; else it is split around its obstacle nearest the middle. Obstacles may be grazed by a share of their size. What is found is grown to its neighbours and kept if it
    spans the area's width or height.
    """
    if not len(b):
        return []
    area = (b[:, 0].min(), b[:, 1].min(), b[:, 2].max(), b[:, 3].max())
    slack = t.whitespace_fuzziness * np.maximum(b[:, 2:] - b[:, :2], 0)
    centre, order = (b[:, :2] + b[:, 2:]) / 2, nearest_rounded(b[:, [1, 0, 3, 2]] * 100)

    def in_way(r: tuple, among: np.ndarray) -> np.ndarray:
        own = b[among]
        ox, oy = np.minimum(own[:, 2], r[2]) - np.maximum(own[:, 0], r[0]), np.minimum(own[:, 3], r[3]) - np.maximum(own[:, 1], r[1])
        return among[(ox > 0) & (oy > 0) & (ox > slack[among, 0]) & (oy > slack[among, 1])]

    def push(r: tuple, among: np.ndarray) -> None:
        heapq.heappush(queue, (-float(nearest_rounded((r[2] - r[0]) * (r[3] - r[1]))), r[1], r[0], next(number), r, in_way(r, among)))

    def grown(r: tuple) -> tuple:
        rows = b[(b[:, 3] > r[1]) & (b[:, 1] < r[3])]
        x0, x1 = max([area[0], *rows[rows[:, 2] <= r[0], 2]]), min([area[2], *rows[rows[:, 0] >= r[2], 0]])
        cols = b[(b[:, 2] > x0) & (b[:, 0] < x1)]
        return float(x0), float(max([area[1], *cols[cols[:, 3] <= r[1], 3]])), float(x1), float(min([area[3], *cols[cols[:, 1] >= r[3], 1]]))

    queue: list = []
    number = count()
    push(area, np.arange(len(b)))
    found: list[tuple[float, float, float, float]] = []
    for _ in range(steps):
        if not queue or len(found) >= t.whitespace_max_rectangles:
            break
        cost, _, _, _, r, among = heapq.heappop(queue)
        if -cost < t.whitespace_min_area:
            break
        if not len(among):
            g = grown(r)
            across = (g[0] <= area[0] + 0.01 and g[2] >= area[2] - 0.01) or (g[1] <= area[1] + 0.01 and g[3] >= area[3] - 0.01)
            if across and g not in found:
                found.append(g)
            continue
        off = nearest_rounded(np.hypot(*(centre[among] - [(r[0] + r[2]) / 2, (r[1] + r[3]) / 2]).T) * 100)
        p = b[among[np.lexsort((*order[among].T[::-1], off))[0]]]
        for part, there in (((r[0], r[1], min(p[0], r[2]), r[3]), p[0] > r[0]), ((max(p[2], r[0]), r[1], r[2], r[3]), p[2] < r[2]), ((r[0], r[1], r[2], min(p[1], r[3])), p[1] > r[1]), ((r[0], max(p[3], r[1]), r[2], r[3]), p[3] < r[3])):
            if there:
                push(part, among)
    return found


def cut_by_white(b: np.ndarray, white: list, least: float, column: np.ndarray) -> np.ndarray:
    """Groups of lines of one column that overlap in a direction and have no white rectangle, wide enough, between them."""
    ox, oy, _, _ = pair_geometry(b)
    apart = np.zeros((len(b), len(b)), bool)
    x0, y0, x1, y1 = b.T
    for w in white:
        gap_y = np.minimum(w[3], np.maximum(y0[:, None], y0)) - np.maximum(w[1], np.minimum(y1[:, None], y1))
        spans_x = (w[0] <= np.maximum(x0[:, None], x0)) & (w[2] >= np.minimum(x1[:, None], x1))
        gap_x = np.minimum(w[2], np.maximum(x0[:, None], x0)) - np.maximum(w[0], np.minimum(x1[:, None], x1))
        spans_y = (w[1] <= np.maximum(y0[:, None], y0)) & (w[3] >= np.minimum(y1[:, None], y1))
        apart |= (ox > 0) & spans_x & (gap_y >= least) | (oy > 0) & spans_y & (gap_x >= least)
    return connected((column[:, None] == column) & ((ox > 0) | (oy > 0)) & ~apart)


def page_blocks(b: np.ndarray, sizes: np.ndarray, columns: list[tuple[float, float]] | None = None, t: Thresholds = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """(block of each line, agreement of each block): groups of near lines, cut where the size changes and numbered from the top; agreement is the best overlap with a group that white space makes."""
    key = nearest_rounded(b[:, [1, 0]] * 100)

    def ordered(group: np.ndarray) -> np.ndarray:
        """Numbers from the top, cut where sizes of following lines differ."""
        out, made = np.zeros(len(b), int), []
        for g in np.unique(group):
            lines = np.flatnonzero(group == g)
            lines = lines[np.lexsort((lines, key[lines, 1], key[lines, 0]))]
            s = sizes[lines]
            largest = np.maximum(s[1:], s[:-1])
            cut = np.concatenate([[0], np.cumsum((largest > 0) & (np.abs(s[1:] - s[:-1]) > t.size_barrier_ratio * largest))])
            made += [lines[cut == c] for c in np.unique(cut)]
        for i, lines in enumerate(sorted(made, key=lambda x: (*key[x[0]], x[0]))):
            out[lines] = i
        return out

    def around(group: np.ndarray) -> np.ndarray:
        return np.array([[*b[group == g, :2].min(0), *b[group == g, 2:].max(0)] for g in range(group.max() + 1)])

    if not len(b):
        return np.zeros(0, int), np.zeros(0)
    cols = columns or [(float(b[:, 0].min()), float(b[:, 2].max()))]
    over = np.stack([np.maximum(np.minimum(b[:, 2], x1) - np.maximum(b[:, 0], x0), 0) for x0, x1 in cols])
    white = [w for i in range(len(cols)) for w in free_rectangles(b[over[i] > 0], t)] if len(cols) > 1 else free_rectangles(b, t)
    heights = np.sort(nearest_rounded(np.maximum(b[:, 3] - b[:, 1], 0) * 100))
    near = ordered(docstrum(b))
    parted = ordered(cut_by_white(b, white, heights[len(heights) // 2] / 100 * t.separator_height_ratio, over.argmax(0)))
    one, two = around(near), around(parted)
    ox = np.maximum(np.minimum(one[:, None, 2], two[None, :, 2]) - np.maximum(one[:, None, 0], two[None, :, 0]), 0)
    oy = np.maximum(np.minimum(one[:, None, 3], two[None, :, 3]) - np.maximum(one[:, None, 1], two[None, :, 1]), 0)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = size(one)[:, None] + size(two) - ox * oy
    return near, np.where(ox * oy > 0, ox * oy / np.where(union > 0, union, 1), 0).max(1)


def segment_blocks(lines: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(page, id, block, agreement, sure) of lines (page, id, x0, y0, x1, y1, size)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        block, agreement = page_blocks(rows[BOX].to_numpy(float), rows["size"].to_numpy(float), None, t)
        return rows[["page", "id"]].assign(block=block, agreement=agreement[block], sure=agreement[block] >= t.agreement_iou_min)

    return lines.groupBy("page").applyInPandas(run, f"page {dict(lines.dtypes)['page']}, id bigint, block int, agreement double, sure boolean")


def white_space(lines: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(page, x0, y0, x1, y1) of the white rectangles across a page's lines."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(free_rectangles(rows[BOX].to_numpy(float), t), columns=BOX).assign(page=rows["page"].iloc[0])[["page", *BOX]].astype(dict.fromkeys(BOX, float))

    return lines.groupBy("page").applyInPandas(run, f"page {dict(lines.dtypes)['page']}, x0 double, y0 double, x1 double, y1 double")


def insert_floating(order: list[int], boxes: np.ndarray, index: int, columns: list[tuple[float, float]]) -> list[int]:
    """The order with a floating box put in: before the first box below it that shares a column, else beside the box whose centre is nearest (nearer the more they overlap)."""
    me = boxes[index]

    def touched(r: np.ndarray) -> set[int]:
        over = [min(r[2], x1) - max(r[0], x0) for x0, x1 in columns]
        return {i for i, x in enumerate(over) if x > 0} or {int(np.argmax(over))}

    mine = touched(me)
    for at, other in enumerate(order):
        if me[3] <= boxes[other][1] and mine & touched(boxes[other]):
            return [*order[:at], index, *order[at:]]
    if not order:
        return [index]
    rest = boxes[order]
    ox, oy = np.maximum(np.minimum(rest[:, 2], me[2]) - np.maximum(rest[:, 0], me[0]), 0), np.maximum(np.minimum(rest[:, 3], me[3]) - np.maximum(rest[:, 1], me[1]), 0)
    size = lambda r: np.maximum(r[..., 2] - r[..., 0], 0) * np.maximum(r[..., 3] - r[..., 1], 0)
    union = size(me) + size(rest) - ox * oy
    far = np.hypot(*((rest[:, :2] + rest[:, 2:]) - (me[:2] + me[2:])).T) / 2 * (1 - np.where(union > 0, ox * oy / np.where(union > 0, union, 1), 0))
    at = int(nearest_rounded(far * 100).argmin())
    at += int(me[1] > boxes[order[at]][1])
    return [*order[:at], index, *order[at:]]
