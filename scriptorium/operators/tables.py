"""Ruled tables: thin paths and cell boxes to rules, rules to grids, runs to cells. A page is the unit."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds
from scriptorium.operators.columns import BOX

TURN = [1, 0, 3, 2]


def join_collinear(pieces: np.ndarray, snap: float, gap: float) -> np.ndarray:
    """Horizontal pieces of one height (within ``snap`` of the line's first) that touch, or nearly, as one."""
    if not len(pieces):
        return pieces.reshape(-1, 4)
    pieces = pieces[np.lexsort((pieces[:, 0], (pieces[:, 1] + pieces[:, 3]) / 2))]
    out, line, start = [], [], None
    for p in [*pieces, None]:
        y = None if p is None else (p[1] + p[3]) / 2
        if line and (p is None or y - start > snap):
            own = np.array(sorted(line, key=lambda r: r[0]))
            reach = np.maximum.accumulate(own[:, 2])
            cut = np.concatenate([[0], np.cumsum(own[1:, 0] > reach[:-1] + gap)])
            out += [[*own[cut == c, :2].min(0), *own[cut == c, 2:].max(0)] for c in range(cut[-1] + 1)]
            line = []
        if p is not None:
            start = y if not line else start
            line.append(p)
    return np.array(out, float)


def cell_edges(boxes: np.ndarray, snap: float) -> np.ndarray:
    """The four sides of each box that shares a side with another, end to end."""
    if not len(boxes):
        return boxes.reshape(-1, 4)
    x0, y0, x1, y1 = boxes.T
    near = lambda a, b: np.abs(a[:, None] - b) <= snap
    beside = near(y0, y0) & near(y1, y1) & (near(x1, x0) | near(x0, x1))
    above = near(x0, x0) & near(x1, x1) & (near(y1, y0) | near(y0, y1))
    cell = boxes[((beside | above) & ~np.eye(len(boxes), dtype=bool)).any(1)]
    a, b, c, d = cell.T
    return np.concatenate([np.stack(s, 1) for s in ((a, b, c, b), (a, d, c, d), (a, b, a, d), (c, b, c, d))]) if len(cell) else cell.reshape(-1, 4)


def assemble_rules(boxes: np.ndarray, is_rule: np.ndarray, t: Thresholds = DEFAULT) -> np.ndarray:
    """A page's rules: its thin paths and the sides of its cells, joined along their lines, lying ones first."""
    thick = ~is_rule & (np.minimum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]) > t.rule_max_thickness_pt)
    found = np.concatenate([boxes[is_rule], cell_edges(boxes[thick], t.grid_snap_pt)])
    lies = found[:, 2] - found[:, 0] >= found[:, 3] - found[:, 1]
    across = join_collinear(found[lies], t.grid_snap_pt, t.rule_join_gap_pt)
    down = join_collinear(found[~lies][:, TURN], t.grid_snap_pt, t.rule_join_gap_pt)[:, TURN]
    return np.concatenate([across, down])


def snapped(values: list[float], snap: float) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or abs(v - out[-1]) > snap:
            out.append(v)
    return out


def band_of(ladder: list[float], value: float) -> int | None:
    """The first step of a ladder that holds a value, both ends included."""
    return next((i for i in range(len(ladder) - 1) if ladder[i] <= value <= ladder[i + 1]), None)


def multiset(texts: list[str]) -> Counter:
    return Counter(w for x in texts for w in x.split())


def middle(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2


def standing(rules: np.ndarray, region: np.ndarray, top: float, foot: float, snap: float) -> list[float]:
    """Where upright rules cross a region from top to foot."""
    up = rules[rules[:, 3] - rules[:, 1] > rules[:, 2] - rules[:, 0]]
    ok = (up[:, 0] >= region[0] - snap) & (up[:, 2] <= region[2] + snap) & (up[:, 1] <= top + snap) & (up[:, 3] >= foot - snap)
    return snapped(middle(up[ok])[0].tolist(), snap) if foot > top else []


def text_rows(boxes: np.ndarray, t: Thresholds = DEFAULT) -> list[dict]:
    """Rows of runs at one height: their edges, and whether they hold several runs that stand apart."""
    rows: list[list[int]] = []
    x, y = middle(boxes) if len(boxes) else (np.zeros(0), np.zeros(0))
    for i in np.argsort(y, kind="stable"):
        if rows and abs(y[i] - y[rows[-1][0]]) <= t.grid_snap_pt:
            rows[-1].append(int(i))
        else:
            rows.append([int(i)])
    return [{"y": float(y[r].mean()), "left": float(boxes[r, 0].min()), "right": float(boxes[r, 2].max()), "starts": sorted(boxes[r, 0].tolist())} for r in rows]


def aligned(rows: list[dict], snap: float) -> list[bool]:
    """Whether a row begins two columns or more where another row does."""
    return [any(sum(any(abs(a - b) <= snap for b in other["starts"]) for a in row["starts"]) >= 2 for other in rows if other is not row) for row in rows]


def regions(rules: np.ndarray, runs: np.ndarray, t: Thresholds = DEFAULT) -> list[tuple[np.ndarray, list[float], list[float]]]:
    """(box, row ladder, column ladder) of groups of lying rules, from the top, each over a good part of the next; a group is cut where what stands between two rules is prose and not cells."""
    snap = t.grid_snap_pt
    across = rules[rules[:, 2] - rules[:, 0] >= rules[:, 3] - rules[:, 1]]
    across = across[np.argsort(across[:, 1], kind="stable")]
    groups: list[list[np.ndarray]] = []
    for r in across:
        last = groups[-1][-1] if groups else None
        shortest = 0.0 if last is None else min(last[2] - last[0], r[2] - r[0])
        if last is not None and shortest > 0 and max(0.0, min(last[2], r[2]) - max(last[0], r[0])) / shortest >= t.rule_overlap_min:
            groups[-1].append(r)
        else:
            groups.append([r])
    out = []
    for group in groups:
        box = np.array([*np.min([g[:2] for g in group], 0), *np.max([g[2:] for g in group], 0)])
        _, y = middle(runs) if len(runs) else (None, np.zeros(0))
        inside = runs[(y >= box[1]) & (y <= box[3]) & (runs[:, 2] > box[0]) & (runs[:, 0] < box[2])] if len(runs) else runs
        rows = text_rows(inside, t)
        in_line = aligned(rows, snap)
        parts = [[group[0]]]
        for above, rule in zip(group, group[1:], strict=False):
            top, foot = (above[1] + above[3]) / 2, (rule[1] + rule[3]) / 2
            between = [(r, a) for r, a in zip(rows, in_line, strict=True) if top < r["y"] < foot]
            ruled = max(0, len(standing(rules, box, top, foot, snap)) - 1)
            over = sum(r["left"] < box[0] - snap or r["right"] > box[2] + snap for r, _ in between)
            cells = len(between) < t.table_min_aligned_rows or ruled >= t.table_min_columns or (any(a for _, a in between) and over < t.table_min_aligned_rows)
            if cells:
                parts[-1].append(rule)
            else:
                parts.append([rule])
        for part in parts:
            if len(part) >= t.table_min_row_rules:
                b = np.array([*np.min([g[:2] for g in part], 0), *np.max([g[2:] for g in part], 0)])
                out.append((b, snapped([float((g[1] + g[3]) / 2) for g in part], snap), standing(rules, b, b[1], b[3], snap)))
    return out


def build_table(box: np.ndarray, row_ladder: list[float], column_ladder: list[float], runs: pd.DataFrame, free: set, t: Thresholds = DEFAULT) -> tuple[list[list[str]], bool, set] | None:
    """(rows of cells, whether they are a grid, blocks taken) of a region and a page's runs (block, text, box), or None if it isn't a table.

    Blocks wholly inside are taken, if they are most of the text there. A grid needs ruled columns that no run crosses, and the words of its cells have to be those of the runs; else each run is a row.
    """
    cx, cy = middle(runs[BOX].to_numpy(float)) if len(runs) else (np.zeros(0), np.zeros(0))
    here = (cx >= box[0]) & (cx <= box[2]) & (cy >= box[1]) & (cy <= box[3])
    runs = runs.assign(cx=cx, cy=cy, here=here, n=runs["text"].str.replace(r"\s", "", regex=True).str.len())
    said = runs[(runs["n"] > 0) & runs["block"].isin(free)]
    took = set(said.groupby("block").filter(lambda g: g["here"].all())["block"]) if len(said) else set()
    own = said[said["block"].isin(took) & said["here"]]
    if not len(own):
        return None
    if own["n"].sum() < t.table_min_taken_text_share * said[said["here"]]["n"].sum():
        return None
    if len(column_ladder) - 1 < t.table_min_columns:
        rows = text_rows(own[BOX].to_numpy(float), t)
        in_line = aligned(rows, t.grid_snap_pt)
        if sum(in_line) < t.table_min_aligned_rows or sum(in_line) < t.table_min_aligned_row_share * len(rows):
            return None
    texts = own["text"].str.strip().tolist()
    crossed = any(((runs[runs["here"]]["x0"] < c) & (runs[runs["here"]]["x1"] > c)).any() for c in column_ladder)
    if len(column_ladder) >= t.table_min_column_rules and not crossed and len(row_ladder) > 1:
        grid: list[list[list[str]]] = [[[] for _ in column_ladder[1:]] for _ in row_ladder[1:]]
        for r in runs[runs["n"] > 0].itertuples():
            i, j = band_of(row_ladder, r.cy), band_of(column_ladder, r.cx)
            if i is not None and j is not None:
                grid[i][j].append(r.text.strip())
        cells = [[" ".join(c) for c in row] for row in grid]
        if cells and cells[0] and multiset([c for row in cells for c in row]) == multiset(texts):
            return cells, True, took
    return [[x] for x in texts], False, took


def page_rules(vectors: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(page, x0, y0, x1, y1) of the rules of vectors (page, x0, y0, x1, y1, is_rule)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*BOX, "is_rule"])
        out = pd.DataFrame(assemble_rules(rows[BOX].to_numpy(float), rows["is_rule"].to_numpy(bool), t), columns=BOX)
        return out.assign(page=rows["page"].iloc[0])[["page", *BOX]]

    return vectors.groupBy("page").applyInPandas(run, f"page {dict(vectors.dtypes)['page']}, x0 double, y0 double, x1 double, y1 double")


def furniture_rules(rules: DataFrame, pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Rules (doc, page, x0, y0, x1, y1) that stand at one place, give or take a step of the grid, on enough pages of their document (``pages``: doc, n). Each place is entered with its neighbours, so places meet by equality."""
    at = lambda c: F.floor(F.col(c) / t.grid_snap_pt + 0.5)
    placed = rules.withColumns({f"p{c}": at(c) for c in BOX})
    near = placed.select("doc", "page", *[f"p{c}" for c in BOX]).distinct()
    for c in BOX:
        own = F.col(f"p{c}")
        near = near.withColumn(f"p{c}", F.explode(F.array(own - 1, own, own + 1)))
    seen = near.groupBy("doc", *[f"p{c}" for c in BOX]).agg(F.countDistinct("page").alias("on")).join(pages, "doc")
    need = F.greatest(F.lit(t.furniture_min_repeat_pages), F.ceil(F.col("n") * t.furniture_min_repeat_page_share))
    often = seen.where(F.col("on") >= need).select("doc", *[f"p{c}" for c in BOX])
    return placed.join(often, ["doc", *[f"p{c}" for c in BOX]], "left_semi").select(*rules.columns)


def extract_tables(vectors: DataFrame, runs: DataFrame, skip: DataFrame | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """(page, table, row, column, text, grid) of the ruled tables of pages. ``vectors``: page, x0, y0, x1, y1, is_rule. ``runs``: page, block, at, text, x0, y0, x1, y1. ``skip``: page, block of blocks that others own."""
    kinds = dict(vectors.dtypes)
    v = vectors.select("page", *[F.col(c).cast("double").alias(c) for c in BOX], F.col("is_rule"), F.lit(None).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("string").alias("text"))
    r = runs if skip is None else runs.join(skip, ["page", "block"], "left_anti")
    r = r.select("page", *[F.col(c).cast("double").alias(c) for c in BOX], F.lit(None).cast("boolean").alias("is_rule"), F.col("block").cast("bigint").alias("block"), F.col("at").cast("bigint").alias("at"), "text")
    ruled = v.select("page").distinct()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        paths = rows[rows["is_rule"].notna()].sort_values(BOX)
        words = rows[rows["is_rule"].isna()].sort_values("at")
        rules = assemble_rules(paths[BOX].to_numpy(float), paths["is_rule"].to_numpy(bool), t)
        free, out, n = set(words["block"]), [], 0
        for box, row_ladder, column_ladder in regions(rules, words[words["text"].str.strip() != ""][BOX].to_numpy(float), t):
            if built := build_table(box, row_ladder, column_ladder, words, free, t):
                cells, grid, took = built
                out += [(rows["page"].iloc[0], n, i, j, x, grid) for i, row in enumerate(cells) for j, x in enumerate(row)]
                free -= took
                n += 1
        return pd.DataFrame(out, columns=["page", "table", "row", "column", "text", "grid"])

    both = v.unionByName(r.join(ruled, "page", "left_semi"))
    return both.groupBy("page").applyInPandas(run, f"page {kinds['page']}, table int, row int, column int, text string, grid boolean")


def cells_of(runs: DataFrame, ladders: DataFrame) -> DataFrame:
    """(page, row, column, text) of runs (page, at, text, x, y: their middle) and ladders (page, rows array, columns array): each run in the first step that holds it, both ends included; texts in order."""

    def step(ladder: str, at: str) -> Column:
        low = F.slice(ladder, F.lit(1), F.greatest(F.size(ladder) - 1, F.lit(0)))
        holds = F.transform(low, lambda x, i: (F.col(at) >= x) & (F.col(at) <= F.get(F.col(ladder), i + 1)))
        return F.array_position(holds, F.lit(True)) - 1

    rows = runs.join(ladders, "page").withColumns({"row": step("rows", "y"), "column": step("columns", "x")}).where("row >= 0 and column >= 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.trim("text").alias("text")))), lambda x: x["text"]), " ")
    return rows.groupBy("page", "row", "column").agg(text.alias("text"))


def word_multiset(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.select(*keys, F.explode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
