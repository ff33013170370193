"""Glyphs to runs and lines: what stands on one baseline, where words and styles end.

Runs and lines are made in Python, on Arrow columns, from the rows of whole pages, so that no glyph is sorted, shuffled or joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.config import DEFAULT, Thresholds

# Signs that stand for a note, and the hyphens that may end a line.
NOTE_SIGNS = "*†‡§‖¶"
HYPHENS = "-‐"


def strip_control(glyphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Glyphs (page, idx, ch, ...) that aren't control characters, and an entry (page, start, n) for each unbroken run of those that are."""
    control = F.rlike("ch", F.lit(r"\p{Cc}"))
    gone = glyphs.where(control).withColumn("run", F.col("idx") - F.expr("row_number() over (partition by page order by idx)"))
    return glyphs.where(~control), gone.groupBy("page", "run").agg(F.min("idx").alias("start"), F.count("*").alias("n")).drop("run")


def line_baselines(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body, baseline): the upper median baseline of a line's glyphs of its most frequent size (the smaller of two as frequent).

    Glyphs are counted by size and baseline first: a line has a few of each, and counts are all that is shuffled.
    """
    counts = glyphs.groupBy(*keys, "size", "baseline").agg(F.count("*").alias("n")).withColumn("known", F.when(F.col("baseline").isNotNull(), F.col("n")).otherwise(0))
    sized = f"over (partition by {', '.join(keys)}, size"
    sums = counts.withColumns({"all": F.expr(f"sum(n) {sized})"), "of": F.expr(f"sum(known) {sized})"), "reached": F.expr(f"sum(known) {sized} order by baseline rows between unbounded preceding and current row)")})
    middle = F.min(F.when((F.col("known") > 0) & (F.col("reached") > F.floor(F.col("of") / 2)), F.col("baseline")))
    sizes = sums.groupBy(*keys, "size").agg(F.first("all").alias("all"), middle.alias("baseline"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("all", (-F.col("size")).alias("less"), "baseline")).alias("x"))
    return best.select(*keys, (-F.col("x.less")).alias("body"), F.col("x.baseline").alias("baseline")).where("body is not null and baseline is not null")


def by_page(rows: DataFrame) -> DataFrame:
    """The rows, those of a page one after another in one partition."""
    return rows.repartition("page").sortWithinPartitions("page")


def _pages(make: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``make`` of whole pages: rows of the last page, the first column, wait for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            page = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(page != page[-1])[-1]) + 1 if (page != page[-1]).any() else 0
            if held and (cut or held[-1].column(0)[-1] != batch.column(0)[0]):
                yield make(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield make(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield make(pa.Table.from_batches(held))

    return run


def _codes(*columns: pa.ChunkedArray) -> np.ndarray:
    """A number for each combination of values, in the order in which the values come; nulls are a value."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        one = c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out = out * (int(one.max(initial=0)) + 1) + one
    return out


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]])


def _middles(line: np.ndarray, size: np.ndarray, baseline: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line its most frequent size (the smaller of several) and the upper median baseline of its glyphs of that size. Lines are numbers from 0, in order."""
    sizes, code = np.unique(size, return_inverse=True)
    pairs, lines = line * len(sizes) + code, int(line[-1]) + 1
    if lines * len(sizes) <= 8 * len(line):
        own = np.bincount(pairs, minlength=lines * len(sizes)).reshape(lines, -1).argmax(1)
    else:
        pairs, n = np.unique(pairs, return_counts=True)
        best = pairs[np.lexsort((pairs % len(sizes), -n, pairs // len(sizes)))]
        own = best[_starts(best // len(sizes))] % len(sizes)
    rows = np.flatnonzero(own[line] == code)
    rows = rows[np.lexsort((baseline[rows], line[rows]))]
    first = _starts(line[rows])
    return sizes[own], baseline[rows[first + np.diff(np.r_[first, len(rows)]) // 2]]


def _vertical(sign: np.ndarray, size: np.ndarray, own: np.ndarray, y0: np.ndarray, y1: np.ndarray, baseline: np.ndarray, body: np.ndarray, t: Thresholds) -> np.ndarray:
    """0 base, 1 sup, 2 sub: a small glyph by its own baseline, a digit or note sign of the body's size by where its ink is."""
    rise, small = t.superscript_rise_ratio * size, size < t.superscript_size_ratio_max * body
    return np.select([small & (baseline - own >= rise), small & (own - baseline >= rise), small, sign & (baseline - y1 >= rise), sign & (y0 - baseline >= rise)], [1, 2, 0, 1, 2], 0)


GLYPH = ["page", "line", "idx", "ch", "x0", "y0", "x1", "y1", "baseline", "font", "size", "weight", "italic"]
BOX = ["x0", "y0", "x1", "y1", "baseline"]


def assemble_runs(glyphs: DataFrame, spaces: DataFrame, t: Thresholds = DEFAULT, gathered: bool = False) -> DataFrame:
    """(page, line, run, text, x0, y0, x1, y1, baseline, size, weight, italic, vertical, first, n) of glyphs (page, line, idx, ch, x0, y0, x1, y1, baseline, font, size, weight, italic).

    On a line glyphs stand by their left edge (then number). A blank goes between two that are farther apart than ``spaces`` (font, size, threshold) says, else a part of the size; a new
    run begins where the style changes or the gap is wide. A page is in memory at once; ``gathered``: the glyphs are those of ``by_page`` rows already.
    """
    g = (glyphs if gathered else by_page(glyphs.select(*GLYPH))).join(F.broadcast(spaces), ["font", "size"], "left").where("page is not null and line is not null and size is not null")
    g = g.select(*[F.col(c).cast("double").alias(c) if c in BOX else F.col(c) for c in GLYPH], F.col("threshold").cast("double").alias("threshold"))
    kind = {f.name: f.dataType for f in g.schema.fields}
    fields = [(c, kind[c]) for c in ("page", "line")] + [("run", T.LongType()), ("text", T.StringType())] + [(c, T.DoubleType()) for c in BOX] + [(c, kind[c]) for c in ("size", "weight", "italic")] + [("vertical", T.StringType()), ("first", kind["idx"]), ("n", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def runs_of(table: pa.Table) -> pa.RecordBatch:
        of = {c: table.column(c) for c in table.column_names}
        numbers = lambda c: of[c].cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(of[c], pa.Array) else of[c].cast(pa.float64()).to_numpy()
        line = _codes(of["page"], of["line"])
        order = np.lexsort((of["idx"].to_numpy(), numbers("x0"), line))
        line, of = line[order], {c: v.combine_chunks().take(pa.array(order)) for c, v in of.items()}
        begins = np.r_[True, line[1:] != line[:-1]]
        line = np.cumsum(begins) - 1
        x0, y0, x1, y1, own, size = (numbers(c) for c in ("x0", "y0", "x1", "y1", "baseline", "size"))
        body, base = (v[line] for v in _middles(line, size, own))
        ch = of["ch"].fill_null("").cast(pa.string())
        sign = pc.is_in(ch, pa.array(list("0123456789" + NOTE_SIGNS))).to_numpy(zero_copy_only=False)
        up = _vertical(sign, size, own, y0, y1, base, body, t)
        style = _codes(*[pa.chunked_array([of[c]]) for c in ("font", "size", "weight", "italic")], pa.chunked_array([up]))
        gap = np.r_[0.0, x0[1:] - x1[:-1]]
        new = begins | np.r_[True, style[1:] != style[:-1]] | (gap > t.line_split_gap_em * body)
        given = numbers("threshold")
        room = np.maximum(np.where(np.isnan(given), t.fallback_space_ratio * size, given), t.min_space_ratio * size)
        space = pc.equal(ch, " ").to_numpy(zero_copy_only=False)
        blank = ~new & (gap > room) & ~space & ~np.r_[False, space[:-1]]
        at = np.flatnonzero(new)
        pieces = pc.if_else(pa.array(blank), pc.binary_join_element_wise(" ", ch, ""), ch)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, len(new)], pa.int32()), pieces), "")
        n, number = np.diff(np.r_[at, len(new)]), np.cumsum(new) - 1
        first = {c: of[c].take(pa.array(at)) for c in ("page", "line", "size", "weight", "italic")}
        out = first | {"run": number[at] - number[np.flatnonzero(begins)][line[at]], "text": text, "x0": np.minimum.reduceat(x0, at), "y0": np.minimum.reduceat(y0, at), "x1": np.maximum.reduceat(x1, at), "y1": np.maximum.reduceat(y1, at)}
        out |= {"baseline": np.add.reduceat(own, at) / n, "vertical": pa.array(np.array(["base", "sup", "sub"])[up[at]].tolist(), pa.string()), "first": np.minimum.reduceat(of["idx"].to_numpy(), at), "n": n}
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in (out[c] for c, _ in fields)], names=[c for c, _ in fields])

    return g.mapInArrow(_pages(runs_of), schema)


def assemble_lines(runs: DataFrame, gathered: bool = False) -> DataFrame:
    """(page, line, x0, y0, x1, y1, baseline, text, hyphen, indent, right_gap) of runs (page, line, run, text, x0, ..., baseline, size): the baseline is that of the largest run (the last of several),
    indent and gap are measured against all runs of the page. A page is in memory at once; ``gathered``: its runs follow one another already."""
    names = ["page", "line", "run", "text", *BOX, "size"]
    r = (runs.select(*names) if gathered else by_page(runs.select(*names))).where("page is not null and line is not null")
    kind = {f.name: f.dataType for f in r.schema.fields}
    fields = [(c, kind[c]) for c in ("page", "line")] + [(c, T.DoubleType()) for c in BOX] + [("text", T.StringType()), ("hyphen", T.BooleanType()), ("indent", T.DoubleType()), ("right_gap", T.DoubleType())]

    def lines_of(table: pa.Table) -> pa.RecordBatch:
        page, line = _codes(table.column("page")), _codes(table.column("page"), table.column("line"))
        order = np.lexsort((table.column("run").to_numpy(), line))
        line, page, of = line[order], page[order], table.take(pa.array(order))
        number = lambda c: of.column(c).cast(pa.float64()).to_numpy()
        x0, y0, x1, y1, base = (number(c) for c in BOX)
        left, right = np.full(page.max() + 1, np.inf), np.full(page.max() + 1, -np.inf)
        np.minimum.at(left, page, x0)
        np.maximum.at(right, page, x1)
        at = _starts(line)
        end = np.r_[at[1:], len(line)] - 1
        largest = np.lexsort((of.column("run").to_numpy(), number("size"), line))[end]
        said = of.column("text").combine_chunks().fill_null("")
        last = pc.utf8_rtrim(said.take(pa.array(end)), characters=" \t\n\x0b\f\r")
        hyphen = pc.is_in(pc.utf8_slice_codeunits(last, -1), pa.array(list(HYPHENS)))
        out = [of.column(c).take(pa.array(at)).combine_chunks() for c in ("page", "line")] + [np.minimum.reduceat(x0, at), np.minimum.reduceat(y0, at), np.maximum.reduceat(x1, at), np.maximum.reduceat(y1, at), base[largest]]
        out += [pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, len(line)], pa.int32()), said), " "), hyphen, np.minimum.reduceat(x0, at) - left[page[at]], right[page[at]] - np.maximum.reduceat(x1, at)]
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out], names=[c for c, _ in fields])

    return r.mapInArrow(_pages(lines_of), T.StructType([T.StructField(*f) for f in fields]))
