"""Where paragraphs begin and which blocks carry one on, from the lines of laid-out blocks.

Lines: doc, page (numbered on within a document, and no other document's), block, column, at (order in the document), text, x0, y0, x1, y1, baseline, size.
Windows run over a block's lines; blocks meet those of their own and the next page only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds
from scriptorium.functions.text import runs_on
from scriptorium.operators.columns import median_heights

BREAK_HYPHEN = r"[-‐]\s*$"


def differs(a: Column, b: Column, share: float) -> Column:
    """Two sizes, both known, that are apart by more than a share of the larger."""
    return F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) / F.greatest(a, b) > share), F.lit(False))


def modal_leadings(lines: DataFrame) -> DataFrame:
    """(block, leading): the mean of a block's gaps between baselines within its most frequent whole number of points (the smaller of two); blocks without gaps have no row."""
    w = Window.partitionBy("block").orderBy("at")
    gaps = lines.withColumn("gap", F.col("baseline") - F.lag("baseline").over(w)).where("gap > 0")
    buckets = gaps.groupBy("block", F.floor(F.col("gap") + 0.5).alias("bucket")).agg(F.count("*").alias("n"), F.avg("gap").alias("mean"))
    return buckets.groupBy("block").agg(F.max(F.struct("n", (-F.col("bucket")).alias("less"), "mean"))["mean"].alias("leading"))


def measured(lines: DataFrame) -> DataFrame:
    """Lines with their place in the block, how many it has, indent and right gap against it, how much of its measure they fill, and the page's em."""
    box = lines.groupBy("block").agg(F.min("x0").alias("b0"), F.max("x1").alias("b1"), F.count("*").alias("lines"))
    rows = lines.join(box, "block").join(median_heights(lines), "page")
    fill = F.least(F.greatest((F.col("x1") - F.col("b0")) / F.greatest(F.col("b1") - F.col("b0"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    place = F.row_number().over(Window.partitionBy("block").orderBy("at"))
    return rows.withColumns({"place": place, "indent": F.col("x0") - F.col("b0"), "right_gap": F.col("b1") - F.col("x1"), "fill": fill}).drop("b0", "b1")


def conventions(rows: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, indents): whether a book marks paragraphs by indenting their first lines (enough of its lines are indented), or by space."""
    share = F.avg((F.col("indent") >= t.indent_min_em * F.col("em")).cast("double"))
    return rows.groupBy("doc").agg((share >= t.indent_convention_min_share).alias("indents"))


def paragraph_starts(rows: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, block, at, starts) of measured lines: a line after the first opens a paragraph if it is indented in a book that indents, stands off from the line before, follows a short line, or is of another size."""
    w = Window.partitionBy("block").orderBy("at")
    both = rows.join(conventions(rows, t), "doc").join(modal_leadings(rows), "block", "left")
    gap = F.col("baseline") - F.lag("baseline").over(w)
    opens = (
        (F.col("indents") & (F.col("indent") >= t.indent_min_em * F.col("em")))
        | F.coalesce((F.col("leading") > 0) & (gap > F.col("leading") * t.extra_leading_ratio), F.lit(False))
        | (F.lag("fill").over(w) < t.line_unwrap_factor)
        | differs(F.lag("size").over(w), F.col("size"), t.size_barrier_ratio)
    )
    return both.select("doc", "block", "at", F.coalesce((F.col("place") > 1) & opens, F.lit(False)).alias("starts"))


def carry_overs(rows: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, block, carried_from) of blocks whose first line goes on with the last paragraph of an earlier block, over a column's or a page's end.

    The candidate is the next block of the same page and like size, whatever stands between; else the first block of the next page, if its size is like.
    """
    word = F.regexp_extract("text", r"^\s*(\S+)", 1)
    first_word = F.when(F.length("text") > 0, (F.col("x1") - F.col("x0")) * F.length(word) / F.length("text")).otherwise(0.0)
    head = F.struct("at", "text", "size", "fill", "indent", "em", first_word.alias("word"))
    last = F.struct("at", "text", "size", "fill", "right_gap")
    blocks = rows.groupBy("doc", "page", "column", "block", "lines").agg(F.min(head).alias("head"), F.max(last).alias("last"))
    entry = F.struct(F.col("head.at").alias("at"), "block", "column", "lines", "head")
    pages = blocks.groupBy("page").agg(F.array_sort(F.collect_list(entry)).alias("on"))
    nexts = pages.select((F.col("page") - 1).alias("page"), F.element_at("on", 1).alias("following"))
    b = blocks.join(pages, "page").join(nexts, "page", "left")
    like = lambda x: ~differs(F.col("last.size"), x["head"]["size"], t.size_barrier_ratio)
    here = F.try_element_at(F.filter("on", lambda x: (x["at"] > F.col("last.at")) & like(x)), F.lit(1))
    there = F.when(F.col("following").isNotNull() & like(F.col("following")), F.col("following"))
    # a block of the same page that is like is the candidate, even if it stands in the same column and so carries nothing
    b = b.withColumns({"here": here, "there": there})
    b = b.withColumn("next", F.when(F.col("here").isNotNull(), F.when(F.col("here.column") != F.col("column"), F.col("here"))).otherwise(F.col("there"))).where("next is not null")
    b = b.join(conventions(rows, t), "doc")
    hyphen = F.rlike("last.text", F.lit(BREAK_HYPHEN))
    open_end = (F.col("last.fill") >= t.line_unwrap_factor) | hyphen
    indented = (F.col("next.lines") > 1) & (F.col("next.head.indent") >= t.indent_min_em * F.col("next.head.em"))
    fits = (F.col("next.head.word") > 0) & (F.col("last.right_gap") > F.col("next.head.word") + F.greatest("last.size", "next.head.size") * t.word_space_em)
    full_out = F.col("indents") & (F.col("next.lines") > 1) & (F.col("next.head.fill") >= t.line_unwrap_factor) & F.rlike("next.head.text", F.lit(r"^\s*[^\p{N}\s]"))
    goes_on = F.coalesce(runs_on(F.col("last.text"), F.col("next.head.text")), F.lit(False))
    carries = open_end & ~indented & (hyphen | ~fits) & (hyphen | goes_on | full_out)
    # a block is carried on by one block; of several that could be, the last in order
    return b.where(carries).groupBy("doc", F.col("next.block").alias("block")).agg(F.max(F.struct(F.col("last.at").alias("at"), "block"))["block"].alias("carried_from"))


def paragraphs(lines: DataFrame, starts: DataFrame, carried: DataFrame, glued: DataFrame | None = None) -> DataFrame:
    """(doc, para, first_page, last_page, blocks, text): lines cut where paragraphs start, joined where one is carried on. A document's lines are folded in order; ``glued`` (doc, at) lines run on without a blank,
    their last hyphen being gone."""
    rows = lines.join(starts, ["doc", "block", "at"]).join(carried, ["doc", "block"], "left")
    rows = rows.join(glued.withColumn("glue", F.lit(True)), ["doc", "at"], "left") if glued is not None else rows.withColumn("glue", F.lit(False))
    rows = rows.select("doc", "page", "block", "at", F.trim("text").alias("text"), "starts", "carried_from", F.coalesce("glue", F.lit(False)).alias("glue"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        made: list[dict] = []
        last_of: dict = {}
        block = None
        for r in part.sort_values("at").itertuples():
            if r.block != block:
                at = last_of.get(r.carried_from) if pd.notna(r.carried_from) else None
            elif r.starts:
                at = None
            else:
                at = last_of[block]
            block = r.block
            if at is None:
                made.append({"doc": key[0], "para": len(made), "first_page": r.page, "blocks": [], "text": "", "glue": True})
                at = len(made) - 1
            p = made[at]
            p["text"] += ("" if p["glue"] else " ") + (r.text[:-1] if r.glue else r.text)
            p["glue"], p["last_page"] = r.glue, r.page
            if block not in p["blocks"]:
                p["blocks"].append(block)
            last_of[block] = at
        return pd.DataFrame(made, columns=["doc", "para", "first_page", "last_page", "blocks", "text", "glue"]).drop(columns="glue")

    kinds = dict(lines.dtypes)
    return rows.groupBy("doc").applyInPandas(run, f"doc {kinds['doc']}, para int, first_page {kinds['page']}, last_page {kinds['page']}, blocks array<{kinds['block']}>, text string")


def line_breaks(lines: DataFrame, starts: DataFrame, carried: DataFrame) -> DataFrame:
    """(doc, at, head, tail): words broken by a hyphen at a line's end within a paragraph, or where one is carried on: head without its hyphen, tail from the next line's start."""
    w = Window.partitionBy("block").orderBy("at")
    rows = lines.join(starts, ["doc", "block", "at"])
    rows = rows.withColumns({"after": F.when(~F.lead("starts").over(w), F.lead("text").over(w)), "ends": F.lead("at").over(w).isNull()})
    heads = lines.groupBy("doc", "block").agg(F.min(F.struct("at", "text"))["text"].alias("next_text")).join(carried, ["doc", "block"]).select("doc", F.col("carried_from").alias("block"), "next_text")
    rows = rows.join(heads, ["doc", "block"], "left").withColumn("after", F.when(F.col("ends"), F.col("next_text")).otherwise(F.col("after")))
    head = F.regexp_extract("text", r"([\p{L}\p{N}]+)[-‐]\s*$", 1)
    tail = F.regexp_extract("after", r"^\s*([\p{L}\p{N}]+)", 1)
    return rows.select("doc", "at", head.alias("head"), tail.alias("tail")).where("head <> '' and tail <> ''")


def resolve_hyphens(breaks: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(glued (doc, at), ledger (doc, at, reason, text)) of breaks and what was decided on them (book, head, tail, decision): each joined word loses one hyphen, on one entry."""
    joined = breaks.join(decisions.where("decision = 'join'").select(F.col("book").alias("doc"), "head", "tail").distinct(), ["doc", "head", "tail"]).select("doc", "at")
    return joined, joined.select("doc", "at", F.lit("Dehyphenate").alias("reason"), F.lit("-").alias("text"))
