"""Headings: which blocks are candidates, what levels they get, and chapter numbers that run through a book."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds
from scriptorium.functions.text import ends_mid_sentence, fold_key, heading_numbering, legible, looks_like_a_misread_numeral, numeral
from scriptorium.operators.evaluate import edit_distance
from scriptorium.operators.structure import remove_level_skips

# What may end a heading that a paragraph runs on from.
RUN_IN_ENDS = ".—:–"


def dominant_clusters(runs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, block, cluster): the style that most of a block's visible characters are in (the last of several), if that is a large enough share. ``runs``: doc, block, cluster (null: unknown), text."""
    chars = runs.withColumn("n", F.length(F.regexp_replace("text", r"(?U)\s", ""))).where("n > 0")
    per = chars.groupBy("doc", "block", "cluster").agg(F.sum("n").alias("n"))
    best = per.groupBy("doc", "block").agg(F.sum("n").alias("of"), F.max(F.when(F.col("cluster").isNotNull(), F.struct("n", "cluster"))).alias("x"))
    return best.where(F.col("x.n") / F.col("of") >= t.cluster_char_share_min).select("doc", "block", F.col("x.cluster").alias("cluster"))


def heading_candidates(blocks: DataFrame, dominant: DataFrame, styles: DataFrame, body: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Blocks (doc, block, at, page, text, width_ratio, space_above) whose style (``dominant``) is a heading's (``styles``: doc, cluster), with cluster, mid_sentence, short_line, air, legible and admissible. ``body``: doc, size."""
    text = F.trim("text")
    rows = blocks.join(dominant, ["doc", "block"]).join(styles.select("doc", "cluster").distinct(), ["doc", "cluster"], "left_semi").join(body.select("doc", F.col("size").alias("body")), "doc").where(text != "")
    rows = rows.withColumns({
        "text": text, "mid_sentence": ends_mid_sentence(text), "short_line": F.col("width_ratio") < t.short_line_max_width_ratio,
        "air": (F.col("space_above") <= 0) | (F.col("space_above") > F.col("body") * t.space_above_min_em), "legible": legible(text, t.legible_min_chars, t.legible_min_share),
    })
    return rows.withColumn("admissible", F.col("short_line") & ~F.col("mid_sentence") & F.col("legible")).drop("body")


def trust_outline(valid: Column, entries: Column, bound: Column, distinct: Column, t: Thresholds = DEFAULT) -> Column:
    """Whether an outline is believed: it binds something, and the style inventory is valid or the outline itself is found on the pages and says different things."""
    fits = (bound >= t.outline_trust_min_bound_share * entries) & (distinct >= t.outline_trust_min_distinct_share * entries)
    return (entries > 0) & (bound > 0) & (valid | fits)


def bind(candidates: DataFrame, entries: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, entry, block, level): entries (doc, entry, title, level, page or null), in order, each bound to the heading, or two following ones of a page, whose text is nearest its title; within a page of where
    it says, each block once. ``candidates``: doc, block, at, page, text, admissible (a pair's second need not be).

    Greedy by nature, so a fold over a document's entries; texts are folded and measured on both sides of one document only.
    """
    c = candidates.select("doc", F.lit(0).alias("kind"), F.col("block").cast("bigint").alias("id"), F.col("at").cast("bigint").alias("at"), F.col("page").cast("bigint").alias("page"), fold_key(F.col("text")).alias("key"), F.col("admissible").alias("own"), F.lit(0).alias("level"))
    e = entries.select("doc", F.lit(1).alias("kind"), F.col("entry").cast("bigint").alias("id"), F.col("entry").cast("bigint").alias("at"), F.col("page").cast("bigint").alias("page"), fold_key(F.col("title")).alias("key"), F.lit(True).alias("own"), F.col("level").cast("int").alias("level"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        heads = rows[rows["kind"] == 0].sort_values("at").to_dict("records")
        follows = {(h["page"], h["at"]): h for h in heads}
        options = [((h,), h["key"]) for h in heads if h["own"]]
        options += [((h, n), f"{h['key']} {n['key']}") for h in heads if h["own"] and (n := follows.get((h["page"], h["at"] + 1)))]
        taken: set = set()
        out = []
        for e in rows[rows["kind"] == 1].sort_values("at").to_dict("records"):
            best = None
            for blocks, text in options:
                if any(b["id"] in taken for b in blocks) or (pd.notna(e["page"]) and abs(blocks[0]["page"] - e["page"]) > 1):
                    continue
                longest = max(len(text), len(e["key"]))
                if abs(len(text) - len(e["key"])) > t.outline_match_ned_max * longest:
                    continue
                far = edit_distance([*text], [*e["key"]]) / longest if longest else 0.0
                rank = (far, blocks[0]["at"], len(blocks))
                if far <= t.outline_match_ned_max and (best is None or rank < best[0]):
                    best = (rank, blocks)
            for b in best[1] if best else ():
                taken.add(b["id"])
                out.append((*key, e["id"], b["id"], e["level"]))
        return pd.DataFrame(out, columns=["doc", "entry", "block", "level"])

    return c.unionByName(e).groupBy("doc").applyInPandas(run, f"doc {dict(candidates.dtypes)['doc']}, entry bigint, block bigint, level int")


def assign_levels(candidates: DataFrame, ranks: DataFrame, by_outline: DataFrame, by_contents: DataFrame, trusted: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, block, at, page, text, cluster, level, source) of heading candidates: by the outline where it is trusted, else by the contents page, else by size, which a number refines; levels that skip are closed.

    ``ranks``: doc, cluster, tier (from 0). ``by_outline``, ``by_contents``: doc, block, level. ``trusted``: doc, valid, outline (boolean).
    """
    c = candidates.join(trusted, "doc")
    has = by_contents.select("doc").distinct().withColumn("any_contents", F.lit(True))
    c = c.join(has, "doc", "left").withColumn("contents", F.col("valid") & ~F.col("outline") & F.coalesce("any_contents", F.lit(False)))
    c = c.join(by_outline.select("doc", "block", F.col("level").alias("o")).distinct(), ["doc", "block"], "left").join(by_contents.select("doc", "block", F.col("level").alias("k")).distinct(), ["doc", "block"], "left").join(ranks, ["doc", "cluster"], "left")
    c = c.where(F.col("admissible") | (F.col("outline") & F.col("o").isNotNull()))
    by_size = F.least(F.greatest(F.col("tier") + 1, F.lit(1)), F.lit(t.size_rank_max_level))
    level = F.when(F.col("outline"), F.col("o")).when(F.col("contents"), F.col("k")).otherwise(by_size)
    c = c.withColumn("level", level).where("level is not null")
    number = heading_numbering(F.col("text"))["level"]
    sized = ~F.col("outline") & ~F.col("contents")
    refined = sized & number.isNotNull() & (number != F.col("level"))
    c = c.withColumns({"source": F.when(F.col("outline"), "outline").when(F.col("contents"), "contents").when(refined, "numbering").otherwise("size"), "level": F.when(refined, number).otherwise(F.col("level"))})
    fixed = remove_level_skips(c.select("doc", "block", "at", "page", "text", "cluster", "level", "source"), "at")
    return fixed.withColumn("level", F.col("fixed")).drop("fixed")


def with_openers(headings: DataFrame, openers: DataFrame) -> DataFrame:
    """Headings (doc, block, at, page, text, level) with chapter openers (doc, block, at, page, text) that aren't among them: at level 1, or 2 where there are parts between them, fewer than openers."""
    first = openers.groupBy("doc").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = headings.join(first, "doc").where((F.col("level") == 1) & (F.col("at") > F.col("first"))).groupBy("doc").agg(F.count("*").alias("parts"))
    level = F.when((F.col("parts") > 0) & (F.col("parts") < F.col("n")), 2).otherwise(1)
    new = openers.join(headings.select("doc", "block"), ["doc", "block"], "left_anti").join(first, "doc").join(parts, "doc", "left").withColumn("level", level)
    both = headings.select("doc", "block", "at", "page", "text", "level").unionByName(new.select("doc", "block", "at", "page", "text", "level"))
    return remove_level_skips(both, "at").withColumn("level", F.col("fixed")).drop("fixed")


def apply_heading_edits(headings: DataFrame, edits: DataFrame) -> DataFrame:
    """Headings (doc, at, cluster, level, source, ...) with what was decided on styles (doc, cluster, new_level or null, demote: paragraph, epigraph or null): those ranked by size alone are moved or leave. Levels that skip are closed."""
    both = headings.join(edits, ["doc", "cluster"], "left")
    sized = F.col("source") == "size"
    kept = both.where(~(sized & F.col("demote").isNotNull()) | F.col("demote").isNull())
    kept = kept.withColumn("level", F.when(sized & F.col("new_level").isNotNull(), F.col("new_level")).otherwise(F.col("level")))
    return remove_level_skips(kept.select(*headings.columns), "at").withColumn("level", F.col("fixed")).select(*headings.columns)


# --- chapter numbers ---


def usual_tops(blocks: DataFrame) -> DataFrame:
    """(doc, top): the upper median of where pages' first blocks (doc, page, at, y0) begin."""
    first = blocks.groupBy("doc", "page").agg(F.min_by("y0", "at").alias("y0"))
    tops = first.groupBy("doc").agg(F.array_sort(F.collect_list("y0")).alias("y"))
    return tops.select("doc", F.element_at("y", (F.floor(F.size("y") / 2) + 1).cast("int")).alias("top"))


def number_labels(text: Column, t: Thresholds = DEFAULT) -> tuple[Column, Column]:
    """Whether a text is a few words with a numeral at an end (or what one is misread as), and the numeral's value."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    numeric = lambda w: F.coalesce(numeral(w).isNotNull() | looks_like_a_misread_numeral(w), F.lit(False))
    return (F.size(words) > 0) & (F.size(words) <= t.opener_max_tokens) & (numeric(first) | numeric(last)), F.coalesce(numeral(first), numeral(last))


def longest_run(values: list, pages: list[int], free: list[bool]) -> list[int]:
    """Places of the longest chain of free values that grow by one or two from page to later page; of several the one that ends first, each step from the earliest that makes it longest."""
    length: dict[int, int] = {}
    back: dict[int, int] = {}
    for i, (v, p) in enumerate(zip(values, pages, strict=True)):
        if not free[i] or v is None:
            continue
        length[i] = 1
        for j in length:
            if j != i and values[j] in (v - 1, v - 2) and pages[j] < p and length[j] + 1 > length[i]:
                length[i], back[i] = length[j] + 1, j
    if not length:
        return []
    at = max(length, key=lambda i: (length[i], -i))
    chain = [at]
    while at in back:
        at = back[at]
        chain.append(at)
    return chain[::-1]


def chapter_openers(blocks: DataFrame, body: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, block, at, page, text, value) of short numbered blocks (doc, block, at, page, text, y0, space_above, lines) that stand low on a page or under air and are links of a chain of numbers through the book; a
    block between two numbers that leave one out is taken for it. ``body``: doc, size."""
    label, value = number_labels(F.col("text"), t)
    w = Window.partitionBy("doc").orderBy("at")
    b = blocks.join(usual_tops(blocks), "doc").join(body.select("doc", F.col("size").alias("body")), "doc")
    first = F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(True))
    sink = F.col("body") * t.opener_sink_em
    b = b.withColumn("stands", F.when(first, F.col("y0") >= F.col("top") + sink).otherwise(F.col("space_above") >= sink))
    c = b.where(F.col("stands") & label & (F.col("lines") <= t.opener_max_lines) & (F.col("lines") > 0)).select("doc", F.col("block").cast("bigint").alias("block"), F.col("at").cast("bigint").alias("at"), F.col("page").cast("bigint").alias("page"), F.trim("text").alias("text"), value.cast("int").alias("value"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        values = [None if pd.isna(v) else int(v) for v in rows["value"]]
        pages, chosen = rows["page"].tolist(), [False] * len(rows)
        while True:
            chain = longest_run(values, pages, [not c for c in chosen])
            gaps = sorted(pages[b] - pages[a] for a, b in zip(chain, chain[1:], strict=False))
            if len(chain) < max(1, t.opener_min_chain) or not gaps or gaps[len(gaps) // 2] < t.opener_min_page_gap:
                break
            for i in chain:
                chosen[i] = True
            for a, b in zip(chain, chain[1:], strict=False):
                if values[b] == values[a] + 2:
                    missing = next((i for i in range(a + 1, b) if not chosen[i] and values[i] != values[a] + 1), None)
                    if missing is not None:
                        chosen[missing] = True
        return rows[chosen].astype({"value": "Int32"})

    return c.groupBy("doc").applyInPandas(run, f"doc {dict(blocks.dtypes)['doc']}, block bigint, at bigint, page bigint, text string, value int")


# --- other headings ---


def run_in_candidates(runs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, block, text, words) of blocks whose first run (doc, block, at, text, weight, italic) is bold or italic as the second is not, a few words long, and ends as a heading does."""
    w = Window.partitionBy("doc", "block").orderBy("at")
    bold = F.col("weight") >= t.bold_weight_min
    first = runs.withColumns({"bold": bold, "then_bold": F.lead(bold).over(w), "then_italic": F.lead("italic").over(w), "k": F.row_number().over(w)}).where("k = 1 and then_bold is not null")
    bare = F.regexp_replace(F.trim("text"), f"[{RUN_IN_ENDS} ]+$", "")
    words = F.regexp_count(bare, F.lit(r"\S+"))
    styled = (F.col("bold") | F.col("italic")) & ~((F.col("bold") == F.col("then_bold")) & (F.col("italic") == F.col("then_italic")))
    return first.where(styled & (bare != F.trim("text")) & words.between(1, t.runin_max_words)).select("doc", "block", bare.alias("text"), words.cast("bigint").alias("words"))


def contents_levels(entries: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Contents entries (doc, page, at, x0, folio) with level 1 to 3: rungs of indent against the page's least numbered entry, a step apart; an entry is on the last rung that it reaches."""
    numbered = F.col("folio").isNotNull()
    e = entries.withColumn("indent", F.col("x0") - F.coalesce(F.min(F.when(numbered, F.col("x0"))).over(Window.partitionBy("doc", "page")), F.lit(0.0)))
    step = F.lit(t.toc_indent_step_pt)
    rungs = F.aggregate(
        F.array_sort(F.collect_list(F.when(numbered, F.col("indent")))),
        F.array().cast("array<double>"),
        lambda acc, x: F.when(F.coalesce(x - F.try_element_at(acc, F.lit(-1)) < step, F.lit(False)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    ladder = e.groupBy("doc").agg(rungs.alias("ladder"))
    e = e.join(ladder, "doc")
    return e.withColumn("level", F.least(F.greatest(F.size(F.filter("ladder", lambda r: F.col("indent") + step > r)), F.lit(1)), F.lit(3))).drop("ladder", "indent")


def join_multiline(headings: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, block, head): headings (doc, block, at, order, page, text, size, y0, y1) that go on the one before: the next block of its page, close below and of its size, or a title close below a number. ``head`` is the first of them."""
    w = Window.partitionBy("doc").orderBy("at")
    label, _ = number_labels(F.col("text"), t)
    was = lambda c: F.lag(c).over(w)
    largest = F.greatest(F.col("size"), was("size"))
    gap = F.col("y0") - was("y1")
    close = lambda em: (gap >= -1.0) & (gap <= em * largest)
    alike = (F.abs(F.col("size") - was("size")) / largest <= t.level_size_tolerance) & close(t.join_gap_em)
    titled = was(label) & ~label & close(t.label_title_gap_em)
    goes_on = F.coalesce((F.col("order") == was("order") + 1) & (F.col("page") == was("page")) & (alike | titled), F.lit(False))
    rows = headings.withColumn("goes_on", goes_on).withColumn("group", F.sum((~F.col("goes_on")).cast("int")).over(w))
    return rows.withColumn("head", F.first("block").over(Window.partitionBy("doc", "group").orderBy("at"))).where("goes_on").select("doc", "block", "head")
