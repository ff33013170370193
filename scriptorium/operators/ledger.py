"""The conservation ledger: multisets of characters, budgets and invariants.

A multiset is a table (keys..., ch, n). Everything is grouped sums and full joins on small, pre-aggregated keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds

# Reasons that count as part of what a document began with, and the budget group of each reason.
FOLDED_INTO_START = ["OverdrawDedup", "OcrLayerDuplicate", "SoftHyphen", "LigatureExpand"]
BUDGET_GROUPS = {"RunningHeader": "furniture", "RunningFooter": "furniture", "PageNumber": "furniture", "Dehyphenate": "dehyphenate", "Ocr": None, "UserOverride": None}


def characters(text: Column) -> Column:
    """The array of a text's characters that are not white space."""
    return F.filter(F.split(F.regexp_replace(text, r"\s", ""), ""), lambda c: c != "")


def histogram(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, ch, n): the multiset of non-space characters of all texts of a key. Order and chunking don't matter."""
    return rows.select(*keys, F.explode(characters(F.col(text))).alias("ch")).groupBy(*keys, "ch").agg(F.count("*").alias("n"))


def union(keys: list[str], *parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "ch").agg(F.sum("n").alias("n"))


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What ``a`` has more of than ``b``."""
    on = [*keys, "ch"]
    left = F.col("n") - F.coalesce("m", F.lit(0))
    return a.join(b.withColumnRenamed("n", "m"), on, "left").select(*on, left.alias("n")).where("n > 0")


def total(a: DataFrame, keys: list[str]) -> DataFrame:
    return a.groupBy(*keys).agg(F.sum("n").alias("total"))


def changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ch, lost, appeared) of characters whose counts differ; one full join of pre-aggregated counts."""
    on = [*keys, "ch"]
    both = before.withColumnRenamed("n", "b").join(after.withColumnRenamed("n", "a"), on, "full").select(*on, F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("a", F.lit(0)).alias("a"))
    return both.where("a <> b").select(*on, F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("lost"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("appeared"))


def reason_totals(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason, removed, added, net) of entries (keys, reason, added boolean, chars); net removal is never negative."""
    removed = F.sum(F.when(F.col("added"), 0).otherwise(F.col("chars")))
    added = F.sum(F.when(F.col("added"), F.col("chars")).otherwise(0))
    sums = entries.groupBy(*keys, "reason").agg(removed.alias("removed"), added.alias("added"))
    return sums.withColumn("net", F.greatest(F.col("removed") - F.col("added"), F.lit(0)))


def replay(entries: DataFrame, stage: str = "stage") -> DataFrame:
    """(stage, reason, net, cumulative): net removals of each stage, and up to it in the stages' order, by reason.

    A window over (stage, reason) totals: rows by the number of stages, not of entries.
    """
    totals = reason_totals(entries, [stage])
    return totals.select(stage, "reason", "net", F.expr(f"sum(net) over (partition by reason order by {stage})").alias("cumulative"))


def budget_check(entries: DataFrame, start: Column, budgets: dict[str, float], t: Thresholds = DEFAULT) -> DataFrame:
    """(budget_group, net, share, budget, headroom, ok) against the characters that there were at first; a row ``global`` for all groups."""
    group = F.create_map(*[F.lit(x) for r, g in budgets_of(budgets).items() for x in (r, g)])
    totals = reason_totals(entries, []).withColumn("budget_group", F.coalesce(F.try_element_at(group, F.col("reason")), F.lit("other")))
    groups = totals.groupBy("budget_group").agg(F.sum("net").alias("net"))
    groups = groups.union(totals.select(F.lit("global").alias("budget_group"), F.col("net")).groupBy("budget_group").agg(F.sum("net").alias("net")))
    limit = F.create_map(*[F.lit(x) for g, b in (budgets | {"global": t.global_non_ocr_removal}).items() for x in (g, b)])
    share = F.col("net") / start
    budget = F.try_element_at(limit, F.col("budget_group"))
    return groups.select("budget_group", "net", share.alias("share"), budget.alias("budget"), (budget - share).alias("headroom"), F.coalesce(share <= budget, F.lit(True)).alias("ok"))


def budgets_of(budgets: dict[str, float]) -> dict[str, str]:
    return {r: g for r, g in BUDGET_GROUPS.items() if g} | {g: g for g in budgets}


def missing_from(units: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, missing): texts of ``units`` that ``there`` has fewer of, after white space is collapsed; a multiset match by counts."""
    norm = F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")
    a = units.select(*keys, norm).groupBy(*keys, "text").agg(F.count("*").alias("n"))
    b = there.select(*keys, norm).groupBy(*keys, "text").agg(F.count("*").alias("m"))
    return a.join(b, [*keys, "text"], "left").select(*keys, "text", (F.col("n") - F.coalesce("m", F.lit(0))).alias("missing")).where("missing > 0")


def retention(out: Column, ocr: Column, start: Column) -> Column:
    return F.when(start == 0, 0.0).otherwise((out - ocr) / start)


def overlaps(a: str, b: str) -> Column:
    """Whether rectangles ``a`` and ``b`` (structs x0, y0, x1, y1) share an area."""
    return F.expr(f"{a}.x0 < {b}.x1 and {b}.x0 < {a}.x1 and {a}.y0 < {b}.y1 and {b}.y0 < {a}.y1")


def overlapping(rects: DataFrame, cell: float, keys: list[str]) -> DataFrame:
    """Pairs (keys, id_a, id_b) of rectangles of a key that overlap.

    A grid join: a rectangle enters every cell it covers, and a pair is reported from the one cell that
    holds the lower left corner of its intersection. Rectangles meet only where they are near, never by key alone.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    grid = rects.select("*", F.explode(F.sequence(at("rect.x0"), at("rect.x1"))).alias("gx")).select("*", F.explode(F.sequence(at("rect.y0"), at("rect.y1"))).alias("gy"))
    a = grid.select(*keys, "gx", "gy", F.col("id").alias("id_a"), F.col("rect").alias("a"))
    b = grid.select(*keys, "gx", "gy", F.col("id").alias("id_b"), F.col("rect").alias("b"))
    own = (F.floor(F.greatest("a.x0", "b.x0") / cell) == F.col("gx")) & (F.floor(F.greatest("a.y0", "b.y0") / cell) == F.col("gy"))
    return a.join(b, [*keys, "gx", "gy"]).where("id_a < id_b").where(overlaps("a", "b") & own).select(*keys, "id_a", "id_b")


def retention_warnings(rows: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, retention) of documents (doc, start, out, ocr) that had characters and kept too few of them."""
    kept = retention(F.col("out"), F.col("ocr"), F.col("start"))
    return rows.where("start > 0").select("doc", kept.alias("retention")).where(F.col("retention") < t.min_char_retention)


def book_characters(files: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, ch, n): the characters of the bodies of files in the reading order (``pos`` not null); markup, and what isn't read, doesn't count."""
    body = F.regexp_extract(F.col(html), r"(?s)<body[^>]*>(.*)</body>", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"(?s)<(script|style)[^>]*>.*?</\1>", ""), "<[^>]*>", " "), "&nbsp;", " ")
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(ch))
    return histogram(files.where("pos is not null").select(*keys, bare.alias("text")), keys)


def check_stages(stages: DataFrame, entries: DataFrame, totals: DataFrame, budgets: dict[str, float], t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, stage, violation): the first rule that a stage breaks.

    ``stages``: doc, stage, conserving, declared array of reasons, before, after (characters). ``entries``: doc, stage, reason, added, chars, text. ``totals``: doc, start. In order: entries of a stage that may have none; a reason that
    isn't declared; a dehyphenation that takes out anything but one hyphen; characters that don't add up; a group's cumulative removal over its budget, then all of them.
    """
    per = entries.groupBy("doc", "stage").agg(F.count("*").alias("n"), F.collect_set("reason").alias("reasons"), F.sum(F.when(F.col("added"), F.col("chars")).otherwise(-F.col("chars"))).alias("change"),
                                              F.count_if((F.col("reason") == "Dehyphenate") & ~(~F.col("added") & F.col("text").isin("-", "‐"))).alias("odd"))
    group = F.create_map(*[F.lit(x) for r, g in budgets_of(budgets).items() for x in (r, g)])
    net = entries.groupBy("doc", "stage", "reason").agg(F.greatest(F.sum(F.when(F.col("added"), -F.col("chars")).otherwise(F.col("chars"))), F.lit(0)).alias("net"))
    net = net.where(~F.col("reason").isin([r for r, g in BUDGET_GROUPS.items() if g is None])).withColumn("budget_group", F.coalesce(F.try_element_at(group, F.col("reason")), F.lit("other")))
    both = net.groupBy("doc", "stage", "budget_group").agg(F.sum("net").alias("net")).union(net.groupBy("doc", "stage", F.lit("global")).agg(F.sum("net")))
    limit = F.create_map(*[F.lit(x) for g, b in (budgets | {"global": t.global_non_ocr_removal}).items() for x in (g, b)])
    run = both.withColumn("so_far", F.expr("sum(net) over (partition by doc, budget_group order by stage)")).join(totals, "doc")
    over = run.where(F.col("so_far") > F.try_element_at(limit, F.col("budget_group")) * F.col("start")).groupBy("doc", "stage").agg(F.min(F.struct((F.col("budget_group") == "global").alias("last"), "budget_group"))["budget_group"].alias("over"))
    s = stages.join(per, ["doc", "stage"], "left").join(over, ["doc", "stage"], "left")
    n = F.coalesce("n", F.lit(0))
    violation = (
        F.when(F.col("conserving") & (n > 0), "I-3")
        .when(F.size(F.array_except(F.coalesce("reasons", F.array().cast("array<string>")), F.col("declared"))) > 0, "I-2")
        .when(F.coalesce("odd", F.lit(0)) > 0, "I-5")
        .when(F.col("before") + F.coalesce("change", F.lit(0)) != F.col("after"), "I-1")
        .when(F.col("over").isNotNull(), F.concat(F.lit("I-4 "), F.col("over")))
    )
    return s.select("doc", "stage", violation.alias("violation")).where("violation is not null")
