"""Checks of finished documents, findings and repairs; page and document classes; escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds

# Severities in their order, worst first.
SEVERITIES = ["fatal", "error", "warning"]


def classify_page(visible: Column, broken: Column, dict_hit: Column, image_area: Column, hidden: Column, t: Thresholds = DEFAULT) -> Column:
    """OcrSandwich, ImageOnly, Blank, BrokenText, Text or Mixed, in that order of rules. ``broken`` counts undecodable characters; an unknown dictionary rate decides nothing."""
    covered = image_area >= t.image_area_ratio_min
    bad = (broken / F.greatest(visible, F.lit(1)) >= t.broken_text_replacement_share) | F.coalesce(dict_hit < t.broken_text_dict_hit_min, F.lit(False))
    return (
        F.when(covered & (hidden >= t.text_min_visible_chars), "OcrSandwich")
        .when(covered & (visible <= t.image_only_max_visible_chars), "ImageOnly")
        .when((visible == 0) & (image_area == 0), "Blank")
        .when((visible >= t.text_min_visible_chars) & bad, "BrokenText")
        .when((visible >= t.text_min_visible_chars) & ~covered, "Text")
        .when((visible > 0) | (image_area > 0), "Mixed")
        .otherwise("Blank")
    )


def classify_image(area_ratio: Column, width: Column, height: Column, t: Thresholds = DEFAULT) -> Column:
    aspect = F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1e-6))
    return F.when(area_ratio >= t.full_page_area_ratio, "background").when(aspect > t.strip_aspect_ratio, "strip").when(F.greatest(width, height) < t.ornament_max_side_pt, "ornament").otherwise("figure")


def effective_dpi(pixels: Column, width_pt: Column) -> Column:
    return F.when(width_pt <= 0, 0.0).otherwise(pixels / (width_pt / 72))


def classify_document(pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, pages, class): scanned by the share of page classes, then slides, then academic, else prose. ``pages``: doc, class, landscape, columns."""
    share = lambda c: F.avg(c.cast("double"))
    s = pages.groupBy("doc").agg(F.count("*").alias("pages"), share(F.col("class").isin("ImageOnly", "OcrSandwich", "BrokenText")).alias("scanned"), share(F.col("landscape")).alias("wide"), share(F.col("columns") >= 2).alias("multi"))
    kind = F.when(F.col("scanned") >= t.scanned_page_share, "scanned").when(F.col("wide") >= 0.5, "slides").when(F.col("multi") >= 0.5, "academic").otherwise("prose")
    return s.select("doc", "pages", kind.alias("class"))


def drop_ornaments(images: DataFrame, pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Images without those whose hash is on many pages of their document (doc, page, hash); images without a hash stay."""
    of = pages.select("doc", "page").distinct().groupBy("doc").agg(F.count("*").alias("of"))
    seen = images.where("hash is not null").groupBy("doc", "hash").agg(F.countDistinct("page").alias("on"))
    gone = seen.join(of, "doc").where((F.col("on") >= t.ornament_min_pages) & (F.col("on") / F.col("of") >= t.ornament_page_share))
    return images.join(gone.select("doc", "hash"), ["doc", "hash"], "left_anti")


def has_remote(html: Column) -> Column:
    return F.rlike(html, F.lit(r"(?i)(src|href)\s*=\s*[\"'](https?:)?//"))


def dangling(refs: DataFrame, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """References without a target."""
    return refs.where(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias(ref)).distinct(), ref, "left_anti")


def bijection(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """(target, refs, kind) findings of references (target) and notes (target): missing (no such note), repeated (several references) and unused (no reference)."""
    r = refs.groupBy("target").agg(F.count("*").alias("refs"))
    n = notes.select("target").distinct().withColumn("there", F.lit(True))
    both = r.join(n, "target", "full")
    kind = F.when(F.col("there").isNull(), "missing").when(F.col("refs").isNull(), "unused").when(F.col("refs") > 1, "repeated")
    return both.select("target", F.coalesce("refs", F.lit(0)).cast("bigint").alias("refs"), kind.alias("kind")).where("kind is not null")


def heading_sanity(headings: DataFrame, t: Thresholds = DEFAULT, order: str = "at") -> DataFrame:
    """(doc, h1, skips, backwards, ok) of headings (doc, at, level, page): number of level 1, levels skipped (a first deeper than 1 counts), pages that go back."""
    rows = headings.select("*", F.expr(f"lag(level, 1, 0) over (partition by doc order by {order})").alias("up"), F.expr(f"lag(page) over (partition by doc order by {order})").alias("was"))
    s = rows.groupBy("doc").agg(F.count_if(F.col("level") == 1).alias("h1"), F.count_if(F.col("level") > F.col("up") + 1).alias("skips"), F.count_if(F.col("page") < F.col("was")).alias("backwards"))
    return s.withColumn("ok", F.col("h1").between(t.h1_count_min, t.h1_count_max) & (F.col("skips") == 0) & (F.col("backwards") == 0))


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def plan_repairs(findings: DataFrame, remedies: dict[str, str | None]) -> DataFrame:
    """(location, id, severity, remedy): the worst finding of each location that has a remedy (then by id), one repair a location."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    known = F.create_map(*[F.lit(x) for k, v in remedies.items() if v for x in (k, v)])
    rows = findings.withColumns({"rank": rank, "remedy": F.try_element_at(known, F.col("id"))}).where("remedy is not null")
    best = rows.groupBy("location").agg(F.min(F.struct("rank", "id", "severity", "remedy")).alias("x"))
    return best.select("location", "x.id", "x.severity", "x.remedy")


def escalations(evidence: DataFrame, allowed: list[str], budget: int) -> DataFrame:
    """(doc, task, fired, granted) of evidence (doc, lang, task, demand, fired): a task that fires gets calls until a document's budget is spent, in the order of tasks."""
    ok = F.col("fired") & (F.lit("*" in allowed) | F.col("lang").isin(allowed))
    rows = evidence.withColumn("wants", F.when(ok, F.col("demand")).otherwise(0))
    before = F.expr("coalesce(sum(wants) over (partition by doc order by task rows between unbounded preceding and 1 preceding), 0)")
    return rows.withColumn("before", before).select("doc", "task", "fired", F.greatest(F.lit(0), F.least(F.col("wants"), F.lit(budget) - F.col("before"))).cast("bigint").alias("granted"))


def manifest_lint(entries: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(rule, id, detail) findings of manifest entries (id, license, source, holdout, bytes)."""
    twice = entries.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), F.col("id").cast("string").alias("id"), F.col("n").cast("string").alias("detail"))
    bare = entries.where("license is null or trim(license) = ''").select(F.lit("license_incomplete").alias("rule"), F.col("id").cast("string").alias("id"), F.lit("").alias("detail"))
    share = entries.agg(F.avg((F.col("source") == "ours").cast("double")).alias("s"), F.count_if(F.col("holdout")).alias("h"))
    ours = share.where(F.col("s") > t.ours_max_share).select(F.lit("ours_share_above_maximum").alias("rule"), F.lit("").alias("id"), F.round("s", 6).cast("string").alias("detail"))
    few = share.where(F.col("h") < t.holdout_min_files).select(F.lit("holdout_below_minimum").alias("rule"), F.lit("").alias("id"), F.col("h").cast("string").alias("detail"))
    return twice.union(bare).union(ours).union(few)


def tagged_share(entries: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """One row (n, share, off): the share of manifest entries that are tagged, and whether it is farther from the target than tolerated; null without entries."""
    s = entries.agg(F.count("*").alias("n"), F.avg(F.col("tagged").cast("double")).alias("share"))
    return s.withColumn("off", F.abs(F.col("share") - t.tagged_share_target) > t.tagged_share_tolerance)
