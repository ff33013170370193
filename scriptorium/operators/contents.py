"""Contents pages, lists, quotations and titles of a book, from lines and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import fold_key, is_boilerplate, list_marker, split_folio, strip_numbering

# The first words of parts of a book, and words before an author's name.
FRONT_WORDS = {"preface": "preface", "foreword": "foreword", "introduction": "introduction", "vorwort": "preface", "einleitung": "introduction", "önsöz": "preface", "giriş": "introduction", "contents": "toc", "inhalt": "toc", "içindekiler": "toc", "dedication": "dedication", "prologue": "prologue"}
BACK_WORDS = {"appendix": "appendix", "anhang": "appendix", "ek": "appendix", "index": "index", "register": "index", "dizin": "index", "bibliography": "bibliography", "literatur": "bibliography", "kaynakça": "bibliography", "glossary": "glossary", "glossar": "glossary", "afterword": "afterword", "nachwort": "afterword", "notes": "notes", "epilogue": "epilogue"}
BY_WORDS = ["by", "von", "yazan"]


def contents_entries(lines: DataFrame) -> DataFrame:
    """(doc, page, at, title, value, fill) of lines (doc, page, at, line) that end in a folio set apart by a leader or white space."""
    e = lines.withColumn("e", split_folio(F.col("line"))).where("e.folio is not null and e.arabic is not null")
    return e.select("doc", "page", "at", "e.title", "e.value", "e.fill")


def contents_pages(lines: DataFrame, min_entries: int = 3, row_share: float = 0.4, rising_share: float = 0.8) -> DataFrame:
    """(doc, page, rows, entries, rising, is_contents): enough lines end in folios, a large enough share of them, and the folios rise."""
    per = lines.groupBy("doc", "page").agg(F.count("*").alias("rows"))
    e = contents_entries(lines).withColumn("was", F.lag("value").over(Window.partitionBy("doc", "page").orderBy("at")))
    got = e.groupBy("doc", "page").agg(F.count("*").alias("entries"), F.count("was").alias("pairs"), F.count_if(F.col("value") >= F.col("was")).alias("up"))
    rising = F.when(F.col("pairs") == 0, 1.0).otherwise(F.col("up") / F.col("pairs"))
    both = per.join(got, ["doc", "page"], "left").na.fill(0, ["entries", "pairs", "up"])
    return both.select("doc", "page", "rows", "entries", rising.alias("rising"), ((F.col("entries") >= min_entries) & (F.col("entries") / F.col("rows") >= row_share) & (rising >= rising_share)).alias("is_contents"))


def link_contents(entries: DataFrame, labels: DataFrame, headings: DataFrame, ned_max: float = 0.3) -> DataFrame:
    """(doc, at, heading, score): an entry's folio names a page (the first with that label); the best heading from one page before to two after by edit distance of titles.

    Headings meet entries by page, so a document's entries are not compared with all of its headings.
    """
    first = labels.groupBy("doc", F.col("label").alias("value")).agg(F.min("page").alias("target"))
    near = entries.join(first, ["doc", "value"]).select("doc", "at", "title", "target", F.explode(F.sequence(F.col("target") - 1, F.col("target") + 2)).alias("page"))
    h = headings.select("doc", "page", F.col("at").alias("heading"), F.col("text").alias("heading_text"))
    a, b = (F.lower(strip_numbering(F.col(c))) for c in ("title", "heading_text"))
    score = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    found = near.join(h, ["doc", "page"]).withColumn("score", score).where(F.col("score") <= ned_max)
    best = found.groupBy("doc", "at").agg(F.min(F.struct("score", F.abs(F.col("page") - F.col("target")).alias("far"), "heading")).alias("x"))
    return best.select("doc", "at", "x.heading", "x.score")


def detect_lists(lines: DataFrame, min_siblings: int = 2) -> DataFrame:
    """(doc, list, kind, first, items, start) of runs of lines (doc, at, line) that begin with markers of one kind; lines without a marker continue an item."""
    m = lines.withColumn("m", list_marker(F.col("line"))).where("m is not null").select("doc", "at", "m.kind", "m.ordinal")
    w = Window.partitionBy("doc").orderBy("at")
    far = F.coalesce((F.col("kind") != F.lag("kind").over(w)) | (F.col("at") - F.lag("at").over(w) > 10), F.lit(True))
    runs = m.withColumn("run", F.sum(far.cast("int")).over(w))
    out = runs.groupBy("doc", F.col("run").alias("list"), "kind").agg(F.min("at").alias("first"), F.count("*").alias("items"), F.min_by("ordinal", "at").alias("start"))
    return out.where(F.col("items") >= min_siblings)


def classify_indented(blocks: DataFrame) -> DataFrame:
    """(doc, at, kind) of indented blocks (doc, at, monospace, lines array<double> fills): pre, verse, quote or ambiguous, by the share of short lines but the last."""
    body = F.slice("lines", F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0)))
    ratio = F.when(F.size(body) == 0, 0.0).otherwise(F.size(F.filter(body, lambda x: x < 0.85)) / F.size(body))
    kind = F.when(F.col("monospace"), "pre").when((ratio > 0.75) & (F.size("lines") >= 3), "verse").when(ratio < 0.25, "quote").otherwise("ambiguous")
    return blocks.select("doc", "at", ratio.alias("short"), kind.alias("kind"))


def part_kind(title: Column, words: dict[str, str]) -> Column:
    """What the first word of a title says a part is; null if nothing."""
    first = F.regexp_replace(F.substring_index(F.trim(fold_key(title)), " ", 1), r"[^\p{L}]", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for p in words.items() for x in p]), first)


def title_and_author(blocks: DataFrame, pages: int = 3) -> DataFrame:
    """(doc, title, author) from the front blocks (doc, page, at, size, text): the largest type, the first on a tie; a line that begins with by, von or yazan."""
    front = blocks.where((F.col("page") < pages) & (F.trim("text") != ""))
    big = front.where(~is_boilerplate(F.col("text"))).groupBy("doc").agg(F.max_by(F.trim("text"), F.struct("size", (-F.col("at")).alias("o"))).alias("title"))
    by = front.where(fold_key(F.substring_index(F.trim("text"), " ", 1)).isin(BY_WORDS) & F.rlike("text", F.lit(r"\S\s+\S")))
    named = by.groupBy("doc").agg(F.min_by(F.trim(F.regexp_replace(F.trim("text"), r"^\S+\s+", "")), "at").alias("author"))
    return front.select("doc").distinct().join(big, "doc", "left").join(named, "doc", "left")
