"""Assertions on documents, distances of trees and tables, admission to a corpus, trends."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stage that must have run before a kind of assertion means anything.
REQUIRED_STAGE = {
    "text_present": "text", "text_absent": "text", "text_order": "layout", "block_count": "paragraphs", "heading_level": "structure", "heading_tree": "structure",
    "image_count": "structure", "note_bijection": "structure", "page_label": "structure", "lang_tag": "text", "css_class": "structure",
}


def evaluate_assertions(assertions: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc, id, kind, outcome) Pass, Fail or Pending (the stage has not run, or the document is unknown) of all eleven kinds.

    ``assertions``: doc, id, kind, text, then, level, headings array<struct<level,text>>, of, min, max, equals, holds, page_index, label, lang, class.
    ``blocks``: doc, at, kind, level, text, lang, class, label, page. ``documents``: doc, stages array<string>, images, bijective.
    Blocks become one row for each document by a grouped aggregate; an assertion is then a predicate on that row.
    """
    row = F.struct("at", "kind", "level", "text", "lang", "class", "page", "label")
    whole = blocks.groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("b"))
    whole = documents.join(whole, "doc", "left").withColumn("b", F.coalesce("b", F.array().cast(whole.schema["b"].dataType)))
    whole = whole.withColumn("all_text", F.array_join(F.transform("b", lambda x: F.coalesce(x["text"], F.lit(""))), "\n"))
    a = assertions.join(whole.select("doc", "stages", "images", "bijective", "b", "all_text"), "doc", "left")
    has = F.contains("all_text", F.col("text"))
    first, second = F.expr("position(text, all_text)"), F.expr("position(then, all_text)")
    tree = F.transform(F.filter("b", lambda x: x["kind"] == "heading"), lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text")))
    count = F.size(F.filter("b", lambda x: x["kind"] == F.col("of")))
    any_block = lambda test: F.exists("b", test)
    holds = (
        F.when(F.col("kind") == "text_present", has)
        .when(F.col("kind") == "text_absent", ~has)
        .when(F.col("kind") == "text_order", (first > 0) & (second > first))
        .when(F.col("kind") == "heading_level", any_block(lambda x: (x["kind"] == "heading") & (x["text"] == F.col("text")) & (x["level"] == F.col("level"))))
        .when(F.col("kind") == "heading_tree", tree.cast("array<struct<level:int,text:string>>") == F.col("headings"))
        .when(F.col("kind") == "block_count", (count >= F.coalesce("min", F.lit(0))) & (count <= F.coalesce("max", F.lit(1 << 30))))
        .when(F.col("kind") == "image_count", F.col("images") == F.col("equals"))
        .when(F.col("kind") == "note_bijection", F.col("bijective") == F.col("holds"))
        .when(F.col("kind") == "page_label", any_block(lambda x: (x["page"] == F.col("page_index")) & (x["label"] == F.col("label"))))
        .when(F.col("kind") == "lang_tag", any_block(lambda x: F.contains(x["text"], F.col("text")) & (x["lang"] == F.col("lang"))))
        .when(F.col("kind") == "css_class", any_block(lambda x: F.contains(x["text"], F.col("text")) & (x["class"] == F.col("class"))))
    )
    stage = F.create_map(*[F.lit(v) for k, s in REQUIRED_STAGE.items() for v in (k, s)])
    ran = F.coalesce(F.array_contains("stages", F.try_element_at(stage, F.col("kind"))), F.lit(False))
    return a.select("doc", "id", "kind", F.when(~ran, "Pending").when(F.coalesce(holds, F.lit(False)), "Pass").otherwise("Fail").alias("outcome"))


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and replacements between two sequences, row by row in numpy."""
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[i] for i in a], int), np.array([codes[i] for i in b], int)
    row, at = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, c in enumerate(x, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(best - at) + at  # what an insertion from the left gives
    return int(row[-1])


#: Items of two sequences are numbered and compared as characters from this one on, which leaves room for 55 000 distinct items before code points that aren't characters.
FIRST_CODE, MOST_ITEMS = 0x100, 55_000


def sequence_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions and replacements between two arrays of strings, in the JVM: each distinct item is a character of two short texts. More than MOST_ITEMS distinct items are an error."""
    items = F.array_distinct(F.concat(a, b))
    code = lambda x: F.lpad(F.hex(F.array_position(items, x) + FIRST_CODE), 4, "0")
    text = lambda c: F.decode(F.unhex(F.array_join(F.transform(c, code), "")), "UTF-16BE")
    return F.when(F.size(items) > MOST_ITEMS, F.raise_error(F.lit("too many distinct items")).cast("int")).otherwise(F.levenshtein(text(a), text(b)))


def sequence_score(truth: Column, said: Column) -> Column:
    """1 less the distance of two arrays of strings over the longer; both empty: 1."""
    longest = F.greatest(F.size(truth), F.size(said))
    return F.when(longest == 0, 1.0).otherwise(1 - sequence_distance(truth, said) / longest)


def in_order(df: DataFrame, keys: list[str], order: list[str], item: Column, name: str) -> DataFrame:
    """(keys, name): each key's items as an array, in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, item.cast("string").alias("item_"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["item_"]).alias(name))


def _both(truth: DataFrame, said: DataFrame, keys: list[str], order: list[str], item: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    both = in_order(truth, keys, order, item, "t").join(in_order(said, keys, order, item, "s"), keys, "full")
    return both.withColumns({"t": F.coalesce("t", none), "s": F.coalesce("s", none)})


def block_order_score(truth: DataFrame, said: DataFrame) -> DataFrame:
    """(doc, score) of texts in order (doc, at, text)."""
    both = _both(truth, said, ["doc"], ["at"], F.col("text"))
    return both.select("doc", sequence_score(F.col("t"), F.col("s")).alias("score"))


def reading_order(truth: DataFrame, said: DataFrame) -> DataFrame:
    """(doc, similarity, tau, common) of blocks in order (doc, at, block; a block once on each side): edit similarity of the sequences, and tau-a over the blocks that both have."""
    both = _both(truth, said, ["doc"], ["at"], F.col("block"))
    places = F.filter(F.transform("s", lambda x: F.array_position("t", x)), lambda p: p > 0)
    n = F.size("places")
    both = both.select("doc", sequence_score(F.col("t"), F.col("s")).alias("similarity"), places.alias("places"))
    return both.select("doc", "similarity", F.when(n < 2, 1.0).otherwise(_concordance("places") / (n * (n - 1) / 2)).alias("tau"), n.cast("bigint").alias("common"))


def _concordance(places: str) -> Column:
    """Pairs in order less pairs out of order, of an array of distinct numbers."""
    later = lambda i: F.slice(places, i + 2, F.size(places))
    return F.aggregate(F.transform(places, lambda p, i: F.aggregate(later(i), F.lit(0).cast("bigint"), lambda s, q: s + F.signum((q - p).cast("double")).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s + x)


def outline_distance(truth: DataFrame, said: DataFrame) -> DataFrame:
    """(doc, distance) of headings (doc, at, level, text): how many have to be put in, left out or changed. An outline is its sequence of levelled headings, so that is a distance of sequences."""
    both = _both(truth, said, ["doc"], ["at"], F.concat_ws("|", "level", "text"))
    return both.select("doc", sequence_distance(F.col("t"), F.col("s")).alias("distance"))


def table_similarity(truth: DataFrame, said: DataFrame) -> DataFrame:
    """(table, teds, teds_s) of cells (table, row, column, text): a table is its cells in order, with their text or (teds_s) without it."""
    full = _both(truth, said, ["table"], ["row", "column"], F.concat_ws("|", "row", "column", "text"))
    bare = _both(truth, said, ["table"], ["row", "column"], F.concat_ws("|", "row", "column"))
    return full.select("table", sequence_score(F.col("t"), F.col("s")).alias("teds")).join(bare.select("table", sequence_score(F.col("t"), F.col("s")).alias("teds_s")), "table")


def image_scores(truth: DataFrame, said: DataFrame) -> DataFrame:
    """(doc, precision, recall, f1, caption_accuracy, checked) of images (doc, image, caption): found ones as a multiset, captions of those that were found; 1 where none was."""
    from scriptorium.operators.metrics import prf

    counts = prf(truth, said, ["doc"], "image").select("doc", "precision", "recall", "f1")
    both = truth.join(said.groupBy("doc", "image").agg(F.last("caption").alias("said")), ["doc", "image"])
    right = both.groupBy("doc").agg(F.count("*").alias("checked"), F.avg(F.col("caption").eqNullSafe(F.col("said")).cast("double")).alias("accuracy"))
    return counts.join(right, "doc", "left").select("doc", "precision", "recall", "f1", F.coalesce("accuracy", F.lit(1.0)).alias("caption_accuracy"), F.coalesce("checked", F.lit(0)).cast("bigint").alias("checked"))


def reader_error_rates(pages: DataFrame, ours: str = "ours") -> DataFrame:
    """(stratum, n, cer, gap) of pages (stratum, truth, said): mean character error rate, and how far it is from that of our own stratum; null without one."""
    from scriptorium.functions.text import cer

    by = pages.groupBy("stratum").agg(F.count("*").alias("n"), F.avg(cer(F.col("truth"), F.col("said"))).alias("cer"))
    own = by.where(F.col("stratum") == ours).select(F.col("cer").alias("own"))  # one row at most
    return by.join(F.broadcast(own), how="left").select("stratum", "n", "cer", (F.col("cer") - F.col("own")).alias("gap"))


def false_repairs(rows: DataFrame) -> DataFrame:
    """(task, language, category, n, b, c, rate): of outcomes (task, language, category, first, second) how many only the second (b) or only the first (c) got right, and the share that was broken."""
    s = rows.groupBy("task", "language", "category").agg(F.count("*").alias("n"), F.count_if(F.col("second") & ~F.col("first")).alias("b"), F.count_if(F.col("first") & ~F.col("second")).alias("c"))
    return s.withColumn("rate", F.col("c") / F.col("n"))


def passing_languages(table: DataFrame, most: float = 0.01) -> DataFrame:
    """(task, language, pass): not worse over all categories together, and no category with too many broken."""
    from scriptorium.operators.metrics import non_inferior

    s = table.groupBy("task", "language").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.max("rate").alias("worst"))
    return s.select("task", "language", (non_inferior(F.col("n"), F.col("b"), F.col("c")) & (F.col("worst") <= most)).alias("pass"))


def gate_enabled(table: DataFrame, enabled: DataFrame, most: float = 0.01) -> DataFrame:
    """(task, language, category, failure) of enabled pairs (task, language): one without evidence fails, as does a category with too many broken."""
    both = enabled.join(table, ["task", "language"], "left")
    failure = F.when(F.col("n").isNull(), "no evaluation").when(F.col("rate") > most, "false repairs")
    return both.select("task", "language", "category", failure.alias("failure")).where("failure is not null")


def guard_files(used: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, problem) of files that a fit may not use: unknown ones, and those held out (``manifest``: file, holdout)."""
    both = used.select("file").distinct().join(manifest, "file", "left")
    return both.select("file", F.when(F.col("holdout").isNull(), "unknown").when(F.col("holdout"), "holdout").alias("problem")).where("problem is not null")


def fit_summary(observations: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row (observations, files, accuracy) over observations (file, correct) of files that may be fitted on."""
    ok = observations.join(manifest.where("not holdout").select("file"), "file", "left_semi")
    return ok.agg(F.count("*").alias("observations"), F.countDistinct("file").alias("files"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def truth_assertions(blocks: DataFrame) -> DataFrame:
    """(doc, kind, text, level, n): what has to hold of a converted book, from what its source says (doc, at, kind, level, text): each heading's level, each paragraph's text, the first two paragraphs' order, how many
    paragraphs there are."""
    none = F.lit(None)
    said = blocks.where(F.trim("text") != "")
    heads = said.where("kind = 'heading'").select("doc", F.lit("heading_level").alias("kind"), "text", "level", none.cast("bigint").alias("n"))
    paras = said.where("kind = 'paragraph'")
    texts = paras.select("doc", F.lit("text_present").alias("kind"), "text", none.cast("int").alias("level"), none.cast("bigint").alias("n"))
    first = paras.withColumn("k", F.expr("row_number() over (partition by doc order by at)")).where("k <= 2").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("x")).where("size(x) = 2 and x[0].text <> x[1].text")
    order = first.select("doc", F.lit("text_order").alias("kind"), F.concat(F.col("x")[0]["text"], F.lit("\n"), F.col("x")[1]["text"]).alias("text"), none.cast("int").alias("level"), none.cast("bigint").alias("n"))
    count = blocks.groupBy("doc").agg(F.count_if(F.col("kind") == "paragraph").alias("n")).select("doc", F.lit("block_count").alias("kind"), none.cast("string").alias("text"), none.cast("int").alias("level"), "n")
    return heads.union(texts).union(order).union(count)


def corpus_rows(manifest: DataFrame, results: DataFrame, scores: DataFrame) -> DataFrame:
    """(stratum, file, metric, value) of a run over a corpus (``manifest``: file, stratum): missing 1 where a file has no result, failed 1 where its result isn't ok, else its scores (file, metric, value)."""
    m = manifest.join(results.select("file", "ok"), "file", "left")
    bad = m.where(F.col("ok").isNull() | ~F.col("ok")).select("stratum", "file", F.when(F.col("ok").isNull(), "missing").otherwise("failed").alias("metric"), F.lit(1.0).alias("value"))
    return bad.unionByName(m.where("ok").join(scores, "file").select("stratum", "file", "metric", "value"))


def bench_gate(runs: DataFrame, seconds: float, bytes_: int) -> DataFrame:
    """(file, seconds_per_page, peak, ok) of runs (file, pages, seconds, peak) against budgets of a page's seconds and of memory."""
    per = F.col("seconds") / F.greatest(F.col("pages"), F.lit(1))
    return runs.select("file", per.alias("seconds_per_page"), "peak", ((per <= seconds) & (F.col("peak") <= bytes_)).alias("ok"))


def admit(candidates: DataFrame, known: DataFrame, licences: list[str], max_file: int, max_total: int, min_pages: int = 4) -> DataFrame:
    """(source, at, id, reason): each candidate's first failing rule, or ``admitted``, in order within a source; none after the source's budget is spent.

    ``candidates``: source, at, id, license, bytes, pages, encrypted. The running sum counts what is admitted before.
    """
    c = candidates.join(known.select("id").distinct().withColumn("known", F.lit(True)), "id", "left")
    c = c.withColumn("again", F.expr("row_number() over (partition by source, id order by at)") > 1)
    before = (
        F.when(F.col("known").isNotNull() | F.col("again"), "duplicate")
        .when(F.col("bytes") > max_file, "too-large")
        .when(~F.coalesce(F.col("license").isin(licences), F.lit(False)), "licence")
        .when(F.col("encrypted"), "unreadable")
        .when(F.col("pages") < min_pages, "too-short")
    )
    c = c.withColumn("reason", before)
    c = c.withColumn("spent", F.expr("coalesce(sum(if(reason is null, bytes, 0)) over (partition by source order by at rows between unbounded preceding and 1 preceding), 0)"))
    c = c.withColumn("over", F.col("spent") >= max_total)
    c = c.withColumn("nth", F.expr("sum(if(over and reason is distinct from 'duplicate', 1, 0)) over (partition by source order by at)"))
    said = F.when((F.col("reason") == "duplicate") & (F.col("nth") == 0), "duplicate").when(F.col("over"), "budget").otherwise(F.coalesce("reason", F.lit("admitted")))
    return c.where((F.col("nth") == 0) | ((F.col("nth") == 1) & F.col("over") & F.expr("reason is distinct from 'duplicate'"))).select("source", "at", "id", said.alias("reason"))


def rejections(outcomes: DataFrame) -> DataFrame:
    """(reason, n) most frequent first, then by name."""
    return outcomes.where("reason <> 'admitted'").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def merge_manifest(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by id; one that exists stays as it is."""
    return existing.unionByName(new.join(existing.select("id"), "id", "left_anti").dropDuplicates(["id"]).select(*existing.columns))


def record_run(history: DataFrame, run: DataFrame) -> DataFrame:
    """The history (commit, metric, value) with this commit's rows in place of any it had."""
    return history.join(run.select("commit").distinct(), "commit", "left_anti").unionByName(run)


def widening(history: DataFrame, order: str) -> DataFrame:
    """(metric, first, last): first and last gap that is known, in the order of a column."""
    known = history.where("gap is not null")
    return known.groupBy("metric").agg(F.min_by("gap", order).alias("first"), F.max_by("gap", order).alias("last"))


def outcomes(gold: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(task, lang, id, first, second) whether either answer is the label, without regard to case and white space; no answer is wrong."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    ok = lambda c: F.coalesce(key(F.col("label")) == key(F.col(c)), F.lit(False))
    both = gold.join(first.select("id", F.col("answer").alias("a")), "id", "left").join(second.select("id", F.col("answer").alias("b")), "id", "left")
    return both.select("task", "lang", "id", ok("a").alias("first"), ok("b").alias("second"))


def passes(rows: DataFrame, most: float = 0.01) -> DataFrame:
    """(task, n, broken, pass): no category may lose more than a share of items that were right before."""
    by = rows.groupBy("task", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("first") & ~F.col("second")).alias("broken"))
    return by.groupBy("task").agg(F.sum("n").alias("n"), F.sum("broken").alias("broken"), F.every(F.col("broken") / F.col("n") <= most).alias("pass"))


def license_of(url: Column) -> Column:
    """The licence that a licence's address names: Creative Commons with its version, CC0, or public domain by mark."""
    cc = r"(?i)creativecommons\.org/licenses/([a-z-]+)/(\d+\.\d+)"
    pd_kind = F.lower(F.regexp_extract(url, r"(?i)creativecommons\.org/publicdomain/(zero|mark)/\d+\.\d+", 1))
    kind = F.regexp_extract(url, cc, 1)
    return F.when(pd_kind == "zero", "CC0-1.0").when(pd_kind == "mark", "PD-old-work").when(kind != "", F.concat(F.lit("CC-"), F.upper(kind), F.lit("-"), F.regexp_extract(url, cc, 2)))
