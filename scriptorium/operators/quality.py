"""Corpus-quality statistics of documents, and their verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds
from scriptorium.functions.text import UNDECODABLE
from scriptorium.sources.readers import trimmed_lines, words_of

PARAGRAPH = r"\n[ \t\r]*\n\s*"


def duplicate_fraction(items: Column) -> Column:
    """Share of an array's items that repeat an earlier one; 0 for none."""
    return F.when(F.size(items) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(items)) / F.size(items))


def ngrams(words: Column, n: int) -> Column:
    """The overlapping n-grams of an array of words, joined by a blank: the array zipped with itself moved by one, n - 1 times."""
    grams = words
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(words, F.lit(k), F.greatest(F.size(words), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(grams, lambda g: g.isNotNull())


def top_ngram_share(docs: DataFrame, n: int, name: str) -> DataFrame:
    """doc_id and the largest share of a document's word characters that one repeated n-gram takes.

    The n-grams are pre-aggregated on the map side, so a document of one phrase costs one row a task.
    """
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    chars = F.aggregate("words", F.lit(0).cast("bigint"), lambda s, w: s + F.length(w))
    words = words.select("doc_id", chars.alias("chars"), ngrams(F.col("words"), n).alias("grams"))  # before the rows multiply
    grams = words.select("doc_id", "chars", F.explode("grams").alias("gram"))
    counts = grams.groupBy("doc_id", "chars", "gram").count().where("count > 1")
    share = F.length(F.replace("gram", F.lit(" "), F.lit(""))) * F.col("count") / F.col("chars")
    return counts.groupBy("doc_id").agg(F.max(share).alias(name))


def top_gram_in_row(words: Column, chars: Column, n: int) -> Column:
    """The same within a row: sort the n-grams, fold over runs of equal ones. No shuffle and no explosion."""
    start = F.struct(F.lit("").alias("gram"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("best"))

    def step(acc: Column, gram: Column) -> Column:
        run = F.when(acc["gram"] == gram, acc["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        size = F.length(F.replace(gram, F.lit(" "), F.lit(""))) * run
        return F.struct(gram.alias("gram"), run.alias("run"), F.when((run > 1) & (size > acc["best"]), size).otherwise(acc["best"]).cast("bigint").alias("best"))

    best = F.aggregate(F.array_sort(ngrams(words, n)), start, step, lambda acc: acc["best"])
    return F.when(chars > 0, best / chars).otherwise(0.0)


def quality_stats(docs: DataFrame, dict_hit_rate: Column | None = None) -> DataFrame:
    """One row per document, by whole-row functions only: nine statistics of its text. No shuffle at any size.

    An unknown dictionary hit rate is null, which is not the same as 0.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        text.alias("text"),
        trimmed_lines(text).alias("lines"),
        F.filter(F.transform(F.split(text, PARAGRAPH), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "").alias("paras"),
        words_of(text).alias("words"),
        (F.lit(None).cast("double") if dict_hit_rate is None else dict_hit_rate).alias("dict_hit_rate"),
    )
    base = base.withColumn("chars", F.aggregate("words", F.lit(0).cast("bigint"), lambda s, w: s + F.length(w)))
    words, n = F.col("words"), F.size("words")
    visible = F.regexp_replace("text", r"\s", "")
    return base.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        n.cast("bigint").alias("n_words"),
        duplicate_fraction(F.col("lines")).alias("dup_line_frac"),
        duplicate_fraction(F.col("paras")).alias("dup_para_frac"),
        *[top_gram_in_row(words, F.col("chars"), k).alias(f"top_{k}gram") for k in (2, 3, 4)],
        F.when(n == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: ~F.rlike(w, F.lit(r"\p{L}")))) / n).alias("non_alpha_word_ratio"),
        F.when(n == 0, 0.0).otherwise(F.col("chars") / n).alias("mean_word_len"),
        F.when(F.length(visible) == 0, 0.0).otherwise((F.length(visible) - F.length(F.regexp_replace(visible, UNDECODABLE, ""))) / F.length(visible)).alias("replacement_share"),
        "dict_hit_rate",
    )


def verdict(t: Thresholds = DEFAULT) -> Column:
    """Broken, Suspicious or Ok from the columns of ``quality_stats``; unknown statistics decide nothing."""
    c = F.col
    broken = (c("replacement_share") > t.broken_text_replacement_share) | F.coalesce(c("dict_hit_rate") < t.broken_text_dict_hit_min, F.lit(False))
    repeats = (c("dup_line_frac") > t.dup_line_frac) | (c("dup_para_frac") > t.dup_para_frac) | (c("top_2gram") > t.top_2gram_frac) | (c("top_3gram") > t.top_3gram_frac) | (c("top_4gram") > t.top_4gram_frac)
    odd = (c("non_alpha_word_ratio") > t.max_non_alpha_words_ratio) | ((c("mean_word_len") > 0) & ((c("mean_word_len") < t.mean_word_len_min) | (c("mean_word_len") > t.mean_word_len_max)))
    return F.when(broken, "Broken").when(repeats | odd, "Suspicious").otherwise("Ok")


def quality_profile(docs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return quality_stats(docs).withColumn("verdict", verdict(t))


def duplicate_blocks(blocks: DataFrame, k: int = 10, t: Thresholds = DEFAULT) -> DataFrame:
    """Of texts long enough to count that occur more than once: the k longest (then first by text), with their surplus copies."""
    seen = blocks.where(F.length("text") >= t.dup_block_min_chars).groupBy("text").agg(F.count("*").alias("n")).where("n > 1")
    return seen.select("text", F.length("text").cast("bigint").alias("chars"), (F.col("n") - 1).alias("surplus")).orderBy(F.desc("chars"), "text").limit(k)


def word_counts(docs: DataFrame) -> DataFrame:
    """Folded words of two letters or more over the corpus, by language."""
    words = docs.select("lang", F.explode(words_of(F.col("text"))).alias("w")).select("lang", F.regexp_replace(F.lower("w"), r"^[^\p{L}]+|[^\p{L}]+$", "").alias("word"))
    return words.where(F.rlike("word", F.lit(r"^\p{L}{2,}$"))).groupBy("lang", "word").agg(F.count("*").alias("n"))


def dict_hit_rate(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id and the share of a document's words in ``lexicon(lang, word)``; null where the language has no list or no word counts.

    Words are counted by document before the join, so the join carries each word of a document once.
    """
    words = docs.select("doc_id", "lang", F.explode(words_of(F.col("text"))).alias("w")).select("doc_id", "lang", F.regexp_replace(F.lower("w"), r"^[^\p{L}]+|[^\p{L}]+$", "").alias("word"))
    counts = words.where(F.rlike("word", F.lit(r"^\p{L}{2,}$"))).groupBy("doc_id", "lang", "word").agg(F.count("*").alias("n"))
    known = lexicon.select("lang", "word").distinct().withColumn("hit", F.lit(True))
    rate = F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")
    listed = lexicon.select(F.col("lang").alias("listed")).distinct()
    found = counts.join(known, ["lang", "word"], "left").groupBy("doc_id", "lang").agg(rate.alias("rate"))
    found = found.join(F.broadcast(listed), F.col("lang") == F.col("listed"), "left").select("doc_id", F.when(F.col("listed").isNotNull(), F.col("rate")).alias("dict_hit_rate"))
    return docs.select("doc_id").join(found, "doc_id", "left")


def significant_blocks(blocks: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Blocks (text, in_table, ...) that are long enough for a repetition to mean anything and aren't cells of a table; white space collapsed."""
    flat = blocks.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    return flat.where(~F.col("in_table") & (F.length("text") >= t.dup_block_min_chars))


def duplicate_stats(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, surplus, texts): copies beyond the first, and texts that have any."""
    n = blocks.groupBy(*keys, "text").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("surplus"), F.count_if(F.col("n") > 1).alias("texts"))
