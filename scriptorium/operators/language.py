"""Languages of documents and blocks by letter trigrams, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds

#: A language's profile holds so many of its trigrams, the most frequent.
PROFILE = 300


def words_of_letters(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), " "), lambda w: w != "")


def cut(words: DataFrame, *kept: str) -> DataFrame:
    """(kept, gram): overlapping trigrams of each word (word), with a blank before and after."""
    padded = words.select(*kept, F.concat(F.lit(" "), "word", F.lit(" ")).alias("padded"))
    return padded.select(*kept, "padded", F.explode(F.sequence(F.lit(1), F.length("padded") - 2)).alias("at")).select(*kept, F.expr("substring(padded, at, 3)").alias("gram"))


def counted(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gram, n): trigrams of a text's words in lower case. Words are counted before they are cut: meant for few keys of many texts."""
    n = texts.select(*keys, F.explode(words_of_letters(F.col("text"))).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    return cut(n, *keys, "n").groupBy(*keys, "gram").agg(F.sum("n").alias("n"))


def profiles(texts: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, weight) of labelled texts (lang, text): the share that each of a language's most frequent trigrams (then the first by name) has among them."""
    n = counted(texts.where("lang is not null and text is not null"), ["lang"])
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= size)
    return top.select("lang", "gram", (F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("weight"))


def scores(texts: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """(keys, lang, score): the mean weight of a text's trigrams in each profile that has any of them. Profiles are PROFILE rows a language.

    Trigrams meet the profiles where their text is read: a text's number of trigrams and its sum for each language are all that is shuffled.
    """
    words = words_of_letters(F.col("text"))
    of = texts.select(*keys, F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("of"))
    grams = cut(texts.select(*keys, F.explode(words).alias("word")), *keys)
    met = grams.join(F.broadcast(known), "gram").groupBy(*keys, "lang").agg(F.sum("weight").alias("sum"))
    return met.join(of, keys).select(*keys, "lang", (F.col("sum") / F.col("of")).alias("score"))


def detect(texts: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """(keys, lang, confidence): the best language (the first by name of several), and how far it is ahead of the next as a share of its score. Texts without a known trigram have no row."""
    s = scores(texts, keys, known)
    best = s.groupBy(*keys).agg(F.min(F.struct((-F.round("score", 12)).alias("less"), "lang")).alias("x"), F.sort_array(F.collect_list(F.round("score", 12)), False).alias("all"))
    second = F.coalesce(F.try_element_at("all", F.lit(2)), F.lit(0.0))
    return best.select(*keys, F.col("x.lang").alias("lang"), (1 - second / F.element_at("all", 1)).alias("confidence"))


def detect_documents(docs: DataFrame, known: DataFrame, fallback: str = "en") -> DataFrame:
    """(doc, lang, confidence, fell_back) of documents (doc, text): an unreliable language is a language; without any the fallback, at confidence 0."""
    found = detect(docs, ["doc"], known)
    both = docs.select("doc").distinct().join(found, "doc", "left")
    return both.select("doc", F.coalesce("lang", F.lit(fallback)).alias("lang"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("lang").isNull().alias("fell_back"))


def detect_blocks(blocks: DataFrame, documents: DataFrame, known: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, block, tag, share) of blocks (doc, block, text) in documents (doc, lang): a tag where a block has words enough, a confident language, and another one than its document; where too many of a
    document's blocks would be tagged, none is."""
    words = blocks.where(F.regexp_count("text", F.lit(r"\S+")) >= t.lang_block_min_words)
    found = detect(words, ["doc", "block"], known).where(F.col("confidence") >= t.lang_block_min_confidence)
    own = documents.select("doc", F.substring_index("lang", "-", 1).alias("main"))
    other = found.join(own, "doc").where("lang <> main").select("doc", "block", F.col("lang").alias("tag"))
    both = blocks.select("doc", "block").join(other, ["doc", "block"], "left")
    share = both.groupBy("doc").agg(F.avg(F.col("tag").isNotNull().cast("double")).alias("share"))
    return both.join(share, "doc").select("doc", "block", F.when(F.col("share") <= t.lang_block_override_max_share, F.col("tag")).alias("tag"), "share")
