"""Words of an optical reader: lines, sizes, confidence, and the bands of a region that they may fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_words(words: DataFrame, snap: float = 0.25) -> DataFrame:
    """(page, block_num, par_num, line_num, text, x0, y0, x1, y1, size): one run for each line of words in their order.

    A line's size is its upper median word height; sizes near the page's median line are set to it.
    """
    keys = ["page", "block_num", "par_num", "line_num"]
    heights = F.array_sort(F.collect_list(F.col("y1") - F.col("y0")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "text"))), lambda x: x["text"]), " ")
    lines = words.groupBy(*keys).agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), heights.alias("h"))
    lines = lines.withColumn("size", F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int"))).drop("h")
    median = F.expr("percentile(size, 0.5) over (partition by page)")
    near = F.abs(F.col("size") - median) <= snap * median
    return lines.withColumn("size", F.when(near, median).otherwise(F.col("size")))


def region_confidence(words: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """(keys, words, mean, low): how many words, their mean confidence, and how many are under the floor."""
    return words.groupBy(*keys).agg(F.count("*").alias("words"), F.avg("confidence").alias("mean"), F.count_if(F.col("confidence") < floor).alias("low"))


def clean_bands(regions: DataFrame, obstacles: DataFrame) -> DataFrame:
    """(region, y0, y1): the bands of each region (region, y0, y1) that no obstacle (region, y0, y1) touches.

    Obstacles are merged by a running maximum of their ends; bands are what lies between the merged ones.
    """
    w = Window.partitionBy("region").orderBy("o0", "o1")
    o = obstacles.select("region", F.col("y0").alias("o0"), F.col("y1").alias("o1")).join(regions, "region").where("o0 < y1 and o1 > y0")
    o = o.select("region", F.greatest("o0", "y0").alias("o0"), F.least("o1", "y1").alias("o1"), "y0", "y1")
    ends = o.union(regions.select("region", F.col("y1").alias("o0"), F.col("y1").alias("o1"), "y0", "y1"))
    reached = F.coalesce(F.max("o1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("y0"))
    return ends.withColumn("from_", reached).where("o0 > from_").select("region", F.col("from_").alias("y0"), F.col("o0").alias("y1"))


def split_by_bands(words: DataFrame, bands: DataFrame) -> DataFrame:
    """(region, id, y0): the first band that holds a word (region, id, y0, y1), null if none does. Bands of a region are few."""
    b = bands.select("region", F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    hit = words.join(b, (words["region"] == b["region"]) & (words["y0"] >= b["b0"]) & (words["y1"] <= b["b1"]), "left").drop(b["region"])
    return hit.groupBy("region", "id").agg(F.min("b0").alias("band"))


def second_language(blocks: DataFrame, main: Column, share: float = 0.20) -> DataFrame:
    """(doc, second): the most frequent other language, if it has a large enough share of blocks (doc, lang)."""
    counts = blocks.groupBy("doc", "lang").agg(F.count("*").alias("n"))
    counts = counts.withColumns({"share": F.col("n") / F.sum("n").over(Window.partitionBy("doc")), "main": main})
    other = counts.where((F.col("lang") != F.col("main")) & (F.col("share") >= share))
    return other.groupBy("doc").agg(F.max_by("lang", F.struct("n", "lang")).alias("second"))
