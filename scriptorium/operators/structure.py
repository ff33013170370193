"""Headings, contents, notes, captions, tables and the parts of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds


def cluster_styles(runs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, size, bold, italic, family, chars, pages, weight, share, is_body, is_candidate) of runs (doc, page, size, weight, italic, family, chars).

    The body is the style with most characters (then the larger size, the lighter one, the later family). A heading candidate is larger than it, or bold at its size, and rare.
    """
    size = (F.round(F.col("size") / t.size_quantum_pt) * t.size_quantum_pt).alias("size")
    g = runs.groupBy("doc", size, (F.col("weight") >= t.bold_weight_min).alias("bold"), "italic", "family").agg(F.sum("chars").alias("chars"), F.max("weight").alias("weight"), F.countDistinct("page").alias("pages"))
    g = g.withColumn("share", F.col("chars") / F.expr("sum(chars) over (partition by doc)"))
    # one best row for each document, found by an aggregate that is combined before the shuffle
    body = g.groupBy("doc").agg(F.max(F.struct("chars", "size", (~F.col("bold")).alias("light"), "family", "italic")).alias("b"))
    g = g.join(body, "doc")
    is_body = (F.col("size") == F.col("b.size")) & (F.col("bold") == ~F.col("b.light")) & (F.col("italic") == F.col("b.italic")) & (F.col("family") == F.col("b.family"))
    above = (F.col("size") > F.col("b.size")) | ((F.col("size") == F.col("b.size")) & F.col("bold") & F.col("b.light"))
    return g.select("doc", "size", "bold", "italic", "family", "chars", "pages", "weight", "share", is_body.alias("is_body"), (above & (F.col("share") < t.candidate_max_char_share)).alias("is_candidate"))


def size_sigma(runs: DataFrame) -> DataFrame:
    """(doc, mean, sigma): the character-weighted deviation of sizes, from three sums."""
    n, s, q = F.sum("chars"), F.sum(F.col("chars") * F.col("size")), F.sum(F.col("chars") * F.col("size") * F.col("size"))
    sums = runs.groupBy("doc").agg(n.alias("n"), s.alias("s"), q.alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select("doc", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("sigma"))


def remove_level_skips(headings: DataFrame, order: str) -> DataFrame:
    """Levels so that none is more than one deeper than the one before: level_i = min(level_i, level_(i-1) + 1), the first at most 1.

    The minimum over all earlier headings of their level plus the distance, so a running minimum of (level - position) does it.
    """
    numbered = headings.withColumn("pos_", F.expr(f"row_number() over (partition by doc order by {order})"))
    low = F.expr("min(level - pos_) over (partition by doc order by pos_)")
    return numbered.withColumn("fixed", F.least(low, F.lit(0)) + F.col("pos_")).withColumn("fixed", F.least("level", "fixed").cast("int")).drop("pos_")


def cluster_ranks(styles: DataFrame, tolerance: float = 0.10, most: int = 3) -> DataFrame:
    """(doc, size, bold, tier) of candidate styles: a new tier where the size drops by more than the tolerance of the tier's top, or from bold to regular at one size."""
    rows = F.reverse(F.array_sort(F.collect_set(F.struct("size", "bold"))))
    start = F.struct(F.lit(0.0).alias("top"), F.lit(False).alias("bold"), F.lit(0).alias("tier"), F.array().cast("array<struct<size:double,bold:boolean,tier:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["tier"] == 0) | (x["size"] < acc["top"] * (1 - tolerance)) | ((x["size"] == acc["top"]) & acc["bold"] & ~x["bold"])
        tier = F.when(new, acc["tier"] + 1).otherwise(acc["tier"])
        row = F.struct(x["size"].cast("double").alias("size"), x["bold"].alias("bold"), F.least(tier, F.lit(most)).alias("tier"))
        return F.struct(F.when(new, x["size"]).otherwise(acc["top"]).cast("double").alias("top"), F.when(new, x["bold"]).otherwise(acc["bold"]).alias("bold"), tier.alias("tier"), F.concat(acc["out"], F.array(row)).alias("out"))

    return styles.groupBy("doc").agg(rows.alias("rows")).select("doc", F.inline(F.aggregate("rows", start, step, lambda acc: acc["out"])))


def edge_distance(a: str, b: str) -> Column:
    return F.expr(f"hypot(greatest(0, greatest({a}.x0, {b}.x0) - least({a}.x1, {b}.x1)), greatest(0, greatest({a}.y0, {b}.y0) - least({a}.y1, {b}.y1)))")


def associate_captions(images: DataFrame, captions: DataFrame, max_gap: float, t: Thresholds = DEFAULT) -> DataFrame:
    """(page, caption, image, distance): each caption's nearest image on its page, within a gap and clearly nearer than the next; one caption an image, the first wins.

    Distances grow by half their size unless the caption is below. An equi join on (page, cell) with each box entered in the cells it could
    be near, so that a page with very many of both makes pairs of neighbours only.
    """
    cell = F.lit(4 * max_gap)
    reach = lambda r, g: (F.explode(F.sequence(F.floor((F.col(f"{r}.x0") - g) / cell), F.floor((F.col(f"{r}.x1") + g) / cell))).alias("gx"))
    a = images.select("page", F.col("id").alias("image"), F.col("rect").alias("i"), reach("rect", max_gap))
    b = captions.select("page", F.col("id").alias("caption"), F.col("rect").alias("c"), reach("rect", 0.0))
    gap = edge_distance("i", "c")
    near = a.join(b, ["page", "gx"]).withColumn("gap", gap).where(F.col("gap") <= max_gap).dropDuplicates(["page", "image", "caption"])
    scored = near.withColumn("distance", F.col("gap") * F.when(F.col("c.y0") >= F.col("i.y1"), 1.0).otherwise(1.5))
    best = scored.groupBy("page", "caption").agg(F.min(F.struct("distance", "image")).alias("best"))
    second = scored.join(best.select("page", "caption", "best"), ["page", "caption"]).where("image <> best.image").groupBy("page", "caption").agg(F.min("distance").alias("second"))
    chosen = best.join(second, ["page", "caption"], "left").where(F.col("second").isNull() | (F.col("second") >= t.caption_distance_ratio_min * F.col("best.distance")))
    first = chosen.groupBy("page", F.col("best.image").alias("image")).agg(F.min(F.struct("caption", F.col("best.distance").alias("distance"))).alias("x"))
    return first.select("page", F.col("x.caption").alias("caption"), "image", F.col("x.distance").alias("distance"))


def link_notes(markers: DataFrame, notes: DataFrame) -> DataFrame:
    """(page, marker, note_id, marker_id, pass) of note bodies and markers (page, marker, id), each used once, in order of identifiers.

    First by page and marker, then numeric markers anywhere, at last what is left of a page, whatever it says. The k-th marker of a key meets the k-th note, so that no pairs are made.
    """

    def keyed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        rows = df.withColumn("k", F.expr(f"row_number() over (partition by {', '.join(keys)} order by page, id)"))
        return rows.select(*keys, "k", F.col("id").alias(name), F.col("page").alias(f"{name}_page"), F.col("marker").alias(f"{name}_marker"))

    def match(m: DataFrame, n: DataFrame, keys: list[str], number: int) -> DataFrame:
        both = keyed(m, keys, "marker_id").join(keyed(n, keys, "note_id"), [*keys, "k"])
        return both.select(F.col("note_id_page").alias("page"), F.col("note_id_marker").alias("marker"), "note_id", "marker_id", F.lit(number).alias("pass"))

    numeric = F.rlike("marker", F.lit("^[0-9]+$"))
    out = None
    for number, keys, which in ((1, ["page", "marker"], F.lit(True)), (2, ["marker"], numeric), (3, ["page"], F.lit(True))):
        m, n = markers, notes
        if out is not None:
            m, n = m.join(out.select(F.col("marker_id").alias("id")), "id", "left_anti"), n.join(out.select(F.col("note_id").alias("id")), "id", "left_anti")
        found = match(m.where(which), n.where(which), keys, number)
        out = found if out is None else out.unionByName(found)
    return out


def zone_of(label: Column, reset: Column, page: Column, back: Column) -> Column:
    """front before the page where arabic numbers start anew, back from a page on, else body."""
    return F.when(page < F.coalesce(reset, F.lit(0)), "front").when(page >= back, "back").otherwise("body")


def arabic_reset(labels: DataFrame) -> DataFrame:
    """(doc, page): the first page labelled 1 after a roman label; null if none."""
    roman = F.rlike("label", F.lit("^(?i)[ivxlcdm]+$"))
    rows = labels.withColumn("seen", F.max(roman.cast("int")).over(_before()))
    return rows.groupBy("doc").agg(F.min(F.when((F.col("label") == "1") & (F.col("seen") == 1), F.col("page"))).alias("page"))


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)


def snapped(values: DataFrame, snap: float = 3.0) -> DataFrame:
    """(key, values): sorted values without those within ``snap`` of the one kept before; a fold over a key's distinct values."""
    rows = F.array_sort(F.collect_set("value"))
    kept = F.aggregate(
        rows,
        F.array().cast("array<double>"),
        lambda acc, x: F.when(F.coalesce(x - F.try_element_at(acc, F.lit(-1)) <= snap, F.lit(False)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return values.groupBy("key").agg(kept.alias("values"))


def pack(pieces: DataFrame, most: int | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, file, pieces, bytes) of pieces (doc, at, bytes) put in order into files of at most so many bytes; a larger piece has a file of its own.

    A fold over a document's piece sizes, one number each; what grows in it is a row for each file.
    """
    most = most or t.split_bytes
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("at", "bytes"))), lambda x: x["bytes"].cast("bigint"))
    row = lambda n, b: F.struct(n.alias("pieces"), b.alias("bytes"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("n"), zero.alias("used"), F.array().cast("array<struct<pieces:bigint,bytes:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] > 0) & (acc["used"] + x > most)
        out = F.when(full, F.concat(acc["out"], F.array(row(acc["n"], acc["used"])))).otherwise(acc["out"])
        return F.struct(F.when(full, zero + 1).otherwise(acc["n"] + 1).alias("n"), F.when(full, x).otherwise(acc["used"] + x).alias("used"), out.alias("out"))

    files = F.aggregate("sizes", start, step, lambda acc: F.concat(acc["out"], F.array(row(acc["n"], acc["used"]))))
    return pieces.groupBy("doc").agg(sizes.alias("sizes")).select("doc", F.posexplode(files).alias("file", "x")).select("doc", "file", "x.pieces", "x.bytes")
