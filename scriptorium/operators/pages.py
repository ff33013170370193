"""Pages before their text is read: geometry, images and their hashes, limits, what an optical reader has to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds
from scriptorium.operators.ledger import overlaps

# The reader's language data by primary tag, what is taken when a tag has none, and marks that a note's reference may be.
READER_LANGUAGES = {"de": "deu", "tr": "tur", "en": "eng"}
READER_FALLBACK = "eng"
INVISIBLE_MODE = 3
READABLE_IMAGES = ["figure", "background", "unknown"]


def to_page(x: Column, y: Column, crop: Column, rotate: Column) -> Column:
    """struct(x, y): a point of a file's space (y up) on the page as it is shown (from the crop box's top left, y down) after a clockwise turn by ``rotate`` degrees."""
    right, up = x - crop["llx"], y - crop["lly"]
    width, height = crop["urx"] - crop["llx"], crop["ury"] - crop["lly"]
    down = height - up
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when(rotate == 90, at(up, right)).when(rotate == 180, at(width - right, up)).when(rotate == 270, at(down, width - right)).otherwise(at(right, down))


def rect_to_page(rect: Column, crop: Column, rotate: Column) -> Column:
    """struct(x0, y0, x1, y1) of a rectangle (llx, lly, urx, ury): both corners are turned, then put in order."""
    a, b = to_page(rect["llx"], rect["lly"], crop, rotate), to_page(rect["urx"], rect["ury"], crop, rotate)
    return F.struct(F.least(a["x"], b["x"]).alias("x0"), F.least(a["y"], b["y"]).alias("y0"), F.greatest(a["x"], b["x"]).alias("x1"), F.greatest(a["y"], b["y"]).alias("y1"))


def is_rule(rect: Column, t: Thresholds = DEFAULT) -> Column:
    """A path that is thin and long."""
    w, h = rect["x1"] - rect["x0"], rect["y1"] - rect["y0"]
    thin, long = F.least(w, h), F.greatest(w, h)
    return (thin <= t.rule_max_thickness_pt) & (long >= t.rule_min_aspect * F.greatest(thin, F.lit(1e-6)))


def refused(pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(page, limit) of pages (page, glyphs, width_px, height_px) that break a cap before any work is done on them: too many glyphs, or an image of too many declared pixels."""
    limits = F.array(F.when(F.col("glyphs") > t.max_page_glyphs, F.lit("glyphs")), F.when(F.col("width_px").cast("bigint") * F.col("height_px") > t.max_image_pixels, F.lit("pixels")))
    return pages.select("page", F.explode(F.filter(limits, lambda x: x.isNotNull())).alias("limit"))


def perceptual_hash(cells: Column) -> Column:
    """64 bits, as a signed bigint: of 64 mean brightnesses (row by row), the i-th lowest bit is set where the i-th cell is at or over their mean."""
    mean = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x) / F.size(cells)
    marks = F.transform(cells, lambda x, i: F.when(x >= mean, F.expr("1L")).otherwise(F.expr("0L")))
    # from the highest bit down: h -> 2 h + bit, without overflow as shifts drop what leaves
    return F.aggregate(F.reverse(marks), F.lit(0).cast("bigint"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b))


def cell_means(pixels: DataFrame) -> DataFrame:
    """(image, cells): 64 mean brightnesses over white of images given as pixels (image, x, y, width, height, r, g, b, a), each pixel in the cells that its place falls in.

    Images smaller than 8 pixels a side share a pixel between cells.
    """
    luma = (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")) * F.col("a") / 255 + 255 * (1 - F.col("a") / 255)

    def cells(at: str, size: str) -> Column:
        low = lambda c: F.floor(c * F.col(size) / 8)
        return F.filter(F.sequence(F.lit(0), F.lit(7)), lambda c: (F.col(at) >= low(c)) & (F.col(at) < F.greatest(low(c + 1), low(c) + 1)))

    spread = pixels.select("image", luma.alias("luma"), F.explode(cells("x", "width")).alias("cx"), cells("y", "height").alias("cys")).select("image", "luma", "cx", F.explode("cys").alias("cy"))
    means = spread.groupBy("image", "cx", "cy").agg(F.avg("luma").alias("mean"))
    return means.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("cy", "cx", "mean"))), lambda x: x["mean"]).alias("cells"))


def needs_hash(width: Column, height: Column, t: Thresholds = DEFAULT) -> Column:
    """Only images small enough for an ornament are ever compared."""
    return (width <= t.ornament_max_side_pt) & (height <= t.ornament_max_side_pt)


def preset(chosen: Column, kind: Column) -> Column:
    """``auto`` is what a document's class calls for; any other choice stays."""
    return F.when(chosen != "auto", chosen).when(kind == "scanned", "scanned").when(kind == "academic", "academic").otherwise("novel")


def scan_pages(pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, page) whose full-page image is the scan of its own text, of pages (doc, page, chars, reader_chars, background).

    Enough text stands over a full-page image, and either most of the book's text pages are so, or the text itself is a reader's.
    """
    text = F.col("chars") >= t.background_min_page_chars
    books = pages.groupBy("doc").agg(F.count_if(text).alias("text_pages"), F.count_if(text & F.col("background")).alias("backed"))
    scanned = (F.col("text_pages") > 0) & (F.col("backed") >= t.scan_book_min_share * F.col("text_pages"))
    return pages.where(text & F.col("background")).join(books, "doc").where(scanned | (F.col("reader_chars") >= t.background_min_page_chars)).select("doc", "page")


def drop_text_backgrounds(images: DataFrame, scans: DataFrame) -> DataFrame:
    """Images (doc, page, kind, ...) without the full-page ones of scan pages."""
    gone = scans.withColumn("kind", F.lit("background"))
    return images.join(gone, ["doc", "page", "kind"], "left_anti")


def inspect(pages: DataFrame) -> DataFrame:
    """(doc, pages, widest, chars, classes map) of pages (doc, page, width, chars, class): what a file is, before it is converted."""
    by = pages.groupBy("doc", "class").agg(F.count("*").alias("n"), F.max("width").alias("widest"), F.sum("chars").alias("chars"))
    return by.groupBy("doc").agg(F.sum("n").alias("pages"), F.max("widest").alias("widest"), F.sum("chars").alias("chars"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("classes"))


def class_histogram(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc", "class").agg(F.count("*").alias("pages"))


# --- what an optical reader has to read ---


def reader_language(tag: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in READER_LANGUAGES.items() for x in p]), F.substring_index(tag, "-", 1)), F.lit(READER_FALLBACK))


def select_languages(wanted: Column, installed: list[str]) -> Column:
    """struct(languages, missing): of an array of wanted languages those installed, each once; the fallback if none is."""
    have = F.array(*map(F.lit, installed))
    kept = F.array_distinct(F.filter(wanted, lambda x: F.array_contains(have, x)))
    return F.struct(F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(READER_FALLBACK))).alias("languages"), F.filter(wanted, lambda x: ~F.array_contains(have, x)).alias("missing"))


def stack_second(documents: DataFrame, blocks: DataFrame, installed: list[str], t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, languages): ``documents`` (doc, languages) with a second language that enough blocks (doc, tag) have; the most frequent other one, then the first by name."""
    counts = blocks.groupBy("doc", reader_language(F.col("tag")).alias("code")).agg(F.count("*").alias("n"))
    total = counts.groupBy("doc").agg(F.sum("n").alias("of"))
    other = counts.join(documents, "doc").where(~F.array_contains("languages", F.col("code")))
    best = other.groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("less"), "code")).alias("x")).join(total, "doc")
    best = best.where((-F.col("x.less") >= t.second_lang_block_share * F.col("of")) & F.col("x.code").isin(installed)).select("doc", F.col("x.code").alias("second"))
    return documents.join(best, "doc", "left").select("doc", F.when(F.col("second").isNull(), F.col("languages")).otherwise(F.concat("languages", F.array("second"))).alias("languages"))


def is_layer(mode: Column, alpha: Column) -> Column:
    """A glyph that isn't drawn: its mode is invisible, or its colour is clear."""
    return (mode == INVISIBLE_MODE) | (alpha == 0)


def reads_again(policy: Column, hit_rate: Column, t: Thresholds = DEFAULT) -> Column:
    """Whether a page's hidden text is read anew: always, never, or (auto) where its words are known to be bad. An unknown rate is no evidence."""
    return F.when(policy == "always", True).when(policy == "never", False).otherwise(F.coalesce(hit_rate < t.broken_text_dict_hit_min, F.lit(False)))


def reading_plan(pages: DataFrame, images: DataFrame, glyphs: DataFrame, mode: str = "auto", t: Thresholds = DEFAULT) -> DataFrame:
    """(page, scope, image, replaces) of what to read: whole pages by class, and on mixed pages each image that no glyph lies on.

    ``pages``: page, class, policy, hit_rate, width, height. ``images``: page, id, kind, rect. ``glyphs``: page, rect. Glyphs meet images by a grid of their page, not in pairs.
    """
    if mode == "never":
        return pages.where(F.lit(False)).select("page", F.lit("").alias("scope"), F.lit(0).cast("bigint").alias("image"), F.lit(False).alias("replaces"))
    again = reads_again(F.col("policy"), F.col("hit_rate"), t)
    always = F.lit(mode == "always")
    sandwich = F.col("class") == "OcrSandwich"
    whole = pages.where((sandwich & (again | always)) | (~sandwich & (always | (F.col("class") == "ImageOnly"))))
    whole = whole.select("page", F.lit("page").alias("scope"), F.lit(-1).cast("bigint").alias("image"), (sandwich & again).alias("replaces"))
    if mode == "always":
        return whole
    mixed = images.join(pages.where("class = 'Mixed'").select("page", "width", "height"), "page").where(F.col("kind").isin(READABLE_IMAGES))
    clip = F.struct(F.greatest("rect.x0", F.lit(0.0)).alias("x0"), F.greatest("rect.y0", F.lit(0.0)).alias("y0"), F.least("rect.x1", "width").alias("x1"), F.least("rect.y1", "height").alias("y1"))
    mixed = mixed.select("page", "id", clip.alias("rect")).where("rect.x1 > rect.x0 and rect.y1 > rect.y0")
    cell = F.lit(t.grid_cell_pt)
    grid = lambda df, name: df.select("page", *(["id"] if "id" in df.columns else []), F.col("rect").alias(name), F.explode(F.sequence(F.floor(F.col("rect.x0") / cell), F.floor(F.col("rect.x1") / cell))).alias("gx"))
    covered = grid(mixed, "a").join(grid(glyphs, "b"), ["page", "gx"]).where(overlaps("a", "b")).select("page", "id").distinct()
    bare = mixed.join(covered, ["page", "id"], "left_anti").select("page", F.lit("image").alias("scope"), F.col("id").cast("bigint").alias("image"), F.lit(False).alias("replaces"))
    return whole.unionByName(bare)


def merge_fonts(fonts: DataFrame) -> DataFrame:
    """(page, font, id): one number for each font name, in the order in which pages (page, font, name) first use it."""
    first = fonts.groupBy("name").agg(F.min(F.struct("page", "font")).alias("first"))
    numbered = first.withColumn("id", F.row_number().over(Window.orderBy("first", "name")) - 1)  # a row for each name: fonts are few
    return fonts.join(numbered.select("name", "id"), "name").select("page", "font", "id")
