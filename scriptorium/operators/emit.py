"""A book's files from its sections and content: markup, navigation, package, container."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import xml_text
from scriptorium.sources.sinks import deterministic_zip

# The one stylesheet, media types by extension, and the properties that an accessible book declares.
STYLESHEET = "body { margin: 0 5%; line-height: 1.4; }\nblockquote { margin: 1em 2em; }\npre { white-space: pre-wrap; }\naside { font-size: 0.85em; }\nfigure { margin: 1em 0; text-align: center; }\nimg { max-width: 100%; }\n"
MEDIA_TYPES = {"xhtml": "application/xhtml+xml", "css": "text/css", "ncx": "application/x-dtbncx+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml"}
ACCESSIBILITY = ["textual", "visual"]
XHTML = '<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">'


def alt_text(said: Column, caption: Column, number: Column) -> Column:
    """What an image is said to show: what it says itself, its caption, or its number; never empty."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(some(said), some(caption), F.concat(F.lit("Figure "), number.cast("string")))


def markup(kind: Column, level: Column, anchor: Column, text: Column) -> Column:
    """The element of a piece of content: heading, paragraph, quote, pre or break."""
    tag = F.when(kind == "heading", F.concat(F.lit("h"), F.least(level, F.lit(6)).cast("string"))).when(kind == "quote", "blockquote").when(kind == "pre", "pre").otherwise("p")
    return F.concat(F.lit("<"), tag, F.lit(' id="'), anchor, F.lit('">'), xml_text(text), F.lit("</"), tag, F.lit(">"))


def emit(content: DataFrame, notes: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, section, at, part, html): the pieces of sections in order. A note (doc, note, page, text, after: the content it is referred to from, or null) stands after its reference; one without goes to
    the end of the section that covers its page. ``content``: doc, section, at, kind, level, text. ``sections``: doc, section, first (page)."""
    anchor = F.concat(F.lit("c"), F.col("at").cast("string"))
    pieces = content.select("doc", "section", "at", F.lit(0).cast("bigint").alias("part"), markup(F.col("kind"), F.col("level"), anchor, F.col("text")).alias("html"))
    aside = F.concat(F.lit('<aside epub:type="footnote" id="n'), F.col("note").cast("string"), F.lit('">'), xml_text(F.col("text")), F.lit("</aside>"))
    told = notes.where("after is not null").join(content.select("doc", F.col("at").alias("after"), "section"), ["doc", "after"])
    placed = told.select("doc", "section", F.col("after").alias("at"), (F.col("note") + 1).cast("bigint").alias("part"), aside.alias("html"))
    # the section whose pages hold an orphan's: the last that begins on its page or before, found by a running maximum over both
    rows = sections.select("doc", F.col("first").alias("page"), F.lit(0).alias("kind"), "section", F.lit(None).cast("bigint").alias("note"), F.lit(None).cast("string").alias("text"))
    rows = rows.unionByName(notes.where("after is null").select("doc", "page", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("section"), F.col("note").cast("bigint").alias("note"), "text"))
    w = Window.partitionBy("doc").orderBy("page", "kind").rowsBetween(Window.unboundedPreceding, 0)
    least = F.min("section").over(Window.partitionBy("doc"))
    lost = rows.withColumn("section", F.coalesce(F.last("section", ignorenulls=True).over(w), least)).where("kind = 1 and section is not null")
    last = content.groupBy("doc", "section").agg(F.max("at").alias("at"))
    lost = lost.join(last, ["doc", "section"], "left").select("doc", "section", F.coalesce("at", F.lit(0)).alias("at"), (F.lit(1 << 40) + F.col("note")).alias("part"), aside.alias("html"))
    return pieces.unionByName(placed).unionByName(lost)


def spine(sections: DataFrame) -> DataFrame:
    """(doc, pos, file, title) of sections (doc, section, heading): a file each, in order; one without a heading isn't in the navigation (null title)."""
    pos = F.row_number().over(Window.partitionBy("doc").orderBy("section")) - 1
    return sections.withColumn("pos", pos).select("doc", "section", "pos", F.concat(F.lit("s"), F.lpad(F.col("pos").cast("string"), 4, "0"), F.lit(".xhtml")).alias("file"), F.col("heading").alias("title"))


def resolve_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links (doc, id, target) with ``href``: the file and anchor where the target (doc, anchor, file) came to be; null if nowhere."""
    return links.join(anchors.select("doc", F.col("anchor").alias("target"), "file"), ["doc", "target"], "left").withColumn("href", F.concat("file", F.lit("#"), "target")).drop("file")


def page_targets(breaks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc, page, label, href) of page breaks (doc, page, label, anchor) that are in the book; the first of a label."""
    first = breaks.withColumn("k", F.row_number().over(Window.partitionBy("doc", "label").orderBy("page"))).where("k = 1 and label is not null")
    return resolve_links(first.select("doc", "page", "label", F.col("anchor").alias("target")), anchors).where("href is not null").select("doc", "page", "label", "href")


def landmarks(files: DataFrame) -> DataFrame:
    """(doc, kind, file): the first file of the body, of the contents and of the back. ``files``: doc, pos, file, role (front:..., back:... or of the body)."""
    kind = F.when(F.col("role") == "front:toc", "toc").when(F.startswith("role", F.lit("front:")), None).when(F.startswith("role", F.lit("back:")), "backmatter").otherwise("bodymatter")
    return files.withColumn("kind", kind).where("kind is not null").groupBy("doc", "kind").agg(F.min_by("file", "pos").alias("file"))


def nav(entries: DataFrame) -> DataFrame:
    """(doc, nav): nested lists of entries (doc, at, level, title, href), whose levels begin at 1 and don't skip: each entry closes and opens what its level against the one before says."""
    w = Window.partitionBy("doc").orderBy("at")
    was = F.coalesce(F.lag("level").over(w), F.lit(0))
    turn = F.when(F.col("level") > was, "<ol><li>").otherwise(F.concat(F.expr("repeat('</li></ol>', was_ - level)"), F.lit("</li><li>")))
    link = F.concat(F.lit('<a href="'), xml_text(F.col("href")), F.lit('">'), xml_text(F.col("title")), F.lit("</a>"))
    rows = entries.withColumn("was_", was).withColumn("item", F.concat(turn, link)).drop("was_")
    all_of = F.transform(F.array_sort(F.collect_list(F.struct("at", "item", "level"))), lambda x: x["item"])
    return rows.groupBy("doc").agg(F.array_join(all_of, "").alias("body"), F.max_by("level", "at").alias("last")).select("doc", F.concat(F.lit('<nav epub:type="toc">'), F.col("body"), F.expr("repeat('</li></ol>', last)"), F.lit("</nav>")).alias("nav"))


def ncx(entries: DataFrame) -> DataFrame:
    """(doc, ncx): nested navigation points of the same entries, numbered in order."""
    w = Window.partitionBy("doc").orderBy("at")
    rows = entries.withColumn("was_", F.coalesce(F.lag("level").over(w), F.lit(0))).withColumn("n_", F.row_number().over(w))
    close = F.expr("repeat('</navPoint>', greatest(was_ - level + 1, 0))")
    point = F.concat(close, F.lit('<navPoint id="p'), F.col("n_").cast("string"), F.lit('" playOrder="'), F.col("n_").cast("string"), F.lit('"><navLabel><text>'), xml_text(F.col("title")), F.lit('</text></navLabel><content src="'), xml_text(F.col("href")), F.lit('"/>'))
    rows = rows.withColumn("item", point)
    all_of = F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"])
    return rows.groupBy("doc").agg(F.array_join(all_of, "").alias("body"), F.max_by("level", "at").alias("last")).select("doc", F.concat(F.lit("<navMap>"), F.col("body"), F.expr("repeat('</navPoint>', last)"), F.lit("</navMap>")).alias("ncx"))


def media_type(file: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in MEDIA_TYPES.items() for x in p]), F.lower(F.substring_index(file, ".", -1)))


def package(books: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, opf) of books (doc, title, lang, identifier, modified) and files (doc, pos or null, file): metadata, the manifest by name, the spine in order."""
    item = F.concat(F.lit('<item id="'), F.regexp_replace("file", r"[^A-Za-z0-9]", "_"), F.lit('" href="'), F.col("file"), F.lit('" media-type="'), media_type(F.col("file")), F.lit('"'), F.when(F.col("file") == "nav.xhtml", ' properties="nav"').otherwise(""), F.lit("/>"))
    ref = F.concat(F.lit('<itemref idref="'), F.regexp_replace("file", r"[^A-Za-z0-9]", "_"), F.lit('"/>'))
    joined = lambda order, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, x.alias("x")))), lambda r: r["x"]), "")
    f = files.groupBy("doc").agg(joined(F.col("file"), item).alias("manifest"))
    s = files.where("pos is not null").groupBy("doc").agg(joined(F.col("pos"), ref).alias("spine"))
    modes = "".join(f'<meta property="schema:accessMode">{m}</meta>' for m in ACCESSIBILITY)
    meta = F.concat(
        F.lit('<metadata><dc:identifier id="id">'), xml_text(F.col("identifier")), F.lit("</dc:identifier><dc:title>"), xml_text(F.col("title")), F.lit("</dc:title><dc:language>"), F.col("lang"), F.lit('</dc:language><meta property="dcterms:modified">'), F.col("modified"), F.lit(f"</meta>{modes}</metadata>")
    )
    out = books.join(f, "doc").join(s, "doc")
    return out.select("doc", F.concat(F.lit('<package unique-identifier="id" version="3.0">'), meta, F.lit("<manifest>"), F.col("manifest"), F.lit("</manifest><spine>"), F.col("spine"), F.lit("</spine></package>")).alias("opf"))


def build_containers(entries: DataFrame) -> DataFrame:
    """(doc, data) of entries (doc, name, data binary): a container whose bytes depend on its entries only. A book's entries meet in one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc": [key[0]], "data": [deterministic_zip(dict(zip(rows["name"], map(bytes, rows["data"]), strict=True)))]})

    return entries.groupBy("doc").applyInPandas(run, f"doc {dict(entries.dtypes)['doc']}, data binary")


def write_atomically(spark: SparkSession, path: str, data: bytes) -> None:
    """Write beside the target, then rename: readers see all of it or nothing."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"can't rename to {path}")


# --- images ---


def lanczos3(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image (rows, columns, channels) resampled with a three-lobed window, which widens when it shrinks; edges repeat."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = max(1.0, n / m)
        at = (np.arange(m) + 0.5) * n / m - 0.5
        x = (np.arange(n)[None, :] - at[:, None]) / scale
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        return w / w.sum(1, keepdims=True)

    a = np.tensordot(weights(image.shape[0], height), image.astype(float), (1, 0))
    b = np.tensordot(weights(image.shape[1], width), a, (1, 1)).transpose(1, 0, 2)
    return np.clip(np.floor(b + 0.5), 0, 255).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A picture of 3 or 4 channels as PNG, unfiltered rows."""
    h, w, c = image.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * c)], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def encode(image: np.ndarray, longest: int = 1600) -> tuple[str, bytes]:
    """(media type, bytes) of a picture with alpha, made smaller where a side is too long. Alpha that is nowhere used is left out. (Pictures without it are PNG too: there is no JPEG writer here.)"""
    h, w = image.shape[:2]
    if max(h, w) > longest:
        image = lanczos3(image, max(1, round(w * longest / max(h, w))), max(1, round(h * longest / max(h, w))))
    if image.shape[2] == 4 and (image[:, :, 3] == 255).all():
        image = image[:, :, :3]
    return "image/png", png(image)
