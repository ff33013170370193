"""Sources: documents as lines, words and tokens; pages as blocks; delimited and line-delimited files."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\x0B\f]+"


#: Tables whose rows cost much work each.
HEAVY = ["documents", "pages"]


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is where its splits are enough for all cores, as at any large size; a small file of one split is dealt out first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def trimmed_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"^{SPACE}|{SPACE}$", "")), lambda x: x != "")


def document_lines(docs: DataFrame) -> DataFrame:
    """A row for each line that is not blank: doc_id, line_no (from 0, of these), line."""
    return docs.select("doc_id", F.posexplode(trimmed_lines(F.col("text"))).alias("line_no", "line"))


def document_words(docs: DataFrame) -> DataFrame:
    """A row for each word: doc_id, word_no, word."""
    return docs.select("doc_id", F.posexplode(words_of(F.col("text"))).alias("word_no", "word"))


TSV_HEADER = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]
TSV_DDL = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"


def ocr_words(spark: SparkSession, path: str, dpi: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Words of an OCR engine's TSV: rows of level 5 with a confidence of 0 or more and text; boxes in points, confidence in 0..1.

    The header must be the twelve known columns (enforced by the reader).
    """
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("enforceSchema", False).option("mode", "FAILFAST").schema(TSV_DDL).csv(path)
    at = lambda px, zero: F.lit(zero) + px * 72 / dpi
    return rows.where("level = 5 and conf >= 0 and trim(text) <> ''").select(
        "page_num", "block_num", "par_num", "line_num", "word_num", "text",
        at(F.col("left"), x0).alias("x0"), at(F.col("top"), y0).alias("y0"), at(F.col("left") + F.col("width"), x0).alias("x1"), at(F.col("top") + F.col("height"), y0).alias("y1"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("conf") / 100)).alias("confidence"),
    )


def json_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of a line-delimited JSON file; a line that doesn't parse is an error."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


# Elements that are blocks, and those whose content is no text.
BLOCKS = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "figcaption", "td", "th", "title", "nav", "footer", "div", "article", "section", "header", "ul", "ol", "table", "tr"]
SILENT = ["script", "style"]


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.tag, self.silent = [], [], "body", 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            level = int(self.tag[1]) if len(self.tag) == 2 and self.tag[0] == "h" and self.tag[1].isdigit() else None
            self.out.append((self.tag, level, text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in BLOCKS:
            self.flush()
            self.tag = tag
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS:
            self.flush()
            self.tag = "body"

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def blocks_of(html: str | None) -> list[tuple[str, int | None, str]]:
    """(tag, heading level, text) of each block of a page that has text, in order."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def html_blocks(pages: DataFrame) -> DataFrame:
    """A row for each block: page_id, block_no, tag, level, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(page, i, *block) for page, html in zip(b["page_id"], b["html"], strict=True) for i, block in enumerate(blocks_of(html))]
            yield pd.DataFrame(rows, columns=["page_id", "block_no", "tag", "level", "text"]).astype({"level": "Int32"})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, block_no int, tag string, level int, text string")
