"""What stands around a document: outline, metadata packets, job specifications, overrides, ground truth, producers; and the interfaces that readers of other formats have to fill."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of producers in the order in which they are tried; strata by the marks of a producer; marks of tools that pass on what others made.
PRODUCERS = [
    ("pdfTeX", "(?i)pdftex|xetex|luatex"), ("InDesign", "(?i)indesign"), ("Word", "(?i)microsoft.*word|word for"), ("Ghostscript", "(?i)ghostscript"), ("Scanner", "(?i)abbyy|finereader|scanner|kofax"),
    ("Typst", "(?i)^typst"), ("WeasyPrint", "(?i)weasyprint"), ("Chromium", "(?i)chrom(e|ium)|skia"),
]
STRATA = [
    ("InDesign", ["indesign"]), ("Quark", ["quarkxpress", "quark xpress"]), ("Word", ["microsoft word", "microsoft® word", "word for windows", "winword"]),
    ("pdfTeX", ["pdftex", "xetex", "luatex", "pdflatex", "latex", "dvips", "dvipdfm", "tex output"]),
    ("ABBYY-scanner", ["abbyy", "finereader", "luradocument", "scanner", "scansoft", "kofax", "omnipage", "canon", "xerox", "ricoh", "konica", "epson", "hp digital sending", "i2s ", "copibook", "bookdrive"]),
    ("Ghostscript", ["ghostscript"]),
]
OWN_STRATA = [("ours(Typst)", ["typst"]), ("ours(WeasyPrint)", ["weasyprint"])]
AFTERWARDS = ["Ghostscript"]
PASS_ON = ["distiller", "pdfwriter", "pdf library", "quartz", "macos", "preview"]


def producer_family(producer: Column, creator: Column) -> Column:
    """The tool that a file says made it: the first pattern that the producer, else the creator, has; else Unknown."""

    def match(text: Column) -> Column:
        out = None
        for family, pattern in reversed(PRODUCERS):
            hit = F.rlike(F.trim(text), F.lit(pattern))
            out = F.when(hit, family) if out is None else F.when(hit, family).otherwise(out)
        return out

    return F.coalesce(match(producer), match(creator), F.lit("Unknown"))


def classify_producer(producer: Column, creator: Column, real_world: bool = False) -> Column:
    """The stratum of a file: by its producer; one that only passes on or works afterwards stands aside for what the creator names."""

    def match(text: Column) -> Column:
        out = None
        for stratum, marks in reversed([*([] if real_world else OWN_STRATA), *STRATA]):
            hit = F.lit(False)
            for m in marks:
                hit = hit | F.contains(F.lower(text), F.lit(m))
            out = F.when(hit, stratum) if out is None else F.when(hit, stratum).otherwise(out)
        return out

    p, c = match(F.coalesce(producer, F.lit(""))), match(F.coalesce(creator, F.lit("")))
    passes = F.lit(False)
    for m in PASS_ON:
        passes = passes | F.contains(F.lower(F.coalesce(producer, F.lit(""))), F.lit(m))
    asks = F.coalesce(p.isin(AFTERWARDS), F.lit(False)) | passes | (F.trim(F.coalesce(producer, F.lit(""))) == "")
    made = F.when(asks & c.isNotNull() & ~c.isin(AFTERWARDS), c)
    return F.when(p.isNotNull() & ~p.isin(AFTERWARDS), p).otherwise(F.coalesce(made, p, F.lit("unknown")))


def flat_outline(bookmarks: DataFrame, depth: int = 16) -> DataFrame:
    """(doc, pos, title, level, page) of bookmarks (doc, node, parent, ord, title, page) in the order of a walk; those without a title are passed, not what is under them."""
    from pyspark.sql import Window

    from scriptorium.operators.book import walk

    rows = walk(bookmarks, depth).where("title is not null")
    return rows.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("place")) - 1).alias("pos"), "title", F.col("depth").alias("level"), "page")


def xmp_fields(packet: Column) -> Column:
    """struct(title, creators, language, producer) of a metadata packet; null where it says nothing."""
    bare = F.regexp_replace(F.regexp_replace(packet, r"<(/?)\w+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"|\s\w+:(\w+)=", " $2")
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    first = lambda path: some(F.xpath_string(bare, F.lit(path)))
    return F.struct(first("//title//li").alias("title"), F.filter(F.xpath(bare, F.lit("//creator//li/text()")), lambda x: F.trim(x) != "").alias("creators"), first("//language//li").alias("language"), first("//Producer").alias("producer"))


SPEC = {"schema": int, "input": str, "output": str, "preset": str, "locale": str, "limits": dict, "ai": dict, "dump_stages": list, "overrides_path": str, "threshold_overrides": dict}
REQUIRED = ["schema", "input", "output"]


def spec_errors(text: str) -> list[str]:
    """What is wrong with a job specification: not an object, unknown fields, missing ones, fields of another type."""
    try:
        spec = json.loads(text)
    except ValueError:
        return ["not JSON"]
    if not isinstance(spec, dict):
        return ["not an object"]
    wrong = [f"unknown: {k}" for k in sorted(spec) if k not in SPEC] + [f"missing: {k}" for k in REQUIRED if k not in spec]
    return wrong + [f"type: {k}" for k in sorted(spec) if k in SPEC and (not isinstance(spec[k], SPEC[k]) or isinstance(spec[k], bool))]


def job_specs(rows: DataFrame) -> DataFrame:
    """(id, errors array) of specifications (id, spec)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "errors": [spec_errors(x or "") for x in b["spec"]]})

    return rows.select("id", "spec").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, errors array<string>")


def accepted_overrides(overrides: DataFrame, documents: DataFrame, version: int) -> DataFrame:
    """Overrides (doc, json) with accepted: only those of this version made for the very file (``documents``: doc, sha256)."""
    o = overrides.join(documents.select("doc", "sha256"), "doc", "left")
    of = lambda name: F.get_json_object("json", f"$.{name}")
    return o.withColumn("accepted", F.coalesce((of("ir_version").try_cast("int") == version) & (of("source_sha256") == F.col("sha256")), F.lit(False))).drop("sha256")


def probe(documents: DataFrame) -> DataFrame:
    """(doc, pages, family, stratum, tagged, encrypted) of file facts (doc, pages, producer, creator, struct_tree, encrypt)."""
    return documents.select("doc", F.coalesce("pages", F.lit(0)).alias("pages"), producer_family(F.col("producer"), F.col("creator")).alias("family"), classify_producer(F.col("producer"), F.col("creator")).alias("stratum"), F.coalesce("struct_tree", F.lit(False)).alias("tagged"), F.coalesce("encrypt", F.lit(False)).alias("encrypted"))


# --- ground truth from other forms of a book ---


class _Truth(HTMLParser):
    """Headings, paragraphs, notes, figures and languages that markup states."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int | None, str]] = []
        self.open: list[tuple[str, str]] = []
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if lang := a.get("xml:lang") or a.get("lang"):
            self.rows.append(("language", None, lang))
        if tag == "img":
            self.rows.append(("figure", None, a.get("alt") or ""))
        note = tag == "aside" or "footnote" in (a.get("epub:type") or a.get("class") or "")
        if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or note:
            self.open.append((tag, "note" if note else tag))
            self.text = []

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0] == tag:
            _, kind = self.open.pop()
            text = " ".join("".join(self.text).split())
            in_note = any(k == "note" for _, k in self.open)
            if text and not in_note:
                self.rows.append(("footnote" if kind == "note" else "heading" if kind[0] == "h" else "paragraph", int(kind[1]) if kind[0] == "h" else None, text))
            if not in_note:
                self.text = []

    def handle_data(self, data):
        self.text.append(data)


def truth_of_markup(html: str) -> list[tuple[str, int | None, str]]:
    """(kind, level, text) of what markup states, in order; languages once each."""
    p = _Truth()
    p.feed(html)
    p.close()
    seen: set = set()
    return [r for r in p.rows if r[0] != "language" or not (r in seen or seen.add(r))]


LATEX_LEVELS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}


def _braced(text: str, at: int) -> tuple[str, int]:
    """What stands in the braces that open at a place, and where they end."""
    depth, start = 0, at
    for i in range(at, len(text)):
        if text[i] in "{}" and (not i or text[i - 1] != "\\"):
            depth += 1 if text[i] == "{" else -1
            if not depth:
                return text[start + 1 : i], i + 1
    return text[start + 1 :], len(text)


def truth_of_latex(source: str) -> list[tuple[str, int | None, str]]:
    """(kind, level, text) of a LaTeX source's headings, notes, figures and paragraphs; comments are left out."""
    text = re.sub(r"(?<!\\)%.*", "", source)
    body = text.partition(r"\begin{document}")[2].partition(r"\end{document}")[0] or text
    out, last, plain = [], 0, []
    flat = lambda s: " ".join(re.sub(r"\\[a-zA-Z]+\*?(\[[^\]]*\])?|[{}~]", " ", s).split())

    def paragraphs(part: str) -> None:
        plain.append(part)

    def flush() -> None:
        out.extend(("paragraph", None, flat(p)) for p in re.split(r"\n\s*\n", "".join(plain)) if flat(p))
        plain.clear()

    for m in re.finditer(r"\\(part|chapter|section|subsection|subsubsection|footnote|includegraphics)\*?(\[[^\]]*\])?\{", body):
        if m.start() < last:
            continue
        inner, end = _braced(body, m.end() - 1)
        paragraphs(body[last : m.start()])
        last = end
        if m.group(1) in LATEX_LEVELS:
            flush()
            out.append(("heading", LATEX_LEVELS[m.group(1)], flat(inner)))
        else:
            out.append(("footnote", None, flat(inner)) if m.group(1) == "footnote" else ("figure", None, inner))
    paragraphs(body[last:])
    flush()
    return out


def truth_of_tags(nodes: DataFrame, depth: int = 32) -> DataFrame:
    """(doc, place, kind, level, text) of a tagged file's structure tree (doc, node, parent, ord, tag, text): headings by their tags' numbers, paragraphs, notes and figures in the order of a walk."""
    from scriptorium.operators.book import walk

    level = F.when(F.col("tag") == "H", 1).when(F.rlike("tag", F.lit("^H[1-6]$")), F.substring("tag", 2, 1).cast("int"))
    kind = F.when(level.isNotNull(), "heading").when(F.col("tag") == "P", "paragraph").when(F.col("tag") == "Note", "footnote").when(F.col("tag") == "Figure", "figure")
    return walk(nodes, depth).withColumns({"kind": kind, "level": level}).where("kind is not null").select("doc", "place", "kind", "level", F.coalesce("text", F.lit("")).alias("text"))


def markup_truth(pages: DataFrame) -> DataFrame:
    """(page_id, at, kind, level, text) of pages (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(page, i, *r) for page, html in zip(b["page_id"], b["html"], strict=True) for i, r in enumerate(truth_of_markup(html or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "at", "kind", "level", "text"]).astype({"level": "Int32"})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, at int, kind string, level int, text string")


# --- what a reader of another format, a model or a host has to offer ---


class PageSource(Protocol):
    """A document's pages as tables: glyphs, images, paths, outline."""

    def glyphs(self) -> DataFrame: ...
    def images(self) -> DataFrame: ...
    def vectors(self) -> DataFrame: ...
    def outline(self) -> DataFrame: ...


class Opener(Protocol):
    def open(self, files: DataFrame) -> PageSource: ...


class Reader(Protocol):
    """An optical reader: words (page, block_num, par_num, line_num, word_num, text, box, confidence) of regions."""

    def read(self, regions: DataFrame) -> DataFrame: ...


class Model(Protocol):
    """Answers (id, answer) to requests (id, prompt, grammar)."""

    def answer(self, requests: DataFrame) -> DataFrame: ...


class Transport(Protocol):
    def post(self, url: str, body: bytes) -> bytes: ...


class Answer(Protocol):
    """The schema that an answer has to have."""

    ddl: str


class Emitter(Protocol):
    """Writes a book and looks at what it wrote."""

    def emit(self, entries: dict[str, bytes]) -> bytes: ...
    def findings(self, data: bytes) -> list[tuple[str, str, str]]: ...


class ProgressSink(Protocol):
    def said(self, stage: str, done: int, total: int) -> None: ...


class Clock(Protocol):
    def now(self) -> float: ...


class QueueSink(Protocol):
    def event(self, job: str, kind: str, payload: str) -> None: ...
