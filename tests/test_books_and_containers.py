"""Emitted files, containers, their checks and repairs; sources around documents; languages."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import containers, emit, evaluate, language
from scriptorium.sources import documents as sources
from scriptorium.sources import sinks

OPF = '<package unique-identifier="id" version="3.0"><metadata><dc:identifier id="id">x</dc:identifier><dc:title>T</dc:title><dc:language>en</dc:language><meta property="dcterms:modified">2020</meta></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/></manifest><spine><itemref idref="a"/></spine></package>'


def container(**changes):
    body = '<p id="p1">x<a epub:type="noteref" href="#n1">1</a></p><aside epub:type="footnote" id="n1">note</aside><img src="i.png" alt="An image"/>'
    entries = {"META-INF/container.xml": '<rootfile full-path="book.opf"/>', "book.opf": OPF, "nav.xhtml": "<html><body><a href='a.xhtml#p1'>x</a></body></html>", "a.xhtml": f"<html><body>{body}</body></html>", "i.png": "x"}
    entries |= changes
    return {k: v.encode() for k, v in entries.items() if v is not None}


def ids(entries, images=None):
    return sorted({f[0] for f in containers.check(sinks.deterministic_zip(entries), images)})


def test_a_good_container_has_no_findings():
    assert ids(container(), 1) == []


@pytest.mark.parametrize(
    ("change", "images", "want"),
    [
        ({"book.opf": OPF.replace('unique-identifier="id"', 'unique-identifier="no"')}, None, "OPF-030"), ({"book.opf": OPF.replace("<dc:title>T</dc:title>", "")}, None, "RSC-005"), ({"book.opf": OPF.replace("image/png", "image/gif")}, None, "OPF-012"),
        ({"i.png": None}, None, "RSC-007"), ({"book.opf": OPF.replace('idref="a"', 'idref="z"')}, None, "RSC-005"), ({"book.opf": OPF.replace(' properties="nav"', "")}, None, "RSC-005"), ({"stray.css": "x"}, None, "OPF-003"),
        ({"a.xhtml": "<html><body><p>open</body></html>"}, None, "RSC-005"), ({"a.xhtml": "<html><body><script src='x'> </script></body></html>"}, None, "OPF-014"), ({"a.xhtml": '<html><body><img src="http://x/y.png" alt="a"/></body></html>'}, None, "RSC-006"),
        ({"a.xhtml": '<html><body><a href="nav.xhtml#none">x</a></body></html>'}, None, "RSC-012"), ({"a.xhtml": '<html><body><a epub:type="noteref" href="#n9">1</a></body></html>'}, None, "NOTE-DANGLING"),
        ({"a.xhtml": '<html><body><img src="i.png" alt=" "/></body></html>'}, None, "ACC-001"), ({}, 2, "IMAGE-PARITY"), ({"a.xhtml": '<html><body><aside epub:type="footnote" id="n1">x</aside></body></html>'}, None, "NOTE-UNUSED"), ({"META-INF/container.xml": None}, None, "RSC-002"),
    ],
)
def test_each_fault_is_found(change, images, want):
    assert want in ids(container(**change), images)


def test_repairs_go_on_while_findings_grow_less():
    bad = container(**{"a.xhtml": '<html><body><img src="i.png" alt=""/><img src="i.png"/><a epub:type="noteref" href="#n9">see</a></body></html>'})
    look = lambda e: containers.check(sinks.deterministic_zip(e))
    mended, left = containers.repair(bad, look)
    assert left == [] and b"see</body>" in mended["a.xhtml"] and mended["a.xhtml"].count(b'alt="Figure"') == 2
    hopeless = container(**{"i.png": None})
    assert [f[0] for f in containers.repair(hopeless, look)[1]] == ["RSC-007", "RSC-007"]
    figures = {"a.xhtml": b'<figure id="f1"><img/></figure><figure id="f2"><img/></figure><figure><figcaption>x</figcaption></figure><a href="#f2">y</a>'}
    assert containers.apply_fix(figures, "drop-figure", "a.xhtml") and figures["a.xhtml"].count(b"<figure") == 2 and b"f1" not in figures["a.xhtml"]


def test_containers_by_the_table(spark):
    rows = [(1, n, bytearray(b)) for n, b in container().items()] + [(2, n, bytearray(b)) for n, b in container(**{"i.png": None}).items()]
    built = emit.build_containers(spark.createDataFrame(rows, "doc int, name string, data binary")).withColumn("images", F.lit(1))
    assert {(r["doc"], r["id"]) for r in containers.validate_containers(built).collect()} == {(2, "RSC-007")}


def test_navigation_is_well_formed(spark):
    from xml.etree import ElementTree

    e = spark.createDataFrame([(1, i, lv, f"T{i} & <x>", f"a{i}.xhtml") for i, lv in enumerate([1, 2, 3, 2, 1, 2])], "doc int, at int, level int, title string, href string")
    nav = ElementTree.fromstring(emit.nav(e).first()["nav"].replace("epub:type", "type"))
    tree = lambda ol: [(li.find("a").text, tree(li.find("ol")) if li.find("ol") is not None else []) for li in ol]
    t = lambda i: f"T{i} & <x>"
    assert tree(nav.find("ol")) == [(t(0), [(t(1), [(t(2), [])]), (t(3), [])]), (t(4), [(t(5), [])])]
    ncx = ElementTree.fromstring(emit.ncx(e).first()["ncx"])
    assert [p.get("playOrder") for p in ncx.iter("navPoint")] == ["1", "2", "3", "4", "5", "6"] and len(ncx) == 2


def test_files_are_renamed_into_place(spark, tmp_path):
    path = f"file://{tmp_path}/book.epub"
    emit.write_atomically(spark, path, b"one")
    emit.write_atomically(spark, path, b"two")
    assert (tmp_path / "book.epub").read_bytes() == b"two" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["book.epub"]


def test_images_shrink_and_keep_their_colours():
    flat = np.full((40, 60, 4), 200, np.uint8)
    assert (emit.lanczos3(flat, 13, 7) == 200).all() and emit.lanczos3(flat, 13, 7).shape == (7, 13, 4)
    ramp = np.repeat(np.arange(0, 240, 4, dtype=np.uint8)[None, :, None], 20, 0).repeat(3, 2)
    small = emit.lanczos3(ramp, 15, 5)[2, 2:-2, 0].astype(int)
    assert (np.diff(small) > 10).all() and abs(small.mean() - ramp.mean()) < 4
    kind, data = emit.encode(np.full((10, 3000, 4), 255, np.uint8), 1600)
    width, height = int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    assert kind == "image/png" and (width, height) == (1600, 5) and data[25] == 2  # no alpha is used
    raw = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    assert len(raw) == 5 * (1600 * 3 + 1) and set(raw) == {0, 255}


def test_ground_truth_of_markup_and_latex(spark):
    html = '<html lang="en"><body><h1>One  two</h1><p>Text <em>here</em>.</p><aside epub:type="footnote"><p>A note.</p></aside><img alt="Pic" src="x"/><p lang="de">Mehr</p></body></html>'
    assert sources.truth_of_markup(html) == [("language", None, "en"), ("heading", 1, "One two"), ("paragraph", None, "Text here."), ("footnote", None, "A note."), ("figure", None, "Pic"), ("language", None, "de"), ("paragraph", None, "Mehr")]
    tex = r"""\documentclass{book} \begin{document} % a comment
\chapter{First \emph{one}} Some text\footnote{A {nested} note} goes on.

Another one with 10\% signs. \section*{Second}
\includegraphics[width=1cm]{pic.png} End. \end{document}"""
    out = sources.truth_of_latex(tex)
    assert [r for r in out if r[0] != "paragraph"] == [("heading", 1, "First one"), ("footnote", None, "A nested note"), ("heading", 2, "Second"), ("figure", None, "pic.png")]
    assert [t for k, _, t in out if k == "paragraph"][:1] == ["Some text goes on."]
    nodes = [(1, 0, None, 0, "Document", None), (1, 1, 0, 1, "H2", "Title"), (1, 2, 0, 2, "Sect", None), (1, 3, 2, 0, "P", "Text"), (1, 4, 0, 3, "Note", "N")]
    tags = sources.truth_of_tags(spark.createDataFrame(nodes, "doc int, node int, parent int, ord int, tag string, text string"))
    assert [tuple(r)[2:] for r in tags.orderBy("place").collect()] == [("heading", 2, "Title"), ("paragraph", None, "Text"), ("footnote", None, "N")]


def test_languages(spark):
    texts = {"en": "the house and the garden of the man who was there with them", "de": "das haus und der garten des mannes der mit ihnen dort war", "fr": "la maison et le jardin de monsieur qui etait avec eux la bas"}
    known = language.profiles(spark.createDataFrame([*texts.items()], "lang string, text string"))
    docs = spark.createDataFrame([(1, "the garden"), (2, "der garten und das haus"), (3, ""), (4, None), (5, "123")], "doc int, text string")
    out = {r["doc"]: (r["lang"], r["fell_back"]) for r in language.detect_documents(docs, known, "xx").collect()}
    assert out == {1: ("en", False), 2: ("de", False), 3: ("xx", True), 4: ("xx", True), 5: ("xx", True)}
    blocks = [(1, i, "the man and the house of the garden") for i in range(9)] + [(1, 9, "der garten und das haus des mannes"), (1, 10, "der garten")]
    b = spark.createDataFrame(blocks, "doc int, block int, text string")
    from dataclasses import replace

    from scriptorium.config import DEFAULT

    main = spark.createDataFrame([(1, "en-GB")], "doc int, lang string")
    tagged = language.detect_blocks(b, main, known, replace(DEFAULT, lang_block_min_confidence=0.3))
    assert {(r["block"], r["tag"]) for r in tagged.where("tag is not null").collect()} == {(9, "de")}  # two words are too few
    assert language.detect_blocks(b, main, known, replace(DEFAULT, lang_block_min_confidence=0.3, lang_block_override_max_share=0.05)).where("tag is not null").count() == 0


def test_sequence_distances(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "c", "d", "e"]), ([], ["x"]), ([f"w{i}" for i in range(700)], [f"w{i}" for i in range(1, 701)])], "a array<string>, b array<string>")
    assert [r["d"] for r in df.select(evaluate.sequence_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [3, 1, 2]
