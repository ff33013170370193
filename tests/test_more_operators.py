from pyspark.sql import functions as F

from scriptorium.operators import contents, evaluate, ocr
from scriptorium.sources import sinks


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


BLOCK = "doc string, at int, kind string, level int, text string, lang string, class string, page int, label string"
ASSERT = "doc string, id int, kind string, text string, then string, level int, headings array<struct<level:int,text:string>>, of string, min int, max int, equals int, holds boolean, page_index int, label string, lang string, class string"


def test_assertions_of_every_kind(spark):
    blocks = spark.createDataFrame([("d", 0, "heading", 1, "One", "en", None, 0, "i"), ("d", 1, "paragraph", None, "some text", "en", "verse", 0, "i"), ("d", 2, "heading", 2, "Two", "de", None, 1, "1")], BLOCK)
    docs = spark.createDataFrame([("d", ["text", "layout", "paragraphs", "structure"], 2, True), ("p", ["text"], 0, True)], "doc string, stages array<string>, images int, bijective boolean")
    base = dict.fromkeys([x.split()[0] for x in ASSERT.split(", ")])
    cases = [
        (dict(kind="text_present", text="some"), True), (dict(kind="text_present", text="none"), False), (dict(kind="text_absent", text="none"), True), (dict(kind="text_order", text="One", then="Two"), True),
        (dict(kind="text_order", text="Two", then="One"), False), (dict(kind="heading_level", text="Two", level=2), True), (dict(kind="heading_level", text="Two", level=1), False), (dict(kind="heading_tree", headings=[(1, "One"), (2, "Two")]), True),
        (dict(kind="block_count", of="heading", min=2), True), (dict(kind="block_count", of="heading", max=1), False), (dict(kind="image_count", equals=2), True), (dict(kind="note_bijection", holds=True), True),
        (dict(kind="page_label", page_index=1, label="1"), True), (dict(kind="lang_tag", text="Two", lang="de"), True), (dict(kind="css_class", text="some", **{"class": "verse"}), True), (dict(kind="css_class", text="some", **{"class": "pre"}), False),
    ]
    data = [tuple((base | c | {"doc": "d", "id": i}).values()) for i, (c, _) in enumerate(cases)]
    data += [tuple((base | {"doc": "p", "id": 90, "kind": "text_order", "text": "a", "then": "b"}).values()), tuple((base | {"doc": "unknown", "id": 91, "kind": "text_present", "text": "a"}).values())]
    out = {r["id"]: r["outcome"] for r in evaluate.evaluate_assertions(spark.createDataFrame(data, ASSERT), blocks, docs).collect()}
    assert [out[i] for i in range(len(cases))] == ["Pass" if ok else "Fail" for _, ok in cases] and out[90] == out[91] == "Pending"


def test_distances(spark):
    assert evaluate.edit_distance(list("kitten"), list("sitting")) == 3 and evaluate.edit_distance([], [1, 2]) == 2 and evaluate.edit_distance([1], []) == 1
    t = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x")], "doc string, at int, text string")
    s = spark.createDataFrame([("a", 0, "x"), ("a", 1, "z"), ("c", 0, "q")], "doc string, at int, text string")
    assert rows(evaluate.block_order_score(t, s), "doc") == [("a", 0.5), ("b", 0.0), ("c", 0.0)]


def test_admission_is_sequential(spark):
    c = [(0, "a", "CC0", 40, 9, False), (1, "a", "CC0", 40, 9, False), (2, "k", "CC0", 40, 9, False), (3, "b", "no", 40, 9, False), (4, "c", "CC0", 400, 9, False), (5, "d", "CC0", 40, 2, False), (6, "e", "CC0", 70, 9, False), (7, "a", "CC0", 1, 9, False), (8, "f", "CC0", 1, 9, False), (9, "g", "CC0", 1, 9, False)]
    df = spark.createDataFrame([("s", *x) for x in c], "source string, at int, id string, license string, bytes bigint, pages int, encrypted boolean")
    out = evaluate.admit(df, spark.createDataFrame([("k",)], "id string"), ["CC0"], 100, 100)
    assert [r[3] for r in rows(out, "at")] == ["admitted", "duplicate", "duplicate", "licence", "too-large", "too-short", "admitted", "duplicate", "budget"]
    assert rows(evaluate.rejections(out))[0] == ("duplicate", 3)


def test_history_and_outcomes(spark):
    h = spark.createDataFrame([("c1", "m", 1.0), ("c2", "m", 2.0)], "commit string, metric string, value double")
    assert rows(evaluate.record_run(h, spark.createDataFrame([("c2", "m", 5.0)], h.schema)), "commit") == [("c1", "m", 1.0), ("c2", "m", 5.0)]
    g = spark.createDataFrame([("m", 1, None), ("m", 2, 0.5), ("m", 3, 0.7)], "metric string, at int, gap double")
    assert rows(evaluate.widening(g, "at")) == [("m", 0.5, 0.7)]
    gold = spark.createDataFrame([("t", "en", 1, "A b"), ("t", "en", 2, "c")], "task string, lang string, id int, label string")
    a, b = spark.createDataFrame([(1, " a  B"), (2, "c")], "id int, answer string"), spark.createDataFrame([(1, "x")], "id int, answer string")
    out = evaluate.outcomes(gold, a, b)
    assert rows(out, "id") == [("t", "en", 1, True, False), ("t", "en", 2, True, False)] and rows(evaluate.passes(out)) == [("t", 2, 2, False)]
    u = spark.createDataFrame([("https://creativecommons.org/licenses/by-sa/4.0/",), ("http://creativecommons.org/publicdomain/zero/1.0",), ("z",)], "u string")
    assert [r["x"] for r in u.select(evaluate.license_of(F.col("u")).alias("x")).collect()] == ["CC-BY-SA-4.0", "CC0-1.0", None]
    e, n = spark.createDataFrame([(1, "old")], "id int, t string"), spark.createDataFrame([(1, "new"), (2, "new"), (2, "new")], "id int, t string")
    assert rows(evaluate.merge_manifest(e, n), "id") == [(1, "old"), (2, "new")]


def test_contents(spark):
    lines = [("d", 1, i, t) for i, t in enumerate(["Contents", "1. First ..... 3", "2. Second ..... 5", "Third ..... 9"])] + [("d", 2, i, t) for i, t in enumerate(["Prose here", "and there 5", "ends"])]
    df = spark.createDataFrame(lines, "doc string, page int, at int, line string")
    assert [r["is_contents"] for r in contents.contents_pages(df).orderBy("page").collect()] == [True, False]
    labels = spark.createDataFrame([("d", p, p - 2) for p in range(3, 14)], "doc string, page int, label bigint")
    heads = spark.createDataFrame([("d", 5, 50, "First"), ("d", 8, 80, "Secund"), ("d", 30, 300, "Third")], "doc string, page int, at int, text string")
    entries = contents.contents_entries(df.where("page = 1"))
    assert [(r["at"], r["heading"]) for r in contents.link_contents(entries, labels, heads).orderBy("at").collect()] == [(1, 50), (2, 80)]


def test_lists_quotes_titles(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["1. a", "go on", "2. b", "text", "• x", "• y", "a. z", "prose"])], "doc string, at int, line string")
    assert [r[2:] for r in rows(contents.detect_lists(lines), "first")] == [("decimal", 0, 2, 1), ("bullet", 4, 2, None)]
    b = spark.createDataFrame([("d", 1, True, [0.5]), ("d", 2, False, [0.3, 0.5, 0.4, 0.9]), ("d", 3, False, [1.0, 0.99, 0.4]), ("d", 4, False, [1.0, 0.4, 0.4])], "doc string, at int, monospace boolean, lines array<double>")
    assert [r["kind"] for r in contents.classify_indented(b).orderBy("at").collect()] == ["pre", "verse", "quote", "ambiguous"]
    t = spark.createDataFrame([("d", 0, 0, 20.0, " Title "), ("d", 0, 1, 20.0, "Other"), ("d", 1, 2, 10.0, "von Jane Doe"), ("d", 9, 3, 99.0, "late")], "doc string, page int, at int, size double, text string")
    assert rows(contents.title_and_author(t)) == [("d", "Title", "Jane Doe")]
    k = spark.createDataFrame([("Vorwort zur",), ("Index",), ("Chapter",)], "t string")
    assert [tuple(r) for r in k.select(contents.part_kind(F.col("t"), contents.FRONT_WORDS), contents.part_kind(F.col("t"), contents.BACK_WORDS)).collect()] == [("preface", None), (None, "index"), (None, None)]


def test_ocr(spark):
    w = [(1, 1, 1, 1, 2, "b", 10.0, 0.0, 20.0, 10.0, 0.9), (1, 1, 1, 1, 1, "a", 0.0, 0.0, 9.0, 11.0, 0.5), (1, 1, 1, 2, 1, "c", 0.0, 20.0, 9.0, 40.0, 0.2)]
    df = spark.createDataFrame(w, "page int, block_num int, par_num int, line_num int, word_num int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    out = ocr.merge_words(df).orderBy("line_num").collect()
    assert [r["text"] for r in out] == ["a b", "c"] and out[0]["x1"] == 20.0
    assert rows(ocr.region_confidence(df, ["page"], 0.6)) == [(1, 3, (0.9 + 0.5 + 0.2) / 3, 2)]
    region = spark.createDataFrame([("r", 0.0, 100.0), ("s", 0.0, 10.0)], "region string, y0 double, y1 double")
    blocked = spark.createDataFrame([("r", 10.0, 20.0), ("r", 15.0, 30.0), ("r", 90.0, 120.0), ("r", 12.0, 13.0)], "region string, y0 double, y1 double")
    bands = ocr.clean_bands(region, blocked)
    assert rows(bands, "region", "y0") == [("r", 0.0, 10.0), ("r", 30.0, 90.0), ("s", 0.0, 10.0)]
    words = spark.createDataFrame([("r", 1, 2.0, 5.0), ("r", 2, 9.0, 12.0), ("r", 3, 40.0, 50.0)], "region string, id int, y0 double, y1 double")
    assert rows(ocr.split_by_bands(words, bands), "id") == [("r", 1, 0.0), ("r", 2, None), ("r", 3, 30.0)]
    langs = spark.createDataFrame([("d", x) for x in ["en"] * 7 + ["de"] * 3], "doc string, lang string")
    assert rows(ocr.second_language(langs, F.lit("en"))) == [("d", "de")]


def test_sinks(spark):
    assert sinks.canonical_json({"b": 1.006, "ir_version": 2, "a": [1.0, {"z": 1, "c": None}]}) == '{"ir_version":2,"a":[1.0,{"c":null,"z":1}],"b":1.01}'
    entries = {"b.xhtml": b"x", "META-INF/container.xml": b"c", "a.css": b"y"}
    data = sinks.deterministic_zip(entries)
    assert data == sinks.deterministic_zip(dict(reversed(entries.items()))) and sinks.container_findings(data) == [] and sinks.read_entries(data)["a.css"] == b"y"
    assert ("name_collision", "B.xhtml") in sinks.container_findings(sinks.deterministic_zip(entries | {"B.xhtml": b""})) or ("name_collision", "b.xhtml") in sinks.container_findings(sinks.deterministic_zip(entries | {"B.xhtml": b""}))
    e = spark.createDataFrame([("j", 5, "b", "x"), ("j", 1, "a", "y" * 100)], "job string, ts_ms bigint, t string, payload string")
    lines = rows(sinks.event_lines(e, 80), "seq")
    assert lines[1][2] == '{"v":1,"t":"b","seq":1,"ts_ms":5,"payload":"x"}' and '"truncated":true' in lines[0][2]
    k = spark.createDataFrame([("ab", "c"), ("a", "bc")], "a string, b string").select(sinks.cache_key(F.col("a"), F.col("b")).alias("k")).collect()
    assert k[0]["k"] != k[1]["k"]
