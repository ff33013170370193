"""Operators on hand-made rows with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.config import Thresholds
from scriptorium.functions import text as T
from scriptorium.operators import furniture, hyphens, layout, ledger, metrics, paragraphs, quality, structure, validate
from scriptorium.sources import readers
from scriptorium.streaming import events


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def docs(spark, *texts):
    return spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")


# --- quality ---


def test_duplicate_lines_and_paragraphs(spark):
    ten = "\n".join([*"abcdef", "x", "x", "x", "x", "x"][1:])
    out = {r["doc_id"]: r for r in quality.quality_stats(docs(spark, ten, "", None, "one\n\none\n \none", "a a a b")).collect()}
    assert out[0]["dup_line_frac"] == pytest.approx(0.4) and out[1]["dup_line_frac"] == 0 and out[2]["n_words"] == 0
    assert out[3]["dup_para_frac"] == pytest.approx(2 / 3)
    assert out[4]["top_2gram"] == pytest.approx(2 * 2 / 4) and out[4]["top_3gram"] == 0 and out[4]["mean_word_len"] == 1
    assert out[0]["dict_hit_rate"] is None


def test_verdict_needs_known_numbers(spark):
    base = dict(replacement_share=0.0, dict_hit_rate=None, dup_line_frac=0.0, dup_para_frac=0.0, top_2gram=0.0, top_3gram=0.0, top_4gram=0.0, non_alpha_word_ratio=0.0, mean_word_len=5.0)
    cases = [({}, "Ok"), ({"replacement_share": 0.21}, "Broken"), ({"dict_hit_rate": 0.34}, "Broken"), ({"dup_line_frac": 0.31}, "Suspicious"), ({"dup_line_frac": 0.30}, "Ok"), ({"mean_word_len": 0.0}, "Ok"), ({"mean_word_len": 11.0}, "Suspicious"), ({"top_4gram": 0.17}, "Suspicious")]
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], ", ".join(f"{k} double" for k in base))
    assert [r["v"] for r in df.select(quality.verdict().alias("v")).collect()] == [v for _, v in cases]


def test_in_row_and_exploded_ngrams_agree(spark):
    rng = random.Random(0)
    df = docs(spark, *[" ".join(rng.choice(["ab", "c", "def"]) for _ in range(rng.randint(0, 30))) for _ in range(40)])
    a = {r["doc_id"]: r["top_3gram"] for r in quality.quality_stats(df).collect()}
    b = {r["doc_id"]: r["x"] for r in quality.top_ngram_share(df, 3, "x").collect()}
    assert all(a[k] == pytest.approx(b.get(k, 0.0)) for k in a)


# --- ledger ---


def test_multisets(spark):
    a = ledger.histogram(docs(spark, "aab c"), ["doc_id"])
    b = ledger.histogram(docs(spark, "a b\nd"), ["doc_id"])
    assert rows(ledger.difference(a, b, ["doc_id"]), "ch") == [(0, "a", 1), (0, "c", 1)]
    assert rows(ledger.changed(a, b, ["doc_id"]), "ch") == [(0, "a", 1, 0), (0, "c", 1, 0), (0, "d", 0, 1)]
    assert rows(ledger.union(["doc_id"], a, b), "ch") == [(0, "a", 3), (0, "b", 2), (0, "c", 1), (0, "d", 1)]
    assert rows(ledger.total(a, ["doc_id"])) == [(0, 4)]


def test_budgets_and_missing_units(spark):
    e = spark.createDataFrame([("s1", "PageNumber", False, 10), ("s1", "PageNumber", True, 4), ("s2", "Dehyphenate", False, 1), ("s2", "Ocr", True, 50)], "stage string, reason string, added boolean, chars bigint")
    assert rows(ledger.replay(e), "stage", "reason") == [("s1", "PageNumber", 6, 6), ("s2", "Dehyphenate", 1, 1), ("s2", "Ocr", 0, 0)]
    out = {r["budget_group"]: r for r in ledger.budget_check(e, F.lit(100.0), {"furniture": 0.05, "dehyphenate": 0.02}).collect()}
    assert not out["furniture"]["ok"] and out["dehyphenate"]["ok"] and out["global"]["net"] == 7
    a = docs(spark, "x  y", "x y", "z").select("text")
    assert rows(ledger.missing_from(a, docs(spark, "x\ny").select("text"), []), "text") == [("x y", 1), ("z", 1)]


def test_overlap_grid_finds_each_pair_once(spark):
    rng = random.Random(1)
    boxes = [(i, i % 2, *(lambda x, y: (x, y, x + rng.random() * 3, y + rng.random() * 3))(rng.uniform(-5, 5), rng.uniform(-5, 5))) for i in range(60)]
    df = spark.createDataFrame([(i, p, (a, b, c, d)) for i, p, a, b, c, d in boxes], "id bigint, page bigint, rect struct<x0:double,y0:double,x1:double,y1:double>")
    want = sorted((p, i, j) for i, p, a, b, c, d in boxes for j, q, e, f, g, h in boxes if i < j and p == q and a < g and e < c and b < h and f < d)
    assert rows(ledger.overlapping(df, 1.0, ["page"]), "page", "id_a", "id_b") == want


# --- metrics ---


def test_wilson(spark):
    low, high = metrics.wilson(F.lit(95), F.lit(100))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (r["l"], r["h"]) == pytest.approx((0.8882, 0.9785), abs=1e-4)
    low, high = metrics.wilson(F.lit(0), F.col("id"))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 0.0)


def test_mcnemar(spark):
    pairs = [(1, 0)] * 8 + [(0, 1)] * 2 + [(1, 1)] * 30
    r = metrics.mcnemar(spark.createDataFrame([("k", *p) for p in pairs], "k string, a int, b int"), ["k"], "a", "b").first()
    assert (r["b"], r["c"], r["exact"]) == (8, 2, True) and r["p_exact"] == pytest.approx(0.109375)
    many = [(1, 0)] * 40 + [(0, 1)] * 20
    r = metrics.mcnemar(spark.createDataFrame([("k", *p) for p in many], "k string, a int, b int"), ["k"], "a", "b").withColumn("p", metrics.chi_square_p("chi2")).first()
    assert r["chi2"] == pytest.approx(19 * 19 / 60) and r["p"] == pytest.approx(0.01419, abs=1e-4)


def test_prf(spark):
    df = lambda *w: spark.createDataFrame([("k", x) for x in w], "k string, w string")
    r = metrics.prf(df("a", "a", "b"), df("a", "b", "c", "c"), ["k"], "w").first()
    assert (r["matched"], r["precision"], r["recall"]) == (2, 0.5, pytest.approx(2 / 3))


def test_kendall_tau_against_pairs(spark):
    rng = random.Random(3)
    items = [(g, i, rng.randrange(12)) for g in "ab" for i in range(40)] + [("c", 0, 1)]
    want = {}
    for g in "abc":
        own = [(x, y) for k, x, y in items if k == g]
        s = sum((a > c) - (a < c) == (b > d) - (b < d) and b != d for a, b in own for c, d in own) - sum((a > c) - (a < c) == (b < d) - (b > d) and b != d for a, b in own for c, d in own)
        want[g] = 1.0 if len(own) < 2 else s / (len(own) * (len(own) - 1))
    got = metrics.kendall_tau(spark.createDataFrame(items, "k string, x bigint, y bigint"), ["k"])
    assert {r["k"]: pytest.approx(r["tau"]) for r in got.collect()} == want


def test_calibration_and_curve(spark):
    o = spark.createDataFrame([(0.05, True), (0.95, True), (1.0, False), (0.9, True)], "confidence double, correct boolean")
    assert rows(metrics.reliability(o, []), "bin")[0][:2] == (0, 1) and rows(metrics.reliability(o, []), "bin")[1][1] == 3
    curve = metrics.risk_coverage(o, [], "confidence")
    assert [r[1:3] for r in rows(curve, F.desc("confidence"))] == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert tuple(metrics.threshold_for(curve, [], 0.34).first()) == (0.05, 1.0)
    assert metrics.threshold_for(curve, [], 0.1).first()[0] is None


# --- furniture, paragraphs ---


def test_running_heads(spark):
    pages = spark.createDataFrame([("b", p) for p in range(1, 31)], "book string, page bigint")
    lines = [("b", p, "top", "Title") for p in range(1, 31)] + [("b", p, "top", "Even") for p in range(2, 31, 2)] + [("b", p, "top", "Window") for p in range(8, 26)] + [("b", p, "top", "Rare") for p in (3, 4)]
    out = {r["key"]: r for r in furniture.repetition_evidence(spark.createDataFrame(lines, "book string, page bigint, band string, key string"), pages).collect()}
    assert (out["Title"]["decision"], out["Title"]["ratio"]) == ("furniture", 1.0)
    assert (out["Even"]["decision"], out["Even"]["scope"]) == ("furniture", "even")
    assert (out["Window"]["decision"], out["Window"]["scope"], out["Window"]["ratio"]) == ("furniture", "window", pytest.approx(18 / 20))
    assert out["Rare"]["decision"] == "text"


def test_folios_and_progressions(spark):
    r = spark.createDataFrame([("b", p, "arabic", p + 10) for p in range(1, 9)] + [("b", 9, "arabic", 3), ("b", 10, "arabic", 99)], "book string, page bigint, system string, value bigint")
    assert rows(furniture.folio_constants(r))[0][2:4] == (10, 8)
    p = spark.createDataFrame([("a", 1, 3), ("a", 2, 5), ("a", 3, 7), ("b", 1, 1), ("b", 1, 2), ("b", 2, 3), ("c", 1, 1), ("c", 2, 1)], "book string, page bigint, value bigint")
    assert rows(furniture.progression(p), "book") == [("a", 2), ("b", None), ("c", None)]


def test_continuity(spark):
    p = spark.createDataFrame([("b", 1, "x", "in the middle of a"), ("b", 2, "sentence, and", "done."), ("b", 3, "new", "end"), ("c", 1, "a", "b")], "book string, page bigint, first string, last string")
    assert rows(furniture.continuity(p), "book") == [("b", 2, 1, 0.5), ("c", 0, 0, 1.0)]


def test_dehyphenation_tiers(spark):
    text = "The pipeline ran. A co-op met pre- and post-war. function functional the the the and and and " + "word " * 5
    t = paragraphs.book_tokens(docs(spark, text).withColumn("book", F.lit("b")), "book")
    words, style = paragraphs.lexicon(paragraphs.word_uses(t)), paragraphs.book_style(paragraphs.word_uses(t))
    breaks = spark.createDataFrame([("b", *x) for x in [("pipe", "line"), ("co", "op"), ("mid", "and"), ("func", "tionary"), ("ab", "3"), ("xy", "Zed"), ("qq", "rr")]], "book string, head string, tail string")
    low = Thresholds(function_word_rank=2)
    out = {r["head"]: (r["tier"], r["decision"]) for r in paragraphs.dehyphenate(breaks, words, style, paragraphs.suspended_words(t), paragraphs.function_words(words, low)).collect()}
    assert out == {"pipe": ("document", "join"), "co": ("document", "keep"), "mid": ("suspended", "keep"), "func": ("stem", "join"), "ab": ("candidate", "keep"), "xy": ("candidate", "keep"), "qq": ("closed", "keep")}


def test_list_tier_and_hash(spark):
    t = paragraphs.book_tokens(docs(spark, "nothing here").withColumn("book", F.lit("b")), "book")
    common = spark.createDataFrame([("sunlight",), ("well",), ("known",)], "word string")
    breaks = spark.createDataFrame([("b", "sun", "light"), ("b", "well", "known")], "book string, head string, tail string")
    words = paragraphs.lexicon(paragraphs.word_uses(t))
    out = {r["head"]: (r["tier"], r["decision"]) for r in paragraphs.dehyphenate(breaks, words, paragraphs.book_style(paragraphs.word_uses(t)), paragraphs.suspended_words(t), paragraphs.function_words(words), common).collect()}
    assert out == {"sun": ("list", "join"), "well": ("list", "keep")}
    one = spark.range(1)
    assert one.select(T.fnv1a32(F.lit("")), T.fnv1a32(F.lit("a"))).first()[:] == (2166136261, 0xE40C292C)
    assert len(one.select(hyphens.features(F.lit("Haus"), F.lit("tür"), F.lit("de"))).first()[0]) == 14


# --- structure, layout, validation ---


def test_level_skips(spark):
    h = spark.createDataFrame([("d", i, n) for i, n in enumerate([3, 1, 3, 4, 2, 6, 6])], "doc string, at int, level int")
    assert [r["fixed"] for r in structure.remove_level_skips(h, "at").orderBy("at").collect()] == [1, 1, 2, 3, 2, 3, 4]


def test_style_tiers(spark):
    s = spark.createDataFrame([("d", 20.0, False), ("d", 19.0, False), ("d", 14.0, True), ("d", 14.0, False), ("d", 10.0, True)], "doc string, size double, bold boolean")
    assert [r[1:] for r in rows(structure.cluster_ranks(s), F.desc("size"), F.desc("bold"))] == [(20.0, False, 1), (19.0, False, 1), (14.0, True, 2), (14.0, False, 3), (10.0, True, 3)]


def test_packing_pieces_into_files(spark):
    p = spark.createDataFrame([("d", i, b) for i, b in enumerate([5, 6, 3, 9, 2])], "doc string, at int, bytes bigint")
    assert rows(structure.pack(p, 10), "file") == [("d", 0, 1, 5), ("d", 1, 2, 9), ("d", 2, 1, 9), ("d", 3, 1, 2)]


def test_notes_are_linked_once(spark):
    m = spark.createDataFrame([(1, "1", 10), (1, "*", 11), (2, "2", 12), (1, "1", 13)], "page int, marker string, id bigint")
    n = spark.createDataFrame([(1, "1", 20), (1, "*", 21), (3, "2", 22), (3, "x", 23)], "page int, marker string, id bigint")
    assert sorted((r["note_id"], r["marker_id"], r["pass"]) for r in structure.link_notes(m, n).collect()) == [(20, 10, 1), (21, 11, 1), (22, 12, 2)]


def test_captions(spark):
    box = "page int, id bigint, rect struct<x0:double,y0:double,x1:double,y1:double>"
    images = spark.createDataFrame([(1, 1, (0.0, 0.0, 10.0, 10.0)), (1, 2, (100.0, 0.0, 110.0, 10.0))], box)
    captions = spark.createDataFrame([(1, 7, (0.0, 11.0, 10.0, 12.0)), (1, 8, (0.0, 12.0, 10.0, 13.0)), (1, 9, (500.0, 0.0, 501.0, 1.0))], box)
    assert rows(structure.associate_captions(images, captions, 4.0)) == [(1, 7, 1, 1.0)]


def test_arabic_reset_and_ladder(spark):
    pages = spark.createDataFrame([("a", i, x) for i, x in enumerate(["i", "ii", "iii", "1", "2"])] + [("b", i, str(i + 1)) for i in range(5)], "doc string, page int, label string")
    assert rows(structure.arabic_reset(pages), "doc") == [("a", 3), ("b", None)]
    v = spark.createDataFrame([("k", x) for x in (0.0, 2.0, 4.0, 5.0, 9.0)], "key string, value double")
    assert structure.snapped(v).first()["values"] == [0.0, 4.0, 9.0]


def test_geometry(spark):
    assert layout.two_means_threshold([0.1, 0.1, 0.2, 3.0, 3.1]) == pytest.approx(1.59, abs=0.02)
    assert layout.two_means_threshold([1.0, 1.0]) is None and layout.two_means_threshold([]) is None
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 4.0, 1.0), (1, 2, 6.0, 0.0, 10.0, 1.0), (1, 3, 0.0, 2.0, 4.0, 3.0), (1, 4, 6.0, 2.0, 10.0, 3.0), (1, 5, 0.0, 20.0, 10.0, 21.0)], "page int, id bigint, x0 double, y0 double, x1 double, y1 double")
    assert [r["id"] for r in layout.reading_order(b, 0.5, 0.5).orderBy("reading_index").collect()] == [1, 3, 2, 4, 5]
    assert [r["id"] for r in layout.reading_order(b, 5.0, 0.5).orderBy("reading_index").collect()] == [1, 2, 3, 4, 5]
    assert sorted(r["reading_index"] for r in layout.reading_order(b, 99.0, 99.0).collect()) == [0, 1, 2, 3, 4]
    lines = spark.createDataFrame([(1, i, 0.0, float(y), 10.0, y + 1.0) for i, y in enumerate([0, 2, 4, 20, 22])], "page int, id bigint, x0 double, y0 double, x1 double, y1 double")
    assert [r["block"] for r in layout.docstrum_groups(lines).orderBy("id").collect()] == [0, 0, 0, 3, 3]
    items = spark.createDataFrame([(1, i, y, 10.0) for i, y in enumerate([100.0, 101.0, 120.0])], "page int, id bigint, baseline double, size double")
    assert [r["line"] for r in layout.cluster_baselines(items).orderBy("id").collect()] == [0, 0, 1]


def test_space_thresholds_do_not_depend_on_the_size(spark):
    counts = {0.1: 900, 1.0: 90, 2.0: 90, 5.0: 300}
    gaps = spark.createDataFrame([*counts.items()], "gap double, n int")
    want = layout.two_means_threshold([g for g, n in counts.items() for _ in range(n)])
    for times in (1, 10, 50):
        repeated = gaps.select(F.lit("a").alias("key"), "gap", F.explode(F.sequence(F.lit(1), F.col("n") * times)))
        row = layout.space_thresholds(repeated, ["key"]).first()
        assert row["n"] == 1380 * times and row["threshold"] == pytest.approx(want)
    assert layout.two_means_threshold([0.1, 3.0], counts=[10**12, 1]) == pytest.approx(1.55)


def test_classes(spark):
    cases = [((100, 0, 0.9, 100), "OcrSandwich"), ((5, 0, 0.9, 0), "ImageOnly"), ((0, 0, 0.0, 0), "Blank"), ((100, 30, 0.0, 0), "BrokenText"), ((100, 0, 0.0, 0), "Text"), ((30, 0, 0.7, 0), "Mixed"), ((100, 0, 0.7, 0), "Mixed")]
    df = spark.createDataFrame([c for c, _ in cases], "v int, b int, a double, h int")
    assert [r["x"] for r in df.select(validate.classify_page(F.col("v"), F.col("b"), F.lit(None).cast("double"), F.col("a"), F.col("h")).alias("x")).collect()] == [w for _, w in cases]
    kinds = spark.createDataFrame([(0.96, 100.0, 100.0), (0.1, 900.0, 100.0), (0.1, 40.0, 40.0), (0.2, 200.0, 100.0)], "r double, w double, h double")
    assert [r["x"] for r in kinds.select(validate.classify_image(F.col("r"), F.col("w"), F.col("h")).alias("x")).collect()] == ["background", "strip", "ornament", "figure"]
    pages = spark.createDataFrame([("d", p) for p in range(10)], "doc string, page int")
    images = spark.createDataFrame([("d", p, "h1") for p in range(4)] + [("d", 1, "h2"), ("d", 1, None)], "doc string, page int, hash string")
    assert sorted(str(r["hash"]) for r in validate.drop_ornaments(images, pages).collect()) == ["None", "h2"]


def test_findings(spark):
    f = spark.createDataFrame([("p1", "a", "warning"), ("p1", "b", "fatal"), ("p2", "c", "error"), ("p2", "a", "error")], "location string, id string, severity string")
    assert rows(validate.plan_repairs(f, {"a": "fix-a", "b": "fix-b", "c": None}), "location") == [("p1", "b", "fatal", "fix-b"), ("p2", "a", "error", "fix-a")]
    r, n = (spark.createDataFrame([(x,) for x in xs], "target string") for xs in (["n1", "n1", "n9"], ["n1", "n2"]))
    assert rows(validate.bijection(r, n), "target") == [("n1", 2, "repeated"), ("n2", 0, "unused"), ("n9", 1, "missing")]
    e = spark.createDataFrame([("d", "en", "1", 4, True), ("d", "en", "2", 4, True), ("d", "en", "3", 4, False), ("e", "xx", "1", 4, True)], "doc string, lang string, task string, demand int, fired boolean")
    assert [r["granted"] for r in validate.escalations(e, ["en"], 6).orderBy("doc", "task").collect()] == [4, 2, 0, 0]


# --- sources, streaming ---


def test_ocr_table_and_blocks(spark, tmp_path):
    head = "\t".join(readers.TSV_HEADER)
    (tmp_path / "a.tsv").write_text(f"{head}\n5\t1\t1\t1\t1\t1\t72\t144\t36\t18\t96.5\tword\n5\t1\t1\t1\t1\t2\t0\t0\t1\t1\t-1\tx\n4\t1\t1\t1\t1\t0\t0\t0\t1\t1\t50\t\n")
    (r,) = readers.ocr_words(spark, str(tmp_path / "a.tsv"), 144).collect()
    assert (r["text"], r["x0"], r["y0"], r["x1"], r["confidence"]) == ("word", 36.0, 72.0, 54.0, 0.965)
    (tmp_path / "b.tsv").write_text("wrong\theader\n1\t2\n")
    with pytest.raises(Exception):
        readers.ocr_words(spark, str(tmp_path / "b.tsv"), 72).collect()
    html = "<html><title>T</title><script>no</script><h2>Head <b>x</b></h2><p>one<br>two<p>three &amp; four</body>"
    assert readers.blocks_of(html) == [("title", None, "T"), ("h2", 2, "Head x"), ("p", None, "one two"), ("p", None, "three & four")] and readers.blocks_of(None) == []


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    df = spark.range(2000).selectExpr("timestamp_seconds(id * 60) ts", "if(id % 3 = 0, 'a', 'b') event_type", "cast(id as double) value")
    last = spark.sql("select timestamp_seconds(10000000) ts, 'end' event_type, 0d value")
    source = f"{tmp_path}/in"
    df.coalesce(1).write.parquet(source)
    events.run_windowed(spark, source, schema, "6 hours", f"{tmp_path}/out", f"{tmp_path}/state")
    last.coalesce(1).write.mode("append").parquet(source)  # moves the watermark past all windows
    for _ in range(2):
        events.run_windowed(spark, source, schema, "6 hours", f"{tmp_path}/out", f"{tmp_path}/state")
    want = rows(events.windowed_counts(df.withColumnRenamed("event_type", "stage"), "6 hours"), "stage", "begin")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "stage", "begin") == want and len(want) == 12


def test_sequences_and_heartbeats(spark):
    e = spark.createDataFrame([("j", 1, 0), ("j", 2, 5), ("j", 5, 20)], "job string, seq bigint, s bigint").selectExpr("job", "seq", "timestamp_seconds(s) ts")
    assert rows(events.sequence_gaps(e)) == [("j", 2, 2)]
    assert rows(events.heartbeat_gaps(e)) == [("j", 3, 1, 15.0)]
    assert [r["n"] for r in events.sessions(e, "6 seconds").orderBy("begin").collect()] == [2, 1]
