"""Pages, glyphs, columns, paragraphs, furniture and tables on hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import columns, furniture, glyphs, headings, pages, paragraph_plan, tables


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def ink(x0, y0, x1, y1, step=14):
    return [(x0, y, x1, y + 10.0) for y in np.arange(y0, y1 - 9, step).tolist()]


@pytest.mark.parametrize(("turn", "want"), [(0, (10.0, 170.0, 30.0, 190.0)), (90, (10.0, 10.0, 30.0, 30.0)), (180, (70.0, 10.0, 90.0, 30.0)), (270, (170.0, 70.0, 190.0, 90.0))])
def test_rectangles_turn_with_the_page(spark, turn, want):
    crop = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("llx", 0), ("lly", 0), ("urx", 100), ("ury", 200))])
    rect = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("llx", 10), ("lly", 10), ("urx", 30), ("ury", 30))])
    assert tuple(spark.range(1).select(pages.rect_to_page(rect, crop, F.lit(turn)).alias("r")).first()["r"]) == want


def test_hash_sets_a_bit_for_each_bright_cell(spark):
    cells = [0.0] * 63 + [255.0]
    df = spark.createDataFrame([(cells,), ([1.0] * 64,)], "c array<double>")
    assert [r["h"] for r in df.select(pages.perceptual_hash(F.col("c")).alias("h")).collect()] == [-(1 << 63), -1]


def test_columns():
    two = np.array(ink(0, 0, 200, 400) + ink(230, 0, 430, 400))
    assert columns.column_bounds(two, 10) == [(0, 200), (230, 430)]
    assert columns.column_bounds(two, 10, 1) == [(0, 430)] and columns.column_bounds(np.array(ink(0, 0, 400, 300)), 10) == [(0, 400)]
    three = np.array(ink(0, 0, 100, 300) + ink(120, 0, 220, 300) + ink(260, 0, 360, 300))
    assert columns.column_bounds(three, 10, 2) == [(0, 220), (260, 360)]  # the wider valley stays
    assert columns.column_bounds(np.zeros((0, 4)), 10) == [(0, 0)]


def test_longest_free_window_against_all_windows():
    rng = np.random.default_rng(1)
    covered = rng.random((40, 60)) < 0.2
    first, size = columns.longest_free(covered, 0.0)
    for c in range(60):
        runs = [len(x) for x in "".join("x" if v else "." for v in covered[:, c]).split("x")]
        assert size[c] == max(runs) and not covered[first[c] : first[c] + size[c], c].any()


def test_blocks_and_white_space():
    b = np.array(ink(0, 0, 200, 100) + ink(0, 130, 200, 230))
    block, agreement = columns.page_blocks(b, np.full(len(b), 10.0))
    assert block.tolist() == [0] * 7 + [1] * 7 and agreement.tolist() == [1, 1]
    sizes = np.array([20.0] + [10.0] * 13)
    assert columns.page_blocks(b, sizes)[0].tolist() == [0] + [1] * 6 + [2] * 7
    white = columns.free_rectangles(b)
    assert white[0] == (0, 94, 200, 130) and all(w[0] == 0 and w[2] == 200 for w in white)
    assert columns.modal_distance([14, 14.2, 30, 30]) == pytest.approx(14.1)


def test_floating_blocks_go_back_where_they_stand():
    boxes = np.array([(0, 100, 90, 200), (110, 100, 200, 200), (0, 0, 200, 50), (110, 210, 200, 300)], float)
    cols = [(0.0, 90.0), (110.0, 200.0)]
    assert columns.insert_floating([0, 1, 3], boxes, 2, cols) == [2, 0, 1, 3]
    assert columns.insert_floating([], boxes, 2, cols) == [2]


def test_runs_and_lines(spark):
    g = [(1, 0, i, ch, float(x), 0.0, float(x) + 5, 10.0, 10.0, 0, size, 400, False) for i, (ch, x, size) in enumerate([("a", 0, 10.0), ("b", 6, 10.0), ("c", 20, 10.0), ("d", 26, 10.0), ("\x01", 27, 10.0)])]
    g.append((1, 0, 5, "2", 32.0, 0.0, 34.0, 4.0, 5.0, 0, 6.0, 400, False))
    df = spark.createDataFrame(g, "page int, line int, idx int, ch string, x0 double, y0 double, x1 double, y1 double, baseline double, font int, size double, weight int, italic boolean")
    kept, gone = glyphs.strip_control(df)
    assert rows(gone) == [(1, 4, 1)]
    out = glyphs.assemble_runs(kept, spark.createDataFrame([(0, 10.0, 3.0)], "font int, size double, threshold double")).orderBy("run").collect()
    assert [(r["text"], r["vertical"]) for r in out] == [("ab cd", "base"), ("2", "sup")]
    line = glyphs.assemble_lines(spark.createDataFrame(out)).first()
    assert line["text"] == "ab cd 2" and line["baseline"] == 10.0 and line["right_gap"] == 0


LINE = "doc int, page bigint, block bigint, column int, at bigint, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double"


def book(spark, *lines):
    out = []
    for at, (page, block, text, x0, x1) in enumerate(lines):
        out.append((1, page, block, 0, at, text, x0, at * 12.0, x1, at * 12.0 + 10, at * 12.0 + 10, 10.0))
    return spark.createDataFrame(out, LINE)


def test_paragraphs_run_on_over_a_page(spark):
    lines = book(spark, (1, 1, "An indented line that is full", 12.0, 100.0), (1, 1, "goes on and ends.", 0.0, 60.0), (1, 1, "Another one that is indented", 12.0, 100.0), (1, 1, "and is broken at the page's", 0.0, 100.0), (2, 2, "end, as lines are. Then", 0.0, 100.0), (2, 2, "it ends.", 0.0, 30.0), (2, 2, "A last one", 12.0, 80.0))
    rows_ = paragraph_plan.measured(lines)
    assert rows(paragraph_plan.conventions(rows_)) == [(1, True)]
    starts = paragraph_plan.paragraph_starts(rows_)
    assert [r["at"] for r in starts.where("starts").orderBy("at").collect()] == [2, 6]
    carried = paragraph_plan.carry_overs(rows_)
    assert rows(carried) == [(1, 2, 1)]
    out = paragraph_plan.paragraphs(lines, starts, carried).orderBy("para").collect()
    assert [(r["first_page"], r["last_page"], r["blocks"], r["text"]) for r in out] == [
        (1, 1, [1], "An indented line that is full goes on and ends."), (1, 2, [1, 2], "Another one that is indented and is broken at the page's end, as lines are. Then it ends."), (2, 2, [2], "A last one")
    ]


def test_hyphens_are_resolved_within_paragraphs(spark):
    lines = book(spark, (1, 1, "a well-", 0.0, 100.0), (1, 1, "known rail-", 0.0, 100.0), (2, 2, "way runs here and", 0.0, 100.0), (2, 2, "on", 0.0, 100.0))
    rows_ = paragraph_plan.measured(lines)
    starts, carried = paragraph_plan.paragraph_starts(rows_), paragraph_plan.carry_overs(rows_)
    breaks = paragraph_plan.line_breaks(lines, starts, carried)
    assert rows(breaks, "at") == [(1, 0, "well", "known"), (1, 1, "rail", "way")]
    decided = spark.createDataFrame([(1, "rail", "way", "join"), (1, "well", "known", "keep")], "book int, head string, tail string, decision string")
    glued, ledger = paragraph_plan.resolve_hyphens(breaks, decided)
    assert rows(glued) == [(1, 1)] and rows(ledger) == [(1, 1, "Dehyphenate", "-")]
    assert [r["text"] for r in paragraph_plan.paragraphs(lines, starts, carried, glued).collect()] == ["a well- known railway runs here and on"]


def test_furniture_of_a_book(spark):
    line = "book int, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double"
    data = []
    for p in range(12):
        head = "The Great Bo0k" if p == 5 else "The Great Book"
        data.append((1, p, 0, head, 0.0, 10.0, 80.0, 20.0, 20.0, 8.0))
        data += [(1, p, 1 + i, f"Sentence {'abcdefghijkl'[p]}{'abcdefghijkl'[i]} of the running text of this page.", 0.0, 100.0 + 20 * i, 300.0, 110.0 + 20 * i, 110.0 + 20 * i, 10.0) for i in range(5)]
        data.append((1, p, 9, "l9" if p == 7 else str(p + 12), 140.0, 780.0, 150.0, 790.0, 790.0, 8.0))
    df, pg = spark.createDataFrame(data, line), spark.createDataFrame([(1, p, 800.0) for p in range(12)], "book int, page int, height double")
    said = {(r["page"], r["line"]): (r["kind"], r["label"]) for r in furniture.detect_furniture(df, pg).collect()}
    assert all(said[p, 0] == ("running_head", None) for p in range(12)) and {k for k in said if k[1] not in (0, 9)} == set()
    assert all(said[p, 9] == ("page_number", str(p + 12)) for p in range(12))  # the misread one is put right by its neighbours
    kept, ledger, labels = furniture.apply_furniture(df, furniture.detect_furniture(df, pg))
    assert kept.count() == 60 and {r["reason"] for r in ledger.collect()} == {"RunningHeader", "PageNumber"}
    assert rows(labels, "page")[7] == (1, 7, "19")
    single = df.where("line = 0")  # a page never loses all that it has
    assert furniture.detect_furniture(single, pg).count() == 0


def test_rules_grids_and_cells():
    pieces = np.array([(0, 0, 50, 1), (52, 0, 100, 1), (0, 20, 100, 21), (0, 0, 1, 21)], float)
    joined = tables.join_collinear(pieces[:3], 3.0, 3.0)
    assert joined.tolist() == [[0, 0, 100, 1], [0, 20, 100, 21]]
    boxes = np.array([(0, 0, 50, 20), (50, 0, 100, 20), (300, 300, 320, 320)], float)
    assert len(tables.cell_edges(boxes, 3.0)) == 8  # the box that stands alone is no cell
    assert tables.snapped([3.0, 0.0, 1.0, 10.0], 3.0) == [0.0, 10.0] and tables.band_of([0, 10, 20], 10) == 0 and tables.band_of([0, 10], 11) is None


def test_tables_of_a_page(spark):
    v = [(1, 0.0, 20.0 * k, 200.0, 20.0 * k + 1, True) for k in range(4)] + [(1, 100.0 * k, 0.0, 100.0 * k + 1, 61.0, True) for k in range(3)]
    v += [(2, 0.0, 0.0, 200.0, 1.0, True), (2, 0.0, 200.0, 200.0, 201.0, True)]
    vec = spark.createDataFrame(v, "page int, x0 double, y0 double, x1 double, y1 double, is_rule boolean")
    r = [(1, 10 + i, 2 * i + j, f"c{i}{j}", 100.0 * j + 5, 20.0 * i + 5, 100.0 * j + 60, 20.0 * i + 15) for i in range(3) for j in range(2)]
    r += [(2, 30, i, f"prose that goes on and on {i}", 5.0, 20.0 * i + 10, 195.0, 20.0 * i + 20) for i in range(8)]
    runs = spark.createDataFrame(r, "page int, block int, at int, text string, x0 double, y0 double, x1 double, y1 double")
    out = rows(tables.extract_tables(vec, runs), "page", "row", "column")
    assert out == [(1, 0, i, j, f"c{i}{j}", True) for i in range(3) for j in range(2)]  # rules over prose are no table
    assert tables.extract_tables(vec, runs, spark.createDataFrame([(1, 11)], "page int, block int")).where("row = 1").collect()[0]["text"] == ""


def test_outline_is_bound_once_and_in_order(spark):
    c = [(1, 1, "Part One"), (2, 1, "Of the beginnings"), (3, 4, "The Middle"), (4, 4, "The Middle"), (5, 9, "The End")]
    cand = spark.createDataFrame([(1, b, b, p, t, b != 2) for b, p, t in c], "doc int, block int, at int, page int, text string, admissible boolean")
    e = [(0, "Part One Of the beginnings", 1, 1), (1, "The Midle", 2, None), (2, "The Middle", 2, None), (3, "The End", 1, 3), (4, "Nothing like it", 1, None)]
    ent = spark.createDataFrame([(1, *x) for x in e], "doc int, entry int, title string, level int, page int")
    assert [(r["entry"], r["block"]) for r in headings.bind(cand, ent).orderBy("entry", "block").collect()] == [(0, 1), (0, 2), (1, 3), (2, 4)]


def test_chapter_numbers(spark):
    pages_ = [(1, "1"), (4, "II"), (5, "not"), (8, "X1I"), (12, "4"), (13, "17"), (20, "5")]
    b = [(1, i, i, p, t, 200.0 if t != "not" else 50.0, 0.0, 1) for i, (p, t) in enumerate(pages_)]
    plain = [(1, 100 + p, 100 + p, 100 + p, "prose", 50.0, 0.0, 9) for p in range(12)]
    df = spark.createDataFrame(b + plain, "doc int, block int, at int, page int, text string, y0 double, space_above double, lines int")
    out = headings.chapter_openers(df, spark.createDataFrame([(1, 10.0)], "doc int, size double"))
    assert [r["text"] for r in out.orderBy("at").collect()] == ["1", "II", "X1I", "4", "5"]  # the misread III stands between 2 and 4
    assert headings.longest_run([1, 2, 2, 3, 9], [1, 2, 2, 5, 6], [True] * 5) == [0, 1, 3]
