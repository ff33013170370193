"""Queries on lines, blocks and columns: a document's lines stand for a laid-out book, vectors for boxes of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import columns, furniture, paragraph_plan
from scriptorium.plans.registry import registry
from scriptorium.plans.text_queries import LINES, RECTS_SQL, rects, rounded
from scriptorium.sources.readers import document_lines, table

QUERIES, ORACLE_SQL, query = registry()

LINES_SQL = f"""l0 as (select doc_id as doc, i - 1 as pos, lines[i] as text, length(lines[i]) as n from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, {LINES.format(t="text")} as lines from documents))),
l as (select doc, doc * 100000 + pos // 30 as page, doc * 100000 + pos // 6 as block, case when doc % 2 = 0 then pos // 6 % 2 else 0 end as col, pos, text, case when n % 9 = 0 then 12.0 else 0.0 end as x0, case when n % 9 = 0 then 12.0 else 0.0 end + least(n, 90) * 5.0 as x1,
 pos * 12.0 + case when n % 8 = 0 then 9.0 else 0.0 end as baseline, case when n % 13 = 0 then 14.0 else 10.0 end as size from l0),
ems as (select page, list_sort(list(round(size * 100)))[count(*) // 2 + 1] / 100 as em from l group by page),
boxes as (select block, min(x0) as b0, max(x1) as b1, count(*) as lines from l group by block),
m as (select l.*, lines, em, row_number() over (partition by l.block order by pos) as place, x0 - b0 as indent, b1 - x1 as right_gap, least(greatest((x1 - b0) / greatest(b1 - b0, 1.0), 0.0), 1.0) as fill from l join boxes using (block) join ems using (page)),
conv as (select doc, avg(case when indent >= em then 1.0 else 0.0 end) >= 0.05 as indents from m group by doc),
gaps as (select block, gap, floor(gap + 0.5) as bucket from (select block, baseline - lag(baseline) over (partition by block order by pos) as gap from l) where gap > 0),
ldg as (select block, mean as lead_ing from (select block, bucket, avg(gap) as mean, row_number() over (partition by block order by count(*) desc, bucket) as r from gaps group by block, bucket) where r = 1)"""


def book_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = document_lines(table(spark, d, "documents")).selectExpr("doc_id doc", "cast(line_no as bigint) at", "line text", "length(line) n")
    rows = rows.selectExpr(
        "doc", "doc * 100000 + at div 30 page", "doc * 100000 + at div 6 block", "if(doc % 2 = 0, at div 6 % 2, 0) column", "at", "text", "if(n % 9 = 0, 12.0D, 0.0D) x0", "if(n % 9 = 0, 12.0D, 0.0D) + least(n, 90) * 5.0D x1",
        "at * 12.0D + if(n % 8 = 0, 9.0D, 0.0D) baseline", "if(n % 13 = 0, 14.0D, 10.0D) size",
    )
    return rows.withColumns({"y0": F.col("baseline") - F.col("size"), "y1": F.col("baseline")})


@query(f"with {LINES_SQL} select block, round(lead_ing, 6) as \"leading\" from ldg")
def modal_leadings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(paragraph_plan.modal_leadings(book_lines(spark, d)), "leading")


@query(f"with {LINES_SQL} select doc, indents from conv")
def paragraph_conventions(spark: SparkSession, d: str) -> DataFrame:
    return paragraph_plan.conventions(paragraph_plan.measured(book_lines(spark, d)))


STARTS_SQL = f"""{LINES_SQL}, w as (select m.*, indents, lead_ing, baseline - lag(baseline) over o as gap, lag(fill) over o as was_fill, lag(size) over o as was_size from m join conv using (doc) left join ldg using (block) window o as (partition by block order by pos)),
starts as (select doc, block, pos, place > 1 and ((indents and indent >= em) or coalesce(lead_ing > 0 and gap > lead_ing * 1.5, false) or was_fill < 0.45 or abs(was_size - size) / greatest(was_size, size) > 0.15) as starts from w)"""


@query(f"with {STARTS_SQL} select doc, block, pos as \"at\" from starts where starts")
def paragraph_starts(spark: SparkSession, d: str) -> DataFrame:
    return paragraph_plan.paragraph_starts(paragraph_plan.measured(book_lines(spark, d))).where("starts").select("doc", "block", "at")


OPEN = "regexp_matches(regexp_replace(regexp_replace({a}, '[\\s]+$', ''), '[\"''”’»«)\\]}}」]+$', ''), '[^.!?…。！？؟]$') and regexp_matches({b}, '^\\s*[\\p{{Ll}}\\p{{Lo}}]')"
CARRY_SQL = f"""{LINES_SQL}, b as (select doc, page, col, block, any_value(lines) as lines, min(pos) as h_at, arg_min(text, pos) as h_text, arg_min(size, pos) as h_size, arg_min(fill, pos) as h_fill, arg_min(indent, pos) as h_indent, any_value(em) as em,
  arg_min((x1 - x0) * length(regexp_extract(text, '^\\s*(\\S+)', 1)) / length(text), pos) as word, max(pos) as l_at, arg_max(text, pos) as l_text, arg_max(size, pos) as l_size, arg_max(fill, pos) as l_fill, arg_max(right_gap, pos) as l_gap from m group by doc, page, col, block),
here as (select a.block, min(c.h_at) as pos from b a join b c on a.page = c.page and c.h_at > a.l_at and abs(a.l_size - c.h_size) / greatest(a.l_size, c.h_size) <= 0.15 group by a.block),
nxt as (select page - 1 as page, min(h_at) as pos from b group by page),
pick as (select a.*, coalesce(here.pos, nxt.pos) as next_at, here.pos is not null as same from b a left join here on here.block = a.block left join nxt on nxt.page = a.page),
j as (select p.*, c.block as n_block, c.lines as n_lines, c.h_text as n_text, c.h_size as n_size, c.h_fill as n_fill, c.h_indent as n_indent, c.em as n_em, c.word as n_word, c.col as n_col, indents from pick p join b c on c.doc = p.doc and c.h_at = p.next_at join conv on conv.doc = p.doc
  where (same and c.col <> p.col) or (not same and c.page = p.page + 1 and abs(p.l_size - c.h_size) / greatest(p.l_size, c.h_size) <= 0.15)),
k as (select *, regexp_matches(l_text, '[-‐]\\s*$') as hyphen from j),
carry as (select doc, n_block as block, arg_max(block, l_at) as carried_from from k where (l_fill >= 0.45 or hyphen) and not (n_lines > 1 and n_indent >= n_em) and (hyphen or not (n_word > 0 and l_gap > n_word + greatest(l_size, n_size) * 0.3))
  and (hyphen or ({OPEN.format(a="l_text", b="n_text")}) or (indents and n_lines > 1 and n_fill >= 0.45 and regexp_matches(n_text, '^\\s*[^\\p{{N}}\\s]'))) group by doc, n_block)"""


@query(f"with {CARRY_SQL} select doc, block, carried_from from carry")
def paragraph_carries(spark: SparkSession, d: str) -> DataFrame:
    return paragraph_plan.carry_overs(paragraph_plan.measured(book_lines(spark, d)))


@query()
def paragraph_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole paragraphs: a fold over a document's lines; the tests hold it against known ones."""
    lines = book_lines(spark, d)
    rows = paragraph_plan.measured(lines)
    out = paragraph_plan.paragraphs(lines, paragraph_plan.paragraph_starts(rows), paragraph_plan.carry_overs(rows))
    return out.select("doc", "para", "first_page", "last_page", F.size("blocks").alias("blocks"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


HYPHENED_SQL = f"""{CARRY_SQL.replace("lines[i] as text, length(lines[i]) as n", "case when (i - 1) % 9 = 4 then regexp_replace(lines[i], '[^\\p{L}\\p{N}]+$', '') || '-' else lines[i] end as text, length(lines[i]) as n")},
w as (select m.*, indents, lead_ing, baseline - lag(baseline) over o as gap, lag(fill) over o as was_fill, lag(size) over o as was_size from m join conv using (doc) left join ldg using (block) window o as (partition by block order by pos)),
starts as (select doc, block, pos, place > 1 and ((indents and indent >= em) or coalesce(lead_ing > 0 and gap > lead_ing * 1.5, false) or was_fill < 0.45 or abs(was_size - size) / greatest(was_size, size) > 0.15) as starts from w),
f as (select doc, block, arg_min(text, pos) as head_text from l group by all),
n as (select s.doc, s.block, s.pos, l.text, lead(starts) over o as next_starts, lead(l.text) over o as next_text, lead(s.pos) over o is null as ends from starts s join l using (doc, block, pos) window o as (partition by s.block order by s.pos)),
a as (select n.doc, n.pos, n.text, case when ends then f.head_text when not next_starts then next_text end as after from n left join carry c on c.carried_from = n.block left join f on f.block = c.block)"""


@query(f"with {HYPHENED_SQL} select doc, pos as \"at\", regexp_extract(text, '([\\p{{L}}\\p{{N}}]+)[-‐]\\s*$', 1) as head, regexp_extract(after, '^\\s*([\\p{{L}}\\p{{N}}]+)', 1) as tail from a where regexp_matches(text, '[\\p{{L}}\\p{{N}}][-‐]\\s*$') and regexp_matches(after, '^\\s*[\\p{{L}}\\p{{N}}]')")
def hyphened_breaks(spark: SparkSession, d: str) -> DataFrame:
    lines = book_lines(spark, d).withColumn("text", F.when(F.col("at") % 9 == 4, F.concat(F.regexp_replace("text", r"[^\p{L}\p{N}]+$", ""), F.lit("-"))).otherwise(F.col("text")))
    rows = paragraph_plan.measured(lines)
    return paragraph_plan.line_breaks(lines, paragraph_plan.paragraph_starts(rows), paragraph_plan.carry_overs(rows))


# --- furniture ---

PAGE_SQL = f"{LINES_SQL}, f as (select doc // 25 as book, doc as page, pos as line, text, x0, x1, baseline, size, baseline - size as y0, baseline as y1 from l)"


def furniture_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = book_lines(spark, d).selectExpr("doc div 25 book", "doc page", "at line", "text", "x0", "y0", "x1", "y1", "baseline", "size")
    return lines, lines.select("book", "page").distinct().withColumn("height", F.lit(800.0))


@query(f"""with {PAGE_SQL}, bs as (select book, size as body from (select book, size, row_number() over (partition by book order by sum(length(text)) desc, size desc) as r from f group by book, size) where r = 1),
g as (select f.*, body, lead(text) over (partition by f.book, page order by line) as next, count(*) over (partition by f.book, page) as of_page, case when y1 <= 64 then 'top' when y0 >= 736 then 'bottom' end as band,
  regexp_replace(regexp_replace(replace(lower(text), '#', ' '), '\\p{{N}}+', '#', 'g'), '[^\\p{{L}}#]', '', 'g') as key from f join bs using (book))
select book, page, line, band, key, of_page = 1 as sole, abs(size - body) <= 0.05 * body and not regexp_matches(text, '[.!?…。！？؟]\\s*$') and coalesce(regexp_matches(next, '^\\s*\\p{{Ll}}'), false) as goes_on from g where band is not null and key <> ''""")
def furniture_candidates(spark: SparkSession, d: str) -> DataFrame:
    return furniture.candidates(*furniture_lines(spark, d)).select("book", "page", "line", "band", "key", "sole", "goes_on")


def headed_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same with a running head over each page and a number under it, now and then misread."""
    lines, pages = furniture_lines(spark, d)
    head = pages.selectExpr("book", "page", "-1L line", "if(page % 25 = 7, 'A Treatise on Thlngs', 'A Treatise on Things') text", "0.0D x0", "10.0D y0", "100.0D x1", "20.0D y1", "20.0D baseline", "8.0D size")
    foot = pages.selectExpr("book", "page", "1000000L line", "if(page % 25 = 9, 'l' || page % 9, cast(page % 25 + 12 as string)) text", "0.0D x0", "780.0D y0", "20.0D x1", "790.0D y1", "790.0D baseline", "10.0D size")
    body = lines.withColumns({"y0": F.col("y0") + 100, "y1": F.col("y1") + 100}).where("y1 < 730")
    return body.unionByName(head).unionByName(foot), pages


# what the planted heads and numbers must come out as, whatever the greedy folds do with the rest: books of few pages have none
@query(f"""with {PAGE_SQL}, p as (select book, page, count(*) over (partition by book) as n from (select distinct book, page from f)) select book, page, cast(-1 as bigint) as line, 'running_head' as kind from p where n >= 20 union all select book, page, 1000000, 'page_number' from p where n >= 20""")
def furniture_verdicts(spark: SparkSession, d: str) -> DataFrame:
    lines, pages = headed_lines(spark, d)
    large = pages.groupBy("book").count().where("count >= 20").select("book")
    return furniture.detect_furniture(lines, pages).where("line in (-1, 1000000)").join(large, "book", "left_semi").select("book", "page", "line", "kind")


@query(f"""with {PAGE_SQL}, v as (select *, case when line = 0 then 'RunningHeader' when line % 7 = 3 then 'PageNumber' end as reason from f), g as (select * from v where reason is not null)
select book, page, reason, cast(sum(length(text)) over (partition by book, page order by line) - length(text) as bigint) as start, cast(sum(length(text)) over (partition by book, page order by line) as bigint) as end, md5(text) as text_md5 from g""")
def furniture_ledger(spark: SparkSession, d: str) -> DataFrame:
    lines, _ = furniture_lines(spark, d)
    said = lines.where("line = 0 or line % 7 = 3").select("book", "page", "line", F.when(F.col("line") == 0, "running_head").otherwise("page_number").alias("kind"), F.lit("1").alias("label"))
    return furniture.apply_furniture(lines, said)[1].select("book", "page", "reason", "start", "end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# --- boxes ---

BOXES = "struct(rect.x0, rect.y0, rect.x1, rect.y1)"


def flat(spark: SparkSession, d: str) -> DataFrame:
    return rects(spark, d).select("page", "id", "rect.*")


@query(f"""with {RECTS_SQL}, p as (select a.id, a.x0, a.y0, a.x1, a.y1, b.x0 as u0, b.y0 as v0, b.x1 as u1, b.y1 as v1 from r a join r b on b.id = a.id + 1),
o as (select *, greatest(least(x1, u1) - greatest(x0, u0), 0.0) as ox, greatest(least(y1, v1) - greatest(y0, v0), 0.0) as oy from p)
select id, round(ox, 6) as across, round(oy, 6) as down, round(case when ox * oy > 0 then ox * oy / ((x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) - ox * oy) else 0 end, 6) as iou from o""")
def box_relations(spark: SparkSession, d: str) -> DataFrame:
    r = rects(spark, d)
    both = r.select("id", F.col("rect").alias("a")).join(r.select((F.col("id") - 1).alias("id"), F.col("rect").alias("b")), "id")
    a, b = F.col("a"), F.col("b")
    return rounded(both.select("id", columns.horizontal_overlap(a, b).alias("across"), columns.vertical_overlap(a, b).alias("down"), columns.intersection_over_union(a, b).alias("iou")), "across", "down", "iou")


@query(f"with {RECTS_SQL} select page, round(min(x0), 6) as x0, round(min(y0), 6) as y0, round(max(x1), 6) as x1, round(max(y1), 6) as y1 from r group by page")
def box_unions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(columns.union_of(flat(spark, d), ["page"]), "x0", "y0", "x1", "y1")


@query(f"with {RECTS_SQL}, h as (select page, list_sort(list(round((y1 - y0) * 1000 * 100))) as h from r group by page) select page, h[len(h) // 2 + 1] / 100 as em from h")
def median_heights(spark: SparkSession, d: str) -> DataFrame:
    big = flat(spark, d).withColumns({"y0": F.lit(0.0), "y1": (F.col("y1") - F.col("y0")) * 1000})
    return columns.median_heights(big)


@query(f"""with {RECTS_SQL}, s as (select page, id % 3 as grp, id as line, 10 + id % 4 as size, round(y0 * 100) as ky, round(x0 * 100) as kx from r), w as (select *, lag(size) over (partition by page, grp order by ky, kx, line) as was from s)
select page, grp as \"group\", line, cast(sum(case when was is not null and abs(was - size) / greatest(was, size) > 0.15 then 1 else 0 end) over (partition by page, grp order by ky, kx, line) as bigint) as part from w""")
def size_breaks(spark: SparkSession, d: str) -> DataFrame:
    lines = flat(spark, d).withColumns({"group": F.col("id") % 3, "size": 10 + F.col("id") % 4}).withColumnRenamed("id", "line")
    return columns.size_breaks(lines)


COLUMNS_SQL = "c as (select distinct page, 0 as col, -1.0 as c0, 0.0 as c1 from r union all select distinct page, 1, 0.01, 1.0 from r)"


def two_columns(boxes: DataFrame) -> DataFrame:
    one = F.struct(F.lit(0).alias("column"), F.lit(-1.0).alias("x0"), F.lit(0.0).alias("x1"))
    two = F.struct(F.lit(1).alias("column"), F.lit(0.01).alias("x0"), F.lit(1.0).alias("x1"))
    return boxes.select("page").distinct().select("page", F.inline(F.array(one, two)))


@query(f"""with {RECTS_SQL}, {COLUMNS_SQL}, o as (select r.page, id, col, greatest(least(x1 * 3, c1) - greatest(x0 * 3, c0), 0.0) as ov, greatest(least(x1 * 3, c1) - greatest(x0 * 3, c0), 0.0) / greatest(c1 - c0, 1.0) >= 0.25 as within from r join c on c.page = r.page)
select page, id, col as \"column\", within > 1 as floats from (select page, id, col, row_number() over (partition by page, id order by ov desc, col) as k, count(*) filter (within) over (partition by page, id) as within from o) where k = 1""")
def column_assignment(spark: SparkSession, d: str) -> DataFrame:
    boxes = flat(spark, d).withColumns({"x0": F.col("x0") * 3, "x1": F.col("x1") * 3})
    return columns.assign_columns(boxes, two_columns(boxes))


@query(f"""with {RECTS_SQL}, {COLUMNS_SQL}, s as (select page, id // 4 as line, id % 4 as seg, x0, y0, x1, y1, 'w' || id as text from r), o as (select s.*, col, row_number() over (partition by s.page, line, seg order by greatest(least(x1, c1) - greatest(x0, c0), 0.0) desc, col) as k from s join c on c.page = s.page)
select page, line, col as \"column\", round(min(x0), 6) as x0, round(max(x1), 6) as x1, string_agg(text, ' ' order by seg) as text from o where k = 1 group by page, line, col""")
def line_splits(spark: SparkSession, d: str) -> DataFrame:
    s = flat(spark, d).select("page", F.expr("id div 4").alias("line"), (F.col("id") % 4).alias("seg"), *columns.BOX, F.concat(F.lit("w"), "id").alias("text"))
    return rounded(columns.split_lines(s, two_columns(s)).select("page", "line", "column", "x0", "x1", "text"), "x0", "x1")


@query(f"""with {RECTS_SQL}, i as (select * from r where id % 5 = 0), b as (select *, row_number() over (partition by page order by id) - 1 as reading_index from r where id % 5 <> 0)
select i.page, i.id as image, coalesce((select min(reading_index) from b where b.page = i.page and b.y0 >= i.y1), (select max(reading_index) + 1 from b where b.page = i.page), 0) as reading_index from i""")
def image_anchors(spark: SparkSession, d: str) -> DataFrame:
    r = flat(spark, d)
    b = r.where("id % 5 <> 0").withColumn("reading_index", F.expr("row_number() over (partition by page order by id) - 1"))
    return columns.anchor_images(r.where("id % 5 = 0"), b)


@query(f"""with {RECTS_SQL}, l as (select page, id as line, case when id % 6 = 0 then 'D' else 'text ' || id end as text, x0 * 100 as x0, y0 * 100 as y0, x1 * 100 as x1, y1 * 100 + case when id % 6 = 0 then 20 else 0 end as y1 from r),
h as (select page, list_sort(list(round((y1 - y0) * 100))) as h from l group by page), e as (select page, h[len(h) // 2 + 1] / 100 as em from h)
select distinct a.page, a.line, a.text from l a join e using (page) join l b on b.page = a.page and b.line <> a.line and b.x0 >= a.x1 and b.y1 > a.y0 and b.y0 < a.y1 where length(a.text) = 1 and em > 0 and a.y1 - a.y0 >= 2 * em""")
def drop_cap_lines(spark: SparkSession, d: str) -> DataFrame:
    r = flat(spark, d).selectExpr("page", "id line", "if(id % 6 = 0, 'D', 'text ' || id) text", "x0 * 100 x0", "y0 * 100 y0", "x1 * 100 x1", "y1 * 100 + if(id % 6 = 0, 20, 0) y1")
    return columns.drop_caps(r)


@query("""with a as (select p_partkey // 3 as doc, p_partkey % 3 as attempt, p_size / 50.0 as broken from part), r as (select doc, max(broken) filter (attempt = 0) as r0, max(broken) filter (attempt = 1) as r1, max(broken) filter (attempt = 2) as r2, min(attempt) as first from a group by doc)
select doc, case when r0 is not null and r0 > 0.3 and r1 < r0 then case when r1 > 0.3 and r2 < r1 then 2 else 1 end when r0 is null and r1 > 0.3 and r2 < r1 then 2 when r0 is null then first else 0 end as attempt from r""")
def column_retries(spark: SparkSession, d: str) -> DataFrame:
    rates = table(spark, d, "part").selectExpr("p_partkey div 3 doc", "p_partkey % 3 attempt", "p_size / 50.0 broken")
    return columns.column_retries(rates)


@query()
def page_columns(spark: SparkSession, d: str) -> DataFrame:
    return columns.detect_columns(flat(spark, d).selectExpr("page", "floor(abs(x0) * 3) * 200 x0", "(id % 20) * 14.0D y0", "floor(abs(x0) * 3) * 200 + 150.0D + x1 x1", "(id % 20) * 14.0D + 12 y1"))


@query()
def page_segments(spark: SparkSession, d: str) -> DataFrame:
    lines = flat(spark, d).selectExpr("page", "id", "0.0D x0", "(id % 20) * 14.0D + if(id % 20 > 7, 30, 0) y0", "100.0D + x1 x1", "(id % 20) * 14.0D + 12 + if(id % 20 > 7, 30, 0) y1", "if(id % 20 = 3, 20.0D, 10.0D) size")
    return rounded(columns.segment_blocks(lines), "agreement")


@query()
def white_rectangles(spark: SparkSession, d: str) -> DataFrame:
    lines = flat(spark, d).selectExpr("page", "if(id % 2 = 0, 0.0D, 120.0D) x0", "(id % 20) * 7.0D y0", "if(id % 2 = 0, 100.0D, 220.0D) x1", "(id % 20) * 7.0D + 10 y1")
    return columns.white_space(lines)
