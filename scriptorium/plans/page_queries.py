"""Queries on pages, images and glyphs made up from vectors, conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import glyphs, pages
from scriptorium.plans.registry import registry
from scriptorium.plans.text_queries import rounded
from scriptorium.sources.readers import table

QUERIES, ORACLE_SQL, query = registry()

E4 = "100 * cast(embedding[{0}] as double) as a, 100 * cast(embedding[{1}] as double) as b, 100 * cast(embedding[{2}] as double) as c, 100 * cast(embedding[{3}] as double) as d"
E_SPARK, E_DUCK = E4.format(0, 1, 2, 3), E4.format(1, 2, 3, 4)


def vectors(spark: SparkSession, d: str, *more: str) -> DataFrame:
    parts = [p.strip() for p in E_SPARK.split(", ")]
    return table(spark, d, "embeddings").selectExpr("vec_id", "label", *parts, *more)


@query(f"""with v as (select vec_id, {E_DUCK}, vec_id % 4 * 90 as rotate from embeddings),
p as (select vec_id, rotate, least(a, c) + 30 as l, greatest(a, c) + 30 as r, least(b, d) + 40 as bot, greatest(b, d) + 40 as top from v)
select vec_id, round(case rotate when 90 then bot when 180 then 90 - r when 270 then 120 - top else l end, 6) as x0, round(case rotate when 90 then l when 180 then bot when 270 then 90 - r else 120 - top end, 6) as y0,
 round(case rotate when 90 then top when 180 then 90 - l when 270 then 120 - bot else r end, 6) as x1, round(case rotate when 90 then r when 180 then top when 270 then 90 - l else 120 - bot end, 6) as y1 from p""")
def page_transforms(spark: SparkSession, d: str) -> DataFrame:
    crop = F.struct(F.lit(-30.0).alias("llx"), F.lit(-40.0).alias("lly"), F.lit(60.0).alias("urx"), F.lit(80.0).alias("ury"))
    rect = F.struct(F.least("a", "c").alias("llx"), F.least("b", "d").alias("lly"), F.greatest("a", "c").alias("urx"), F.greatest("b", "d").alias("ury"))
    out = vectors(spark, d).select("vec_id", pages.rect_to_page(rect, crop, F.col("vec_id") % 4 * 90).alias("r"))
    return rounded(out.select("vec_id", "r.*"), "x0", "y0", "x1", "y1")


@query(f"""with v as (select vec_id, {E_DUCK} from embeddings), s as (select vec_id, least(abs(a) * 5, abs(b) / 4) as thin, greatest(abs(a) * 5, abs(b) / 4) as long, abs(a) * 5 <= 48 and abs(b) / 4 <= 48 as small from v)
select vec_id, thin <= 3 and long >= 10 * greatest(thin, 1e-6) as rule, small as hashed from s""")
def rule_paths(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.abs("a") * 5, F.abs("b") / 4
    rect = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), w.alias("x1"), h.alias("y1"))
    return vectors(spark, d).select("vec_id", pages.is_rule(rect).alias("rule"), pages.needs_hash(w, h).alias("hashed"))


REFUSED = "p_partkey as page, p_partkey * 9000 as glyphs, p_size * 400 as width_px, p_size * 700 as height_px"


@query(f"with p as (select {REFUSED} from part) select page, 'glyphs' as \"limit\" from p where glyphs > 1000000 union all select page, 'pixels' from p where cast(width_px as bigint) * height_px > 100000000")
def refused_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.refused(table(spark, d, "part").selectExpr(*[x.strip() for x in REFUSED.split(", ")]))


@query("""with c as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as c from embeddings), m as (select vec_id, c, list_sum(c) / len(c) as mean from c),
h as (select vec_id, sum(case when c[i + 1] >= mean then cast(pow(2, i) as hugeint) else 0 end) as h from (select vec_id, c, mean, unnest(range(0, 64)) as i from m) group by vec_id)
select vec_id, cast(case when h >= cast(pow(2, 63) as hugeint) then h - cast(pow(2, 63) as hugeint) - cast(pow(2, 63) as hugeint) else h end as bigint) as hash from h""")
def image_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", pages.perceptual_hash(F.col("embedding").cast("array<double>")).alias("hash"))


# 64 components as the pixels of an image 16 wide and 4 high
@query("""with p as (select vec_id as image, i % 16 as x, i // 16 as y, 128 + 500 * cast(embedding[i + 1] as double) as r, 255.0 * (i % 3) / 2 as a from (select *, unnest(range(0, 64)) as i from embeddings)),
l as (select image, x, y, r * a / 255 + 255 * (1 - a / 255) as luma from p), c as (select unnest(range(0, 8)) as c),
cx as (select c as cx, c * 2 as x0, greatest((c + 1) * 2, c * 2 + 1) as x1 from c), cy as (select c as cy, c // 2 as y0, greatest((c + 1) // 2, c // 2 + 1) as y1 from c)
select image, cy * 8 + cx as cell, round(avg(luma), 6) as mean from l join cx on x >= x0 and x < x1 join cy on y >= y0 and y < y1 group by all""")
def cell_brightness(spark: SparkSession, d: str) -> DataFrame:
    px = table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "v"))
    v = 128 + 500 * F.col("v").cast("double")
    px = px.select("image", (F.col("i") % 16).alias("x"), F.floor(F.col("i") / 16).alias("y"), F.lit(16).alias("width"), F.lit(4).alias("height"), v.alias("r"), v.alias("g"), v.alias("b"), (255.0 * (F.col("i") % 3) / 2).alias("a"))
    out = pages.cell_means(px).select("image", F.posexplode("cells").alias("cell", "mean"))
    return rounded(out.withColumn("cell", F.col("cell").cast("bigint")), "mean")


SCAN = "cast(floor(doc_id / 50) as bigint) as doc, doc_id as page, n_chars as chars, case when doc_id % 3 = 0 then n_chars else 0 end as reader_chars, doc_id % 4 <> 0 and cast(floor(doc_id / 50) as bigint) % 2 = 0 or doc_id % 4 = 1 as background"


@query(f"""with p as (select {SCAN} from documents), b as (select doc, count(*) filter (chars >= 200) as t, count(*) filter (chars >= 200 and background) as k from p group by doc),
s as (select doc, page from p join b using (doc) where chars >= 200 and background and (k >= 0.5 * t or reader_chars >= 200)), i as (select doc, page, case when background then 'background' else 'figure' end as kind from p)
select i.doc, i.page, i.kind from i left join s on s.doc = i.doc and s.page = i.page where s.page is null or i.kind <> 'background'""")
def scan_images_dropped(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").selectExpr(*[x.strip() for x in SCAN.split(", ")])
    images = p.select("doc", "page", F.when(F.col("background"), "background").otherwise("figure").alias("kind"))
    return pages.drop_text_backgrounds(images, pages.scan_pages(p)).select("doc", "page", "kind")


KIND = "case when n_chars < 100 then 'Blank' when doc_id % 7 = 0 then 'ImageOnly' else 'Text' end"


@query(f"""with p as (select doc_id // 50 as doc, doc_id % 3 * 100.0 as width, n_chars as chars, {KIND} as class, case doc_id // 50 % 3 when 0 then 'auto' when 1 then 'novel' else 'academic' end as chosen from documents)
select doc, count(*) as pages, max(width) as widest, cast(sum(chars) as bigint) as chars, count(*) filter (class = 'Blank') as blank, count(*) filter (class = 'ImageOnly') as images, count(*) filter (class = 'Text') as text,
 case when any_value(chosen) <> 'auto' then any_value(chosen) when avg(case when class = 'ImageOnly' then 1.0 else 0.0 end) >= 0.15 then 'scanned' else 'novel' end as preset from p group by doc""")
def file_inspection(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").selectExpr("doc_id div 50 doc", "doc_id % 3 * 100.0D width", "n_chars chars", f"{KIND} class")
    count = lambda c: F.coalesce(F.try_element_at("classes", F.lit(c)), F.lit(0)).cast("bigint")
    out = pages.inspect(p).select("doc", "pages", "widest", "chars", count("Blank").alias("blank"), count("ImageOnly").alias("images"), count("Text").alias("text"))
    chosen = F.when(F.col("doc") % 3 == 0, "auto").when(F.col("doc") % 3 == 1, "novel").otherwise("academic")
    return out.withColumn("preset", pages.preset(chosen, F.when(F.col("images") / F.col("pages") >= 0.15, "scanned").otherwise("prose")))


@query(f"select doc_id // 50 as doc, {KIND} as class, count(*) as pages from documents group by all")
def page_class_histogram(spark: SparkSession, d: str) -> DataFrame:
    return pages.class_histogram(table(spark, d, "documents").selectExpr("doc_id div 50 doc", f"{KIND} class"))


CODE_SQL = "case split_part({t}, '-', 1) when 'de' then 'deu' when 'tr' then 'tur' else 'eng' end"


@query(f"""with b as (select doc_id // 20 as doc, case when doc_id % 3 = 0 then 'de-AT' when doc_id % 5 = 0 then 'tr' else lang end as tag from documents), m as (select doc, {CODE_SQL.format(t="min(tag)")} as main, 'xyz' as odd from b group by doc),
c as (select doc, {CODE_SQL.format(t="tag")} as code, count(*) as n from b group by all), t as (select doc, sum(n) as total from c group by doc),
o as (select doc, code, n, row_number() over (partition by doc order by n desc, code) as r from c join m using (doc) where code <> main)
select m.doc, main || case when o.code is not null and o.n >= 0.2 * t.total and o.code in ('deu', 'eng') then '+' || o.code else '' end as languages, odd as missing from m join t using (doc) left join o on o.doc = m.doc and o.r = 1""")
def reader_languages(spark: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("doc_id") % 3 == 0, "de-AT").when(F.col("doc_id") % 5 == 0, "tr").otherwise(F.col("lang"))
    b = table(spark, d, "documents").select(F.expr("doc_id div 20").alias("doc"), tag.alias("tag"))
    wanted = F.array(pages.reader_language(F.min("tag")), F.lit("xyz"))
    first = b.groupBy("doc").agg(pages.select_languages(wanted, ["deu", "eng", "tur"]).alias("x"))
    out = pages.stack_second(first.select("doc", F.col("x.languages").alias("languages")), b, ["deu", "eng"])
    return out.join(first, "doc").select("doc", F.array_join("languages", "+").alias("languages"), F.array_join("x.missing", "+").alias("missing"))


PLAN_PAGES = "page_id as page, case page_id % 5 when 0 then 'OcrSandwich' when 1 then 'ImageOnly' when 2 then 'Mixed' when 3 then 'BrokenText' else 'Text' end as class, case page_id % 3 when 0 then 'auto' when 1 then 'always' else 'never' end as policy, case when page_id % 2 = 0 then 0.2D when page_id % 7 = 0 then 0.9D end as hit_rate, 100.0D as width, 150.0D as height"


def _split(text: str) -> list[str]:
    from scriptorium.plans.scalar_queries import _columns

    return _columns(text)


@query(f"""with p as (select {PLAN_PAGES.replace("0D", "0").replace("0.2D", "0.2").replace("0.9D", "0.9")} from pages), a as (select *, class = 'OcrSandwich' as sandwich, case policy when 'always' then true when 'never' then false else coalesce(hit_rate < 0.35, false) end as again from p),
i as (select label * 50 + vec_id % 50 as page, vec_id as id, case vec_id % 4 when 0 then 'figure' when 1 then 'strip' when 2 then 'background' else 'unknown' end as kind, greatest(least(a, c), 0.0) as x0, greatest(least(b, d), 0.0) as y0, least(greatest(a, c), 100.0) as x1, least(greatest(b, d), 150.0) as y1 from (select *, {E_DUCK} from embeddings)),
m as (select i.* from i join p on p.page = i.page where p.class = 'Mixed' and kind in ('figure', 'background', 'unknown') and x1 > x0 and y1 > y0),
g as (select page_id as page, page_id % 10 * 1.0 as gx, page_id % 7 * 1.0 as gy from pages)
select page, 'page' as scope, cast(-1 as bigint) as image, sandwich and again as replaces from a where (sandwich and again) or (not sandwich and class = 'ImageOnly')
union all select page, 'image', id, false from m where not exists (select 1 from g where g.page = m.page and gx < x1 and gx + 3 > x0 and gy < y1 and gy + 3 > y0)""")
def reading_plan(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").selectExpr(*_split(PLAN_PAGES))
    kind = F.element_at(F.array(*map(F.lit, ["figure", "strip", "background", "unknown"])), (F.col("vec_id") % 4 + 1).cast("int"))
    rect = F.struct(F.least("a", "c").alias("x0"), F.least("b", "d").alias("y0"), F.greatest("a", "c").alias("x1"), F.greatest("b", "d").alias("y1"))
    images = vectors(spark, d).select((F.col("label") * 50 + F.col("vec_id") % 50).alias("page"), F.col("vec_id").alias("id"), kind.alias("kind"), rect.alias("rect"))
    ink = table(spark, d, "pages").selectExpr("page_id page", "named_struct('x0', page_id % 10 * 1.0D, 'y0', page_id % 7 * 1.0D, 'x1', page_id % 10 * 1.0D + 3, 'y1', page_id % 7 * 1.0D + 3) rect")
    return pages.reading_plan(p, images, ink)


@query("""with f as (select o_orderkey as page, l_linenumber as font, p_brand as name from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey), u as (select distinct * from f),
n as (select name, row_number() over (order by first, name) - 1 as id from (select name, min((page, font)) as first from u group by name)) select page, font, id from u join n using (name)""")
def font_numbers(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("font"), F.col("l_partkey").alias("p_partkey"))
    there = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"))
    f = items.join(there, "page").join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name")), "p_partkey").select("page", "font", "name").distinct()
    return pages.merge_fonts(f).select("page", "font", F.col("id").cast("bigint").alias("id"))


# --- glyphs: the characters of each turn, sixty to a line, some small and raised, with wide gaps ---

GLYPH_SQL = """c as (select conv_id * 1000 + turn as page, i - 1 as i, string_split(text, '')[i] as ch from (select conv_id, turn, text, unnest(range(1, length(text) + 1)) as i from conversations)),
raw as (select page, i as idx, i // 60 as line, ch, i % 60 * 6.0 + case when i % 17 >= 8 then 4.0 else 0.0 end + case when i % 41 >= 20 then 15.0 else 0.0 end as x0, i // 60 * 14.0 - case when i % 23 = 5 then 4.0 else 0.0 end as baseline,
 case when i % 23 = 5 then 6.0 else 10.0 end as size, i // 200 % 2 as font, i // 30 % 5 = 0 as italic from c),
g as (select *, x0 + 5 as x1, baseline - size as y0, baseline as y1 from raw where not regexp_matches(ch, '\\p{Cc}')),
ms as (select page, line, size as body from (select page, line, size, row_number() over (partition by page, line order by count(*) desc, size) as r from g group by page, line, size) where r = 1),
lb as (select g.page, g.line, body, list_sort(list(baseline)) as b from g join ms on ms.page = g.page and ms.line = g.line and ms.body = g.size group by all),
of_line as (select page, line, body, b[len(b) // 2 + 1] as base from lb),
v as (select g.*, body, base, case when size < 0.8 * body then case when base - baseline >= 0.3 * size then 'sup' when baseline - base >= 0.3 * size then 'sub' else 'base' end
 when regexp_full_match(ch, '[0-9*†‡§‖¶]') and base - y1 >= 0.3 * size then 'sup' when regexp_full_match(ch, '[0-9*†‡§‖¶]') and y0 - base >= 0.3 * size then 'sub' else 'base' end as vertical from g join of_line using (page, line)),
w as (select *, x0 - lag(x1) over o as gap, lag((font, size, italic, vertical)) over o as was, lag(ch) over o as before from v window o as (partition by page, line order by x0, idx)),
n as (select *, was is null or was <> (font, size, italic, vertical) or gap > 1.2 * body as new from w),
r as (select *, sum(case when new then 1 else 0 end) over (partition by page, line order by x0, idx) - 1 as run, case when not new and gap > greatest(case when font = 0 and size = 10 then 2.0 else 0.25 * size end, 0.15 * size) and ch <> ' ' and before <> ' ' then ' ' else '' end || ch as piece from n),
runs as (select page, line, run, string_agg(piece, '' order by x0, idx) as text, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, avg(baseline) as baseline, any_value(size) as size, any_value(vertical) as vertical, count(*) as n from r group by page, line, run)"""


def glyph_rows(spark: SparkSession, d: str, gathered: bool = False) -> DataFrame:
    """A row for each character; ``gathered``: texts, not their characters, are brought together by page."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page"), "text")
    c = (glyphs.by_page(c) if gathered else c).select("page", F.posexplode(F.filter(F.split("text", ""), lambda x: x != "")).alias("i", "ch"))
    g = c.selectExpr(
        "page", "i idx", "i div 60 line", "ch", "i % 60 * 6.0D + if(i % 17 >= 8, 4.0D, 0.0D) + if(i % 41 >= 20, 15.0D, 0.0D) x0", "i div 60 * 14.0D - if(i % 23 = 5, 4.0D, 0.0D) baseline",
        "if(i % 23 = 5, 6.0D, 10.0D) size", "i div 200 % 2 font", "400 weight", "i div 30 % 5 = 0 italic",
    )
    return g.withColumns({"x1": F.col("x0") + 5, "y0": F.col("baseline") - F.col("size"), "y1": F.col("baseline")})


def run_rows(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = glyphs.strip_control(glyph_rows(spark, d, gathered=True))
    spaces = spark.createDataFrame([(0, 10.0, 2.0)], "font bigint, size double, threshold double")
    return glyphs.assemble_runs(kept, spaces, gathered=True)


@query(f"with {GLYPH_SQL} select page, line, cast(run as bigint) as run, md5(text) as text_md5, x0, x1, round(baseline, 6) as baseline, size, vertical, n from runs")
def glyph_runs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(run_rows(spark, d).select("page", "line", F.col("run").cast("bigint").alias("run"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "x0", "x1", "baseline", "size", "vertical", "n"), "baseline")


@query(f"""with {GLYPH_SQL}, p as (select page, min(x0) as l, max(x1) as r from runs group by page), x as (select page, line, min(x0) as x0, max(x1) as x1, max((size, run, baseline)) as big, string_agg(text, ' ' order by run) as text, arg_max(text, run) as last from runs group by all)
select page, line, round(struct_extract_at(big, 3), 6) as baseline, md5(text) as text_md5, regexp_matches(regexp_replace(last, '\\s+$', ''), '[-‐]$') as hyphen, x0 - l as indent, r - x1 as right_gap from x join p using (page)""")
def glyph_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = glyphs.assemble_lines(run_rows(spark, d), gathered=True)
    return rounded(lines.select("page", "line", "baseline", F.md5(F.col("text").cast("binary")).alias("text_md5"), "hyphen", "indent", "right_gap"), "baseline")


@query(f"""with {GLYPH_SQL}, k as (select page, idx, idx - row_number() over (partition by page order by idx) as run from raw where regexp_matches(ch, '\\p{{Cc}}')) select page, min(idx) as start, count(*) as n from k group by page, run""")
def control_glyphs(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.strip_control(glyph_rows(spark, d))[1].select("page", F.col("start").cast("bigint").alias("start"), "n")


@query(f"with {GLYPH_SQL} select page, line, body, base as baseline from of_line")
def line_baselines(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.line_baselines(glyphs.strip_control(glyph_rows(spark, d))[0], ["page", "line"])
