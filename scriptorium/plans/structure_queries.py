"""Queries on the other tables: scalars, styles, captions, notes, evaluation statistics, events, repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import layout, metrics, quality, structure, validate
from scriptorium.plans.text_queries import LINES, WORDS, entries, rects, rounded
from scriptorium.sources.readers import document_lines, html_blocks, table, words_of
from scriptorium.streaming import events as log

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


Z = metrics.normal_quantile(0.95)


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    mid = f"({k} / {n} + {Z * Z} / (2 * {n})) / (1 + {Z * Z} / {n})"
    half = f"{Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {Z * Z} / (4 * {n} * {n})) / (1 + {Z * Z} / {n})"
    return f"round(greatest(0.0, {mid} - {half}), 6)", f"round(least(1.0, {mid} + {half}), 6)"


# --- string scalars over the names of parts and the lines of documents ---

ROMAN_SQL = "(select cast(sum(case when v < w then -v else v end) as int) from (select v, coalesce(lead(v) over (order by i), 0) as w from (select unnest(range(1, length(t) + 1)) as i, unnest(list_transform(string_split(lower(t), ''), lambda c: case c when 'i' then 1 when 'v' then 5 when 'x' then 10 when 'l' then 50 when 'c' then 100 when 'd' then 500 when 'm' then 1000 else 0 end)) as v)))"


@query(f"""
with t as (select distinct unnest({WORDS.format(t="text")}) as t from documents),
c as (select t, unnest(range(1, length(t) + 1)) as i, unnest(string_split(lower(t), '')) as ch from t where regexp_full_match(t, '(?i)[ivxlcdm]{{1,8}}')),
v as (select t, i, case ch when 'i' then 1 when 'v' then 5 when 'x' then 10 when 'l' then 50 when 'c' then 100 when 'd' then 500 when 'm' then 1000 end as v from c),
w as (select t, v, coalesce(lead(v) over (partition by t order by i), 0) as w from v),
s as (select t, sum(case when v < w then -v else v end) as value from w group by t)
select t as token, cast(value as int) as value from s where value >= 0""")
def roman_values(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select(F.explode(words_of(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", T.roman_value(F.col("token")).alias("value")).where("value is not null")


LINE_SQL = f"l as (select distinct unnest({LINES.format(t='text')}) as line from documents)"


@query(f"""with {LINE_SQL}, w as (select line, {WORDS.format(t="line")} as w from l),
h as (select line, lower(regexp_replace(w[1], '[:.]+$', '')) as key, regexp_replace(coalesce(w[2], ''), '[.:,—–]+$', '') as value, regexp_replace(w[1], '[.):—–]+$', '') as head from w),
k as (select *, case when key in ('part', 'teil', 'kisim', 'kısım') then 'part' when key in ('chapter', 'kapitel', 'abschnitt', 'bolum', 'bölüm') then 'chapter' when key in ('appendix', 'anhang', 'ek') then 'appendix' end as kind,
 regexp_full_match(value, '[0-9]+|\\p{{L}}') or regexp_full_match(value, '(?i)[ivxlcdm]{{1,8}}') or lower(value) in ({", ".join(f"'{w}'" for w in T.NUMBER_WORDS)}) as numbered, regexp_full_match(head, '\\.*[0-9]+(\\.+[0-9]+)*\\.*') as dotted, regexp_full_match(head, '(?i)[ivxlcdm]{{1,8}}') as roman from h)
select line, case when kind is not null and numbered then kind when dotted then 'decimal' else 'roman' end as kind, case when kind is not null and numbered then value else head end as value,
 case when kind is not null and numbered then 1 when dotted then least(len(list_filter(string_split(head, '.'), lambda p: p <> '')), 6) else 1 end as level
from k where (kind is not null and numbered) or dotted or roman""")
def heading_numbering(spark: SparkSession, d: str) -> DataFrame:
    lines = document_lines(table(spark, d, "documents")).select("line").distinct()
    return lines.select("line", T.heading_numbering(F.col("line")).alias("h")).where("h is not null").select("line", "h.kind", "h.value", "h.level")


@query(f"""with {LINE_SQL} select line, regexp_matches(line, '[,;:\\-–—]$') as mid_sentence, coalesce(regexp_extract(line, '(?i)^[^a-z]*(isbn)', 1), '') <> '' as isbn_word,
 length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2 and length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 0.6 * length(regexp_replace(line, '\\s', '', 'g'))
   or (regexp_matches(regexp_replace(line, '\\s', '', 'g'), '^[\\p{{N}}.]+$') and regexp_matches(line, '\\p{{N}}')) as legible from l""")
def line_shapes(spark: SparkSession, d: str) -> DataFrame:
    lines = document_lines(table(spark, d, "documents")).select("line").distinct()
    line = F.col("line")
    return lines.select("line", T.ends_mid_sentence(line).alias("mid_sentence"), (F.regexp_extract(line, "(?i)^[^a-z]*(isbn)", 1) != "").alias("isbn_word"), T.legible(line).alias("legible"))


@query(f"""with {LINE_SQL}, m as (select line, regexp_extract(line, '^([•·–—*‣▪◦])\\s', 1) as bullet, regexp_extract(line, '^\\s*(\\S+)', 1) as token from l),
b as (select *, regexp_extract(token, '^(.+)[.)]$', 1) as body, length(token) <= 8 and not regexp_matches(line, '^[•·–—*‣▪◦]') as short from m)
select line, case when bullet <> '' then 'bullet' when regexp_full_match(body, '[0-9]+') then 'decimal' when regexp_full_match(body, '(?i)[ivxlcdm]{{1,8}}') then 'roman' else 'alpha' end as kind,
 case when bullet <> '' then bullet else token end as marker from b where bullet <> '' or (short and (regexp_full_match(body, '[0-9]+') or regexp_full_match(body, '(?i)[ivxlcdm]{{1,8}}') or regexp_full_match(body, '\\p{{L}}')))""")
def list_markers(spark: SparkSession, d: str) -> DataFrame:
    lines = document_lines(table(spark, d, "documents")).select("line").distinct()
    return lines.select("line", T.list_marker(F.col("line")).alias("m")).where("m is not null").select("line", "m.kind", "m.marker")


@query("""select p_partkey, round(case when greatest(length(p_name), length(p_type)) = 0 then 0.0 else levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) end, 6) as ned,
 regexp_replace(regexp_replace(lower(p_type), '([-_ ,]*(regular|bold|italic|oblique|light|medium|semibold|book|roman|black))+[-_ ,]*$', ''), '[-_ ,]+$', '') as family from part""")
def name_distance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(T.normalised_edit_distance(F.col("p_name"), F.col("p_type")), 6).alias("ned"), T.family_key(F.col("p_type")).alias("family"))


# --- structure ---

RUNS_SQL = "runs as (select l_suppkey % 50 as doc, l_orderkey % 40 as page, round((8 + l_discount * 60) / 0.5) * 0.5 as size, case when l_tax >= 0.07 then 700 else 400 end as weight, l_linestatus = 'O' as italic, l_returnflag as family, cast(l_quantity as bigint) as chars from lineitem)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("doc"), (F.col("l_orderkey") % 40).alias("page"), (F.round((8 + F.col("l_discount") * 60) / 0.5) * 0.5).alias("size"),
        F.when(F.col("l_tax") >= 0.07, 700).otherwise(400).alias("weight"), (F.col("l_linestatus") == "O").alias("italic"), F.col("l_returnflag").alias("family"), F.col("l_quantity").cast("bigint").alias("chars"),
    )


STYLES_SQL = f"""{RUNS_SQL}, g as (select doc, size, weight >= 600 as bold, italic, family, cast(sum(chars) as bigint) as chars, max(weight) as weight, count(distinct page) as pages from runs group by all),
s as (select *, chars / sum(chars) over (partition by doc) as share, row_number() over (partition by doc order by chars desc, size desc, bold, family desc, italic desc) as r from g),
styles as (select s.doc, s.size, s.bold, s.italic, s.family, s.chars, s.pages, s.weight, s.share, s.r = 1 as is_body,
 (s.size > b.size or (s.size = b.size and s.bold and not b.bold)) and s.share < 0.15 as is_candidate from s join (select * from s where r = 1) b on b.doc = s.doc)"""


@query(f"with {STYLES_SQL} select doc, size, bold, italic, family, chars, pages, weight, round(share, 6) as share, is_body, is_candidate from styles")
def style_clusters(spark: SparkSession, d: str) -> DataFrame:
    return rounded(structure.cluster_styles(runs(spark, d)), "share")


@query(f"with {RUNS_SQL}, s as (select doc, sum(chars) as n, sum(chars * size) as s, sum(chars * size * size) as q from runs group by doc) select doc, round(s / n, 6) as mean, round(sqrt(greatest(0.0, q / n - s / n * s / n)), 6) as sigma from s")
def size_sigma(spark: SparkSession, d: str) -> DataFrame:
    return rounded(structure.size_sigma(runs(spark, d)), "mean", "sigma")


@query(f"""with recursive {STYLES_SQL}, c as (select distinct doc, cast(size as double) as size, bold from styles where is_candidate), o as (select *, row_number() over (partition by doc order by size desc, bold desc) as k from c),
r as (select doc, k, size, bold, size as top, bold as top_bold, 1 as tier from o where k = 1 union all
 select o.doc, o.k, o.size, o.bold, case when o.size < r.top * 0.9 or (o.size = r.top and r.top_bold and not o.bold) then o.size else r.top end, case when o.size < r.top * 0.9 or (o.size = r.top and r.top_bold and not o.bold) then o.bold else r.top_bold end,
  case when o.size < r.top * 0.9 or (o.size = r.top and r.top_bold and not o.bold) then r.tier + 1 else r.tier end from o join r on o.doc = r.doc and o.k = r.k + 1)
select doc, size, bold, least(tier, 3) as tier from r""")
def heading_tiers(spark: SparkSession, d: str) -> DataFrame:
    styles = structure.cluster_styles(runs(spark, d)).where("is_candidate").select("doc", F.col("size").cast("double").alias("size"), "bold")
    return structure.cluster_ranks(styles)


LEVELS_SQL = "h as (select p_partkey // 40 as doc, p_partkey as \"at\", 1 + p_size % 4 as level, row_number() over (partition by p_partkey // 40 order by p_partkey) as pos from part)"


@query(f"""with recursive {LEVELS_SQL}, r as (
 select doc, "at", level, pos, least(level, 1) as fixed from h where pos = 1
 union all select h.doc, h."at", h.level, h.pos, least(h.level, r.fixed + 1) from h join r on r.doc = h.doc and h.pos = r.pos + 1)
select doc, "at", level, fixed from r""")
def heading_level_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.expr("p_partkey div 40").alias("doc"), F.col("p_partkey").alias("at"), (1 + F.col("p_size") % 4).alias("level"))
    return structure.remove_level_skips(rows, "at")


@query("""with h as (select p_partkey // 40 as doc, p_partkey as "at", 1 + p_size % 4 as level, p_partkey // 7 % 50 as page from part),
r as (select *, lag(level, 1, 0) over (partition by doc order by "at") as up, lag(page) over (partition by doc order by "at") as was from h),
s as (select doc, count(*) filter (level = 1) as h1, count(*) filter (level > up + 1) as skips, count(*) filter (page < was) as backwards from r group by doc)
select *, h1 between 2 and 60 and skips = 0 and backwards = 0 as ok from s""")
def heading_sanity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.expr("p_partkey div 40").alias("doc"), F.col("p_partkey").alias("at"), (1 + F.col("p_size") % 4).alias("level"), F.expr("p_partkey div 7 % 50").alias("page"))
    return validate.heading_sanity(rows)


BOXES_SQL = "r as (select vec_id as id, vec_id // 20 as page, least(embedding[1], embedding[3])::double as x0, greatest(embedding[1], embedding[3])::double as x1, least(embedding[2], embedding[4])::double as y0, greatest(embedding[2], embedding[4])::double as y1 from embeddings)"


@query(f"""with {BOXES_SQL}, g as (select c.page, c.id as caption, i.id as image, c.y0 >= i.y1 as below,
  sqrt(power(greatest(0, greatest(i.x0, c.x0) - least(i.x1, c.x1)), 2) + power(greatest(0, greatest(i.y0, c.y0) - least(i.y1, c.y1)), 2)) as gap from r c join r i on c.page = i.page and c.x1 - c.x0 < c.y1 - c.y0 and i.x1 - i.x0 >= i.y1 - i.y0),
s as (select *, gap * case when below then 1.0 else 1.5 end as distance from g where gap <= 0.05),
o as (select *, row_number() over (partition by page, caption order by distance, image) as r, lead(distance) over (partition by page, caption order by distance, image) as second from s),
c as (select * from o where r = 1 and (second is null or second >= 1.5 * distance)),
f as (select *, row_number() over (partition by page, image order by caption) as k from c)
select page, caption, image, round(distance, 6) as distance from f where k = 1""")
def caption_nearest(spark: SparkSession, d: str) -> DataFrame:
    boxes = rects(spark, d)
    wide = F.expr("rect.x1 - rect.x0 >= rect.y1 - rect.y0")  # wide boxes are images, tall ones captions
    return rounded(structure.associate_captions(boxes.where(wide), boxes.where(~wide), 0.05), "distance")


@query("""with m as (select o_orderkey // 40 as page, cast(o_orderkey % 30 as varchar) as marker, o_orderkey as id from orders where o_orderstatus = 'O'), n as (select o_orderkey // 40 as page, cast(o_orderkey % 30 as varchar) as marker, o_orderkey as id from orders where o_orderstatus = 'F'),
mk as (select *, row_number() over (partition by page, marker order by id) as k from m), nk as (select *, row_number() over (partition by page, marker order by id) as k from n),
one as (select mk.page, mk.marker, nk.id as note_id, mk.id as marker_id, 1 as pass from mk join nk using (page, marker, k)),
m2 as (select *, row_number() over (partition by marker order by page, id) as k from m where id not in (select marker_id from one)), n2 as (select *, row_number() over (partition by marker order by page, id) as k from n where id not in (select note_id from one)),
two as (select n2.page, n2.marker, n2.id as note_id, m2.id as marker_id, 2 as pass from m2 join n2 using (marker, k)),
m3 as (select *, row_number() over (partition by page order by page, id) as k from m where id not in (select marker_id from one union all select marker_id from two)), n3 as (select *, row_number() over (partition by page order by page, id) as k from n where id not in (select note_id from one union all select note_id from two))
select * from one union all select * from two union all select n3.page, n3.marker, n3.id, m3.id, 3 from m3 join n3 using (page, k)""")
def note_links(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.expr("o_orderkey div 40").alias("page"), (F.col("o_orderkey") % 30).cast("string").alias("marker"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    return structure.link_notes(o.where("o_orderstatus = 'O'").drop("o_orderstatus"), o.where("o_orderstatus = 'F'").drop("o_orderstatus"))


@query("""with r as (select o_custkey as target, count(*) as refs from orders group by 1), n as (select distinct c_custkey as target, true as there from customer)
select target, coalesce(refs, 0) as refs, case when there is null then 'missing' when refs is null then 'unused' when refs > 1 then 'repeated' end as kind from r full join n using (target) where there is null or refs is null or refs > 1""")
def note_bijection(spark: SparkSession, d: str) -> DataFrame:
    return validate.bijection(table(spark, d, "orders").select(F.col("o_custkey").alias("target")), table(spark, d, "customer").select(F.col("c_custkey").alias("target")))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey is not null and l_partkey not in (select p_partkey from part where p_size > 10)")
def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return validate.dangling(items, "l_partkey", table(spark, d, "part").where("p_size > 10"), "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""with recursive p as (select source || '-' || (doc_id // 2000) as doc, row_number() over (partition by source, doc_id // 2000 order by doc_id) as i, cast(strlen(coalesce(text, '')) as bigint) as b from documents),
r as (select doc, i, b, b as used, 0 as file from p where i = 1 union all
 select p.doc, p.i, p.b, case when r.used + p.b > 260000 then p.b else r.used + p.b end, case when r.used + p.b > 260000 then r.file + 1 else r.file end from p join r on p.doc = r.doc and p.i = r.i + 1)
select doc, file, count(*) as pieces, cast(sum(b) as bigint) as bytes from r group by doc, file""")
def pack_260k(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select(F.concat("source", F.lit("-"), F.expr("doc_id div 2000")).alias("doc"), F.col("doc_id").alias("at"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"))
    return structure.pack(p)


@query("""with l as (select o_orderkey // 100 as doc, o_orderkey as page, case when o_orderkey % 3 = 0 then 'iv' else cast(1 + o_orderkey % 5 as varchar) end as label from orders),
s as (select *, max(case when regexp_full_match(label, '(?i)[ivxlcdm]+') then 1 else 0 end) over (partition by doc order by page rows between unbounded preceding and 1 preceding) as seen from l)
select doc, min(page) filter (label = '1' and seen = 1) as page from s group by doc""")
def arabic_reset(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("o_orderkey") % 3 == 0, "iv").otherwise((1 + F.col("o_orderkey") % 5).cast("string"))
    return structure.arabic_reset(table(spark, d, "orders").select(F.expr("o_orderkey div 100").alias("doc"), F.col("o_orderkey").alias("page"), label.alias("label")))


@query("""with recursive v as (select distinct p_brand as key, cast(p_retailprice as double) as value from part), o as (select *, row_number() over (partition by key order by value) as i from v),
r as (select key, i, value as kept from o where i = 1 union all select o.key, o.i, case when o.value - r.kept <= 3.0 then r.kept else o.value end from o join r on o.key = r.key and o.i = r.i + 1)
select key, count(distinct kept) as n, round(sum(distinct kept), 4) as total from r group by key""")
def snapped_ladders(spark: SparkSession, d: str) -> DataFrame:
    out = structure.snapped(table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_retailprice").cast("double").alias("value")))
    return out.select("key", F.size("values").cast("bigint").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


# --- pages ---


@query()
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return html_blocks(table(spark, d, "pages"))


@query(r"""select page_id, regexp_matches(coalesce(html, ''), '(?i)(src|href)\s*=\s*["''](https?:)?//') as remote, len(regexp_extract_all(coalesce(html, ''), '(?i)<h[1-6][ >]')) as headings, len(regexp_extract_all(coalesce(html, ''), '(?i)<img[ >/]')) as images,
 len(regexp_extract_all(coalesce(html, ''), '(?i)<script[ >]')) as scripts from pages""")
def page_markup(spark: SparkSession, d: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("bigint")
    return table(spark, d, "pages").select("page_id", validate.has_remote(html).alias("remote"), count("(?i)<h[1-6][ >]").alias("headings"), count("(?i)<img[ >/]").alias("images"), count("(?i)<script[ >]").alias("scripts"))


PAGE_SQL = "p as (select page_id, coalesce(page_id % 8, 0) as doc, length(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'), '\\s', '', 'g')) * (page_id % 3) as visible, page_id % 11 as broken, case when page_id % 4 = 0 then 0.8 else 0.0 end as area, page_id % 13 * 6 as hidden from pages)"


@query(f"""with {PAGE_SQL} select page_id, visible, case when area >= 0.6 and hidden >= 50 then 'OcrSandwich' when area >= 0.6 and visible <= 10 then 'ImageOnly' when visible = 0 and area = 0 then 'Blank'
 when visible >= 50 and broken / greatest(visible, 1) >= 0.20 then 'BrokenText' when visible >= 50 and area < 0.6 then 'Text' when visible > 0 or area > 0 then 'Mixed' else 'Blank' end as class from p""")
def page_class(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select("page_id", "visible", "class")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    bare = F.length(F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", ""), r"\s", "")).cast("bigint")
    p = table(spark, d, "pages").select("page_id", (F.col("page_id") % 8).alias("doc"), (bare * (F.col("page_id") % 3)).alias("visible"), (F.col("page_id") % 11).alias("broken"), F.when(F.col("page_id") % 4 == 0, 0.8).otherwise(0.0).alias("area"), (F.col("page_id") % 13 * 6).alias("hidden"))
    return p.withColumn("class", validate.classify_page(F.col("visible"), F.col("broken"), F.lit(None).cast("double"), F.col("area"), F.col("hidden")))


@query(f"""with {PAGE_SQL}, c as (select doc, case when area >= 0.6 and hidden >= 50 then 'OcrSandwich' when area >= 0.6 and visible <= 10 then 'ImageOnly' when visible = 0 and area = 0 then 'Blank'
 when visible >= 50 and broken / greatest(visible, 1) >= 0.20 then 'BrokenText' when visible >= 50 and area < 0.6 then 'Text' else 'Mixed' end as class, page_id % 5 = 0 as wide, 1 + page_id % 3 as columns from p),
s as (select doc, count(*) as pages, avg(case when class in ('ImageOnly', 'OcrSandwich', 'BrokenText') then 1.0 else 0.0 end) as scanned, avg(case when wide then 1.0 else 0.0 end) as w, avg(case when columns >= 2 then 1.0 else 0.0 end) as m from c group by doc)
select doc, pages, case when scanned >= 0.5 then 'scanned' when w >= 0.5 then 'slides' when m >= 0.5 then 'academic' else 'prose' end as class from s""")
def doc_class(spark: SparkSession, d: str) -> DataFrame:
    pages = _classes(spark, d).withColumns({"landscape": F.col("page_id") % 5 == 0, "columns": 1 + F.col("page_id") % 3})
    return validate.classify_document(pages)


# --- evaluation ---

LABELS_SQL = "x as (select l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars from labels l join documents d using (doc_id))"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


LOW, HIGH = wilson_sql("passed", "n")


@query(f"with {LABELS_SQL}, s as (select source, count(*) as n, cast(sum(quality) as bigint) as passed from x group by source) select source, n, passed, round(passed / n, 6) as rate, {LOW} as low, {HIGH} as high from s")
def wilson_by_source(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.wilson_by(labelled(spark, d), ["source"], "quality"), "rate", "low", "high")


LOW9, HIGH9 = (x.removeprefix("round(").removesuffix(", 6)") for x in wilson_sql("passed", "n"))


@query(f"""with {LABELS_SQL}, s as (select source, count(*) as n, cast(sum(quality) as bigint) as passed from x group by source), w as (select *, passed / n as rate, {LOW9} as low, {HIGH9} as high from s)
select source, n, passed, round(rate, 6) as rate, round(low, 6) as low, round(high, 6) as high, not (n < 30 or rate < 0.6 - (high - low) / 2) as pass from w""")
def gate(spark: SparkSession, d: str) -> DataFrame:
    w = metrics.wilson_by(labelled(spark, d), ["source"], "quality")
    last = w.select("source", F.lit(0.6).alias("last_rate"))
    return rounded(metrics.gate(w, last, ["source"]), "rate", "low", "high")


@query(f"""with {LABELS_SQL}, s as (select lang, count(*) as n, count(*) filter (quality = 1 and toxic = 0) as b, count(*) filter (quality = 0 and toxic = 1) as c from x group by lang)
select lang, n, b, c, b + c < 25 as exact, case when b + c = 0 then 1.0 when b + c < 25 then round(least(1.0, 2 * (select sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) from (select unnest(range(0, least(b, c) + 1)) as i))), 6) end as p_exact,
 case when b + c >= 25 then round(power(greatest(abs(b - c) - 1, 0), 2) / (b + c), 6) end as chi2 from s""")
def mcnemar_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.mcnemar(labelled(spark, d), ["lang"], "quality", "toxic"), "p_exact", "chi2")


# the normal density's area by Simpson's rule, in more steps than the operator takes
AREA = "list_sum(list_transform(range(0, 2001), lambda i: case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end * exp(-pow(sqrt(x) * i / 2000, 2) / 2))) * sqrt(x) / 6000"


@query(f"""with {LABELS_SQL}, s as (select source, count(*) filter (quality = 1 and toxic = 0) as b, count(*) filter (quality = 0 and toxic = 1) as c from x group by source), k as (select *, b + c as d, power(greatest(abs(b - c) - 1, 0), 2) / greatest(b + c, 1) as x from s)
select source, b, c, round(case when d = 0 then 1.0 when d < 25 then least(1.0, 2 * (select sum(exp(lgamma(d + 1) - lgamma(i + 1) - lgamma(d - i + 1) - d * ln(2))) from (select unnest(range(0, least(b, c) + 1)) as i))) else greatest(0.0, 1 - sqrt(2 / pi()) * {AREA}) end, 6) as p from k""")
def mcnemar_p(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.mcnemar(labelled(spark, d), ["source"], "quality", "toxic")
    return rounded(m.select("source", "b", "c", F.coalesce("p_exact", metrics.chi_square_p("chi2")).alias("p")), "p")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("lang", (F.least("n_chars", F.lit(10000)) / 10000.0).alias("confidence"), (F.col("quality") == 1).alias("correct"))


OBS_SQL = f"{LABELS_SQL}, o as (select lang, least(n_chars, 10000) / 10000.0 as confidence, quality = 1 as correct from x)"
BINS_SQL = f"{OBS_SQL}, b as (select lang, cast(least(floor(confidence * 10), 9) as bigint) as bin, count(*) as n, avg(confidence) as mean_confidence, avg(case when correct then 1.0 else 0.0 end) as accuracy from o group by all)"


@query(f"with {BINS_SQL} select lang, bin, n, round(mean_confidence, 6) as mean_confidence, round(accuracy, 6) as accuracy from b")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.reliability(observations(spark, d), ["lang"]), "mean_confidence", "accuracy")


@query(f"with {BINS_SQL} select lang, cast(sum(n) as bigint) as n, round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) as ece from b group by lang")
def expected_calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.expected_calibration_error(observations(spark, d), ["lang"]), "ece")


CURVE_SQL = f"{OBS_SQL}, l as (select lang, confidence, count(*) as n, count(*) filter (not correct) as bad from o group by all), r as (select lang, confidence, sum(n) over w as accepted, sum(bad) over w as wrong, sum(n) over (partition by lang) as total from l window w as (partition by lang order by confidence desc)), c as (select lang, confidence, accepted, wrong, wrong / accepted as risk, accepted / total as coverage from r)"


@query(f"with {CURVE_SQL} select lang, round(confidence, 6) as confidence, cast(accepted as bigint) as accepted, cast(wrong as bigint) as wrong, round(risk, 6) as risk, round(coverage, 6) as coverage from c")
def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.risk_coverage(observations(spark, d), ["lang"], "confidence"), "confidence", "risk", "coverage")


@query(f"with {CURVE_SQL} select lang, round(min(confidence) filter (risk <= 0.45), 6) as threshold, round(max(coverage) filter (risk <= 0.45), 6) as coverage from c group by lang")
def threshold_for(spark: SparkSession, d: str) -> DataFrame:
    curve = metrics.risk_coverage(observations(spark, d), ["lang"], "confidence")
    return rounded(metrics.threshold_for(curve, ["lang"], 0.45), "threshold", "coverage")


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.inline(F.array(F.struct(F.lit("chars").alias("metric"), F.col("n_chars").cast("double").alias("value")), F.struct(F.lit("lines").alias("metric"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("double").alias("value")))))
    return docs.withColumnRenamed("source", "stratum")


ROWS_SQL = "m as (select source as stratum, 'chars' as metric, cast(n_chars as double) as value from documents union all select source, 'lines', cast(len(string_split(coalesce(text, ''), chr(10))) as double) from documents)"


@query(f"with {ROWS_SQL} select stratum, metric, count(*) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, min(value) as least, max(value) as most from m group by all")
def stratum_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.stratum_report(metric_rows(spark, d)), "mean", "median")


@query(f"with {ROWS_SQL} select metric, round(avg(value) filter (stratum = 'src1') - avg(value) filter (stratum <> 'src1'), 6) as gap from m group by metric")
def ours_vs_real_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ours_vs_real_gap(metric_rows(spark, d), "src1"), "gap")


@query(f"""with t as (select unnest({WORDS.format(t="text")}) as w from benchmark), a as (select w, count(*) as t from t group by w), s as (select source, unnest({WORDS.format(t="text")}) as w from documents), b as (select source, w, count(*) as s from s group by all),
k as (select distinct source from documents), full_t as (select source, w, t from k, a), j as (select source, w, coalesce(t, 0) as t, coalesce(s, 0) as s from full_t full join b using (source, w)),
g as (select source, sum(least(t, s)) as matched, sum(t) as truth, sum(s) as said from j group by source)
select source, cast(matched as bigint) as matched, cast(truth as bigint) as truth, cast(said as bigint) as said, round(matched / said, 6) as precision, round(matched / truth, 6) as recall,
 round(case when matched = 0 then 0.0 else 2 * (matched / said) * (matched / truth) / (matched / said + matched / truth) end, 6) as f1 from g""")
def prf_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sources = docs.select("source").distinct()
    truth = table(spark, d, "benchmark").select(F.explode(words_of(F.col("text"))).alias("w"))
    out = metrics.prf_against_one(truth, docs.select("source", F.explode(words_of(F.col("text"))).alias("w")), sources, ["source"], "w")
    return rounded(out, "precision", "recall", "f1")


@query("""with r as (select source || '-' || (doc_id // 2000) as book, doc_id as x, n_chars as y from documents), p as (select a.book, sign((b.x - a.x) * (b.y - a.y)) as s from r a join r b on a.book = b.book and a.x < b.x),
n as (select book, count(*) as n from r group by book)
select n.book, n.n, round(case when n.n < 2 then 1.0 else coalesce(sum(s), 0) / (n.n * (n.n - 1) / 2) end, 6) as tau from n left join p on p.book = n.book group by n.book, n.n""")
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.kendall_tau(table(spark, d, "documents").select(F.concat("source", F.lit("-"), F.expr("doc_id div 2000")).alias("book"), F.col("doc_id").alias("x"), F.col("n_chars").alias("y")), ["book"]), "tau")


@query("""with e as (select c_custkey % 1400 as id, case when c_custkey % 17 = 0 then '' else c_mktsegment end as license, case when c_nationkey < 12 then 'ours' else 'real' end as source, c_custkey % 20 = 0 as holdout from customer),
s as (select avg(case when source = 'ours' then 1.0 else 0.0 end) as s, count(*) filter (holdout) as h from e)
select 'duplicate_id' as rule, cast(id as varchar) as id, cast(count(*) as varchar) as detail from e group by id having count(*) > 1
union all select 'license_incomplete', cast(id as varchar), '' from e where license is null or trim(license) = ''
union all select 'ours_share_above_maximum', '', cast(round(s, 6) as varchar) from s where s > 0.40
union all select 'holdout_below_minimum', '', cast(h as varchar) from s where h < 100""")
def manifest_lint(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    e = c.select((F.col("c_custkey") % 1400).alias("id"), F.when(F.col("c_custkey") % 17 == 0, "").otherwise(F.col("c_mktsegment")).alias("license"), F.when(F.col("c_nationkey") < 12, "ours").otherwise("real").alias("source"), (F.col("c_custkey") % 20 == 0).alias("holdout"))
    return validate.manifest_lint(e)


@query(f"""with b as (select source as doc, lang, len({WORDS.format(t="text")}) as words from documents), c as (select doc, lang, count(*) as k from b group by all), m as (select doc, lang as main from (select *, row_number() over (partition by doc order by k desc, lang) as r from c) where r = 1),
f as (select b.doc, main, avg(case when words >= 5 and lang <> main then 1.0 else 0.0 end) as share from b join m using (doc) group by all)
select doc, main, round(share, 6) as share, share <= 0.20 as tags from f""")
def block_language_cap(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "documents").select(F.col("source").alias("doc"), "lang", F.size(words_of(F.col("text"))).alias("words"))
    main = b.groupBy("doc", "lang").count().groupBy("doc").agg(F.max(F.struct("count", F.expr("transform(split(lang, ''), c -> -ascii(c))").alias("order"), "lang")).alias("x")).select("doc", F.col("x.lang").alias("main"))
    out = b.join(F.broadcast(main), "doc").groupBy("doc", "main").agg(F.avg(((F.col("words") >= 5) & (F.col("lang") != F.col("main"))).cast("double")).alias("share"))
    return rounded(out.withColumn("tags", F.col("share") <= 0.20), "share")


# --- events ---

EVENTS_SQL = "e as (select user_id as job, event_type as stage, ts, event_id as seq, value from events)"


def log_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), "ts", F.col("event_id").alias("seq"), "value")


@query(f"with {EVENTS_SQL} select job, stage, count(*) as n, min(ts) as first, max(ts) as last, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) as seconds from e group by all")
def job_stage_timings(spark: SparkSession, d: str) -> DataFrame:
    return log.stage_timings(log_rows(spark, d)).withColumn("seconds", F.round("seconds", 3))


@query(f"with {EVENTS_SQL}, g as (select job, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by job order by ts, seq)) / 1e6 as gap from e) select job, count(*) as beats, count(*) filter (gap > 3600) as gaps, round(max(gap), 3) as longest from g group by job")
def heartbeat_gaps(spark: SparkSession, d: str) -> DataFrame:
    return log.heartbeat_gaps(log_rows(spark, d), 3600).withColumn("longest", F.round("longest", 3))


@query(f"with {EVENTS_SQL}, n as (select job, seq, lead(seq) over (partition by job order by seq) as next from e) select job, seq as after, next - seq - 1 as missing from n where next > seq + 1")
def seq_gaps(spark: SparkSession, d: str) -> DataFrame:
    return log.sequence_gaps(log_rows(spark, d))


@query(f"""with {EVENTS_SQL}, g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by job order by ts) < 43200000000 then 0 else 1 end as new from e), s as (select *, sum(new) over (partition by job order by ts rows unbounded preceding) as k from g)
select job, min(ts) as begin, max(ts) + interval 12 hours as end, count(*) as n from s group by job, k""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return log.sessions(log_rows(spark, d), "12 hours")


@query(f"with {EVENTS_SQL} select stage, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as begin, count(*) as n, round(sum(value), 4) as total from e group by all")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    return log.windowed_counts(log_rows(spark, d), "6 hours").withColumn("total", F.round("total", 4))


REMEDIES = {"click": "rewrite-alt", "purchase": "drop-figure", "view": None, "signup": "plain-reference"}


@query("""with f as (select user_id as location, event_type as id, case when value > 80 then 'fatal' when value > 40 then 'error' else 'warning' end as severity from events),
r as (select *, case severity when 'fatal' then 1 when 'error' then 2 else 3 end as k, case id when 'click' then 'rewrite-alt' when 'purchase' then 'drop-figure' when 'signup' then 'plain-reference' end as remedy from f)
select location, id, severity, remedy from (select *, row_number() over (partition by location order by k, id) as n from r where remedy is not null) where n = 1""")
def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    f = e.select(F.col("user_id").alias("location"), F.col("event_type").alias("id"), F.when(F.col("value") > 80, "fatal").when(F.col("value") > 40, "error").otherwise("warning").alias("severity"))
    return validate.plan_repairs(f, REMEDIES)


@query("""with v as (select doc_id as doc, lang, unnest(['1-metadata', '2-structure', '3-verse']) as task, unnest([n_chars % 5, n_chars % 7, n_chars % 3]) as demand, unnest([n_chars % 2 = 0, n_chars > 1000, lang = 'en']) as fired from documents),
w as (select *, case when fired and lang in ('en', 'de') then demand else 0 end as wants from v), b as (select *, coalesce(sum(wants) over (partition by doc order by task rows between unbounded preceding and 1 preceding), 0) as before from w)
select doc, task, fired, cast(greatest(0, least(wants, 6 - before)) as bigint) as granted from b""")
def escalation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    rows = F.inline(F.array(F.struct(F.lit("1-metadata").alias("task"), (n % 5).alias("demand"), (n % 2 == 0).alias("fired")), F.struct(F.lit("2-structure").alias("task"), (n % 7).alias("demand"), (n > 1000).alias("fired")), F.struct(F.lit("3-verse").alias("task"), (n % 3).alias("demand"), (F.col("lang") == "en").alias("fired"))))
    return validate.escalations(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang", rows), ["en", "de"], 6)


# --- geometry: order-dependent folds over a page; no SQL ---


@query()
def xy_cut_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(rects(spark, d).select("page", "id", "rect.*"), 0.001, 0.001)


@query(f"""with recursive {BOXES_SQL}, p as (select a.page, a.id as a, b.id as b, least(a.x1, b.x1) - greatest(a.x0, b.x0) as ox, abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) as dy, case when least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 then 0.0 else greatest(b.x0 - a.x1, a.x0 - b.x1, 0.0) end as dx from r a join r b on a.page = b.page and a.id <> b.id),
u as (select *, sqrt(dx * dx + dy * dy) as far from p where dy >= dx), n as (select page, a, min(far) as near from u group by all), m as (select page, floor(near + 0.5) as bucket, count(*) as k, avg(near) as usual from n group by all), w as (select page, usual from (select *, row_number() over (partition by page order by k desc, bucket) as i from m) where i = 1),
e as (select u.page, a, b from u join w using (page) where ox > 0 and far <= usual * 1.3), reach as (select page, id as a, id as root from r union select e.page, e.b, reach.root from reach join e on e.page = reach.page and e.a = reach.a)
select page, a as id, min(root) as block from reach group by page, a""")
def docstrum_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.docstrum_groups(rects(spark, d).select("page", "id", "rect.*"))


@query(f"""with recursive {BOXES_SQL}, o as (select page, id, y1 as base, y1 - y0 as size, row_number() over (partition by page order by y1, id) as k from r),
c as (select page, k, id, 0 as line, base as anchor, size as big from o where k = 1 union all
 select o.page, o.k, o.id, case when abs(o.base - c.anchor) > 0.3 * greatest(c.big, o.size) then c.line + 1 else c.line end, case when abs(o.base - c.anchor) > 0.3 * greatest(c.big, o.size) or o.size > c.big then o.base else c.anchor end,
  case when abs(o.base - c.anchor) > 0.3 * greatest(c.big, o.size) or o.size > c.big then o.size else c.big end from o join c on o.page = c.page and o.k = c.k + 1)
select page, id, line from c""")
def baseline_clusters(spark: SparkSession, d: str) -> DataFrame:
    return layout.cluster_baselines(rects(spark, d).select("page", "id", F.col("rect.y1").alias("baseline"), (F.col("rect.y1") - F.col("rect.y0")).alias("size")))


GAP_STEP = "sum(case when abs(x - low) <= abs(x - high) then x * n end) / sum(case when abs(x - low) <= abs(x - high) then n end), sum(case when abs(x - low) > abs(x - high) then x * n end) / sum(case when abs(x - low) > abs(x - high) then n end)"


@query(f"""with recursive g as (select l_returnflag as a, l_linestatus as b, round(l_tax * 10 + case when l_quantity > 25 then 4.0 else 0.0 end, 2) as x, count(*) as n from lineitem group by all),
k as (select a, b, 0 as i, min(x) as low, max(x) as high from g group by a, b union all select a, b, i + 1, low2, high2 from (select k.a, k.b, k.i, {GAP_STEP.replace("), sum(case when abs(x - low) > ", ") as low2, sum(case when abs(x - low) > ", 1)} as high2 from k join g on g.a = k.a and g.b = k.b where k.i < 32 group by k.a, k.b, k.i, k.low, k.high)),
f as (select * from k where i = 32), s as (select f.a, f.b, low, high, sum(n * least(abs(x - low), abs(x - high))) / sum(n) as spread, max(x) - min(x) as range_, sum(n) as total from f join g on g.a = f.a and g.b = f.b group by all)
select a as l_returnflag, b as l_linestatus, cast(total as bigint) as n, round(case when total >= 2 and range_ > 0.05 and (high - low) / greatest(spread, 0.05) >= 2 then (low + high) / 2 end, 6) as threshold from s""")
def space_thresholds(spark: SparkSession, d: str) -> DataFrame:
    gaps = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_tax") * 10 + F.when(F.col("l_quantity") > 25, 4.0).otherwise(0.0)).alias("gap"))
    return rounded(layout.space_thresholds(gaps, ["l_returnflag", "l_linestatus"]), "threshold")


__all__ = ["QUERIES", "ORACLE_SQL", "entries", "quality"]
