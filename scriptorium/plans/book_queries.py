"""Queries on a book's structure: parts stand for headings and blocks, lines for list items, orders for claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import book, structure
from scriptorium.plans.registry import registry
from scriptorium.plans.scalar_queries import _columns
from scriptorium.plans.text_queries import rounded
from scriptorium.sources.readers import table

QUERIES, ORACLE_SQL, query = registry()

HEADS = "p_partkey // 40 as doc, p_partkey as pos, p_partkey // 3 as page, 1 + p_size % 4 as level, case p_partkey % 10 when 0 then 'Preface' when 1 then 'Part ' || (p_size % 9 + 1) when 2 then 'Chapter ' || p_size when 7 then 'Appendix A' when 8 then 'Index:' else p_name end as text"
PARENT = "greatest(" + ", ".join(f"case when level > {k} then max(case when level = {k} then pos end) over (partition by doc order by pos rows between unbounded preceding and 1 preceding) end" for k in range(1, 6)) + ")"
FRONT = ", ".join(f"'{w}'" for w in ("preface", "foreword", "introduction", "vorwort", "einleitung", "önsöz", "giriş", "contents", "inhalt", "içindekiler", "dedication", "prologue"))
HEADS_SQL = f"""h as (select {HEADS} from part), rs as (select doc, min(page) + 4 as reset from h where doc % 2 = 0 group by doc), lp as (select doc, max(page) as last from h group by doc),
k as (select h.*, reset, last, case lower(regexp_replace(regexp_extract(text, '^\\s*(\\S+)', 1), '[:.,]+$', '')) when 'preface' then 'preface' end as front, case lower(regexp_replace(regexp_extract(text, '^\\s*(\\S+)', 1), '[:.,]+$', '')) when 'appendix' then 'appendix' when 'index' then 'index' end as back from h left join rs using (doc) join lp using (doc)),
b as (select *, min(case when reset is not null and page >= reset or reset is null and front is null then pos end) over (partition by doc) as body_at from k),
z as (select *, min(case when back is not null and page >= 0.5 * last and pos > body_at then pos end) over (partition by doc) as back_at from b),
zoned as (select doc, pos, page, level, text, front, back, case when coalesce(pos >= back_at, false) then 'back' when coalesce(pos >= body_at, false) then 'body' else 'front' end as zone from z),
tree as (select *, {PARENT} as parent from zoned)"""


def spark_sql(text: str) -> list[str]:
    return [c.replace(" // ", " div ") for c in _columns(text)]


def heads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*spark_sql(HEADS)).withColumnRenamed("pos", "at")


def zoned(spark: SparkSession, d: str) -> DataFrame:
    h = heads(spark, d)
    resets = h.where("doc % 2 = 0").groupBy("doc").agg((F.min("page") + 4).alias("page"))
    return book.zones(h, resets, h.groupBy("doc").agg(F.max("page").alias("last")))


@query(f'with {HEADS_SQL} select doc, pos as "at", coalesce(parent, -1) as parent, zone from tree')
def zone_order(spark: SparkSession, d: str) -> DataFrame:
    return book.section_tree(zoned(spark, d)).select("doc", "at", F.coalesce("parent", F.lit(-1)).alias("parent"), "zone")


@query(f"""with {HEADS_SQL}, p as (select *, zone = 'body' and regexp_full_match(text, 'Part [0-9]+') as is_part from tree), r as (select p.*, u.is_part as under from p left join p u on u.doc = p.doc and u.pos = p.parent)
select doc, pos as "at", case when zone = 'front' then 'front:' || coalesce(front, 'other') when zone = 'back' then 'back:' || coalesce(back, 'other') when is_part then 'part' when level = 1 or coalesce(under, false) then 'chapter' else 'section' end as role from r""")
def section_roles(spark: SparkSession, d: str) -> DataFrame:
    return book.section_roles(zoned(spark, d)).select("doc", "at", "role")


@query(f"""with {HEADS_SQL}, s as (select doc, pos, parent, case when pos % 7 = 0 then 'front' else zone end as zone, page as first, page + pos % 5 - 1 as last from tree), t as (select *, case zone when 'front' then 1 when 'body' then 2 else 3 end as rank from s where parent is null),
w as (select *, lag(rank) over (partition by doc order by pos) as was, lag(first) over (partition by doc order by pos) as before from t)
select distinct * from (select doc, 'W_ZONES_OUT_OF_ORDER' as code from w where rank < was union all select doc, 'W_SECTION_PAGES_NOT_MONOTONE' from w where first < before union all select doc, 'W_SECTION_PAGES_NOT_MONOTONE' from s where last < first)""")
def section_warnings(spark: SparkSession, d: str) -> DataFrame:
    s = book.section_tree(zoned(spark, d))
    return book.section_warnings(s.select("doc", "at", "parent", F.when(F.col("at") % 7 == 0, "front").otherwise(F.col("zone")).alias("zone"), F.col("page").alias("first"), (F.col("page") + F.col("at") % 5 - 1).alias("last")))


FRONTS = "p_partkey // 6 as doc, p_partkey as page, case p_partkey % 6 when 0 then 'The ' || p_name when 1 then 'A Title' when 2 then 'A Title and ' || p_name when 3 then '© ' || p_size when 4 then 'To ' || p_name else 'Wise words — Jane Doe' end as text, p_partkey % 17 = 0 as links, case p_partkey % 6 when 5 then 'Wise words — Jane Doe' else 'x' end as last"


@query(f"""with p as (select {FRONTS} from part), w as (select *, len(regexp_extract_all(text, '\\S+')) as words, case when doc % 3 <> 0 then 'atitle' end as key from p),
k as (select *, case when words = 0 then 'other' when links then 'contents' when contains(text, '©') then 'copyright' when words <= 60 and contains(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g'), key) then 'title'
 when words <= 90 and regexp_matches(last, '[—–]\\s*\\p{{Lu}}[^\\s—–]*(\\s+[^\\s—–]+){{0,3}}\\s*$') then 'epigraph' when words <= 30 and not regexp_matches(text, '\\p{{N}}') then 'dedication' else 'other' end as kind from w),
h as (select *, kind = 'title' and row_number() over o = 1 and coalesce(words <= lead(words) over o, false) as half from k window o as (partition by doc, kind order by page)),
t as (select doc, page, case when half then 'half_title' when kind in ('other', 'dedication') and page % 4 = 0 then 'preface' else kind end as kind from h),
n as (select *, case when kind = lag(kind) over (partition by doc order by page) then 0 else 1 end as new from t), r as (select *, sum(new) over (partition by doc order by page) as section from n)
select doc, cast(section as bigint) as section, kind, min(page) as first, max(page) as last from r group by all""")
def front_sections(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr(*spark_sql(FRONTS))
    titles = p.select("doc").distinct().select("doc", F.when(F.col("doc") % 3 != 0, "A Title").alias("title"))
    told = p.where("page % 4 = 0").select("doc", "page", F.lit("preface").alias("kind"))
    return book.front_sections(book.front_page_kinds(p, titles, told))


@query("select o_custkey // 10 as doc, o_orderkey // 4 as page, min(o_orderkey) as \"at\" from orders group by all")
def page_breaks(spark: SparkSession, d: str) -> DataFrame:
    return book.page_breaks(table(spark, d, "orders").selectExpr("o_custkey div 10 doc", "o_orderkey div 4 page", "o_orderkey at"))


# a tree: of each forty parts, a part's parent is the one at half its place
TREE = "p_partkey // 40 as doc, p_partkey % 40 as node, case when p_partkey % 40 > 0 then (p_partkey % 40 - 1) // 2 end as parent, p_size as ord, case when p_partkey % 3 > 0 then p_name end as text"


@query(f"""with recursive n as (select {TREE} from part), w as (select doc, node, text, 0 as depth, [(ord, node)] as path from n where parent is null union all select n.doc, n.node, n.text, w.depth + 1, list_append(w.path, (n.ord, n.node)) from n join w on w.doc = n.doc and w.node = n.parent)
select doc, node, depth, row_number() over (partition by doc order by path) - 1 as place from w""")
def tree_walk(spark: SparkSession, d: str) -> DataFrame:
    return book.walk(table(spark, d, "part").selectExpr(*spark_sql(TREE)), 6).select("doc", "node", "depth", F.col("place").cast("bigint").alias("place"))


@query(f"""with recursive n as (select {TREE} from part), w as (select doc, node, text, [(ord, node)] as path from n where parent is null union all select n.doc, n.node, n.text, list_append(w.path, (n.ord, n.node)) from n join w on w.doc = n.doc and w.node = n.parent)
select doc, string_agg(text, ' ' order by path) as text from w group by doc""")
def tree_texts(spark: SparkSession, d: str) -> DataFrame:
    pieces = book.text_pieces(table(spark, d, "part").selectExpr(*spark_sql(TREE)), 6)
    return pieces.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ").alias("text"))


@query("""with p as (select p_partkey as id, case when p_partkey % 5 = 0 then p_type when p_partkey % 5 = 1 then p_name end as title, case when p_partkey % 7 = 0 then 1 end as level from part), b as (select p_partkey, p_name, p_size % 3 as lvl from part)
select id, 'title' as field, p_name as removed, title as added from p join b on p_partkey = id where title is not null and title <> p_name union all select id, 'level', cast(lvl as varchar), cast(level as varchar) from p join b on p_partkey = id where level is not null and level <> lvl""")
def override_ledger(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    rows = part.selectExpr("p_partkey id", "p_name title", "p_size % 3 level")
    patch = part.selectExpr("p_partkey id", "case when p_partkey % 5 = 0 then p_type when p_partkey % 5 = 1 then p_name end title", "if(p_partkey % 7 = 0, 1, null) level")
    _, entries = book.apply_overrides(rows, patch, ["id"], ["title", "level"])
    return entries.select("id", F.when(F.rlike("removed", F.lit("^[0-2]$")), "level").otherwise("title").alias("field"), "removed", "added")


# --- claims ---

CLAIMS = "o_orderkey // 50 as doc, o_custkey % 7 as block, o_orderkey % 5 as by_whom, o_orderpriority as text"
BLOCK_SQL = "blocks as (select doc, block, string_agg(text, ' ' order by text) as text from (select distinct doc, block, text from c) group by all)"


def claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "orders").selectExpr(*spark_sql(CLAIMS)).withColumnRenamed("by_whom", "by")
    blocks = c.select("doc", "block", "text").distinct().groupBy("doc", "block").agg(F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("text"))
    return c, blocks


@query(f"with c as (select {CLAIMS} from orders) select doc, block, count(*) as claims from c group by all having count(*) > 1")
def contested_blocks(spark: SparkSession, d: str) -> DataFrame:
    return book.contested(claims(spark, d)[0])


@query(f"""with c as (select {CLAIMS} from orders), {BLOCK_SQL}, t as (select doc, block from c group by all having count(*) > 1),
cc as (select doc, block, ch, count(*) as n from (select doc, block, unnest(string_split(regexp_replace(text, '\\s', '', 'g'), '')) as ch from c) group by all), bc as (select doc, block, ch, count(*) as n from (select doc, block, unnest(string_split(regexp_replace(text, '\\s', '', 'g'), '')) as ch from blocks) group by all)
select distinct cc.doc, cc.block from cc join t using (doc, block) left join bc using (doc, block, ch) where cc.n > coalesce(bc.n, 0)""")
def overclaimed_blocks(spark: SparkSession, d: str) -> DataFrame:
    return book.overclaimed(*claims(spark, d))


@query(f"with c as (select {CLAIMS} from orders) select doc, block, by_whom, text from c where not (by_whom in (1, 3) and doc % 2 = 0)")
def orphaned_claims(spark: SparkSession, d: str) -> DataFrame:
    c, _ = claims(spark, d)
    return book.orphaned_claims(c, c.where("by in (1, 3) and doc % 2 = 0")).select("doc", "block", F.col("by").alias("by_whom"), "text")


# --- notes ---

NOTES = "p_partkey // 10 as doc, p_partkey as pos, p_partkey // 5 as page, p_partkey // 4 as block, p_size % 2 = 0 as raised, case p_partkey % 6 when 0 then '*' when 1 then cast(p_size as string) else p_brand end as run, case p_partkey % 5 when 0 then p_size || '. ' || p_name when 1 then '† ' || p_name when 2 then p_size || ' ' || p_name else p_name end as text, case when p_partkey // 4 % 3 = 0 then 8.0 else 10.0 end as size, p_partkey % 4 / 4.0 as band"
MARKER = "case when raised and (regexp_full_match(run, '[0-9]+') or run in ('*', '†', '‡', '§', '‖', '¶')) then run when regexp_extract(text, '^\\s*(\\S+)', 1) in ('*', '†', '‡', '§', '‖', '¶') then regexp_extract(text, '^\\s*(\\S+)', 1) when regexp_matches(text, '^\\s*[0-9]+[.)]+(\\s|$)') then regexp_extract(text, '^\\s*([0-9]+)', 1) end"
NOTES_SQL = f"l0 as (select {NOTES} from part), l as (select *, {MARKER} as marker from l0), zone as (select block from l where size / 10.0 < 0.85 and band >= 0.55 group by block having count(marker) > 0)"


def note_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr(*[c.replace("8.0 else 10.0", "8.0D else 10.0D") for c in spark_sql(NOTES)])
    return rows.withColumn("marker", book.leading_marker(F.col("run"), F.col("raised"), F.col("text"))).withColumnRenamed("pos", "at").withColumn("body", F.lit(10.0))


@query(f'with {NOTES_SQL} select pos as "at", coalesce(marker, \'\') as marker, block in (select block from zone) as in_zone from l')
def note_markers(spark: SparkSession, d: str) -> DataFrame:
    lines = note_lines(spark, d)
    zone = book.note_blocks(lines).withColumn("in_zone", F.lit(True))
    return lines.join(zone, "block", "left").select("at", F.coalesce("marker", F.lit("")).alias("marker"), F.coalesce("in_zone", F.lit(False)).alias("in_zone"))


@query(f"""with {NOTES_SQL}, z as (select * from l where block in (select block from zone)), o as (select *, case when marker is not null or row_number() over (partition by doc order by pos) = 1 then 1 else 0 end as opens from z), n as (select *, sum(opens) over (partition by doc order by pos) as note from o)
select doc, cast(note as bigint) as note, min(page) as page, coalesce(max(marker), '') as marker, string_agg(trim(text), ' ' order by pos) as text from n group by doc, note""")
def note_bodies(spark: SparkSession, d: str) -> DataFrame:
    lines = note_lines(spark, d)
    return book.note_bodies(lines.join(book.note_blocks(lines), "block", "left_semi")).withColumn("marker", F.coalesce("marker", F.lit("")))


@query(f"with {NOTES_SQL} select pos as \"at\", run from l where raised and (regexp_full_match(run, '[0-9]+') or run = '*') and block not in (select block from zone)")
def body_markers(spark: SparkSession, d: str) -> DataFrame:
    lines = note_lines(spark, d)
    return book.body_markers(lines.select("at", "block", "raised", F.col("run").alias("text")), book.note_blocks(lines)).select("at", F.col("text").alias("run"))


@query("""with n as (select p_partkey as note, p_partkey // 5 as page, p_size * 10.0 as y0, p_size * 4.0 as w from part), r as (select p_partkey // 5 as page, p_size as length, p_retailprice % 500 as foot from part where p_size >= 2)
select distinct note from n join r using (page) where length / w < 0.4 and foot <= y0 and y0 - foot <= 30""")
def separator_rules(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    notes = part.selectExpr("p_partkey note", "p_partkey div 5 page", "p_size * 10.0D y0", "p_size * 4.0D column_width")
    rules = part.where("p_size >= 2").selectExpr("p_partkey div 5 page", "0.0D x0", "p_retailprice % 500 - 1 y0", "cast(p_size as double) x1", "p_retailprice % 500 y1")
    return book.separator_rules(notes, rules, 10.0)


CAPTIONED = "p_partkey, case p_partkey % 4 when 0 then 'Fig. ' || p_size when 1 then '' else p_name end as text, 8.0 + p_size % 5 as size, p_size % 9 = 0 as italic, p_size / 40.0 as width_ratio"


@query(f"with b as (select {CAPTIONED} from part) select p_partkey, p_partkey % 4 = 0 as has_prefix from b where text <> '' and (p_partkey % 4 = 0 or size < 10 or italic) and width_ratio <= 1")
def caption_candidates(spark: SparkSession, d: str) -> DataFrame:
    return book.caption_candidates(table(spark, d, "part").selectExpr(*_columns(CAPTIONED)), F.lit(10.0)).select("p_partkey", "has_prefix")


# --- margins, type, lists ---


@query("with b as (select p_partkey // 40 as doc, p_size / 3.0 as x0 from part), c as (select doc, floor(x0 + 0.5) as edge, count(*) as n from b group by all) select doc, cast(edge as bigint) as margin from (select *, row_number() over (partition by doc order by n desc, edge) as r from c) where r = 1")
def left_margins(spark: SparkSession, d: str) -> DataFrame:
    return book.left_margins(table(spark, d, "part").selectExpr("p_partkey div 40 doc", "p_size / 3.0D x0")).select("doc", F.col("margin").cast("bigint").alias("margin"))


@query("""with r as (select p_partkey // 8 as block, p_partkey as pos, p_name as text, length(p_name) * (6.0 + case when p_partkey // 8 % 2 = 0 then 0 else p_partkey % 3 end) as w from part), a as (select block, pos, w / length(text) as adv from r where length(text) > 3)
select block, count(*) >= 4 and arg_min(adv, pos) > 0 and abs(max(adv) - arg_min(adv, pos)) / arg_min(adv, pos) < 0.01 and abs(min(adv) - arg_min(adv, pos)) / arg_min(adv, pos) < 0.01 as mono from a group by block""")
def monospaced_blocks(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "part").selectExpr("p_partkey div 8 block", "p_partkey at", "p_name text", "0.0D x0", "length(p_name) * (6.0D + if(p_partkey div 8 % 2 = 0, 0, p_partkey % 3)) x1")
    return book.monospaced(runs)


ITEMS = "p_partkey // 20 as doc, p_partkey // 10 as run, p_partkey as pos, case p_partkey % 3 when 0 then 0.0 when 1 then 0.0 else 12.0 end as x0, case when p_partkey % 3 = 2 then '• ' || p_name when p_partkey // 10 % 4 = 3 and p_partkey % 2 = 0 then 'a) x' else (p_partkey % 10 + 1) || '. ' || p_name end as line"


@query(f"""with i as (select {ITEMS} from part), m as (select *, case when line like '• %' then 'bullet' when regexp_matches(line, '^[0-9]') then 'decimal' else 'alpha' end as kind, case when line like '• %' then null when regexp_matches(line, '^[0-9]') then cast(regexp_extract(line, '^([0-9]+)', 1) as int) else 1 end as ordinal from i),
s as (select *, floor((x0 - min(x0) over (partition by doc, run)) / 3.0) as step from m), d as (select *, dense_rank() over (partition by doc, run order by step) as depth from s),
ok as (select doc, run from d where depth = 1 group by all having count(*) >= 2 and count(distinct kind) = 1), w as (select d.*, row_number() over o = 1 as first, lag(ordinal) over o as was from d join ok using (doc, run) window o as (partition by d.doc, d.run, depth order by pos))
select doc, run, pos as "at", depth, kind, coalesce(ordinal, -1) as ordinal, coalesce(case when first and ordinal <> 1 then ordinal end, -1) as start, coalesce(ordinal <> was + 1 and kind <> 'bullet', false) as gap from w""")
def built_lists(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").selectExpr(*[c.replace("0.0 ", "0.0D ").replace("12.0 ", "12.0D ") for c in spark_sql(ITEMS)]).withColumnRenamed("pos", "at")
    out = book.built_lists(lines)
    return out.select("doc", "run", "at", F.col("depth").cast("bigint").alias("depth"), "kind", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), F.coalesce("start", F.lit(-1)).alias("start"), "gap")
