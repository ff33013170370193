"""Queries for contents, lists, readers' words, admission, outcomes and event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import contents, evaluate, ocr, structure
from scriptorium.plans.structure_queries import log_rows
from scriptorium.plans.text_queries import LINES, rects, rounded
from scriptorium.sources.readers import document_lines, html_blocks, table
from scriptorium.sources.sinks import cache_key, event_lines

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add




NUMBER_DIGIT = "case c when 'i' then 1 when 'v' then 5 when 'x' then 10 when 'l' then 50 when 'c' then 100 when 'd' then 500 else 1000 end"


@query(f"""with l as (select source as doc, doc_id as page, i - 1 as pos, lines[i] as line from (select source, doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select source, doc_id, {LINES.format(t="text")} as lines from documents))),
n as (select *, regexp_extract(regexp_replace(line, '\\s+$', ''), '([\\p{{L}}\\p{{N}}]+)$', 1) as number, trim(regexp_replace(regexp_replace(line, '[\\p{{L}}\\p{{N}}]+\\s*$', ''), '[\\s.·…_\\-‧•]+$', '')) as title from l),
rn as (select distinct number from n where regexp_full_match(number, '[ivxlcdm]{{1,8}}|[IVXLCDM]{{1,8}}')), rd as (select number, i, {NUMBER_DIGIT} as v from (select number, i, string_split(lower(number), '')[i] as c from (select number, unnest(range(1, length(number) + 1)) as i from rn))),
rv as (select number, sum(case when v < nx then -v else v end) as value from (select number, v, coalesce(lead(v) over (partition by number order by i), 0) as nx from rd) group by number),
e as (select n.doc, n.page, n.pos, case when regexp_full_match(n.number, '[0-9]{{1,4}}') then cast(n.number as bigint) else rv.value end as value from n left join rv on rv.number = n.number where regexp_matches(title, '\\p{{L}}')),
w as (select *, lag(value) over (partition by doc, page order by pos) as was from e where value >= 0), g as (select doc, page, count(*) as entries, count(was) as pairs, count(*) filter (value >= was) as up from w group by all), p as (select doc, page, count(*) as rows_ from l group by all)
select doc, page, rows_ as "rows", coalesce(entries, 0) as entries, round(case when coalesce(pairs, 0) = 0 then 1.0 else up / pairs end, 6) as rising, coalesce(entries, 0) >= 3 and coalesce(entries, 0) / rows_ >= 0.4 and case when coalesce(pairs, 0) = 0 then 1.0 else up / pairs end >= 0.8 as is_contents from p left join g using (doc, page)""")
def contents_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("doc", F.col("source"))
    lines = document_lines(docs).join(docs.select("doc_id", "doc"), "doc_id").select("doc", F.col("doc_id").alias("page"), F.col("line_no").alias("at"), "line")
    return rounded(contents.contents_pages(lines), "rising")




WORDS_SQL = """w as (select l_suppkey % 20 as page, l_linenumber as block_num, l_partkey % 3 as par_num, l_orderkey % 50 as line_num, cast(l_quantity as bigint) * 1000000 + l_orderkey as word_num, l_returnflag || l_linestatus as text,
 l_discount * 100 as x0, l_tax * 100 as y0, l_discount * 100 + l_quantity as x1, l_tax * 100 + 5 + l_quantity / 10 as y1, l_discount * 10 as confidence from lineitem)"""


def reader_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_suppkey % 20 page", "l_linenumber block_num", "l_partkey % 3 par_num", "l_orderkey % 50 line_num", "cast(l_quantity as bigint) * 1000000 + l_orderkey word_num", "l_returnflag || l_linestatus text",
        "l_discount * 100 x0", "l_tax * 100 y0", "l_discount * 100 + l_quantity x1", "l_tax * 100 + 5 + l_quantity / 10 y1", "l_discount * 10 confidence",
    )


@query(f"""with {WORDS_SQL}, h as (select page, block_num, par_num, line_num, count(*) as n, string_agg(text, ' ' order by word_num, text) as text, min(x0) as x0, max(x1) as x1, list_sort(list(y1 - y0)) as hs from w group by all),
s as (select *, hs[len(hs) // 2 + 1] as size from h), m as (select *, quantile_cont(size, 0.5) over (partition by page) as med from s)
select page, block_num, par_num, line_num, md5(text) as text_md5, round(x0, 4) as x0, round(x1, 4) as x1, round(case when abs(size - med) <= 0.25 * med then med else size end, 4) as size from m""")
def reader_lines(spark: SparkSession, d: str) -> DataFrame:
    out = ocr.merge_words(reader_words(spark, d))
    return out.select("page", "block_num", "par_num", "line_num", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.round("x0", 4).alias("x0"), F.round("x1", 4).alias("x1"), F.round("size", 4).alias("size"))


@query(f"with {WORDS_SQL} select page, block_num, count(*) as words, round(avg(confidence), 6) as mean, count(*) filter (confidence < 0.3) as low from w group by all")
def region_confidence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ocr.region_confidence(reader_words(spark, d), ["page", "block_num"], 0.3), "mean")


@query("""with o as (select vec_id // 20 as region, least(embedding[2], embedding[4])::double as y0, least(embedding[2], embedding[4])::double + 0.002 as y1 from embeddings),
c as (select region, greatest(y0, -1.0) as a, least(y1, 1.0) as b from o where y0 < 1.0 and y1 > -1.0), regions as (select distinct vec_id // 20 as region from embeddings),
e as (select region, a, b from c union all select region, 1.0, 1.0 from regions), r as (select region, a, coalesce(max(b) over (partition by region order by a, b rows between unbounded preceding and 1 preceding), -1.0) as reached from e)
select region, round(reached, 6) as y0, round(a, 6) as y1 from r where a > reached""")
def clean_bands(spark: SparkSession, d: str) -> DataFrame:
    boxes = rects(spark, d)
    regions = boxes.select(F.col("page").alias("region")).distinct().select("region", F.lit(-1.0).alias("y0"), F.lit(1.0).alias("y1"))
    blocked = boxes.select(F.col("page").alias("region"), F.col("rect.y0").alias("y0"), (F.col("rect.y0") + 0.002).alias("y1"))
    return rounded(ocr.clean_bands(regions, blocked), "y0", "y1")


@query("""with c as (select o_orderkey // 500 as source, o_orderkey as pos, case when o_orderkey % 11 = 0 then o_custkey else o_orderkey + 1000000000 end as id, o_orderpriority as license, cast(o_totalprice as bigint) as bytes, o_orderkey % 30 as pages, o_orderkey % 97 = 0 as encrypted from orders),
k as (select c.*, c.id in (select c_custkey from customer where c_acctbal > 5000) as known, row_number() over (partition by source, id order by pos) > 1 as again from c),
r as (select *, case when known or again then 'duplicate' when bytes > 400000 then 'too-large' when license not in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 'licence' when encrypted then 'unreadable' when pages < 4 then 'too-short' end as reason from k),
s as (select *, coalesce(sum(case when reason is null then bytes else 0 end) over (partition by source order by pos rows between unbounded preceding and 1 preceding), 0) >= 20000000 as over from r),
n as (select *, sum(case when over and reason is distinct from 'duplicate' then 1 else 0 end) over (partition by source order by pos) as nth from s)
select source, pos, id, case when reason = 'duplicate' and nth = 0 then 'duplicate' when over then 'budget' else coalesce(reason, 'admitted') end as reason from n where nth = 0 or (nth = 1 and over and reason is distinct from 'duplicate')""")
def harvest_admission(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("o_orderkey div 500 source", "o_orderkey at", "if(o_orderkey % 11 = 0, o_custkey, o_orderkey + 1000000000) id", "o_orderpriority license", "cast(rint(o_totalprice) as bigint) bytes", "o_orderkey % 30 pages", "o_orderkey % 97 = 0 encrypted")
    known = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    return evaluate.admit(o, known, ["1-URGENT", "2-HIGH", "3-MEDIUM"], 400_000, 20_000_000).withColumnRenamed("at", "pos")


@query("""with x as (select l.doc_id, d.source as task, d.lang, quality = 1 as first, toxic = 0 as second from labels l join documents d using (doc_id)), b as (select task, lang, count(*) as n, count(*) filter (first and not second) as broken from x group by all)
select task, cast(sum(n) as bigint) as n, cast(sum(broken) as bigint) as broken, bool_and(broken / n <= 0.01) as pass from b group by task""")
def false_repair_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("task"), "lang"), "doc_id").select("task", "lang", (F.col("quality") == 1).alias("first"), (F.col("toxic") == 0).alias("second"))
    return evaluate.passes(rows)


@query("""with e as (select user_id as job, epoch_us(ts) // 1000 as ts_ms, event_type as t, event_id from events) select job, row_number() over (partition by job order by ts_ms, t, event_id) - 1 as seq, ts_ms, t from e""")
def event_sequence(spark: SparkSession, d: str) -> DataFrame:
    e = log_rows(spark, d).select("job", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("stage").alias("t"), F.lit("").alias("payload"))
    line = event_lines(e)
    return line.select("job", F.col("seq").cast("bigint").alias("seq"), F.get_json_object("line", "$.ts_ms").cast("bigint").alias("ts_ms"), F.get_json_object("line", "$.t").alias("t"))


@query("select p_partkey, sha256(length(p_name) || ':' || p_name || ';' || length(p_brand) || ':' || p_brand || ';') as key from part")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", cache_key(F.col("p_name"), F.col("p_brand")).alias("key"))


@query()
def block_order_score(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a page as they stand against the same without its navigation: how much of the order is left."""
    blocks = html_blocks(table(spark, d, "pages")).select(F.col("page_id").alias("doc"), F.col("block_no").alias("at"), "text", "tag")
    return evaluate.block_order_score(blocks.drop("tag"), blocks.where("tag <> 'li'").drop("tag"))




@query("""with recursive v as (select distinct l_suppkey % 30 as key, cast(round(l_extendedprice / 500) * 2 as double) as value from lineitem), o as (select *, row_number() over (partition by key order by value) as i from v),
r as (select key, i, value as kept from o where i = 1 union all select o.key, o.i, case when o.value - r.kept <= 3.0 then r.kept else o.value end from o join r on o.key = r.key and o.i = r.i + 1)
select key, count(distinct kept) as n, round(sum(distinct kept), 4) as total from r group by key""")
def rule_ladders(spark: SparkSession, d: str) -> DataFrame:
    out = structure.snapped(table(spark, d, "lineitem").selectExpr("l_suppkey % 30 key", "cast(round(l_extendedprice / 500) * 2 as double) value"))
    return out.select("key", F.size("values").cast("bigint").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))
