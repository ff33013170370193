"""Queries on headings, tables and the hyphen classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import headings, hyphens, tables
from scriptorium.plans.book_queries import spark_sql
from scriptorium.plans.registry import registry
from scriptorium.plans.text_queries import WORDS, rounded
from scriptorium.sources.readers import table, words_of

QUERIES, ORACLE_SQL, query = registry()

BLOCK = "p_partkey // 40 as doc, p_partkey as block, p_partkey as pos, p_partkey // 4 as page, case p_partkey % 9 when 0 then '1.2 ' || p_name when 4 then p_name || ',' when 6 then 'x....' else p_name end as text, p_size / 60.0 as width_ratio, p_size % 20 * 1.0 as space_above"
RUNS_SQL = "runs as (select l_partkey // 40 as doc, l_partkey as block, case when l_suppkey % 4 < 3 then l_suppkey % 4 end as cluster, l_returnflag || ' ' || l_linestatus as text from lineitem)"
DOM_SQL = f"{RUNS_SQL}, per as (select doc, block, cluster, sum(2) as n from runs group by all), best as (select doc, block, cluster, n, sum(n) over (partition by doc, block) as of_all, row_number() over (partition by doc, block order by case when cluster is null then 1 else 0 end, n desc, cluster desc) as r from per), dom as (select doc, block, cluster from best where r = 1 and cluster is not null and n / of_all >= 0.4)"


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*[c.replace("60.0", "60.0D").replace("1.0 as", "1.0D as") for c in spark_sql(BLOCK)]).withColumnRenamed("pos", "at")


def dominant(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    from scriptorium.config import DEFAULT

    runs = table(spark, d, "lineitem").selectExpr("l_partkey div 40 doc", "l_partkey block", "if(l_suppkey % 4 < 3, l_suppkey % 4, null) cluster", "l_returnflag || ' ' || l_linestatus text")
    return headings.dominant_clusters(runs, replace(DEFAULT, cluster_char_share_min=0.4))


@query(f"with {DOM_SQL} select * from dom")
def dominant_clusters(spark: SparkSession, d: str) -> DataFrame:
    return dominant(spark, d)


CAND_SQL = f"""{DOM_SQL}, b as (select {BLOCK} from part), c as (select b.*, dom.cluster, regexp_matches(trim(text), '[,;:\\-–—]$') as mid_sentence, width_ratio < 0.6 as short_line, space_above <= 0 or space_above > 12 as air,
 length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2 and length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 0.6 * length(regexp_replace(text, '\\s', '', 'g')) as legible from b join dom using (doc, block) where cluster in (1, 2))"""


def found(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    docs = b.select("doc").distinct()
    styles = docs.select("doc", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("cluster"))
    return headings.heading_candidates(b, dominant(spark, d), styles, docs.withColumn("size", F.lit(10.0)))


@query(f"with {CAND_SQL} select block, cluster, mid_sentence, short_line, air, legible, short_line and not mid_sentence and legible as admissible from c")
def heading_candidates(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select("block", "cluster", "mid_sentence", "short_line", "air", "legible", "admissible")


@query("select p_partkey, p_size % 8 > 0 and p_size % 6 > 0 and (p_partkey % 3 = 0 or (p_size % 6 >= 0.5 * (p_size % 8) and p_size % 5 >= 0.8 * (p_size % 8))) as trusted from part")
def outline_trust(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", headings.trust_outline(F.col("p_partkey") % 3 == 0, F.col("p_size") % 8, F.col("p_size") % 6, F.col("p_size") % 5).alias("trusted"))


# skips are closed by a running minimum of level less place, as in heading_level_repair
FIX = "least(level, least(min(level - place) over (partition by doc order by place), 0) + place)"


@query(f"""with {CAND_SQL}, t as (select distinct doc, doc % 3 <> 0 as valid, doc % 3 = 1 as outline from c), o as (select block, 1 + block % 3 as level from c where block % 2 = 0), k as (select block, 1 + block % 2 as level from c where doc % 2 = 0),
j as (select c.*, t.valid, t.outline, o.level as ol, k.level as kl, t.valid and not t.outline and c.doc % 2 = 0 as contents from c join t using (doc) left join o using (block) left join k using (block)),
a as (select *, short_line and not mid_sentence and legible as ok from j), l as (select *, case when outline then ol when contents then kl else least(greatest(cluster - 1 + 1, 1), 3) end as lvl from a where ok or (outline and ol is not null)),
m as (select *, case when outline then 'outline' when contents then 'contents' when regexp_matches(text, '^1[.]2 ') and lvl <> 2 then 'numbering' else 'size' end as source, case when not outline and not contents and regexp_matches(text, '^1[.]2 ') then 2 else lvl end as level from l where lvl is not null),
p as (select *, row_number() over (partition by doc order by pos) as place from m) select block, source, cast({FIX} as int) as level from p""")
def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    c = found(spark, d)
    docs = c.select("doc").distinct()
    trusted = docs.select("doc", (F.col("doc") % 3 != 0).alias("valid"), (F.col("doc") % 3 == 1).alias("outline"))
    outline = c.where("block % 2 = 0").select("doc", "block", (1 + F.col("block") % 3).alias("level"))
    contents = c.where("doc % 2 = 0").select("doc", "block", (1 + F.col("block") % 2).alias("level"))
    ranks = docs.select("doc", F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("cluster"), F.lit(k - 1).alias("tier")) for k in (1, 2)])).alias("x")).select("doc", "x.*")
    return headings.assign_levels(c, ranks, outline, contents, trusted).select("block", "source", F.col("level").cast("int").alias("level"))


@query(f"""with b as (select {BLOCK} from part), h as (select doc, block, pos, 1 + block % 3 as level from b where block % 4 = 0), o as (select doc, block, pos from b where block % 6 = 1 or block % 12 = 4), f as (select doc, min(pos) as first, count(*) as n from o group by doc),
p as (select doc, count(*) as parts from h join f using (doc) where level = 1 and pos > first group by doc), w as (select o.doc, o.block, o.pos, case when parts > 0 and parts < n then 2 else 1 end as level from o join f using (doc) left join p using (doc) where o.block not in (select block from h)),
a as (select *, row_number() over (partition by doc order by pos) as place from (select * from h union all select * from w)) select block, cast({FIX} as int) as level from a""")
def headings_with_openers(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).select("doc", "block", "at", "page", "text")
    h = b.where("block % 4 = 0").withColumn("level", (1 + F.col("block") % 3).cast("int"))
    return headings.with_openers(h, b.where("block % 6 = 1 or block % 12 = 4")).select("block", F.col("level").cast("int").alias("level"))


@query(f"""with b as (select {BLOCK} from part), h as (select doc, block, pos, block % 5 as cluster, 1 + block % 3 as level, case when block % 3 = 0 then 'outline' else 'size' end as source from b),
e as (select *, case when source = 'size' and cluster = 2 then 1 else level end as lvl from h where not (source = 'size' and cluster in (3, 4))), a as (select doc, block, lvl as level, row_number() over (partition by doc order by pos) as place from e) select block, cast({FIX} as int) as level from a""")
def heading_edits(spark: SparkSession, d: str) -> DataFrame:
    h = blocks(spark, d).select("doc", "block", "at", (F.col("block") % 5).alias("cluster"), (1 + F.col("block") % 3).cast("int").alias("level"), F.when(F.col("block") % 3 == 0, "outline").otherwise("size").alias("source"))
    rows = F.array(*[F.struct(F.lit(c).cast("bigint").alias("cluster"), F.lit(n).cast("int").alias("new_level"), F.lit(x).cast("string").alias("demote")) for c, n, x in ((2, 1, None), (3, None, "paragraph"), (4, None, "epigraph"))])
    edits = h.select("doc").distinct().select("doc", F.inline(rows))
    return headings.apply_heading_edits(h, edits).select("block", F.col("level").cast("int").alias("level"))


@query("with b as (select p_partkey // 40 as doc, p_partkey // 4 as page, arg_min(p_size * 1.0, p_partkey) as y0 from part group by all), l as (select doc, list_sort(list(y0)) as y from b group by doc) select doc, cast(y[len(y) // 2 + 1] as double) as top from l")
def usual_tops(spark: SparkSession, d: str) -> DataFrame:
    return headings.usual_tops(table(spark, d, "part").selectExpr("p_partkey div 40 doc", "p_partkey div 4 page", "p_partkey at", "p_size * 1.0D y0"))


RUN_IN = "p_partkey // 3 as block, p_partkey as pos, case p_partkey % 5 when 0 then p_name || '.' when 1 then p_name || ' —' when 2 then p_name || ' a b c d e f g h.' else p_name end as text, case when p_size % 2 = 0 then 700 else 400 end as weight, p_size % 3 = 0 as italic"


@query(f"""with r as (select {RUN_IN} from part), n as (select *, weight >= 600 as bold, lead(weight >= 600) over (partition by block order by pos) as tb, lead(italic) over (partition by block order by pos) as ti, row_number() over (partition by block order by pos) as k from r),
s as (select *, regexp_replace(trim(text), '[.—:– ]+$', '') as bare from n where k = 1 and tb is not null)
select block, bare as text, len(regexp_extract_all(bare, '\\S+')) as words from s where (bold or italic) and not (bold = tb and italic = ti) and bare <> trim(text) and len(regexp_extract_all(bare, '\\S+')) between 1 and 8""")
def run_in_headings(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "part").selectExpr(*spark_sql(RUN_IN)).withColumnRenamed("pos", "at").withColumn("doc", F.lit(0))
    return headings.run_in_candidates(runs).select("block", "text", "words")


@query("""with recursive e as (select p_partkey // 40 as doc, p_partkey // 10 as page, p_partkey as pos, p_size % 7 * 3.0 as x0, case when p_partkey % 4 > 0 then p_size end as folio from part),
i as (select *, x0 - coalesce(min(case when folio is not null then x0 end) over (partition by doc, page), 0.0) as indent from e), v as (select distinct doc, indent from i where folio is not null), o as (select *, row_number() over (partition by doc order by indent) as k from v),
r as (select doc, k, indent as kept, 1 as rung from o where k = 1 union all select o.doc, o.k, case when o.indent - r.kept < 4 then r.kept else o.indent end, case when o.indent - r.kept < 4 then r.rung else r.rung + 1 end from o join r on o.doc = r.doc and o.k = r.k + 1),
l as (select distinct doc, kept, rung from r) select i.pos as \"at\", least(greatest(coalesce(max(rung), 0), 1), 3) as level from i left join l on l.doc = i.doc and i.indent + 4 > l.kept group by i.pos""")
def contents_levels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "part").selectExpr("p_partkey div 40 doc", "p_partkey div 10 page", "p_partkey at", "p_size % 7 * 3.0D x0", "if(p_partkey % 4 > 0, p_size, null) folio")
    return headings.contents_levels(e).select("at", F.col("level").cast("int").alias("level"))


MULTI = "p_partkey // 40 as doc, p_partkey as block, p_partkey as pos, p_partkey - p_partkey // 7 as ord, p_partkey // 5 as page, case p_partkey % 6 when 0 then 'Chapter ' || p_size when 3 then 'IV' else p_name end as text, 10.0 + p_size % 3 as size, p_partkey * 20.0 as y0, p_partkey * 20.0 + p_size % 20 + 2 as y1"


@query(f"""with h as (select {MULTI} from part), k as (select *, len(regexp_extract_all(text, '\\S+')) <= 4 and (text = 'IV' or regexp_matches(text, '^Chapter [0-9]+$')) as label from h), w as (select *, lag(size) over o as ws, lag(y1) over o as wy, lag(ord) over o as wo, lag(page) over o as wp, lag(label) over o as wl from k window o as (partition by doc order by pos)),
g as (select *, coalesce(ord = wo + 1 and page = wp and ((abs(size - ws) / greatest(size, ws) <= 0.1 and y0 - wy >= -1 and y0 - wy <= 1.2 * greatest(size, ws)) or (wl and not label and y0 - wy >= -1 and y0 - wy <= 3 * greatest(size, ws))), false) as on_ from w),
n as (select *, sum(case when on_ then 0 else 1 end) over (partition by doc order by pos) as grp from g) select block, head from (select block, on_, first_value(block) over (partition by doc, grp order by pos) as head from n) where on_""")
def joined_headings(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "part").selectExpr(*[c.replace("20.0", "20.0D").replace("10.0 ", "10.0D ") for c in spark_sql(MULTI)]).withColumnRenamed("pos", "at").withColumnRenamed("ord", "order")
    return headings.join_multiline(h).select("block", "head")


@query()
def bound_outline(spark: SparkSession, d: str) -> DataFrame:
    """A greedy fold over a document's entries, which SQL doesn't say; the tests hold it against known cases."""
    b = blocks(spark, d).select("doc", "block", "at", "page", "text").withColumn("admissible", F.col("block") % 3 != 0)
    e = b.where("block % 5 = 0").select("doc", F.col("block").alias("entry"), F.concat("text", F.lit("s")).alias("title"), F.lit(1).alias("level"), F.when(F.col("block") % 2 == 0, F.col("page")).alias("page"))
    return headings.bind(b, e)


@query()
def chapter_openers(spark: SparkSession, d: str) -> DataFrame:
    """A chain of numbers through a book; a fold, which the tests hold against known cases."""
    p = table(spark, d, "part")
    b = p.selectExpr("p_partkey div 40 doc", "p_partkey block", "p_partkey at", "p_partkey div 2 page", "if(p_partkey % 8 = 0, cast(p_partkey % 40 div 8 + 1 as string), p_name) text", "if(p_partkey % 8 = 0, 200.0D, 50.0D) y0", "0.0D space_above", "1 lines")
    return headings.chapter_openers(b, b.select("doc").distinct().withColumn("size", F.lit(10.0)))


# --- tables: grids of rules and the runs in them ---

GRID = "vec_id // 12 as page, vec_id % 12 // 4 as r, vec_id % 4 as c, 'w' || label as word"


def grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").selectExpr(*spark_sql(GRID))
    pages = v.select("page").distinct()
    lines = [(0.0, 20.0 * k, 200.0, 20.0 * k + 1, True) for k in range(4)] + [(50.0 * k, 0.0, 50.0 * k + 1, 61.0, True) for k in range(5)]
    rules = pages.select("page", F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("x0", "y0", "x1", "y1", "is_rule"), r, strict=True)]) for r in lines])))
    runs = v.selectExpr("page", "page * 100 + r block", "r * 4 + c at", "word text", "c * 50 + 5.0D x0", "r * 20 + 5.0D y0", "c * 50 + 40.0D x1", "r * 20 + 15.0D y1")
    return rules, runs


@query(f"with v as (select {GRID} from embeddings), p as (select page, count(distinct r) as rows from v group by page) select v.page, 0 as \"table\", r as \"row\", c as \"column\", word as text, true as grid from v")
def ruled_tables(spark: SparkSession, d: str) -> DataFrame:
    return tables.extract_tables(*grid(spark, d)).where("text <> ''").selectExpr("page", "cast(`table` as int) `table`", "cast(row as bigint) row", "cast(column as bigint) column", "text", "grid")


@query("""with v as (select distinct vec_id // 12 as page from embeddings) select page, 0.0 as x0, 20.0 * k as y0, 201.0 as x1, 20.0 * k + 1 as y1 from v, (select unnest(range(0, 4)) as k) where k not in (0, 3)
union all select page, 0.0, 20.0 * k, 201.0, 20.0 * k + 1 from v, (select unnest([0, 3]) as k)""")
def page_rules(spark: SparkSession, d: str) -> DataFrame:
    rules, _ = grid(spark, d)
    # lying rules in two pieces that nearly touch, which come back as one
    pieces = rules.where("x1 - x0 > 100").select("page", F.inline(F.array(F.struct("x0", "y0", F.lit(99.0).alias("x1"), "y1", "is_rule"), F.struct(F.lit(100.0).alias("x0"), "y0", F.lit(201.0).alias("x1"), "y1", "is_rule"))))
    return tables.page_rules(pieces)


FURN = "p_partkey // 40 as doc, p_partkey // 4 as page, case when p_partkey % 4 = 0 then 0.0 else p_size * 7.0 end as x0, case when p_partkey % 4 = 0 then 30.0 + p_size % 3 else p_size * 11.0 end as y0"


@query(f"""with r as (select {FURN}, p_partkey as id from part), q as (select *, floor(x0 / 3.0 + 0.5) as a, floor(y0 / 3.0 + 0.5) as b, floor((x0 + 100) / 3.0 + 0.5) as c, floor((y0 + 1) / 3.0 + 0.5) as e from r), n as (select doc, count(distinct page) as n from r group by doc)
select id from q x join n using (doc) where (select count(distinct page) from q y where y.doc = x.doc and abs(y.a - x.a) <= 1 and abs(y.b - x.b) <= 1 and abs(y.c - x.c) <= 1 and abs(y.e - x.e) <= 1) >= greatest(3, ceil(n.n * 0.2))""")
def furniture_rules(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "part").selectExpr(*[c.replace("0.0 ", "0.0D ") for c in spark_sql(FURN)], "p_partkey id").withColumns({"x0": F.col("x0").cast("double"), "y0": F.col("y0").cast("double")})
    r = r.withColumns({"x1": F.col("x0") + 100, "y1": F.col("y0") + 1})
    return tables.furniture_rules(r, r.groupBy("doc").agg(F.countDistinct("page").alias("n"))).select("id")


@query("""with r as (select p_partkey // 10 as page, p_partkey as pos, p_name as text, p_size * 1.0 as x, p_size % 13 * 5.0 as y from part), c as (select *, case when x between 0 and 10 then 0 when x between 10 and 25 then 1 when x between 25 and 40 then 2 end as cc, case when y between 0 and 20 then 0 when y between 20 and 50 then 1 end as rr from r)
select page, cast(rr as bigint) as \"row\", cast(cc as bigint) as \"column\", string_agg(trim(text), ' ' order by pos) as text from c where rr is not null and cc is not null group by page, rr, cc""")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "part").selectExpr("p_partkey div 10 page", "p_partkey at", "p_name text", "p_size * 1.0D x", "p_size % 13 * 5.0D y")
    ladders = runs.select("page").distinct().select("page", F.array(*map(F.lit, [0.0, 20.0, 50.0])).alias("rows"), F.array(*map(F.lit, [0.0, 10.0, 25.0, 40.0])).alias("columns"))
    return tables.cells_of(runs, ladders).selectExpr("page", "cast(row as bigint) row", "cast(column as bigint) column", "text")


@query(f"select source, word, count(*) as n from (select source, unnest({WORDS.format(t='text')}) as word from documents) group by all")
def word_multisets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return tables.word_multiset(docs, ["source"])


# --- the hyphen classifier ---

SPLIT = f"w as (select distinct unnest({WORDS.format(t='text')}) as w from benchmark), b as (select w as id, substr(w, 1, length(w) // 2) as head, substr(w, length(w) // 2 + 1) as tail from w where length(w) >= 5)"


def splits(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "benchmark").select(F.explode(words_of(F.col("text"))).alias("w")).distinct().where("length(w) >= 5")
    return w.selectExpr("w id", "substring(w, 1, length(w) div 2) head", "substring(w, length(w) div 2 + 1) tail", "'en-GB' lang")


def _features_sql() -> str:
    last = lambda n: f"case when length(head) <= {n} then lower(head) else substr(lower(head), length(head) - {n - 1}) end"
    flag = lambda c: f"case when {c} then 'True' else 'False' end"
    parts = ["'bias'", "'lang=en'", "'hl=' || least(length(head), 9)", "'tl=' || least(length(tail), 9)", "'hup=' || " + flag("regexp_matches(head, '^\\p{Lu}')"), "'tup=' || " + flag("regexp_matches(tail, '^\\p{Lu}')"), "'hyp=' || " + flag("contains(head, '-') or contains(tail, '-')")]
    for n in (1, 2, 3):
        parts += [f"'h{n}=' || {last(n)}", f"'t{n}=' || substr(lower(tail), 1, {n})"]
    return "[" + ", ".join([*parts, f"'j=' || {last(1)} || '|' || substr(lower(tail), 1, 1)"]) + "]"


FNV = "list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(range(1, strlen(f) + 1), lambda i: cast((strpos('0123456789ABCDEF', substr(hex(encode(f)), 2 * i - 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(f)), 2 * i, 1)) - 1 as bigint))), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


@query(f"with {SPLIT} select id, array_to_string({_features_sql()}, ' ') as features from b")
def hyphen_features(spark: SparkSession, d: str) -> DataFrame:
    return splits(spark, d).select("id", F.array_join(hyphens.features(F.col("head"), F.col("tail"), F.col("lang")), " ").alias("features"))


@query(f"""with {SPLIT}, f as (select id, unnest({_features_sql()}) as f from b), h as (select id, {FNV} % 8192 as bucket from f), s as (select id, 0.05 + sum((bucket * 37 % 101 - 50) / 100.0) as score from h group by id)
select id, round(score, 6) as score, case when score >= 0.25 then 'keep' when score <= -0.25 then 'join' else 'undecided' end as action from s""")
def hyphen_scores(spark: SparkSession, d: str) -> DataFrame:
    weights = spark.range(hyphens.BUCKETS).select(F.col("id").alias("bucket"), ((F.col("id") * 37 % 101 - 50) / 100.0).alias("weight"))
    return rounded(hyphens.score_breaks(splits(spark, d), weights, 0.05).select("id", "score", "action"), "score")


COUNTS = f"c as (select lower(w) as word, count(*) as n from (select unnest({WORDS.format(t='text')}) as w from documents) where regexp_full_match(w, '[A-Za-z]+(-[A-Za-z]+)?') group by all)"


def counted(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(words_of(F.col("text"))).alias("w")).where(F.rlike("w", F.lit("^[A-Za-z]+(-[A-Za-z]+)?$")))
    # few words of these tables have a hyphen: every word of ten letters or more stands with one as well
    counts = w.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    return counts.union(counts.where("length(word) >= 10 and instr(word, '-') = 0").select(F.expr("substring(word, 1, 5) || '-' || substring(word, 6)").alias("word"), "n"))


@query(f"""with {COUNTS}, a as (select * from c union all select substr(word, 1, 5) || '-' || substr(word, 6), n from c where length(word) >= 10 and strpos(word, '-') = 0), w as (select word, word as f from a where n >= 2),
p as (select word, 2 + {FNV} % (length(word) - 3) as pos from w where strpos(word, '-') = 0 and length(word) >= 4)
select word, split_part(word, '-', 1) as head, substr(word, strpos(word, '-') + 1) as tail, true as keep from w where strpos(word, '-') > 0 and length(split_part(word, '-', 1)) >= 2 and length(substr(word, strpos(word, '-') + 1)) >= 2
union all select word, substr(word, 1, pos), substr(word, pos + 1), false from p""")
def hyphen_examples(spark: SparkSession, d: str) -> DataFrame:
    return hyphens.build_examples(counted(spark, d))


@query()
def hyphen_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Trained on two thirds of the examples, measured on the rest."""
    e = hyphens.build_examples(counted(spark, d)).withColumn("held", F.crc32(F.col("word").cast("binary")) % 3 == 0)
    weights, bias = hyphens.train(e.where("not held").drop("held"))
    some = np.flatnonzero(weights)
    table_ = spark.createDataFrame([(int(i), float(weights[i])) for i in some], "bucket bigint, weight double")
    scored = hyphens.score_breaks(e.where("held").select(F.col("word").alias("id"), "head", "tail", F.lit("en").alias("lang"), "keep"), table_, bias)
    return hyphens.metrics(scored)


@query("""with s as (select quality = 1 as keep, toxic - 0.5 as score from labels) select round(count(*) filter (keep and score > 0) / greatest(count(*) filter (keep), 1), 6) as keep_recall, round(count(*) filter (not keep and score <= 0) / greatest(count(*) filter (not keep), 1), 6) as join_recall,
 round(avg(case when (score > 0) = keep then 1.0 else 0.0 end), 6) as accuracy, round((count(*) filter (keep and score > 0) / greatest(count(*) filter (keep), 1) + count(*) filter (not keep and score <= 0) / greatest(count(*) filter (not keep), 1)) / 2, 6) as balanced_accuracy from s""")
def hyphen_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labels").select((F.col("quality") == 1).alias("keep"), (F.col("toxic") - 0.5).alias("score"))
    return rounded(hyphens.metrics(s), "keep_recall", "join_recall", "accuracy", "balanced_accuracy")


WORD_LIST = f"a as (select distinct lower(w) as word from (select unnest({WORDS.format(t='text')}) as w from documents) where regexp_full_match(w, '[A-Za-z]{{3,}}'))"
COMPOUND_SQL = f"""{WORD_LIST}, cuts as (select word, seam, substr(word, 1, seam) as l, substr(word, seam + 1) as rest from (select word, unnest(range(3, length(word) - 2)) as seam from a where length(word) >= 6)),
o as (select word, seam, l, rest, unnest(['', 'es', 'en', 'er', 's', 'n']) as link, unnest([0, 1, 2, 3, 4, 5]) as rank from cuts where l in (select word from a)),
f as (select *, substr(rest, length(link) + 1) as r from o where starts_with(rest, link)), g as (select *, row_number() over (partition by word order by seam, rank) as k from f where length(r) >= 3 and r in (select word from a)),
comp as (select word, l as "left", link, r as "right" from g where k = 1)"""


def word_list(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(words_of(F.col("text"))).alias("w")).where(F.rlike("w", F.lit("^[A-Za-z]{3,}$")))
    return w.select(F.lower("w").alias("word")).distinct()


@query(f'with {COMPOUND_SQL} select word, "left", link, "right" from comp')
def compound_splits(spark: SparkSession, d: str) -> DataFrame:
    words = word_list(spark, d)
    return hyphens.split_compounds(words, words)


PIECES = "b as (select w as id, substr(w, 1, 4) as head, substr(w, 5) as tail from (select distinct w from (select unnest(" + WORDS.format(t="text") + ") as w from documents) where regexp_full_match(w, '[A-Za-z]{8,}')))"


def pieces(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(words_of(F.col("text"))).alias("w")).where(F.rlike("w", F.lit("^[A-Za-z]{8,}$"))).distinct()
    return w.selectExpr("w id", "substring(w, 1, 4) head", "substring(w, 5) tail")


@query(f"""with {COMPOUND_SQL}, {PIECES} select id, 'keep' as decision from b where regexp_matches(head, '^[A-Z]') and regexp_matches(tail, '^[A-Z]') union all select id, 'join' from b where not (regexp_matches(head, '^[A-Z]') and regexp_matches(tail, '^[A-Z]')) and lower(head || tail) in (select word from comp)""")
def german_decisions(spark: SparkSession, d: str) -> DataFrame:
    return hyphens.german_decisions(pieces(spark, d), word_list(spark, d))


@query(f"""with {WORD_LIST}, {PIECES}, k as (select id, lower(head || tail) in (select word from a where length(word) % 2 = 0) as w, lower(head) in (select word from a where length(word) % 2 = 0) as h, lower(tail) in (select word from a where length(word) % 2 = 0) as t from b)
select id, case when h and t and not w then 'keep' else 'join' end as decision from k where (h and t and not w) or (w and not (h and t))""")
def word_list_decisions(spark: SparkSession, d: str) -> DataFrame:
    return hyphens.word_list_decisions(pieces(spark, d), word_list(spark, d).where("length(word) % 2 = 0"))


@query(f"with w as (select distinct lower(w) as word from (select unnest({WORDS.format(t='text')}) as w from benchmark) where regexp_full_match(w, '[A-Za-z]+')) select count(*) as size, md5(string_agg(word, chr(10) order by word)) as blob_md5 from w")
def word_blob(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "benchmark").select(F.explode(words_of(F.col("text"))).alias("w")).where(F.rlike("w", F.lit("^[A-Za-z]+$"))).select(F.lower("w").alias("word"))
    return hyphens.word_blob(w).select("size", F.md5(F.col("blob").cast("binary")).alias("blob_md5"))
