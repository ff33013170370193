"""Queries on evaluation, model answers and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import answers, evaluate, metrics
from scriptorium.plans.book_queries import TREE, spark_sql
from scriptorium.plans.registry import registry
from scriptorium.plans.text_queries import rounded
from scriptorium.sources.readers import table
from scriptorium.streaming import jobs

QUERIES, ORACLE_SQL, query = registry()

# --- sequences: items of twenty parts are one letter each, so that SQL can compare them as texts ---

SEQ_SQL = "p as (select p_partkey // 20 as doc, p_partkey % 20 as i, p_size, p_name, p_type from part)"


@query(f"""with {SEQ_SQL}, t as (select doc, string_agg(chr(cast(33 + i as int)), '' order by i) as t from p group by doc), q as (select *, row_number() over (partition by doc order by p_size, i) as r from p where p_size % 9 <> 0), s as (select doc, string_agg(chr(cast(33 + i as int)), '' order by r) as s, count(*) as n from q group by doc),
k as (select a.doc, sum(sign(b.i - a.i)) as c from q a join q b on a.doc = b.doc and a.r < b.r group by a.doc)
select t.doc, round(1 - levenshtein(t, coalesce(s, '')) / greatest(length(t), length(coalesce(s, ''))), 6) as similarity, round(case when coalesce(n, 0) < 2 then 1.0 else coalesce(c, 0) / (n * (n - 1) / 2) end, 6) as tau, coalesce(n, 0) as common from t left join s using (doc) left join k using (doc)""")
def reading_order_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey div 20 doc", "p_partkey % 20 i", "p_size")
    truth = p.selectExpr("doc", "i at", "cast(i as string) block")
    said = p.where("p_size % 9 <> 0").selectExpr("doc", "p_size * 100 + i at", "cast(i as string) block")
    return rounded(evaluate.reading_order(truth, said), "similarity", "tau")


HEADS_SQL = f"{SEQ_SQL}, t as (select doc, i, 1 + p_size % 3 as level, p_type as text from p where i % 2 = 0), s as (select doc, i, 1 + p_size % 3 + case when i % 8 = 0 then 1 else 0 end as level, p_type as text from p where i % 2 = 0 and i % 10 <> 4)"


def outlines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").selectExpr("p_partkey div 20 doc", "p_partkey % 20 at", "1 + p_size % 3 level", "p_type text").where("at % 2 = 0")
    return p, p.where("at % 10 <> 4").withColumn("level", F.col("level") + F.when(F.col("at") % 8 == 0, 1).otherwise(0))


@query(f"""with {HEADS_SQL}, a as (select doc, level, text, count(*) as t from t group by all), b as (select doc, level, text, count(*) as s from s group by all), g as (select doc, sum(least(coalesce(t, 0), coalesce(s, 0))) as m, sum(coalesce(t, 0)) as t, sum(coalesce(s, 0)) as s from a full join b using (doc, level, text) group by doc)
select doc, round(m / s, 6) as precision, round(m / t, 6) as recall, round(case when m = 0 then 0.0 else 2 * (m / s) * (m / t) / (m / s + m / t) end, 6) as f1 from g""")
def outline_f1(spark: SparkSession, d: str) -> DataFrame:
    truth, said = (x.select("doc", F.concat_ws("|", "level", "text").alias("item")) for x in outlines(spark, d))
    return rounded(metrics.prf(truth, said, ["doc"], "item").select("doc", "precision", "recall", "f1"), "precision", "recall", "f1")


@query(f"""with {HEADS_SQL}, u as (select doc, i, level || '|' || text as item, 0 as side from t union all select doc, i, level || '|' || text, 1 from s), c as (select *, chr(33 + cast(dense_rank() over (partition by doc order by item) as int)) as ch from u),
x as (select doc, string_agg(ch, '' order by i) filter (side = 0) as a, string_agg(ch, '' order by i) filter (side = 1) as b from c group by doc) select doc, levenshtein(coalesce(a, ''), coalesce(b, '')) as distance from x""")
def outline_distances(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.outline_distance(*outlines(spark, d)).select("doc", F.col("distance").cast("bigint").alias("distance"))


CELLS_SQL = f"{SEQ_SQL}, t as (select doc, i // 4 as r, i % 4 as c, p_type as text from p), s as (select doc, i // 4 as r, i % 4 as c, case when p_size % 7 = 0 then 'x' else p_type end as text from p where p_size % 11 <> 0)"


@query(f"""with {CELLS_SQL}, u as (select doc, r, c, r || '|' || c || '|' || text as full_, r || '|' || c as bare, 0 as side from t union all select doc, r, c, r || '|' || c || '|' || text, r || '|' || c, 1 from s),
k as (select *, chr(33 + cast(dense_rank() over (partition by doc order by full_) as int)) as f, chr(33 + cast(dense_rank() over (partition by doc order by bare) as int)) as b from u),
x as (select doc, coalesce(string_agg(f, '' order by r, c) filter (side = 0), '') as tf, coalesce(string_agg(f, '' order by r, c) filter (side = 1), '') as sf, coalesce(string_agg(b, '' order by r, c) filter (side = 0), '') as tb, coalesce(string_agg(b, '' order by r, c) filter (side = 1), '') as sb from k group by doc)
select doc as \"table\", round(1 - levenshtein(tf, sf) / greatest(length(tf), length(sf)), 6) as teds, round(1 - levenshtein(tb, sb) / greatest(length(tb), length(sb)), 6) as teds_s from x""")
def table_similarities(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey div 20 `table`", "p_partkey % 20 div 4 row", "p_partkey % 4 column", "p_type text", "p_size")
    said = p.where("p_size % 11 <> 0").withColumn("text", F.when(F.col("p_size") % 7 == 0, "x").otherwise(F.col("text")))
    return rounded(evaluate.table_similarity(p.drop("p_size"), said.drop("p_size")), "teds", "teds_s")


@query(f"""with {SEQ_SQL}, t as (select doc, cast(i as varchar) || '>' || p_size as item from p), s as (select doc, cast(i as varchar) || '>' || case when i % 5 = 0 then 0 else p_size end as item from p where i % 7 <> 3), m as (select doc, count(*) as m from t join s using (doc, item) group by doc), a as (select doc, count(*) as t from t group by doc), b as (select doc, count(*) as s from s group by doc)
select doc, coalesce(m, 0) as matched, round(coalesce(m, 0) / s, 6) as precision, round(coalesce(m, 0) / t, 6) as recall from a left join b using (doc) left join m using (doc)""")
def note_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey div 20 doc", "p_partkey % 20 i", "p_size")
    said = p.where("i % 7 <> 3").selectExpr("doc", "i || '>' || if(i % 5 = 0, 0, p_size) item")
    return rounded(metrics.prf(p.selectExpr("doc", "i || '>' || p_size item"), said, ["doc"], "item").select("doc", "matched", "precision", "recall"), "precision", "recall")


@query(f"""with {SEQ_SQL}, t as (select doc, i as image, p_type as caption from p where i % 3 = 0), s as (select doc, i as image, case when i % 2 = 0 then p_type else p_name end as caption from p where i % 3 = 0 and i % 5 <> 0 or i % 11 = 1),
a as (select doc, count(*) as t from t group by doc), b as (select doc, count(*) as s from s group by doc), m as (select t.doc, count(*) as m, avg(case when t.caption = s.caption then 1.0 else 0.0 end) as acc from t join s using (doc, image) group by t.doc)
select doc, round(coalesce(m, 0) / s, 6) as precision, round(coalesce(m, 0) / t, 6) as recall, round(coalesce(acc, 1.0), 6) as caption_accuracy, coalesce(m, 0) as checked from a join b using (doc) left join m using (doc)""")
def image_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey div 20 doc", "p_partkey % 20 image", "p_type", "p_name")
    truth = p.where("image % 3 = 0").selectExpr("doc", "image", "p_type caption")
    said = p.where("image % 3 = 0 and image % 5 <> 0 or image % 11 = 1").selectExpr("doc", "image", "if(image % 2 = 0, p_type, p_name) caption")
    return rounded(evaluate.image_scores(truth, said).select("doc", "precision", "recall", "caption_accuracy", "checked"), "precision", "recall", "caption_accuracy")


@query("""with p as (select case p_size % 3 when 0 then 'ours' when 1 then 'scan' else 'print' end as stratum, p_name as truth, replace(p_name, 'e', case when p_size % 3 = 0 then 'c' else 'oo' end) as said from part), s as (select stratum, count(*) as n, avg(levenshtein(truth, said) / length(truth)) as cer from p group by stratum)
select stratum, n, round(cer, 6) as cer, round(cer - (select cer from s where stratum = 'ours'), 6) as gap from s""")
def reader_error_gap(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("case p_size % 3 when 0 then 'ours' when 1 then 'scan' else 'print' end stratum", "p_name truth", "replace(p_name, 'e', if(p_size % 3 = 0, 'c', 'oo')) said")
    return rounded(evaluate.reader_error_rates(p), "cer", "gap")


# --- gates on outcomes ---

OUT_SQL = "o as (select o_custkey % 3 as task, o_orderpriority as language, o_orderkey % 4 as category, o_orderkey % 50 <> 7 as first, o_orderkey % 40 <> 9 as second from orders), f as (select task, language, category, count(*) as n, count(*) filter (second and not first) as b, count(*) filter (first and not second) as c from o group by all)"


def repairs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("o_custkey % 3 task", "o_orderpriority language", "o_orderkey % 4 category", "o_orderkey % 50 <> 7 first", "o_orderkey % 40 <> 9 second")
    return evaluate.false_repairs(o)


@query(f"with {OUT_SQL} select task, language, category, n, b, c, round(c / n, 6) as rate from f")
def false_repair_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(repairs(spark, d), "rate")


Z95 = 1.6448536269514722
NON_INFERIOR = f"case when n = 0 then false when ((b + c) / n - ((b - c) / n) * ((b - c) / n)) / n <= 0 then (b - c) / n > -0.02 else ((b - c) / n + 0.02) / sqrt(((b + c) / n - ((b - c) / n) * ((b - c) / n)) / n) > {Z95} end"


@query(f"with {OUT_SQL}, s as (select task, language, sum(n) as n, sum(b) as b, sum(c) as c, max(c / n) as worst from f group by all) select task, language, {NON_INFERIOR} and worst <= 0.01 as pass from s")
def task_languages(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.passing_languages(repairs(spark, d))


@query(f"""with {OUT_SQL}, e as (select unnest([0, 1, 7]) as task, '1-URGENT' as language) select e.task, e.language, coalesce(category, -1) as category, case when n is null then 'no evaluation' else 'false repairs' end as failure from e left join f on f.task = e.task and f.language = e.language where n is null or c / n > 0.01""")
def enabled_gate(spark: SparkSession, d: str) -> DataFrame:
    enabled = spark.createDataFrame([(k, "1-URGENT") for k in (0, 1, 7)], "task bigint, language string")
    return evaluate.gate_enabled(repairs(spark, d), enabled).withColumn("category", F.coalesce("category", F.lit(-1)))


@query(f"""with s as (select o_orderkey // 100 as grp, count(*) as n, count(*) filter (o_custkey % 9 = 1) as b, count(*) filter (o_custkey % 23 = 2) as c from orders group by 1)
select grp, n, b, c, {NON_INFERIOR} as non_inferior, b > c and least(1.0, 2 * (select sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) from (select unnest(range(0, least(b, c) + 1)) as i))) < 0.05 as superior from s""")
def paired_tests(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").groupBy(F.expr("o_orderkey div 100").alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col("o_custkey") % 9 == 1).alias("b"), F.count_if(F.col("o_custkey") % 23 == 2).alias("c"))
    n, b, c = F.col("n"), F.col("b"), F.col("c")
    return s.select("grp", "n", "b", "c", metrics.non_inferior(n, b, c).alias("non_inferior"), metrics.superior(b, c).alias("superior"))


@query("""with m as (select c_custkey as file, c_custkey % 5 = 0 as holdout from customer), u as (select distinct o_custkey + 20 as file from orders) select u.file, case when holdout is null then 'unknown' else 'holdout' end as problem from u left join m using (file) where holdout is null or holdout""")
def fit_guard(spark: SparkSession, d: str) -> DataFrame:
    manifest = table(spark, d, "customer").selectExpr("c_custkey file", "c_custkey % 5 = 0 holdout")
    return evaluate.guard_files(table(spark, d, "orders").selectExpr("o_custkey + 20 file"), manifest)


@query("with m as (select c_custkey as file from customer where c_custkey % 5 <> 0), o as (select o_custkey as file, o_orderstatus = 'F' as correct from orders) select count(*) as observations, count(distinct file) as files, round(avg(case when correct then 1.0 else 0.0 end), 6) as accuracy from o join m using (file)")
def fit_summary(spark: SparkSession, d: str) -> DataFrame:
    manifest = table(spark, d, "customer").selectExpr("c_custkey file", "c_custkey % 5 = 0 holdout")
    return rounded(evaluate.fit_summary(table(spark, d, "orders").selectExpr("o_custkey file", "o_orderstatus = 'F' correct"), manifest), "accuracy")


@query("""with b as (select p_partkey // 10 as doc, p_partkey as pos, case when p_size % 3 = 0 then 'heading' else 'paragraph' end as kind, p_size % 4 + 1 as level, case when p_size % 7 = 0 then ' ' else p_name end as text from part), s as (select * from b where trim(text) <> ''),
k as (select *, row_number() over (partition by doc order by pos) as k from s where kind = 'paragraph'), o as (select a.doc, a.text || chr(10) || b.text as text from k a join k b on a.doc = b.doc and a.k = 1 and b.k = 2 and a.text <> b.text)
select doc, 'heading_level' as kind, text, level, -1 as n from s where kind = 'heading' union all select doc, 'text_present', text, -1, -1 from s where kind = 'paragraph' union all select doc, 'text_order', text, -1, -1 from o union all select doc, 'block_count', '', -1, count(*) filter (kind = 'paragraph') from b group by doc""")
def truth_assertions(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "part").selectExpr("p_partkey div 10 doc", "p_partkey at", "if(p_size % 3 = 0, 'heading', 'paragraph') kind", "p_size % 4 + 1 level", "if(p_size % 7 = 0, ' ', p_name) text")
    out = evaluate.truth_assertions(b)
    return out.select("doc", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("n", F.lit(-1)).cast("bigint").alias("n"))


@query("""with m as (select c_custkey as file, c_mktsegment as stratum from customer), r as (select distinct o_custkey as file, o_custkey % 6 <> 0 as ok from orders), s as (select o_custkey as file, 'price' as metric, sum(o_totalprice) as value from orders group by 1), j as (select m.*, ok from m left join r using (file))
select stratum, file, case when ok is null then 'missing' else 'failed' end as metric, 1.0 as value from j where ok is null or not ok union all select stratum, j.file, metric, round(value, 4) from j join s on s.file = j.file where ok""")
def corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    manifest = table(spark, d, "customer").selectExpr("c_custkey file", "c_mktsegment stratum")
    o = table(spark, d, "orders")
    scores = o.groupBy(F.col("o_custkey").alias("file")).agg(F.sum("o_totalprice").alias("value")).withColumn("metric", F.lit("price"))
    return evaluate.corpus_rows(manifest, o.selectExpr("o_custkey file", "o_custkey % 6 <> 0 ok").distinct(), scores).withColumn("value", F.round("value", 4))


@query("select p_partkey as file, round(p_partkey % 97 / greatest(p_size, 1), 6) as seconds_per_page, p_size * 20000000 as peak, p_partkey % 97 <= 1.5 * greatest(p_size, 1) and p_size * 20000000 <= 524288000 as ok from part")
def bench_gate(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "part").selectExpr("p_partkey file", "p_size pages", "p_partkey % 97 * 1.0D seconds", "p_size * 20000000 peak")
    return rounded(evaluate.bench_gate(runs, 1.5, 524_288_000), "seconds_per_page")


@query("""with e as (select c_custkey as id, c_nationkey % 3 = 0 as tagged from customer), s as (select avg(case when tagged then 1.0 else 0.0 end) as s, count(*) as n from e) select n, round(s, 6) as share, abs(s - 0.126) > 0.05 as off from s""")
def tagged_share(spark: SparkSession, d: str) -> DataFrame:
    from scriptorium.operators import validate

    return rounded(validate.tagged_share(table(spark, d, "customer").select((F.col("c_nationkey") % 3 == 0).alias("tagged"))), "share")


# --- functions that had no query: outcomes, trends, manifests, contents, ledger ---


@query("""with g as (select p_partkey as id, p_type as label from part), a as (select p_partkey as id, case when p_size % 3 = 0 then lower(p_type) || '  ' else 'x' end as a from part where p_size % 5 <> 0), b as (select p_partkey as id, p_type as b from part where p_size % 2 = 0)
select g.id, coalesce(lower(trim(label)) = lower(trim(a)), false) as first, coalesce(lower(trim(label)) = lower(trim(b)), false) as second from g left join a using (id) left join b using (id)""")
def answer_outcomes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    gold = p.selectExpr("p_partkey id", "p_type label", "'t' task", "'en' lang")
    a = p.where("p_size % 5 <> 0").selectExpr("p_partkey id", "if(p_size % 3 = 0, lower(p_type) || '  ', 'x') answer")
    return evaluate.outcomes(gold, a, p.where("p_size % 2 = 0").selectExpr("p_partkey id", "p_type answer")).select("id", "first", "second")


@query("""with h as (select o_orderkey // 100 as com, o_orderstatus as metric, sum(o_totalprice) as value from orders group by all), r as (select o_orderkey // 100 as com, o_orderstatus as metric, count(*) * 1.0 as value from orders where o_orderkey // 100 < 3 group by all)
select com as \"commit\", metric, round(value, 4) as value from h where com not in (select com from r) union all select com, metric, value from r""")
def recorded_runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    by = [F.expr("o_orderkey div 100").alias("commit"), F.col("o_orderstatus").alias("metric")]
    h = o.groupBy(*by).agg(F.sum("o_totalprice").alias("value"))
    r = o.where("o_orderkey div 100 < 3").groupBy(*by).agg((F.count("*") * 1.0).alias("value"))
    return evaluate.record_run(h, r).withColumn("value", F.round("value", 4))


@query("""with h as (select o_orderstatus as metric, o_orderkey as pos, case when o_orderkey % 3 > 0 then o_totalprice end as gap from orders) select metric, arg_min(gap, pos) filter (gap is not null) as first, arg_max(gap, pos) filter (gap is not null) as last from h group by metric""")
def gap_widening(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.widening(table(spark, d, "orders").selectExpr("o_orderstatus metric", "o_orderkey pos", "if(o_orderkey % 3 > 0, o_totalprice, null) gap"), "pos")


@query("""with c as (select o_orderkey // 500 as source, o_orderkey % 7 as k from orders) select case k when 0 then 'duplicate' when 1 then 'licence' else 'too-short' end as reason, count(*) as n from c where k < 5 group by 1""")
def rejections(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("case o_orderkey % 7 when 0 then 'duplicate' when 1 then 'licence' when 5 then 'admitted' when 6 then 'admitted' else 'too-short' end reason")
    return evaluate.rejections(o)


@query("select s_suppkey as id, s_name as name from supplier union all select n_nationkey, n_name from nation where n_nationkey not in (select s_suppkey from supplier)")
def merged_manifest(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").selectExpr("s_suppkey id", "s_name name")
    return evaluate.merge_manifest(old, table(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) id", "n_name name"))


URL = "case p_partkey % 4 when 0 then 'https://creativecommons.org/licenses/by-sa/4.0/' when 1 then 'http://creativecommons.org/publicdomain/zero/1.0/' when 2 then 'http://creativecommons.org/publicdomain/mark/1.0/' else p_name end"


@query(f"select p_partkey, case p_partkey % 4 when 0 then 'CC-BY-SA-4.0' when 1 then 'CC0-1.0' when 2 then 'PD-old-work' else '' end as licence from part")
def url_licences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.coalesce(evaluate.license_of(F.expr(URL)), F.lit("")).alias("licence"))


# --- escalation and answers ---

EV = "p_partkey, p_size % 2 = 0 as a, p_size % 3 = 0 as b, p_size % 5 as n, p_size / 50.0 as ratio"


@query(f"""with e as (select {EV} from part), v as (select p_partkey, [not a or b, n = 0 and p_partkey % 4 < 3, n > 1 and not (p_partkey % 3 > 0 and p_partkey % 2 >= p_partkey % 3), a and ratio between 0.35 and 0.75 and n > 0, not a and not b and n <> 1, a and n between 1 and 8 and b] as f,
 case when ratio < 0.35 then 'full' when ratio > 0.75 then 'short' else 'between' end as band from e) select p_partkey, f[1] as metadata, f[2] as structure, f[3] as roles, f[4] as verse, f[5] as hyphen, f[6] as run_in, band from v""")
def escalation_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "part").selectExpr("p_partkey", "p_size % 2 = 0 a", "p_size % 3 = 0 b", "p_size % 5 n", "p_size / 50.0D ratio")
    a, b, n, k = F.col("a"), F.col("b"), F.col("n"), F.col("p_partkey")
    all_of = answers.gather(
        ("metadata", answers.metadata(a, b)), ("structure", answers.book_structure(n, k % 4)), ("roles", answers.heading_roles(n, k % 3, k % 2)), ("verse", answers.verse_quote(a, F.col("ratio"), n)), ("hyphen", answers.dehyphenation(a, b, n == 1)), ("run_in", answers.run_in_heading(a, n, b))
    )
    x = e.withColumn("x", all_of)
    return x.select("p_partkey", *[F.col("x")[i]["fires"].alias(c) for i, c in enumerate(["metadata", "structure", "roles", "verse", "hyphen", "run_in"])], answers.line_band(F.col("ratio")).alias("band"))


@query("""with q as (select o_orderkey // 20 as doc, o_orderkey as pos, o_custkey as key, (o_orderkey % 5) * 1.0 as seconds from orders), j as (select q.*, key in (select c_custkey from customer where c_custkey % 4 = 0) as cached from q),
w as (select *, coalesce(sum(case when cached then 0 else 1 end) over o, 0) as asked, coalesce(sum(case when cached then 0 else seconds end) over o, 0) as spent from j window o as (partition by doc order by pos rows between unbounded preceding and 1 preceding))
select doc, pos as \"at\", case when cached then 'cached' when asked >= 8 then 'calls' when spent >= 12 then 'seconds' else 'asked' end as outcome from w""")
def ask_sessions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "orders").selectExpr("o_orderkey div 20 doc", "o_orderkey at", "o_custkey key", "o_orderkey % 5 * 1.0D seconds")
    cache = table(spark, d, "customer").where("c_custkey % 4 = 0").selectExpr("c_custkey key")
    return answers.session(q, cache, 8, 12.0).select("doc", "at", "outcome")


@query("""select event_id, case when event_id % 4 = 0 then -1 when event_id % 4 = 1 then -1 else cast(json_extract(props, '$.k') as bigint) end as k from events""")
def schema_gate(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_id") % 4 == 0, F.replace("props", F.lit("}"), F.lit(', "more": 1}'))).when(F.col("event_id") % 4 == 1, "no json").otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.coalesce(answers.gate_schema(said, "k bigint")["k"], F.lit(-1)).alias("k"))


@query("""with b as (select p_partkey // 5 as doc, p_partkey as pos, p_name as text from part), a as (select doc, case when doc % 4 = 1 then -pos else pos end as pos, case when doc % 4 = 2 and pos % 5 = 0 then text || 'x' when doc % 4 = 3 then replace(text, ' ', '  ') else text end as text from b),
bt as (select doc, regexp_replace(string_agg(text, '' order by pos), '\\s', '', 'g') as t from b group by doc), at_ as (select doc, regexp_replace(string_agg(text, '' order by pos), '\\s', '', 'g') as t from a group by doc)
select doc, cast(0 as bigint) as lost, cast(length(at_.t) - length(bt.t) as bigint) as gained, doc % 4 = 1 and at_.t <> bt.t as reordered from bt join at_ using (doc)""")
def locality_gate(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "part").selectExpr("p_partkey div 5 doc", "p_partkey at", "p_name text")
    a = b.selectExpr("doc", "if(doc % 4 = 1, -at, at) at", "case when doc % 4 = 2 and at % 5 = 0 then text || 'x' when doc % 4 = 3 then replace(text, ' ', '  ') else text end text")
    return answers.gate_locality(b, a)


@query("""with s as (select p_partkey as id, p_size / 50.0 as x, p_retailprice % 7 / 7 as y, p_size % 3 as v, p_partkey % 3 as w from part) select id, case when case when id % 5 = 0 then null else y end > x + 0.01 then 'dup_line' when x > y + 0.3 + 0.01 then 'top_2gram' when w > v then 'violations' else '' end as worsened from s""")
def validity_gate(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").selectExpr("p_partkey id", "p_size / 50.0D x", "p_retailprice % 7 / 7 y", "p_size % 3 v", "p_partkey % 3 w")
    both = s.selectExpr("id", "x b_dup_line", "if(id % 5 = 0, null, y) a_dup_line", "y + 0.3D b_top_2gram", "x a_top_2gram", "0.0D b_top_3gram", "0.0D a_top_3gram", "0.0D b_non_alpha", "0.0D a_non_alpha", "v b_violations", "w a_violations")
    return answers.gate_validity(both).withColumn("worsened", F.coalesce("worsened", F.lit("")))


META = "p_partkey, '  A Book of ' || p_name || chr(10) || 'by ' || p_type as pages, case p_partkey % 4 when 0 then 'a book of ' || p_name when 1 then 'Other' when 2 then '' else 'A  BOOK' end as title, case p_partkey % 3 when 0 then p_type when 1 then 'Nobody' end as publisher"


@query(f"""with m as (select {META} from part) select p_partkey, case when p_partkey % 4 in (1, 2) then 'not verbatim: title' when p_partkey % 3 = 1 then 'not verbatim: publisher' else '' end as failure, case when p_partkey % 4 in (0, 3) or p_partkey % 4 = 2 then title else '' end as plausible,
 case when p_partkey % 4 = 1 or p_partkey % 3 = 1 then 'fallback' when p_partkey % 4 = 2 then 'fallback' else 'llm' end as method from m""")
def metadata_answers(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").selectExpr(*[c.replace("chr(10)", "'\\n'") for c in spark_sql(META)])
    fields = F.create_map(F.lit("title"), F.col("title"), F.lit("publisher"), F.col("publisher"))
    failure = answers.validate_metadata(fields, F.col("pages"), F.col("title"))
    large = F.array(F.substring_index("pages", "\n", 1))
    out = m.select("p_partkey", failure.alias("failure"), F.coalesce(answers.plausible_title(F.col("title"), large), F.lit("")).alias("plausible"), answers.settle(F.col("title"), failure, F.lit("x"))["method"].alias("method"))
    return out.withColumn("failure", F.coalesce("failure", F.lit("")))


@query("""with a as (select p_partkey, [p_name, 'Jane Doe', 'R2 D2', p_brand] as a from part) select p_partkey, array_to_string(list_filter(a, lambda x: len(regexp_extract_all(x, '\\S+')) >= 2 and not regexp_matches(x, '\\p{N}')), ';') as authors, p_partkey % 3 = 0 as accepted from a""")
def plausible_authors(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(F.col("p_name"), F.lit("Jane Doe"), F.lit("R2 D2"), F.col("p_brand"))
    word = F.element_at(F.array(*map(F.lit, [" verse ", "verses", ""])), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.array_join(answers.plausible_authors(names), ";").alias("authors"), answers.accepts(word, ["verse", "quote"]).alias("accepted"))


ROLES_SQL = """c as (select p_partkey // 6 as doc, p_partkey % 6 as cluster, p_size * 5 as count, p_partkey % 6 - 2 as z, case p_size % 4 when 0 then 'chapter' when 1 then 'epigraph' when 2 then 'body' else 'section' end as role, p_partkey % 6 in (4, 5) as heading from part),
pr as (select doc, cluster, case when doc % 3 = 0 and cluster % 2 = 0 then 'x' else role end as role from c where cluster < 4), dis as (select pr.doc, avg(case when pr.role is distinct from c.role then 1.0 else 0.0 end) as disagree from pr left join c using (doc, cluster) group by pr.doc)"""


@query(f"""with {ROLES_SQL}, s as (select doc, bool_or(role = 'chapter' and count not between 2 and 200) as ch, arg_max(role, (count, -cluster)) filter (z > 0) as top, count(*) filter (heading) as h, count(*) filter (heading and role in ('body', 'epigraph')) as dm from c group by doc)
select doc, round(disagree, 6) as disagree, case when disagree > 0.2 then 'holdout' when ch then 'chapter count' when top = 'epigraph' then 'epigraph' when h > 0 and h = dm then 'all demoted' else '' end as failure from s join dis using (doc)""")
def role_answers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").selectExpr("p_partkey div 6 doc", "p_partkey % 6 cluster", "p_size * 5 count", "p_partkey % 6 - 2 z", "case p_size % 4 when 0 then 'chapter' when 1 then 'epigraph' when 2 then 'body' else 'section' end role", "p_partkey % 6 in (4, 5) heading")
    probes = c.where("cluster < 4").selectExpr("doc", "cluster", "if(doc % 3 = 0 and cluster % 2 = 0, 'x', role) role")
    dis = answers.holdout_check(probes, c)
    return rounded(answers.validate_roles(c, dis).join(dis, "doc").select("doc", "disagree", F.coalesce("failure", F.lit("")).alias("failure")), "disagree")


@query("""with n as (select p_partkey, p_size * 12 as n from part), c as (select p_partkey, n, unnest(range(0, cast(case when n <= 200 then 1 else ceil((n - 200) / 180.0) + 1 end as int))) as k from n) select p_partkey, cast(k * 180 as bigint) as start, cast(least(n, k * 180 + 200) as bigint) as \"end\" from c""")
def structure_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.inline(answers.chunks(F.col("p_size") * 12)))


@query("""with l as (select p_partkey // 10 as doc, p_partkey % 2 as chunk, p_partkey % 10 // 2 as heading, case when p_partkey % 10 < 3 then 0 when p_size % 9 = 0 then 2 else 1 end as zone, false as part from part), o as (select doc, heading, count(distinct (zone, part)) as says, min(zone) as zone from l group by all),
w as (select *, zone < lag(zone) over (partition by doc order by heading) as back from o) select doc, case when max(says) > 1 then 'overlap' when bool_or(coalesce(back, false)) then 'order' else '' end as failure from w group by doc""")
def stitched_zones(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey div 10 doc", "p_partkey % 2 chunk", "p_partkey % 10 div 2 heading", "case when p_partkey % 10 < 3 then 0 when p_size % 9 = 0 then 2 else 1 end zone", "false part")
    return answers.stitch(rows).withColumn("failure", F.coalesce("failure", F.lit("")))


@query("""with z as (select p_partkey, p_size % 6 as f, [p_size % 9, p_size % 9 + p_partkey % 3] as parts, 8 + p_size % 4 as b from part) select p_partkey, case when f > 10 or b > 10 or parts[1] >= 10 or parts[2] >= 10 then 'range' when not (f < parts[1] and parts[1] < parts[2] and parts[2] < b) then 'order' else '' end as failure from z""")
def zone_bounds(spark: SparkSession, d: str) -> DataFrame:
    z = table(spark, d, "part").selectExpr("p_partkey", "cast(p_size % 6 as bigint) f", "array(cast(p_size % 9 as bigint), p_size % 9 + p_partkey % 3) parts", "cast(8 + p_size % 4 as bigint) b")
    return z.select("p_partkey", F.coalesce(answers.validate_structure(F.col("f"), F.col("parts"), F.col("b"), F.lit(10)), F.lit("")).alias("failure"))


@query("""select p_partkey, case when p_size % 3 = 0 and p_size % 2 = 0 then 'quote' when p_size % 3 = 1 and (p_size % 5 < 3 or p_size / 50.0 <= 0.35) then 'quote' when p_size % 3 = 0 then 'pre' when p_size % 3 = 1 then 'verse' else 'quote' end as kind, case p_partkey % 3 when 0 then 'halftitle' when 1 then '' else 'body' end as page from part""")
def counter_evidence(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ["pre", "verse", "quote"])), (F.col("p_size") % 3 + 1).cast("int"))
    kind = answers.counter_evidence(said, F.col("p_size") % 2 == 1, F.col("p_size") % 5, F.col("p_size") / 50.0, F.lit("quote"))
    letter = F.element_at(F.array(*map(F.lit, [' "(b) half', "", "**K"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), F.coalesce(answers.parse_kind(letter), F.lit("")).alias("page"))


@query("with b as (select p_partkey // 40 as doc, p_partkey as block, row_number() over (partition by p_partkey // 40 order by p_partkey) - 1 as k from part) select doc, k // 6 as batch, block from b where k < 20")
def answer_batches(spark: SparkSession, d: str) -> DataFrame:
    return answers.batches(table(spark, d, "part").selectExpr("p_partkey div 40 doc", "p_partkey at", "p_partkey block"), 6, 20)


@query(f"""with c as (select s_suppkey as model, 20 + s_nationkey as n, s_nationkey % 4 as b, s_nationkey % 3 as c, s_nationkey % 5 / 200.0 as broken, s_suppkey % 2 = 0 as ok, s_acctbal as sec from supplier)
select model, array_to_string(list_filter([case when n < 30 then 'evidence' end, case when not ({NON_INFERIOR}) then 'non_inferior' end, case when broken > 0.01 then 'false_repair' end, case when not ok then 'schema' end, case when sec > 5000 then 'time' end], lambda x: x is not null), ',') as failed from c""")
def promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "supplier").selectExpr(
        "s_suppkey model", "20 + s_nationkey n", "s_nationkey % 4 b", "s_nationkey % 3 c", "s_nationkey % 5 / 200.0D broken", "s_suppkey % 2 = 0 schema_ok", "true locality_ok", "true validity_ok", "s_acctbal seconds", "5000.0D budget", "1 memory", "2 memory_budget", "true licence_ok"
    )
    return answers.promotion_gates(c).select("model", F.array_join("failed", ",").alias("failed"))


# --- jobs ---


@query("""with e as (select user_id as job, event_type as stage, event_id as seq, cast(floor(value) as bigint) as done, cast(floor(value) as bigint) + event_id % 3 * 20 as total from events), l as (select job, stage, arg_max(done, seq) as done, arg_max(total, seq) as total from e group by all)
select job, stage, done, total, round(case when total = 0 then 1.0 else least(1.0, done / total) end, 6) as share from l""")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("user_id job", "event_type stage", "event_id seq", "cast(floor(value) as bigint) done", "cast(floor(value) as bigint) + event_id % 3 * 20 total")
    return rounded(jobs.progress(e), "share")


JOB_SQL = "e as (select user_id as job, event_id as seq, event_id * 2.0 as ts, case event_id % 13 when 0 then 'start' when 5 then 'cancel' when 9 then 'exit' else 'tick' end as t from events)"


def job_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id job", "event_id seq", "event_id * 2.0D ts", "case event_id % 13 when 0 then 'start' when 5 then 'cancel' when 9 then 'exit' else 'tick' end t")


@query(f"""with {JOB_SQL}, s as (select job, bool_or(t = 'start') as st, min(ts) filter (t = 'cancel') as told, min(ts) filter (t = 'exit') as lft, max(ts) as now from e group by job), k as (select *, coalesce(coalesce(lft, now) - told > 5, false) as killed from s)
select job, case when lft is not null or killed then 'done' when told is not null then 'cancelling' when st then 'running' else 'preparing' end as state, killed from k""")
def job_states(spark: SparkSession, d: str) -> DataFrame:
    return jobs.states(job_events(spark, d))


@query(f"with {JOB_SQL}, c as (select job, min(seq) as told from e where t = 'cancel' group by job) select e.job, seq from e left join c using (job) where told is null or seq <= told or t = 'exit'")
def cancelled_events(spark: SparkSession, d: str) -> DataFrame:
    return jobs.cancelled(job_events(spark, d)).select("job", "seq")


@query("""with q as (select o_custkey as worker, o_orderkey as pos, o_orderkey as job, o_orderkey % 9 = 0 as running from orders), w as (select *, count(*) filter (running) over (partition by worker) as busy, sum(case when running then 0 else 1 end) over (partition by worker order by pos) as place from q)
select worker, job, busy + place <= 3 as starts from w where not running""")
def job_queue(spark: SparkSession, d: str) -> DataFrame:
    return jobs.pump(table(spark, d, "orders").selectExpr("o_custkey worker", "o_orderkey at", "o_orderkey job", "o_orderkey % 9 = 0 running"), 3)


@query("select user_id, event_id as job from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k <= 5")
def job_history(spark: SparkSession, d: str) -> DataFrame:
    h = jobs.history(table(spark, d, "events").selectExpr("user_id user", "ts", "event_id job"), 5)
    return h.selectExpr("user user_id", "job")


@query("select event_id as job, event_type as stage, round(value * 20, 6) as seconds, value * 20 > 1200 as late, cast(floor(value / 2) as bigint) as beats from events")
def job_deadlines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id job", "event_type stage", "0.0D begin", "value * 20 end", "value")
    late = jobs.deadlines(e)
    beats = e.select("job", jobs.heartbeat_due(F.col("value")).alias("beats"))
    return rounded(late.join(beats, "job"), "seconds")


@query("with j as (select p_partkey as job, p_size * 30 as pages, p_retailprice * 1000 as bytes from part) select job, 'pages' as cap, cast(pages as double) as value, 1000.0 as allowed from j where pages > 1000 union all select job, 'bytes', bytes, 950000.0 from j where bytes > 950000")
def job_limits(spark: SparkSession, d: str) -> DataFrame:
    return jobs.over_limits(table(spark, d, "part").selectExpr("p_partkey job", "p_size * 30 pages", "p_retailprice * 1000 bytes"), {"pages": 1000, "bytes": 950_000})


@query("""with s as (select o_custkey as job, sum(o_totalprice) as sec, count(*) as stages, bool_and(o_orderstatus <> 'P') as ok from orders group by 1), w as (select o_custkey as job, count(*) as w from orders where o_orderpriority = '1-URGENT' group by 1)
select job, case when ok then 'ok' else 'failed' end as status, round(sec, 4) as seconds, stages, coalesce(w, 0) as urgent from s left join w using (job)""")
def run_reports(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    stages = o.selectExpr("o_custkey job", "o_orderkey stage", "o_totalprice seconds", "o_orderstatus <> 'P' ok")
    r = jobs.report(stages, o.selectExpr("o_custkey job", "o_orderpriority code"), o.groupBy(F.col("o_custkey").alias("job"), F.col("o_orderstatus").alias("class")).agg(F.count("*").alias("pages")))
    return r.select("job", "status", F.round("seconds", 4).alias("seconds"), "stages", F.coalesce(F.try_element_at("warnings", F.lit("1-URGENT")), F.lit(0)).cast("bigint").alias("urgent"))


@query(f"""with c as (select p_partkey // 20 as doc, p_partkey as pos, case when p_size % 4 = 0 then 'heading' when p_size % 4 = 1 then 'table' else 'paragraph' end as kind, p_size % 3 as level, p_name as text from part)
select doc, count(*) filter (kind = 'heading') as headings, count(*) filter (kind = 'table') as tables, count(*) filter (kind = 'paragraph') as paragraphs, coalesce(string_agg(level || ' ' || text, ';' order by pos) filter (kind = 'heading'), '') as outline from c group by doc""")
def structure_digests(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").selectExpr("p_partkey div 20 doc", "p_partkey at", "case when p_size % 4 = 0 then 'heading' when p_size % 4 = 1 then 'table' else 'paragraph' end kind", "p_size % 3 level", "p_name text")
    n = lambda k: F.coalesce(F.try_element_at("variants", F.lit(k)), F.lit(0)).cast("bigint")
    return jobs.structure_digest(c).select("doc", n("heading").alias("headings"), n("table").alias("tables"), n("paragraph").alias("paragraphs"), F.array_join("headings", ";").alias("outline"))


@query("select p_partkey // 40 as doc, count(distinct p_partkey // 10) as pages, count(distinct p_partkey // 4) as blocks, count(*) as lines, max(p_size % 3) + 1 as columns from part group by 1")
def layout_digests(spark: SparkSession, d: str) -> DataFrame:
    return jobs.layout_digest(table(spark, d, "part").selectExpr("p_partkey div 40 doc", "p_partkey div 10 page", "p_partkey div 4 block", "p_size % 3 column"))


@query("""with a as (select p_partkey as id, p_name as v from part where p_size % 6 <> 0), b as (select p_partkey as id, case when p_size % 5 = 0 then p_type else p_name end as v from part where p_size % 7 <> 0)
select id, coalesce(a.v, '') as was, coalesce(b.v, '') as now, case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end as change from a full join b using (id) where a.v is distinct from b.v""")
def stage_diffs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a = p.where("p_size % 6 <> 0").selectExpr("p_partkey id", "p_name v")
    b = p.where("p_size % 7 <> 0").selectExpr("p_partkey id", "if(p_size % 5 = 0, p_type, p_name) v")
    return jobs.stage_diff(a, b, ["id"], "v").select("id", F.coalesce("was", F.lit("")).alias("was"), F.coalesce("is", F.lit("")).alias("now"), "change")


@query("with l as (select user_id as log, event_id as pos, length(props) as bytes from events) select log, pos as \"at\", cast(floor(coalesce(sum(bytes) over (partition by log order by pos rows between unbounded preceding and 1 preceding), 0) / 40) as bigint) as file from l")
def rotated_logs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.rotated_log(table(spark, d, "events").selectExpr("user_id log", "event_id at", "length(props) bytes"), 40).select("log", "at", F.col("file").cast("bigint").alias("file"))
