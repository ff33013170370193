"""Queries on documents: quality, vocabulary, conservation, furniture, dehyphenation, string scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import furniture, ledger, paragraphs, quality
from scriptorium.sources.readers import document_lines, table, trimmed_lines, words_of

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


WORDS = "list_filter(regexp_split_to_array({t}, '[ \\t\\n\\r\\x0B\\f]+'), lambda w: w <> '')".replace("\\x0B", "\\v")
LINES = "list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\n\\r\\v\\f]+|[ \\t\\n\\r\\v\\f]+$', '', 'g')), lambda x: x <> '')"


def _grams(n: int) -> str:
    return f"""
g{n} as (select doc_id, max(length(replace(gram, ' ', '')) * n / chars) as top from (
  select doc_id, chars, gram, count(*) as n from (
    select doc_id, chars, unnest(list_transform(range(1, greatest(len(words) - {n} + 2, 1)), lambda i: array_to_string(words[i:i + {n - 1}], ' '))) as gram from b where len(words) >= {n}
  ) group by all having count(*) > 1) group by doc_id)"""


PROFILE_SQL = f"""
with b0 as (select doc_id, coalesce(text, '') as text from documents),
b as (select doc_id, text, {LINES.format(t="text")} as lines, {WORDS.format(t="text")} as words,
  list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n\\s*'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '') as paras,
  coalesce(list_sum(list_transform({WORDS.format(t="text")}, lambda w: length(w))), 0) as chars, regexp_replace(text, '\\s', '', 'g') as visible from b0),
{_grams(2)},{_grams(3)},{_grams(4)},
s as (select b.doc_id, cast(len(lines) as bigint) as n_lines, cast(len(words) as bigint) as n_words,
  case when len(lines) = 0 then 0.0 else 1 - len(list_distinct(lines)) / len(lines) end as dup_line_frac,
  case when len(paras) = 0 then 0.0 else 1 - len(list_distinct(paras)) / len(paras) end as dup_para_frac,
  coalesce(g2.top, 0.0) as top_2gram, coalesce(g3.top, 0.0) as top_3gram, coalesce(g4.top, 0.0) as top_4gram,
  case when len(words) = 0 then 0.0 else len(list_filter(words, lambda w: not regexp_matches(w, '\\p{{L}}'))) / len(words) end as non_alpha_word_ratio,
  case when len(words) = 0 then 0.0 else chars / len(words) end as mean_word_len,
  case when length(visible) = 0 then 0.0 else (length(visible) - length(regexp_replace(visible, '[\\x{{FFFD}}\\p{{Co}}\\p{{Cc}}]', '', 'g'))) / length(visible) end as replacement_share
  from b left join g2 using (doc_id) left join g3 using (doc_id) left join g4 using (doc_id))
select doc_id, n_lines, n_words, round(dup_line_frac, 6) as dup_line_frac, round(dup_para_frac, 6) as dup_para_frac, round(top_2gram, 6) as top_2gram, round(top_3gram, 6) as top_3gram, round(top_4gram, 6) as top_4gram,
  round(non_alpha_word_ratio, 6) as non_alpha_word_ratio, round(mean_word_len, 6) as mean_word_len, round(replacement_share, 6) as replacement_share,
  case when replacement_share > 0.20 then 'Broken'
    when dup_line_frac > 0.30 or dup_para_frac > 0.30 or top_2gram > 0.20 or top_3gram > 0.18 or top_4gram > 0.16 or non_alpha_word_ratio > 0.8 or (mean_word_len > 0 and (mean_word_len < 3.0 or mean_word_len > 10.0)) then 'Suspicious' else 'Ok' end as verdict
from s"""


@query(PROFILE_SQL)
def quality_profile(spark: SparkSession, d: str) -> DataFrame:
    out = quality.quality_profile(table(spark, d, "documents")).drop("dict_hit_rate")
    return rounded(out, "dup_line_frac", "dup_para_frac", "top_2gram", "top_3gram", "top_4gram", "non_alpha_word_ratio", "mean_word_len", "replacement_share")


@query(f"""
with b as (select doc_id, {WORDS.format(t="text")} as words, coalesce(list_sum(list_transform({WORDS.format(t="text")}, lambda w: length(w))), 0) as chars from documents),
{_grams(3)} select doc_id, round(top, 6) as top_3gram from g3""")
def top_ngram_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.top_ngram_share(table(spark, d, "documents"), 3, "top_3gram"), "top_3gram")


@query(f"""
with l as (select unnest({LINES.format(t="text")}) as text from documents),
g as (select text, count(*) as n from l where length(text) >= 40 group by text having count(*) > 1)
select text, length(text) as chars, n - 1 as surplus from g order by chars desc, text limit 10""")
def duplicate_blocks_topk(spark: SparkSession, d: str) -> DataFrame:
    lines = document_lines(table(spark, d, "documents")).withColumnRenamed("line", "text")
    return quality.duplicate_blocks(lines)


WORD_SQL = f"""
w as (select doc_id, lang, regexp_replace(lower(unnest({WORDS.format(t="text")})), '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g') as word from documents),
k as (select doc_id, lang, word from w where regexp_full_match(word, '\\p{{L}}{{2,}}'))"""


@query(f"with {WORD_SQL} select lang, word, count(*) as n from k group by all")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.word_counts(table(spark, d, "documents"))


@query(f"""with {WORD_SQL}, lex as (select lang, word from (select lang, word, count(*) as n from k group by all) where n >= 5),
c as (select k.doc_id, avg(case when lex.word is null then 0 else 1 end) as r from k left join lex on k.lang = lex.lang and k.word = lex.word group by k.doc_id)
select d.doc_id, round(r, 6) as dict_hit_rate from documents d left join c using (doc_id)""")
def dict_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return rounded(quality.dict_hit_rate(docs, quality.word_counts(docs).where("n >= 5")), "dict_hit_rate")


CHARS = "unnest(string_split(regexp_replace({t}, '\\s', '', 'g'), ''))"


@query(f"select lang, ch, count(*) as n from (select lang, {CHARS.format(t='text')} as ch from documents) where ch <> '' group by all")
def char_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ledger.histogram(table(spark, d, "documents"), ["lang"])


@query(f"""
with b as (select source, ch, count(*) as n from (select source, {CHARS.format(t='text')} as ch from documents) where ch <> '' group by all),
a as (select source, ch, count(*) as n from (select source, {CHARS.format(t="translate(text, '%$#*', '')")} as ch from documents) where ch <> '' group by all)
select source, ch, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) as lost, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) as appeared
from b full join a using (source, ch) where coalesce(b.n, 0) <> coalesce(a.n, 0)""")
def char_conservation_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    after = docs.select("source", F.translate("text", "%$#*", "").alias("text"))
    return ledger.changed(ledger.histogram(docs, ["source"]), ledger.histogram(after, ["source"]), ["source"])


ENTRIES_SQL = """e as (select case l_returnflag when 'R' then 'RunningHeader' when 'A' then 'Dehyphenate' else 'SoftHyphen' end as reason, l_linestatus = 'O' as added,
 cast(l_quantity as bigint) as chars, l_suppkey % 12 as stage from lineitem)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("l_returnflag") == "R", "RunningHeader").when(F.col("l_returnflag") == "A", "Dehyphenate").otherwise("SoftHyphen")
    return table(spark, d, "lineitem").select(reason.alias("reason"), (F.col("l_linestatus") == "O").alias("added"), F.col("l_quantity").cast("bigint").alias("chars"), (F.col("l_suppkey") % 12).alias("stage"))


TOTALS_SQL = "sum(case when added then 0 else chars end) as removed, sum(case when added then chars else 0 end) as added"


@query(f"with {ENTRIES_SQL}, s as (select stage, reason, {TOTALS_SQL} from e group by all) select stage, reason, cast(removed as bigint) as removed, cast(added as bigint) as added, cast(greatest(removed - added, 0) as bigint) as net from s")
def ledger_reason_totals(spark: SparkSession, d: str) -> DataFrame:
    return ledger.reason_totals(entries(spark, d), ["stage"])


@query(f"""with {ENTRIES_SQL}, s as (select stage, reason, {TOTALS_SQL} from e group by all), n as (select stage, reason, greatest(removed - added, 0) as net from s)
select stage, reason, cast(net as bigint) as net, cast(sum(net) over (partition by reason order by stage) as bigint) as cumulative from n""")
def ledger_replay(spark: SparkSession, d: str) -> DataFrame:
    return ledger.replay(entries(spark, d))


@query(f"""with {ENTRIES_SQL}, s as (select reason, {TOTALS_SQL} from e group by all),
n as (select case reason when 'RunningHeader' then 'furniture' when 'Dehyphenate' then 'dehyphenate' else 'other' end as budget_group, greatest(removed - added, 0) as net from s),
g as (select budget_group, sum(net) as net from n group by all union all select 'global', sum(net) from n),
h as (select budget_group, net, net / 1000000.0 as share, case budget_group when 'furniture' then 0.05 when 'dehyphenate' then 0.01 when 'global' then 0.08 end as budget from g)
select budget_group, cast(net as bigint) as net, round(cast(share as double), 6) as share, cast(budget as double) as budget, round(cast(budget as double) - cast(share as double), 6) as headroom, coalesce(share <= budget, true) as ok from h""")
def budget_check(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.budget_check(entries(spark, d), F.lit(1_000_000.0), {"furniture": 0.05, "dehyphenate": 0.01}), "share", "headroom")


@query(f"""
with l as (select source, trim(regexp_replace(unnest({LINES.format(t="text")}), '\\s+', ' ', 'g')) as text from documents),
a as (select source, text, count(*) as n from l group by all)
select source, text, n - 1 as missing from a where n > 1""")
def conservation_unaccounted(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("source", F.explode(trimmed_lines(F.col("text"))).alias("text"))
    return ledger.missing_from(lines, lines.select("source", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).distinct(), ["source"])


RECTS_SQL = "r as (select vec_id as id, vec_id // 20 as page, least(embedding[1], embedding[3])::double as x0, greatest(embedding[1], embedding[3])::double as x1, least(embedding[2], embedding[4])::double as y0, greatest(embedding[2], embedding[4])::double as y1 from embeddings)"


def rects(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    box = F.struct(F.least(e(1), e(3)).alias("x0"), F.least(e(2), e(4)).alias("y0"), F.greatest(e(1), e(3)).alias("x1"), F.greatest(e(2), e(4)).alias("y1"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id div 20").alias("page"), box.alias("rect"))


@query(f"with {RECTS_SQL} select a.page, a.id as id_a, b.id as id_b from r a join r b on a.page = b.page and a.id < b.id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1")
def invariant_overlap(spark: SparkSession, d: str) -> DataFrame:
    return ledger.overlapping(rects(spark, d), 0.25, ["page"])


@query(f"""
with l as (select unnest({LINES.format(t="text")}) as line from documents),
k as (select regexp_replace(regexp_replace(replace(line, '#', ' '), '\\p{{N}}+', '#', 'g'), '[^\\p{{L}}#]', '', 'g') as key from l)
select key, count(*) as n from k group by key having count(*) > 1""")
def masked_line_keys(spark: SparkSession, d: str) -> DataFrame:
    lines = document_lines(table(spark, d, "documents"))
    return lines.groupBy(T.mask(F.col("line")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query("select key, count(*) as n, min(name) as least from (select regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g') as key, p_name as name from part) group by key")
def fold_key_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(T.squash_key(F.col("p_name")).alias("key")).agg(F.count("*").alias("n"), F.min("p_name").alias("least"))


#: A side of this many rows or fewer, counted first, is broadcast.
FEW = 100_000


@query("select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)")
def benchmark_needles(spark: SparkSession, d: str) -> DataFrame:
    """Needles are looked up by the first of their inner words (the first word may be cut by what stands before it, the last by what follows): four, or as many as there are. What meets is numbers; only then
    are the texts of the documents that hold a needle's words read, and the whole needle sought in them. Needles of two words or less are sought in every text."""
    needles = table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle"), words_of(F.col("text")).alias("w")).withColumn("k", F.greatest(F.least(F.size("w") - 2, F.lit(4)), F.lit(0)))
    docs = table(spark, d, "documents")
    sized = lambda df, n: F.broadcast(df) if n <= FEW else df
    out = None
    for k, n in sorted((r["k"], r["count"]) for r in needles.groupBy("k").count().collect()):  # five rows at most
        own = needles.where(F.col("k") == k)
        if k:
            own = own.select("item_id", "needle", F.array_join(F.slice("w", 2, k), " ").alias("gram"))
            grams = docs.select("doc_id", F.explode(F.array_distinct(quality.ngrams(words_of(F.col("text")), k))).alias("gram"))
            met = grams.join(sized(own.select("item_id", "gram"), n), "gram").select("doc_id", "item_id").distinct()
            hits = docs.select("doc_id", "text").join(met, "doc_id").join(sized(own.select("item_id", "needle"), n), "item_id")
        else:
            hits = docs.join(sized(own.select("item_id", "needle"), n), F.contains("text", F.col("needle")))
        found = hits.where(F.contains("text", F.col("needle"))).select("item_id", "doc_id")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.where(F.lit(False)).select(F.lit(0).cast("bigint").alias("item_id"), "doc_id")


BANDS_SQL = f"""
p as (select source || '-' || (doc_id // 2000) as book, row_number() over (partition by source, doc_id // 2000 order by doc_id) as page, {LINES.format(t="text")} as lines from documents),
pages as (select book, page from p where len(lines) > 0),
lines as (select distinct book, page, band, regexp_replace(regexp_replace(replace(line, '#', ' '), '\\p{{N}}+', '#', 'g'), '[^\\p{{L}}#]', '', 'g') as key from (
  select book, page, 'top' as band, lines[1] as line from p where len(lines) > 0 union all select book, page, 'bottom', lines[-1] from p where len(lines) > 0)),
numbered as (select book, page, row_number() over (partition by book order by page) as rank from pages),
books as (select book, count(*) as n, count(*) filter (page % 2 = 0) as n_even, count(*) filter (page % 2 <> 0) as n_odd from pages group by book),
hits as (select *, count(*) over (partition by book, band, key order by rank range between current row and 19 following) as wh from lines join numbered using (book, page) join books using (book)),
k as (select book, band, key, n, n_even, n_odd, count(*) as hits, count(*) filter (page % 2 = 0) as eh, count(*) filter (page % 2 <> 0) as oh,
  greatest(coalesce(max(wh) filter (not (n > 20 and rank > n - 20)), 0), count(*) filter (n > 20 and rank > n - 20)) as wb from hits group by all),
o as (
  select book, band, key, hits, hits / n as ratio, hits as pages, 'all' as scope, hits >= greatest(2, least(n, greatest(3, ceil(0.2 * n)))) as enough from k
  union all select book, band, key, hits, eh / n_even, eh, 'even', eh >= greatest(2, least(n_even, greatest(3, ceil(0.2 * n_even)))) from k where n_even > 0
  union all select book, band, key, hits, oh / n_odd, oh, 'odd', oh >= greatest(2, least(n_odd, greatest(3, ceil(0.2 * n_odd)))) from k where n_odd > 0
  union all select book, band, key, hits, wb / 20, wb, 'window', wb >= greatest(2, least(20, greatest(3, ceil(0.2 * 20)))) from k where n > 20),
best as (select *, row_number() over (partition by book, band, key order by ratio desc, case scope when 'all' then 0 when 'even' then 1 when 'odd' then 2 else 3 end) as r from o)"""


@query(f"""with {BANDS_SQL} select book, band, key, hits, round(ratio, 6) as ratio, scope, pages,
case when enough and ratio >= 0.7 then 'furniture' when ratio >= 0.3 then 'abstain' else 'text' end as decision from best where r = 1""")
def furniture_repetition(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("book", F.concat("source", F.lit("-"), F.expr("doc_id div 2000")))
    p = docs.select("book", "doc_id").withColumn("page", F.expr("row_number() over (partition by book order by doc_id)"))  # numbers alone: texts don't travel
    both = docs.select("doc_id", trimmed_lines(F.col("text")).alias("lines")).where("size(lines) > 0").select("doc_id", F.element_at("lines", 1).alias("top"), F.element_at("lines", -1).alias("bottom"))
    p = p.join(both, "doc_id")
    ends = F.explode(F.array(F.struct(F.lit("top").alias("band"), F.col("top").alias("line")), F.struct(F.lit("bottom").alias("band"), F.col("bottom").alias("line"))))
    lines = p.select("book", "page", ends.alias("x")).select("book", "page", "x.band", T.mask(F.col("x.line")).alias("key"))
    return rounded(furniture.repetition_evidence(lines, p), "ratio")


FOLIO_SQL = "f as (select o_orderkey // 300 as book, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'roman' else 'arabic' end as system, row_number() over (partition by o_orderkey // 300 order by o_orderkey) as page, o_orderkey % 7 as off from orders)"


@query(f"""with {FOLIO_SQL}, c as (select book, system, off as constant, count(distinct page) as pages, count(*) as n from f group by all)
select book, system, constant, pages, round(share, 6) as share from (select *, n / sum(n) over (partition by book, system) as share from c) where pages >= 3 and share >= 0.15""")
def folio_constants(spark: SparkSession, d: str) -> DataFrame:
    system = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "roman").otherwise("arabic")
    book = F.expr("o_orderkey div 300")
    rows = table(spark, d, "orders").select(book.alias("book"), system.alias("system"), F.expr("row_number() over (partition by o_orderkey div 300 order by o_orderkey)").alias("page"), (F.col("o_orderkey") % 7).alias("off"))
    return rounded(furniture.folio_constants(rows.withColumn("value", F.col("page") + F.col("off"))), "share")


@query("""
with p as (select conv_id as book, turn as page, text, lead(text) over (partition by conv_id order by turn) as next from conversations),
r as (select book, next is not null as has, regexp_matches(regexp_replace(regexp_replace(text, '[\\s]+$', ''), '["''”’»«)\\]}」]+$', ''), '[^.!?…。！？؟]$') and regexp_matches(next, '^\\s*[\\p{Ll}\\p{Lo}]') as held from p)
select book, count(*) filter (has) as boundaries, count(*) filter (has and held) as held, case when count(*) filter (has) = 0 then 1.0 else round(count(*) filter (has and held) / count(*) filter (has), 6) end as rate from r group by book""")
def continuity_rate(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), F.col("text").alias("first"), F.col("text").alias("last"))
    return rounded(furniture.continuity(pages), "rate")


TOKENS_SQL = f"""
t0 as (select source as book, doc_id, {WORDS.format(t="text")} as w from documents),
t1 as (select book, doc_id, unnest(range(0, len(w))) as i, unnest(w) as raw from t0),
tk as (select book, doc_id, i, raw, regexp_replace(raw, '^[^\\p{{L}}\\p{{N}}\\-‐]+|[^\\p{{L}}\\p{{N}}\\-‐]+$', '', 'g') as clean from t1),
tokens as materialized (select *, lower(clean) as word, case when regexp_matches(clean, '[-‐]$') then 'open' when regexp_matches(clean, '\\p{{L}}[-‐]\\p{{L}}') then 'hyphenated' else 'plain' end as kind from tk where clean <> ''),
lexicon as materialized (select book, regexp_replace(word, '[-‐]', '') as word, count(*) filter (kind = 'plain') as plain, count(*) filter (kind = 'hyphenated') as hyphenated from tokens where kind <> 'open' group by all)"""


@query(f"with {TOKENS_SQL} select * from lexicon")
def doc_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs.lexicon(paragraphs.word_uses(paragraphs.book_tokens(table(spark, d, "documents"), "source")))


@query(f"""with {TOKENS_SQL}, m as (select *, coalesce(regexp_matches(lag(raw) over (partition by book, doc_id order by i), '[.!?…:]$'), true) as after_stop from tokens),
s as (select book, count(*) filter (kind <> 'open') as words, count(*) filter (kind <> 'open' and regexp_matches(clean, '[-‐]\\p{{Ll}}')) as compounds,
 count(*) filter (kind <> 'open' and not after_stop and regexp_matches(raw, '^\\p{{Lu}}')) as capitals, count(*) filter (kind <> 'open' and not after_stop) as mids from m group by book)
select book, words, round(compounds / words, 6) as lower_compound_rate, round(case when mids = 0 then 0.0 else capitals / mids end, 6) as capital_rate,
 words >= 2000 and compounds / words <= 0.0005 as joins_by_style, case when mids = 0 then 0.0 else capitals / mids end >= 0.15 as capital_nouns from s""")
def book_style(spark: SparkSession, d: str) -> DataFrame:
    return rounded(paragraphs.book_style(paragraphs.word_uses(paragraphs.book_tokens(table(spark, d, "documents"), "source"))), "lower_compound_rate", "capital_rate")


@query(f"with {TOKENS_SQL}, r as (select book, word, plain, (select count(*) from lexicon b where b.book = a.book and b.plain > a.plain) as larger from lexicon a where plain > 0) select book, word, plain from r where larger < 30")
def function_words(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs.function_words(paragraphs.lexicon(paragraphs.word_uses(paragraphs.book_tokens(table(spark, d, "documents"), "source"))))


# every place between two words of one line stands for a line's end: head and tail of what could be one broken word
BREAKS_SQL = f"""{TOKENS_SQL},
breaks as materialized (select distinct book, head, tail from (select book, clean as head, lead(clean) over (partition by book, doc_id order by i) as tail from tokens) where regexp_full_match(head, '\\p{{L}}{{2,12}}') and regexp_full_match(tail, '\\p{{L}}{{2,12}}')),
b1 as (select book, head, tail, lower(head || tail) as joined, lower(head || substr(tail, 1, 3)) as stem, lower(tail) as low_tail from breaks),
m as (select *, coalesce(regexp_matches(lag(raw) over (partition by book, doc_id order by i), '[.!?…:]$'), true) as after_stop from tokens),
st0 as (select book, count(*) filter (kind <> 'open') as words, count(*) filter (kind <> 'open' and regexp_matches(clean, '[-‐]\\p{{Ll}}')) as compounds,
 count(*) filter (kind <> 'open' and not after_stop and regexp_matches(raw, '^\\p{{Lu}}')) as capitals, count(*) filter (kind <> 'open' and not after_stop) as mids from m group by book),
style as (select book, words >= 2000 and compounds / words <= 0.0005 as joins_by_style, case when mids = 0 then 0.0 else capitals / mids end >= 0.15 as capital_nouns from st0),
susp as (select distinct book, nextw as word from (select book, kind, lead(word) over (partition by book, doc_id order by i) as nextw from tokens) where kind = 'open' and nextw is not null),
fw as (select book, word from (select book, word, plain, rank() over (partition by book order by plain desc) as r from lexicon where plain > 0) where r <= 30),
lens as (select distinct book, length(stem) as s from b1 where length(stem) >= 4),
stems as (select book, substr(word, 1, s) as stem, sum(plain) as n from lexicon join lens using (book) where length(word) >= s and plain > 0 group by all),
x as (select b1.*, coalesce(l.plain, 0) as np, coalesce(l.hyphenated, 0) as nh, joins_by_style, capital_nouns, susp.word is not null as is_s, fw.word is not null as is_f, stems.n as ns
 from b1 left join lexicon l on l.book = b1.book and l.word = b1.joined left join style on style.book = b1.book left join susp on susp.book = b1.book and susp.word = low_tail
 left join fw on fw.book = b1.book and fw.word = low_tail left join stems on stems.book = b1.book and stems.stem = b1.stem),
tiers as (select book, head, tail, case
 when regexp_matches(joined, '\\p{{N}}') or not (regexp_matches(tail, '^\\p{{Ll}}') or capital_nouns) then 'candidate:keep'
 when np > 0 and nh = 0 then 'document:join' when nh > 0 and np = 0 then 'document:keep' when is_s or is_f then 'suspended:keep'
 when capital_nouns and regexp_matches(head, '^(\\p{{Lu}}|\\P{{L}})') and regexp_matches(tail, '^\\p{{Lu}}') then 'compound:keep'
 when length(stem) >= 4 and ns > 0 then 'stem:join' when joins_by_style then 'style:join' else 'closed:keep' end as t from x)"""


@query(f"with {BREAKS_SQL} select book, head, tail, split_part(t, ':', 1) as tier, split_part(t, ':', 2) as decision from tiers")
def dehyphen_decisions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    pairs = paragraphs.book_pairs(docs, "source")
    breaks = pairs.where(F.rlike("head", F.lit(r"^\p{L}{2,12}$")) & F.rlike("tail", F.lit(r"^\p{L}{2,12}$")))
    words = paragraphs.lexicon(paragraphs.pair_words(pairs)).where("book is not null and word is not null")
    return paragraphs.dehyphenate(breaks, words, paragraphs.style_of(docs, "source"), paragraphs.suspended_of(docs, "source"), paragraphs.function_words(words))
