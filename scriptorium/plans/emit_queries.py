"""Queries on emitted books, containers, sources around documents, languages and the ledger's stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import containers, emit, language, ledger, quality
from scriptorium.plans.book_queries import spark_sql
from scriptorium.plans.registry import registry
from scriptorium.plans.text_queries import LINES, rounded
from scriptorium.sources import documents as sources
from scriptorium.sources.readers import document_lines, table

QUERIES, ORACLE_SQL, query = registry()

# --- languages ---



def _counts(name: str, keys: str, source: str) -> str:
    words = "list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"""{name}w as (select {keys}, ' ' || word || ' ' as padded, count(*) as k from (select {keys}, unnest({words}) as word from {source}) group by all),
{name} as materialized (select {keys}, substr(padded, i, 3) as gram, sum(k) as n from (select *, unnest(range(1, length(padded) - 1)) as i from {name}w) group by all)"""


PROFILE_SQL = f"""{_counts("pc", "lang", "(select lang, text from documents where lang is not null and text is not null)")},
pt as (select *, row_number() over (partition by lang order by n desc, gram) as k from pc), prof as (select lang, gram, n / sum(n) over (partition by lang) as weight from pt where k <= 300)"""


def _detect(name: str, keys: str) -> str:
    return f"""of_{name} as (select {keys}, sum(n) as total from {name} group by all), m_{name} as (select {keys}, p.lang as lang, round(sum(n * weight) / any_value(total), 12) as score from {name} join prof p using (gram) join of_{name} using ({keys}) group by {keys}, p.lang),
d_{name} as (select {keys}, lang, 1 - coalesce(lead(score) over (partition by {keys} order by score desc, lang), 0) / score as confidence, row_number() over (partition by {keys} order by score desc, lang) as r from m_{name})"""


@query(f"with {PROFILE_SQL} select lang, gram, round(weight, 9) as weight from prof")
def language_profiles(spark: SparkSession, d: str) -> DataFrame:
    return language.profiles(table(spark, d, "documents")).withColumn("weight", F.round("weight", 9))


@query(f"""with {PROFILE_SQL}, {_counts("dc", "doc", "(select doc_id as doc, text from documents)")}, {_detect("dc", "doc")}
select doc_id as doc, coalesce(x.lang, 'en') as lang, round(coalesce(confidence, 0.0), 6) as confidence, x.lang is null as fell_back from documents left join (select * from d_dc where r = 1) x on x.doc = doc_id""")
def document_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return rounded(language.detect_documents(docs.select(F.col("doc_id").alias("doc"), "text"), language.profiles(docs)), "confidence")


# lines of twenty documents stand for the blocks of one book
@query(f"""with {PROFILE_SQL}, l as (select doc_id // 20 as doc, doc_id * 100000 + i - 1 as block, lines[i] as text from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, {LINES.format(t="text")} as lines from documents))),
{_counts("bc", "doc, block", "(select * from l where len(regexp_extract_all(text, '\\S+')) >= 5)")}, {_detect("bc", "doc, block")}, mn as (select doc_id // 20 as doc, min(lang) as main from documents group by 1),
o as (select d.doc, d.block, d.lang as tag from d_bc d join mn using (doc) where r = 1 and confidence >= 0.6 and lang <> main), s as (select l.doc, avg(case when tag is null then 0.0 else 1.0 end) as share from l left join o using (doc, block) group by l.doc)
select l.doc, l.block, coalesce(case when share <= 0.2 then tag end, '') as tag, round(share, 6) as share from l left join o using (doc, block) join s on s.doc = l.doc""")
def block_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = document_lines(docs).selectExpr("doc_id div 20 doc", "doc_id * 100000 + line_no block", "line text")
    main = docs.groupBy(F.expr("doc_id div 20").alias("doc")).agg(F.min("lang").alias("lang"))
    out = language.detect_blocks(lines, main, language.profiles(docs))
    return rounded(out.withColumn("tag", F.coalesce("tag", F.lit(""))), "share")


# --- a book's files ---

CONTENT = "p_partkey // 40 as doc, p_partkey // 8 as section, p_partkey as pos, case p_partkey % 8 when 0 then 'heading' when 5 then 'quote' when 6 then 'pre' else 'para' end as kind, 1 + p_size % 3 as level, p_name || ' & <' || p_size || '>' as text"
NOTES = "o_orderkey // 60 % 5 as doc, o_orderkey as note, o_orderkey // 8 as page, case when o_orderkey % 3 = 0 then o_orderkey // 60 % 5 * 40 + o_orderkey % 40 end as after_pos, o_orderpriority as text"
ESC = "replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
TAG = "case kind when 'heading' then 'h' || least(level, 6) when 'quote' then 'blockquote' when 'pre' then 'pre' else 'p' end"
ASIDE = "'<aside epub:type=\"footnote\" id=\"n' || note || '\">' || " + ESC.format(t="text") + " || '</aside>'"


@query(f"""with c as (select {CONTENT} from part), n as (select {NOTES} from orders where o_orderkey < 300), s as (select distinct doc, section, min(pos) as first from c group by doc, section),
p as (select doc, section, pos, cast(0 as bigint) as part, '<' || {TAG} || ' id="c' || pos || '">' || {ESC.format(t="text")} || '</' || {TAG} || '>' as html from c),
t as (select n.doc, c.section, after_pos as pos, note + 1 as part, {ASIDE.replace("text", "n.text")} as html from n join c on c.doc = n.doc and c.pos = after_pos where after_pos is not null),
o as (select n.doc, note, n.text, coalesce((select max(section) from s where s.doc = n.doc and s.first <= n.page), (select min(section) from s where s.doc = n.doc)) as section from n where after_pos is null),
l as (select o.doc, o.section, (select max(pos) from c where c.doc = o.doc and c.section = o.section) as pos, 1099511627776 + note as part, {ASIDE.replace("text", "o.text")} as html from o where section is not null)
select doc, section, pos as "at", part, md5(html) as html_md5 from (select * from p union all select * from t union all select * from l)""")
def emitted_pieces(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").selectExpr(*spark_sql(CONTENT)).withColumnRenamed("pos", "at")
    n = table(spark, d, "orders").where("o_orderkey < 300").selectExpr(*spark_sql(NOTES)).withColumnRenamed("after_pos", "after")
    sections = c.groupBy("doc", "section").agg(F.min("at").alias("first"))
    out = emit.emit(c, n, sections)
    return out.select("doc", "section", "at", "part", F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query(f"""with c as (select {CONTENT} from part), s as (select distinct doc, section from c), p as (select *, row_number() over (partition by doc order by section) - 1 as pos from s), f as (select *, 's' || lpad(cast(pos as varchar), 4, '0') || '.xhtml' as file from p)
select doc, section, pos, file, case when section % 3 = 0 then '' else 'Section ' || section end as title from f""")
def book_spine(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").selectExpr(*spark_sql(CONTENT))
    s = c.select("doc", "section").distinct().withColumn("heading", F.when(F.col("section") % 3 != 0, F.concat(F.lit("Section "), "section")))
    return emit.spine(s).select("doc", "section", F.col("pos").cast("bigint").alias("pos"), "file", F.coalesce("title", F.lit("")).alias("title"))


@query("""with a as (select p_partkey // 40 as doc, 'a' || p_size as anchor, min('s' || (p_partkey // 8) || '.xhtml') as file from part group by all), l as (select p_partkey // 40 as doc, p_partkey as id, 'a' || (p_size + 1) as target from part)
select l.doc, id, l.target, coalesce(file || '#' || l.target, '') as href from l left join a on a.doc = l.doc and a.anchor = l.target""")
def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    anchors = p.groupBy(F.expr("p_partkey div 40").alias("doc"), F.concat(F.lit("a"), "p_size").alias("anchor")).agg(F.min(F.concat(F.lit("s"), F.expr("p_partkey div 8"), F.lit(".xhtml"))).alias("file"))
    links = p.selectExpr("p_partkey div 40 doc", "p_partkey id", "'a' || (p_size + 1) target")
    return emit.resolve_links(links, anchors).withColumn("href", F.coalesce("href", F.lit("")))


@query("""with b as (select p_partkey // 40 as doc, p_partkey as page, case when p_size % 5 > 0 then cast(p_size as varchar) end as label, 'a' || p_partkey as anchor from part), a as (select p_partkey // 40 as doc, 'a' || p_partkey as anchor, 'f.xhtml' as file from part where p_partkey % 3 > 0),
k as (select *, row_number() over (partition by doc, label order by page) as k from b where label is not null) select k.doc, page, label, file || '#' || k.anchor as href from k join a on a.doc = k.doc and a.anchor = k.anchor where k = 1""")
def page_list(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    breaks = p.selectExpr("p_partkey div 40 doc", "p_partkey page", "if(p_size % 5 > 0, cast(p_size as string), null) label", "'a' || p_partkey anchor")
    return emit.page_targets(breaks, p.where("p_partkey % 3 > 0").selectExpr("p_partkey div 40 doc", "'a' || p_partkey anchor", "'f.xhtml' file"))


@query("""with f as (select p_partkey // 40 as doc, p_partkey as pos, 'f' || p_partkey as file, case p_size % 5 when 0 then 'front:toc' when 1 then 'front:other' when 2 then 'back:index' else 'chapter' end as role from part),
k as (select *, case when role = 'front:toc' then 'toc' when role like 'back:%' then 'backmatter' when role like 'front:%' then null else 'bodymatter' end as kind from f) select doc, kind, arg_min(file, pos) as file from k where kind is not null group by all""")
def book_landmarks(spark: SparkSession, d: str) -> DataFrame:
    return emit.landmarks(table(spark, d, "part").selectExpr("p_partkey div 40 doc", "p_partkey pos", "'f' || p_partkey file", "case p_size % 5 when 0 then 'front:toc' when 1 then 'front:other' when 2 then 'back:index' else 'chapter' end role"))


@query("select p_partkey, case when p_size % 3 = 0 then p_type when p_size % 3 = 1 and p_partkey % 2 = 0 then p_name else 'Figure ' || p_partkey end as alt from part")
def alt_texts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", emit.alt_text(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), "p_type")).otherwise(" "), F.when((F.col("p_size") % 3 == 1) & (F.col("p_partkey") % 2 == 0), F.col("p_name")), F.col("p_partkey")).alias("alt"))


NAV = "p_partkey // 40 as doc, p_partkey as pos, case p_partkey % 40 % 5 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 3 else 2 end as level, p_name || ' & co' as title, 'f' || p_partkey || '.xhtml' as href"


@query(f"""with e as (select {NAV} from part), w as (select *, coalesce(lag(level) over (partition by doc order by pos), 0) as was from e),
i as (select *, case when level > was then '<ol><li>' else repeat('</li></ol>', was - level) || '</li><li>' end || '<a href="' || href || '">' || replace(title, '&', '&amp;') || '</a>' as item from w)
select doc, md5('<nav epub:type="toc">' || string_agg(item, '' order by pos) || repeat('</li></ol>', arg_max(level, pos)) || '</nav>') as nav_md5 from i group by doc""")
def book_nav(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "part").selectExpr(*spark_sql(NAV)).withColumnRenamed("pos", "at")
    return emit.nav(e).select("doc", F.md5(F.col("nav").cast("binary")).alias("nav_md5"))


@query(f"""with e as (select {NAV} from part), w as (select *, coalesce(lag(level) over (partition by doc order by pos), 0) as was, row_number() over (partition by doc order by pos) as n from e),
i as (select *, repeat('</navPoint>', greatest(was - level + 1, 0)) || '<navPoint id="p' || n || '" playOrder="' || n || '"><navLabel><text>' || replace(title, '&', '&amp;') || '</text></navLabel><content src="' || href || '"/>' as item from w)
select doc, md5('<navMap>' || string_agg(item, '' order by pos) || repeat('</navPoint>', arg_max(level, pos)) || '</navMap>') as ncx_md5 from i group by doc""")
def book_ncx(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "part").selectExpr(*spark_sql(NAV)).withColumnRenamed("pos", "at")
    return emit.ncx(e).select("doc", F.md5(F.col("ncx").cast("binary")).alias("ncx_md5"))


FILES = "p_partkey // 40 as doc, case when p_size % 3 > 0 then p_partkey end as pos, case p_partkey % 40 when 0 then 'nav.xhtml' when 1 then 'style.css' else 's' || p_partkey || case p_size % 3 when 0 then '.png' else '.xhtml' end end as file"


@query(f"""with f as (select {FILES} from part), k as (select *, regexp_replace(file, '[^A-Za-z0-9]', '_', 'g') as id, case split_part(file, '.', 2) when 'xhtml' then 'application/xhtml+xml' when 'css' then 'text/css' else 'image/png' end as media from f),
m as (select doc, string_agg('<item id="' || id || '" href="' || file || '" media-type="' || media || '"' || case when file = 'nav.xhtml' then ' properties="nav"' else '' end || '/>', '' order by file) as manifest, string_agg('<itemref idref="' || id || '"/>', '' order by pos) filter (pos is not null) as spine from k group by doc)
select doc, md5('<package unique-identifier="id" version="3.0"><metadata><dc:identifier id="id">urn:' || doc || '</dc:identifier><dc:title>A &amp; B</dc:title><dc:language>en</dc:language><meta property="dcterms:modified">2020-01-01T00:00:00Z</meta><meta property="schema:accessMode">textual</meta><meta property="schema:accessMode">visual</meta></metadata><manifest>'
 || manifest || '</manifest><spine>' || spine || '</spine></package>') as opf_md5 from m""")
def book_packages(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").selectExpr(*spark_sql(FILES))
    books = f.select("doc").distinct().select("doc", F.lit("A & B").alias("title"), F.lit("en").alias("lang"), F.concat(F.lit("urn:"), "doc").alias("identifier"), F.lit("2020-01-01T00:00:00Z").alias("modified"))
    return emit.package(books, f).select("doc", F.md5(F.col("opf").cast("binary")).alias("opf_md5"))


@query()
def container_checks(spark: SparkSession, d: str) -> DataFrame:
    """Containers built from pages, and what is wrong with them; the tests hold the checks against containers with known faults."""
    pages = table(spark, d, "pages").where("html is not null")
    entry = lambda name, data: F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), data.cast("binary").alias("data"))
    opf = F.lit('<package unique-identifier="id" version="3.0"><metadata><dc:identifier id="id">x</dc:identifier><dc:title>x</dc:title><dc:language>en</dc:language><meta property="dcterms:modified">2020</meta></metadata><manifest><item id="p" href="p.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine><itemref idref="p"/></spine></package>')
    entries = pages.select(F.col("page_id").alias("doc"), F.inline(F.array(entry("mimetype", F.lit("application/epub+zip")), entry(containers.CONTAINER, F.lit('<rootfile full-path="book.opf"/>')), entry("book.opf", opf), entry("p.xhtml", F.col("html")))))
    return containers.validate_containers(emit.build_containers(entries).withColumn("images", F.lit(None).cast("int")))


# --- sources around documents ---

PRODUCER = "p_partkey, case p_partkey % 9 when 0 then 'pdfTeX-1.40' when 1 then 'Adobe InDesign 19' when 2 then 'Acrobat Distiller' when 3 then 'GPL Ghostscript 10' when 4 then 'Typst 0.15' when 5 then '' when 6 then 'Skia/PDF m131' when 7 then 'Not Typst at all' else p_name end as producer, case p_size % 4 when 0 then 'LaTeX with hyperref' when 1 then 'Microsoft Word' when 2 then 'WeasyPrint 63' else p_name end as creator"


@query(f"""with p as (select {PRODUCER} from part), k as (select *, case when creator = 'Microsoft Word' then 'Word' when creator like 'WeasyPrint%' then 'WeasyPrint' else 'Unknown' end as cf, case creator when 'LaTeX with hyperref' then 'pdfTeX' when 'Microsoft Word' then 'Word' when 'WeasyPrint 63' then 'ours(WeasyPrint)' end as cs from p)
select p_partkey, case p_partkey % 9 when 0 then 'pdfTeX' when 1 then 'InDesign' when 3 then 'Ghostscript' when 4 then 'Typst' when 6 then 'Chromium' else cf end as family,
 case p_partkey % 9 when 0 then 'pdfTeX' when 1 then 'InDesign' when 2 then coalesce(cs, 'unknown') when 3 then coalesce(cs, 'Ghostscript') when 4 then 'ours(Typst)' when 5 then coalesce(cs, 'unknown') when 7 then 'ours(Typst)' else 'unknown' end as stratum, p_partkey % 2 = 0 as tagged from k""")
def producer_families(spark: SparkSession, d: str) -> DataFrame:
    from scriptorium.plans.scalar_queries import _columns

    p = table(spark, d, "part").selectExpr(*_columns(PRODUCER))
    facts = p.select(F.col("p_partkey").alias("doc"), F.lit(1).alias("pages"), "producer", "creator", (F.col("p_partkey") % 2 == 0).alias("struct_tree"), F.lit(None).cast("boolean").alias("encrypt"))
    return sources.probe(facts).select(F.col("doc").alias("p_partkey"), "family", "stratum", "tagged")


BOOKMARK = "p_partkey // 40 as doc, p_partkey % 40 as node, case when p_partkey % 40 > 0 then (p_partkey % 40 - 1) // 3 end as parent, p_size as ord, case when p_partkey % 5 > 0 then p_name end as title, p_partkey as page"


@query(f"""with recursive n as (select {BOOKMARK} from part), w as (select doc, node, title, page, 0 as level, [(ord, node)] as path from n where parent is null union all select n.doc, n.node, n.title, n.page, w.level + 1, list_append(w.path, (n.ord, n.node)) from n join w on w.doc = n.doc and w.node = n.parent)
select doc, row_number() over (partition by doc order by path) - 1 as pos, title, level, page from w where title is not null""")
def flat_outlines(spark: SparkSession, d: str) -> DataFrame:
    return sources.flat_outline(table(spark, d, "part").selectExpr(*spark_sql(BOOKMARK)), 5).withColumn("pos", F.col("pos").cast("bigint"))


@query("select p_partkey, p_name as title, p_brand || ';' || p_type as creators, case when p_size % 2 = 0 then 'en' else '' end as language from part")
def metadata_packets(spark: SparkSession, d: str) -> DataFrame:
    li = lambda c: F.concat(F.lit("<rdf:li>"), c, F.lit("</rdf:li>"))
    packet = F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="r"><rdf:Description xmlns:dc="d"><dc:title><rdf:Alt>'), li(F.col("p_name")), F.lit("</rdf:Alt></dc:title><dc:creator><rdf:Seq>"), li(F.col("p_brand")), li(F.col("p_type")),
        F.lit("</rdf:Seq></dc:creator>"), F.when(F.col("p_size") % 2 == 0, "<dc:language><rdf:Bag><rdf:li>en</rdf:li></rdf:Bag></dc:language>").otherwise(""), F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"),
    )
    x = table(spark, d, "part").withColumn("x", sources.xmp_fields(packet))
    return x.select("p_partkey", "x.title", F.array_join("x.creators", ";").alias("creators"), F.coalesce("x.language", F.lit("")).alias("language"))


@query("""select p_partkey as id, case p_partkey % 5 when 0 then '' when 1 then 'unknown: colour' when 2 then 'missing: output' when 3 then 'type: schema' else 'not JSON' end as errors from part""")
def job_spec_errors(spark: SparkSession, d: str) -> DataFrame:
    spec = F.expr("""case p_partkey % 5 when 0 then '{"schema": 2, "input": "a", "output": "b"}' when 1 then '{"schema": 2, "input": "a", "output": "b", "colour": 1}' when 2 then '{"schema": 2, "input": "a"}' when 3 then '{"schema": "2", "input": "a", "output": "b"}' else p_name end""")
    out = sources.job_specs(table(spark, d, "part").select(F.col("p_partkey").alias("id"), spec.alias("spec")))
    return out.select("id", F.array_join("errors", "; ").alias("errors"))


@query("select p_partkey as doc, p_size % 2 = 0 and p_partkey % 3 = 0 as accepted from part")
def accepted_overrides(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    o = p.selectExpr("p_partkey doc", """'{"ir_version": ' || (1 + p_size % 2) || ', "source_sha256": "' || if(p_partkey % 3 = 0, sha2(p_name, 256), 'x') || '"}' json""")
    return sources.accepted_overrides(o, p.selectExpr("p_partkey doc", "sha2(p_name, 256) sha256"), 1).select("doc", "accepted")


@query()
def markup_truths(spark: SparkSession, d: str) -> DataFrame:
    """What pages' markup states; an HTML parser, which the tests hold against known markup."""
    out = sources.markup_truth(table(spark, d, "pages"))
    return out.groupBy("page_id", "kind").agg(F.count("*").alias("n"))


# --- the ledger's stages ---

STAGE_SQL = """e as (select o_custkey as doc, o_orderpriority as stage, case o_orderkey % 4 when 0 then 'RunningHeader' when 1 then 'Dehyphenate' when 2 then 'SoftHyphen' else 'Ocr' end as reason, o_orderkey % 4 = 3 as added, case o_orderkey % 4 when 1 then 1 else o_orderkey % 9 + 1 end as chars, case when o_orderkey % 4 = 1 and o_orderkey % 20 <> 5 then '-' else 'x' end as text from orders),
st as (select distinct o_custkey as doc, o_orderpriority as stage, o_orderpriority = '5-LOW' as conserving, o_custkey % 7 = 0 as narrow, 1000 as before from orders)"""


@query(f"""with {STAGE_SQL}, per as (select doc, stage, count(*) as n, bool_or(reason = 'SoftHyphen') as soft, cast(sum(case when added then chars else -chars end) as bigint) as change, count(*) filter (reason = 'Dehyphenate' and not (not added and text = '-')) as odd from e group by all),
net as (select doc, stage, reason, greatest(sum(case when added then -chars else chars end), 0) as net from e where reason <> 'Ocr' group by all),
g as (select doc, stage, case reason when 'RunningHeader' then 'furniture' when 'Dehyphenate' then 'dehyphenate' else 'other' end as grp, sum(net) as net from net group by all union all select doc, stage, 'global', sum(net) from net group by doc, stage),
r as (select *, sum(net) over (partition by doc, grp order by stage) as so_far from g), ov as (select doc, stage, arg_min(grp, case when grp = 'global' then 'zzz' else grp end) as over_ from r where so_far > case grp when 'furniture' then 0.012 when 'dehyphenate' then 0.004 when 'global' then 0.08 end * 1000 group by all)
select doc, stage, v as violation from (select st.doc, st.stage, case when conserving and coalesce(n, 0) > 0 then 'I-3' when narrow and coalesce(soft, false) then 'I-2' when coalesce(odd, 0) > 0 then 'I-5' when st.doc % 11 = 0 then 'I-1' when over_ is not null then 'I-4 ' || over_ end as v from st left join per using (doc, stage) left join ov using (doc, stage)) where v is not null""")
def stage_invariants(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").selectExpr(
        "o_custkey doc", "o_orderpriority stage", "case o_orderkey % 4 when 0 then 'RunningHeader' when 1 then 'Dehyphenate' when 2 then 'SoftHyphen' else 'Ocr' end reason", "o_orderkey % 4 = 3 added",
        "if(o_orderkey % 4 = 1, 1, o_orderkey % 9 + 1) chars", "if(o_orderkey % 4 = 1 and o_orderkey % 20 <> 5, '-', 'x') text",
    )
    change = e.groupBy("doc", "stage").agg(F.sum(F.when(F.col("added"), F.col("chars")).otherwise(-F.col("chars"))).alias("c"))
    declared = F.when(F.col("doc") % 7 == 0, F.array(*map(F.lit, ["RunningHeader", "Dehyphenate", "Ocr"]))).otherwise(F.array(*map(F.lit, ["RunningHeader", "Dehyphenate", "Ocr", "SoftHyphen"])))
    stages = change.select("doc", "stage", (F.col("stage") == "5-LOW").alias("conserving"), declared.alias("declared"), F.lit(1000).alias("before"), (1000 + F.col("c") + F.when(F.col("doc") % 11 == 0, 1).otherwise(0)).alias("after"))
    totals = stages.select("doc").distinct().withColumn("start", F.lit(1000))
    return ledger.check_stages(stages, e, totals, {"furniture": 0.012, "dehyphenate": 0.004})


@query("select p_partkey as doc, round((p_size * 19 - p_size % 3) / (p_size * 20), 6) as retention from part where (p_size * 19 - p_size % 3) / (p_size * 20) < 0.98 and p_size > 0 and p_partkey % 4 > 0 union all select p_partkey, 0.0 from part where p_size > 0 and p_partkey % 4 = 0")
def retention_warnings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey doc", "p_size * 20 start", "if(p_partkey % 4 = 0, 0, p_size * 19) out", "if(p_partkey % 4 = 0, 0, p_size % 3) ocr")
    return rounded(ledger.retention_warnings(rows), "retention")


@query("""with f as (select page_id, regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1) as body from pages where page_id % 3 > 0), b as (select page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(body, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as t from f)
select page_id % 5 as book, ch, count(*) as n from (select page_id, unnest(string_split(regexp_replace(t, '\\s', '', 'g'), '')) as ch from b) where ch <> '' group by all""")
def book_characters(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "pages").select((F.col("page_id") % 5).alias("book"), F.when(F.col("page_id") % 3 > 0, F.col("page_id")).alias("pos"), "html")
    return ledger.book_characters(f, ["book"])


@query("""with a as (select p_name as ch, sum(p_size) as n from part group by 1), b as (select p_name as ch, count(*) * 20 as n from part where p_size % 2 = 0 group by 1), u as (select ch, sum(n) as n from (select * from a union all select * from b) group by ch), f as (select a.ch, greatest(a.n - coalesce(b.n, 0), 0) as n from a left join b using (ch))
select 'union' as op, ch, cast(n as bigint) as n from u union all select 'difference', ch, cast(n as bigint) from f where n > 0 union all select 'total', '', cast(sum(n) as bigint) from a""")
def multiset_algebra(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("k", F.lit(0))
    a = p.groupBy("k", F.col("p_name").alias("ch")).agg(F.sum("p_size").alias("n"))
    b = p.where("p_size % 2 = 0").groupBy("k", F.col("p_name").alias("ch")).agg((F.count("*") * 20).alias("n"))
    row = lambda op, df: df.select(F.lit(op).alias("op"), "ch", F.col("n").cast("bigint").alias("n"))
    total = ledger.total(a, ["k"]).select(F.lit("total").alias("op"), F.lit("").alias("ch"), F.col("total").cast("bigint").alias("n"))
    return row("union", ledger.union(["k"], a, b)).union(row("difference", ledger.difference(a, b, ["k"]))).union(total)


@query(f"""with l as (select source, trim(regexp_replace(unnest({LINES.format(t="text")}), '\\s+', ' ', 'g')) as text from documents), s as (select source, text, count(*) as n from l where length(text) >= 40 group by all) select source, cast(coalesce(sum(n - 1), 0) as bigint) as surplus, count(*) filter (n > 1) as texts from s group by source""")
def duplicate_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = document_lines(docs).join(docs.select("doc_id", "source"), "doc_id").select("source", F.col("line").alias("text"), F.lit(False).alias("in_table"))
    return quality.duplicate_stats(quality.significant_blocks(lines), ["source"])
