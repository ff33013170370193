"""Queries for string scalars, on made-up titles, labels and numbers derived from the tables; the same inputs are spelt for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.plans.registry import registry
from scriptorium.plans.text_queries import WORDS, rounded
from scriptorium.sources.readers import table, words_of
from scriptorium.sources.sinks import canonical_rows

QUERIES, ORACLE_SQL, query = registry()

# every distinct word, with ligatures and soft hyphens put in
SPIKED_SQL = f"w as (select distinct unnest({WORDS.format(t='text')}) as w from documents), s as (select w, replace(replace(w, 'fi', 'ﬁ'), 'st', chr(173) || 'st') as spiked from w)"


def spiked(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(words_of(F.col("text"))).alias("w")).distinct()
    return words.select("w", F.replace(F.replace("w", F.lit("fi"), F.lit("ﬁ")), F.lit("st"), F.lit("­st")).alias("spiked"))


@query(f"with {SPIKED_SQL} select w, nfc_normalize(replace(replace(nfc_normalize(spiked), chr(173), ''), 'ﬁ', 'fi')) as normal, w <> spiked as changed from s")
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    return spiked(spark, d).select("w", T.normalized(F.col("spiked")).alias("normal"), (F.col("w") != F.col("spiked")).alias("changed"))


@query(f"""with {SPIKED_SQL}, c as (select w, i - 1 as i, string_split(nfc_normalize(spiked), '')[i] as ch from (select w, spiked, unnest(range(1, length(nfc_normalize(spiked)) + 1)) as i from s)),
g as (select *, case when ch = chr(173) then 0 when ch = 'ﬁ' then 2 else 1 end as grown from c), o as (select *, cast(coalesce(sum(grown) over (partition by w order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as o from g)
select w, 'SoftHyphen' as reason, false as added, i as start, i + 1 as end, ch as piece from o where ch = chr(173)
union all select w, 'LigatureExpand', false, i, i + 1, ch from o where ch = 'ﬁ' union all select w, 'LigatureExpand', true, o, o + 2, 'fi' from o where ch = 'ﬁ'""")
def normal_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = spiked(spark, d).select("w", F.inline(T.normal_ledger(F.col("spiked"))))
    return rows.select("w", "reason", "added", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("text").alias("piece"))


PAIR = "p_partkey, p_name || '-' || chr(10) || p_type || '  x' as truth, case p_partkey % 3 when 0 then p_name || p_type || ' x' when 1 then p_brand || ' ' || p_name else '' end as said"
FORM = "trim(regexp_replace(replace({c}, '-' || chr(10), ''), '\\s+', ' ', 'g'))"


@query(f"""with p as (select {PAIR} from part), f as (select p_partkey, {FORM.format(c="truth")} as a, {FORM.format(c="said")} as b from p)
select p_partkey, a as truth_form, round(levenshtein(a, b) / greatest(length(a), length(b)), 6) as ned, round(levenshtein(a, b) / length(a), 6) as cer, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) as score from f""")
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr(*_columns(PAIR))
    a, b = F.col("truth"), F.col("said")
    return rounded(p.select("p_partkey", T.compare_form(a).alias("truth_form"), T.ned(a, b).alias("ned"), T.cer(a, b).alias("cer"), T.text_score(a, b).alias("score")), "ned", "cer", "score")


def _columns(text: str) -> list[str]:
    """The expressions of a select list, cut at commas outside brackets and quotes."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(text):
        quoted ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quoted else 0
        if ch == "," and not depth and not quoted:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


CANON = "M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})"
DIGIT = "case {c} when 'i' then 1 when 'v' then 5 when 'x' then 10 when 'l' then 50 when 'c' then 100 when 'd' then 500 when 'm' then 1000 end"


@query(f"""with t as (select distinct unnest({WORDS.format(t="text")}) as token from documents union select cast(p_size as varchar) || '.' from part union select '(' || case p_partkey % 4 when 0 then 'XIV' when 1 then 'IIII' when 2 then 'vii' else '0' end || ')' from part),
b as (select token, regexp_replace(token, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') as bare from t),
r as (select distinct bare from b where regexp_full_match(bare, '[ivxlcdm]{{1,8}}|[IVXLCDM]{{1,8}}') and regexp_full_match(upper(bare), '{CANON}')),
d as (select bare, i, {DIGIT.format(c="string_split(lower(bare), '')[i]")} as v from (select bare, unnest(range(1, length(bare) + 1)) as i from r)),
v as (select bare, sum(case when v < n then -v else v end) as value from (select bare, v, coalesce(lead(v) over (partition by bare order by i), 0) as n from d) group by bare)
select token, cast(coalesce(case when regexp_full_match(bare, '[0-9]{{1,3}}') and cast(bare as int) > 0 then cast(bare as int) else v.value end, -1) as int) as number, regexp_full_match(bare, '[IVXLCivxl1]{{1,6}}') and regexp_matches(bare, '[A-Z1]') as misread
from b left join v using (bare) where regexp_full_match(bare, '[0-9]{{1,3}}') or v.value is not null or regexp_full_match(bare, '[IVXLCivxl1]{{1,6}}')""")
def numerals(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    tokens = table(spark, d, "documents").select(F.explode(words_of(F.col("text"))).alias("token")).union(part.selectExpr("cast(p_size as string) || '.'")).union(part.selectExpr("'(' || case p_partkey % 4 when 0 then 'XIV' when 1 then 'IIII' when 2 then 'vii' else '0' end || ')'"))
    token = F.col("token")
    out = tokens.distinct().select("token", F.coalesce(T.numeral(token), F.lit(-1)).cast("int").alias("number"), T.looks_like_a_misread_numeral(token).alias("misread"))
    bare = F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return out.where(F.rlike(bare, F.lit("^[0-9]{1,3}$")) | (F.col("number") >= 0) | F.rlike(bare, F.lit("^[IVXLCivxl1]{1,6}$")))


CAPTION = "p_partkey, case p_partkey % 7 when 0 then 'Fig. ' || p_size || ': ' || p_name when 1 then 'Table IV ' || p_name when 2 then 'Figure7 x' when 3 then 'Plate ' || p_name when 4 then 'Abb.' || p_size when 5 then 'Tafel B. ' || p_name else p_name end as line"


@query(f"""with p as (select {CAPTION} from part), w as (select *, regexp_split_to_array(trim(line), '\\s+') as w from p),
f as (select p_partkey, line, lower(regexp_extract(w[1], '^(\\p{{L}}*)', 1)) as word, regexp_replace(regexp_replace(w[1], '^\\p{{L}}*', ''), '^[.:]+', '') as glued, coalesce(w[2], '') as second from w),
n as (select *, regexp_replace(case when glued <> '' then glued else second end, '[.:)—]+$', '') as number from f)
select p_partkey, line, word in ({", ".join(f"'{w}'" for w in T.CAPTION_WORDS)}) and (regexp_full_match(number, '[0-9]+|\\p{{Lu}}') or regexp_full_match(number, '(?i)[ivxlcdm]{{1,8}}')) as caption from n""")
def caption_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*_columns(CAPTION)).select("p_partkey", "line", T.starts_with_caption_prefix(F.col("line")).alias("caption"))


FOLIO = "p_partkey, case p_partkey % 6 when 0 then p_name || ' ..... ' || p_size when 1 then p_name || ' xii' when 2 then p_name || '____IV' when 3 then cast(p_size as string) when 4 then p_name || '  ' else p_name || ' · 12345' end as line"


@query(f"""with p as (select {FOLIO} from part), n as (select *, regexp_extract(regexp_replace(line, '\\s+$', ''), '([\\p{{L}}\\p{{N}}]+)$', 1) as number, regexp_replace(line, '[\\p{{L}}\\p{{N}}]+\\s*$', '') as head from p),
t as (select *, trim(regexp_replace(head, '[\\s.·…_\\-‧•]+$', '')) as title, length(regexp_replace(regexp_extract(head, '([\\s.·…_\\-‧•]*)$', 1), '\\s', '', 'g')) as fill,
 case when regexp_full_match(number, '[0-9]{{1,4}}') then cast(number as bigint) when number = 'xii' then 12 when number = 'IV' then 4 end as value from n)
select p_partkey, line, case when value is not null and regexp_matches(title, '\\p{{L}}') then title else line end as title, coalesce(case when regexp_matches(title, '\\p{{L}}') then value end, -1) as value, case when value is not null and regexp_matches(title, '\\p{{L}}') then fill else 0 end as fill from t""")
def folio_splits(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr(*_columns(FOLIO)).withColumn("x", T.split_folio(F.col("line")))
    return p.select("p_partkey", "line", "x.title", F.coalesce("x.value", F.lit(-1)).alias("value"), F.col("x.fill").cast("bigint").alias("fill"))


TITLE = "p_partkey, case p_partkey % 8 when 0 then '1.2 ' || p_name when 1 then 'IV.  ' || p_name when 2 then 'Microsoft Word - ' || p_name || '.doc' when 3 then 'Untitled ' || p_size when 4 then p_name || ' — Blue Rod' when 5 then p_name || '.PDF' when 6 then 'Untitledness' else '  ' || upper(p_name) || '   x ' end as title"
FILE = "'a/b/' || replace(p_name, ' ', '_') || '-' || p_size || case p_partkey % 3 when 0 then '.pdf' when 1 then '' else '.tar.gz' end"
EXTENSIONS = f"\\.({T.FILE_EXTENSIONS})$"


def boiler(t: str) -> str:
    return f"trim({t}) = '' or regexp_matches(lower(trim({t})), '^microsoft (word|powerpoint) - |^untitled($|[^\\p{{L}}])|{EXTENSIONS}|^(document|dokument|belge|presentation)[0-9]*$')"


@query(f"""with p as (select {TITLE}, {FILE} as file from part), s as (select *, regexp_replace(trim(title), '\\s+', ' ', 'g') as flat,
 trim(regexp_replace(translate(regexp_replace(regexp_extract(file, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1'), '_-', '  '), '\\s+', ' ', 'g')) as named from p)
select p_partkey, title, regexp_replace(flat, '^([^\\p{{L}}\\p{{N}}\\s]*([0-9.]*|[IVXLCDM]{{1,8}})[^\\p{{L}}\\p{{N}}\\s]* )+', '') as stripped, {boiler("title")} as boilerplate, case when {boiler("named")} then null else named end as from_file,
 regexp_matches(title, '[—–]\\s*\\p{{Lu}}[^\\s—–]*(\\s+[^\\s—–]+){{0,3}}\\s*$') as attributed, lower(flat) as verbatim, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g') as squashed from s""")
def title_scalars(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr(*_columns(TITLE), f"{FILE} file")
    t = F.col("title")
    return p.select(
        "p_partkey", "title", T.strip_numbering(t).alias("stripped"), T.is_boilerplate(t).alias("boilerplate"), T.title_from_filename(F.col("file")).alias("from_file"), T.ends_with_attribution(t).alias("attributed"), T.verbatim_key(t).alias("verbatim"), T.squash_key(t).alias("squashed")
    )


@query("""with h as (select p_partkey, p_name, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(trim(p_name))) as h from part)
select p_partkey, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] as urn from h""")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.identifier(F.col("p_name")).alias("urn"))


@query("""with r as (select vec_id, label, 100 * embedding[1]::double as x0, 100 * embedding[2]::double as y0, 100 * embedding[3]::double as x1, 100 * embedding[4]::double as y1 from embeddings)
select vec_id, substr(sha256(concat_ws('|', label, cast(round(x0) as bigint), cast(round(y0) as bigint), cast(round(x1) as bigint), cast(round(y1) as bigint), 'block ' || (vec_id % 7))), 1, 16) as block from r""")
def block_ids(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double") * 100
    return table(spark, d, "embeddings").select("vec_id", T.block_id(F.col("label"), e(1), e(2), e(3), e(4), F.concat(F.lit("block "), F.col("vec_id") % 7)).alias("block"))


@query("select p_partkey, cast(json_object('ir_version', 1, 'name', p_name, 'price', round(p_retailprice / 7, 2), 'size', p_size) as varchar) as line from part")
def canonical_json_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_name").alias("name"), (F.col("p_retailprice") / 7).alias("price"), F.lit(1).alias("ir_version"))
    return p.select("p_partkey", canonical_rows(p.drop("p_partkey")).alias("line"))


MARK = "p_partkey, case p_partkey % 5 when 0 then 'ISBN x' when 1 then 'no 978-3-16-148410-' || (p_size % 10) when 2 then '12.3.4' when 3 then 'xiv' else p_name end as text, case p_partkey % 5 when 0 then p_size || ' | ' || p_name when 1 then p_name || ' ' || p_size when 2 then p_name || ' —' || p_size || '—' when 3 then cast(p_size as string) else p_name || ' / ' || p_size end as head"
SEP = "[|•·–—/:\\-]"


@query(f"""with p as (select {MARK} from part), w as (select *, regexp_split_to_array(head, '\\s+') as w, p_partkey % 3 = 0 as smaller, regexp_replace(text, '[\\s.]', '', 'g') as bare from p),
e as (select *, w[1] as a, w[2] as a2, w[-1] as b, w[-2] as b2, regexp_replace(w[1], '^{SEP}+|{SEP}+$', '', 'g') as da, regexp_replace(w[-1], '^{SEP}+|{SEP}+$', '', 'g') as db from w)
select p_partkey, contains(upper(text), 'ISBN') or coalesce(list_bool_or(list_transform(regexp_extract_all(text, '[0-9X-]+'), lambda x: regexp_full_match(regexp_replace(x, '[^0-9]', '', 'g'), '97[89][0-9]{{10}}'))), false) as isbn,
 cast(case when regexp_full_match(bare, '[0-9]{{1,18}}') then cast(bare as bigint) when bare = 'xiv' then 14 else -1 end as bigint) as number,
 coalesce(case when regexp_matches(head, '\\p{{L}}') and len(w) >= 2 then coalesce(case when regexp_full_match(da, '[0-9]{{1,18}}') and (length(a) <> length(da) or regexp_full_match(a2, '{SEP}+') or smaller) then cast(da as bigint) end,
  case when regexp_full_match(db, '[0-9]{{1,18}}') and (length(b) <> length(db) or regexp_full_match(b2, '{SEP}+') or smaller) then cast(db as bigint) end) end, -1) as at_an_end from e""")
def mark_scalars(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr(*_columns(MARK))
    roman_free = F.when(F.rlike("text", F.lit(r"^[0-9.]+$|^xiv$")), T.numeric_value(F.col("text")))
    return p.select("p_partkey", T.has_isbn(F.col("text")).alias("isbn"), F.coalesce(roman_free, F.lit(-1)).alias("number"), F.coalesce(T.number_at_an_end(F.col("head"), F.col("p_partkey") % 3 == 0), F.lit(-1)).alias("at_an_end"))


@query("""with t as (select lang, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\v\\f]+')) as w from documents where text is not null),
k as (select lang, case when regexp_matches(w, '[\\x{FFFD}\\p{Co}\\p{Cc}]') then 'undecodable' when length(regexp_replace(w, '[^\\p{L}]', '', 'g')) >= 2 then 'word' else 'other' end as kind, w from t where w <> '')
select lang, kind, case when kind = 'word' then lower(regexp_replace(w, '^[^\\p{L}]+|[^\\p{L}]+$', '', 'g')) else '' end as word, count(*) as n from k group by all""")
def token_kinds(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select("lang", F.explode(T.tokens_of(F.col("text"))).alias("t"))
    return tokens.groupBy("lang", "t.kind", "t.word").agg(F.count("*").alias("n"))


CODES = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa"}


@query(f"""with c as (select doc_id, lang || case when doc_id % 2 = 0 then '-XX' else '' end as tag, case doc_id % 5 when 4 then 'xxx' else case lang {" ".join(f"when '{k}' then '{v}'" for k, v in CODES.items())} end end as code, text from documents)
select doc_id, split_part(tag, '-', 1) as primary_tag, case code {" ".join(f"when '{v}' then '{k}'" for k, v in CODES.items())} else code end as tag, coalesce(length(text) - length(regexp_replace(text, '[\\x{{FFFD}}\\p{{Co}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g')), 0) as undecodable from c""")
def language_tags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    code = F.when(F.col("doc_id") % 5 == 4, "xxx").otherwise(F.try_element_at(F.create_map(*[F.lit(x) for p in CODES.items() for x in p]), F.col("lang")))
    tag = F.concat(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "-XX").otherwise(""))
    return docs.select("doc_id", T.primary(tag).alias("primary_tag"), T.tag_of(code).alias("tag"), F.coalesce(T.undecodable_count(F.col("text")), F.lit(0)).cast("bigint").alias("undecodable"))


WARNINGS = {"en": {"W_PAGES": "{n} pages of {book} were dropped", "W_LANG": "language {lang} is unknown"}, "de": {"W_PAGES": "{n} Seiten von {book} entfallen"}}


@query("""with w as (select p_partkey, case when p_partkey % 2 = 0 then 'W_PAGES' else 'W_LANG' end as code, case p_partkey % 3 when 0 then 'de-AT' when 1 then 'en' else 'tr' end as locale, p_name, p_size, p_type from part)
select p_partkey, case when code = 'W_LANG' then 'language ' || p_type || ' is unknown' when locale = 'de-AT' then p_size || ' Seiten von ' || p_name || ' entfallen' else p_size || ' pages of ' || p_name || ' were dropped' end as message from w""")
def warning_texts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey", "if(p_partkey % 2 = 0, 'W_PAGES', 'W_LANG') code", "case p_partkey % 3 when 0 then 'de-AT' when 1 then 'en' else 'tr' end locale", "map('n', cast(p_size as string), 'book', p_name, 'lang', p_type) slots")
    return p.select("p_partkey", T.render(T.localised(WARNINGS, F.col("code"), F.col("locale")), F.col("slots")).alias("message"))


@query("select page_id, md5(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) as escaped, md5(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) as page from pages")
def xml_texts(spark: SparkSession, d: str) -> DataFrame:
    md5 = lambda c: F.md5(T.xml_text(c).cast("binary"))
    return table(spark, d, "pages").select("page_id", md5(F.col("url")).alias("escaped"), md5(F.coalesce("html", F.lit(""))).alias("page"))


@query(f"""with w as (select distinct unnest({WORDS.format(t="text")}) as w from benchmark), b as (select w, list_transform(range(1, strlen(w) + 1), lambda i: cast((strpos('0123456789ABCDEF', substr(hex(encode(w)), 2 * i - 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(w)), 2 * i, 1)) - 1 as bigint)) as b from w)
select w, list_reduce(list_prepend(cast(2166136261 as bigint), b), lambda h, x: (xor(h, x) * 16777619) & 4294967295) as hash from b""")
def fnv_hashes(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.explode(words_of(F.col("text"))).alias("w")).distinct()
    return words.select("w", T.fnv1a32(F.col("w")).alias("hash"))
