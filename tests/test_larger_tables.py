"""Queries against their SQL on rows that the given tables hold few or none of."""

import duckdb

from scriptorium import catalogue
from scriptorium.operators import paragraphs


def against_sql(spark, name, tmp_path, **tables):
    """Rows of a query and of its SQL over tables given as DuckDB's SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
    plain = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    return plain(got), plain(want)


def test_admission_rounds_bytes_as_its_sql(spark, tmp_path):
    orders = "select i::bigint as o_orderkey, 1::bigint as o_custkey, [399999.5, 400000.4, 400000.5, 400000.6, 400001.5][i % 5 + 1]::double as o_totalprice, '1-URGENT' as o_orderpriority from range(1, 2000) t(i)"
    got, want = against_sql(spark, "harvest_admission", tmp_path, orders=orders, customer="select 9::bigint as c_custkey, 9000.0::double as c_acctbal")
    assert got == want


def test_glyphs_are_neither_sorted_nor_joined(spark, tmp_path):
    """Texts longer than an Arrow batch, control characters."""
    chats = "select (i // 2)::bigint as conv_id, (i % 2)::bigint as turn, repeat('a1 b-' || chr(10), 300 + i % 7) || 'c*' as text from range(40) t(i)"
    for name in ("glyph_runs", "glyph_lines", "line_baselines"):
        got, want = against_sql(spark, name, tmp_path, conversations=chats)
        assert got == want
        plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "collect_list" not in plan and ("Window" not in plan or name == "line_baselines")


def test_line_baselines_of_repeated_pages(spark, tmp_path):
    chats = "select 1::bigint as conv_id, 2::bigint as turn, repeat('word ', 20 + i::int) as text from range(6) t(i)"
    got, want = against_sql(spark, "line_baselines", tmp_path, conversations=chats)
    assert got == want


def test_block_languages_shuffle_no_trigrams(spark, tmp_path):
    """Repeated identifiers count together, texts without letters and nulls have no language."""
    text = "case i % 9 when 0 then '12 34' when 1 then null else repeat('the ship sailed over the sea ' || chr(10) || 'der Wind kam von der See her und ' || i || ' ', 2 + i::int % 3) end"
    docs = f"select (i // 2)::bigint as doc_id, {text} as text, case when i % 3 = 0 then 'de' else 'en' end as lang from range(60) t(i)"
    for name in ("block_languages", "document_languages"):
        if name == "document_languages":
            docs = docs.replace("(i // 2)", "i")  # its SQL has a row for each row, not for each identifier
        got, want = against_sql(spark, name, tmp_path, documents=docs)
        assert got == want
        plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert not any("gram" in x and "doc" in x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_breaks_are_shuffled_once(spark, tmp_path):
    """Marks, stops, open and inner hyphens, nulls; words before, at and after a joined form; pairs are neither joined nor made distinct by shuffles of their own."""
    words = ["Ship", "ship,", "\"Sea", "sea.", "—", "...", "co-op", "pre-", "post‐)", "coop", "shipsea", "shipseaman", "a1", "(and", "and", "Mann", "über", "Überall.", "seas", "ship-Sea", "x", "--", "shi"]
    text = "array_to_string([(%s)[1 + (i * 7919 + j * j * (31 + i %% 13)) %% %d] for j in range(60)], chr(10) || ' ')" % ("[" + ", ".join(f"'{w}'" for w in words) + "]", len(words))
    docs = f"select i::bigint as doc_id, case when i = 5 then null when i = 6 then '' else {text} end as text, ['a', 'b', 'c'][1 + i % 3] as source from range(60) t(i)"
    got, want = against_sql(spark, "dehyphen_decisions", tmp_path, documents=docs)
    assert got == want
    plan = catalogue.QUERIES["dehyphen_decisions"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any("head" in x and "tail" in x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "low_tail" not in x and "begin" not in x)


def test_style_and_suspended_words_of_texts(spark):
    text = ["A co-op met. \"The\" pre- — and post-war Men: go Far… On! a-b- c ‐ D, (eF-g)", "", None, "No stop", "... one", "x"]
    docs = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(text)], "book int, doc_id int, text string")
    tokens = paragraphs.book_tokens(docs, "book")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(paragraphs.style_of(docs, "book")) == rows(paragraphs.book_style(paragraphs.word_uses(tokens)))
    assert rows(paragraphs.suspended_of(docs, "book")) == rows(paragraphs.suspended_words(tokens)) != []


def test_breaks_with_many_looked_up_words(spark, tmp_path, monkeypatch):
    docs = "select i::bigint as doc_id, 'pipe line pre- and pipeline func tion functional Ab ' || i as text, case i % 3 when 0 then 'a' else 'b' end as source from range(9) t(i)"
    monkeypatch.setattr(paragraphs, "FEW", 0)
    got, want = against_sql(spark, "dehyphen_decisions", tmp_path, documents=docs)
    assert got == want
