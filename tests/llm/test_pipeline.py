"""The pipeline's stages in order, each held against what it should do to a small table."""

import corpus_pipeline as C
from scriptorium.llm.common import Workspace


def test_stages_and_columns(spark, tmp_path, words):
    base = [" ".join(words[(71 * i + j) % 3000] for j in range(40 + i)) for i in range(40)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[3].upper(), "en", "s1", 1), (101, base[4] + " tail", "en", "s1", 1), (102, "123 !!!", "en", "s0", 7), (103, None, "en", "s0", 0)]
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_duplicates", "mixing", "packing"]
    ws, kept = Workspace(spark, "test"), [{r["doc_id"] for r in docs.collect()}]
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = ws.keep(out, name)
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] - kept[1] == {102, 103}
    assert kept[1] - kept[2] == {3}  # the larger identifier of equal texts stays
    assert kept[2] - kept[3] == {101}  # the smaller of near copies stays
    assert kept[4] <= kept[3] and len(kept[4]) > 10
    pieces = C.STAGES[-1][1](spark, docs, path).collect()
    assert {r["doc_id"] for r in pieces} == kept[4]
    assert {r["doc_id"] for r in C.run(spark, path).collect()} == kept[4]


def test_free_heap_goes_back_between_steps(spark):
    """A heap that a large step has filled shrinks once the step is over; else it stays at its most beside the Python workers."""
    from scriptorium.llm.common import shrink_heaps

    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    spark.range(0, 6_000_000, 1, 8).selectExpr("id % 1000000 k", "repeat(cast(id as string), 4) t").groupBy("k").agg({"t": "collect_list"}).write.format("noop").mode("overwrite").save()
    before = runtime.totalMemory()
    shrink_heaps(spark)
    assert runtime.totalMemory() < 0.8 * before


def test_every_stage_begins_with_shrunk_heaps(spark, tmp_path, monkeypatch):
    import sys

    spark.createDataFrame([(i, f"some words of text {i} " * 5, "en", "a", 1) for i in range(9)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"file://{tmp_path}/documents.parquet")
    docs, called = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    for name, stage in C.STAGES:
        monkeypatch.setattr(sys.modules[stage.__module__], "shrink_heaps", lambda _, name=name: called.append(name))
        stage(spark, docs, f"file://{tmp_path}")
    assert {n for n, _ in C.STAGES} == set(called)
