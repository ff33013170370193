import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from scriptorium.llm import exact_dedup as X

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        own = groups[(t or "").translate(LOWER)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").translate(LOWER).encode()).digest()))
    return out


def result(df):
    return [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"])) for r in df.collect()]


def order(rows):
    return sorted(rows, key=str)


def test_same_as_brute_force(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert order(result(X.exact_dedup(spark, odd_docs))) == order(brute(rows))


def test_a_weak_digest_is_put_right_by_the_byte_check(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    weak = X.exact_dedup(spark, odd_docs, digest=lambda c: F.unhex(F.lit("00")))
    assert order(x[:4] for x in result(weak)) == order(x[:4] for x in brute(rows))


def test_large_group_and_empty_table(spark, odd_docs):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "Same").otherwise(F.col("id").cast("string")).alias("text"))
    got = X.exact_dedup(spark, df).where("kept").count()
    assert got == 251
    assert X.exact_dedup(spark, odd_docs.limit(0)).count() == 0


def test_state_is_kept_between_arrivals(spark, tmp_path):
    folder, state = f"file://{tmp_path}/arrivals", f"file://{tmp_path}/state"
    put = lambda rows: spark.createDataFrame(rows, X.ARRIVAL).coalesce(1).write.mode("append").parquet(folder)
    put([(1, b"a", 5, 0), (2, b"b", 5, 1)])
    X.update_state(spark, folder, state).count()
    put([(7, b"a", 6, 0)])
    got = {bytes(r["digest"]): (r["keep_id"], r["keep_file"], r["keep_row"], r["group_size"]) for r in X.update_state(spark, folder, state).collect()}
    assert got == {b"a": (7, 6, 0, 2), b"b": (2, 5, 1, 1)}


def test_the_locator_is_where_the_text_is(spark, odd_docs, tmp_path):
    path = f"file://{tmp_path}/some docs"
    odd_docs.repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    places = docs.select("doc_id", "text", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    texts = {(r["file"], r["row"]): (r["doc_id"], (r["text"] or "").translate(LOWER)) for r in places.collect()}
    found = X.exact_dedup(spark, docs).collect()
    assert len(found) == 11
    for r in found:
        keep_id, text = texts[r["keep_file"], r["keep_row"]]
        assert keep_id == r["keep_id"] and hashlib.sha256(text.encode()).digest() == bytes(r["digest"])


def test_null_identifiers_are_told_apart_by_their_bytes(spark):
    rows = [(None, "a"), (None, "b"), (None, "a"), (3, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    weak = X.exact_dedup(spark, df, digest=lambda c: F.unhex(F.lit("00")))
    assert order(x[:4] for x in result(weak)) == order(x[:4] for x in brute(rows))
