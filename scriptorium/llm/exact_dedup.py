"""Exact deduplication by a stateful stream.

Arrivals (identifier, digest of the normalised text, locator) are a Structured Streaming
source. The stream's keyed state lives in RocksDB on the executors' disks, is saved in the
shared folder at each commit, has no watermark and so never expires, and holds per digest
the stable identifier, the content locator and the number of copies. A locator is a row's file and its place in that file.
After the stream has taken all that has arrived, the state is read as a table and every hit is held, byte for
byte, against the content that the state's locator points to. Everything is DataFrame operations.

The state's partitions are those of ``spark.sql.shuffle.partitions`` when a stream begins, and stay as many for its life: a distinct text takes some 100 bytes, so
10 000 million of them are a thousand partitions of 1 GB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import Workspace, column, lower_ascii, shrink_heaps, sized_join

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVAL = "doc_id bigint, digest binary, file bigint, row bigint"
#: RocksDB's native memory on an executor, all stores together.
STORE_MB = 64


def sha256(normalised: Column) -> Column:
    return F.unhex(F.sha2(normalised.cast("binary"), 256))


def normalise(text: Column) -> Column:
    """A-Z to lower case; null counts as empty."""
    return F.coalesce(lower_ascii(text), F.lit(""))


def located(ws: Workspace, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the locator: file (a hash of its path) and row (its number in the file). Rows that aren't read from Parquet files are written first, and are then."""

    def read(df: DataFrame, names: list[str]) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select(column(df, names[0]).cast("long").alias("doc_id"), column(df, names[1]).cast("string").alias("text"), F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row"))

    try:
        return read(docs, [id_col, text_col])
    except AnalysisException:
        given = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
        return read(ws.keep(given, "content"), ["doc_id", "text"])


def update_state(spark: SparkSession, arrivals: str, checkpoint: str, bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """Run the stream over what has come to the folder ``arrivals`` since the last call with this checkpoint; return the state.

    Rows: digest, keep_id (largest identifier so far), keep_file and keep_row (where that document is), group_size.
    """
    store = "spark.sql.streaming.stateStore"
    # without preallocated files, a small store takes what it holds and not 4 MB or more
    # and many stores on one executor stay small; those of a query that has ended are unloaded soon
    small = {f"{store}.rocksdb.writeBufferSizeMB": "16", f"{store}.maintenanceInterval": "10s"}
    small |= {f"{store}.rocksdb.boundedMemoryUsage": "true", f"{store}.rocksdb.maxMemoryUsageMB": str(STORE_MB)}
    conf = {**small, f"{store}.providerClass": ROCKSDB, f"{store}.rocksdb.changelogCheckpointing.enabled": "true", f"{store}.rocksdb.allowFAllocate": "false"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(ARRIVAL).option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(arrivals)
        state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("last"), F.count("*").alias("group_size"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.format("statestore").load(checkpoint)
    value = {f.name: i for i, f in enumerate(found.schema["value"].dataType.fields)}
    last, size = list(value)[0], list(value)[1]
    kept = [F.col(f"value.`{last}`.{x}").alias(f"keep_{y}") for x, y in (("doc_id", "id"), ("file", "file"), ("row", "row"))]
    return found.select(F.col("key.digest").alias("digest"), *kept, F.col(f"value.`{size}`").alias("group_size"))


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest (binary), keep_file and keep_row (the locator of the document that stays).

    Texts are equal if identical after A-Z are lower-cased; a null text counts as empty and is
    equal to an empty one. Of equal texts the largest identifier stays. Rows that repeat the identifier
    that stays, with an equal text, are that document and are kept as well. A null identifier is
    smaller than all others; a group of null identifiers only is kept (it has nothing to prefer). No rows: no rows.
    Other columns are not read, whatever their names. ``digest`` may be weak: texts that
    share a digest but differ in bytes are told apart by the byte check.
    """
    ws = Workspace(spark, "exact-dedup")
    content = located(ws, docs, id_col, text_col)
    ws.keep(content.select("doc_id", digest(normalise(F.col("text"))).alias("digest"), "file", "row"), "arrivals")
    state = update_state(spark, ws.paths["arrivals"], ws.path("state"))
    arrivals = spark.read.schema(ARRIVAL).parquet(ws.paths["arrivals"])
    found = ws.keep(arrivals.join(state, "digest"), "found")

    # The byte check: texts are read, and shuffled, where a hit or what it hit points to.
    place, kept_place = ["file", "row"], ["keep_file", "keep_row"]
    hits = found.where("group_size > 1 and (file <> keep_file or row <> keep_row)").select("digest", *place, *kept_place)
    keeps = ws.keep(hits.select(*[F.col(k).alias(p) for k, p in zip(kept_place, place, strict=True)]).distinct(), "keeps")
    texts = sized_join(content, ws.keep(hits.select(*place).union(keeps).distinct(), "wanted"), place, "left_semi").select(*place, normalise(F.col("text")).alias("text"))
    kept_texts = sized_join(texts, keeps, place, "left_semi").select(*[F.col(p).alias(k) for k, p in zip(kept_place, place, strict=True)], F.col("text").alias("kept_text"))
    differ = texts.join(hits, place).join(kept_texts, kept_place).where(F.col("text") != F.col("kept_text")).select("digest").distinct()
    differ = ws.keep(differ, "differ")
    out = found.select("doc_id", "digest", "keep_id", *kept_place, "group_size")
    if not differ.isEmpty():  # one digest, several texts: those are grouped by their bytes
        odd = sized_join(content.select("doc_id", *place, normalise(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text"))), differ, "digest", "left_semi")
        groups = odd.groupBy("digest", "text").agg(F.max(F.struct("doc_id", *place)).alias("last"), F.count("*").alias("group_size"))
        again = odd.join(groups, ["digest", "text"]).select("doc_id", "digest", F.col("last.doc_id").alias("keep_id"), F.col("last.file").alias("keep_file"), F.col("last.row").alias("keep_row"), "group_size")
        out = sized_join(out, differ, "digest", "left_anti").unionByName(again)
    ws.drop("arrivals", "state", "keeps", "wanted")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(spark, docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents
), g as (
  select doc_id, max(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size, sha256(x) as text_sha256 from t
)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from g
"""


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the document with the largest identifier stays; all columns of documents are returned."""
    shrink_heaps(spark)
    verdict = exact_dedup(spark, docs)
    gone = verdict.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    keyed = docs.withColumn("digest_", sha256(normalise(F.col("text"))))
    return sized_join(keyed, gone, keyed["doc_id"].eqNullSafe(F.col("gone_id")) & (keyed["digest_"] == F.col("gone_digest")), "left_anti").select(*docs.columns)
