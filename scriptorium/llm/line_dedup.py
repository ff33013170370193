"""Repeated runs of lines: a suffix array over line identifiers by distributed prefix doubling.

A document is a sequence of line identifiers. The rank of a position at depth 2**k orders the
suffixes by their first 2**k lines; the next depth's ranks are those of pairs of ranks, so a depth costs a join and a sort of
distinct pairs, and positions whose prefix occurs once leave. Positions of equal rank are an interval of the suffix array whose
longest common prefix is 2**k lines or more, and two overlapping ranks give the interval of any depth. A run counts
from MIN_WORDS words on: of each interval the first occurrence stays, the later copies go, and what they cover
together are the maximal repeated runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import Workspace, column, sized_join

MIN_WORDS = 50


def windows(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first line, lines) of the shortest runs with ``least`` words that begin at a line, and of those that end at one."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    first = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least)  # least end with total[end] - total[first] >= least
    ok = end <= n
    out = {*zip(first[ok].tolist(), (end - first)[ok].tolist(), strict=True)}
    last = np.arange(1, n + 1)
    begin = np.searchsorted(total, total[1:] - least, side="right") - 1
    ok = begin >= 0
    out |= {*zip(begin[ok].tolist(), (last - begin)[ok].tolist(), strict=True)}
    return sorted(out)


def _cut(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = windows(np.array(counts or [], np.int64), least)
                out[0].append(row)
                out[1].append(doc)
                out[2].append([a for a, _ in found])
                out[3].append([n for _, n in found])
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), batch.column(2), batch.column(3), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int32()))], names=["row", "doc_id", "h", "g", "starts", "lengths"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], names=["a", "b", "part", "place"])
        at += n


def _ranks(spark: SparkSession, ws: Workspace, pairs: DataFrame, name: str) -> DataFrame:
    """Rows (row, pos, rank) of the pairs (row, pos, a, b) that occur more than once; ranks are in the order of (a, b)."""
    classes = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    order = classes.repartitionByRange("a", "b").sortWithinPartitions("a", "b").mapInArrow(_numbered, "a bigint, b bigint, part int, place bigint")
    order = ws.keep(order, f"order-{name}")
    ends = {r["part"]: r["n"] for r in order.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number for each partition
    parts = sorted(ends)
    begin = spark.createDataFrame([(p, int(x)) for p, x in zip(parts, np.cumsum([0, *(ends[p] for p in parts)]), strict=False)], "part int, begin bigint")
    order = order.join(F.broadcast(begin), "part").select("a", "b", (F.col("begin") + F.col("place")).alias("rank"))
    return ws.keep(sized_join(pairs, order, ["a", "b"], "inner", sum(ends.values())).select("row", "pos", "rank"), f"ranks-{name}")


def repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, removed (the numbers, from 0, of lines that are later copies, ascending).

    Lines end at a newline and are equal if their text is. A run counts if it has ``min_words`` words (runs of characters other than space and
    0x09-0x0D). Its first occurrence, by identifier (null first), then place, stays; if a later copy overlaps the first
    occurrence, only lines after that go. A null text has no lines; an empty one has one, empty. Repeated rows are copies of each other.
    Long texts are read whole. No rows: no rows. Other columns aren't read.
    """
    ws = Workspace(spark, "line-dedup")
    text = F.split(column(docs, text_col).cast("string"), "\n")
    counts = F.transform(text, lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")))
    given = docs.select(column(docs, id_col).cast("long").alias("doc_id"), counts.alias("words"), F.transform(text, lambda x: F.xxhash64(x)).alias("h"), F.transform(text, lambda x: F.xxhash64(x, F.lit(1))).alias("g"))
    lines = ws.keep(given.mapInArrow(_cut(min_words), "row bigint, doc_id bigint, h array<bigint>, g array<bigint>, starts array<int>, lengths array<int>"), "lines")

    places = lines.select("row", F.inline(F.transform(F.arrays_zip(F.col("h").alias("h"), F.col("g").alias("g")), lambda x, i: F.struct(i.alias("pos"), x["h"].alias("a"), x["g"].alias("b")))))
    ranks = _ranks(spark, ws, places, "0")
    # a run of several lines that is repeated begins with a repeated line
    spans = lines.select("row", "doc_id", F.inline(F.arrays_zip(F.col("starts").alias("pos"), F.col("lengths").alias("length"))))
    spans = ws.keep(spans.join(ranks, ["row", "pos"], "left_semi"), "spans")
    longest = spans.agg(F.max("length")).first()[0] or 0

    gone, depth = None, 1
    while depth <= longest:
        of_depth = spans.where(f"length >= {depth} and length < {2 * depth}")
        head = of_depth.join(ranks.withColumnRenamed("rank", "a"), ["row", "pos"])
        if depth == 1:
            runs = head.withColumn("b", F.lit(0).cast("bigint"))
        else:  # two overlapping prefixes
            tail = ranks.select("row", F.col("pos").alias("tail"), F.col("rank").alias("b"))
            runs = head.withColumn("tail", F.expr(f"pos + length - {depth}")).join(tail, ["row", "tail"]).drop("tail")
        runs = ws.keep(runs.select("row", "doc_id", "pos", "length", "a", "b"), f"runs-{depth}")
        first = runs.groupBy("length", "a", "b").agg(F.min(F.struct("doc_id", "row", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
        first = ws.keep(first.drop("n"), f"first-{depth}")  # a table, so that an interval with very many members is split in the join
        later = sized_join(runs, first, ["length", "a", "b"], "inner").where("row <> first.row or pos <> first.pos")
        start = F.expr("if(row = first.row, greatest(pos, first.pos + length), pos)")
        new = later.select("row", start.alias("start"), F.expr("pos + length").alias("end")).where("start < end")
        new = ws.keep(new, f"gone-{depth}")
        gone = new if gone is None else gone.union(new)
        if 2 * depth <= longest:
            after = ranks.select("row", (F.col("pos") - depth).alias("pos"), F.col("rank").alias("b"))
            pairs = ws.keep(ranks.withColumnRenamed("rank", "a").join(after, ["row", "pos"]), f"pairs-{depth}")
            ranks = _ranks(spark, ws, pairs, str(2 * depth))
            ws.drop(f"pairs-{depth}", f"ranks-{0 if depth == 1 else depth}", f"order-{0 if depth == 1 else depth}")
        ws.drop(f"runs-{depth}", f"first-{depth}")
        depth *= 2

    counted = lines.select("row", "doc_id", F.when(F.col("h").isNull(), 0).otherwise(F.size("h")).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    if gone is None:
        return counted.select("doc_id", "n_lines", none.alias("removed"))
    removed = gone.distinct().groupBy("row").agg(F.collect_list(F.sequence(F.col("start"), F.col("end") - 1)).alias("spans"))
    removed = removed.select("row", F.array_sort(F.array_distinct(F.flatten("spans"))).alias("removed"))
    return counted.join(removed, "row", "left").select("doc_id", "n_lines", F.coalesce("removed", none).alias("removed"))


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines of ``removed`` (as ``repeated_lines`` gives them; identifiers that occur once) taken out of the text."""
    spots = removed.where(F.size("removed") > 0).select(F.col("doc_id").alias("removed_id_"), F.col("removed").alias("removed_lines_"))
    joined = docs.join(spots, column(docs, id_col) == F.col("removed_id_"), "left")
    left = F.array_join(F.filter(F.split(column(docs, text_col), "\n"), lambda x, i: ~F.array_contains(F.col("removed_lines_"), i)), "\n")
    return joined.select(*[(F.when(F.col("removed_id_").isNull(), column(docs, c)).otherwise(left).alias(c) if c == text_col else column(docs, c)) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


OP10_SQL = f"""
with d as (
  select doc_id, string_split(text, chr(10)) as lines from documents
), l as (
  select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from d
), w as (
  select doc_id, i, lines[i] as line, len(regexp_extract_all(lines[i], '[^\\x20\\x09-\\x0D]+')) as words from l
), c as (
  select doc_id, i, line, words, cast(sum(words) over (partition by doc_id order by i) as bigint) as upto from w
), spans as (
  select a.doc_id, a.i as s, min(b.i) as e from c a join c b on a.doc_id = b.doc_id and b.i >= a.i and b.upto - a.upto + a.words >= {MIN_WORDS} group by all
  union
  select b.doc_id, max(a.i) as s, b.i as e from c a join c b on a.doc_id = b.doc_id and b.i >= a.i and b.upto - a.upto + a.words >= {MIN_WORDS} group by b.doc_id, b.i
), runs as (
  select s.doc_id, s.s, s.e, array_to_string(d.lines[s.s:s.e], chr(10)) as content, s.e - s.s + 1 as n from spans s join d using (doc_id)
), first as (
  select *, first_value(doc_id) over (partition by content, n order by doc_id, s) as first_doc, first_value(s) over (partition by content, n order by doc_id, s) as first_s from runs
), gone as (
  select distinct doc_id, unnest(range(case when doc_id = first_doc then greatest(s, first_s + n) else s end, e + 1)) - 1 as line from first where doc_id <> first_doc or s <> first_s
), per as (
  select doc_id, count(*) as n_removed, string_agg(cast(line as varchar), ',' order by line) as removed from gone group by doc_id
)
select d.doc_id, coalesce(len(d.lines), 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(removed, '') as removed from d left join per using (doc_id)
"""
