"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic of ``topics``); the cells' weights are raked until their marginals
are the targets, on the driver where cells are few, else as a table. A document is sampled with a probability in proportion to its cell's weight over
its cell's tokens, scaled so that the expected number of tokens is the wanted share of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import topics
from scriptorium.llm.common import Workspace, column, fresh, give_back, shrink_heaps, sized_join
from scriptorium.llm.shingles import word_hashes

if TYPE_CHECKING:  # Python tasks do without it
    import pandas as pd

DIMENSIONS = ("source", "language", "topic")
#: Without targets, a marginal's target is its share of tokens to this power, normalised: small ones gain.
TEMPER = 0.7
#: The expected share of all tokens that is sampled.
SHARE = 0.6
ROUNDS, CLOSE = 500, 1e-10
#: Up to so many cells are raked on the driver; more are raked as a table, with the same result.
MOST_CELLS = 200_000


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Weights of the cells, in sum 1, whose marginals are the targets; begins with the cells' shares of tokens.

    A category without tokens cannot be reached: its target is left out and the others are normalised. If the targets are
    not all reachable together, the result of the last round stays (the last dimension's marginal is exact).
    """
    weight = cells["tokens"].to_numpy(np.float64).copy()
    if weight.sum() <= 0:
        return weight
    weight /= weight.sum()
    plan = []
    for d, wanted in targets.items():
        names, code = np.unique(cells[d].to_numpy().astype(str), return_inverse=True)
        has = np.bincount(code, weight, len(names)) > 0
        goal = np.array([max(0.0, wanted.get(n, 0.0)) for n in names]) * has
        if goal.sum() > 0:
            plan.append((code, goal / goal.sum()))
    for _ in range(rounds):
        off = 0.0
        for code, goal in plan:
            now = np.bincount(code, weight, len(goal))
            off = max(off, np.abs(now - goal).max())
            weight = weight * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code]
        if off < close:
            break
    return weight


def calibrate(weight: np.ndarray, counted: np.ndarray, share: float) -> np.ndarray:
    """Probabilities min(1, k * weight / counted) with k such that the expected tokens are ``share`` of all, or as many as can be."""
    ratio = np.divide(weight, counted, out=np.zeros_like(weight), where=counted > 0)
    p, want = np.zeros_like(ratio), share * counted.sum()
    if ratio.max(initial=0) <= 0:
        return p
    order = np.argsort(-ratio, kind="stable")
    full, rest = 0.0, (ratio * counted)[order][::-1].cumsum()[::-1]
    for i, j in enumerate(order):  # cells of the highest ratio reach 1 first
        k = (want - full) / rest[i] if rest[i] > 0 else np.inf
        if k * ratio[j] <= 1:
            p[order[i:]] = np.minimum(1.0, k * ratio[order[i:]])
            return p
        p[j] = 1.0 if ratio[j] > 0 else 0.0
        full += counted[j] * p[j]
    return p


def tempered(cells: pd.DataFrame, power: float = TEMPER) -> dict[str, dict[str, float]]:
    out = {}
    for d in DIMENSIONS:
        sums = cells.groupby(d)["tokens"].sum()
        goal = (sums / max(1, sums.sum())) ** power * (sums > 0)
        out[d] = (goal / max(goal.sum(), 1e-300)).to_dict()
    return out


def rake_table(ws: Workspace, cells: DataFrame, targets: dict[str, dict[str, float]] | None, share: float, rounds: int = ROUNDS, close: float = CLOSE, power: float = TEMPER) -> DataFrame:
    """(source, language, topic, w, p): what ``rake`` and ``calibrate`` give, as grouped sums and joins on a written table of cells; one table a round."""
    spark = ws.spark
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if total <= 0:
        return cells.select(*DIMENSIONS, F.lit(0.0).alias("w"), F.lit(0.0).alias("p"))
    goals = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
        if targets is not None and d not in targets:
            continue
        if targets is None:
            goal = sums.select(d, F.pow(F.col("n") / total, F.lit(power)).alias("goal"))
        else:
            wanted = spark.createDataFrame([(k, float(max(0.0, v))) for k, v in targets[d].items()], f"{d} string, goal double")
            goal = sums.join(wanted, d, "left").select(d, F.coalesce("goal", F.lit(0.0)).alias("goal"))
        all_of = float(goal.agg(F.sum("goal")).first()[0] or 0)
        if all_of > 0:
            goals[d] = ws.keep(goal.withColumn("goal", F.col("goal") / all_of), f"goals-{d}")
    now = ws.keep(cells.withColumn("w", F.col("tokens") / total), "weights")
    for i in range(rounds):
        off, after = 0.0, now
        for d, goal in goals.items():
            sums = ws.keep(after.groupBy(d).agg(F.sum("w").alias("is")).join(goal, d, "left").select(d, "is", F.coalesce("goal", F.lit(0.0)).alias("goal")), f"sums-{i}-{d}")
            off = max(off, sums.agg(F.max(F.abs(F.col("is") - F.col("goal")))).first()[0] or 0.0)
            factor = sums.select(d, F.when(F.col("is") > 0, F.col("goal") / F.col("is")).otherwise(0.0).alias("factor"))
            after = after.join(factor, d).withColumn("w", F.col("w") * F.col("factor")).drop("factor")
        now = ws.keep(after, f"weights-{i}")
        ws.drop("weights" if i == 0 else f"weights-{i - 1}")
        if off < close:
            break
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)
    now = ws.keep(now.withColumn("ratio", ratio), "ratios")
    k, full = 0.0, -1
    while True:  # cells that reach 1 leave; what they have counts in full
        at_one = F.col("ratio") * k >= 1
        n, done, rest = now.agg(F.count_if(at_one), F.coalesce(F.sum(F.when(at_one, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~at_one, F.col("w"))), F.lit(0.0))).first()
        if n == full or rest <= 0:
            k = k if rest > 0 or n else 0.0
            break
        k, full = (share * total - float(done)) / rest, n
    p = F.when(F.col("ratio") > 0, F.least(F.lit(1.0), F.lit(k) * F.col("ratio"))).otherwise(0.0)
    return now.select(*DIMENSIONS, "w", p.alias("p"))


def uniform(identifier: Column) -> Column:
    """A number in [0, 1) that depends on the identifier only."""
    return F.conv(F.substring(F.md5(F.coalesce(identifier.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _read(names: list[str]):
    """Adds a document's tokens (runs of bytes other than space and 0x09-0x0D) and their buckets to its columns but the first, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, at, n = [], [], []
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                words = word_hashes(t or b"")
                tokens.append(len(words))
                for own, x in zip((at, n), topics.buckets(words), strict=True):
                    own.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(tokens, pa.int64()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=names)
        give_back()

    return run


def _named(model: topics.Topics, names: list[str]):
    """Adds the topic to columns of which the last three are language, at and n; at and n go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at, n = (c.to_pylist() for c in batch.columns[-3:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(model.names(at, n, langs), pa.string())], names=names)
        give_back()

    return run


def mix_sources(
    spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep: list[str] | None = None, model: topics.Topics | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, unless given) and: topic, tokens, weight (of the row's cell, after raking), probability and sampled. Names that are taken are lengthened by ``_``.

    One row per row. A null source or language is the empty name; a null or empty text has no tokens and the topic
    ``none``. Topics are those of ``model``, or of a model fitted to all of ``docs``. A cell without tokens has probability 0. Rows that repeat an identifier in the same cell share one draw. A null identifier draws as an empty one. No rows: no rows.
    """
    ws = Workspace(spark, "mixing")
    kept, names = docs.columns if keep is None else keep, {}
    taken = [*kept]
    for n in ("topic", "tokens", "weight", "probability", "sampled"):
        names[n] = fresh(taken, n)
        taken.append(names[n])
    name = lambda c: F.coalesce(column(docs, c).cast("string"), F.lit(""))
    # plain names on the way through Python; texts are read once, what follows reads their buckets
    given = docs.select(column(docs, text_col).cast("string").alias("text"), *[column(docs, c).alias(f"c{i}") for i, c in enumerate(kept)], name(source_col).alias("source"), name(lang_col).alias("language"), uniform(column(docs, id_col)).alias("draw"))
    schema = T.StructType([*given.schema.fields[1:], T.StructField("tokens", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])
    read = ws.keep(given.mapInArrow(_read([f.name for f in schema.fields]), schema), "read")
    model = model or topics.fit_vectors(read.select("language", "at", "n"))

    def with_topics(columns: list[str]) -> DataFrame:
        slim = T.StructType([*read.select(*columns, "language").schema.fields, T.StructField("topic", T.StringType())])
        return read.select(*columns, "language", "at", "n").mapInArrow(_named(model, [f.name for f in slim.fields]), slim)

    own = with_topics([*[f"c{i}" for i in range(len(kept))], "source", "draw", "tokens"])
    cells = ws.keep(with_topics(["source", "tokens"]).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    n = cells.count()
    if n <= MOST_CELLS:
        few = cells.toPandas().sort_values([*DIMENSIONS], ignore_index=True)
        weight = rake(few, targets or tempered(few))
        chance = calibrate(weight, few["tokens"].to_numpy(np.float64), share)
        table = spark.createDataFrame([(*map(str, r[:3]), float(w), float(p)) for r, w, p in zip(few.itertuples(index=False), weight, chance, strict=True)], "source string, language string, topic string, w double, p double")
    else:
        table = ws.keep(rake_table(ws, cells, targets, share), "raked")
    out = sized_join(own, table, [*DIMENSIONS], "inner", n)
    added = [F.col("topic"), F.col("tokens"), F.col("w"), F.col("p"), F.col("draw") < F.col("p")]
    return out.select(*[F.col(f"c{i}") for i in range(len(kept))], *added).toDF(*kept, *names.values())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = mix_sources(spark, docs, keep=["doc_id", "source", "lang"])
    return found.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), "sampled")


def sample_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents sampled to the tempered marginals, with all columns."""
    shrink_heaps(spark)
    found = mix_sources(spark, docs)
    return found.where(F.col(found.columns[-1])).select(*docs.columns)
