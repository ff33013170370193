"""Near duplicates among vectors by sorted projection passes.

In each pass the vectors are sorted by a word of random sign hashes, most significant first, and cut into blocks; vectors of
a block are compared with each other and with the next block's. Every pair that is near
shares the first bits of some pass with high probability, and then lies in neighbouring blocks or in the same run: the vectors
with the same first bits, as many bits as make a run of evenly spread vectors about a block. A run that is wider than two blocks
is compared in full, stretch against stretch in tasks of a bounded size, so a large group of near copies loses nothing to the width of the window.
Equal vectors are one class from the start, so copies cannot fill a block. A vector carries its block and run
of every pass, so that a pair is counted in the first pass that finds it and links never have to be gathered to be told apart.
The more vectors, the more bits a run has, and the more passes are made, so that the chance of missing a pair at the limit stays as it is. Classes are
named by a hash of their vectors, never by an identifier, so rows that share an identifier alone have nothing to do with each other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import Workspace, column, sized_join
from scriptorium.llm.components import connected_components

BITS, SEED = 48, 20
#: So many passes at least, and as many as leave a pair at the limit unfound with this chance at most, if sign bits were all that brings pairs together.
PASSES, MISS = 12, 0.002
#: Vectors in a block, and blocks in a task.
BLOCK, BLOCKS = 512, 8


def bits_of_run(n: int, block: int = BLOCK) -> int:
    """Bits that make a run of ``n`` evenly spread vectors about a block."""
    return min(BITS, max(0, (n - 1) // block).bit_length())


def passes_for(n: int, least: float, block: int = BLOCK) -> int:
    """Passes for ``n`` vectors: two at cosine ``least`` agree in all the bits of a run, in one pass or more, but for a chance of MISS."""
    agree = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** bits_of_run(n, block)
    return PASSES if agree >= 1 else max(PASSES, math.ceil(math.log(MISS) / math.log1p(-agree)))


def projections(dim: int, passes: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, passes * BITS))


def codes(vectors: np.ndarray, passes: int) -> np.ndarray:
    """(n, passes) words of BITS sign bits, first hash most significant."""
    bits = (vectors @ projections(vectors.shape[1], passes) > 0).reshape(len(vectors), passes, BITS)
    return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _encode(passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, digests, words = [], [None] * batch.num_rows, [None] * batch.num_rows
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(batch.column(1).to_pylist()):
                x = None if v is None or None in v else np.array(v, np.float64)
                if x is not None and (not len(x) or not np.isfinite(x).all() or not x.any()):
                    x = None
                vectors.append(None if x is None else x + 0.0)  # -0.0 is 0.0
                if x is not None:
                    digests[i] = hashlib.md5(vectors[i].tobytes(), usedforsecurity=False).digest()
                    by_dim.setdefault(len(x), []).append(i)
            for rows in by_dim.values():
                x = np.stack([vectors[i] for i in rows])
                for i, c in zip(rows, codes(x / np.abs(x).max(1, keepdims=True), passes), strict=True):
                    words[i] = c
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(words, pa.list_(pa.int64())), pa.array(vectors, pa.list_(pa.float64()))], names=["vec_id", "digest", "codes", "vector"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their partition and their place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], names=[*batch.schema.names, "part", "place"])
        at += n


class _Links:
    """Links of a task's vectors, all of one length, in the pass ``now``, counted tile by tile so that no list of pairs is made."""

    def __init__(self, rows: pd.DataFrame, now: int, least: float):
        self.now, self.least = now, least
        self.places, self.runs = np.stack(rows["blocks"].to_list()), np.stack(rows["runs"].to_list())
        self.copies = rows["copies"].to_numpy().astype(np.float64)
        x = np.stack(rows["vector"].to_list())
        self.x = x / np.abs(x).max(1, keepdims=True)  # squares of tiny or huge components stay finite
        self.size = np.sqrt((self.x * self.x).sum(1))
        self.links, self.root = np.zeros(len(rows)), np.arange(len(rows))

    def tile(self, left: np.ndarray, right: np.ndarray) -> None:
        """Compare ``left`` with ``right``, or with itself if it is the same; pairs that an earlier pass compared aren't counted again."""
        if not len(left) or not len(right):
            return
        near = (self.x[left] @ self.x[right].T) / (self.size[left, None] * self.size[right]) >= self.least
        if left is right:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        if not len(i):
            return
        if self.now and 16 * len(i) < near.size:
            one, two = left[i], right[j]
            met = np.zeros(len(i), bool)
            for q in range(self.now):
                met |= (self.runs[one, q] == self.runs[two, q]) | (np.abs(self.places[one, q] - self.places[two, q]) <= 1)
            near[i[met], j[met]] = False
        elif self.now:
            for q in range(self.now):
                near &= self.runs[left, q][:, None] != self.runs[right, q]
                near &= np.abs(self.places[left, q][:, None] - self.places[right, q]) > 1
        if not near.any():
            return
        self.links[left] += near @ self.copies[right]
        self.links[right] += near.T @ self.copies[left]
        while True:  # each round joins every row's root with that of a link outside it
            apart = near & (self.root[left][:, None] != self.root[right])
            i = np.flatnonzero(apart.any(1))
            if not len(i):
                return
            for p, q in {*zip(self.root[left[i]].tolist(), self.root[right[apart[i].argmax(1)]].tolist(), strict=True)}:
                p, q = self._find(p), self._find(q)
                self.root[max(p, q)] = min(p, q)
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            i = self.root[i]
        return i

    def found(self, rows: pd.DataFrame) -> pd.DataFrame:
        ids, some = rows["id"].to_numpy(), np.flatnonzero(self.links)
        return pd.DataFrame({"id": ids[some], "links": self.links[some].astype(np.int64), "other": ids[self.root[some]]})


FOUND = "id bigint, links bigint, other bigint"


def _named(salt: int) -> Column:
    """A class's name: a hash of its vector's digest."""
    return F.xxhash64("digest", F.lit(salt))


def _compare(least: float, blocks_a_task: int):
    """Links of the vectors of some neighbouring blocks: (id, links, other); ``other`` joins each with its root in this task, where it has one."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        now, first = int(key[0]), int(key[1]) * blocks_a_task
        dims, out = rows["vector"].map(len).to_numpy(), []
        for dim in np.unique(dims):
            some = rows[dims == dim].reset_index(drop=True)
            links = _Links(some, now, least)
            at = {b: np.flatnonzero(links.places[:, now] == b) for b in range(first, first + blocks_a_task + 1)}
            for b in range(first, first + blocks_a_task):
                links.tile(at[b], at[b])
                links.tile(at[b], at[b + 1])
            out.append(links.found(some))
        return pd.concat(out, ignore_index=True)

    return run


def _compare_run(least: float, blocks_a_task: int):
    """As ``_compare``, of one or two stretches of blocks of a wide run: the pairs of blocks that aren't neighbours."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        now, one, two = int(key[0]), int(key[3]), int(key[4])
        links = _Links(rows, now, least)
        own = links.places[:, now]
        at = {b: np.flatnonzero(own == b) for b in np.unique(own).tolist()}
        for a in at:
            for b in at:
                if b > a + 1 and a // blocks_a_task == one and b // blocks_a_task == two:
                    links.tile(at[a], at[b])
        return links.found(rows)

    return run


def embedding_components(spark: SparkSession, vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", passes: int | None = None, block: int = BLOCK, blocks_a_task: int = BLOCKS) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Two rows link if the cosine of their vectors, in double precision, is ``least`` or more. n_links counts the other rows linked directly,
    copies included; component_id is the smallest identifier reachable; kept marks its row.
    A vector that is null, empty or zero, or has a null or non-finite component, links with nothing; so do vectors of different lengths
    with each other. Rows that repeat an identifier are rows of their own, and link by their vectors. A null identifier is larger than all others; a component without another has a null name, and its rows
    are kept. No rows: no rows. Other columns aren't read. No pair below ``least`` is linked; a pair is missed if no pass brings it into neighbouring blocks or the same run.
    There are ``passes_for`` passes unless ``passes`` says how many.
    """
    ws = Workspace(spark, "embedding-dedup")
    given = vectors.select(column(vectors, id_col).cast("long").alias("vec_id"), column(vectors, vector_col).cast("array<double>").alias("vector"))
    passes = passes or passes_for(given.count(), least, block)
    base = given.mapInArrow(_encode(passes), "vec_id bigint, digest binary, codes array<bigint>, vector array<double>")
    base = ws.keep(base.withColumn("row", F.monotonically_increasing_id()), "base")
    classes = base.where("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("vec_id").isNull().alias("nameless"), "vec_id", "row")).alias("first"), F.count("*").alias("copies"))
    classes = ws.keep(classes, "digests")
    for salt in count():  # until no two classes have the same name, which is nearly always the first
        name = _named(salt)
        if classes.groupBy(name.alias("id")).count().where("count > 1").isEmpty():
            break
    classes = classes.select("digest", name.alias("id"), "copies", F.col("first.vec_id").alias("vec_id"), F.col("first.row").alias("row"))
    ones = ws.keep(sized_join(base.select("row", "codes", "vector"), classes.drop("vec_id"), "row", "inner").drop("row"), "ones")
    n = ones.count()

    run_bits = bits_of_run(n, block)
    order = ones.select("digest", F.size("vector").alias("dim"), F.posexplode("codes").alias("pass", "code"))
    order = order.select("digest", "pass", "dim", "code", F.shiftright("code", BITS - run_bits).alias("run"), F.xxhash64("pass", "digest").alias("tie"))  # equal codes in another order in each pass
    sort = ["pass", "dim", "code", "tie", "digest"]
    order = order.repartitionByRange(*sort).sortWithinPartitions(*sort).select("digest", "pass", "dim", "run")
    placed = ws.keep(order.mapInArrow(_numbered, "digest binary, pass int, dim int, run bigint, part int, place bigint"), "placed")
    ends = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number for each partition
    begins = dict(zip(sorted(ends), np.cumsum([0, *(ends[p] for p in sorted(ends))]).tolist(), strict=False))
    begin = spark.createDataFrame([*begins.items()], "part int, begin bigint")
    blocks = placed.join(F.broadcast(begin), "part").select("digest", "pass", "dim", "run", F.floor((F.col("begin") + F.col("place") - F.col("pass") * F.lit(n)) / block).cast("int").alias("block"))
    wide = blocks.groupBy("pass", "dim", "run").agg(F.min("block").alias("first"), F.max("block").alias("last")).where("last - first > 1")
    wide = ws.keep(wide, "wide")
    blocks = blocks.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("pass", "block", "run"))).alias("at"))
    blocks = blocks.select("digest", F.col("at.block").alias("blocks"), F.col("at.run").alias("runs"))
    spread = ws.keep(ones.drop("codes").join(blocks, "digest"), "spread")

    held = ["id", "copies", "vector", "blocks", "runs"]
    near = spread.select(*held, F.posexplode("blocks").alias("pass", "block"))
    task = F.floor(F.col("block") / blocks_a_task)
    near = near.select(*held, "pass", F.explode(F.when((F.col("block") % blocks_a_task == 0) & (task > 0), F.array(task, task - 1)).otherwise(F.array(task))).alias("task"))
    found = near.groupBy("pass", "task").applyInPandas(_compare(least, blocks_a_task), FOUND)
    if n_wide := wide.count():
        inside = spread.select(*held, F.size("vector").alias("dim"), F.posexplode("runs").alias("pass", "run"))
        inside = sized_join(inside, wide, ["pass", "dim", "run"], "inner", n_wide)
        own = F.floor(F.get("blocks", F.col("pass")) / blocks_a_task)
        stretches = F.sequence(F.floor(F.col("first") / blocks_a_task), F.floor(F.col("last") / blocks_a_task))
        inside = inside.select(*held, "pass", "dim", "run", own.alias("own"), F.explode(stretches).alias("stretch"))
        inside = inside.select(*held, "pass", "dim", "run", F.least("own", "stretch").alias("one"), F.greatest("own", "stretch").alias("two"))
        found = found.union(inside.groupBy("pass", "dim", "run", "one", "two").applyInPandas(_compare_run(least, blocks_a_task), FOUND))
    found = ws.keep(found, "found")
    ws.drop("placed", "ones", "spread", "wide")

    components = ws.keep(connected_components(spark, found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))), "components")
    members = components.join(classes.select("id", "vec_id"), "id")
    members = members.join(members.groupBy("component_id").agg(F.min("vec_id").alias("least")), "component_id").select("id", "least", F.lit(True).alias("linked"))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(counted, "id", "left").join(members, "id", "left")
    named = named.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("linked"), F.col("least")).otherwise(F.col("vec_id")).alias("component_id"))
    out = base.select("vec_id", "digest").join(named, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
