"""What the operators of this subpackage share: the shared folder, written tables, joins of a checked size."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many rows of a few numbers each.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``. Where that is unset, a new one if all run in one process (tests), else an error, as a machine's own folder would lose rows."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='scriptorium-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows and bytes of an Arrow batch: what the JVM and a Python worker hold at once, twice over. Set where Spark's own settings stand.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(1 << 20))}


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, whatever their path; once for each context."""
    for key, (usual, own) in ARROW.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, own)
    sc = spark.sparkContext
    if getattr(sc, "_scriptorium_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="scriptorium-code-")) / "scriptorium.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(target))
    sc._scriptorium_shipped = True


def give_back() -> None:
    """At the end of a Python task: free memory goes back to the system, as the worker lives on for other stages."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shrink_heaps(spark: SparkSession) -> None:
    """Between long steps: the executors' JVMs collect their garbage, so that free heap goes back to the system. A heap never shrinks else, and after a large step
    it would stay at its most beside the Python workers of the next. As many tasks as cores, so that every executor has one."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


class Workspace:
    """Tables written in the shared folder to cut lineage: a lost executor costs a read, not the work before it.

    ``keep`` writes and rereads a frame; ``drop`` removes tables that no later step reads. What is left is read by the frame that an operator returns;
    ``clean_up`` removes it once that has been written.
    """

    made: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, table_path(spark, name), {}
        Workspace.made.append((spark, self.root))
        ship_package(spark)

    def path(self, name: str) -> str:
        self.paths[name] = f"{self.root}/{name}-{len(self.paths)}"
        return self.paths[name]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "snappy").parquet(path)  # hashes hardly shrink, and other codecs leave native memory behind
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> None:
    """Remove the tables of all operators that this session has run; frames that they returned can't be read any more."""
    for own, root in Workspace.made:
        if own is spark:
            remove(spark, root)
    Workspace.made = [x for x in Workspace.made if x[0] is not spark]


def sized_join(left: DataFrame, right: DataFrame, on, how: str, rows: int | None = None) -> DataFrame:
    """Join with ``right`` broadcast if it has at most BROADCAST_ROWS rows (counted here unless given), else by shuffle with AQE's skew handling."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right, on, how)


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column is called so (names count without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return df["`" + name.replace("`", "``") + "`"]


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
