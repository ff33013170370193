"""Shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable shards. Shards of similar size form a tier; when a tier has enough of them
they are merged into files of the target size. Every change is a new manifest version, committed by
an exclusive rename to a name that must not exist yet: readers see a version or not at all, and of two writers one wins; the other looks at the
new version and commits after it. The file system's rename has to be atomic and to refuse a name that is taken, as HDFS and local ones do; on an
object store the manifest folder belongs on one that is.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import Workspace, remove, table_path


@dataclass(frozen=True)
class Shard:
    """A file that never changes; ``since`` is the version that added it."""

    path: str
    bytes: int
    since: int


class Conflict(Exception):
    """Another writer has committed the version."""


class ShardStore:
    """A set of shards under ``root``, a folder that the driver and all executors see.

    ``target`` is the size of merged files; ``fan_in`` shards of a tier are merged; sizes of a tier are within a factor ``ratio``.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = 256 << 20, fan_in: int = 4, ratio: int = 4):
        self.spark, self.root, self.target, self.fan_in, self.ratio = spark, root.rstrip("/"), target, fan_in, ratio
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list:
        path = self._path(folder)
        return [*self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for f in self._list(f"{self.root}/manifest") if (n := f.getPath().getName()).startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], T.StructType | None]:
        """The version (the last, unless given), its shards and the rows' schema. Version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, [], None
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:09d}.json"))
        try:
            said = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return version, [Shard(**s) for s in said["shards"]], T.StructType.fromJson(said["schema"])

    def commit(self, base: int, shards: list[Shard], schema: T.StructType) -> int:
        """Make ``shards`` version base + 1; Conflict if that exists. The manifest is complete before it gets its name."""
        version = base + 1
        name = f"{self.root}/manifest/v{version:09d}.json"
        temp = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, self._path(name), options)  # fails if the name is taken
        except Exception as e:
            self._fs.delete(temp, False)
            if version in self.versions():
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _write(self, df: DataFrame, version: int) -> list[Shard]:
        folder = f"{self.root}/data/{version:09d}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").parquet(folder)
        return [Shard(f.getPath().toString(), f.getLen(), version) for f in self._list(folder) if f.getPath().getName().startswith("part-")]

    @staticmethod
    def _widened(schema: T.StructType | None, df: DataFrame) -> tuple[T.StructType, DataFrame]:
        """The schema with the columns that only ``df`` has, nullable, and ``df`` in that schema."""
        if schema is None or schema == df.schema:
            return df.schema, df
        known, given = {f.name.lower() for f in schema.fields}, {f.name.lower() for f in df.schema.fields}
        schema = T.StructType([*schema.fields, *(T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name.lower() not in known)])
        lacks = {f.name for f in schema.fields if f.nullable and f.name.lower() not in given}
        return schema, df.select(*[(F.lit(None) if f.name in lacks else df["`" + f.name.replace("`", "``") + "`"]).cast(f.dataType).alias(f.name) for f in schema.fields])

    def append(self, df: DataFrame) -> int:
        """The rows of ``df`` as new shards, a file for each of its partitions; no rows: no new version.

        Columns are matched by name, in any case. A column that the store doesn't know widens its schema, with null in the rows before; a
        nullable column that ``df`` lacks is null, and the lack of another is an error. If another writer commits first, the shards are committed after its version, and
        written anew only if that changed the schema.
        """
        written, new = None, []
        while True:
            version, shards, schema = self.manifest()
            schema, rows = self._widened(schema, df)
            if written != schema:
                self._discard(new)
                written, new = schema, self._write(rows, version + 1)
            if not new:
                return version
            try:
                return self.commit(version, shards + new, schema)
            except Conflict:
                continue

    def _discard(self, shards: list[Shard]) -> None:
        for folder in {s.path.rpartition("/")[0] for s in shards}:
            remove(self.spark, folder)

    def tier(self, shard: Shard) -> int:
        return int(math.log(max(1, shard.bytes), self.ratio))

    def plan(self) -> list[list[Shard]]:
        """Runs to merge: the shards of each tier that has fan_in or more, smallest tier first. Files of half the target or more are done."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.manifest()[1]:
            if 2 * s.bytes < self.target:
                tiers.setdefault(self.tier(s), []).append(s)
        return [sorted(tiers[t], key=lambda s: (s.since, s.path)) for t in sorted(tiers) if len(tiers[t]) >= self.fan_in]

    def compact(self) -> int:
        """Merge until no tier has fan_in shards; each merge is a version. Rows are concatenated, not shuffled. What another writer commits meanwhile stays; if it has merged the same shards,
        this merge is dropped."""
        while runs := self.plan():
            version, _, schema = self.manifest()
            gone = {s.path for s in runs[0]}
            size = sum(s.bytes for s in runs[0])
            merged = self.spark.read.schema(schema).option("maxPartitionBytes", str(self.target)).parquet(*sorted(gone))
            # merged files are fewer than the shards that they come from, so that this ends
            files = min(max(1, round(size / self.target)), max(1, len(gone) // 2))
            new = self._write(merged.coalesce(files), version + 1)
            while True:
                version, shards, schema = self.manifest()
                if not gone <= {s.path for s in shards}:
                    self._discard(new)
                    break
                try:
                    self.commit(version, [s for s in shards if s.path not in gone] + new, schema)
                    break
                except Conflict:
                    continue
        return self.manifest()[0]

    def vacuum(self, keep: int = 1, patience: float = 24 * 3600) -> None:
        """Delete files that only versions before the last ``keep`` name, and those that no version names once they haven't been touched for ``patience`` seconds: until then they may be
        those of a writer that has yet to commit. Manifests stay, so that a version's number is never given twice."""
        versions = self.versions()
        live = {s.path for v in versions[-keep:] for s in self.manifest(v)[1]}
        old = {s.path.rpartition("/")[0] for v in versions[:-keep] for s in self.manifest(v)[1]}
        for folder in self._list(f"{self.root}/data"):
            path = folder.getPath().toString()
            files = self._list(path)
            if any(f.getPath().toString() in live for f in files):
                continue
            touched = max([folder.getModificationTime(), *(f.getModificationTime() for f in files)]) / 1000
            if path in old or time.time() - touched > patience:
                remove(self.spark, path)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; None of an empty store can be read."""
        _, shards, schema = self.manifest(version)
        if schema is None:
            raise ValueError("an empty store has no schema")
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards])


#: The query's arrivals, and the size of its merged files.
ARRIVALS, TARGET = 4, 64 << 20


def shard_arrivals(spark: SparkSession, rows: DataFrame, root: str, arrivals: int = ARRIVALS, target: int = TARGET) -> ShardStore:
    """A store that took ``rows`` in so many arrivals (dealt by a hash of the whole row), compacted after each, and without superseded files.

    Every row is in one shard, repeated rows as often as they occur, nulls and columns of any name as they are. No rows: one empty shard at most, with the schema.
    """
    store = ShardStore(spark, root, target)
    names = ["`" + c.replace("`", "``") + "`" for c in rows.columns]
    for k in range(arrivals):
        store.append(rows.where(F.pmod(F.xxhash64(*names), F.lit(arrivals)) == k))
        store.compact()
        store.vacuum()
    return store


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    Workspace(spark, "sharding")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = shard_arrivals(spark, docs, table_path(spark, "shards"))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP8_SQL = "select doc_id, lang, source, n_chars, cast(strlen(text) as bigint) as n_bytes, sha256(text) as text_sha256 from documents"
