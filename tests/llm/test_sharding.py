import threading

import pytest

from scriptorium.llm.common import table_path
from scriptorium.llm.sharding import Conflict, Shard, ShardStore, shard_arrivals


def rows(spark, a, b):
    return spark.range(a, b).selectExpr("id doc_id", "repeat(sha2(cast(id as string), 256), 20) text")


def test_append_compact_read(spark):
    store = ShardStore(spark, table_path(spark, "store"), target=400_000, fan_in=3)
    with pytest.raises(ValueError):
        store.read()
    for k in range(7):
        store.append(rows(spark, k * 300, (k + 1) * 300).coalesce(2))
    before = store.manifest()[1]
    assert len(before) == 14 and store.versions() == [*range(1, 8)]
    assert store.compact() > 7
    version, after, _ = store.manifest()
    assert len(after) < 14 and not store.plan()
    assert sorted(r["doc_id"] for r in store.read().collect()) == [*range(2100)]
    assert store.read(3).count() == 900  # old versions can be read until the vacuum
    store.vacuum()
    assert store.read().count() == 2100
    assert all(s.bytes > 0 and s.since <= version for s in after)


def test_only_similar_sizes_are_merged(spark):
    store = ShardStore(spark, table_path(spark, "store"), target=1 << 20, fan_in=2, ratio=4)
    store.append(rows(spark, 0, 3000).coalesce(1))
    store.append(rows(spark, 3000, 3010).coalesce(1))
    assert store.plan() == []
    store.append(rows(spark, 3010, 3020).coalesce(1))
    (run,) = store.plan()
    assert len(run) == 2 and max(s.bytes for s in run) < 40_000


def test_of_two_writers_one_wins(spark):
    store = ShardStore(spark, table_path(spark, "store"))
    schema = rows(spark, 0, 1).schema
    won, lost = [], []

    def write(k):
        try:
            won.append(ShardStore(spark, store.root).commit(0, [Shard(f"file:/x{k}", 1, 1)], schema))
        except Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won == [1] and len(lost) == 3 and len(store.manifest()[1]) == 1


def test_odd_rows(spark, odd_docs):
    store = shard_arrivals(spark, odd_docs, table_path(spark, "store"))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, odd_docs.collect()))
    empty = shard_arrivals(spark, odd_docs.limit(0), table_path(spark, "store"))
    assert empty.manifest()[0] == 0 or empty.read().count() == 0


def test_a_further_column_widens_the_schema(spark):
    store = ShardStore(spark, table_path(spark, "store"), fan_in=3)
    store.append(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    store.append(spark.createDataFrame([("b", 0.5, 2)], "TEXT string, `the.score` double, doc_id int"))
    store.append(spark.createDataFrame([(3, "c")], "doc_id bigint, text string"))
    want = [(1, "a", None), (2, "b", 0.5), (3, "c", None)]
    assert store.read().columns == ["doc_id", "text", "the.score"] and sorted(map(tuple, store.read().collect())) == want
    store.compact()
    assert len(store.manifest()[1]) < 3 and sorted(map(tuple, store.read().collect())) == want
    assert store.read(1).columns == ["doc_id", "text"]


def test_a_vacuum_leaves_what_another_writer_has_yet_to_commit(spark):
    root = table_path(spark, "store")
    a, b = ShardStore(spark, root, fan_in=2), ShardStore(spark, root, fan_in=2)
    b.append(rows(spark, 0, 10))
    pending = a._write(rows(spark, 10, 20).coalesce(1), 9)  # written, not committed
    b.append(rows(spark, 20, 30))
    b.compact()
    b.vacuum()
    version, shards, schema = a.manifest()
    a.commit(version, shards + pending, schema)
    assert sorted(r["doc_id"] for r in a.read().collect()) == [*range(30)]
    stray = a._write(rows(spark, 30, 40).coalesce(1), 9)
    a.vacuum()
    assert a._fs.exists(a._path(stray[0].path))
    a.vacuum(patience=-1)
    assert not a._fs.exists(a._path(stray[0].path)) and a.read().count() == 30


def test_writers_that_lose_commit_after_the_winner(spark, monkeypatch):
    root = table_path(spark, "store")
    one, other = ShardStore(spark, root, fan_in=2), ShardStore(spark, root)
    one.append(rows(spark, 0, 10).coalesce(1))
    commit, busy = ShardStore.commit, []

    def late(self, base, shards, schema):
        if self is one and len(busy) < 2:
            busy.append(base)
            # the first time another writer brings a further column, the second time more rows
            other.append(rows(spark, 100, 110).coalesce(1).selectExpr("*", "1 extra") if len(busy) == 1 else rows(spark, 200, 210).coalesce(1))
        return commit(self, base, shards, schema)

    monkeypatch.setattr(ShardStore, "commit", late)
    one.append(rows(spark, 10, 20).coalesce(1))
    assert len(busy) == 2 and one.read().columns == ["doc_id", "text", "extra"]
    assert sorted(r["doc_id"] for r in one.read().collect()) == [*range(20), *range(100, 110), *range(200, 210)]
    busy.clear()
    one.compact()
    assert busy and one.read().count() >= 50


def test_two_merges_of_the_same_shards(spark, monkeypatch):
    root = table_path(spark, "store")
    one, other = ShardStore(spark, root, fan_in=2), ShardStore(spark, root, fan_in=2)
    for k in range(3):
        one.append(rows(spark, k * 10, k * 10 + 10).coalesce(1))
    commit, once = ShardStore.commit, []

    def late(self, base, shards, schema):
        if self is one and not once:
            once.append(1)
            other.compact()
        return commit(self, base, shards, schema)

    monkeypatch.setattr(ShardStore, "commit", late)
    one.compact()
    assert sorted(r["doc_id"] for r in one.read().collect()) == [*range(30)]
