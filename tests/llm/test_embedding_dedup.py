import numpy as np

from scriptorium.llm import embedding_dedup as E


def brute(rows, least=0.95):
    x = [None if v is None or None in v or not np.isfinite(v).all() or not np.any(v) else np.array(v, float) for _, v in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            low[find(i)] = min(low.get(find(i), v), v)
    return sorted(((v, links[i], low.get(find(i)), v == low.get(find(i))) for i, (v, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_same_as_brute_force_with_small_blocks(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0, 0.02, 0.15])).tolist()))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    want, have = brute(rows), got(E.embedding_components(spark, df, block=24, blocks_a_task=2))
    missed = sum(a[1] for a in want) - sum(b[1] for b in have)
    assert 0 <= missed <= 0.01 * sum(a[1] for a in want) and all(b[1] <= a[1] for a, b in zip(want, have, strict=True))
    assert got(E.embedding_components(spark, df, block=1024)) == want


def test_copies_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [2.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [inf, 1.0]), (10, [None, 1.0]), (11, []), (12, [0.0, 1.0, 0.0]), (None, [0.0, -1.0]), (13, [1e-300, 0.0]), (14, [1e300, 1e299])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, digest string")
    want = sorted([(5, 5, 2, False), (2, 5, 2, True), (9, 5, 2, False), (3, 5, 2, False), (13, 5, 2, False), (14, 5, 2, False), *((i, 0, i, True) for i in (4, 6, 7, 8, 10, 11, 12)), (None, 0, None, True)], key=str)
    assert got(E.embedding_components(spark, df)) == want
    assert E.embedding_components(spark, df.limit(0)).count() == 0


def test_a_large_group_of_equal_vectors(spark):
    df = spark.range(3000).selectExpr("id vec_id", "if(id < 2000, array(1f, 2f, 3f), array(cast(id as float), -1f, cast(id % 7 as float))) embedding")
    rows = {r["vec_id"]: r for r in E.embedding_components(spark, df, block=64).collect()}
    assert all(rows[i]["n_links"] == 1999 and rows[i]["component_id"] == 0 for i in range(2000))


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=32)
    x = np.concatenate([base + rng.normal(size=(1500, 32)) * 0.15, base * rng.uniform(1, 2, (500, 1)), rng.normal(size=(1000, 32))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(5)
    have = np.array([r["n_links"] for r in E.embedding_components(spark, df, block=64, blocks_a_task=4).orderBy("vec_id").collect()])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum() and (have[1500:2000] >= 499).all()


def test_rows_that_share_an_identifier_alone_are_apart(spark):
    x, x2, y, y2 = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0], [0.0, 0.1, 1.0]
    rows = [(0, x2), (1, x), (1, y), (5, y2), (None, y), (None, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = [(0, 1, 0, True), (1, 1, 0, False), (1, 2, 1, True), (5, 2, 1, False), (None, 2, 1, False), (None, 0, None, True)]
    assert got(E.embedding_components(spark, df)) == sorted(want, key=str)


def test_passes_grow_with_the_table():
    assert [E.passes_for(n, 0.95) for n in (0, 500, 10**4, 10**6, 10**9)] == sorted(E.passes_for(n, 0.95) for n in (0, 500, 10**4, 10**6, 10**9))
    for n in (10**4, 10**6, 10**9):
        agree = (1 - np.arccos(0.95) / np.pi) ** E.bits_of_run(n)
        assert (1 - agree) ** E.passes_for(n, 0.95) <= E.MISS
