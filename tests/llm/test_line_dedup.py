import random
import re

import numpy as np

from scriptorium.llm import line_dedup as L


def count(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def brute(rows, least):
    """Every run of ``least`` words or more that occurs before is deleted but for what overlaps its first occurrence."""
    docs = sorted(((d, k, t.split("\n")) for k, (d, t) in enumerate(rows) if t is not None), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    spans = []
    for o, (_, k, lines) in enumerate(docs):
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(map(count, lines[i:j])) >= least:
                    spans.append((o, k, i, tuple(lines[i:j])))
                    break
        for j in range(1, len(lines) + 1):
            for i in range(j - 1, -1, -1):
                if sum(map(count, lines[i:j])) >= least:
                    spans.append((o, k, i, tuple(lines[i:j])))
                    break
    first, gone = {}, {k: set() for k in range(len(rows))}
    for o, k, i, text in sorted(spans, key=lambda x: x[:3]):
        if text not in first:
            first[text] = (k, i)
        elif first[text] != (k, i):
            a = max(i, first[text][1] + len(text)) if first[text][0] == k else i
            gone[k] |= set(range(a, i + len(text)))
    return sorted(((d, 0 if t is None else t.count("\n") + 1, sorted(gone[k])) for k, (d, t) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], list(r["removed"])) for r in df.collect()), key=str)


def test_windows():
    assert L.windows(np.array([3, 0, 3, 10]), 6) == [(0, 3), (1, 3), (2, 2), (3, 1)]
    assert L.windows(np.array([], int), 6) == [] and L.windows(np.array([5]), 6) == []


def test_same_as_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 6))) for _ in range(12)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(2, 9))] for _ in range(4)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice([rng.choice(runs), [rng.choice(pool)], [f"own {i} {rng.random()}"]])
        rows.append((i, "\n".join(lines)))
    rows += [(60, "\n".join(["x y z"] * 9)), (61, rows[5][1]), (62, None), (63, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(L.repeated_lines(spark, df, 8)) == brute(rows, 8)


def test_odd_rows_and_texts(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(L.repeated_lines(spark, odd_docs, 4)) == brute(rows, 4)
    assert L.repeated_lines(spark, odd_docs.limit(0)).count() == 0


def test_lines_are_taken_out(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f"), (2, "x\na b c\nd e f\ny"), (3, None)], "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in L.without_lines(df, L.repeated_lines(spark, df, 6)).collect()}
    assert out == {1: "a b c\nd e f", 2: "x\ny", 3: None}
