import re

import numpy as np
import pandas as pd
import pytest

from scriptorium.llm import mixing as M


def test_raked_marginals_are_the_targets():
    rng = np.random.default_rng(0)
    cells = pd.DataFrame([(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(1, 1000))) for a in range(5) for b in range(3) for c in range(2)], columns=[*M.DIMENSIONS, "tokens"])
    targets = {"source": {f"s{i}": w for i, w in enumerate([1, 2, 3, 4, 5])}, "language": {"l0": 0.2, "l1": 0.3, "l2": 0.5}, "topic": {"t0": 3, "t1": 1}}
    w = M.rake(cells, targets)
    for d, wanted in targets.items():
        got = pd.Series(w).groupby(cells[d]).sum()
        assert np.allclose(got, [wanted[k] / sum(wanted.values()) for k in got.index])
    # odds ratios stay those of the tokens
    x, y = w.reshape(5, 3, 2), cells["tokens"].to_numpy().reshape(5, 3, 2)
    ratio = lambda m: m[0, 0, 0] * m[1, 1, 0] / m[0, 1, 0] / m[1, 0, 0]
    assert ratio(x) == pytest.approx(ratio(y))


def test_unreachable_targets_and_empty_cells():
    cells = pd.DataFrame([("a", "x", "t", 5), ("b", "x", "t", 0)], columns=[*M.DIMENSIONS, "tokens"])
    w = M.rake(cells, {"source": {"a": 0.5, "b": 0.5, "c": 1.0}})
    assert w.tolist() == [1.0, 0.0]
    assert M.rake(cells.assign(tokens=0), {"source": {"a": 1.0}}).tolist() == [0, 0]


def test_probabilities_meet_the_share():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.5, 0.9, 1.0):
        w, n = rng.random(50), rng.integers(1, 100, 50).astype(float)
        p = M.calibrate(w / w.sum(), n, share)
        assert (0 <= p).all() and (p <= 1).all() and (p * n).sum() == pytest.approx(share * n.sum())
        low = p < 1
        assert np.allclose(p[low] * n[low] / w[low], (p[low] * n[low] / w[low])[0]) if low.any() else True


def mixed_rows(n=1500):
    rng = np.random.default_rng(2)
    fields = {"sea": ["ship", "wave", "salt", "port", "sail"], "law": ["court", "judge", "claim", "oath", "bail"]}
    out = []
    for i in range(n):
        own = rng.choice(["sea", "law"], p=[0.8, 0.2])
        text = " ".join(rng.choice([*fields[own], "the", "of"], int(rng.integers(0, 60))))
        out.append((i, text, str(rng.choice(["en", "de"], p=[0.8, 0.2])), str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1])), own))
    return out


def expected(rows, share):
    """Each row's weight and probability from (source, language, topic, tokens), by plain loops."""
    cells, total = {}, sum(r[3] for r in rows)
    for s, lang, t, n in rows:
        cells[s, lang, t] = cells.get((s, lang, t), 0) + n
    goals = []
    for d in range(3):
        sums = {}
        for k, n in cells.items():
            sums[k[d]] = sums.get(k[d], 0) + n
        g = {k: (n / total) ** M.TEMPER for k, n in sums.items() if n}
        goals.append({k: v / sum(g.values()) for k, v in g.items()})
    w = {k: n / total for k, n in cells.items()}
    for _ in range(3000):
        for d in range(3):
            now = {}
            for k, v in w.items():
                now[k[d]] = now.get(k[d], 0) + v
            w = {k: v * goals[d].get(k[d], 0) / now[k[d]] if now[k[d]] else 0.0 for k, v in w.items()}
    low, high = 0.0, 1e12  # the scale, by bisection of the expected tokens
    p = lambda k, c: min(1.0, c * w[k] / cells[k]) if cells[k] else 0.0
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(p(k, mid) * cells[k] for k in cells) < share * total else (low, mid)
    return [(w[r[:3]], p(r[:3], high)) for r in rows]


@pytest.mark.parametrize("most", [200_000, 3])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(M, "MOST_CELLS", most)
    rows = mixed_rows()
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, lang string, source string").repartition(6)
    out = M.mix_sources(spark, df, share=0.5).toPandas().sort_values("doc_id")
    assert (out["tokens"] == [len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows]).all()
    want = np.array(expected([*zip(out["source"], out["lang"], out["topic"], out["tokens"], strict=True)], 0.5))
    assert np.allclose(out["weight"], want[:, 0], atol=1e-7) and np.allclose(out["probability"], want[:, 1], atol=1e-5)
    kept = out[out["sampled"]]
    assert kept["tokens"].sum() == pytest.approx(0.5 * out["tokens"].sum(), rel=0.08)
    if most > 3:
        again = M.mix_sources(spark, df.repartition(3), share=0.5).toPandas().sort_values("doc_id")
        assert (again["sampled"].to_numpy() == out["sampled"].to_numpy()).all()


def test_given_targets_as_a_table(spark, monkeypatch):
    rows = mixed_rows(400)
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, lang string, source string")
    targets = {"source": {"a": 1.0, "b": 1.0, "missing": 3.0}, "language": {"en": 0.4, "de": 0.6}}
    model = M.topics.fit(df, "doc_id", "text", "lang")
    few = M.mix_sources(spark, df, targets, 0.3, model=model).toPandas().sort_values("doc_id")
    monkeypatch.setattr(M, "MOST_CELLS", 2)
    many = M.mix_sources(spark, df, targets, 0.3, model=model).toPandas().sort_values("doc_id")
    assert np.allclose(few["weight"], many["weight"], atol=1e-8) and np.allclose(few["probability"], many["probability"], atol=1e-8)


def test_topics_part_what_differs_within_a_language(spark):
    rows = [r for r in mixed_rows(600) if len(r[1].split()) > 8]
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, lang string, source string")
    model = M.topics.fit(df, "doc_id", "text", "lang", k=2)
    from scriptorium.llm.shingles import word_hashes

    said = [model(word_hashes(r[1].encode()), r[2]) for r in rows]
    pairs = {(a, r[4]) for a, r in zip(said, rows, strict=True)}
    right = max(sum((a == "t0") == (r[4] == f) for a, r in zip(said, rows, strict=True)) for f in ("sea", "law"))
    assert right >= 0.9 * len(rows), pairs
    assert model(word_hashes(b""), "en") == "none" and M.topics.fit(df.limit(0), "doc_id", "text", "lang")(word_hashes(b"x"), "en") == "none"


def test_odd_rows(spark, odd_docs):
    out = M.mix_sources(spark, odd_docs)
    assert out.columns[: len(odd_docs.columns)] == odd_docs.columns and out.columns[-5:] == ["topic_", "tokens_", "weight", "probability", "sampled_"]
    assert out.count() == 11 and {(r["tokens_"], r["topic_"]) for r in out.where("doc_id in (3, 4, 5)").collect()} == {(0, "none")}
    assert M.mix_sources(spark, odd_docs.limit(0)).count() == 0


def test_topics_are_fitted_to_all_documents(spark):
    """Rarity, means and centres don't hang on the few documents that the centres begin with."""
    df = spark.createDataFrame([r[:4] for r in mixed_rows(600)], "doc_id int, text string, lang string, source string")
    few, all_of = (M.topics.fit(df.repartition(n), "doc_id", "text", "lang", sample=s, k=2) for n, s in ((3, 40), (7, 600)))
    assert np.array_equal(few.rare, all_of.rare) and all(np.array_equal(few.means[k], all_of.means[k]) for k in ("de", "en"))
    cosine = few.centres @ all_of.centres.T
    assert cosine.max(1).min() > 0.99 and cosine.max(0).min() > 0.99


def test_no_document_is_picked_for_the_centres(spark, monkeypatch):
    """Texts are hashed once, sorted and collected never; a table's topics are those of the model on each text, however rows are dealt."""
    rows = mixed_rows(300)
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, lang string, source string")
    monkeypatch.setattr(type(df), "collect", lambda *_: pytest.fail("rows of documents are collected"))
    model = M.topics.fit(df.repartition(5), "doc_id", "text", "lang")
    again = M.topics.fit(df.repartition(2), "doc_id", "text", "lang")
    assert np.array_equal(model.centres, again.centres)
    monkeypatch.undo()
    out = M.mix_sources(spark, df.repartition(3)).toPandas().sort_values("doc_id")
    from scriptorium.llm.shingles import word_hashes

    assert out["topic"].tolist() == [model(word_hashes(r[1].encode()), r[2]) for r in rows]


def test_a_round_sends_a_row_for_each_bucket(spark):
    """The sums of a round are those of plain loops, and a task sends a row a bucket with all centres, not one for each centre, language and bucket."""
    T = M.topics
    rows = [(lang, *T.buckets(np.arange(i, 5 * i, 3, dtype=np.uint64) ** 2)) for i in range(200) for lang in ("de", "en", "")]
    rng = np.random.default_rng(4)
    rare, means = rng.random(T.BUCKETS), {k: rng.random(T.BUCKETS) / 40 for k in ("", "de", "en", "fr")}
    centres = rng.standard_normal((3, T.BUCKETS))
    want = np.zeros_like(centres)
    for lang, at, n in rows:
        if at:
            x = np.zeros(T.BUCKETS)
            x[np.frombuffer(at, np.int16)] = np.sqrt(np.frombuffer(n, np.int32))
            x *= rare
            x = x / np.linalg.norm(x) - means[lang]
            want[(centres @ x).argmax()] += x / np.linalg.norm(x)
    df = spark.createDataFrame(rows, "language string, at binary, n binary").repartition(3)
    found = df.mapInArrow(T._directions(rare, means), "language int, over double, at binary, x binary")
    assert np.allclose(T._sums(found, centres, np.array([*means.values()])), want, atol=1e-4)
    sent = []
    whole = type(df).mapInArrow

    def counted(self, f, schema):
        out = whole(self, f, schema)
        sent.append((out.count(), schema))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(df), "mapInArrow", counted)
        T.fit_vectors(df, 3)
    rounds = [n for n, schema in sent if "string" not in schema and "binary" not in schema]
    assert rounds and max(rounds) <= 3 * (T.BUCKETS + len(means))
