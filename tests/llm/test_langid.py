import numpy as np
import pytest

from scriptorium.llm import langid as L


def test_gradients_are_those_of_the_loss():
    net = L.Network(["a", "b", "c"], hidden=3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    tokens = np.ascontiguousarray(np.frombuffer(b" ab  cde x y ", np.uint8)[:12].reshape(3, 4).T)
    labels = np.array([0, 1, 2])

    def loss():
        return -np.log(net.positions(tokens)[:, labels, np.arange(3)]).mean()

    _, grads = net.gradients(tokens, labels)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        flat = v.reshape(-1)
        used = np.flatnonzero(np.abs(grads[k].reshape(-1)) > 1e-4)
        for i in rng.choice(used, min(4, len(used)), replace=False):
            was, eps = flat[i], 1e-3
            flat[i] = was + eps
            up = loss()
            flat[i] = was - eps
            down = loss()
            flat[i] = was
            assert (up - down) / (2 * eps) == pytest.approx(grads[k].reshape(-1)[i], rel=0.05, abs=2e-4), k


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(1)
    parts = {"xx": ["ka", "to", "mi", "ru"], "yy": ["schl", "ein", "ung", "er"], "zz": ["ção", "lhe", "nho", "eira"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(n))
    return [(i, make(lang, int(rng.integers(1, 40))), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 60)]


def test_held_out_accuracy(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id bigint, text string, lang string")
    net = L.fit(df, steps=150)
    assert net.langs == ["xx", "yy", "zz"]
    rows = L.identify(spark, df, net).where("crc32(cast(doc_id as string)) % 3 = 1").collect()
    assert len(rows) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_rows_and_other_columns_decide_nothing(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id bigint, text string, lang string")
    flipped = df.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 3 = 1, 'qq', lang) lang")
    a, b = L.fit(df, steps=5), L.fit(flipped, steps=5)
    assert a.langs == b.langs and all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_odd_rows(spark, odd_docs):
    net = L.fit(odd_docs, steps=5)
    out = L.identify(spark, odd_docs, net)
    assert out.columns == [*odd_docs.columns, "lang_pred_", "score_"]
    rows = out.collect()
    und = sorted(str(r["doc_id"]) for r in rows if r["lang_pred_"] == "und")
    assert len(rows) == 11 and und == ["3", "4", "5", "8", "8"]
    assert all((r["score_"] == 0) == (r["lang_pred_"] == "und") for r in rows)
    empty = odd_docs.limit(0)
    assert L.fit(empty).langs == [] and L.identify(spark, empty, L.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in L.identify(spark, odd_docs, L.Network([]), keep=["doc_id"]).collect()} == {"und"}


def test_numerals_are_no_letters(spark):
    df = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ ١٢ 3"), (3, "ª"), (4, "語"), (5, "½ ² x")], "doc_id bigint, text string")
    net = L.Network(["a", "b"])
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in L.identify(spark, df, net).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_a_text_is_read_the_same_whatever_is_read_with_it(monkeypatch):
    net = L.Network(["a", "b"])
    texts = [b"ab cd", "Straße über".encode() * 60, b"1 2", None, ("語" * 500).encode(), b"cd " * 400]
    together = L.predict(net, texts)
    assert together == [L.predict(net, [t])[0] for t in texts]
    monkeypatch.setattr(L, "CELLS", 1)
    assert together == L.predict(net, texts)


def test_every_position_counts_once_and_windows_end_between_characters():
    net, text = L.Network(["a", "b", "c"]), L.folded("Ünï 語 cödé 12 -- und so wéiter ".encode() * 40)
    sums = L.window_sums(net, [text, text[:0], text[:7]], core=16, context=4)
    assert sums[:, -1].tolist() == [len(text), 0, 7]
    assert np.allclose(sums[:, :-1].sum(1), sums[:, -1], rtol=1e-5)
    whole = net.positions(np.concatenate([np.full(16, 32, np.uint8), text[:150], np.full(16, 32, np.uint8)])[:, None])[16:-16, :, 0].sum(0)
    assert np.allclose(L.window_sums(net, [text[:150]])[0, :-1], whole, rtol=1e-4)


def test_long_training_texts_are_read_whole(spark):
    rows = [(i, "x" * 30_000 + (" abc" if i % 2 else " def"), "ab"[i % 2]) for i in range(40)]
    net = L.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), steps=1)
    assert net.langs == ["a", "b"]
    few = L.fit(spark.createDataFrame([(i, "abc", f"l{i % 30:02}") for i in range(300)], "doc_id bigint, text string, lang string"), train_all=30, steps=1)
    assert len(few.langs) == 30  # no language is left out, whatever their number
