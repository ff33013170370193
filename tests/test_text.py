"""String scalars on small cases with known answers."""

import uuid

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_normalized(spark):
    assert one(spark, T.normalized, "é di­vided ofﬁce ﬅop") == "é divided office stop"
    once = one(spark, T.normalized, "ﬃx­")
    assert one(spark, T.normalized, once) == once == "ffix"


@pytest.mark.parametrize(("text", "lang", "key"), [("İSTANBUL", "tr", "istanbul"), ("ISPARTA", "tr", "ısparta"), ("ISPARTA", "en", "isparta"), ("Straße", "de", "straße")])
def test_fold_key(spark, text, lang, key):
    assert one(spark, T.fold_key, text, lang) == key


def test_distances(spark):
    assert one(spark, T.normalised_edit_distance, "abc", "abd") == pytest.approx(1 / 3)
    assert one(spark, T.normalised_edit_distance, "", "") == 0
    assert one(spark, T.ned, "pipe-\nline  x", "pipeline x") == 0
    assert one(spark, T.cer, "", "a") == 1 and one(spark, T.cer, "", "") == 0 and one(spark, T.cer, "ab", "abcdef") == 2


@pytest.mark.parametrize(("text", "value"), [("iv", 4), ("XIV", 14), ("MCMXCIX", 1999), ("abc", None), ("iiiiiiiii", None), ("IIII", 4), ("", None)])
def test_roman_value(spark, text, value):
    assert one(spark, T.roman_value, text) == value


@pytest.mark.parametrize(("text", "value"), [("12.", 12), ("XIV", 14), ("IIII", None), ("Mix", None), ("vx", None), ("0", None), ("1984", None), ("(iv)", 4)])
def test_numeral(spark, text, value):
    assert one(spark, T.numeral, text) == value


@pytest.mark.parametrize(
    ("text", "want"),
    [("Chapter 3: Home", ("chapter", "3", 1)), ("Anhang A", ("appendix", "A", 1)), ("Bölüm II", ("chapter", "II", 1)), ("Chapter of Accidents", None), ("1.2.3 Method", ("decimal", "1.2.3", 3)), ("IV. Title", ("roman", "IV", 1)), ("Teil Zwei", ("part", "Zwei", 1)), ("Prose here", None), ("", None)],
)
def test_heading_numbering(spark, text, want):
    got = one(spark, T.heading_numbering, text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("1. first", ("decimal", "1.", 1)), ("12) x", ("decimal", "12)", 12)), ("a. x", ("alpha", "a.", 1)), ("iv. x", ("roman", "iv.", 4)), ("• A", ("bullet", "•", None)), ("•A", None), ("1984 was", None), ("—said the clerk", None), ("", None)],
)
def test_list_marker(spark, text, want):
    got = one(spark, T.list_marker, text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("text", "title", "folio", "value"), [("Teşekkür ........ 11", "Teşekkür", "11", 11), ("Preface xii", "Preface", "xii", 12), ("Method.....12", "Method", "12", 12), ("12", "12", None, None), ("No number", "No number", None, None)])
def test_split_folio(spark, text, title, folio, value):
    got = one(spark, T.split_folio, text)
    assert (got["title"], got["folio"], got["value"]) == (title, folio, value)


@pytest.mark.parametrize(("last", "first", "want"), [("in the middle of a", "sentence, and", True), ("the end.”", "then", False), ("open", "New", False), ("open", "漢字", True), ("", "x", False)])
def test_runs_on(spark, last, first, want):
    assert one(spark, T.runs_on, last, first) is want


def test_small_predicates(spark):
    yes = lambda f, *v: one(spark, f, *v) is True
    assert yes(T.legible, "1.") and yes(T.legible, "Intro") and not yes(T.legible, "x.....") and not yes(T.legible, " ")
    assert yes(T.ends_mid_sentence, "so,") and not yes(T.ends_mid_sentence, "so.")
    assert yes(T.starts_with_caption_prefix, "Fig.3 x") and yes(T.starts_with_caption_prefix, "Şekil 3") and yes(T.starts_with_caption_prefix, "Table IV") and not yes(T.starts_with_caption_prefix, "Table manners")
    assert yes(T.is_boilerplate, "Untitled 3") and yes(T.is_boilerplate, "a.docx") and yes(T.is_boilerplate, "Document1") and not yes(T.is_boilerplate, "Untitledness") and yes(T.is_boilerplate, " ")
    assert yes(T.has_isbn, "isbn here") and yes(T.has_isbn, "no 978-3-16-148410-0 x") and not yes(T.has_isbn, "123")
    assert yes(T.ends_with_attribution, "text — Jane Doe") and not yes(T.ends_with_attribution, "text — she said so and left early") and not yes(T.ends_with_attribution, "a — b")
    assert yes(T.looks_like_a_misread_numeral, "X1I") and not yes(T.looks_like_a_misread_numeral, "abc")


def test_keys_and_names(spark):
    assert one(spark, T.mask, "Page 12, Part 3") == "Page#Part#"
    assert one(spark, T.numeric_value, " 1 2. ") == 12 and one(spark, T.numeric_value, "xiv") == 14 and one(spark, T.numeric_value, "x9") is None
    assert one(spark, T.family_key, "ABCDEF+Minion-BoldItalic") == "minion" and one(spark, T.family_key, "Minion-Regular") == "minion"
    assert one(spark, T.strip_numbering, "1. Turing's Brains") == "Turing's Brains" and one(spark, T.strip_numbering, "IV") == "IV"
    assert one(spark, T.title_from_filename, "a/My_book-one.pdf") == "My book one"
    assert one(spark, T.squash_key, "A b-C 1!") == "abc1" and one(spark, T.primary, "en-GB") == "en"
    sha = "ab" * 32
    assert one(spark, T.identifier, sha) == f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, sha)}"
    assert one(spark, T.xml_text, "a<b>&\"") == "a&lt;b&gt;&amp;&quot;"
    with pytest.raises(Exception, match="illegal XML"):
        one(spark, T.xml_text, "a\x01")
    df = spark.createDataFrame([("12 | Title", False), ("Title 12", False), ("Title 12", True), ("12", True)], "t string, s boolean")
    assert [r["x"] for r in df.select(T.number_at_an_end(F.col("t"), F.col("s")).alias("x")).collect()] == [12, None, 12, None]
    got = df.limit(1).select(T.tokens_of(F.lit("Ab x �q 12 wörter!")).alias("x")).first()["x"]
    assert [(k, w) for k, w in got] == [("word", "ab"), ("other", ""), ("undecodable", ""), ("other", ""), ("word", "wörter")]
