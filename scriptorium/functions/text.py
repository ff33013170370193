"""String scalars as Column expressions: whole-stage code, no Python but for Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Word lists, marks and namespaces that results depend on.
PART_WORDS = ["part", "teil", "kisim", "kısım"]
CHAPTER_WORDS = ["chapter", "kapitel", "abschnitt", "bolum", "bölüm"]
APPENDIX_WORDS = ["appendix", "anhang", "ek"]
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eins", "zwei", "drei", "vier", "funf", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "bir", "iki", "uc", "üç", "dort", "dört", "bes", "beş", "alti"]
CAPTION_WORDS = ["fig", "figure", "table", "plate", "listing", "chart", "scheme", "abb", "abbildung", "tabelle", "tab", "tafel", "sekil", "şekil", "tablo", "resim", "cizelge"]
STYLE_SUFFIXES = "regular|bold|italic|oblique|light|medium|semibold|book|roman|black"
FILE_EXTENSIONS = "doc|docx|indd|pages|ppt|pptx|pdf|rtf|odt"
TERMINALS = ".!?…。！？؟"
CLOSERS = "\"'”’»«)\\]}」"
BULLETS = "•·–—*‣▪◦"
LEADERS = ".·…_\\-‧•"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


@pandas_udf(StringType())
def nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFD", s))


def expand_ligatures(text: Column) -> Column:
    for one, more in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(more))
    return text


def normalized(text: Column) -> Column:
    """Composed, without soft hyphens, ligatures expanded; idempotent. Never folds case or compatibility forms."""
    return nfc(expand_ligatures(F.replace(nfc(text), F.lit("­"), F.lit(""))))


def fold_key(text: Column, lang: Column | None = None) -> Column:
    """Lower case for look-ups; Turkish and Azeri have dotted and dotless i."""
    plain = F.lower(F.replace(text, F.lit("İ"), F.lit("i̇")))
    if lang is None:
        return plain
    return F.when(F.substring_index(lang, "-", 1).isin("tr", "az"), F.lower(F.translate(text, "İI", "iı"))).otherwise(plain)


def squash_key(text: Column, lang: Column | None = None) -> Column:
    return F.regexp_replace(fold_key(text, lang), r"[^\p{L}\p{N}]", "")


def normalised_edit_distance(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def compare_form(text: Column) -> Column:
    """What error rates compare: ligatures expanded, a hyphen before a newline dropped, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(expand_ligatures(text), "-\n", ""), r"\s+", " "))


def ned(truth: Column, said: Column) -> Column:
    return normalised_edit_distance(compare_form(truth), compare_form(said))


def cer(truth: Column, said: Column) -> Column:
    """Edits over the truth's length, not capped; for an empty truth 0 or 1."""
    a, b = compare_form(truth), compare_form(said)
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(a))


def text_score(truth: Column, said: Column) -> Column:
    return F.lit(1.0) - ned(truth, said)


def is_roman(text: Column) -> Column:
    return F.rlike(text, F.lit("^(?i)[ivxlcdm]{1,8}$"))


def roman_value(text: Column) -> Column:
    """The signed sum of a roman numeral's digits; null for other text or a negative sum."""
    value = F.transform(
        F.split(F.lower(text), ""),
        lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50).when(c == "c", 100).when(c == "d", 500).when(c == "m", 1000).otherwise(0),
    )
    # the digit after each, 0 after the last
    after = F.concat(F.slice(value, F.lit(2), F.greatest(F.size(value) - 1, F.lit(0))), F.array(F.lit(0)))
    total = F.aggregate(F.zip_with(value, after, lambda x, y: F.when(x < y, -x).otherwise(x)), F.lit(0), lambda s, x: s + x)
    return F.when(is_roman(text) & (total >= 0), total)


def to_roman(value: Column) -> Column:
    """The canonical numeral of 1 to 3999."""
    digit = lambda at: F.floor(value / at) % 10
    names = lambda *x: F.array(*map(F.lit, x))
    return F.concat(
        F.repeat(F.lit("M"), F.floor(value / 1000).cast("int")),
        F.element_at(names("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), (digit(100) + 1).cast("int")),
        F.element_at(names("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), (digit(10) + 1).cast("int")),
        F.element_at(names("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), (digit(1) + 1).cast("int")),
    )


def numeral(token: Column) -> Column:
    """Up to three digits over 0, or a roman numeral in one case that is spelt canonically."""
    bare = F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    number = F.when(F.rlike(bare, F.lit("^[0-9]{1,3}$")), bare.cast("int"))
    value = roman_value(bare)
    cased = F.rlike(bare, F.lit("^([A-Z]+|[a-z]+)$"))
    return F.when(number > 0, number).when(cased & (value > 0) & (value < 4000) & (F.lower(to_roman(value)) == F.lower(bare)), value)


def looks_like_a_misread_numeral(token: Column) -> Column:
    bare = F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.rlike(bare, F.lit("^[IVXLCivxl1]{1,6}$")) & F.rlike(bare, F.lit("[A-Z1]"))


def decimal_level(head: Column) -> Column:
    """1 to 6: how many numbers a dotted number has; null for other text."""
    return F.when(F.rlike(head, F.lit(r"^\.*[0-9]+(\.+[0-9]+)*\.*$")), F.least(F.size(F.filter(F.split(head, r"\."), lambda p: p != "")), F.lit(6)))


def heading_numbering(text: Column, lang: Column | None = None) -> Column:
    """struct(kind, value, level) of a heading's numbering, or null. Words before a number come first, then dotted numbers, then roman ones."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    first, second = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))
    key = fold_key(F.regexp_replace(first, "[:.]+$", ""), lang)
    kind = F.when(key.isin(PART_WORDS), "part").when(key.isin(CHAPTER_WORDS), "chapter").when(key.isin(APPENDIX_WORDS), "appendix")
    value = F.regexp_replace(second, "[.:,—–]+$", "")
    numbered = F.rlike(value, F.lit(r"^([0-9]+|\p{L})$")) | is_roman(value) | fold_key(value, lang).isin(NUMBER_WORDS)
    head = F.regexp_replace(first, "[.):—–]+$", "")
    level = decimal_level(head)
    made = lambda k, v, n: F.struct(k.alias("kind"), v.alias("value"), n.cast("int").alias("level"))
    return F.when(kind.isNotNull() & numbered, made(kind, value, F.lit(1))).when(level.isNotNull(), made(F.lit("decimal"), head, level)).when(is_roman(head), made(F.lit("roman"), head, F.lit(1)))


def legible(text: Column, min_chars: int = 2, min_share: float = 0.6) -> Column:
    """Enough letters or digits, or only digits and full stops."""
    visible = F.regexp_replace(text, r"(?U)\s", "")
    alnum = F.length(F.regexp_replace(visible, r"[^\p{L}\p{N}]", ""))
    number = (alnum > 0) & F.rlike(visible, F.lit(r"^[\p{N}.]+$"))
    return (F.length(visible) > 0) & (number | ((alnum >= min_chars) & (alnum >= min_share * F.length(visible))))


def ends_mid_sentence(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[,;:\-–—]\z"))


def runs_on(last: Column, first: Column) -> Column:
    """``last`` does not end a sentence and ``first`` begins with a lower-case or caseless letter."""
    open_end = F.regexp_replace(F.regexp_replace(last, r"(?U)\s+\z", ""), f"[{CLOSERS}]+\\z", "")
    return F.rlike(open_end, F.lit(f"[^{TERMINALS}]\\z")) & F.rlike(first, F.lit(r"(?U)^\s*[\p{Ll}\p{Lo}]"))


def list_marker(text: Column) -> Column:
    """struct(kind, marker, ordinal) of the marker that a line begins with, or null. Roman wins over a single letter."""
    bullet = F.regexp_extract(text, f"(?U)^([{BULLETS}])\\s", 1)
    token = F.regexp_extract(text, r"(?U)^\s*(\S+)", 1)
    body = F.regexp_extract(token, r"^(.+)[.)]$", 1)
    short = (F.length(token) <= 8) & (body != "") & ~F.rlike(text, F.lit(f"^[{BULLETS}]"))
    made = lambda k, m, n: F.struct(F.lit(k).alias("kind"), m.alias("marker"), n.cast("int").alias("ordinal"))
    return (
        F.when(bullet != "", made("bullet", bullet, F.lit(None)))
        .when(short & F.rlike(body, F.lit("^[0-9]+$")), made("decimal", token, F.try_to_number(body, F.lit("99999999"))))
        .when(short & is_roman(body), made("roman", token, roman_value(body)))
        .when(short & F.rlike(body, F.lit(r"^\p{L}$")), made("alpha", token, F.ascii(F.lower(body)) - 96))
    )


def starts_with_caption_prefix(text: Column, lang: Column | None = None) -> Column:
    """A caption word, then a number, roman numeral or capital letter, in the same or the next token."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    first, second = F.try_element_at(words, F.lit(1)), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))
    word = F.regexp_extract(first, r"^(\p{L}*)", 1)
    glued = F.regexp_replace(F.substr(first, F.length(word) + 1), "^[.:]+", "")
    number = F.regexp_replace(F.when(glued != "", glued).otherwise(second), "[.:)—]+$", "")
    return F.coalesce(fold_key(word, lang).isin(CAPTION_WORDS) & (F.rlike(number, F.lit(r"^([0-9]+|\p{Lu})$")) | is_roman(number)), F.lit(False))


def split_folio(text: Column) -> Column:
    """struct(title, folio, value, arabic, fill) of a contents line; folio is null if none ends it."""
    number = F.regexp_extract(F.regexp_replace(text, r"(?U)\s+\z", ""), r"([\p{L}\p{N}]+)\z", 1)
    arabic = F.rlike(number, F.lit("^[0-9]{1,4}$"))
    roman = F.rlike(number, F.lit("^([ivxlcdm]{1,8}|[IVXLCDM]{1,8})$"))
    value = F.when(arabic, number.cast("bigint")).when(roman, roman_value(number).cast("bigint"))
    head = F.regexp_replace(text, r"(?U)[\p{L}\p{N}]+\s*\z", "")
    title = F.trim(F.regexp_replace(head, f"(?U)[\\s{LEADERS}]+\\z", ""))
    found = (value >= 0) & F.rlike(title, F.lit(r"\p{L}"))
    fill = F.length(F.regexp_replace(F.regexp_extract(head, f"(?U)([\\s{LEADERS}]*)\\z", 1), r"(?U)\s", ""))
    none = F.lit(None)
    return F.struct(
        F.when(found, title).otherwise(text).alias("title"), F.when(found, number).otherwise(none).alias("folio"), F.when(found, value).otherwise(none).alias("value"), F.when(found, arabic).otherwise(none).alias("arabic"), F.when(found, fill).otherwise(0).alias("fill")
    )


def strip_numbering(text: Column) -> Column:
    """A title without the numbers before it, unless nothing else is left."""
    number = r"[^\p{L}\p{N}\s]*([0-9.]*|[IVXLCDM]{1,8})[^\p{L}\p{N}\s]*"
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), f"^({number} )+(?=\\S)", "")


def is_boilerplate(title: Column) -> Column:
    """Titles that programs write: default names, file names, nothing."""
    t = F.lower(F.trim(title))
    return (t == "") | F.rlike(t, F.lit(f"^microsoft (word|powerpoint) - |^untitled(?!\\p{{L}})|\\.({FILE_EXTENSIONS})$|^(document|dokument|belge|presentation)[0-9]*$"))


def title_from_filename(filename: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(filename, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    clean = F.trim(F.regexp_replace(F.translate(stem, "_-", "  "), r"\s+", " "))
    return F.when(~is_boilerplate(clean), clean)


def identifier(sha256: Column) -> Column:
    """urn:uuid of version 5 in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.trim(sha256).cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def has_isbn(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit("[0-9X-]+"), F.lit(0)), lambda r: F.regexp_replace(r, "[^0-9]", ""))
    return F.contains(F.upper(text), F.lit("ISBN")) | F.exists(runs, lambda d: F.rlike(d, F.lit("^97[89][0-9]{10}$")))


def ends_with_attribution(text: Column) -> Column:
    """The words after the last dash are one to four and begin with a capital."""
    return F.rlike(text, F.lit(r"(?U)[—–]\s*\p{Lu}[^\s—–]*(\s+[^\s—–]+){0,3}\s*\z"))


UNDECODABLE = r"[\x{FFFD}\p{Co}[\p{Cc}&&[^\t\n\r]]]"


def undecodable_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, UNDECODABLE, ""))


def tokens_of(text: Column, lang: Column | None = None) -> Column:
    """array of struct(kind, word): word (folded), undecodable or other (fewer than two letters)."""
    return F.transform(
        F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""),
        lambda w: F.when(F.rlike(w, F.lit(UNDECODABLE)), F.struct(F.lit("undecodable").alias("kind"), F.lit("").alias("word")))
        .when(F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2, F.struct(F.lit("word").alias("kind"), fold_key(F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""), lang).alias("word")))
        .otherwise(F.struct(F.lit("other").alias("kind"), F.lit("").alias("word"))),
    )


def number_at_an_end(text: Column, smaller: Column) -> Column:
    """The number that a running head begins or ends with, set apart by a separator or by the line's smaller type; null if none."""
    sep = r"|•·–—/:\-"
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")

    def read(end: Column, beside: Column) -> Column:
        digits = F.regexp_replace(end, f"^[{sep}]+|[{sep}]+$", "")
        apart = (F.length(end) != F.length(digits)) | F.rlike(beside, F.lit(f"^[{sep}]+$")) | smaller
        return F.when(F.rlike(digits, F.lit("^[0-9]{1,18}$")) & apart, digits.cast("bigint"))

    enough = F.rlike(text, F.lit(r"\p{L}")) & (F.size(words) >= 2)
    return F.when(enough, F.coalesce(read(F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))), read(F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(-2)))))


def mask(text: Column) -> Column:
    """Runs of digits as ``#``, then letters only: the key by which lines repeat."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("#"), F.lit(" ")), r"\p{N}+", "#"), r"[^\p{L}#]", "")


def numeric_value(text: Column) -> Column:
    """The value of a line that is nothing but a number, arabic or roman."""
    bare = F.regexp_replace(text, r"(?U)[\s.]", "")
    return F.when(F.rlike(bare, F.lit("^[0-9]{1,18}$")), bare.cast("bigint")).otherwise(roman_value(bare).cast("bigint"))


def family_key(name: Column) -> Column:
    """A font's family: without subset prefix, style words and case."""
    plain = F.regexp_replace(name, r"^.{6}\+", "")
    return F.regexp_replace(F.lower(plain), f"([-_ ,]*({STYLE_SUFFIXES}))+[-_ ,]*$|[-_ ,]+$", "")


def primary(tag: Column) -> Column:
    return F.substring_index(tag, "-", 1)


def verbatim_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def xml_text(text: Column) -> Column:
    """Escaped for XML; a character that XML forbids is an error."""
    illegal = F.rlike(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"))
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(illegal, F.raise_error(F.lit("illegal XML character"))).otherwise(out)


def block_id(page: Column, x0: Column, y0: Column, x1: Column, y1: Column, text: Column) -> Column:
    """A stable name for a block: of its page, its box to a point, and its first 64 characters."""
    return F.substring(F.sha2(F.concat_ws("|", page, *[F.round(c).cast("bigint") for c in (x0, y0, x1, y1)], F.substring(text, 1, 64)).cast("binary"), 256), 1, 16)


# ISO 639-3 codes of the languages that detectors name, and their two-letter tags (cmn and pes by the tags that readers know).
ISO_639 = {
    "epo": "eo", "eng": "en", "rus": "ru", "cmn": "zh", "spa": "es", "por": "pt", "ita": "it", "ben": "bn", "fra": "fr", "deu": "de", "ukr": "uk", "kat": "ka", "ara": "ar", "hin": "hi",
    "jpn": "ja", "heb": "he", "yid": "yi", "pol": "pl", "amh": "am", "jav": "jv", "kor": "ko", "nob": "nb", "dan": "da", "swe": "sv", "fin": "fi", "tur": "tr", "nld": "nl", "hun": "hu",
    "ces": "cs", "ell": "el", "bul": "bg", "bel": "be", "mar": "mr", "kan": "kn", "ron": "ro", "slv": "sl", "hrv": "hr", "srp": "sr", "mkd": "mk", "lit": "lt", "lav": "lv", "est": "et",
    "tam": "ta", "vie": "vi", "urd": "ur", "tha": "th", "guj": "gu", "uzb": "uz", "pan": "pa", "aze": "az", "ind": "id", "tel": "te", "pes": "fa", "mal": "ml", "ori": "or", "mya": "my",
    "nep": "ne", "sin": "si", "khm": "km", "tuk": "tk", "aka": "ak", "zul": "zu", "sna": "sn", "afr": "af", "lat": "la", "slk": "sk", "cat": "ca", "tgl": "tl", "hye": "hy", "cym": "cy",
}


def tag_of(code: Column) -> Column:
    """The two-letter tag of a three-letter language code; an unknown code as it is."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ISO_639.items() for x in p]), code), code)


def render(template: Column, slots: Column) -> Column:
    """A template with each ``{name}`` replaced from a map of strings; slots without a value stay."""
    return F.aggregate(F.map_entries(slots), template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def localised(templates: dict[str, dict[str, str]], code: Column, locale: Column, fallback: str = "en") -> Column:
    """The template of a code in a locale's language, else in the fallback's. ``templates``: language, then code."""
    flat = F.create_map(*[F.lit(x) for lang, own in templates.items() for c, text in own.items() for x in (f"{lang}|{c}", text)])
    at = lambda lang: F.try_element_at(flat, F.concat_ws("|", lang, code))
    return F.coalesce(at(primary(locale)), at(F.lit(fallback)))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of a text's bytes in UTF-8, as a bigint."""
    data = F.encode(text, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint")
    places = F.when(F.octet_length(text) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.octet_length(text)))
    return F.aggregate(places, F.lit(2166136261).cast("bigint"), lambda h, i: ((h.bitwiseXOR(byte(i))) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def normal_ledger(text: Column) -> Column:
    """array of struct(reason, added, start, end, text): what ``normalized`` takes out and puts in. Spans of removals count the composed input's characters, of additions the output's."""
    made = F.array().cast("array<struct<reason:string,added:boolean,start:int,end:int,text:string>>")
    expansion = F.create_map(*[F.lit(x) for p in LIGATURES.items() for x in p])
    entry = lambda reason, added, at, size, what: F.struct(F.lit(reason).alias("reason"), F.lit(added).alias("added"), at.cast("int").alias("start"), (at + size).cast("int").alias("end"), what.alias("text"))

    def step(acc: Column, ch: Column) -> Column:
        more = F.try_element_at(expansion, ch)
        soft = ch == "­"
        own = F.when(soft, F.array(entry("SoftHyphen", False, acc["i"], F.lit(1), ch))).when(
            more.isNotNull(), F.array(entry("LigatureExpand", False, acc["i"], F.lit(1), ch), entry("LigatureExpand", True, acc["o"], F.length(more), more))
        )
        grown = F.when(soft, 0).when(more.isNotNull(), F.length(more)).otherwise(1)
        return F.struct((acc["i"] + 1).alias("i"), (acc["o"] + grown).alias("o"), F.when(own.isNull(), acc["out"]).otherwise(F.concat(acc["out"], own)).alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("o"), made.alias("out"))
    marked = F.rlike(text, F.lit(f"[­{''.join(LIGATURES)}]"))  # few texts have any
    return F.when(marked, F.aggregate(F.filter(F.split(nfc(text), ""), lambda c: c != ""), start, step, lambda acc: acc["out"])).otherwise(made)
