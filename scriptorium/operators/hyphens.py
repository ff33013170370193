"""The hyphen classifier: its features, training and scores; German compounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds
from scriptorium.functions.text import fnv1a32, primary

# Buckets of hashed features, least count of a word and letters of a piece to learn from, linking letters of German compounds, letters of a part.
BUCKETS, MIN_COUNT, MIN_PIECE = 8192, 2, 2
LINKS = ["es", "en", "er", "s", "n"]
MIN_PART = 3
#: Training holds so many examples at most, those of least hash; all are counted and scored.
TRAIN_EXAMPLES = 200_000


def features(head: Column, tail: Column, lang: Column) -> Column:
    """What a break looks like, as strings: language, lengths up to 9, case, hyphens, up to three letters on either side, and the two at the seam."""
    h, t = F.lower(head), F.lower(tail)
    yes = lambda c: F.when(c, "True").otherwise("False")
    upper = lambda c: F.rlike(c, F.lit(r"^\p{Lu}"))
    last = lambda n: F.when(F.length(h) <= n, h).otherwise(F.right(h, F.lit(n)))
    parts = [
        ("", F.lit("bias")), ("lang=", primary(lang)), ("hl=", F.least(F.length(head), F.lit(9)).cast("string")), ("tl=", F.least(F.length(tail), F.lit(9)).cast("string")), ("hup=", yes(upper(head))), ("tup=", yes(upper(tail))),
        ("hyp=", yes(F.contains(head, F.lit("-")) | F.contains(tail, F.lit("-")))),
    ]
    for n in (1, 2, 3):
        parts += [(f"h{n}=", last(n)), (f"t{n}=", F.substring(t, 1, n))]
    parts.append(("j=", F.concat(last(1), F.lit("|"), F.substring(t, 1, 1))))
    return F.array(*[F.concat(F.lit(a), b) for a, b in parts])


def buckets(names: Column, n: int = BUCKETS) -> Column:
    return F.transform(names, lambda f: fnv1a32(f) % n)


def score_breaks(breaks: DataFrame, weights: DataFrame, bias: float, t: Thresholds = DEFAULT) -> DataFrame:
    """Breaks (id, head, tail, lang) with score and action: the bias and the weights (bucket, weight) of their features' buckets; keep or join beyond a margin, else undecided. The weights are one row a bucket."""
    rows = breaks.select("id", F.explode(buckets(features(F.col("head"), F.col("tail"), F.col("lang")))).alias("bucket"))
    sums = rows.join(F.broadcast(weights), "bucket", "left").groupBy("id").agg((F.lit(bias) + F.sum(F.coalesce("weight", F.lit(0.0)))).alias("score"))
    m = t.classifier_margin_min
    return breaks.join(sums, "id").withColumn("action", F.when(F.col("score") >= m, "keep").when(F.col("score") <= -m, "join").otherwise("undecided"))


def build_examples(words: DataFrame) -> DataFrame:
    """(word, head, tail, keep) of word types (word, n) that occur often enough, one each: a word with a hyphen is a break there to keep, another one is cut at a place that its own hash picks, to join."""
    w = words.where((F.col("n") >= MIN_COUNT) & ~F.rlike("word", F.lit("['’]")))
    seam = F.instr("word", "-")
    hyphened = w.where(seam > 0).select("word", F.substring_index("word", "-", 1).alias("head"), F.expr("substring(word, instr(word, '-') + 1)").alias("tail"), F.lit(True).alias("keep"))
    hyphened = hyphened.where((F.length("head") >= MIN_PIECE) & (F.length("tail") >= MIN_PIECE) & ~F.startswith("tail", F.lit("-")))
    plain = w.where((seam == 0) & (F.length("word") >= 2 * MIN_PIECE))
    at = (F.lit(MIN_PIECE) + fnv1a32(F.col("word")) % (F.length("word") - 2 * MIN_PIECE + 1)).cast("int")
    plain = plain.select("word", at.alias("at")).select("word", F.expr("substring(word, 1, at)").alias("head"), F.expr("substring(word, at + 1)").alias("tail"), F.lit(False).alias("keep"))
    return hyphened.unionByName(plain)


def fit(marks: np.ndarray, keep: np.ndarray, n: int = BUCKETS, epochs: int = 400, rate: float = 0.5, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression by plain descent on a fixed schedule, classes weighing the same; ``marks`` has a row of buckets for each example."""
    theta, bias = np.zeros(n), 0.0
    share = np.where(keep, 0.5 / max(1, keep.sum()), 0.5 / max(1, (~keep).sum())) * len(keep)
    for epoch in range(epochs):
        p = 1 / (1 + np.exp(-(theta[marks].sum(1) + bias)))
        error = (p - keep) * share
        theta -= rate * (np.bincount(marks.ravel(), np.repeat(error, marks.shape[1]), n) / len(keep) + l2 * theta)
        bias -= rate * float(error.mean())
        rate *= 0.3 if epoch == 250 else 1.0
    return theta, bias


def train(examples: DataFrame, lang: str = "en", most: int = TRAIN_EXAMPLES) -> tuple[np.ndarray, float]:
    """Fit to examples (word, head, tail, keep): all, or ``most`` of them by least hash of the word."""
    rows = examples.select("keep", buckets(features(F.col("head"), F.col("tail"), F.lit(lang))).alias("marks"), fnv1a32(F.col("word")).alias("h"), "word").orderBy("h", "word").limit(most).select("keep", "marks").toPandas()
    if not len(rows):
        return np.zeros(BUCKETS), 0.0
    return fit(np.stack(rows["marks"].to_list()), rows["keep"].to_numpy(bool))


def metrics(scored: DataFrame) -> DataFrame:
    """One row (keep_recall, join_recall, balanced_accuracy, accuracy) of scored examples (keep, score)."""
    right = lambda keep: F.count_if((F.col("keep") == keep) & ((F.col("score") > 0) == keep)) / F.greatest(F.count_if(F.col("keep") == keep), F.lit(1))
    s = scored.agg(right(True).alias("keep_recall"), right(False).alias("join_recall"), F.avg(((F.col("score") > 0) == F.col("keep")).cast("double")).alias("accuracy"))
    return s.withColumn("balanced_accuracy", (F.col("keep_recall") + F.col("join_recall")) / 2)


def hyphen_is_real(head: Column, tail: Column) -> Column:
    """A hyphen between a capital (or what is no letter) and a capital is the word's own."""
    return F.rlike(head, F.lit(r"^(\p{Lu}|\P{L})")) & F.rlike(tail, F.lit(r"^\p{Lu}"))


def split_compounds(words: DataFrame, attested: DataFrame) -> DataFrame:
    """(word, left, link, right): the first place, from the left, where a word falls into two attested words (word), with nothing or a linking letter between.

    Every cut of a word is a row and meets the attested words by equality, twice.
    """
    w = words.select("word").distinct().where(F.length("word") >= 2 * MIN_PART)
    cuts = w.select("word", F.explode(F.sequence(F.lit(MIN_PART), F.length("word") - MIN_PART)).alias("seam"))
    cuts = cuts.select("word", "seam", F.expr("substring(word, 1, seam)").alias("left"), F.expr("substring(word, seam + 1)").alias("rest"))
    known = attested.select("word").distinct()
    cuts = cuts.join(known.select(F.col("word").alias("left")), "left", "left_semi")
    options = F.array(F.struct(F.lit(0).alias("rank"), F.lit("").alias("link")), *[F.struct(F.lit(i).alias("rank"), F.lit(x).alias("link")) for i, x in enumerate(LINKS, 1)])
    cuts = cuts.select("word", "seam", "left", "rest", F.inline(options)).where(F.startswith("rest", F.col("link")))
    cuts = cuts.withColumn("right", F.expr("substring(rest, length(link) + 1)")).where(F.length("right") >= MIN_PART)
    found = cuts.join(known.select(F.col("word").alias("right")), "right", "left_semi")
    return found.groupBy("word").agg(F.min(F.struct("seam", "rank", "left", "link", "right")).alias("x")).select("word", "x.left", "x.link", "x.right")


def german_decisions(breaks: DataFrame, attested: DataFrame) -> DataFrame:
    """(id, decision) of breaks (id, head, tail): keep a hyphen that is the word's own, join what is a compound of attested words; others have no row."""
    own = breaks.where(hyphen_is_real(F.col("head"), F.col("tail"))).select("id", F.lit("keep").alias("decision"))
    rest = breaks.where(~F.coalesce(hyphen_is_real(F.col("head"), F.col("tail")), F.lit(False))).select("id", F.lower(F.concat("head", "tail")).alias("word"))
    return own.unionByName(rest.join(split_compounds(rest, attested).select("word"), "word").select("id", F.lit("join").alias("decision")))


def word_list_decisions(breaks: DataFrame, known: DataFrame) -> DataFrame:
    """(id, decision) of breaks (id, head, tail) by a list of words (word): both halves and not the whole keep, the whole and not both halves join; others have no row."""
    rows = breaks.select("id", F.lower(F.concat("head", "tail")).alias("whole"), F.lower("head").alias("h"), F.lower("tail").alias("t"))
    for c in ("whole", "h", "t"):
        rows = rows.join(known.select(F.col("word").alias(c), F.lit(True).alias(f"has_{c}")).distinct(), c, "left")
    has = {c: F.coalesce(f"has_{c}", F.lit(False)) for c in ("whole", "h", "t")}
    decision = F.when(has["h"] & has["t"] & ~has["whole"], "keep").when(has["whole"] & ~(has["h"] & has["t"]), "join")
    return rows.select("id", decision.alias("decision")).where("decision is not null")


def word_blob(words: DataFrame) -> DataFrame:
    """(size, blob): a sorted list of distinct words as one text, a word a line. Meant for a vocabulary, which is bounded."""
    return words.agg(F.array_sort(F.collect_set("word")).alias("w")).select(F.size("w").cast("bigint").alias("size"), F.array_join("w", "\n").alias("blob"))
