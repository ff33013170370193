"""When a model is asked, and what of its answers is believed: evidence, budgets, gates. No model is called here; answers are a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds
from scriptorium.functions.text import verbatim_key
from scriptorium.operators import ledger

# The kinds of an opening page, in the order in which they are offered.
PAGE_KINDS = ["title", "halftitle", "copyright", "dedication", "epigraph", "contents", "foreword", "preface", "introduction", "other", "body"]
LETTERS = "ABCDEFGHIJK"


def _verdict(*rules: tuple[Column | None, bool, str]) -> Column:
    """struct(fires, because) of the first rule that holds; the last has no condition."""
    out = None
    for test, fires, because in reversed(rules):
        said = F.struct(F.lit(fires).alias("fires"), F.lit(because).alias("because"))
        out = said if test is None else F.when(test, said).otherwise(out)
    return out


def metadata(present: Column, boilerplate: Column) -> Column:
    return _verdict((~present, True, "no title"), (boilerplate, True, "boilerplate title"), (None, False, "title declared"))


def book_structure(outline: Column, contents: Column, least: int = 3) -> Column:
    return _verdict((outline > 0, False, "outline"), (contents >= least, False, "contents page"), (None, True, "neither"))


def heading_roles(styles: Column, headings: Column, numbered: Column) -> Column:
    return _verdict((styles <= 1, False, "one style"), ((headings > 0) & (numbered >= headings), False, "all numbered"), (None, True, "styles not ordered"))


def line_band(ratio: Column, low: float = 0.35, high: float = 0.75) -> Column:
    return F.when(ratio < low, "full").when(ratio > high, "short").otherwise("between")


def verse_quote(indented: Column, ratio: Column, remaining: Column) -> Column:
    band = line_band(ratio)
    return _verdict((~indented, False, "paragraph"), (band == "full", False, "quotation"), (band == "short", False, "verse"), (remaining == 0, False, "budget"), (None, True, "between"))


def dehyphenation(in_book: Column, in_list: Column, halves: Column) -> Column:
    return _verdict((in_book, False, "joined in book"), (in_list, False, "joined in list"), (halves, False, "halves attested"), (None, True, "no evidence"))


def run_in_heading(styled: Column, words: Column, ended: Column, most: int = 8) -> Column:
    return _verdict((~styled, False, "not styled"), ((words == 0) | (words > most), False, "length"), (~ended, False, "not ended"), (None, True, "run-in"))


def gather(*verdicts: tuple[str, Column]) -> Column:
    """array of struct(task, fires, because): all of a document's escalations."""
    return F.array(*[F.struct(F.lit(task).alias("task"), v["fires"].alias("fires"), v["because"].alias("because")) for task, v in verdicts])


def session(requests: DataFrame, cache: DataFrame, calls: int, seconds: float) -> DataFrame:
    """Requests (doc, at, key, seconds) with how each ends: from the cache (key), answered, or refused once a document's calls or seconds are spent. Cached ones cost nothing; running sums over what was asked before."""
    rows = requests.join(cache.select("key").distinct().withColumn("cached", F.lit(True)), "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    w = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.coalesce(F.sum((~F.col("cached")).cast("int")).over(w), F.lit(0))
    spent = F.coalesce(F.sum(F.when(~F.col("cached"), F.col("seconds"))).over(w), F.lit(0.0))
    return rows.withColumn("outcome", F.when(F.col("cached"), "cached").when(asked >= calls, "calls").when(spent >= seconds, "seconds").otherwise("asked")).drop("cached")


# --- gates ---


def gate_schema(answer: Column, ddl: str) -> Column:
    """An answer parsed as JSON of a schema; null if it isn't that, or has other fields."""
    parsed = F.from_json(answer, ddl, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(answer)
    known = [f.split()[0].strip("`") for f in ddl.split(", ")]
    return F.when(F.size(F.array_except(F.coalesce(keys, F.array(F.lit("?"))), F.array(*map(F.lit, known)))) == 0, parsed)


def gate_locality(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc, lost, gained, reordered) of documents' pieces (doc, at, text): an edit may change neither the characters that aren't white space nor their order."""
    bare = lambda df, name: df.groupBy("doc").agg(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), ""), r"(?U)\s", "").alias(name))
    counts = ledger.changed(ledger.histogram(before, ["doc"]), ledger.histogram(after, ["doc"]), ["doc"]).groupBy("doc").agg(F.sum("lost").alias("lost"), F.sum("appeared").alias("gained"))
    both = bare(before, "b").join(bare(after, "a"), "doc", "full").join(counts, "doc", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return both.select("doc", zero("lost").alias("lost"), zero("gained").alias("gained"), (F.col("lost").isNull() & ~F.col("b").eqNullSafe(F.col("a"))).alias("reordered"))


STATISTICS = ["dup_line", "top_2gram", "top_3gram", "non_alpha"]


def gate_validity(both: DataFrame, ratio: float = 0.01, violations: int = 0) -> DataFrame:
    """(id, worsened): of statistics before (b_...) and after (a_...) the first that got worse by more than the tolerance; null statistics decide nothing, ``violations`` (b_, a_) are whole numbers."""
    rules = None
    for s in ["violations", *STATISTICS[::-1]]:
        worse = (F.col("a_violations") > F.col("b_violations") + violations) if s == "violations" else F.coalesce(F.col(f"a_{s}") > F.col(f"b_{s}") + ratio, F.lit(False))
        rules = F.when(worse, s) if rules is None else F.when(worse, s).otherwise(rules)
    return both.select("id", rules.alias("worsened"))


def settle(answer: Column, failure: Column, fallback: Column) -> Column:
    """struct(value, method): the answer if nothing failed, else what was found without a model."""
    return F.when(failure.isNull() & answer.isNotNull(), F.struct(answer.alias("value"), F.lit("llm").alias("method"))).otherwise(F.struct(fallback.alias("value"), F.lit("fallback").alias("method")))


def accepts(answer: Column, words: list[str]) -> Column:
    """Whether an answer is one of a grammar's words and nothing else."""
    return F.trim(answer).isin(words)


def validate_metadata(fields: Column, pages: Column, title: Column, most: int = 300) -> Column:
    """What is wrong with an answer: a field (map of name to value) that isn't printed on the first pages, or a title out of range; null if nothing."""
    printed = verbatim_key(pages)
    wrong = F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull() & ((verbatim_key(e["value"]) == "") | ~F.contains(printed, verbatim_key(e["value"]))))
    length = F.length(F.trim(title))
    return F.when(F.size(wrong) > 0, F.concat(F.lit("not verbatim: "), wrong[0]["key"])).when((length == 0) | (length > most), "title out of range")


def plausible_title(title: Column, large: Column, least: int = 3) -> Column:
    """The title if a line of large type (array of texts) holds it, or is a part of it; else null."""
    want = verbatim_key(title)
    ok = F.exists(large, lambda x: F.contains(verbatim_key(x), want) | ((F.length(verbatim_key(x)) >= least) & F.contains(want, verbatim_key(x))))
    return F.when(ok, title)


def plausible_authors(authors: Column, least_words: int = 2) -> Column:
    return F.filter(authors, lambda a: (F.regexp_count(a, F.lit(r"\S+")) >= least_words) & ~F.rlike(a, F.lit(r"\p{N}")))


def holdout_check(probes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(doc, disagree): the share of probes (doc, cluster, role) whose role isn't that of their style (doc, cluster, role)."""
    both = probes.join(clusters.select("doc", "cluster", F.col("role").alias("own")), ["doc", "cluster"], "left")
    return both.groupBy("doc").agg(F.avg((~F.col("role").eqNullSafe(F.col("own"))).cast("double")).alias("disagree"))


def validate_roles(clusters: DataFrame, disagree: DataFrame, most: float = 0.20, low: int = 2, high: int = 200) -> DataFrame:
    """(doc, failure) of roles (doc, cluster, count, z, role, heading): probes that disagree, chapters of too few or too many runs, an epigraph as the most frequent large style, or every heading demoted; null if nothing."""
    size = F.when(F.col("z") > 0, F.struct("count", (-F.col("cluster")).alias("less"), "role"))
    s = clusters.groupBy("doc").agg(
        F.some((F.col("role") == "chapter") & ~F.col("count").between(low, high)).alias("chapters"), (F.max(size)["role"] == "epigraph").alias("epigraph"),
        F.count_if("heading").alias("headings"), F.count_if(F.col("heading") & F.col("role").isin("body", "epigraph")).alias("demoted"),
    )
    s = s.join(disagree, "doc", "left")
    failure = F.when(F.col("disagree") > most, "holdout").when(F.coalesce("chapters", F.lit(False)), "chapter count").when(F.coalesce("epigraph", F.lit(False)), "epigraph").when((F.col("headings") > 0) & (F.col("headings") == F.col("demoted")), "all demoted")
    return s.select("doc", failure.alias("failure"))


def chunks(n: Column, size: int = 200, overlap: int = 20) -> Column:
    """array of struct(start, end): ranges of at most ``size`` that overlap, the last one ending at n."""
    step = size - min(overlap, size - 1)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct((k * step).cast("bigint").alias("start"), F.least(n.cast("bigint"), (k * step + size).cast("bigint")).alias("end")))


def stitch(labels: DataFrame) -> DataFrame:
    """(doc, failure) of chunks' labels (doc, chunk, heading, zone 0 front, 1 body, 2 back, part): null if all chunks agree where they overlap and zones run front, body, back."""
    one = labels.groupBy("doc", "heading").agg(F.countDistinct("zone", "part").alias("says"), F.min("zone").alias("zone"))
    back = F.col("zone") < F.lag("zone").over(Window.partitionBy("doc").orderBy("heading"))
    s = one.withColumn("back", F.coalesce(back, F.lit(False))).groupBy("doc").agg(F.max("says").alias("says"), F.some("back").alias("back"))
    return s.select("doc", F.when(F.col("says") > 1, "overlap").when(F.col("back"), "order").alias("failure"))


def validate_structure(front_end: Column, parts: Column, back_start: Column, n: Column) -> Column:
    """What is wrong with zone boundaries: one out of range, or not strictly rising from front over parts to back; null if nothing."""
    row = F.concat(F.array(front_end), parts, F.array(back_start))
    rising = F.forall(F.zip_with(F.slice(row, F.lit(1), F.size(row) - 1), F.slice(row, F.lit(2), F.size(row) - 1), lambda a, b: a < b), lambda x: x)
    return F.when((front_end > n) | (back_start > n) | F.exists(parts, lambda p: p >= n), "range").when(~rising, "order")


def counter_evidence(kind: Column, monospace: Column, lines: Column, ratio: Column, default: Column, least: int = 3, short: float = 0.35) -> Column:
    """A block's kind, unless the page speaks against it: preformatted without even type, verse of few or full lines."""
    return F.when((kind == "pre") & ~monospace, default).when((kind == "verse") & ((lines < least) | (ratio <= short)), default).otherwise(kind)


def batches(blocks: DataFrame, size: int, most: int) -> DataFrame:
    """(doc, batch, block) of the first ``most`` blocks (doc, at, block) that a book may ask about, so many a call."""
    k = F.row_number().over(Window.partitionBy("doc").orderBy("at")) - 1
    return blocks.withColumn("k", k).where(F.col("k") < most).select("doc", F.floor(F.col("k") / size).alias("batch"), "block")


def parse_kind(answer: Column, order: list[str] = PAGE_KINDS) -> Column:
    """The kind that an answer's first letter names, whatever quotes or brackets stand before it; null if none."""
    letter = F.upper(F.regexp_extract(answer, r'^[\s"*(]*(.)', 1))
    at = F.instr(F.lit(LETTERS), letter)
    return F.when((letter != "") & (at > 0), F.get(F.array(*map(F.lit, order)), at - 1))


def promotion_gates(candidates: DataFrame, least_n: int = 30, alpha: float = 0.05, margin: float = 0.02, most_broken: float = 0.01, t: Thresholds = DEFAULT) -> DataFrame:
    """(model, failed array) of candidates (model, n, b, c, broken, schema_ok, locality_ok, validity_ok, seconds, budget, memory, memory_budget, licence_ok): the names of the nine gates that each fails."""
    from scriptorium.operators.metrics import non_inferior

    gates = {
        "evidence": F.col("n") >= least_n, "non_inferior": non_inferior(F.col("n"), F.col("b"), F.col("c"), alpha, margin), "false_repair": F.col("broken") <= most_broken, "schema": F.col("schema_ok"), "locality": F.col("locality_ok"),
        "validity": F.col("validity_ok"), "time": F.col("seconds") <= F.col("budget"), "memory": F.col("memory") <= F.col("memory_budget"), "licence": F.col("licence_ok"),
    }
    return candidates.select("model", F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items()]), lambda x: x.isNotNull()).alias("failed"))
