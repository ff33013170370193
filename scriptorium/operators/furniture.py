"""Running heads, folios and continuity across pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds
from scriptorium.functions.text import TERMINALS, fold_key, is_roman, mask, number_at_an_end, numeric_value, roman_value, runs_on
from scriptorium.operators.evaluate import edit_distance

# A line this long shows where a page's text stands, what lies this far from it is in the margin, and letters that readers take digits for.
MARGIN_CHARS, MARGIN_SLACK = 30, 1.0
DIGIT_LIKE = "ılIiOoSsB"
FOLIO_REACH = 2


def repetition_evidence(lines: DataFrame, pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(book, band, key, hits, ratio, scope, pages, decision) for each key of a band.

    ``lines``: book, page, band, key. ``pages``: book, page, those that have text. The best share of hit pages
    is taken over all pages, even ones, odd ones and every window of so many pages; windows run over a key's hits
    only, numbered by eligible page; of equal shares the first scope counts. A key must be on enough pages of its scope: required is max(3, 20 %), within 2 and the scope.
    """
    w = t.furniture_window_pages
    numbered = pages.select("book", "page").distinct().withColumn("rank", F.expr("row_number() over (partition by book order by page)"))
    books = numbered.groupBy("book").agg(F.count("*").alias("all"), F.count_if(F.col("page") % 2 == 0).alias("even"), F.count_if(F.col("page") % 2 != 0).alias("odd"))
    hits = lines.select("book", "page", "band", "key").distinct().join(numbered, ["book", "page"]).join(books, "book")
    last = (F.col("all") > w) & (F.col("rank") > F.col("all") - w)
    hits = hits.withColumn("window_hits", F.expr(f"count(*) over (partition by book, band, key order by rank range between current row and {w - 1} following)"))
    by_key = hits.groupBy("book", "band", "key", "all", "even", "odd").agg(
        F.count("*").alias("hits"), F.count_if(F.col("page") % 2 == 0).alias("even_hits"), F.count_if(F.col("page") % 2 != 0).alias("odd_hits"), F.max(F.when(~last, F.col("window_hits"))).alias("in_window"), F.count_if(last).alias("in_last")
    )

    def required(scope: Column) -> Column:
        share = F.ceil(t.furniture_min_repeat_page_share * scope)
        return F.greatest(F.lit(2), F.least(scope, F.greatest(F.lit(t.furniture_min_repeat_pages), share)))

    windowed = F.greatest(F.coalesce("in_window", F.lit(0)), F.col("in_last"))

    def evidence(name: str, count: Column, scope: Column) -> Column:
        rank = -["all", "even", "odd", "window"].index(name)
        return F.struct((count / scope).alias("ratio"), F.lit(rank).alias("first"), count.alias("pages"), F.lit(name).alias("scope"), (count >= required(scope)).alias("enough"))

    options = F.array(
        evidence("all", F.col("hits"), F.col("all")),
        F.when(F.col("even") > 0, evidence("even", F.col("even_hits"), F.col("even"))),
        F.when(F.col("odd") > 0, evidence("odd", F.col("odd_hits"), F.col("odd"))),
        F.when(F.col("all") > w, evidence("window", windowed, F.lit(w))),
    )
    best = F.array_max(F.filter(options, lambda x: x.isNotNull()))
    out = by_key.withColumn("best", best)
    fires = F.col("best.enough") & (F.col("best.ratio") >= t.furniture_repetition_ratio_min)
    grey = F.col("best.ratio") >= t.furniture_repetition_ratio_grey_min
    return out.select("book", "band", "key", "hits", F.col("best.ratio").alias("ratio"), F.col("best.scope").alias("scope"), F.col("best.pages").alias("pages"), F.when(fires, "furniture").when(grey, "abstain").otherwise("text").alias("decision"))


def folio_constants(readings: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(book, system, constant, pages, share) of page numbers: value less page is one constant for a run of pages.

    ``readings``: book, page, system, value. A constant counts if it is on enough pages and a large enough share of the system's readings.
    """
    counts = readings.groupBy("book", "system", (F.col("value") - F.col("page")).alias("constant")).agg(F.countDistinct("page").alias("pages"), F.count("*").alias("n"))
    share = F.col("n") / F.expr("sum(n) over (partition by book, system)")
    return counts.select("book", "system", "constant", "pages", share.alias("share")).where((F.col("pages") >= t.furniture_min_repeat_pages) & (F.col("share") >= t.folio_constant_min_share))


def progression(readings: DataFrame) -> DataFrame:
    """(book, step): the one non-zero difference between values in the order of pages; null if there is none or a page has two values."""
    pages = readings.groupBy("book", "page").agg(F.min("value").alias("value"), F.max("value").alias("high"))
    steps = pages.withColumn("step", F.expr("value - lag(value) over (partition by book order by page)"))
    one = (F.min("step") == F.max("step")) & (F.min("step") != 0) & (F.count_if(F.col("value") != F.col("high")) == 0)
    return steps.groupBy("book").agg(F.when(one, F.min("step")).alias("step"))


def continuity(pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(book, boundaries, held, rate) over pages (book, page, first, last): how often text runs on over a page's end; 1.0 without boundaries."""
    pairs = pages.withColumn("next", F.expr("lead(first) over (partition by book order by page)"))
    sums = pairs.groupBy("book").agg(F.count("next").alias("boundaries"), F.count_if(F.coalesce(runs_on(F.col("last"), F.col("next")), F.lit(False))).alias("held"))
    return sums.select("book", "boundaries", "held", F.when(F.col("boundaries") == 0, 1.0).otherwise(F.col("held") / F.col("boundaries")).alias("rate"))


# --- from lines to verdicts ---
# lines: book, page, line, text, x0, y0, x1, y1, baseline, size; pages: book, page, height


def body_sizes(lines: DataFrame) -> DataFrame:
    """(book, body): the size that most characters are set in; the larger of two."""
    chars = lines.groupBy("book", "size").agg(F.sum(F.length("text")).alias("chars"))
    return chars.groupBy("book").agg(F.max(F.struct("chars", "size"))["size"].alias("body"))


def band_of(y0: Column, y1: Column, height: Column, t: Thresholds = DEFAULT) -> Column:
    return F.when(y1 <= t.furniture_band_ratio * height, "top").when(y0 >= height - t.furniture_band_ratio * height, "bottom")


def candidates(lines: DataFrame, pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(book, page, line, band, key, baseline, value, sole, goes_on) of the lines in a page's top or bottom band that have a key: their number, if they are one; whether
    they are all that the page has, and whether they look like a sentence that the next line goes on with."""
    w = Window.partitionBy("book", "page").orderBy("line")
    rows = lines.join(body_sizes(lines), "book").join(pages, ["book", "page"])
    rows = rows.withColumns({"next": F.lead("text").over(w), "of": F.count("*").over(Window.partitionBy("book", "page")), "band": band_of(F.col("y0"), F.col("y1"), F.col("height"), t), "key": mask(fold_key(F.col("text")))})
    in_body = F.abs(F.col("size") - F.col("body")) <= t.furniture_body_size_tolerance * F.col("body")
    open_end = ~F.rlike("text", F.lit(f"[{TERMINALS}]\\s*$"))
    goes_on = in_body & open_end & F.coalesce(F.rlike("next", F.lit(r"^\s*\p{Ll}")), F.lit(False))
    kept = rows.where(F.col("band").isNotNull() & (F.trim("text") != "") & (F.col("key") != ""))
    return kept.select("book", "page", "line", "band", "key", "baseline", numeric_value(F.col("text")).alias("value"), (F.col("of") == 1).alias("sole"), goes_on.alias("goes_on"), "body")


def near_groups(found: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(book, band, key, baseline, group): keys within an edit distance are one group, as are baselines within a distance of its first; in the order in which they first occur.

    The folds run over the distinct keys and baselines of a book's band, not over its pages.
    """
    first = found.groupBy("book", "band", "key", "baseline").agg(F.min(F.struct("page", "line")).alias("at"), F.first("body").alias("body"))
    rows = first.select("book", "band", "key", "baseline", F.col("at.page").alias("page"), F.col("at.line").alias("line"), "body")

    bins = lambda text: np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % 64, minlength=64)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["page", "line"], kind="stable")
        heads: list[str] = []
        counts, sizes = np.zeros((len(part), 64), np.int64), np.zeros(len(part))
        of_key: dict[str, int] = {}
        starts: dict[int, list[float]] = {}
        out = []
        for r in part.itertuples():
            if r.key not in of_key:
                n, own = len(heads), bins(r.key)
                # characters that one has more of than the other bound the distance from below
                off = counts[:n] - own
                least = np.maximum(np.maximum(off, 0).sum(1), np.maximum(-off, 0).sum(1))
                most = t.furniture_ned_max * np.maximum(sizes[:n], len(r.key))
                near = (i for i in np.flatnonzero(least <= most).tolist() if heads[i] == r.key or edit_distance([*heads[i]], [*r.key]) <= most[i])
                of_key[r.key] = next(near, n)
                if of_key[r.key] == n:
                    heads.append(r.key)
                    counts[n], sizes[n] = own, len(r.key)
            g = of_key[r.key]
            lows = starts.setdefault(g, [])
            at = next((i for i, b in enumerate(lows) if abs(b - r.baseline) <= t.furniture_y_cluster_ratio * r.body), len(lows))
            if at == len(lows):
                lows.append(r.baseline)
            out.append((*key, r.key, r.baseline, f"{heads[g]}|{at}"))
        return pd.DataFrame(out, columns=["book", "band", "key", "baseline", "group"])

    return rows.groupBy("book", "band").applyInPandas(run, f"book {dict(found.dtypes)['book']}, band string, key string, baseline double, group string")


def folio_readings(lines: DataFrame, pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(book, page, line, band, baseline, arabic, value, label, with_text): lines in a band or the margin that are a number, look like one, or are a running head that has one at an end."""
    rows = lines.join(body_sizes(lines), "book").join(pages, ["book", "page"])
    long = F.length("text") >= MARGIN_CHARS
    over = Window.partitionBy("book", "page")
    rows = rows.withColumns({"left": F.min(F.when(long, F.col("x0"))).over(over), "right": F.max(F.when(long, F.col("x1"))).over(over)})
    aside = F.coalesce((F.col("x1") <= F.col("left") + MARGIN_SLACK) | (F.col("x0") >= F.col("right") - MARGIN_SLACK), F.lit(False))
    token = F.regexp_replace("text", r"[^\p{L}\p{N}]", "")
    rows = rows.withColumns({"band": F.coalesce(band_of(F.col("y0"), F.col("y1"), F.col("height"), t), F.when(aside, "body")), "token": token}).where("band is not null and token <> ''")
    arabic = F.rlike("token", F.lit("^[0-9]+$"))
    roman = F.rlike("token", F.lit("^([a-z]+|[A-Z]+)$")) & is_roman(F.col("token"))
    end = F.when((F.length("token") > 5) & (F.col("band") != "body"), number_at_an_end(F.col("text"), F.col("size") < F.col("body")))
    value = F.when(F.length("token") > 5, end).when(arabic, F.col("token").cast("bigint")).when(roman, roman_value(F.col("token")).cast("bigint"))
    like = F.rlike("token", F.lit("[0-9]")) & F.rlike("token", F.lit(f"^[0-9{DIGIT_LIKE}]+$"))
    kept = rows.withColumn("value", value).where("value is not null or length(token) <= 5").where(F.col("value").isNotNull() | like)
    short = F.length("token") <= 5
    return kept.select("book", "page", "line", "band", "baseline", F.when(F.col("value").isNotNull(), arabic | ~short).alias("arabic"), "value", F.when(short, F.trim("text")).otherwise(F.col("value").cast("string")).alias("label"), (~short).alias("with_text"), "body")


def find_folios(readings: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(book, page, line, band, label, with_text): a page's first number that is the page plus one of the constants that many pages agree on; then numbers that can't be read but stand where
    one of the two pages before or after has its own, in the order of pages."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["page", "line"], kind="stable")
        known = part[part["value"].notna()].assign(constant=lambda x: x["value"] - x["page"])
        counts = known.groupby(["arabic", "constant"]).size()
        of = known.groupby("arabic").size()
        good = {k for k, n in counts.items() if n >= max(2, t.furniture_min_repeat_pages) and n >= t.folio_constant_min_share * of[k[0]]}
        at: dict[int, tuple] = {}
        out = []
        for r in known.itertuples():
            if (r.arabic, r.constant) in good and r.page not in at:
                at[r.page] = (r.band, r.baseline, r.constant)
                out.append((*key, r.page, r.line, r.band, r.label, r.with_text))
        for r in part[part["value"].isna()].itertuples() if out else ():
            near = [at[p] for p in range(r.page - FOLIO_REACH, r.page + FOLIO_REACH + 1) if p != r.page and p in at]
            hit = next((n for n in near if n[0] == r.band and abs(n[1] - r.baseline) <= t.furniture_y_cluster_ratio * max(1.0, r.body)), None)
            if r.page not in at and hit and r.page + hit[2] > 0:
                at[r.page] = (hit[0], r.baseline, hit[2])
                out.append((*key, r.page, r.line, hit[0], str(int(r.page + hit[2])), False))
        return pd.DataFrame(out, columns=["book", "page", "line", "band", "label", "with_text"])

    kinds = dict(readings.dtypes)
    return readings.groupBy("book").applyInPandas(run, f"book {kinds['book']}, page {kinds['page']}, line {kinds['line']}, band string, label string, with_text boolean")


def detect_furniture(lines: DataFrame, pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(book, page, line, kind, label) of lines that are page numbers, running heads or running feet. Page numbers first; the rest by repetition; a page never loses all its lines; books of one page with text have none.

    What is read several times (numbers, candidates, groups: a few rows a page) is cached; ``spark.catalog.clearCache()`` frees it.
    """
    eligible = lines.select("book", "page").distinct()
    enough = eligible.groupBy("book").agg(F.count("*").alias("n")).where("n >= 2").select("book")
    lines = lines.join(enough, "book", "left_semi")
    folios = find_folios(folio_readings(lines, pages, t), t).persist()
    numbers = folios.select("book", "page", "line", F.when(~F.col("with_text"), "page_number").when(F.col("band") == "top", "running_head").otherwise("running_foot").alias("kind"), "label")
    found = candidates(lines, pages, t).join(folios.select("book", "page", "line"), ["book", "page", "line"], "left_anti").persist()
    grouped = found.join(near_groups(found, t), ["book", "band", "key", "baseline"]).persist()
    flags = grouped.groupBy("book", "band", "group").agg(F.every("sole").alias("all_sole"), F.some("goes_on").alias("any_goes_on"), F.every(F.col("value").isNotNull()).alias("numeric"))
    steps = progression(grouped.withColumn("book", F.struct("book", "band", "group"))).select("book.*", "step")
    repeats = repetition_evidence(grouped.select("book", "page", "band", F.col("group").alias("key")), eligible, t).where("decision = 'furniture'").select("book", "band", F.col("key").alias("group"))
    fires = repeats.join(flags, ["book", "band", "group"]).join(steps, ["book", "band", "group"], "left").where("not all_sole and not any_goes_on and (not numeric or step is not null)")
    kind = F.when(F.col("numeric"), "page_number").when(F.col("band") == "top", "running_head").otherwise("running_foot")
    rest = grouped.join(fires, ["book", "band", "group"]).select("book", "page", "line", kind.alias("kind"), F.when(F.col("numeric"), F.col("value").cast("string")).alias("label"))
    said = numbers.unionByName(rest)
    whole = lines.groupBy("book", "page").agg(F.count("*").alias("of")).join(said.groupBy("book", "page").agg(F.count("*").alias("gone")), ["book", "page"]).where("of = gone")
    return said.join(whole.select("book", "page"), ["book", "page"], "left_anti")


REASONS = {"running_head": "RunningHeader", "running_foot": "RunningFooter", "page_number": "PageNumber"}


def apply_furniture(lines: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines without furniture; an entry (book, page, reason, start, end, text) for each line taken out, spans counting a page's removed characters; labels (book, page, label), the last of a page."""
    on = ["book", "page", "line"]
    gone = lines.join(verdicts.select(*on, "kind", "label"), on)
    w = Window.partitionBy("book", "page").orderBy("line")
    end = F.sum(F.length("text")).over(w)
    reason = F.try_element_at(F.create_map(*[F.lit(x) for p in REASONS.items() for x in p]), F.col("kind"))
    ledger = gone.select("book", "page", reason.alias("reason"), (end - F.length("text")).alias("start"), end.alias("end"), "text")
    labels = gone.where("label is not null").groupBy("book", "page").agg(F.max_by("label", "line").alias("label"))
    return lines.join(verdicts.select(*on), on, "left_anti"), ledger, labels
