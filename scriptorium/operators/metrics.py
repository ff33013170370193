"""Evaluation metrics and statistics over tables of outcomes."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds


def normal_quantile(confidence: float) -> float:
    """The two-sided z of a confidence level, by bisection of erf."""
    low, high = 0.0, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < confidence else (low, mid)
    return (low + high) / 2


def wilson(passed: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson's interval, within 0..1; (0, 0) for no observations."""
    z = normal_quantile(confidence)
    p = passed / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), centre + half))


def wilson_by(outcomes: DataFrame, keys: list[str], ok: str, confidence: float = 0.95) -> DataFrame:
    sums = outcomes.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(ok).cast("int")).alias("passed"))
    low, high = wilson(F.col("passed"), F.col("n"), confidence)
    return sums.select(*keys, "n", "passed", (F.col("passed") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def gate(intervals: DataFrame, last: DataFrame, keys: list[str], t: Thresholds = DEFAULT) -> DataFrame:
    """pass unless there are too few instances, or the rate is under the last good one by more than its interval's half width."""
    both = intervals.join(last, keys, "left")
    bad = (F.col("n") < t.assertion_min_instances) | F.coalesce(F.col("rate") < F.col("last_rate") - (F.col("high") - F.col("low")) / 2, F.lit(False))
    return both.select(*intervals.columns, (~bad).alias("pass"))


def prf(truth: DataFrame, said: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, matched, truth, said, precision, recall, f1) of multisets of items; both empty is 1.

    Counts of items meet in one full join; nothing is paired within a key.
    """
    on = [*keys, item]
    a = truth.groupBy(*on).agg(F.count("*").alias("t"))
    b = said.groupBy(*on).agg(F.count("*").alias("s"))
    both = a.join(b, on, "full").na.fill(0, ["t", "s"])
    sums = both.groupBy(*keys).agg(F.sum(F.least("t", "s")).alias("matched"), F.sum("t").alias("truth"), F.sum("s").alias("said"))
    return _rates(sums)


def _rates(sums: DataFrame) -> DataFrame:
    p = F.when(F.col("said") == 0, (F.col("truth") == 0).cast("double")).otherwise(F.col("matched") / F.col("said"))
    r = F.when(F.col("truth") == 0, (F.col("said") == 0).cast("double")).otherwise(F.col("matched") / F.col("truth"))
    out = sums.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def prf_against_one(truth: DataFrame, said: DataFrame, groups: DataFrame, keys: list[str], item: str) -> DataFrame:
    """As ``prf``, where every key has the same truth (``item`` alone). Items are counted first and meet the truth's counts by item; what a key lacks follows from sums, so the truth isn't repeated for each key."""
    a = truth.groupBy(item).agg(F.count("*").alias("t"))
    b = said.groupBy(*keys, item).agg(F.count("*").alias("s"))
    all_of = a.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("truth"))  # one row
    sums = b.join(a, item, "left").groupBy(*keys).agg(F.sum(F.least("s", F.coalesce("t", F.lit(0)))).alias("matched"), F.sum("s").alias("said"))
    sums = groups.join(sums, keys, "left").na.fill(0, ["matched", "said"]).crossJoin(F.broadcast(all_of)).select(*keys, "matched", "truth", "said")
    return _rates(sums)


def chi_square_p(x: Column | str) -> Column:
    """The upper tail of chi square with one degree of freedom: Simpson's rule on the normal density up to 6, its asymptotic series beyond."""
    x = F.col(x) if isinstance(x, str) else x
    z, n = F.sqrt(x), 400
    density = lambda u: F.exp(-u * u / 2)
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + F.when(i % 2 == 1, 4.0).otherwise(2.0) * density(z * i / n))
    area = (1 + inner + density(z)) * z / (3 * n)
    tail = math.sqrt(2 / math.pi) * density(z) / z * (1 - 1 / x + 3 / (x * x) - 15 / (x * x * x))
    return F.when(z <= 6, F.greatest(F.lit(0.0), 1 - math.sqrt(2 / math.pi) * area)).when(z > 6, tail)


def exact_p(b: Column, c: Column) -> Column:
    """The two-sided binomial p of b against c discordant pairs; 1 without any. Each probability is made from the one before it, in logarithms."""
    n, k = (b + c).cast("double"), F.least(b, c)
    start = F.struct((-n * math.log(2)).alias("log"), F.exp(-n * math.log(2)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1) / i)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    places = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(places, start, step, lambda acc: acc["sum"])))


def superior(b: Column, c: Column, alpha: float = 0.05) -> Column:
    """Whether the first answers are better: more pairs where they alone are right, and too many for chance."""
    return (b > c) & (exact_p(b, c) < alpha)


def non_inferior(n: Column, b: Column, c: Column, alpha: float = 0.05, margin: float = 0.02) -> Column:
    """Whether the first answers aren't worse by the margin: one-sided z of the paired difference. Without discordant pairs the difference is 0."""
    d = (b - c) / n
    variance = ((b + c) / n - d * d) / n
    z = (d + margin) / F.sqrt(F.greatest(variance, F.lit(1e-300)))
    return F.when(n == 0, False).when(variance <= 0, d > -margin).otherwise(z > NormalDist().inv_cdf(1 - alpha))


def mcnemar(pairs: DataFrame, keys: list[str], first: str, second: str, t: Thresholds = DEFAULT) -> DataFrame:
    """(keys, n, b, c, exact, p, chi2): first only right (b), second only right (c); exact p for few discordant pairs, else chi square with correction."""
    yes, no = F.col(first).cast("boolean"), F.col(second).cast("boolean")
    sums = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(yes & ~no).alias("b"), F.count_if(~yes & no).alias("c"))
    d = F.col("b") + F.col("c")
    few = d < t.exact_below
    chi = F.when(d > 0, F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)), F.lit(2)) / d)
    return sums.select(*keys, "n", "b", "c", few.alias("exact"), F.when(few, exact_p(F.col("b"), F.col("c"))).alias("p_exact"), F.when(~few, chi).alias("chi2"))


def reliability(observations: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """(keys, bin, n, mean_confidence, accuracy) of bins of one width; the last is closed, empty ones are left out."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("bigint")
    return observations.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def expected_calibration_error(observations: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    cells = reliability(observations, keys, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")
    return cells.groupBy(*keys).agg(F.sum("n").alias("n"), gap.alias("ece"))


def risk_coverage(observations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, confidence, accepted, wrong, risk, coverage): what accepting down to each confidence costs.

    Observations are first counted by confidence, so the window runs over distinct confidences.
    """
    levels = observations.groupBy(*keys, "confidence").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("bad"))
    part = f"partition by {', '.join(keys)}" if keys else ""
    run = levels.select(*keys, "confidence", F.expr(f"sum(n) over ({part} order by confidence desc)").alias("accepted"), F.expr(f"sum(bad) over ({part} order by confidence desc)").alias("wrong"), F.expr(f"sum(n) over ({part})").alias("of"))
    return run.select(*keys, "confidence", "accepted", "wrong", (F.col("wrong") / F.col("accepted")).alias("risk"), (F.col("accepted") / F.col("of")).alias("coverage"))


def threshold_for(curve: DataFrame, keys: list[str], target: float) -> DataFrame:
    """The lowest confidence whose risk is within the target: the widest coverage; null if none is."""
    ok = F.col("risk") <= target
    return curve.groupBy(*keys).agg(F.min(F.when(ok, F.col("confidence"))).alias("threshold"), F.max(F.when(ok, F.col("coverage"))).alias("coverage"))


def stratum_report(rows: DataFrame) -> DataFrame:
    """(stratum, metric, n, mean, median, least, most) of rows (stratum, metric, value)."""
    return rows.groupBy("stratum", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.expr("percentile(value, 0.5)").alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))


def ours_vs_real_gap(rows: DataFrame, ours: str = "ours") -> DataFrame:
    """(metric, gap): mean of our stratum less that of the others; null if either is missing."""
    mine = F.avg(F.when(F.col("stratum") == ours, F.col("value")))
    theirs = F.avg(F.when(F.col("stratum") != ours, F.col("value")))
    return rows.groupBy("metric").agg((mine - theirs).alias("gap"))


def kendall_tau(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, tau) of tau-a between two orders ``x`` and ``y`` (integers, ``y`` non-negative and under 2**31); fewer than two items: 1.

    Discordances are counted as inversions in a merge by the bits of y, so that n items cost about 32 n rows and
    no pair is made: at each bit, of items that agree above it, those with a one that come before those with a zero.
    """
    ranked = rows.select(*keys, "x", "y")
    bits = ranked.select("*", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("bit"))
    bits = bits.select(*keys, "bit", "x", F.expr("shiftright(y, bit + 1)").alias("above"), F.expr("shiftright(y, bit) & 1").alias("one"))
    part = ", ".join([*keys, "bit", "above"])
    # zeros after ones in the order of x are discordant, ones after zeros concordant; equal x are neither
    seen = bits.select(*keys, "one", F.expr(f"coalesce(sum(one) over (partition by {part} order by x range between unbounded preceding and 1 preceding), 0)").alias("ones"), F.expr(f"coalesce(sum(1 - one) over (partition by {part} order by x range between unbounded preceding and 1 preceding), 0)").alias("zeros"))
    sums = seen.groupBy(*keys).agg(F.sum(F.when(F.col("one") == 0, F.col("ones")).otherwise(0)).alias("discordant"), F.sum(F.when(F.col("one") == 1, F.col("zeros")).otherwise(0)).alias("concordant"))
    n = ranked.groupBy(*keys).agg(F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return n.join(sums, keys).select(*keys, "n", F.when(F.col("n") < 2, 1.0).otherwise((F.col("concordant") - F.col("discordant")) / pairs).alias("tau"))
