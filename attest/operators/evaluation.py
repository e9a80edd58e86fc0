"""Evaluation of verification scores: exact ROC, AUC, equal error rate and operating points.

A record is (same_person boolean, score double in [0, 1]), and optionally n, how many pairs it stands for; a pair is accepted if its
score is strictly above the threshold.
Records are first counted by score. Running counts over the distinct scores, highest first, then give every operating point at
once. Nothing is ordered in one task: scores fall into BUCKETS ranges, whose few totals are summed first, and the distinct
scores of one range are ordered within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
TRUE, FALSE = ("1", "true", "yes", "same", "same_person", "genuine"), ("0", "false", "no", "different", "different_person", "impostor")


def label(text: Column) -> Column:
    """Six words for true and six for false, whatever their case and outer spaces; null for any other."""
    x = F.lower(F.trim(text))
    return F.when(x.isin(*TRUE), True).when(x.isin(*FALSE), False)


def problems(records: DataFrame) -> DataFrame:
    """One row: what forbids an evaluation (empty, null, not_finite, range, one_class), null if nothing does."""
    s = F.col("score")
    a = records.agg(F.count("*").alias("n"), F.count_if(s.isNull() | F.col("same_person").isNull()).alias("nulls"), F.count_if(F.isnan(s) | (F.abs(s) == float("inf"))).alias("odd"), F.count_if((s < 0) | (s > 1)).alias("out"), F.count_if(F.col("same_person")).alias("genuine"))
    return a.select(F.when(F.col("n") == 0, "empty").when(F.col("nulls") > 0, "null").when(F.col("odd") > 0, "not_finite").when(F.col("out") > 0, "range").when((F.col("genuine") == 0) | (F.col("genuine") == F.col("n")), "one_class").alias("problem"))


def by_score(records: DataFrame) -> DataFrame:
    """score, genuine, impostor; and of the records at or above the score: up_genuine, up_impostor, up_all; and the next lower score, below."""
    n = F.col("n") if "n" in records.columns else F.lit(1)
    own = lambda which: F.coalesce(F.sum(F.when(which, n)), F.lit(0)).cast("long")
    counted = records.groupBy("score").agg(own(F.col("same_person")).alias("genuine"), own(~F.col("same_person")).alias("impostor")).withColumn("bucket", F.least(F.floor(F.col("score") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    down = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy("bucket").agg(F.sum("genuine").alias("g"), F.sum("impostor").alias("i"), F.max("score").alias("top"))
    totals = totals.select(F.col("bucket").alias("b"), F.coalesce(F.sum("g").over(down), F.lit(0)).alias("g"), F.coalesce(F.sum("i").over(down), F.lit(0)).alias("i"), F.lead("top").over(Window.orderBy(F.desc("bucket"))).alias("next_top"))  # at most BUCKETS rows
    within = Window.partitionBy("bucket").orderBy(F.desc("score"))
    met = counted.join(F.broadcast(totals), F.col("bucket") == F.col("b"))
    out = met.select("score", "genuine", "impostor", (F.sum("genuine").over(within) + F.col("g")).alias("up_genuine"), (F.sum("impostor").over(within) + F.col("i")).alias("up_impostor"), F.coalesce(F.lead("score").over(within), F.col("next_top")).alias("below"))
    return out.withColumn("up_all", F.col("up_genuine") + F.col("up_impostor"))


def curve(records: DataFrame) -> DataFrame:
    """threshold, four counts and four rates, for every threshold that tells records apart: 1, the midpoints between neighbouring scores, 0."""
    scores = by_score(records)
    totals = scores.agg(F.sum("genuine").alias("all_genuine"), F.sum("impostor").alias("all_impostor"), F.sum(F.when(F.col("score") == 0, F.col("genuine")).otherwise(0)).alias("zero_genuine"), F.sum(F.when(F.col("score") == 0, F.col("impostor")).otherwise(0)).alias("zero_impostor"))
    between = scores.where(F.col("below").isNotNull()).select(((F.col("score") + F.col("below")) / 2).alias("threshold"), F.col("up_genuine").alias("true_accept"), F.col("up_impostor").alias("false_accept"))
    ends = totals.select(F.inline(F.array(F.struct(F.lit(1.0).alias("threshold"), F.lit(0).cast("long").alias("true_accept"), F.lit(0).cast("long").alias("false_accept")), F.struct(F.lit(0.0).alias("threshold"), (F.col("all_genuine") - F.col("zero_genuine")).alias("true_accept"), (F.col("all_impostor") - F.col("zero_impostor")).alias("false_accept")))))
    rows = between.unionByName(ends).crossJoin(F.broadcast(totals.select("all_genuine", "all_impostor")))  # the other side is one row
    far, tar = F.try_divide(F.col("false_accept"), F.col("all_impostor")), F.try_divide(F.col("true_accept"), F.col("all_genuine"))
    return rows.select("threshold", "true_accept", "false_accept", (F.col("all_genuine") - F.col("true_accept")).alias("false_reject"), (F.col("all_impostor") - F.col("false_accept")).alias("true_reject"), far.alias("far"), (1 - tar).alias("frr"), tar.alias("tar"), (1 - far).alias("trr"))


def equal_error(points: DataFrame) -> DataFrame:
    """The point where FAR and FRR are nearest; of equal ones the one with the smaller sum, then the higher threshold."""
    key = F.struct(F.abs(F.col("far") - F.col("frr")), F.col("far") + F.col("frr"), -F.col("threshold"))
    best = points.agg(F.min_by(F.struct("threshold", "far", "frr"), key).alias("p"))
    return best.select(((F.col("p.far") + F.col("p.frr")) / 2).alias("eer"), "p.threshold", "p.far", "p.frr")


def auc(records: DataFrame) -> DataFrame:
    """Area under the ROC curve with its corners: the chance that a genuine pair scores above an impostor one, ties counting half, which is what the trapezoids sum to."""
    s = by_score(records)
    wins = F.sum(F.col("impostor") * (F.col("up_genuine") - F.col("genuine") / 2))
    return s.agg(F.try_divide(wins, F.sum("genuine") * F.sum("impostor")).alias("auc"))


def at_targets(points: DataFrame, targets: list[float]) -> DataFrame:
    """For each target: of the points with a FAR of at most it, the one of greatest TAR, then greatest FAR, then least threshold."""
    rows = points.select("*", F.explode(F.array(*map(F.lit, targets))).alias("target")).where(F.col("far") <= F.col("target"))
    best = rows.groupBy("target").agg(F.max_by(F.struct("threshold", "far", "tar", "frr"), F.struct("tar", "far", -F.col("threshold"))).alias("p"))
    return best.select("target", "p.*")


def summary(records: DataFrame) -> DataFrame:
    """For genuine and impostor pairs: count, min, max, mean, median (of an even count, the mean of the middle two), from the counts by score."""
    s = by_score(records)
    long = s.select(F.inline(F.array(F.struct(F.lit(True).alias("same_person"), F.col("score"), F.col("genuine").alias("n"), F.col("up_genuine").alias("up")), F.struct(F.lit(False).alias("same_person"), F.col("score"), F.col("impostor").alias("n"), F.col("up_impostor").alias("up"))))).where(F.col("n") > 0)
    total = F.broadcast(long.groupBy("same_person").agg(F.sum("n").alias("count"), F.min("score").alias("min"), F.max("score").alias("max"), F.try_divide(F.sum(F.col("score") * F.col("n")), F.sum("n")).alias("mean")))  # two rows
    met = long.join(total, "same_person")
    # ranks from the top: (up - n, up] holds the middle ones
    holds = lambda k: F.max(F.when((F.col("up") - F.col("n") < k) & (k <= F.col("up")), F.col("score")))
    low, high = F.floor((F.col("count") + 1) / 2), F.floor(F.col("count") / 2) + 1
    return met.groupBy("same_person", "count", "min", "max", "mean").agg(((holds(low) + holds(high)) / 2).alias("median"))


def report(records: DataFrame, targets: list[float]) -> DataFrame:
    """One row with everything: the EER point, AUC, points at targets, summaries, the curve being left to `curve`."""
    points = curve(records)
    e = equal_error(points).select(F.struct("*").alias("equal_error"))
    t = at_targets(points, targets).agg(F.array_sort(F.collect_list(F.struct("target", "threshold", "far", "tar", "frr"))).alias("targets"))
    m = summary(records).agg(F.array_sort(F.collect_list(F.struct("same_person", "count", "min", "max", "mean", "median"))).alias("scores"))
    return e.crossJoin(auc(records)).crossJoin(t).crossJoin(m)  # one row each


#: Ranges of a group's distinct values that places are first sought in, and how many of them are passed over at a time.
RANKS, STEP = 256, 16


def nearest_rank(values: DataFrame, group: list[str], value: str, share: float = 0.95) -> DataFrame:
    """n, median, and the value at place round-half-even(share (n - 1)) from 0 (p95), for each group: a latency table.

    Values are counted, and the distinct ones cut into about RANKS ranges by approximate quantiles, which merge; the ranges' counts are
    exact, and only the values of the ranges that hold a place are ordered. Nulls are left out.
    """
    some = values.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    borders = some.groupBy(*group).agg(F.percentile_approx("_v", F.array(*(F.lit(k / RANKS) for k in range(1, RANKS))), F.lit(2000)).alias("_borders"))
    keys = [F.col(g).alias(f"_k{i}") for i, g in enumerate(group)]
    same = lambda: [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group)]
    # The range of a value is the number of borders below it: first among every STEP-th border, then among those up to the next of them.
    borders = borders.select(*keys, "_borders", F.filter("_borders", lambda x, i: (i + 1) % STEP == 0).alias("_coarse"))
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("_v")))
    placed = some.join(borders, same()).withColumn("_far", below("_coarse"))
    counts = placed.select(*group, "_v", "_n", (F.col("_far") * STEP + below(F.slice("_borders", F.col("_far") * STEP + 1, F.lit(STEP - 1)))).alias("_range"))
    ranges = counts.groupBy(*group, "_range").agg(F.sum("_n").alias("_m"))  # at most RANKS rows a group
    along, whole = Window.partitionBy(*group).orderBy("_range"), Window.partitionBy(*group)
    ranges = ranges.select(*group, "_range", (F.sum("_m").over(along) - F.col("_m")).alias("_before"), "_m", F.sum("_m").over(whole).alias("n"))
    places = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2), F.bround(share * (F.col("n") - 1)).cast("long"))
    ranges = ranges.select("*", F.filter(places, lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_m"))).alias("_own")).where(F.size("_own") > 0)
    near = counts.join(ranges.select(*keys, F.col("_range").alias("_r"), "_before", "n"), [*same(), F.col("_range") == F.col("_r")])
    within = Window.partitionBy(*group, "_range").orderBy("_v")
    ranked = near.select(*group, "n", "_v", (F.sum("_n").over(within) + F.col("_before")).alias("_upto"), "_n")
    at = lambda place: F.max(F.when((F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto")), F.col("_v")))
    n = F.col("n")
    return ranked.groupBy(*group, "n").agg(((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"), at(F.bround(share * (n - 1))).alias("p95"))
