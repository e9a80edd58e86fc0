"""Mixing sources to target weights, in DataFrame operations only: Pareto order sampling after certain whole copies.

A source whose target is r times its words owes each of its documents floor(r) certain copies. What its target still lacks is sampled, with
inclusion in proportion to size: a document of s words has inclusion min(1, s/T), T being the size that makes the expected words those
that lack. Documents of T words or more are certain; the others are ranked by random odds over inclusion odds, u/(1-u) over
l/(1-l), and the first ones are taken until their words are as near as may be to what lacks: a sample of fixed size (in words) with
unequal probabilities. u is a function of doc_id and a seed, so that reruns agree.

No source is ever ranked in one task. The rank's logarithm is cut into RANGES ranges; their words are summed for each source, the range
where the cut falls is cut into RANGES ranges again, LEVELS times. Ranges below the cut are taken whole, and only the documents in the last
range where it falls (one part in RANGES^LEVELS of the scale) are ordered. Sources themselves, however many, are ordered in ranges too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, forget, written

RANGES, LEVELS = 256, 3
#: The logarithm of a rank lies within these bounds: u has 52 bits, and a text fewer than 2^40 words.
LOW, HIGH = -64.0, 64.0
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int, text: Column | None = None) -> Column:
    """52 bits of a digest of doc_id, in (0, 1); a null doc_id draws by the digest of its text."""
    said = doc_id.cast("string") if text is None else F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), said)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def placed(rows: DataFrame, order: list[Column], sums: dict[str, str], place: str) -> DataFrame:
    """rows with their place (from 1) in an order, and for each sum the total of a column over the rows before: ranges of the order are placed by themselves, after the totals of the ranges before them."""
    parts = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    totals = parts.groupBy("_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select(F.col("_range").alias("_r"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ("_n", *(f"_sum_{k}" for k in sums))))
    within = Window.partitionBy("_range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(totals), F.col("_range") == F.col("_r"))
    own = {place: F.row_number().over(within) + F.col("_before_n")} | {k: F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"_before_sum_{k}") for k, c in sums.items()}
    return out.select(*rows.columns, *(c.alias(k) for k, c in own.items()))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """From (source, source_size), one row for each source: target added.

    Weights go round the sources in code-point order, null last. Sources reach `most` times their size in the order of
    size by weight; each is held there if the level of those not yet held exceeds it, which is what resharing ends in.
    """
    ranked = placed(sizes, [F.col("source").asc_nulls_last()], {}, "_k")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_k") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("_w", weight).withColumn("_ratio", F.col("source_size") / F.col("_w"))
    level = placed(ranked, [F.col("_ratio"), F.col("_k")], {"_held": "source_size", "_held_w": "_w"}, "_place")
    whole = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
    level = level.withColumn("_level", F.try_divide(F.lit(whole["all"]) - F.col("_held") * most, F.lit(whole["w"]) - F.col("_held_w")))
    # The level falls from the first source that is not held on; those before it are held.
    cut = level.where(~(most * F.col("source_size") <= F.col("_level") * F.col("_w"))).agg(F.min(F.struct("_place", "_level")).alias("cut")).first()["cut"]
    held = (most * F.col("source_size")).cast("double")
    target = held if cut is None else F.when(F.col("_place") < cut["_place"], held).otherwise(F.lit(cut["_level"]) * F.col("_w"))
    return level.select("source", "source_size", target.alias("target"))


def certain_from(narrow: DataFrame, goals: DataFrame) -> DataFrame:
    """_s, _t: for each source that lacks words, the size T from which its documents are certain: the words expected, of min(1, size / T) of each document, are what it lacks.

    Sizes are counted first, and only the distinct ones of a source are ordered.
    """
    sizes = narrow.where(F.col("size") > 0).groupBy("_source", "size").agg(F.count("*").alias("n"))
    met = sizes.join(goals.where(F.col("_lack") > 0).select("_goal", "_lack", "source_size"), F.col("_source").eqNullSafe(F.col("_goal")))
    w = Window.partitionBy("_source").orderBy("size")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    told = met.select("_source", "_lack", "size", F.sum(F.col("n").cast("double") * F.col("size") * F.col("size")).over(upto).alias("squares"), (F.col("source_size") - F.sum(F.col("n") * F.col("size")).over(upto)).alias("larger"), F.lead("size").over(w).alias("next"))
    told = told.withColumn("t", F.when(F.col("_lack") > F.col("larger"), F.col("squares") / (F.col("_lack") - F.col("larger"))))
    fits = told.where(F.col("t").isNotNull() & (F.col("next").isNull() | (F.col("t") < F.col("next"))))
    return fits.groupBy(F.col("_source").alias("_s")).agg(F.min_by("t", "size").alias("_t"))


def mixed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0, ranges: int = RANGES, levels: int = LEVELS) -> DataFrame:
    """The columns `keep` of docs, and size, source_size, target, taken, inclusion (of one copy more than the certain ones), _copies, one row for each row given.

    A null text has no words; rows without words are never taken. Null is a source of its own. Rows with the same doc_id
    have the same u; ties are broken by size, and rows equal in both are taken in any order. A null doc_id draws by its text. An empty
    table gives an empty table.
    """
    u, size = F.col("_u"), F.col("size")
    rows = docs.select(*keep, F.col("source").alias("_source"), n_words(F.col("text")).alias("size"), uniform(F.col("doc_id"), seed, F.col("text")).alias("_u"))
    narrow = written(rows.select("_source", "size", "_u"), "mix-sizes")
    told = written(narrow.groupBy("_source").agg(F.sum("size").alias("source_size")), "mix-sources")
    goals = targets(told.select(F.col("_source").alias("source"), "source_size"), weights, most)
    goals = goals.withColumn("_sure", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long"))
    goals = written(goals.withColumn("_lack", F.col("target") - F.col("_sure") * F.col("source_size")).withColumnRenamed("source", "_goal"), "mix-lacks")
    goals = goals.join(certain_from(narrow, goals), F.col("_goal").eqNullSafe(F.col("_s")), "left").drop("_s")
    cut = written(goals.withColumns({"_first": F.lit(0).cast("long"), "_last": F.lit(ranges**levels - 1).cast("long"), "_below": F.lit(0).cast("long")}), "mix-goals")

    def ranked(some: DataFrame) -> DataFrame:
        """With _t: inclusion, rank, and the path of ranges of its logarithm, one number a level: floor(ranges x), floor(ranges of what is left), and so on."""
        some = some.withColumn("inclusion", F.when(size > 0, F.coalesce(F.least(F.lit(1.0), size / F.col("_t")), F.lit(0.0))).otherwise(0.0))
        rank = F.when(F.col("inclusion") >= 1, 0.0).when(F.col("inclusion") > 0, u / (1 - u) * ((1 - F.col("inclusion")) / F.col("inclusion")))
        some = some.withColumn("_rank", rank)
        log = F.when(F.col("_rank") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1 - 1e-9), (F.log("_rank") - LOW) / (HIGH - LOW)))).when(F.col("_rank") == 0, 0.0)
        return some.withColumn("_path", F.floor(log * float(ranges**levels)).cast("long"))

    met = lambda some, *more: some.join(cut.select("_goal", "_t", *more), F.col("_source").eqNullSafe(F.col("_goal")), "left").drop("_goal")
    last = narrow
    narrow = written(ranked(met(narrow)).select("_source", "_path", "size").where(F.col("_path").isNotNull()), "mix-paths")
    forget(last)
    for level in range(levels - 1, -1, -1):
        width = ranges**level
        inside = narrow.join(cut.select("_goal", "_first", "_last"), F.col("_source").eqNullSafe(F.col("_goal")) & F.col("_path").between(F.col("_first"), F.col("_last")))
        summed = inside.groupBy("_goal", F.expr(f"_path div {width}").alias("_part")).agg(F.sum("size").alias("_words"))  # at most `ranges` rows a source
        at = Window.partitionBy("_goal").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        summed = summed.withColumn("_sum", F.coalesce(F.sum("_words").over(at), F.lit(0))).withColumnRenamed("_goal", "_s")
        here = (F.col("_below") + F.col("_sum") <= F.col("_lack")) & (F.col("_lack") < F.col("_below") + F.col("_sum") + F.col("_words"))
        last = cut
        step = cut.join(summed, F.col("_goal").eqNullSafe(F.col("_s"))).where(here)
        step = step.select(F.col("_goal").alias("_s"), (F.col("_part") * width).alias("_a"), (F.col("_part") * width + width - 1).alias("_z"), (F.col("_below") + F.col("_sum")).alias("_b"))
        # A source without a cut (nothing to sample) keeps no range: it ends in one that lies below all.
        cut = cut.join(step, F.col("_goal").eqNullSafe(F.col("_s")), "left").drop("_s")
        cut = cut.withColumns({"_first": F.coalesce("_a", F.lit(-1)), "_last": F.coalesce("_z", F.lit(-1)), "_below": F.coalesce("_b", F.lit(0))}).drop("_a", "_z", "_b")
        cut = written(cut, "mix-goals")
        forget(last)
    rows = ranked(met(rows, "source_size", "target", "_sure", "_lack", "_first", "_below"))
    in_cut = F.coalesce(F.col("_path") == F.col("_first"), F.lit(False))
    # Every range but that of the cut is decided by its number. Only the latter's rows go to the window below.
    sure = rows.where(~in_cut).withColumn("_extra", F.when(F.col("_path") < F.col("_first"), F.lit(1)).otherwise(F.lit(0)))
    order = Window.partitionBy("_source").orderBy("_rank", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.where(in_cut).withColumn("_before", F.col("_below") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    near = near.withColumn("_extra", F.when(F.col("_lack") - F.col("_before") >= size / 2, F.lit(1)).otherwise(F.lit(0))).drop("_before")
    both = sure.unionByName(near)
    copies = F.when(size > 0, F.col("_sure") + F.col("_extra")).otherwise(F.lit(0)).cast("long")
    return both.withColumn("_copies", copies).select(*keep, "size", "source_size", "target", (size * F.col("_copies")).alias("taken"), "inclusion", "_copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, with the columns of docs and their values, whatever the columns are called.

    Rows without words (null or empty texts) are never taken; a repeated row is taken as often for each of its copies. An
    empty table gives an empty table.
    """
    held = docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("_row"), F.col("doc_id"), F.col("source"), F.col("text"))
    taken = mixed(held, keep=("_row",), **how).where(F.col("_copies") > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).select("_row.*")
