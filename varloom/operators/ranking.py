"""Ranks that share ties, their labels, and what is counted over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.support import stored

#: Cutoffs that one task of a whole curve runs through.
BLOCK = 65_536

# Least scores of the labels.
LIKELY, POTENTIALLY = 0.48, 0.28


def _rows_above(counts: DataFrame, score: str, by: list[str]) -> DataFrame:
    """counts (by, score, __n), one row per score, with `__above`: the rows of the group whose score is larger.

    The counts are laid out by ranges of group and score, as many as the
    session has shuffle partitions and adaptive execution finds worth while, so
    a large group spans many. The running count is taken within each range, and
    the totals of the group's higher ranges are added: no task sorts a group.
    """
    placed = stored(counts).repartitionByRange(*by, F.desc(score)).withColumn("__range", F.spark_partition_id())
    ranged = stored(placed)
    totals = ranged.groupBy(*by, "__range").agg(F.sum("__n").alias("__total"))
    higher = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__range", F.coalesce(F.sum("__total").over(higher), F.lit(0)).alias("__higher"))
    within = Window.partitionBy(*by, "__range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    both = ranged.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(offsets, [*by, "__range"])
    return both.select(*by, score, "__n", (F.col("__higher") + F.col("__before")).alias("__above"))


def _known(df: DataFrame, score: str) -> DataFrame:
    return df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def _all_known(by: list[str]) -> Column:
    return F.greatest(*[F.col(b).isNull().cast("int") for b in by], F.lit(0), F.lit(0)) == 0


def average_rank(df: DataFrame, score: str, by: list[str], rank: str = "rank") -> DataFrame:
    """df with the 1-based rank of each score in its group, the highest first, ties sharing the mean of their places.

    Equal scores are counted first, so a hot score is one row by the time it is
    ranked. A null or NaN score has no rank and counts for none; rows with a
    null in `by` have none either.
    """
    known = _known(df, score).filter(_all_known(by))
    counts = known.groupBy(*by, score).agg(F.count("*").alias("__n"))
    ranks = _rows_above(counts, score, by).select(*by, score, (F.col("__above") + (F.col("__n") + 1) / 2).alias(rank))
    return df.join(ranks, [*by, score], "left")


def rank_against(cases: DataFrame, controls: DataFrame, score: str, by: list[str], rank: str = "rank") -> DataFrame:
    """cases with the average rank of each case's score among itself and all controls of its group.

    Controls are counted by score; cases join in as scores of no weight, and
    one running count over both answers every case.
    """
    asked = _known(cases, score).select(*by, score).distinct().withColumn("__n", F.lit(0).cast("long"))
    counts = _known(controls, score).groupBy(*by, score).agg(F.count("*").alias("__n")).unionByName(asked).groupBy(*by, score).agg(F.sum("__n").alias("__n"))
    ranks = _rows_above(counts, score, by).select(*by, score, (F.col("__above") + (F.col("__n") + 2) / 2).alias(rank))
    return cases.join(ranks, [*by, score], "left")


def score_label(score: Column) -> Column:
    return F.when(score >= LIKELY, "likely pathogenic").when(score >= POTENTIALLY, "potentially pathogenic").when(score.isNotNull(), "likely benign")


def rank_text(rank: Column) -> Column:
    """One decimal, dropped where it is 0; ranks are whole or half numbers."""
    return F.regexp_replace(F.format_string("%.1f", rank), r"\.0$", "")


def hits_at_cutoffs(ranked: DataFrame, replicate: str, rank: str, cutoffs: int) -> DataFrame:
    """(replicate, k, hits): how many rows of each replicate have a rank of at most k, for k from 1 to cutoffs.

    Only rows within the last cutoff are looked at, and they are counted by
    rank before the running sum.
    """
    first = ranked.filter(F.col(rank) <= cutoffs).groupBy(replicate, F.greatest(F.lit(1), F.ceil(rank)).cast("int").alias("k")).agg(F.count("*").alias("n"))
    grid = ranked.select(replicate).distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(cutoffs))))
    running = Window.partitionBy(replicate).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(first, [replicate, "k"], "left").select(replicate, "k", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("hits"))


def recall_leave_one_out(ranked: DataFrame, major: str, replicate: str, rank: str) -> DataFrame:
    """(k, hits, mean_hits): positives with a rank of at most k over all replicates, and per replicate.

    One held-out positive per (major, replicate) row. k runs from 1 to the
    number of majors; hits are divided by the number of replicates.
    """
    sizes = ranked.agg(F.count_distinct(major).alias("end"), F.count_distinct(replicate).alias("replicates")).withColumn("every", F.lit(0))
    hits = hits_at_all_cutoffs(ranked.withColumn("every", F.lit(0)), sizes.select("every", "end"), "every", rank)
    return hits.join(F.broadcast(sizes.select("every", "replicates")), "every").select("k", "hits", (F.col("hits") / F.col("replicates")).alias("mean_hits"))


def recall_by_replicate(ranked: DataFrame, major: str, replicate: str, rank: str, replicates: list) -> DataFrame:
    """(k, one column of hits per listed replicate): the leave-one-out curve of each replicate beside the others."""
    ends = ranked.groupBy(replicate).agg(F.count_distinct(major).alias("end"))
    return hits_at_all_cutoffs(ranked, ends, replicate, rank).groupBy("k").pivot(replicate, replicates).agg(F.first("hits"))


def random_area(positives: Column, rows: Column, limit: float) -> Column:
    """The area up to the limit under the curve of a random order, a line through the origin that reaches all positives at the last row."""
    return positives / rows * limit * limit / 2


def score_text(score: Column) -> Column:
    """Three decimals of the binary value itself, as C prints it; Spark's own formatting rounds the shortest decimal text."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.3f}")

    return text(score.cast("double"))


def recall_curve(ranked: DataFrame, replicate: str, rank: str, cutoffs: int) -> DataFrame:
    """(k, mean_hits): the hits within each cutoff, averaged over the replicates."""
    return hits_at_cutoffs(ranked, replicate, rank, cutoffs).groupBy("k").agg(F.avg("hits").alias("mean_hits"))


def hits_at_all_cutoffs(ranked: DataFrame, ends: DataFrame, replicate: str, rank: str) -> DataFrame:
    """(replicate, k, hits): the rows of each replicate with a rank of at most k, for k from 1 to its own `end` in ends (replicate, end).

    Curves are cut into blocks of cutoffs; the running sum is taken within a
    block and the hits of the blocks before are added, so that no task holds a
    whole curve.
    """
    block = F.floor((F.col("k") - 1) / BLOCK).cast("long").alias("block")
    blocks = ends.filter("end >= 1").select(replicate, "end", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - 1) / BLOCK).cast("long"))).alias("block"))
    grid = blocks.repartition(replicate, "block").select(replicate, F.explode(F.sequence(F.col("block") * BLOCK + 1, F.least("end", (F.col("block") + 1) * BLOCK))).alias("k"), "block", F.lit(0).cast("long").alias("n"))
    counts = ranked.filter(F.col(rank).isNotNull()).groupBy(replicate, F.greatest(F.lit(1), F.ceil(rank)).cast("long").alias("k")).agg(F.count("*").alias("n")).select(replicate, "k", block, "n")
    totals = blocks.select(replicate, "block", F.lit(0).cast("long").alias("n")).unionByName(counts.select(replicate, "block", "n")).groupBy(replicate, "block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(replicate).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(replicate, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    running = Window.partitionBy(replicate, "block").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
    both = grid.withColumn("asked", F.lit(True)).unionByName(counts.withColumn("asked", F.lit(False)))
    within = both.withColumn("within", F.sum("n").over(running)).filter("asked")
    return within.join(offsets, [replicate, "block"], "left").select(replicate, "k", (F.coalesce("before", F.lit(0)) + F.col("within")).alias("hits"))


def reciprocal_rank(df: DataFrame, ranks: list[str]) -> Column:
    """The mean of 1 / rank over several models."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + 1 / F.col(r)
    return total / len(ranks)


def area(curve: DataFrame, by: str, x: str, y: str, limit: float) -> DataFrame:
    """(by, area): trapezoid area of each curve from its first x to the limit, the last step cut off by interpolation."""
    w = Window.partitionBy(by).orderBy(x)
    steps = curve.select(by, F.col(x).alias("x1"), F.col(y).alias("y1"), F.lag(x).over(w).alias("x0"), F.lag(y).over(w).alias("y0")).filter("x0 IS NOT NULL").filter(F.col("x0") < limit)
    end = F.least(F.col("x1"), F.lit(limit))
    at_end = F.col("y0") + (F.col("y1") - F.col("y0")) * (end - F.col("x0")) / (F.col("x1") - F.col("x0"))
    return steps.groupBy(by).agg(F.sum((end - F.col("x0")) * (F.col("y0") + at_end) / 2).alias("area"))
