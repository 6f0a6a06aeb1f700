"""Points in intervals: a binned equi-join in place of a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.support import small

#: Width of a bin. Wide enough that a long interval falls into few bins.
BIN = 1 << 16


def point_in_interval(points: DataFrame, intervals: DataFrame, key: str, pos: str, start: str, end: str, bin_width: int = BIN) -> DataFrame:
    """Every pair with equal keys and start < pos <= end (0-based half-open intervals, 1-based points).

    Intervals are spread over the bins they touch and points fall into one, so
    that Spark joins by key and bin and checks the bounds on what meets. The
    spread intervals, computed once, are broadcast where few were measured; else both
    sides are shuffled, where adaptive execution splits a hot bin. Null keys,
    positions and bounds match nothing, nor do intervals that end before they
    start. Names on both sides must differ but for the key.
    """
    bins = F.sequence(F.floor((F.col(start) + 1) / bin_width), F.floor(F.col(end) / bin_width))
    spread = intervals.filter(F.col(start) < F.col(end)).withColumn("__bin", F.explode(bins))
    binned = points.filter(F.col(pos).isNotNull()).withColumn("__bin", F.floor(F.col(pos) / bin_width))
    joined = binned.join(small(spread), [key, "__bin"])
    return joined.filter((F.col(start) < F.col(pos)) & (F.col(pos) <= F.col(end))).drop("__bin")


def best_per(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order, which should end in a tiebreak.

    Values to order by must be negated where the largest is wanted. A minimum
    with a partial step, so that a group has shrunk before the shuffle.
    """
    best = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct("*").alias("row"))).alias("best")
    return df.groupBy(*[F.col(b).alias(f"__by_{b}") for b in by]).agg(best).select("best.row.*")


def unique_per(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows of groups that have just one."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).filter("__n = 1").drop("__n")


def segment_offsets(segments: Column, strand: Column) -> Column:
    """The segments (struct<start, end>) in the direction of the strand, with the bases `before` each."""
    ordered = F.when(strand == "-", F.reverse(F.array_sort(segments))).otherwise(F.array_sort(segments))
    lengths = F.transform(ordered, lambda s: s["end"] - s["start"])
    return F.transform(
        ordered,
        lambda s, i: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x).alias("before")
        ),
    )


def premrna_offset(pos: Column, tx_start: Column, tx_end: Column, strand: Column) -> Column:
    """0-based place of a genome position in the transcript; null outside it or without a strand."""
    inside = (tx_start < pos) & (pos <= tx_end)
    return F.when(inside & (strand == "+"), pos - tx_start - 1).when(inside & (strand == "-"), tx_end - pos)


def premrna_position(offset: Column, tx_start: Column, tx_end: Column, strand: Column) -> Column:
    """The genome position of a place in the transcript; the inverse of premrna_offset."""
    inside = (offset >= 0) & (offset < tx_end - tx_start)
    return F.when(inside & (strand == "+"), offset + tx_start + 1).when(inside & (strand == "-"), tx_end - offset)


def cds_offset(pos: Column, segments: Column, strand: Column) -> Column:
    """0-based place of a genome position in the spliced coding sequence; null in introns. `segments` as from segment_offsets."""
    here = F.get(F.filter(segments, lambda s: (s["start"] < pos) & (pos <= s["end"])), F.lit(0))
    return here["before"] + F.when(strand == "-", here["end"] - pos).otherwise(pos - here["start"] - 1)


def cds_position(offset: Column, segments: Column, strand: Column) -> Column:
    """The genome position of a place in the spliced coding sequence; the inverse of cds_offset."""
    here = F.get(F.filter(segments, lambda s: (s["before"] <= offset) & (offset < s["before"] + s["end"] - s["start"])), F.lit(0))
    return F.when(strand == "-", here["end"] - (offset - here["before"])).otherwise(here["start"] + 1 + offset - here["before"])
