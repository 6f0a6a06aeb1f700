"""Repeated, grouped and overlapping splits for benchmarks; every choice is a seeded hash."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.support import small, stored


def shuffled(seed: int, *ids: str) -> Column:
    """A key that orders rows at random but alike in every engine and run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def hash_half(seed: int, *ids: str) -> Column:
    """True for about half of the rows, by the first hexadecimal digit of their key."""
    return F.substring(shuffled(seed, *ids), 1, 1) < "8"


def grouped_splits(df: DataFrame, row_id: str, label: str, group: str, iterations: int, seed: int = 1) -> DataFrame:
    """(iteration, row_id, role): per iteration test rows by half of each class, and training rows.

    Positives are drawn for the test set one by one; of the positives, those
    whose group has none in the test set train, so that no group stands on both
    sides; a null group shares nothing. Negatives that are not drawn train.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.col(label).alias("label"), F.col(group).alias("group")).filter("label IN (0, 1)")
    repeated = rows.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    drawn = repeated.withColumn("is_test", hash_half(seed, "iteration", "row_id"))
    tested = drawn.filter("is_test AND label = 1").select("iteration", "group").distinct()
    train = drawn.filter("label = 0 AND NOT is_test").unionByName(drawn.filter("label = 1 AND NOT is_test").join(tested, ["iteration", "group"], "left_anti").select(drawn.columns))
    both = train.withColumn("role", F.lit("train")).unionByName(drawn.filter("is_test").withColumn("role", F.lit("test")))
    return both.select("iteration", "row_id", "role")


def first_of_each(rows: DataFrame, by: list[str], key: str, row_id: str, share: float) -> DataFrame:
    """rows with `first`: whether a row is among the first floor(share * n) of its group by (key, row_id); `key` is a hexadecimal text.

    Rows are counted by group and the first four digits of the key. Of those
    counts one row a group is left, the digits at the bound and how many rows
    are first there. It is what rows are held against, so no row is shuffled or
    sorted but those at the bound.
    """
    digits = rows.withColumn("__lot", F.substring(key, 1, 4))
    lots = digits.groupBy(*by, "__lot").agg(F.count("*").alias("__n"))
    every, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)
    left = (F.floor(F.sum("__n").over(every) * share) - F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__left")
    reached = lots.select(*by, "__lot", "__n", left).filter(F.col("__left") > 0)
    # the last digits of which any row is first
    bounds = reached.groupBy(*by).agg(F.max(F.struct("__lot", "__left")).alias("__bound"))
    placed = digits.join(small(bounds), by, "left")
    at = F.col("__lot") == F.col("__bound")["__lot"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(key, row_id))
    at_bound = placed.filter(at).withColumn("first", rank <= F.col("__bound")["__left"])
    others = placed.filter(~F.coalesce(at, F.lit(False))).withColumn("first", F.coalesce(F.col("__lot") < F.col("__bound")["__lot"], F.lit(False)))
    return at_bound.unionByName(others).select(*rows.columns, "first")


def stratified_splits(df: DataFrame, row_id: str, label: str, group: str, iterations: int, test_share: float = 0.5, seed: int = 1) -> DataFrame:
    """(iteration, row_id, role): per iteration floor(test_share * n) rows of each class for testing, and training rows.

    The rows of a class are drawn in the order of a seeded hash, ties by id.
    Positives whose group has none in the test set train, a null group shares
    nothing, and so do all negatives that are not drawn. Row ids are unique.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.col(label).alias("label"), F.col(group).alias("group")).filter("label IN (0, 1)")
    repeated = rows.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("key", shuffled(seed, "iteration", "row_id"))
    drawn = first_of_each(repeated, ["iteration", "label"], "key", "row_id", test_share)
    tested = drawn.filter("first AND label = 1").select("iteration", "group").distinct()
    spared = drawn.filter("label = 1 AND NOT first").join(tested, ["iteration", "group"], "left_anti").select("iteration", "row_id", F.lit("train").alias("role"))
    others = drawn.filter("first OR label = 0").select("iteration", "row_id", F.when(F.col("first"), "test").otherwise("train").alias("role"))
    return others.unionByName(spared)


def left_out(compact: DataFrame, major: int, replicate: int) -> DataFrame:
    """(row_id, role): the training and test set of one held-out positive, from the compact form of leave_one_out().

    The positive is tested with the replicate's test negatives; all other
    positives train with its training negatives.
    """
    role = F.when(F.col("major").isNull(), F.col("role")).when(F.col("major") == major, "test").otherwise("train")
    return compact.filter(F.col("replicate") == replicate).select("row_id", role.alias("role"))


def leave_one_out(df: DataFrame, row_id: str, label: str, replicates: int, seed: int = 1) -> DataFrame:
    """(major, replicate, row_id, role) in compact form: one held-out positive per (major, replicate).

    Rows are listed per replicate, not per positive: `major` is the positive's
    id for its own test row and null for the negatives, whose half in test is
    the same for every positive of that replicate. The training positives of a
    major are all others.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.col(label).alias("label")).filter("label IN (0, 1)")
    repeated = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return repeated.select(
        F.when(F.col("label") == 1, F.col("row_id")).alias("major"),
        "replicate",
        "row_id",
        F.when((F.col("label") == 1) | hash_half(seed, "replicate", "row_id"), "test").otherwise("train").alias("role"),
    )


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """df with the place of each row in the given order, from 0; the order should be total.

    Rows are laid into sorted ranges; a row's place is its place in its range
    and the rows of the ranges before, of which there is one count a range.
    """
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = ranged.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.select(*df.columns, (F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def subsets_by_position(df: DataFrame, row_id: str, n: int = 2, d: int = 4) -> DataFrame:
    """(subset, row_id): every choice of n of d residue classes of the rows' places by id gives a subset."""
    placed = with_position(df.select(F.col(row_id).alias("row_id")), ["row_id"])
    return overlapping_subsets(placed, "position", n, d, ["row_id"]).select("subset", F.col("kept_row_id").alias("row_id"))


def overlapping_subsets(df: DataFrame, row_id: str, n: int = 2, d: int = 4, keep: list[str] | None = None) -> DataFrame:
    """(subset, row_id): every choice of n of d residue classes of the ids gives a subset."""
    chosen = F.array(*[F.struct(F.lit("".join(map(str, c))).alias("subset"), F.array(*map(F.lit, c)).alias("classes")) for c in combinations(range(d), n)])
    also = [F.col(k).alias(f"kept_{k}") for k in keep or []]
    exploded = df.select(F.col(row_id).alias("row_id"), *also, F.explode(chosen).alias("c"))
    return exploded.filter(F.array_contains("c.classes", F.pmod(F.col("row_id"), F.lit(d)).cast("int"))).select("c.subset", "row_id", *[f"kept_{k}" for k in keep or []])
