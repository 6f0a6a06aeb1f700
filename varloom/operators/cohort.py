"""In which cohorts a change occurs, and how often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scoring_above(df: DataFrame, score: str, least: float = 0.1) -> DataFrame:
    """The rows whose score is more than `least`; unknown scores are not."""
    return df.filter((F.col(score) > least) & ~F.isnan(F.col(score).cast("double")))


def cohort_counts(df: DataFrame, keys: list[str], cohort: str) -> DataFrame:
    """keys, n_total and `n:cohort,...` with the largest count first, ties by cohort name.

    Counted by key and cohort first, so a group is never larger than the number
    of cohorts. A null cohort is left out.
    """
    counts = df.filter(F.col(cohort).isNotNull()).groupBy(*keys, cohort).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col(cohort).alias("cohort"))))
    text = F.array_join(F.transform(listed, lambda x: F.concat((-x["minus"]).cast("string"), F.lit(":"), x["cohort"])), ",")
    return counts.groupBy(*keys).agg(F.sum("n").alias("n_total"), text.alias("cohorts"))
