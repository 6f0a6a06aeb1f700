"""Column statistics, standardizing against a control, and the linear discriminant."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardized(df: DataFrame, features: list[str], control: DataFrame | None = None) -> DataFrame:
    """df with each feature as (x - mean) / std of the control's rows, or of its own.

    std is the population's; a feature of no spread becomes 0 and null stays
    null. The statistics, two numbers per feature, become part of the plan.
    """
    source = df if control is None else control
    stats = source.agg(*[g(F.col(f)).alias(f"{n}_{f}") for f in features for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()

    def z(f: str) -> Column:
        mean, std = stats[f"m_{f}"], stats[f"s_{f}"]
        if not std:
            return F.when(F.col(f).isNotNull(), F.lit(0.0))
        return (F.col(f) - F.lit(mean)) / F.lit(std)

    return df.select(*[z(c).alias(c) if c in features else F.col(c) for c in df.columns])


def feature_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """(name, mean, variance): mean and sample variance of each feature, null variance below two values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select("x.*")
    return long.groupBy("name").agg(F.avg("value").alias("mean"), F.when(F.count("value") > 1, F.var_samp("value")).alias("variance"))


def discriminant(df: DataFrame, features: list[str], label: str) -> list[float]:
    """Weights of Fisher's discriminant: inverse(S1 + S0) (mean1 - mean0).

    Class means and sample covariances come from one aggregate per class; only
    those numbers reach the driver, where the small system is solved. Rows with
    a null feature or label do not count; a feature without spread weighs 0.
    """
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    whole = df.select(F.col(label).alias("__y"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    rows = whole.groupBy("__y").agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs]).collect()
    by = {int(r["__y"]): r for r in rows}
    spread = np.zeros((len(features), len(features)))
    for r in by.values():
        for a, b in pairs:
            i, j = features.index(a), features.index(b)
            spread[i, j] += r[f"c_{a}_{b}"]
            spread[j, i] = spread[i, j]
    apart = np.array([by[1][f"m_{f}"] - by[0][f"m_{f}"] for f in features])
    return [float(x) for x in np.linalg.lstsq(spread, apart)[0]]


def weighted_sum(features: list[str], weights: list[float]) -> Column:
    total = F.lit(0.0)
    for f, w in zip(features, weights):
        total = total + F.col(f) * F.lit(w)
    return total


def without_families(df: DataFrame, families: dict[str, list[str]], family: str) -> DataFrame:
    """df without the features of one family, for ablation."""
    return df.drop(*families[family])
