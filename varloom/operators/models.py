"""Scoring models: estimators of pyspark.ml over named feature columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.support import stored

#: Cells (combinations of binned features) up to which a forest is grown on their counts; beyond that Spark grows it on the rows.
CELLS = 1 << 20

#: Parts of 1 that shares are counted in, so that their sums are whole numbers and the same in any order.
UNIT = 1 << 40


def forest(features: list[str], label: str, trees: int = 2001, depth: int = 10, seed: int = 1) -> Pipeline:
    """A random forest; the score is the mean of the trees' class shares, not a count of votes."""
    return _pipeline(features, RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", maxMemoryInMB=1024, seed=seed))


def neural_net(features: list[str], label: str, hidden: int = 5, steps: int = 500, seed: int = 1) -> Pipeline:
    """A net with one hidden layer."""
    return _pipeline(features, MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[len(features), hidden, 2], maxIter=steps, seed=seed))


def linear_svm(features: list[str], label: str, cost: float = 0.01, steps: int = 100) -> Pipeline:
    """A linear support-vector classifier. It minimises hinge loss; ranking by average precision is not on offer in Spark."""
    return _pipeline(features, LinearSVC(featuresCol="features", labelCol=label, regParam=cost, maxIter=steps))


def _pipeline(features: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), estimator])


def scores(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """df with the model's score for class 1: its probability, or the margin where there is none."""
    out = model.transform(df)
    raw = "probability" if "probability" in out.columns else "rawPrediction"
    return out.select(*df.columns, vector_to_array(raw)[1].alias(name))


def fitted_scores(pipeline: Pipeline, df: DataFrame, name: str = "score") -> DataFrame:
    """scores() of df by the pipeline fitted on df; a forest is grown on cells where they are few.

    A forest sees nothing of a row but its label and the bins of its features.
    So it is grown on the counts of rows by bins and label, which are bounded
    however many rows there are: the number of a row's copies in a tree's sample
    is Poisson with mean 1, and that of n rows alike is Poisson with mean n.
    """
    assembler, estimator = pipeline.getStages()
    as_spark_does = lambda: scores(pipeline.fit(df), df, name)
    if not isinstance(estimator, RandomForestClassifier) or estimator.getFeatureSubsetStrategy() != "sqrt":
        return as_spark_does()
    features, label = assembler.getInputCols(), estimator.getLabelCol()
    rows = df.dropna(subset=features)
    limits = bin_limits(rows, features, estimator.getMaxBins())
    wide = np.cumprod([1, *[len(limits[f]) + 1 for f in features]])
    if wide[-1] >= 1 << 62:
        return as_spark_does()
    cell = F.lit(0).cast("long")
    for f, factor in zip(features, wide):
        for limit in limits[f]:
            cell = cell + F.when(F.col(f) > limit, F.lit(int(factor))).otherwise(F.lit(0))
    counts = stored(rows.groupBy(cell.alias("cell")).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"), F.count("*").alias("n")))
    size = counts.agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum(F.col("n0") + F.col("n1")).alias("known")).first()
    if not size.cells or size.cells > CELLS or size.n != size.known:
        return as_spark_does()
    table = counts.orderBy("cell").toArrow()
    keys, n0, n1 = (table.column(c).to_numpy() for c in ("cell", "n0", "n1"))
    bins = np.stack([keys // factor % (len(limits[f]) + 1) for f, factor in zip(features, wide)]).astype(np.int32)
    spark, trees, depth, seed = df.sparkSession, estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed()
    shared = spark.sparkContext.broadcast((bins, n0, n1))

    def grow(numbers: Iterator[int]) -> Iterator[np.ndarray]:
        total = None
        for tree in numbers:
            part = np.rint(tree_shares(*shared.value, depth, np.random.default_rng([seed, tree])) * UNIT).astype(np.int64)
            total = part if total is None else total + part
        if total is not None:
            yield total

    lots = min(trees, max(1, 4 * spark.sparkContext.defaultParallelism))
    sums = spark.sparkContext.parallelize(range(trees), lots).mapPartitions(grow).treeReduce(lambda a, b: a + b)
    found = spark.createDataFrame(pd.DataFrame({"__cell": keys, name: sums / (UNIT * trees)}))
    return rows.withColumn("__cell", cell).join(F.broadcast(found), "__cell").select(*df.columns, name)


def bin_limits(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """The limits of each feature's bins: between its values where they are few, else its quantiles over all rows."""
    shares = [i / bins for i in range(1, bins)]
    quantiles = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f) for f in features]).first()
    out = {}
    for f in features:
        values = sorted(float(r[0]) for r in df.select(f).distinct().limit(bins + 1).collect())
        out[f] = [(a + b) / 2 for a, b in zip(values, values[1:])] if len(values) <= bins else sorted(set(quantiles[f]))
    return out


def tree_shares(bins: np.ndarray, n0: np.ndarray, n1: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """For each cell the share of class 1 in its leaf of one tree, grown on a bootstrap sample of the cells' rows.

    `bins` has a row for each feature. The tree is grown as Spark grows it: by
    the Gini index, with the root of the number of features tried at each node,
    and two leaves under one node that stand for the same class become one.
    """
    ones = rng.poisson(n1).astype(float)
    weight = ones + rng.poisson(n0)
    sampled = np.nonzero(weight)[0]
    n_features, n_bins = len(bins), int(bins.max(initial=0)) + 1
    tried = int(np.ceil(np.sqrt(n_features)))
    total, positive = [np.array([weight.sum()])], [np.array([ones.sum()])]
    parent, split = [np.zeros(1, np.int64)], []
    at = np.zeros(bins.shape[1], np.int64)  # each cell's node, numbered within the level
    alive = np.ones(bins.shape[1], bool)  # cells that reached this level
    ends = np.zeros(bins.shape[1], np.int64)  # the level of each cell's last node
    for level in range(depth):
        w, p = total[level], positive[level]
        number = np.full(len(w), -1)
        open_nodes = np.nonzero((p > 0) & (p < w))[0]
        number[open_nodes] = np.arange(len(open_nodes))
        m = len(open_nodes)
        here = sampled[alive[sampled]]
        here = here[number[at[here]] >= 0]
        if not m or not len(here):
            split.append(np.zeros(len(w), bool))
            break
        local = number[at[here]] * n_bins
        allowed = np.argsort(rng.random((m, n_features)), axis=1).argsort(axis=1) < tried
        W, P = w[open_nodes], p[open_nodes]
        base = (P**2 + (W - P) ** 2) / W
        best, gain, left_w, left_p = np.zeros(m, np.int64), np.full(m, 1e-9), np.zeros(m), np.zeros(m)
        for f in range(n_features):
            key = local + bins[f, here]
            lw, lp = (np.cumsum(np.bincount(key, x[here], m * n_bins).reshape(m, n_bins), axis=1) for x in (weight, ones))
            rw, rp = W[:, None] - lw, P[:, None] - lp
            with np.errstate(divide="ignore", invalid="ignore"):
                g = (lp**2 + (lw - lp) ** 2) / lw + (rp**2 + (rw - rp) ** 2) / rw - base[:, None]
            g[(lw == 0) | (rw == 0) | ~allowed[:, f, None]] = 0
            b = g.argmax(axis=1)
            row = np.arange(m)
            better = g[row, b] > gain
            gain[better], best[better] = g[row, b][better], f * n_bins + b[better]
            left_w[better], left_p[better] = lw[row, b][better], lp[row, b][better]
        chosen = np.nonzero(gain > 1e-9)[0]
        split.append(np.isin(np.arange(len(w)), open_nodes[chosen]))
        if not len(chosen):
            break
        first = np.full(len(w), -1)
        first[open_nodes[chosen]] = 2 * np.arange(len(chosen))
        total.append(np.stack([left_w[chosen], W[chosen] - left_w[chosen]], axis=1).ravel())
        positive.append(np.stack([left_p[chosen], P[chosen] - left_p[chosen]], axis=1).ravel())
        parent.append(np.repeat(open_nodes[chosen], 2))
        of = np.zeros(len(w), np.int64)
        of[open_nodes] = best
        going = np.nonzero(alive & (first[at] >= 0))[0]
        alive[:] = False
        alive[going] = True
        rule = of[at[going]]
        at[going] = first[at[going]] + (bins[rule // n_bins, going] > rule % n_bins)
        ends[going] = level + 1
    split += [np.zeros(len(total[-1]), bool)] * (len(total) - len(split))
    # leaves of one class under one node, from the deepest level up
    for level in range(len(total) - 1, 0, -1):
        says = 2 * positive[level] > total[level]
        merged = ~split[level][0::2] & ~split[level][1::2] & (says[0::2] == says[1::2])
        split[level - 1][parent[level][0::2][merged]] = False
    # each node's share, or that of the merged node above it
    share = [positive[0] / max(total[0][0], 1.0)]
    inside = [np.zeros(1, bool)]
    for level in range(1, len(total)):
        up = parent[level]
        inside.append(inside[-1][up] | ~split[level - 1][up])
        share.append(np.where(inside[-1], share[-1][up], positive[level] / total[level]))
    out = np.zeros(bins.shape[1])
    for level in range(len(total)):
        mine = ends == level
        out[mine] = share[level][at[mine]]
    return out


def single_feature(pattern: str, df: DataFrame) -> Column:
    """The first feature whose name matches, as a score: the baseline of one feature."""
    return F.col(next(c for c in df.columns if pattern.lower() in c.lower()))
