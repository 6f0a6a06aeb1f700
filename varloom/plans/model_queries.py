"""Registered queries on ranks, splits, statistics and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators import cohort, models, ranking, splits, standardize
from varloom.sources.tables import svm_line
from varloom.support import table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

#: Ranks that curves go up to in the queries whose SQL ends there; rank_recall_split_all and rank_recall_each_all have no such end.
CUTOFFS = 60


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "split_rows").select("row_id", "split_name", "source", "label_class", "score", (F.col("pos") % 997).cast("double").alias("second"))


def rank_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored example with its rank and label, as the final report lists them."""
    ranked = ranking.average_rank(_scored(spark, sf_dir), "score", []).filter("rank IS NOT NULL")
    return ranked.select(ranking.rank_text(F.col("rank")).alias("rank"), "score", ranking.score_label(F.col("score")).alias("label"), "row_id")


def rank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best examples, ties by id."""
    return rank_report(spark, sf_dir).orderBy(F.desc("score"), "row_id").limit(10)


def rank_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.average_rank(_scored(spark, sf_dir), "score", ["source"]).select("row_id", "source", "rank")


def rank_against_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return ranking.rank_against(rows.filter("label_class = 1"), rows.filter("label_class = 0"), "score", ["source"]).select("row_id", "source", "rank")


def _positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.average_rank(_scored(spark, sf_dir), "score", ["source"]).filter("label_class = 1")


def rank_recall_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.recall_curve(_positives(spark, sf_dir), "source", "rank", CUTOFFS).select("k", F.round("mean_hits", 9).alias("mean_hits"))


def rank_recall_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one positive at a time against the controls of its source, the leave-one-out curve."""
    return ranking.hits_at_cutoffs(rank_against_control(spark, sf_dir), "source", "rank", CUTOFFS)


def rank_recall_split_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall curve over every cutoff, up to one less than the ranked rows of the largest source; smaller sources keep all their hits."""
    ranked = ranking.average_rank(_scored(spark, sf_dir), "score", ["source"])
    sources = ranked.groupBy("source").agg(F.count("rank").alias("n"), F.count_if(F.col("label_class") == 1).alias("positives")).filter("positives > 0")
    ends = sources.agg((F.max("n") - 1).alias("end"), F.count("*").alias("replicates")).withColumn("every", F.lit(0))
    positives = ranked.filter("label_class = 1").withColumn("every", F.lit(0))
    hits = ranking.hits_at_all_cutoffs(positives, ends.select("every", "end"), "every", "rank")
    return hits.join(F.broadcast(ends.select("every", "replicates")), "every").select("k", F.round(F.col("hits") / F.col("replicates"), 9).alias("mean_hits"))


def rank_recall_each_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leave-one-out curve over every cutoff, up to the number of positives of the source."""
    cases = rank_against_control(spark, sf_dir)
    return ranking.hits_at_all_cutoffs(cases, cases.groupBy("source").agg(F.count("*").alias("end")), "source", "rank")


def rank_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' ranks joined into the mean of their reciprocals."""
    both = ranking.average_rank(ranking.average_rank(_scored(spark, sf_dir), "score", [], "first_rank"), "second", [], "second_rank")
    return both.select("row_id", F.round(ranking.reciprocal_rank(both, ["first_rank", "second_rank"]), 12).alias("mrr"))


def rank_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = ranking.hits_at_cutoffs(_positives(spark, sf_dir), "source", "rank", CUTOFFS)
    return ranking.area(curve, "source", "k", "hits", 25.0)


def rank_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source's positives that rank within 5, 10, 25 and 50."""
    p = _positives(spark, sf_dir)
    return p.groupBy("source").agg(*[F.round(F.avg(F.coalesce(F.col("rank") <= t, F.lit(False)).cast("int")), 9).alias(f"within_{t}") for t in (5, 10, 25, 50)])


def std_against_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(*KEYS, "l_returnflag", *FEATURES)
    z = standardize.standardized(t, FEATURES, t.filter("l_returnflag = 'N'"))
    return z.select(*KEYS, *[F.round(f, 6).alias(f) for f in FEATURES])


def std_feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = standardize.feature_stats(table(spark, sf_dir, "lineitem"), FEATURES)
    return stats.select("name", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"))


def std_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples' two scores as rows (variable, value)."""
    return _scored(spark, sf_dir).unpivot("row_id", ["score", "second"], "variable", "value")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_returnflag IN ('R', 'A')").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))


def std_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled row's score on the discriminant of two features."""
    t, two = _labelled(spark, sf_dir), ["l_quantity", "l_discount"]
    return t.select(*KEYS, "label", F.round(standardize.weighted_sum(two, standardize.discriminant(t, two, "label")), 8).alias("score"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.sources.variants import bare_chrom

    t = table(spark, sf_dir, "split_rows")
    return t.withColumn("locus", F.concat_ws(":", bare_chrom(F.col("chrom")), F.floor(F.col("pos") / 1_000_000).cast("string")))


def split_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped_splits(_examples(spark, sf_dir), "row_id", "label_class", "locus", 5)


def split_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leave_one_out(_examples(spark, sf_dir), "row_id", "label_class", 3)


def split_grouped_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped splits in the 50 iterations of the benchmark."""
    return splits.grouped_splits(_examples(spark, sf_dir), "row_id", "label_class", "locus", 50)


def split_leave_one_out_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out splits in the 10 replicates of the benchmark."""
    return splits.leave_one_out(_examples(spark, sf_dir), "row_id", "label_class", 10)


def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped splits with a given share of each class in the test set."""
    return splits.stratified_splits(_examples(spark, sf_dir), "row_id", "label_class", "locus", 5, 0.3)


def split_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping subsets by the rows' places."""
    return splits.subsets_by_position(_examples(spark, sf_dir), "row_id")


def union_case_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training matrix: standardized cases with class 1 and the control after them with class 0."""
    rows = _scored(spark, sf_dir).select("row_id", "label_class", "score", "second").na.fill(0.0, ["score", "second"])
    control = rows.filter("label_class = 0")
    case, rest = (standardize.standardized(x.drop("label_class"), ["score", "second"], control.drop("label_class")) for x in (rows.filter("label_class = 1"), control))
    both = case.withColumn("class", F.lit(1)).unionByName(rest.withColumn("class", F.lit(0)))
    return both.select("row_id", "class", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"))


def agg_scored_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which sources a change scores above 0.1, and how often."""
    return cohort.cohort_counts(cohort.scoring_above(_examples(spark, sf_dir), "score"), ["locus", "alt"], "source")


def rank_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all files, each once and in order."""
    return table(spark, sf_dir, "variant_lines").select("file_name").distinct().orderBy("file_name")


def rank_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's area under its hits up to a bound between two cutoffs, and that of a random order."""
    ranked = ranking.average_rank(_scored(spark, sf_dir), "score", ["source"])
    sizes = ranked.groupBy("source").agg(F.count_if((F.col("label_class") == 1) & F.col("rank").isNotNull()).alias("positives"), F.count("rank").alias("n")).filter("positives > 0")
    curve = ranking.hits_at_cutoffs(ranked.filter("label_class = 1"), "source", "rank", 40)
    areas = ranking.area(curve, "source", "k", "hits", 25.5)
    return areas.join(sizes, "source").select("source", F.round("area", 6).alias("area"), F.round(ranking.random_area(F.col("positives"), F.col("n"), 25.5), 6).alias("random_area"))


def rank_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leave-one-out curve over all sources, summed and per source."""
    cases = rank_against_control(spark, sf_dir)
    curve = ranking.recall_leave_one_out(cases, "row_id", "source", "rank")
    return curve.select("k", "hits", F.round("mean_hits", 9).alias("mean_hits"))


def split_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.overlapping_subsets(_examples(spark, sf_dir), "row_id")


def svm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("row_id", svm_line(F.coalesce("label_class", F.lit(0)), [F.col("second").cast("long")]).alias("line"))


def _model_scores(spark: SparkSession, sf_dir: str, pipeline) -> DataFrame:
    t = _labelled(spark, sf_dir).select(*KEYS, "label", *FEATURES)
    return models.fitted_scores(pipeline, t).select(*KEYS, "label", "score")


def ml_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_scores(spark, sf_dir, models.forest(FEATURES, "label"))


def ml_neural_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_scores(spark, sf_dir, models.neural_net(FEATURES, "label"))


def ml_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_scores(spark, sf_dir, models.linear_svm(FEATURES, "label"))


def ml_single_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _labelled(spark, sf_dir).select(*KEYS, "label", *FEATURES)
    return t.select(*KEYS, "label", models.single_feature("DISCOUNT", t).alias("score"))


def ml_without_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of what is left when a family of features is dropped."""
    t = standardize.without_families(table(spark, sf_dir, "lineitem"), {"price": ["l_extendedprice"], "rates": ["l_discount", "l_tax"]}, "rates")
    left = [f for f in FEATURES if f in t.columns]
    return standardize.feature_stats(t, left).select("name", F.round("mean", 4).alias("mean"))


QUERIES = {
    f.__name__: f
    for f in (
        rank_report, rank_top, rank_in_source, rank_against_control, rank_recall_split, rank_recall_each, rank_recall_split_all, rank_recall_each_all, rank_reciprocal, rank_area, rank_cdf,
        std_against_control, std_feature_stats, std_long, std_discriminant, split_grouped, split_leave_one_out, split_grouped_all, split_leave_one_out_all, split_subsets, svm_lines,
        split_stratified, split_positions, union_case_control, agg_scored_cohorts, rank_ids, rank_baseline, rank_leave_one_out,
        ml_forest, ml_neural_net, ml_svm, ml_single_feature, ml_without_family,
    )
}

_RANK = "rank() OVER ({by} ORDER BY {s} DESC) + (count(*) OVER (PARTITION BY {more}{s}) - 1) / 2.0"
_REPORT = f"""r AS (SELECT row_id, score, {_RANK.format(by="", s="score", more="")} AS rank FROM split_rows WHERE score IS NOT NULL),
report AS (SELECT CASE WHEN rank = floor(rank) THEN CAST(CAST(rank AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor(rank) AS BIGINT) AS VARCHAR) || '.5' END AS rank, score,
  CASE WHEN score >= 0.48 THEN 'likely pathogenic' WHEN score >= 0.28 THEN 'potentially pathogenic' ELSE 'likely benign' END AS label, row_id FROM r)"""
_SOURCE = f"""ranked AS (SELECT row_id, source, label_class, {_RANK.format(by="PARTITION BY source", s="score", more="source, ")} AS rank FROM split_rows WHERE score IS NOT NULL),
sourced AS (SELECT s.row_id, s.source, s.label_class, rank FROM split_rows s LEFT JOIN ranked r ON s.row_id = r.row_id),
pos AS (SELECT * FROM sourced WHERE label_class = 1)"""
_CONTROL = """cases AS (
  SELECT c.row_id, c.source, CASE WHEN c.score IS NOT NULL THEN (SELECT count(*) FILTER (k.score > c.score) + (count(*) FILTER (k.score = c.score) + 2) / 2.0
    FROM split_rows k WHERE k.label_class = 0 AND k.source = c.source) END AS rank
  FROM split_rows c WHERE c.label_class = 1)"""


def _hits(ranked: str) -> str:
    return f"""hits AS (SELECT source, k, count(*) FILTER (rank <= k) AS hits FROM (SELECT * FROM {ranked}) CROSS JOIN (SELECT unnest(range(1, {CUTOFFS} + 1)) AS k) GROUP BY source, k)"""


_LABELLED = "t AS (SELECT *, CAST(l_returnflag = 'R' AS INT) AS label FROM lineitem WHERE l_returnflag IN ('R', 'A'))"
_KEYS = ", ".join(KEYS)

ORACLE = {
    "rank_report": f"WITH {_REPORT} SELECT * FROM report",
    "rank_top": f"WITH {_REPORT} SELECT * FROM report ORDER BY score DESC, row_id LIMIT 10",
    "rank_in_source": f"WITH {_SOURCE} SELECT row_id, source, rank FROM sourced",
    "rank_against_control": f"WITH {_CONTROL} SELECT row_id, source, rank FROM cases",
    "rank_recall_split": f"WITH {_SOURCE}, {_hits('pos')} SELECT CAST(k AS INT) AS k, round(avg(hits), 9) AS mean_hits FROM hits GROUP BY k",
    "rank_recall_each": f"WITH {_CONTROL}, {_hits('cases')} SELECT source, CAST(k AS INT) AS k, hits FROM hits",
    "rank_recall_split_all": f"""WITH {_SOURCE}, sources AS (SELECT source, count(rank) AS n FROM sourced GROUP BY source HAVING count(*) FILTER (label_class = 1) > 0),
      c AS (SELECT CAST(greatest(ceil(rank), 1) AS BIGINT) AS k, count(*) AS n FROM pos WHERE rank IS NOT NULL GROUP BY 1)
      SELECT g.k, round(CAST(coalesce(sum(n) OVER (ORDER BY g.k), 0) AS DOUBLE) / (SELECT count(*) FROM sources), 9) AS mean_hits
      FROM (SELECT unnest(range(1, (SELECT max(n) FROM sources))) AS k) g LEFT JOIN c ON g.k = c.k""",
    "rank_recall_each_all": f"""WITH {_CONTROL}, c AS (SELECT source, CAST(greatest(ceil(rank), 1) AS BIGINT) AS k, count(*) AS n FROM cases WHERE rank IS NOT NULL GROUP BY 1, 2),
      g AS (SELECT source, unnest(range(1, n + 1)) AS k FROM (SELECT source, count(*) AS n FROM cases GROUP BY 1))
      SELECT g.source, g.k, CAST(coalesce(sum(n) OVER (PARTITION BY g.source ORDER BY g.k), 0) AS BIGINT) AS hits FROM g LEFT JOIN c ON g.source = c.source AND g.k = c.k""",
    "rank_reciprocal": f"""WITH a AS (SELECT row_id, {_RANK.format(by="", s="score", more="")} AS r1 FROM split_rows WHERE score IS NOT NULL),
      b AS (SELECT row_id, {_RANK.format(by="", s="pos % 997", more="")} AS r2 FROM split_rows)
      SELECT row_id, round((1 / r1 + 1 / r2) / 2, 12) AS mrr FROM b LEFT JOIN a USING (row_id)""",
    "rank_area": f"""WITH {_SOURCE}, {_hits('pos')}, l AS (SELECT source, k, hits, lag(hits) OVER (PARTITION BY source ORDER BY k) AS before FROM hits)
      SELECT source, sum((hits + before) / 2.0) AS area FROM l WHERE before IS NOT NULL AND k <= 25 GROUP BY source""",
    "rank_cdf": f"WITH {_SOURCE} SELECT source, " + ", ".join(f"round(avg(CASE WHEN rank <= {t} THEN 1 ELSE 0 END), 9) AS within_{t}" for t in (5, 10, 25, 50)) + " FROM pos GROUP BY source",
    "std_against_control": "WITH c AS (SELECT "
    + ", ".join(f"avg({f}) FILTER (l_returnflag = 'N') AS m_{f}, stddev_pop({f}) FILTER (l_returnflag = 'N') AS s_{f}" for f in FEATURES)
    + f" FROM lineitem) SELECT {_KEYS}, "
    + ", ".join(f"round(({f} - m_{f}) / s_{f}, 6) AS {f}" for f in FEATURES)
    + " FROM lineitem, c",
    "std_feature_stats": " UNION ALL ".join(f"SELECT '{f}' AS name, round(avg({f}), 4) AS mean, round(var_samp({f}), 2) AS variance FROM lineitem" for f in FEATURES),
    "std_long": "SELECT row_id, 'score' AS variable, score AS value FROM split_rows UNION ALL SELECT row_id, 'second', CAST(pos % 997 AS DOUBLE) FROM split_rows",
    "std_discriminant": f"""WITH {_LABELLED}, c AS (SELECT label, avg(l_quantity) AS mx, avg(l_discount) AS my, var_samp(l_quantity) AS vx, var_samp(l_discount) AS vy, covar_samp(l_quantity, l_discount) AS vxy FROM t GROUP BY label),
      d AS (SELECT sum(vx) AS a, sum(vxy) AS b, sum(vy) AS c, sum(CASE WHEN label = 1 THEN mx ELSE -mx END) AS dx, sum(CASE WHEN label = 1 THEN my ELSE -my END) AS dy FROM c)
      SELECT {_KEYS}, label, round(l_quantity * (c * dx - b * dy) / (a * c - b * b) + l_discount * (a * dy - b * dx) / (a * c - b * b), 8) AS score FROM t, d""",
    "split_grouped": r"""WITH x AS (SELECT row_id, label_class AS label, regexp_replace(regexp_replace(chrom, '[^\p{L}\p{N}_]+', '', 'g'), '(?i)^chr', '') || ':' || pos // 1000000 AS locus, unnest(range(1, 6)) AS iteration
        FROM split_rows WHERE label_class IN (0, 1)),
      d AS (SELECT *, left(md5('1:' || iteration || ':' || row_id), 1) < '8' AS is_test FROM x)
      SELECT CAST(iteration AS INT) AS iteration, row_id, 'test' AS role FROM d WHERE is_test UNION ALL
      SELECT CAST(iteration AS INT), row_id, 'train' FROM d WHERE NOT is_test AND (label = 0 OR NOT EXISTS (SELECT 1 FROM d e WHERE e.is_test AND e.label = 1 AND e.iteration = d.iteration AND e.locus = d.locus))""",
    "split_leave_one_out": """SELECT CASE WHEN label_class = 1 THEN row_id END AS major, CAST(replicate AS INT) AS replicate, row_id,
        CASE WHEN label_class = 1 OR left(md5('1:' || replicate || ':' || row_id), 1) < '8' THEN 'test' ELSE 'train' END AS role
      FROM (SELECT row_id, label_class, unnest(range(1, 4)) AS replicate FROM split_rows WHERE label_class IN (0, 1))""",
    "split_subsets": "SELECT a || '' || b AS subset, row_id FROM split_rows, (SELECT x.i AS a, y.i AS b FROM range(4) x(i), range(4) y(i) WHERE x.i < y.i) WHERE row_id % 4 IN (a, b)",
    "svm_lines": "SELECT row_id, coalesce(label_class, 0) || ' qid:1 1:' || (pos % 997) AS line FROM split_rows",
    "ml_single_feature": f"WITH {_LABELLED} SELECT {_KEYS}, label, l_discount AS score FROM t",
    "ml_without_family": " UNION ALL ".join(f"SELECT '{f}' AS name, round(avg({f}), 4) AS mean FROM lineitem" for f in ("l_quantity", "l_extendedprice")),
}
ORACLE |= {
    "split_grouped_all": ORACLE["split_grouped"].replace("range(1, 6)", "range(1, 51)"),
    "split_leave_one_out_all": ORACLE["split_leave_one_out"].replace("range(1, 4)", "range(1, 11)"),
}
ORACLE |= {
    "split_stratified": r"""WITH x AS (SELECT row_id, label_class AS label, regexp_replace(regexp_replace(chrom, '[^\p{L}\p{N}_]+', '', 'g'), '(?i)^chr', '') || ':' || pos // 1000000 AS locus, unnest(range(1, 6)) AS iteration
        FROM split_rows WHERE label_class IN (0, 1)),
      d AS (SELECT *, row_number() OVER (PARTITION BY iteration, label ORDER BY md5('1:' || iteration || ':' || row_id), row_id) <= floor(count(*) OVER (PARTITION BY iteration, label) * 0.3) AS is_test FROM x)
      SELECT CAST(iteration AS INT) AS iteration, row_id, 'test' AS role FROM d WHERE is_test UNION ALL
      SELECT CAST(iteration AS INT), row_id, 'train' FROM d WHERE NOT is_test AND (label = 0 OR NOT EXISTS (SELECT 1 FROM d e WHERE e.is_test AND e.label = 1 AND e.iteration = d.iteration AND e.locus = d.locus))""",
    "split_positions": """SELECT a || '' || b AS subset, row_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place FROM split_rows),
      (SELECT x.i AS a, y.i AS b FROM range(4) x(i), range(4) y(i) WHERE x.i < y.i) WHERE place % 4 IN (a, b)""",
    "union_case_control": """WITH r AS (SELECT row_id, label_class, coalesce(score, 0) AS score, coalesce(CAST(pos % 997 AS DOUBLE), 0) AS second FROM split_rows),
      c AS (SELECT avg(score) AS ms, stddev_pop(score) AS ss, avg(second) AS mt, stddev_pop(second) AS st FROM r WHERE label_class = 0)
      SELECT row_id, label_class AS class, round((score - ms) / ss, 6) AS score, round((second - mt) / st, 6) AS second FROM r, c WHERE label_class IN (0, 1)""",
    "agg_scored_cohorts": r"""WITH x AS (SELECT regexp_replace(regexp_replace(chrom, '[^\p{L}\p{N}_]+', '', 'g'), '(?i)^chr', '') || ':' || pos // 1000000 AS locus, alt, source, count(*) AS n
        FROM split_rows WHERE score > 0.1 AND source IS NOT NULL GROUP BY ALL)
      SELECT locus, alt, CAST(sum(n) AS BIGINT) AS n_total, string_agg(n || ':' || source, ',' ORDER BY n DESC, source) AS cohorts FROM x GROUP BY ALL""",
    "rank_ids": "SELECT DISTINCT file_name FROM variant_lines",
    "rank_baseline": f"""WITH {_SOURCE}, sizes AS (SELECT source, count(rank) FILTER (label_class = 1) AS positives, count(rank) AS n FROM sourced GROUP BY source),
      hits AS (SELECT source, k, count(*) FILTER (rank <= k) AS hits FROM pos, (SELECT unnest(range(1, 27)) AS k) GROUP BY source, k),
      l AS (SELECT source, k, hits, lag(hits) OVER (PARTITION BY source ORDER BY k) AS before FROM hits)
      SELECT source, round(sum(CASE WHEN k <= 25 THEN (hits + before) / 2.0 ELSE 0.5 * (before + before + (hits - before) * 0.5) / 2.0 END), 6) AS area,
        round(any_value(positives) / any_value(n) * 25.5 * 25.5 / 2, 6) AS random_area
      FROM l JOIN sizes USING (source) WHERE before IS NOT NULL AND positives > 0 GROUP BY source""",
    "rank_leave_one_out": f"""WITH {_CONTROL}, c AS (SELECT CAST(greatest(ceil(rank), 1) AS BIGINT) AS k, count(*) AS n FROM cases WHERE rank IS NOT NULL GROUP BY 1),
      g AS (SELECT unnest(range(1, (SELECT count(*) FROM cases) + 1)) AS k)
      SELECT g.k, CAST(coalesce(sum(n) OVER (ORDER BY g.k), 0) AS BIGINT) AS hits, round(CAST(coalesce(sum(n) OVER (ORDER BY g.k), 0) AS DOUBLE) / (SELECT count(DISTINCT source) FROM cases), 9) AS mean_hits FROM g LEFT JOIN c ON g.k = c.k""",
}
