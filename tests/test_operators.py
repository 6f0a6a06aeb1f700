import math
import random

import pytest
from pyspark.sql import functions as F

from varloom.functions import genetics, sequence, splice
from varloom.operators import cohort, generate, intervals, lookup, models, ranking, scoring, splits, standardize
from varloom.sources import variants


def test_rank_shares_ties(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0.9, 0.5, 0.5, 0.1, None, float("nan")])], "id long, s double")
    got = {r.id: r["rank"] for r in ranking.average_rank(df, "s", []).collect()}
    assert got == {0: 1.0, 1: 2.5, 2: 2.5, 3: 4.0, 4: None, 5: None}


def test_rank_against_brute_force(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), rng.randint(0, 40) / 10, rng.randint(0, 1)) for i in range(400)]
    df = spark.createDataFrame(data, "id long, g string, s double, y int")
    own = {r.id: r["rank"] for r in ranking.average_rank(df, "s", ["g"]).collect()}
    for i, g, s, _ in data:
        same = [x for _, h, x, _ in data if h == g]
        assert own[i] == sum(x > s for x in same) + (sum(x == s for x in same) + 1) / 2
    cases, controls = df.filter("y = 1"), df.filter("y = 0")
    for r in ranking.rank_against(cases, controls, "s", ["g"]).collect():
        ctl = [x for _, h, x, y in data if h == r.g and y == 0]
        assert r["rank"] == sum(x > r.s for x in ctl) + (sum(x == r.s for x in ctl) + 2) / 2


def test_labels_and_texts(spark):
    df = spark.createDataFrame([(0.48, 1.0), (0.28, 2.5), (0.1, 3.0), (None, 4.0)], "s double, r double")
    got = df.select(ranking.score_label(F.col("s")), ranking.rank_text(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("likely pathogenic", "1"), ("potentially pathogenic", "2.5"), ("likely benign", "3"), (None, "4")]


def test_scores_are_printed_by_their_binary_value(spark):
    values = [0.0745, 0.0065, 0.0385, 0.0375, 0.8126, 1.0, 0.0, -0.5, None, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "s double").select(ranking.score_text(F.col("s"))).collect()]
    assert got[:-1] == [None if x is None else "%.3f" % x for x in values[:-1]] and got[-1] is None


def test_leave_one_out_curves_and_random_area(spark):
    ranked = spark.createDataFrame([(m, rep, rank) for rep, ranks in ((1, [1.0, 2.5, 9.0]), (2, [3.0, 1.5, None])) for m, rank in enumerate(ranks)], "major int, rep int, rank double")
    got = [tuple(r) for r in ranking.recall_leave_one_out(ranked, "major", "rep", "rank").orderBy("k").collect()]
    assert got == [(1, 1, 0.5), (2, 2, 1.0), (3, 4, 2.0)]
    each = [tuple(r) for r in ranking.recall_by_replicate(ranked, "major", "rep", "rank", [1, 2]).orderBy("k").collect()]
    assert each == [(1, 1, 0), (2, 1, 1), (3, 2, 2)]
    curve = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 5.0), ("a", 30.0, 10.0)], "m string, x double, y double")
    assert ranking.area(curve, "m", "x", "y", 25.0).first().area == 25 + 15 * (5 + 8.75) / 2
    assert spark.range(1).select(ranking.random_area(F.lit(10), F.lit(100), 25.0)).first()[0] == 10 / 100 * 25 * 25 / 2


def test_ranks_over_many_ranges(spark):
    """Ranges begin and end inside groups, and their totals still add up."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(4)
        data = [(i, rng.choice("aaab"), float(rng.randint(0, 300))) for i in range(3000)]
        df = spark.createDataFrame(data, "id long, g string, s double")
        got = {r.id: r["rank"] for r in ranking.average_rank(df, "s", ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in "ab":
        scores = sorted((s for _, h, s in data if h == g), reverse=True)
        first = {s: scores.index(s) for s in scores}
        assert all(got[i] == first[s] + (scores.count(s) + 1) / 2 for i, h, s in data if h == g)


def test_curves(spark):
    ranked = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("b", 9.0), ("b", None)], "rep string, rank double")
    hits = {(r.rep, r.k): r.hits for r in ranking.hits_at_cutoffs(ranked, "rep", "rank", 4).collect()}
    assert [hits["a", k] for k in (1, 2, 3, 4)] == [1, 1, 2, 2] and [hits["b", k] for k in (1, 2, 3, 4)] == [0, 0, 0, 0]
    curve = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 10.0), ("a", 20.0, 10.0)], "m string, x double, y double")
    assert ranking.area(curve, "m", "x", "y", 15.0).first().area == 100.0


def test_curves_have_every_cutoff(spark, tmp_path, monkeypatch):
    from varloom.plans import model_queries

    monkeypatch.setattr(ranking, "BLOCK", 7)
    rng = random.Random(5)
    data = [(i, "ab"[i % 4 == 0], rng.randint(0, 1), rng.choice([None, *map(float, range(90))]), i) for i in range(300)]
    made = spark.createDataFrame(data, "row_id long, source string, label_class int, score double, pos long").withColumn("split_name", F.lit("x"))
    made.write.parquet(f"{tmp_path}/split_rows.parquet")
    ranks = {s: [r["rank"] for r in model_queries.rank_in_source(spark, str(tmp_path)).collect() if data[r.row_id][1:3] == (s, 1) and r["rank"]] for s in "ab"}
    last = max(sum(d[1] == s and d[3] is not None for d in data) for s in "ab") - 1
    got = {r.k: r.mean_hits for r in model_queries.rank_recall_split_all(spark, str(tmp_path)).collect()}
    assert got == {k: sum(x <= k for s in "ab" for x in ranks[s]) / 2 for k in range(1, last + 1)} and last > model_queries.CUTOFFS
    cases = model_queries.rank_against_control(spark, str(tmp_path)).collect()
    each = {(r.source, r.k): r.hits for r in model_queries.rank_recall_each_all(spark, str(tmp_path)).collect()}
    assert each == {(s, k): sum(r.source == s and r["rank"] is not None and r["rank"] <= k for r in cases) for s in "ab" for k in range(1, sum(r.source == s for r in cases) + 1)}


def test_points_in_intervals(spark):
    rng = random.Random(1)
    points = [(i, rng.choice("xy"), rng.randint(0, 3000)) for i in range(300)] + [(900, None, 5), (901, "x", None)]
    spans = [(j, rng.choice("xy"), s, s + rng.randint(-5, 900)) for j, s in enumerate(rng.randint(0, 3000) for _ in range(60))] + [(99, "x", None, 5)]
    got = intervals.point_in_interval(
        spark.createDataFrame(points, "p long, c string, pos long"), spark.createDataFrame(spans, "i long, c string, s long, e long"), "c", "pos", "s", "e", 128
    )
    want = {(p, i) for p, c, x in points for i, d, s, e in spans if c and c == d and x is not None and s is not None and s < x <= e}
    found = [(r.p, r.i) for r in got.select("p", "i").collect()]
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize("strand, exons, cds", [("+", [(1, 10), (11, 23)], (3, 22)), ("-", [(1, 14), (15, 23)], (3, 22))])
def test_projections_go_back(spark, strand, exons, cds):
    segments = [(max(s, cds[0]), min(e, cds[1])) for s, e in exons]
    df = spark.range(0, 26).withColumn("strand", F.lit(strand)).withColumn("segments", F.array(*[F.struct(F.lit(s).cast("long").alias("start"), F.lit(e).cast("long").alias("end")) for s, e in segments]))
    df = df.withColumn("segments", intervals.segment_offsets(F.col("segments"), F.col("strand")))
    one, last = F.lit(1), F.lit(23)
    df = df.withColumn("pre", intervals.premrna_offset(F.col("id"), one, last, F.col("strand"))).withColumn("cod", intervals.cds_offset(F.col("id"), F.col("segments"), F.col("strand")))
    df = df.withColumn("pre_back", intervals.premrna_position(F.col("pre"), one, last, F.col("strand"))).withColumn("cod_back", intervals.cds_position(F.col("cod"), F.col("segments"), F.col("strand")))
    got = {r.id: r for r in df.collect()}
    assert [i for i in got if got[i].pre is not None] == list(range(2, 24))
    assert all(r.pre_back == r.id for r in got.values() if r.pre is not None)
    assert all(r.cod_back == r.id for r in got.values() if r.cod is not None)
    assert sorted(r.cod for r in got.values() if r.cod is not None) == list(range(18))
    if strand == "+":
        assert (got[2].pre, got[4].cod, got[10].cod, got[12].cod) == (0, 0, 6, 7)
    else:
        assert (got[23].pre, got[22].cod, got[16].cod, got[14].cod) == (0, 0, 6, 7)


def test_last_row_wins(spark):
    table = spark.createDataFrame([("a", 1, 0.1), ("a", 3, None), ("b", 1, 0.2), (None, 9, 0.9)], "k string, t int, v double")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    got = {r.k: r.v for r in lookup.looked_up(rows, table, ["k"], "v", "t").collect()}
    assert got == {"a": None, "b": 0.2, "c": None, None: None}


def test_codons(spark):
    assert len(genetics.codon_rows()) == 64 and len(genetics.synonymous_changes()) == 138
    assert abs(sum(r[2] for r in genetics.codon_rows()) - 1000) < 1
    df = spark.createDataFrame([("TTT", 2, "T", "C"), ("TTT", 2, "T", "A"), ("TAA", 1, "A", "G"), ("TNT", 0, "T", "C"), ("TTT", 2, "G", "C")], "c string, f int, r string, a string")
    got = [r[0] for r in df.select(genetics.is_synonymous(F.col("c"), F.col("f"), F.col("r"), F.col("a"))).collect()]
    assert got == [True, False, True, None, False]


def parts(spark, *marked):
    return sequence.with_parts(spark.createDataFrame([(m,) for m in marked], "m string"), "m")[0]


def test_mutation_string_and_parts(spark):
    df = spark.createDataFrame([("AAACCCGGG", 4, "C", "T"), ("AAACCCGGG", 4, "G", "T")], "s string, o int, r string, a string")
    edges = F.array(F.lit(6), F.lit(0), F.lit(3), F.lit(9), F.lit(0))
    got = [r[0] for r in df.select(sequence.mutation_string(F.col("s"), edges, F.col("o"), F.col("r"), F.col("a"))).collect()]
    assert got == ["AAA|C[C/T]C|GGG", None]
    p = parts(spark, "aaa|c[c/t]c|ggg", "AAA|CCC", "A[C/T]|G[A/C]", "AN[C/T]A").collect()
    assert (p[0]["head"], p[0]["ref"], p[0]["alt"], p[0]["tail"], p[0]["before"], p[0]["after"]) == ("C", "C", "T", "C", ["AAA"], ["GGG"])
    assert p[1]["ref"] is None and p[2]["ref"] is None and p[3]["head"] == ""


def test_cpg_reads_plain_heads_only(spark):
    from varloom.functions.registry import with_features
    from varloom.plans import sequence_queries  # noqa: F401

    df = parts(spark, "AC[G/T]A", "NAC[G/T]A", "aC[G/T]A", "A[C/T]GN")
    assert [r.is_cpg for r in with_features(df, ["m"], ["cpg"]).collect()] == [1, None, None, 1]


def test_motifs(spark):
    df = parts(spark, "ACGT[A/C]CGTACG", "[A/C]")
    m = {n: F.col(n) for n in ("head", "ref", "alt", "tail", "before", "after")}
    motifs = spark.createDataFrame([("tacg",), ("TCCG",), ("TCCG",), ("TCG",), ("TNCG",), (None,)], "motif string")
    f = sequence.motif_feature(m, [sequence.motif_hits("bits", 4)])
    got = df.withColumn("bits", sequence.motif_bits(motifs, "motif", 4)).select(f["n_old"], f["n_lost"], f["n_gained"], f["lost"]).collect()
    assert tuple(got[0]) == (2, 0, 0, 0.0) and tuple(got[1]) == (0, 0, 0, None)


@pytest.mark.parametrize("width", [2, 6, 8])
def test_motif_places_against_brute_force(spark, width):
    rng = random.Random(width)
    words = {"".join(rng.choice("ACGT") for _ in range(width)) for _ in range(60)} | {"A" * width, "T" * width}
    seqs = ["".join(rng.choice("ACGTN" if i % 3 else "AT") for _ in range(rng.choice([0, 1, width, 400]))) for i in range(30)] + [None, "T" * 50]
    df = spark.createDataFrame([(s,) for s in seqs], "s string").withColumn("bits", sequence.motif_bits(spark.createDataFrame([(w,) for w in words], "motif string"), "motif", width))
    got = [(r.s, r.hits) for r in df.select("s", sequence.motif_hits("bits", width)(F.col("s")).alias("hits")).collect()]
    assert all(hits == [i + 1 for i in range(len(s) - width + 1) if s[i : i + width] in words] for s, hits in got if s is not None)
    empty = df.select("s").withColumn("bits", sequence.motif_bits(spark.createDataFrame([], "motif string"), "motif", width))
    assert all(not r[0] for r in empty.select(sequence.motif_hits("bits", width)(F.col("s"))).collect())


def test_cpg_positions_crop_and_ratio(spark):
    df = parts(spark, "AAA|CC[C/T]GA|GGG")
    m = {n: F.col(n) for n in ("head", "ref", "alt", "tail", "before", "after")}
    f = sequence.relative_positions(F.col("m"), m)
    cpg = sequence.makes_cpg(F.right("head", F.lit(1)), F.left("tail", F.lit(1)), F.col("ref"), F.col("alt"))
    r = df.select(cpg, f["f_premrna"], f["f_mrna"], sequence.cpg_ratio(F.lit("CGCG")), sequence.cpg_ratio(F.lit("AAA"))).first()
    # the chunk with the change is the second, so of its side only the first chunk is an exon
    assert r[0] is True and r[1] == 6 / (6 + 6 + 1) and r[2] == 2 / (3 + 2 + 1) and r[3] == 2.0 and r[4] == 0.0
    c = spark.createDataFrame([("AAAA", "CCCC"), ("A", "CCCC"), ("A", "C")], "a string, b string")
    got = [tuple(r) for r in c.select(*sequence.cropped(F.col("a"), F.col("b"), 2)).collect()]
    assert got == [("AA", "CC"), ("A", "CCC"), (None, None)]
    n = spark.createDataFrame([(1.0, 10.0), (0.0, 1.0), (-1.0, 1.0)], "o double, n double")
    assert [r[0] for r in n.select(sequence.log_ratio(F.col("o"), F.col("n"))).collect()] == [-1.0, None, None]


SITES = {
    "c|ccaaaaaaaaaaaaaaaaaaAG|TTTGGGGGGGGGGG[T/A]TT|GTaaaaccccc|cc": ({"AAAAAAAAAAAAAAAAAAAGTTT"}, {"GGGGTTTGT", "GGGGATTGT", "TTTGTAAAA", "ATTGTAAAA"}),
    "c|ccaaaaaaaaaaaaaaaaaaAG|TTTGGGGGGG[T/A]GGGGGTTT|GTaaaaccccc|cc": (
        {"AAAAAAAAAAAAAAAAAAAGTTT", "AAAAAAAGTTTGGGGGGGTGGGG", "AAAAAAAGTTTGGGGGGGAGGGG"},
        {"TTTGTAAAA", "GGGGTGGGG", "GGGGAGGGG", "GGGGTTTGT"},
    ),
    "TT[T/A]GGGGGTTT|GTaaaaccccc|cc": (set(), {"TTTGTAAAA", "GGGGTTTGT"}),
}


@pytest.mark.parametrize("marked", SITES)
def test_splice_sites(spark, marked):
    df = parts(spark, marked)
    s = splice.spliced({n: F.col(n) for n in ("head", "ref", "alt", "tail", "before", "after")})
    for side, want in zip((3, 5), SITES[marked]):
        sites = F.flatten(F.transform(splice.junctions(s, side), lambda i: F.array(splice.site(s["old"], i, side), splice.site(s["new"], i, side))))
        assert set(df.select(sites).first()[0]) == want


def test_junction_features(spark):
    kept = "array(named_struct('i', 5, 'old', 3D, 'new', 1D), named_struct('i', 9, 'old', 1D, 'new', 3D))"
    df = spark.sql(f"SELECT {kept} AS k UNION ALL SELECT slice({kept}, 1, 0)")
    f = splice.junction_features(F.col("k"), F.lit(5))
    got = [tuple(r) for r in df.select(*f.values()).collect()]
    assert got == [(3.0, 2.0, 2.0, 2.0, True, True, False), (None, None, None, None, False, False, False)]


def test_matrix_holds_every_family(spark, tmp_path):
    from varloom.plans import sequence_queries

    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("ACGT") for _ in range(rng.choice([20, 90, 300])))) for i in range(60)]
    spark.createDataFrame([*texts, (60, "ACG")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(s, "ACGTACGTTGCA") for s in ("science", "law", "procedure")], "subject string, text string").write.parquet(f"{tmp_path}/subject_samples.parquet")
    got = {r.doc_id: r for r in sequence_queries.seq_feature_matrix(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(60)) and not any(x is None for r in got.values() for x in r)
    for query, columns in (("seq_matrices", {"lost": "sr_lost", "gained": "sr_gained"}), ("seq_codon_usage", {"rscu": "rscu", "d_rscu": "d_rscu"}), ("seq_folding", {"pdg": "pdg"})):
        want = getattr(sequence_queries, query)(spark, str(tmp_path)).collect()
        assert all(got[r.doc_id][to] == (r[c] or 0) for r in want for c, to in columns.items())
        assert all(any(r[to] for r in got.values()) for to in columns.values())
    ranks = sequence_queries.seq_matrix_ranks(spark, str(tmp_path)).collect()
    assert len(ranks) == 60
    assert all(float(r["rank"]) == sum(x.score > r.score for x in ranks) + (sum(x.score == r.score for x in ranks) + 1) / 2 for r in ranks)


def test_standardize_and_discriminant(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (3.0, 5.0, 0), (7.0, None, 1), (9.0, 6.0, 1), (8.0, 4.0, 1), (2.0, 6.5, 0)], "x double, c double, y int")
    z = standardize.standardized(df.select("x", F.lit(2.0).alias("k")), ["x", "k"]).collect()
    assert abs(sum(r.x for r in z)) < 1e-9 and all(r.k == 0 for r in z)
    stats = {r.name: (r["mean"], r.variance) for r in standardize.feature_stats(df, ["x"]).collect()}
    assert stats["x"][0] == 5.0 and math.isclose(stats["x"][1], 11.6)
    w = standardize.discriminant(df, ["x", "c"], "y")
    scored = df.dropna().select("y", standardize.weighted_sum(["x", "c"], w).alias("s")).collect()
    assert min(r.s for r in scored if r.y) > max(r.s for r in scored if not r.y)


def test_grouped_splits(spark):
    df = spark.createDataFrame([(i, i % 2, f"g{i % 5}") for i in range(200)], "id long, y int, g string")
    got = splits.grouped_splits(df, "id", "y", "g", 3).join(df, F.col("row_id") == df.id)
    for it in (1, 2, 3):
        rows = got.filter(F.col("iteration") == it).collect()
        tested = {r.g for r in rows if r.role == "test" and r.y == 1}
        assert not tested & {r.g for r in rows if r.role == "train" and r.y == 1}
    subsets = splits.overlapping_subsets(df, "id").groupBy("subset").count().collect()
    assert len(subsets) == 6 and {r["count"] for r in subsets} == {100}


def test_stratified_splits_have_exact_shares(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0), None if i % 9 == 0 else f"g{i % 50}") for i in range(1003)], "id long, y int, g string")
    data = {r.id: r for r in df.collect()}
    for it, role_of in {it: {r.row_id: r.role for r in splits.stratified_splits(df, "id", "y", "g", 2, 0.3).filter(F.col("iteration") == it).collect()} for it in (1, 2)}.items():
        for y in (0, 1):
            assert sum(role == "test" and data[i].y == y for i, role in role_of.items()) == math.floor(0.3 * sum(r.y == y for r in data.values()))
        tested = {data[i].g for i, role in role_of.items() if role == "test" and data[i].y == 1} - {None}
        assert not tested & {data[i].g for i, role in role_of.items() if role == "train" and data[i].y == 1} and it
    assert splits.stratified_splits(df.limit(0), "id", "y", "g", 2).collect() == []


def test_first_rows_are_drawn_without_moving_the_others(spark):
    keys = [f"{i % 3:04x}{i % 7:04x}" for i in range(300)]
    df = spark.createDataFrame([(i, i % 2, k) for i, k in enumerate(keys)], "id long, g int, k string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for share in (0.0, 0.001, 0.3, 0.5, 1.0):
            drawn = splits.first_of_each(df, ["g"], "k", "id", share)
            for g in (0, 1):
                own = sorted((keys[i], i) for i in range(300) if i % 2 == g)
                assert sorted(r.id for r in drawn.filter(F.col("first") & (F.col("g") == g)).collect()) == sorted(i for _, i in own[: math.floor(share * 150)])
            assert drawn.count() == 300
        # the counts by digits never meet the rows; what does is one row a group
        assert "SortMergeJoin" not in (plan := drawn._jdf.queryExecution().executedPlan().toString()) and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_one_left_out(spark):
    df = spark.createDataFrame([(i, int(i < 4)) for i in range(40)], "id long, y int")
    compact = splits.leave_one_out(df, "id", "y", 2)
    got = {r.row_id: r.role for r in splits.left_out(compact, 2, 1).collect()}
    assert len(got) == 40 and got[2] == "test" and [got[i] for i in (0, 1, 3)] == ["train"] * 3
    assert {i: r for i, r in got.items() if i > 3} == {i: r.role for i, r in ((r.row_id, r) for r in compact.filter("replicate = 1 AND major IS NULL").collect())}


def test_places_of_rows(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10_000), 500)
    got = {r.id: r.position for r in splits.with_position(spark.createDataFrame([(i,) for i in ids], "id long").repartition(7), ["id"]).collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids))}


def test_cohorts(spark):
    df = spark.createDataFrame([("v", "b"), ("v", "a"), ("v", "b"), ("w", "c"), ("w", None)], "k string, c string")
    assert sorted(map(tuple, cohort.cohort_counts(df, ["k"], "c").collect())) == [("v", 3, "2:b,1:a"), ("w", 1, "1:c")]


def test_generated_sites(spark):
    df = spark.createDataFrame([(1, "ATGTTTTAA"), (2, "AT"), (3, None), (4, "ANN")], "id long, cds string")
    got = {(r.id, r.site, r.ref, r.alt) for r in generate.synonymous_sites(df, "id", "cds").collect()}
    assert got == {(1, 5, "T", "C"), (1, 7, "A", "G"), (1, 8, "A", "G")}
    changes = spark.createDataFrame([(1, True)], "id long, cpg boolean")
    sites = generate.synonymous_sites(df, "id", "cds")
    assert generate.matched_controls(changes, sites, "id", "cpg", False).first().matched is False


def test_scorer_runs_once_per_text(spark):
    df = spark.createDataFrame([("AA",), ("AA",), ("C",), (None,)], "t string")
    got = scoring.scored(df, "t", lambda s: s.str.len().astype(float)).collect()
    assert sorted((r.t or "", r.score or 0.0) for r in got) == [("", 0.0), ("AA", 2.0), ("AA", 2.0), ("C", 1.0)]
    table = spark.createDataFrame([("AA", 7.0)], "t string, score double")
    assert scoring.scored(df, "t", table).filter("score = 7").count() == 2


def test_models_separate_classes(spark):
    df = spark.createDataFrame([(float(i % 2) * 3 + (i % 7) / 10, float(i % 5), i % 2) for i in range(120)], "a double, b double, y int")
    for pipeline in (models.forest(["a", "b"], "y", trees=11, depth=3), models.neural_net(["a", "b"], "y", steps=60), models.linear_svm(["a", "b"], "y", steps=30)):
        got = models.scores(pipeline.fit(df), df).collect()
        assert min(r.score for r in got if r.y) > max(r.score for r in got if not r.y)


def test_forest_on_cells_scores_as_on_rows(spark, monkeypatch):
    rng = random.Random(5)
    data = [(rng.randrange(6), rng.random(), rng.randrange(2)) for _ in range(1500)]
    df = spark.createDataFrame([(i, float(a), b, None if i == 7 else c + 0.5, int(rng.random() < (0.8 if a > 2 and b > 0.5 else 0.3))) for i, (a, b, c) in enumerate(data)], "id int, a double, b double, c double, y int")
    pipeline = models.forest(["a", "b", "c"], "y", trees=300, depth=5)
    rows = {r.id: r.score for r in models.scores(pipeline.fit(df), df).collect()}
    again = [{r.id: r.score for r in models.fitted_scores(pipeline, x).collect()} for x in (df, df.repartition(5))]
    assert again[0] == again[1] and 7 not in rows and set(rows) == set(again[0])
    apart = [abs(rows[i] - again[0][i]) for i in rows]
    assert sum(apart) / len(apart) < 0.02 and max(apart) < 0.12 and math.sqrt(sum((x - 0.4) ** 2 for x in rows.values()) / len(rows)) > 0.15
    # no forest of Spark's is fitted, which passes over all rows for every level of every tree
    monkeypatch.setattr(models.Pipeline, "fit", lambda *_: pytest.fail("fitted on rows"))
    assert models.fitted_scores(pipeline, df).count() == 1499


def test_coding_length_in_frame(spark, tmp_path):
    from varloom.plans import variant_queries

    gene = lambda tx, cds_end, strand="+": (tx, tx, "chr1", strand, 0, 40, 2, cds_end, 2, "0,20,", "10,40,")
    names = "tx_id string, name2 string, chrom string, strand string, tx_start long, tx_end long, cds_start long, cds_end long, exon_count int, exon_starts string, exon_ends string"
    # 8 bases of the first exon; 1, 2 and 3 of the second
    models = spark.createDataFrame([gene("a", 21), gene("b", 22), gene("c", 23), gene("d", 22, "?")], names)
    got = {r.tx: (r.reason, r.frame_reason) for r in variants.transcripts(models).collect()}
    assert got == {"a": (None, None), "b": (None, "frame"), "c": (None, "frame"), "d": ("strand", "strand")}
    models.write.parquet(f"{tmp_path}/gene_models.parquet")
    counts = variant_queries.QUERIES["flt_transcript_reasons_in_frame"](spark, str(tmp_path)).collect()
    assert {r.reason: r.n for r in counts} == {"usable": 1, "frame": 2, "strand": 1}


def test_queries_run_whole_models_and_splits(spark, tmp_path, monkeypatch):
    from varloom.plans import model_queries

    monkeypatch.setattr(model_queries, "_model_scores", lambda spark, sf_dir, pipeline: pipeline.getStages()[1])
    forest, net, svm = (getattr(model_queries, f"ml_{n}")(spark, "") for n in ("forest", "neural_net", "svm"))
    assert (forest.getNumTrees(), forest.getMaxDepth(), net.getMaxIter(), svm.getMaxIter()) == (2001, 10, 500, 100)
    spark.createDataFrame([(i, i % 2, "chr1", i * 900_000) for i in range(80)], "row_id long, label_class int, chrom string, pos long").write.parquet(f"{tmp_path}/split_rows.parquet")
    for query, column, n in (("split_grouped_all", "iteration", 50), ("split_leave_one_out_all", "replicate", 10)):
        got = model_queries.QUERIES[query](spark, str(tmp_path)).select(column).distinct().collect()
        assert sorted(r[0] for r in got) == list(range(1, n + 1))


def test_records(spark):
    lines = spark.createDataFrame([(1, "chr1 5\t. A C,G PASS x y"), (2, "# c"), (3, " "), (4, "X a"), (5, None)], "id long, line string")
    got = {r.id: r for r in variants.vcf_records(lines, "line", ["id"]).collect()}
    assert set(got) == {1, 4} and (got[1].chrom, got[1].pos, got[1].alt, got[1].rest) == ("1", 5, "C", ["PASS", "x", "y"]) and got[4].pos is None
    protein = spark.createDataFrame([("GENE 12 K A>G",)], "line string")
    assert tuple(variants.protein_records(protein, "line").first()) == ("GENE", 12, "K", "A", "G")
    q = spark.createDataFrame([(None, "DP4=1,1,1,1"), (10.0, "DP4=1,1,1,1"), (50.0, "DP4=9,9,0,1"), (50.0, "INDEL;DP4=1,1,1,1"), (0.0, "DP=7"), (40.0, None)], "q double, i string")
    assert [r[0] for r in q.select(variants.good_quality(F.col("q"), F.col("i"))).collect()] == [True, False, False, False, True, False]
