"""Changes on transcripts of both strands and a packed genome, up to the ranked report."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import packed
from varloom.functions import sequence
from varloom.functions.registry import Family, register, with_features
from varloom.operators import annotate
from varloom.plans import pipeline_queries, sequence_queries
from varloom.sources import genome, variants

MODELS = "tx_id string, name2 string, chrom string, strand string, tx_start long, tx_end long, cds_start long, cds_end long, exon_count int, exon_starts string, exon_ends string"
PLUS = ("t+", "plus", "chr1", "+", 1, 23, 3, 22, 2, "1,11,", "10,23,")
MINUS = ("t-", "minus", "chr2", "-", 1, 23, 3, 22, 2, "1,15,", "14,23,")
GENOME = {"1": "CAAATGCCCTATTCCCCCCTAATCCCC", "2": "AAATTAGGGGGGAATAGGGCATTCCCCCCC"}


def chunks_of(spark, sequences, size=genome.CHUNK):
    return genome.chunked(spark.createDataFrame(list(sequences.items()), "n string, s string"), "n", "s", size)


def placed(spark, *models):
    return annotate.placed_transcripts(variants.transcripts(spark.createDataFrame(list(models), MODELS)))


@pytest.mark.parametrize("size", [5, genome.CHUNK])
def test_whole_transcripts(spark, size):
    lost = ("t0", "none", "chr9", "+", 1, 23, 3, 22, 2, "1,11,", "10,23,")
    open_end = ("t1", "open", "chr1", "+", 1, 23, 3, 19, 2, "1,11,", "10,23,")
    got = {r.gene: r for r in annotate.assembled(placed(spark, PLUS, MINUS, lost, open_end), chunks_of(spark, GENOME, size), size).collect()}
    assert got["plus"].coding == got["minus"].coding == "ATGCCCTTTCCCCCCTAA"
    assert (got["plus"].premrna, got["minus"].premrna) == ("AAATGCCCTATTCCCCCCTAAT", "AATGCCCTATTCCCCCCTAATT")
    assert {g: r.genome_reason for g, r in got.items()} == {"plus": None, "minus": None, "none": "no_sequence", "open": "stop"}


CALLS = [
    (1, "1", 13, "T", "C"), (2, "1", 13, "T", "A"), (3, "1", 13, "G", "C"), (4, "2", 13, "A", "G"), (5, "2", 13, "A", "T"), (6, "1", 11, "A", "C"), (7, "1", 24, "T", "C"), (8, "1", None, "T", "C"), (9, None, 13, "T", "C"), (10, "1", 13, None, "C"),
]


def test_synonymous_calls_and_their_exons(spark):
    calls = spark.createDataFrame(CALLS, "variant_id long, chrom string, pos long, ref string, alt string")
    at = placed(spark, PLUS, MINUS)
    chunks = chunks_of(spark, GENOME)
    hits = annotate.synonymous_hits(calls, at, chunks)
    got = {r.variant_id: (r.tx, r.cds_offset, r.codon, r.frame, r.s_ref, r.s_alt) for r in hits.collect()}
    assert got == {1: ("t+", 8, "TTT", 2, "T", "C"), 4: ("t-", 8, "TTT", 2, "T", "C")}
    marked = {r.variant_id: r.marked for r in annotate.marked_transcripts(hits, annotate.assembled(at, chunks)).collect()}
    assert marked == {1: "AAATGCCCT|A|T[T/C]CCCCCCTAAT", 4: "AATGCCCT|A|T[T/C]CCCCCCTAATT"}
    exons = {r.variant_id: r for r in annotate.mutated_exons(hits, chunks).collect()}
    assert (exons[4].before, exons[4]["head"], exons[4].ref, exons[4].alt, exons[4]["tail"], exons[4].after) == (["AATGCCCTA"], "T", "T", "C", "CCCCCCTAATT", [""])
    assert annotate.synonymous_hits(calls.limit(0), at, chunks).count() == 0


def test_longest_and_unique_transcripts(spark):
    longer = ("t2", "plus", "chr1", "+", 0, 27, 3, 22, 2, "0,11,", "10,27,")
    calls = spark.createDataFrame(CALLS[:1], "variant_id long, chrom string, pos long, ref string, alt string")
    at, chunks = placed(spark, PLUS, longer), chunks_of(spark, GENOME)
    assert [r.tx for r in annotate.longest(annotate.synonymous_hits(calls, at, chunks)).collect()] == ["t2"]
    named = spark.createDataFrame([(1, "plus", "t+", 13, "T", "C"), (2, "plus", "t2", 13, "T", "A"), (3, "plus", "no", 13, "T", "C")], "variant_id long, gene string, tx string, pos long, ref string, alt string")
    assert [(r.variant_id, r.tx) for r in annotate.looked_up_again(named, at, chunks).collect()] == [(1, "t+")]
    twice = placed(spark, PLUS, (*PLUS[:5], 24, *PLUS[6:10], "10,24,"))
    assert twice.count() == 2 and annotate.looked_up_again(named, twice, chunks).count() == 0


def test_protein_coordinates(spark):
    asked = [(1, "plus", 3, "F", "T", "C"), (2, "minus", 3, "F", "T", "C"), (3, "plus", 3, "L", "T", "C"), (4, "plus", 99, "F", "T", "C"), (5, "none", 3, "F", "T", "C"), (6, "plus", 3, "F", "T", "A"), (7, None, 3, "F", "T", "C")]
    records = spark.createDataFrame(asked, "record_id long, gene string, aa_pos int, aa string, ref string, alt string")
    got = {r.record_id: (r.chrom, r.pos, r.ref, r.alt) for r in annotate.protein_changes(records, placed(spark, PLUS, MINUS), chunks_of(spark, GENOME)).collect()}
    assert got == {1: ("1", 13, "T", "C"), 2: ("2", 13, "A", "G")}


def test_from_a_packed_genome_to_the_report(spark, tmp_path):
    """What is fetched by position gives the same features as the whole marked transcript; the report ranks every call."""
    rng = random.Random(12)
    seqs = {c: "".join(rng.choice("ACGT") for _ in range(4000)) for c in ("1", "2")}
    (tmp_path / "g.2bit").write_bytes(packed(seqs))
    chunks = genome.read_genome(spark, str(tmp_path / "g.2bit")).cache()
    models = []
    for i, strand in enumerate("+-+-"):
        cuts = sorted(rng.sample(range(200 + 10 * i, 3800), 8))
        models.append((f"t{i}", f"g{i}", f"chr{i % 2 + 1}", strand, cuts[0], cuts[-1], cuts[0] + 4, cuts[-1] - 5, 4, ",".join(map(str, cuts[::2])) + ",", ",".join(map(str, cuts[1::2])) + ","))
    calls = [(k, c, p, s[p - 1], alt, "r") for k, (c, s, p, alt) in enumerate((c, s, p, alt) for c, s in seqs.items() for p in range(150, 3900, 7) for alt in "ACGT" if alt != s[p - 1])]
    df = spark.createDataFrame(calls, "variant_id long, chrom string, pos long, ref string, alt string, id string")
    at = placed(spark, *models)
    hits = annotate.longest(annotate.synonymous_hits(df, at, chunks)).withColumn("gerp", F.col("pos") / 7.0)
    assert 40 < hits.count() < len(calls)
    bits = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(n)),) for n in (6, 8) for _ in range(3000)], "motif string")
    for name, _, width in sequence_queries.MOTIFS:
        hits = hits.withColumn(f"bits_{name}", sequence.motif_bits(bits, "motif", width))
    hits = hits.cache()
    matrix = pipeline_queries.feature_matrix(hits, chunks, pipeline_queries.FAMILIES).cache()
    got = {r.variant_id: r.asDict() for r in matrix.collect()}
    whole = annotate.marked_transcripts(hits, annotate.assembled(at, chunks)).drop("ref", "alt")
    parsed = sequence.with_parts(whole.withColumn("seq", F.col("codon")).withColumn("offset", F.col("frame")).drop("codon", "frame", "is_synonymous"), "marked")[0]
    for r in with_features(parsed, ["variant_id"], ["usage", "cpg", "matrices", "splice", "motifs", "position"]).na.fill(0).collect():
        want = r.asDict()
        assert {k: round(float(got[r.variant_id][k]), 6) for k in want} == {k: round(float(x), 6) for k, x in want.items()}
    # the report's families from exons that are counted, not carried along
    quick = {r.variant_id: r.asDict() for r in pipeline_queries.feature_matrix(hits, chunks, pipeline_queries.QUICK).collect()}
    assert {k: {n: round(x, 6) if isinstance(x, float) else x for n, x in r.items()} for k, r in quick.items()} == {k: {n: round(got[k][n], 6) if isinstance(got[k][n], float) else got[k][n] for n in r} for k, r in quick.items()} and len(quick) == len(got)
    named = annotate.coding_hits(df, at, chunks).select("variant_id", "rec", "cds_offset", "codon", "frame", "s_ref", "s_alt", "is_synonymous")
    plain = annotate.with_codons(annotate.point_in_interval(df, at, "chrom", "pos", "cds_start", "cds_end"), chunks, ["variant_id", "rec"]).select(named.columns)
    assert named.exceptAll(plain).count() == plain.exceptAll(named).count() == 0 < named.filter("codon IS NOT NULL").count()
    labels = df.select("variant_id", (F.col("variant_id") % 3 == 0).cast("int").alias("label"))
    report = pipeline_queries.ranked_report(matrix, labels).collect()
    assert sorted(r.variant_id for r in report) == sorted(got) and {(r.chrom, r.pos, r.ref, r.alt) for r in report} <= {c[1:5] for c in calls}
    best = min(report, key=lambda r: float(r["rank"]))
    assert best.score == max(r.score for r in report) and all(0 <= r.score <= 1 for r in report)


def test_a_genome_with_gaps(spark):
    """Regions and windows of a table that lacks some chunks of a sequence."""
    chunks = chunks_of(spark, {"1": "ACGTACGTGGCCGTTA"}, 4).filter("chunk_id <> 1")
    wanted = spark.createDataFrame([(1, "1", 9, 14), (2, "1", 12, 40)], "region_id int, name string, start long, end long")
    assert {r.region_id: r.seq for r in genome.regions(chunks, wanted, 4).collect()} == {1: "GCCGT", 2: "GTTA"}
    places = spark.createDataFrame([("1", p) for p in (1, 4, 6, 9, 12, 12, 16, 17, None)] + [(None, 3), ("2", 3)], "chrom string, pos long")
    got = {r.pos: r.around for r in genome.windows(chunks, places, 2, 4).collect()}
    assert got == {1: "NNACG", 4: "CGTNN", 9: "NNGGC", 12: "GCCGT", 16: "TTANN"}


def test_the_report_has_every_family(spark, monkeypatch):
    """pipe_report's matrix holds the features of motifs, weight matrices and splice sites too, as the whole exon gives them."""
    chunks = chunks_of(spark, {"1": GENOME["1"][:23] + "GGTAAGTCACACGAGGTCAGCAAGTTT" + GENOME["1"][23:]})
    long_exon = ("t+", "plus", "chr1", "+", 1, 53, 3, 22, 2, "1,11,", "10,53,")
    calls = spark.createDataFrame([c for c in CALLS if c[1] == "1"], "variant_id long, chrom string, pos long, ref string, alt string")
    at = placed(spark, long_exon)
    hits = annotate.synonymous_hits(calls, at, chunks).withColumn("gerp", F.lit(0.5)).cache()
    motifs = spark.createDataFrame([("TTCCCC",), ("TCCCCC",), ("CACACG",), ("CACACGAG",), ("TTCCCCCC",)], "motif string")
    with_bits = lambda df: df.select("*", *[sequence.motif_bits(motifs, "motif", w).alias(f"bits_{n}") for n, _, w in sequence_queries.MOTIFS])
    monkeypatch.setattr(pipeline_queries, "stand_in_genome", lambda *_: chunks)
    monkeypatch.setattr(pipeline_queries, "_rare", lambda *_: hits)
    monkeypatch.setattr(pipeline_queries, "with_motifs", lambda _spark, _dir, df: with_bits(df), raising=False)
    monkeypatch.setattr(pipeline_queries, "table", lambda *_: calls.withColumn("filt", F.lit("PASS")))
    monkeypatch.setattr(pipeline_queries, "ranked_report", lambda matrix, labels: matrix)
    got = pipeline_queries.pipe_report(spark, "").collect()
    whole = with_bits(annotate.marked_transcripts(hits, annotate.assembled(at, chunks)).drop("ref", "alt"))
    parsed = sequence.with_parts(whole.withColumn("seq", F.col("codon")).withColumn("offset", F.col("frame")).drop("codon", "frame", "is_synonymous"), "marked")[0]
    want = {r.variant_id: r.asDict() for r in with_features(parsed, ["variant_id"], [f for f in sequence_queries.MATRIX if f not in ("domains", "pdg", "pvar")]).na.fill(0).collect()}
    assert [r.variant_id for r in got] == [1] == list(want)
    assert {k: round(float(got[0][k]), 6) for k in want[1]} == {k: round(float(x), 6) for k, x in want[1].items()}
    assert want[1]["sil_lost"] > 0 and want[1]["enh_lost"] > 0


@pytest.mark.parametrize("size", [8, 13, 64])
def test_words_counted_over_chunks(spark, size):
    """Words on either strand, across the ends of chunks and beside letters that are no bases, in long, short and unknown ranges."""
    rng = random.Random(size)
    text = "".join(rng.choice("ACGTACGTACGTN") for _ in range(300))
    chunks = chunks_of(spark, {"1": text}, size)
    tables = {"two": [np.array([rng.randint(0, 2) for _ in range(16)]), np.array([rng.randint(0, 1) for _ in range(64)]), np.array([rng.randint(0, 1) for _ in range(16)])], "six": [np.array([rng.randint(0, 1) for _ in range(4**6)])]}
    tables |= {f"{n}_minus": [genome.turned_words(t) for t in several] for n, several in tables.items()}
    ends = [(0, 300), (0, 1), (size - 1, size + 1), (size, 2 * size), (7, 7), (290, 999)] + [tuple(sorted(rng.sample(range(300), 2))) for _ in range(60)]
    ranges = spark.createDataFrame([("1", *e) for e in ends] + [("2", 0, 9)], "chrom string, start long, end long")
    got = {(r.chrom, r.start, r.end): r.asDict() for r in genome.counted(chunks, ranges, tables, size).collect()}
    turned = str.maketrans("ACGT", "TGCA")
    for a, b in {e for e in ends if e[0] < e[1]}:
        part, row = text[a:b], got["1", a, b]
        assert (row["n"], row["n_other"]) == (len(part), part.count("N"))
        for name, several in tables.items():
            read = part[::-1].translate(turned) if name.endswith("_minus") else part
            several = tables[name.removesuffix("_minus")]
            word = lambda w: sum("ACGT".index(x) * 4**k for k, x in enumerate(reversed(w)))
            words = [(t, read[i : i + w]) for t in several for w in [genome.word_width(t)] for i in range(len(read) - w + 1)]
            assert row[name] == sum(int(t[word(x)]) for t, x in words if "N" not in x), (a, b, name)
    assert len(got) == len({e for e in ends if e[0] < e[1]}) + 1 and got["2", 0, 9]["n"] == 0


def test_word_tables(spark):
    """The tables have the same hits as the expressions."""
    text = "".join(random.Random(3 + i).choice("ACGT") for i in range(1500))
    numbers = lambda w: [sum("ACGT".index(x) * 4**k for k, x in enumerate(reversed(text[i : i + w]))) for i in range(len(text) - w + 1)]
    bits = sequence.motif_bits(spark.createDataFrame([(text[i : i + 6],) for i in range(0, 90, 3)], "motif string"), "motif", 6)
    df = spark.createDataFrame([(text,)], "s string").select("s", bits.alias("bits"))
    row = df.select("bits", sequence.motif_hits("bits", 6)(F.col("s")).alias("motifs"), *[sequence.matrix_hits(n)(F.col("s")).alias(n) for n in sequence.MATRICES]).first()
    tables = {n: sequence.matrix_words(n) for n in sequence.MATRICES} | {"motifs": sequence.motif_words(row["bits"], 6)}
    for name, t in tables.items():
        assert row[name] == [i + 1 for i, x in enumerate(numbers(genome.word_width(t))) if t[x]], name


def test_a_family_can_be_added(spark):
    register(Family("length", lambda: {"length": F.length("s") + F.col("one")}, [lambda: {"one": F.lit(1)}]))
    df = spark.createDataFrame([("abc",)], "s string")
    assert with_features(df, ["s"], ["length"]).first().length == 4
    with pytest.raises(ValueError):
        with_features(df, ["s"], ["length", "length"])
