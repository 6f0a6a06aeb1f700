"""The whole way from calls to a ranked report, over the tables and a stand-in genome, with SQL for its first half.

The tables hold no genome. Chunk c of a chromosome is the letters A, C, G and T
of one of the subject samples, repeated to the chunk's length; which one follows
from the chromosome's name and c.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.functions import genetics, sequence
from varloom.functions.registry import with_features
from varloom.operators import annotate, lookup, ranking, standardize
from varloom.plans.sequence_queries import MATRIX, MOTIFS, bases, with_motifs
from varloom.plans.variant_queries import _AF, _TX, _VARIANTS, _chrom, clean_snvs
from varloom.sources import variants as v
from varloom.sources.genome import CHUNK, PARTS
from varloom.sources.tables import stage
from varloom.support import shared_dir, stored, table

#: Families of the matrix; positions and domains come from the genome.
FAMILIES = [f for f in MATRIX if f not in ("position", "domains")]

#: Families that need neither motif sets nor weight matrices; the report has all FAMILIES.
QUICK = ["usage", "cpg", "pdg", "pvar"]

#: Bases of a domain on either side of the change.
DOMAIN = 20


def stand_in_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, chunk_id, seq) of every chunk that a transcript touches; its size is that of the gene models, whatever the scale."""
    samples = table(spark, sf_dir, "subject_samples").select("sample_id", bases(F.col("text")).alias("seq"))
    numbered = samples.select((F.row_number().over(Window.orderBy("sample_id")) - 1).alias("number"), "seq")
    count = samples.agg(F.count("*").alias("n")).scalar()
    t = table(spark, sf_dir, "gene_models").select(F.regexp_replace("chrom", "^chr", "").alias("name"), "tx_start", "tx_end").filter("tx_start < tx_end")
    touched = t.select("name", F.explode(F.sequence(F.floor(F.col("tx_start") / CHUNK), F.floor((F.col("tx_end") - 1) / CHUNK))).alias("chunk_id")).distinct()
    chunks = touched.withColumn("number", F.pmod(F.ascii("name") * 131 + F.length("name") * 17 + F.col("chunk_id") * 7, count).cast("int"))
    whole = F.rpad("seq", F.lit(CHUNK), F.col("seq"))
    made = chunks.join(F.broadcast(numbered.filter("seq <> ''")), "number").select("name", "chunk_id", whole.alias("seq"))
    made = made.repartition(PARTS * spark.sparkContext.defaultParallelism, "name", "chunk_id")
    return stage(made, shared_dir(spark, "genome"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.placed_transcripts(v.transcripts(table(spark, sf_dir, "gene_models"))).distinct()


def _synonymous(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """Every single-base call in the longest transcript in which it is synonymous."""
    return annotate.longest(annotate.synonymous_hits(clean_snvs(spark, sf_dir), _placed(spark, sf_dir), chunks))


def pipe_synonymous(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _synonymous(spark, sf_dir, stand_in_genome(spark, sf_dir))
    return found.select("variant_id", "tx", "gene", "strand", "cds_offset", "codon", "frame", "s_ref", "s_alt")


def pipe_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every single-base call in every transcript whose coding range covers it, with its codon there."""
    calls = clean_snvs(spark, sf_dir).select("variant_id", "chrom", "pos", "ref", "alt")
    found = annotate.coding_hits(calls, _placed(spark, sf_dir), stand_in_genome(spark, sf_dir)).filter("codon IS NOT NULL")
    return found.select("variant_id", "tx", "cds_start", "cds_offset", "codon", "is_synonymous")


def _rare(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """The synonymous calls with their frequency and conservation, rare and unknown ones only."""
    af = v.allele_frequencies(table(spark, sf_dir, "allele_freq")).filter("reason IS NULL")
    known = lookup.looked_up(_synonymous(spark, sf_dir, chunks), af, ["chrom", "pos", "alt"], "af", "loaded_ts", "site_id")
    rare = known.filter(lookup.in_frequency_range(F.col("af")))
    scores = table(spark, sf_dir, "split_rows").select(v.bare_chrom(F.col("chrom")).alias("chrom"), "pos", F.col("score").alias("gerp"), "loaded_ts", "row_id")
    return lookup.looked_up(rare, scores, ["chrom", "pos"], "gerp", "loaded_ts", "row_id")


def pipe_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rare(spark, sf_dir, stand_in_genome(spark, sf_dir)).select("variant_id", "tx", F.round("af", 9).alias("af"), "gerp")


def feature_matrix(hits: DataFrame, chunks: DataFrame, families: list[str]) -> DataFrame:
    """variant_id, gene, tx, chrom, pos and g_ref, g_alt of the hits with the features of each change, nulls as 0.

    The family that looks for motifs needs the columns of with_motifs() in hits.
    Where all families are among FAMILIES, exons are counted and not carried
    along: lost and gained hits and changed splice sites lie round the change,
    and of the rest of the exon only the numbers of hits and bases are needed.
    """
    ids = ["variant_id", "gene", "tx", "chrom", "pos", "g_ref", "g_alt"]
    local = set(families) <= set(FAMILIES)
    # the sets are alike in all rows, so they are taken from one and not shuffled with the hits
    widths = {f"bits_{name}": width for name, _, width in MOTIFS if f"bits_{name}" in hits.columns}
    bits = {c: hits.select(c).limit(1).scalar() for c in widths}
    fetched = hits.drop(*widths).withColumn("g_ref", F.col("ref")).withColumn("g_alt", F.col("alt"))
    exons = annotate.mutated_surroundings(fetched, chunks, words=_words(hits, widths, families)) if local else annotate.mutated_exons(fetched, chunks)
    cut = dict(zip(("fold_pre", "fold_post"), sequence.cropped(F.concat(F.get("before", F.lit(0)), "head"), F.concat("tail", F.get("after", F.lit(0))), DOMAIN)))
    places = annotate.places_in_transcript(*map(F.col, ("head_length", "tail_length"))) if local else annotate.places_in_transcript()
    families = [f"{f}_counted" if local and f in ("cpg", "matrices", "motifs") else f for f in families]
    made = places | cut | {"seq": F.col("codon"), "offset": F.col("frame"), "raw_head": F.col("head")} | bits
    ready = exons.select(*[c for c in exons.columns if c not in ("codon", "frame", "is_synonymous")], *[c.alias(n) for n, c in made.items()])
    return with_features(ready, [*ids, "gerp", "f_premrna", "f_mrna"], families).na.fill(0)


def _words(hits: DataFrame, widths: dict[str, int], families: list[str]) -> dict[str, list]:
    """The tables of words whose hits in whole exons the families need, by the name of their count."""
    out = {"n_sr": [sequence.matrix_words(n) for n in sorted(sequence.MATRICES)]} if "matrices" in families else {}
    if "motifs" in families:
        one = hits.select(*widths).first()
        out |= {f"n_{c.removeprefix('bits_')}": [sequence.motif_words(one[c] if one else None, w)] for c, w in widths.items()}
    return out


def ranked_report(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """The ranked report of a matrix: standardized against the rows of label 0, scored by the linear discriminant, ranked and labelled.

    `labels` is (variant_id, label).
    """
    ready = stored(matrix.join(labels, "variant_id"))
    names = [c for c in ready.columns if c not in ("variant_id", "gene", "tx", "chrom", "pos", "g_ref", "g_alt", "label")]
    z = standardize.standardized(ready, names, ready.filter("label = 0"))
    scored = z.withColumn("score", 1 / (1 + F.exp(-standardize.weighted_sum(names, standardize.discriminant(z, names, "label")))))
    ranked = ranking.average_rank(scored, "score", [])
    return ranked.select(
        ranking.rank_text(F.col("rank")).alias("rank"), "score", ranking.score_label(F.col("score")).alias("class"), "gene", "tx", "chrom", "pos", "variant_id", F.col("g_ref").alias("ref"), F.col("g_alt").alias("alt")
    )


def pipe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked report of all rare synonymous calls.

    The tables name no harmful calls; those that passed their filter stand in
    for the control and the others for the examples.
    """
    chunks = stand_in_genome(spark, sf_dir)
    labels = table(spark, sf_dir, "variants").select("variant_id", (~F.coalesce(F.col("filt") == "PASS", F.lit(False))).cast("int").alias("label"))
    hits = with_motifs(spark, sf_dir, stored(_rare(spark, sf_dir, chunks)))
    return ranked_report(feature_matrix(hits, chunks, FAMILIES), labels)


QUERIES = {f.__name__: f for f in (pipe_codons, pipe_synonymous, pipe_rare, pipe_report)}

_CODONS = ", ".join(f"('{c}', '{aa}')" for c, aa, _, _ in genetics.codon_rows())

_PLACED = f"""{_VARIANTS}, {_TX},
samples AS (SELECT row_number() OVER (ORDER BY sample_id) - 1 AS number, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS q FROM subject_samples),
placed AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT tx, gene, chr, strand, tx_start, tx_end, cds_start, cds_end, starts, ends FROM tx WHERE reason IS NULL)),
pieces AS (
  SELECT *, coalesce(sum(e - s) OVER (PARTITION BY id ORDER BY CASE WHEN strand = '-' THEN -s ELSE s END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT id, strand, greatest(s, cds_start) AS s, least(e, cds_end) AS e FROM (SELECT id, strand, cds_start, cds_end, unnest(starts) AS s, unnest(ends) AS e FROM placed))
  WHERE s < e
),
hit AS (SELECT v.*, p.* EXCLUDE (chr, starts, ends) FROM snv v JOIN placed p ON v.chrom = p.chr AND cds_start < pos AND pos <= cds_end),
coded AS (
  SELECT h.*, CAST(before + CASE WHEN h.strand = '-' THEN e - pos ELSE pos - s - 1 END AS BIGINT) AS o,
    CASE WHEN h.strand = '-' THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS s_ref, CASE WHEN h.strand = '-' THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS s_alt
  FROM hit h JOIN pieces USING (id) WHERE s < pos AND pos <= e
),
three AS (
  SELECT variant_id, id, chrom, p.strand, k, CASE WHEN p.strand = '-' THEN e - (off - before) ELSE s + 1 + off - before END AS place
  FROM (SELECT variant_id, id, chrom, k, o - o % 3 + k AS off FROM coded, (SELECT unnest(range(3)) AS k)) c JOIN pieces p USING (id) WHERE before <= off AND off < before + e - s
),
letters AS (
  SELECT variant_id, id, string_agg(CASE WHEN strand = '-' THEN translate(base, 'ACGT', 'TGCA') ELSE base END, '' ORDER BY k) AS codon
  FROM (SELECT t.*, CAST(q[CAST((place - 1) % {CHUNK} % length(q) + 1 AS BIGINT)] AS VARCHAR) AS base FROM three t
    JOIN samples ON number = (ascii(chrom) * 131 + length(chrom) * 17 + (place - 1) // {CHUNK} * 7) % (SELECT count(*) FROM subject_samples))
  GROUP BY variant_id, id HAVING count(*) = 3
),
code(codon, aa) AS (VALUES {_CODONS}),
codons AS (
  SELECT c.*, l.codon, CAST(o % 3 AS INT) AS frame, CASE WHEN x.aa IS NOT NULL AND y.aa IS NOT NULL THEN l.codon[o % 3 + 1] = s_ref AND x.aa = y.aa END AS is_synonymous
  FROM coded c JOIN letters l USING (variant_id, id) LEFT JOIN code x ON x.codon = l.codon LEFT JOIN code y ON y.codon = l.codon[1:o % 3] || s_alt || l.codon[o % 3 + 2:]
),
best AS (SELECT * FROM codons WHERE is_synonymous QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY tx_end - tx_start DESC, tx, tx_start, cds_start, cds_end, gene) = 1)
"""

ORACLE = {
    "pipe_codons": f"WITH {_PLACED} SELECT variant_id, tx, cds_start, o AS cds_offset, codon, is_synonymous FROM codons",
    "pipe_synonymous": f"WITH {_PLACED} SELECT variant_id, tx, gene, strand, o AS cds_offset, codon, frame, s_ref, s_alt FROM best",
    "pipe_rare": f"""WITH {_PLACED}, {_AF},
      last AS (SELECT * FROM af WHERE reason IS NULL AND chrom IS NOT NULL AND pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chrom, pos, alt ORDER BY loaded_ts DESC NULLS LAST, site_id DESC) = 1),
      scores AS (SELECT {_chrom("chrom")} AS chrom, pos, score AS gerp, loaded_ts, row_id FROM split_rows),
      scored AS (SELECT * FROM scores WHERE chrom IS NOT NULL AND pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY loaded_ts DESC NULLS LAST, row_id DESC) = 1)
      SELECT variant_id, tx, round(CASE WHEN an <> 0 THEN ac / an END, 9) AS af, gerp
      FROM best b LEFT JOIN last l ON b.chrom = l.chrom AND b.pos = l.pos AND b.alt = l.alt LEFT JOIN scored s ON b.chrom = s.chrom AND b.pos = s.pos
      WHERE coalesce(round(CASE WHEN an <> 0 THEN ac / an END, 4), 0) BETWEEN 0 AND 0.05""",
}
