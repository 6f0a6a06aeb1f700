"""Registered queries over variants, transcripts and frequencies, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators import cohort, intervals, lookup
from varloom.sources import variants as v
from varloom.support import small, table


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.clean_variants(table(spark, sf_dir, "variants"))


def _transcripts(spark: SparkSession, sf_dir: str, in_frame: bool = False) -> DataFrame:
    """The transcripts; with in_frame, `reason` also names coding sequences of a length that 3 does not divide."""
    t = v.transcripts(table(spark, sf_dir, "gene_models"))
    return t.withColumn("reason", F.col("frame_reason")) if in_frame else t


def clean_snvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).filter(v.is_snv(F.col("ref"), F.col("alt")) & (F.col("chrom") != "Y"))


def src_vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.vcf_records(table(spark, sf_dir, "variant_lines"), "line", ["line_id"]).select("line_id", "chrom", "pos", "id", "ref", "alt", F.size("rest").alias("n_rest"))


def src_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exon of every distinct transcript record that has a whole exon list."""
    t = _transcripts(spark, sf_dir).filter("exons IS NOT NULL")
    return t.select("tx", "gene", "chrom", F.posexplode("exons").alias("exon_no", "e")).select("tx", "gene", "chrom", "exon_no", "e.start", "e.end")


def src_allele_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    af = v.allele_frequencies(table(spark, sf_dir, "allele_freq"))
    return af.select("site_id", "chrom", "pos", "alt", F.round("af", 9).alias("af"), "reason")


def flt_snv_not_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_snvs(spark, sf_dir).select("variant_id", "chrom", "pos", "ref", "alt")


def flt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "variants")
    return t.filter(v.good_quality(F.col("qual"), F.col("info"), least_depth=10)).select("variant_id")


def flt_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with their frequency, none or rare ones only."""
    af = v.allele_frequencies(table(spark, sf_dir, "allele_freq")).filter("reason IS NULL")
    found = lookup.looked_up(_variants(spark, sf_dir), af, ["chrom", "pos", "alt"], "af", "loaded_ts", "site_id")
    return found.filter(lookup.in_frequency_range(F.col("af"))).select("variant_id", F.round("af", 9).alias("af"))


def flt_transcript_reasons(spark: SparkSession, sf_dir: str, in_frame: bool = False) -> DataFrame:
    return _transcripts(spark, sf_dir, in_frame).groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count("*").alias("n"))


def join_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each variant with the last score known at its position."""
    scores = table(spark, sf_dir, "split_rows").select(v.bare_chrom(F.col("chrom")).alias("chrom"), "pos", "score", "loaded_ts", "row_id")
    return lookup.looked_up(_variants(spark, sf_dir), scores, ["chrom", "pos"], "score", "loaded_ts", "row_id").select("variant_id", "score")


def _hits(spark: SparkSession, sf_dir: str, in_frame: bool = False) -> DataFrame:
    usable = _transcripts(spark, sf_dir, in_frame).filter("reason IS NULL").select("chrom", "tx", "gene", "cds_start", "cds_end", (F.col("tx_end") - F.col("tx_start")).alias("tx_length")).distinct()
    return intervals.point_in_interval(clean_snvs(spark, sf_dir).select("variant_id", "chrom", "pos"), usable, "chrom", "pos", "cds_start", "cds_end")


def join_transcripts(spark: SparkSession, sf_dir: str, in_frame: bool = False) -> DataFrame:
    return _hits(spark, sf_dir, in_frame).select("variant_id", "tx", "gene", "cds_start")


def join_best_transcript(spark: SparkSession, sf_dir: str, in_frame: bool = False) -> DataFrame:
    """The longest transcript that covers each variant, by name where two are as long."""
    return intervals.best_per(_hits(spark, sf_dir, in_frame), ["variant_id"], -F.col("tx_length"), F.col("tx")).select("variant_id", "tx", "gene", "tx_length")


def _placed(spark: SparkSession, sf_dir: str, in_frame: bool = False) -> DataFrame:
    syn = table(spark, sf_dir, "synonymous").select("syn_id", "pos", "gene_id", F.col("tx_id").alias("tx"))
    usable = _transcripts(spark, sf_dir, in_frame).filter("reason IS NULL")
    return syn.join(small(usable), "tx")


def join_unique_transcript(spark: SparkSession, sf_dir: str, in_frame: bool = False) -> DataFrame:
    """Synonymous calls whose gene and transcript name exactly one record that covers them."""
    fit = _placed(spark, sf_dir, in_frame).filter("gene = gene_id AND cds_start < pos AND pos <= cds_end")
    return intervals.unique_per(fit, ["syn_id"]).select("syn_id", "tx", "gene", "strand")


def fn_projection(spark: SparkSession, sf_dir: str, in_frame: bool = False) -> DataFrame:
    """Places of synonymous calls in their transcripts and coding sequences, and back again."""
    placed = _placed(spark, sf_dir, in_frame).filter("tx_start < pos AND pos <= tx_end").withColumn("segments", intervals.segment_offsets(F.col("cds"), F.col("strand")))
    pre = intervals.premrna_offset(F.col("pos"), F.col("tx_start"), F.col("tx_end"), F.col("strand"))
    coding = intervals.cds_offset(F.col("pos"), F.col("segments"), F.col("strand"))
    both = placed.withColumn("premrna_offset", pre).withColumn("cds_offset", coding)
    return both.select(
        "syn_id",
        "tx",
        "premrna_offset",
        "cds_offset",
        intervals.premrna_position(F.col("premrna_offset"), F.col("tx_start"), F.col("tx_end"), F.col("strand")).alias("premrna_back"),
        intervals.cds_position(F.col("cds_offset"), F.col("segments"), F.col("strand")).alias("cds_back"),
    )


def agg_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    syn = table(spark, sf_dir, "synonymous").select(v.bare_chrom(F.col("chrom")).alias("chrom"), "pos", v.bare_allele(F.col("ref")).alias("ref"), v.bare_allele(F.col("alt")).alias("alt"), "cohort")
    return cohort.cohort_counts(syn, ["chrom", "pos", "ref", "alt"], "cohort")


def agg_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and distinct changes of each sample; the changes are counted by key first, so that a hot sample spreads."""
    calls = _variants(spark, sf_dir).groupBy("sample_id", "chrom", "pos", "ref", "alt").agg(F.count("*").alias("n"))
    return calls.groupBy("sample_id").agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_changes"))


QUERIES = {
    f.__name__: f
    for f in (
        src_vcf_lines, src_exons, src_allele_freq, flt_snv_not_y, flt_quality, flt_frequency, flt_transcript_reasons,
        join_conservation, join_transcripts, join_best_transcript, join_unique_transcript, fn_projection, agg_cohorts, agg_samples,
    )
}

#: Queries on usable transcripts; each is registered once more, as NAME_in_frame, with the rule that 3 divides the coding length.
FRAMED = (flt_transcript_reasons, join_transcripts, join_best_transcript, join_unique_transcript, fn_projection)
QUERIES |= {f"{f.__name__}_in_frame": partial(f, in_frame=True) for f in FRAMED}


def _chrom(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}_]+', '', 'g'), '(?i)^chr', '')"


def _allele(c: str) -> str:
    return rf"upper(regexp_replace(string_split_regex({c}, '[,;|/]')[1], '[^\p{{L}}\p{{N}}*<>]+', '', 'g'))"


_VARIANTS = f"""
v AS (SELECT variant_id, sample_id, {_chrom("chrom")} AS chrom, pos, {_allele("ref")} AS ref, {_allele("alt")} AS alt FROM variants),
snv AS (SELECT * FROM v WHERE length(ref) = 1 AND length(alt) = 1 AND chrom <> 'Y')
"""

_AF = rf"""
af0 AS (
  SELECT site_id, {_chrom("chrom")} AS chrom, pos, nullif({_allele("alt")}, '') AS alt, loaded_ts,
    try_cast(regexp_extract(';' || info || ';', ';AC=([^;,]*)', 1) AS DOUBLE) AS ac,
    try_cast(regexp_extract(';' || info || ';', ';AN=([^;]*)', 1) AS DOUBLE) AS an FROM allele_freq
),
af AS (SELECT *, CASE WHEN alt IS NULL THEN 'alt' WHEN ac IS NULL THEN 'ac' WHEN an IS NULL THEN 'an' END AS reason FROM af0)
"""

_TX = """
rec AS (SELECT row_number() OVER () AS rec, * FROM (SELECT DISTINCT * FROM gene_models)),
listed AS (
  SELECT *, regexp_replace(chrom, '^chr', '') AS chr,
    list_transform(list_filter(string_split(exon_starts, ','), lambda x: trim(x) <> ''), lambda x: try_cast(x AS BIGINT)) AS starts,
    list_transform(list_filter(string_split(exon_ends, ','), lambda x: trim(x) <> ''), lambda x: try_cast(x AS BIGINT)) AS ends FROM rec
),
tx0 AS (SELECT *, coalesce(len(starts) = len(ends) AND len(starts) = exon_count, false) AS whole FROM listed),
seg AS (
  SELECT rec, greatest(s, cds_start) AS s, least(e, cds_end) AS e, strand
  FROM (SELECT rec, cds_start, cds_end, strand, unnest(starts) AS s, unnest(ends) AS e FROM tx0 WHERE whole)
  WHERE greatest(s, cds_start) < least(e, cds_end)
),
tx AS (
  SELECT *, tx_id AS tx, name2 AS gene, CASE
    WHEN strand IS NULL OR strand NOT IN ('+', '-') THEN 'strand'
    WHEN NOT whole THEN 'exons'
    WHEN NOT coalesce(cds_start < cds_end, false) THEN 'empty_cds'
    WHEN cds_start < tx_start OR cds_end > tx_end THEN 'cds_outside'
    WHEN rec NOT IN (SELECT rec FROM seg) THEN 'no_coding' END AS reason FROM tx0
),
usable AS (SELECT DISTINCT chr, tx, gene, cds_start, cds_end, tx_end - tx_start AS tx_length FROM tx WHERE reason IS NULL)
"""

_HITS = f"""{_VARIANTS}, {_TX},
hits AS (SELECT variant_id, tx, gene, cds_start, tx_length FROM snv JOIN usable ON snv.chrom = usable.chr AND cds_start < pos AND pos <= cds_end)
"""

ORACLE = {
    "src_vcf_lines": rf"""
      SELECT line_id, regexp_replace(f[1], '^chr', '') AS chrom, try_cast(CASE WHEN regexp_full_match(f[2], '[+-]?[0-9]+') THEN f[2] END AS BIGINT) AS pos, f[3] AS id, f[4] AS ref,
        string_split(f[5], ',')[1] AS alt, CAST(greatest(len(f) - 5, 0) AS INT) AS n_rest
      FROM (SELECT line_id, string_split_regex(regexp_replace(line, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'), '[\s\x{{A0}}]+') AS f FROM variant_lines
            WHERE regexp_matches(line, '[^\s\x{{A0}}]') AND NOT starts_with(line, '#'))""",
    "src_exons": f"""WITH {_TX} SELECT tx, gene, chr AS chrom, CAST(i - 1 AS INT) AS exon_no, starts[i] AS start, ends[i] AS "end"
      FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS i FROM tx WHERE whole)""",
    "src_allele_freq": f"WITH {_AF} SELECT site_id, chrom, pos, alt, CASE WHEN reason IS NULL AND an <> 0 THEN round(ac / an, 9) END AS af, reason FROM af",
    "flt_snv_not_y": f"WITH {_VARIANTS} SELECT variant_id, chrom, pos, ref, alt FROM snv",
    "flt_quality": r"""SELECT variant_id FROM variants WHERE (qual IS NULL OR qual = 0 OR qual >= 30) AND NOT coalesce(contains(info, 'INDEL'), false)
      AND coalesce(try_cast(nullif(regexp_extract(upper(regexp_replace(info, '\s+', '', 'g')), '(?:^|[;,|])DP=(\d+)', 1), '') AS INT) >= 10, false)""",
    "flt_frequency": f"""WITH {_VARIANTS}, {_AF},
      last AS (SELECT * FROM af WHERE reason IS NULL AND chrom IS NOT NULL AND pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chrom, pos, alt ORDER BY loaded_ts DESC NULLS LAST, site_id DESC) = 1)
      SELECT variant_id, round(CASE WHEN an <> 0 THEN ac / an END, 9) AS af FROM v LEFT JOIN last USING (chrom, pos, alt)
      WHERE coalesce(round(CASE WHEN an <> 0 THEN ac / an END, 4), 0) BETWEEN 0 AND 0.05""",
    "flt_transcript_reasons": f"WITH {_TX} SELECT coalesce(reason, 'usable') AS reason, count(*) AS n FROM tx GROUP BY 1",
    "join_conservation": f"""WITH {_VARIANTS}, s AS (SELECT {_chrom("chrom")} AS chrom, pos, score, loaded_ts, row_id FROM split_rows),
      last AS (SELECT * FROM s WHERE chrom IS NOT NULL AND pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY loaded_ts DESC NULLS LAST, row_id DESC) = 1)
      SELECT variant_id, score FROM v LEFT JOIN last USING (chrom, pos)""",
    "join_transcripts": f"WITH {_HITS} SELECT variant_id, tx, gene, cds_start FROM hits",
    "join_best_transcript": f"""WITH {_HITS} SELECT variant_id, tx, gene, tx_length FROM hits
      QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY tx_length DESC, tx) = 1""",
    "join_unique_transcript": f"""WITH {_TX} SELECT syn_id, tx, gene, strand FROM synonymous s JOIN tx ON s.tx_id = tx.tx AND s.gene_id = tx.gene AND cds_start < s.pos AND s.pos <= cds_end
      WHERE reason IS NULL QUALIFY count(*) OVER (PARTITION BY syn_id) = 1""",
    "fn_projection": f"""WITH {_TX},
      offsets AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY rec ORDER BY CASE WHEN strand = '-' THEN -s ELSE s END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seg),
      placed AS (SELECT syn_id, y.pos, tx.* FROM synonymous y JOIN tx ON y.tx_id = tx.tx WHERE reason IS NULL AND tx_start < y.pos AND y.pos <= tx_end)
      SELECT syn_id, tx, CASE WHEN p.strand = '+' THEN p.pos - tx_start - 1 ELSE tx_end - p.pos END AS premrna_offset,
        CAST(before + CASE WHEN p.strand = '-' THEN e - p.pos ELSE p.pos - s - 1 END AS BIGINT) AS cds_offset, p.pos AS premrna_back, CASE WHEN before IS NOT NULL THEN p.pos END AS cds_back
      FROM placed p LEFT JOIN offsets o ON p.rec = o.rec AND s < p.pos AND p.pos <= e""",
    "agg_cohorts": f"""SELECT chrom, pos, ref, alt, CAST(sum(n) AS BIGINT) AS n_total, string_agg(n || ':' || cohort, ',' ORDER BY n DESC, cohort) AS cohorts
      FROM (SELECT {_chrom("chrom")} AS chrom, pos, {_allele("ref")} AS ref, {_allele("alt")} AS alt, cohort, count(*) AS n FROM synonymous WHERE cohort IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
    "agg_samples": f"""WITH {_VARIANTS} SELECT sample_id, CAST(sum(n) AS BIGINT) AS n_calls, count(*) AS n_changes FROM (SELECT sample_id, chrom, pos, ref, alt, count(*) AS n FROM v GROUP BY ALL) GROUP BY ALL""",
}

_TX_IN_FRAME = _TX.replace(
    "'no_coding' END", "'no_coding' WHEN (SELECT sum(e - s) FROM seg WHERE seg.rec = tx0.rec) % 3 <> 0 THEN 'frame' END"
)
ORACLE |= {f"{f.__name__}_in_frame": ORACLE[f.__name__].replace(_TX, _TX_IN_FRAME) for f in FRAMED}
