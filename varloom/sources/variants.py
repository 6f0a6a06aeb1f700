"""Readers and parsers of variant, transcript and frequency records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.support import SPACE, trim_space


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file_name): the lines of plain or gzipped text files, globs included."""
    return spark.read.text(path).withColumn("file_name", F.col("_metadata.file_path"))


def content_lines(df: DataFrame, line: str) -> DataFrame:
    """Without blank lines and lines that start with `#`."""
    return df.filter(F.col(line).rlike(rf"[^{SPACE[1:]}") & ~F.startswith(F.col(line), F.lit("#")))


def bare_chrom(c: Column) -> Column:
    """A chromosome name without white space, quotes, other marks and a `chr` in front."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", ""), "(?i)^chr", "")


def bare_allele(c: Column) -> Column:
    """The first of several alternates, or a base string, in capitals without marks."""
    return F.upper(F.regexp_replace(F.get(F.split(c, "[,;|/]"), F.lit(0)), r"[^\p{L}\p{N}*<>]+", ""))


def vcf_records(df: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """keep..., chrom, pos, id, ref, alt, rest of each content line split at any white space.

    One `chr` in front of chrom goes, of several alternates the first stays;
    fields past the fifth are `rest`. Lines of fewer than five fields have nulls
    there, and a position that is no number is null.
    """
    f = F.split(trim_space(F.col(line)), f"{SPACE}+")
    at = lambda i: F.get(f, F.lit(i))
    return content_lines(df, line).select(
        *keep,
        F.regexp_replace(at(0), "^chr", "").alias("chrom"),
        at(1).try_cast("long").alias("pos"),
        at(2).alias("id"),
        at(3).alias("ref"),
        F.substring_index(at(4), ",", 1).alias("alt"),
        F.slice(f, F.lit(6), F.greatest(F.lit(0), F.size(f) - 5)).alias("rest"),
    )


def protein_records(df: DataFrame, line: str) -> DataFrame:
    """gene, aa_pos, aa, ref, alt of lines `gene pos aa X>Y`."""
    f = F.split(trim_space(F.col(line)), f"{SPACE}+")
    at = lambda i: F.get(f, F.lit(i))
    return content_lines(df, line).select(
        at(0).alias("gene"), at(1).try_cast("int").alias("aa_pos"), at(2).alias("aa"), F.substring_index(at(3), ">", 1).alias("ref"), F.substring_index(at(3), ">", -1).alias("alt")
    )


def int_list(c: Column) -> Column:
    """The numbers of a comma list with a trailing comma; null where one is no number."""
    numbers = F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: x.try_cast("long"))
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers)


def transcripts(models: DataFrame) -> DataFrame:
    """One row per distinct transcript record: gene, tx, bounds, exons and coding segments as arrays of intervals.

    `reason` says why a record is unusable, null where it is not: strand, exons
    (lists of unequal or wrong number, or not numbers), empty_cds, cds_outside
    and no_coding. `frame_reason` says the same with one rule more: frame, where
    3 does not divide the length of the coding segments. Intervals are 0-based
    and half-open.
    """
    t = models.distinct().select(
        F.col("tx_id").alias("tx"),
        F.col("name2").alias("gene"),
        F.regexp_replace("chrom", "^chr", "").alias("chrom"),
        "strand",
        "tx_start",
        "tx_end",
        "cds_start",
        "cds_end",
        "exon_count",
        int_list(F.col("exon_starts")).alias("starts"),
        int_list(F.col("exon_ends")).alias("ends"),
    )
    exons = F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    coding = F.transform("exons", lambda e: F.struct(F.greatest(e["start"], F.col("cds_start")).alias("start"), F.least(e["end"], F.col("cds_end")).alias("end")))
    even = F.coalesce((F.size("starts") == F.size("ends")) & (F.size("starts") == F.col("exon_count")), F.lit(False))
    parsed = t.withColumn("exons", F.when(even, exons)).withColumn("cds", F.filter(coding, lambda s: s["start"] < s["end"]))
    length = F.aggregate("cds", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    reason = (
        F.when(~F.coalesce(F.col("strand").isin("+", "-"), F.lit(False)), "strand")
        .when(F.col("exons").isNull(), "exons")
        .when(~F.coalesce(F.col("cds_start") < F.col("cds_end"), F.lit(False)), "empty_cds")
        .when((F.col("cds_start") < F.col("tx_start")) | (F.col("cds_end") > F.col("tx_end")), "cds_outside")
        .when(F.size("cds") == 0, "no_coding")
    )
    framed = F.coalesce("reason", F.when(F.col("cds_length") % 3 != 0, "frame"))
    return parsed.withColumn("cds_length", length).withColumn("reason", reason).withColumn("frame_reason", framed).drop("starts", "ends")


def info_value(info: Column, name: str) -> Column:
    """The value of `name=` in a `;`-separated info field, null where it is absent."""
    return F.get(F.filter(F.transform(F.split(info, ";"), lambda x: F.when(F.startswith(x, F.lit(f"{name}=")), F.substring(x, F.lit(len(name) + 2), F.length(x)))), lambda x: x.isNotNull()), F.lit(0))


def allele_frequencies(df: DataFrame) -> DataFrame:
    """site_id, chrom, pos, alt, af and loaded_ts: AC / AN of the first alternate.

    `reason` names what is missing (`ac`, `an` or `alt`); af is null then, and
    also where AN is 0.
    """
    ac, an = F.substring_index(info_value(F.col("info"), "AC"), ",", 1).try_cast("double"), info_value(F.col("info"), "AN").try_cast("double")
    alt = F.nullif(bare_allele(F.col("alt")), F.lit(""))
    reason = F.when(alt.isNull(), "alt").when(ac.isNull(), "ac").when(an.isNull(), "an")
    return df.select("site_id", bare_chrom(F.col("chrom")).alias("chrom"), "pos", alt.alias("alt"), F.when(reason.isNull(), F.try_divide(ac, an)).alias("af"), reason.alias("reason"), "loaded_ts")


def clean_variants(df: DataFrame) -> DataFrame:
    """variant_id, chrom, pos, ref, alt, qual, filt, info, sample_id, loaded_ts with bare chrom and alleles."""
    return df.select("variant_id", bare_chrom(F.col("chrom")).alias("chrom"), "pos", bare_allele(F.col("ref")).alias("ref"), bare_allele(F.col("alt")).alias("alt"), "qual", "filt", "info", "sample_id", "loaded_ts")


def is_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def good_quality(qual: Column, info: Column, least: float = 30.0, least_depth: int = 3) -> Column:
    """Quality absent, 0 or at least `least`; no INDEL; read counts that bear the alternate on both strands.

    Read counts are DP4=a,b,c,d, of which all must reach least_depth together
    and c and d be positive; a record without DP4 is judged by DP alone.
    """
    count = lambda k: F.nullif(F.regexp_extract(info, r"DP4=(\d+),(\d+),(\d+),(\d+)", k), F.lit("")).cast("int")
    depth = F.nullif(F.regexp_extract(F.upper(F.regexp_replace(info, r"\s+", "")), r"(?:^|[;,|])DP=(\d+)", 1), F.lit("")).try_cast("int")
    dp4 = (count(1) + count(2) + count(3) + count(4) >= least_depth) & (count(3) > 0) & (count(4) > 0)
    enough = F.when(count(1).isNotNull(), dp4).otherwise(F.coalesce(depth >= least_depth, F.lit(False)))
    return (qual.isNull() | (qual == 0) | (qual >= least)) & ~F.coalesce(F.contains(info, F.lit("INDEL")), F.lit(False)) & enough
