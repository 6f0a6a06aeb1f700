"""All synonymous changes of a coding sequence, and random controls matched to given changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.genetics import synonymous_table
from varloom.functions.sequence import makes_cpg
from varloom.operators.splits import shuffled

# Fixed value: bases from a segment's start within which a control counts as near a splice site.
NEAR_SPLICE = 3


def synonymous_sites(sequences: DataFrame, row_id: str, cds: str, segment_starts: Column | None = None) -> DataFrame:
    """(row_id, site, ref, alt, has_cpg, near_splice): every synonymous change of every codon.

    `site` counts from 0 in the spliced coding sequence. `segment_starts` is an
    array of the places where coding segments begin. Codons with anything but
    ACGT, and a rest of fewer than three bases, give none. The changes come from
    a join with a dimension of fixed size, which is broadcast.
    """
    spark = sequences.sparkSession
    rows = sequences.filter(F.length(cds) >= 3).select(row_id, F.col(cds).alias("cds"), (F.array(F.lit(0)) if segment_starts is None else segment_starts).alias("starts"))
    codons = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.length("cds") / 3).cast("int") - 1)).alias("number"))
    codons = codons.withColumn("codon", F.expr("substring(cds, number * 3 + 1, 3)"))
    changes = codons.join(F.broadcast(synonymous_table(spark)), "codon").withColumn("site", F.col("number") * 3 + F.col("frame"))
    ref = F.expr("substring(codon, frame + 1, 1)")
    prev, nxt = F.when(F.col("site") > 0, F.expr("substring(cds, site, 1)")), F.expr("substring(cds, site + 2, 1)")
    distance = F.array_min(F.transform("starts", lambda s: F.abs(s - F.col("site"))))
    return changes.select(row_id, "site", ref.alias("ref"), "alt", makes_cpg(prev, nxt, ref, F.col("alt")).alias("has_cpg"), (distance <= NEAR_SPLICE).alias("near_splice"))


def matched_controls(changes: DataFrame, sites: DataFrame, row_id: str, cpg: str | None, avoid_splice: bool, seed: int = 1) -> DataFrame:
    """(row_id, site, ref, alt, matched): one synonymous site of the same sequence for each change.

    Drawn by a seeded hash among the sites that agree in CpG (if `cpg` names a
    column of `changes`) and lie off splice sites (if asked for); where none
    does, among all, with `matched` false. A change whose sequence has no
    synonymous site gives no row.
    """
    joined = changes.join(sites, row_id)
    fits = F.lit(True)
    if cpg:
        fits = fits & (F.col("has_cpg") == F.col(cpg))
    if avoid_splice:
        fits = fits & ~F.col("near_splice")
    drawn = joined.withColumn("matched", fits).withColumn("key", shuffled(seed, row_id, "site", "alt"))
    first = drawn.groupBy(row_id).agg(F.min(F.struct((~F.col("matched")).alias("off"), "key", "site", "ref", "alt")).alias("x"))
    return first.select(row_id, "x.site", "x.ref", "x.alt", (~F.col("x.off")).alias("matched"))
