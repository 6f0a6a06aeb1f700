"""Bases, codons and codon usage as column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The standard genetic code, amino acids of the codons in the order of BASES.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# Occurrences of each human codon in a thousand.
CODON_USAGE = {
    "TTT": 17.6, "TCT": 15.2, "TAT": 12.2, "TGT": 10.6,
    "TTC": 20.3, "TCC": 17.7, "TAC": 15.3, "TGC": 12.6,
    "TTA": 7.7, "TCA": 12.2, "TAA": 1.0, "TGA": 1.6,
    "TTG": 12.9, "TCG": 4.4, "TAG": 0.8, "TGG": 13.2,
    "CTT": 13.2, "CCT": 17.5, "CAT": 10.9, "CGT": 4.5,
    "CTC": 19.6, "CCC": 19.8, "CAC": 15.1, "CGC": 10.4,
    "CTA": 7.2, "CCA": 16.9, "CAA": 12.3, "CGA": 6.2,
    "CTG": 39.6, "CCG": 6.9, "CAG": 34.2, "CGG": 11.4,
    "ATT": 16.0, "ACT": 13.1, "AAT": 17.0, "AGT": 12.1,
    "ATC": 20.8, "ACC": 18.9, "AAC": 19.1, "AGC": 19.5,
    "ATA": 7.5, "ACA": 15.1, "AAA": 24.4, "AGA": 12.2,
    "ATG": 22.0, "ACG": 6.1, "AAG": 31.9, "AGG": 12.0,
    "GTT": 11.0, "GCT": 18.4, "GAT": 21.8, "GGT": 10.8,
    "GTC": 14.5, "GCC": 27.7, "GAC": 25.1, "GGC": 22.2,
    "GTA": 7.1, "GCA": 15.8, "GAA": 29.0, "GGA": 16.5,
    "GTG": 28.1, "GCG": 7.4, "GAG": 39.6, "GGG": 16.5,
}


@cache
def codon_rows() -> list[tuple[str, str, float, float]]:
    """(codon, amino acid, frequency, rscu) of the 64 codons.

    rscu is the codon's frequency times the number of its amino acid's codons
    over their summed frequency.
    """
    code = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
    family = {aa: [c for c in code if code[c] == aa] for aa in set(code.values())}
    return [(c, aa, CODON_USAGE[c], len(family[aa]) * CODON_USAGE[c] / sum(CODON_USAGE[x] for x in family[aa])) for c, aa in sorted(code.items())]


@cache
def synonymous_changes() -> list[tuple[str, int, str]]:
    """(codon, frame from 0, other base) of every single-base change that keeps the amino acid, stops included."""
    code = {c: aa for c, aa, _, _ in codon_rows()}
    swapped = ((c, i, b, c[:i] + b + c[i + 1 :]) for c in code for i in range(3) for b in "ACGT" if b != c[i])
    return [(c, i, b) for c, i, b, new in swapped if code[new] == code[c]]


def codon_table(spark: SparkSession) -> DataFrame:
    """The codons as a dimension of 64 rows."""
    return spark.createDataFrame(codon_rows(), "codon string, amino_acid string, frequency double, rscu double")


def synonymous_table(spark: SparkSession) -> DataFrame:
    """The synonymous single-base changes as a dimension."""
    return spark.createDataFrame(synonymous_changes(), "codon string, frame int, alt string")


def codon_number(codon: Column) -> Column:
    """The place of a codon among the 64 in alphabetical order, from 0; null for anything else."""
    plain = (F.length(codon) == 3) & (F.translate(codon, "ACGT", "") == "")
    return F.when(plain, F.conv(F.translate(codon, "ACGT", "0123"), 4, 10).cast("int"))


def amino_acid(number: Column) -> Column:
    """One-letter amino acid of a codon by its number, `*` for a stop."""
    return F.get(F.array(*[F.lit(aa) for _, aa, _, _ in codon_rows()]), number)


def usage(number: Column) -> Column:
    """Relative synonymous usage of a codon by its number."""
    return F.get(F.array(*[F.lit(u) for _, _, _, u in codon_rows()]), number)


def translated(codon: Column) -> Column:
    """One-letter amino acid of a codon, `*` for a stop, null for anything else."""
    return amino_acid(codon_number(codon))


def rscu(codon: Column) -> Column:
    """Relative synonymous codon usage, null where the codon is none."""
    return usage(codon_number(codon))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def on_strand(base: Column, strand: Column) -> Column:
    """The base, complemented on the minus strand."""
    return F.when(strand == "-", F.translate(base, "ACGT", "TGCA")).otherwise(base)


def codon_at(cds: Column, number: Column) -> Column:
    """The codon of a 1-based amino-acid number; short or empty past the end."""
    return F.substring(cds, (number - 1) * 3 + 1, F.lit(3))


def swapped(codon: Column, frame: Column, base: Column) -> Column:
    """The codon with the base at a 0-based frame replaced."""
    return F.concat(F.substring(codon, F.lit(1), frame), base, F.substring(codon, frame + 2, F.lit(3)))


def is_synonymous(codon: Column, frame: Column, ref: Column, alt: Column) -> Column:
    """True where the codon holds ref at the frame and alt keeps the amino acid; null where anything is no base.

    A stop that stays a stop counts.
    """
    new = translated(swapped(codon, frame, alt))
    return F.when(translated(codon).isNotNull() & new.isNotNull(), (F.substring(codon, frame + 1, F.lit(1)) == ref) & (new == translated(codon)))
