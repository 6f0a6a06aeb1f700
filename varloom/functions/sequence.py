"""Features of a mutated transcript, written `EX|intron|EX[R/A]EX`, as column expressions.

Every function takes and gives columns, so that all features of a row are
computed in one projection and none needs a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bases on either side of the change in which a motif can be lost or gained.
FLANK = 7

# Weight matrices of splicing factors, a weight for each base and place, and the least score of a hit.
MATRICES = {
    "SF2/ASF": (
        1.956,
        {
            "A": [-1.14, 0.62, -1.58, 1.32, -1.58, -1.58, 0.62],
            "C": [1.37, -1.1, 0.73, 0.33, 0.94, -1.58, -1.58],
            "G": [-0.21, 0.17, 0.48, -1.58, 0.33, 0.99, -0.11],
            "T": [-1.58, -0.5, -1.58, -1.13, -1.58, -1.13, 0.27],
        },
    ),
    "SC35": (
        2.383,
        {
            "A": [-0.88, 0.09, -0.06, -1.58, 0.09, -0.41, -0.06, 0.23],
            "C": [-1.16, -1.58, 0.95, 1.11, 0.56, 0.86, 0.32, -1.58],
            "G": [0.87, 0.45, -1.36, -1.58, -0.33, -0.05, -1.36, 0.68],
            "T": [-1.18, -0.2, 0.38, 0.88, -0.2, -0.86, 0.96, -1.58],
        },
    ),
    "SRp40": (
        2.670,
        {
            "A": [-0.13, -1.58, 1.28, -0.33, 0.97, -0.13, -1.58],
            "C": [0.56, 0.68, -1.12, 1.24, -0.77, 0.13, -0.05],
            "G": [-1.58, -0.14, -1.33, -0.48, -1.58, 0.44, 0.8],
            "T": [0.92, 0.37, 0.23, -1.14, 0.72, -1.58, -1.58],
        },
    ),
    "SRp55": (
        2.676,
        {
            "A": [-0.66, 0.11, -0.66, 0.11, -1.58, 0.61],
            "C": [0.39, -1.58, 1.48, -1.58, -1.58, 0.98],
            "G": [-1.58, 0.72, -1.58, 0.72, 0.21, -0.79],
            "T": [1.22, -1.58, -0.07, -1.58, 1.02, -1.58],
        },
    ),
}


def mutation_string(premrna: Column, edges: Column, offset: Column, ref: Column, alt: Column) -> Column:
    """The sequence cut at the edges, joined by `|`, with `[ref/alt]` at the 0-based offset.

    `edges` is an array of 0-based cuts, 0 and the length among them, in any
    order and with repeats. Null where the sequence does not hold ref there.
    """
    sorted_edges = F.array_sort(F.array_distinct(edges))
    starts = F.slice(sorted_edges, 1, F.size(sorted_edges) - 1)
    ends = F.slice(sorted_edges, F.lit(2), F.size(sorted_edges) - 1)

    def chunk(start: Column, end: Column) -> Column:
        plain = F.substring(premrna, start + 1, end - start)
        at = offset - start
        marked = F.concat(F.substring(plain, F.lit(1), at), F.lit("["), ref, F.lit("/"), alt, F.lit("]"), F.substring(plain, at + 2, F.length(premrna)))
        return F.when((offset >= start) & (offset < end), marked).otherwise(plain)

    return F.when(F.substring(premrna, offset + 1, F.lit(1)) == ref, F.array_join(F.zip_with(starts, ends, chunk), "|"))


def chunks_of(marked: Column) -> Column:
    return F.split(F.upper(marked), r"\|", -1)


def mutated_chunk(chunks: Column) -> Column:
    """The 0-based number of the one chunk that holds a change; null where none or several do."""
    at = F.filter(F.transform(chunks, lambda x, i: F.when(F.instr(x, "/") > 0, i)), lambda i: i.isNotNull())
    return F.when(F.size(at) == 1, F.get(at, F.lit(0)))


def mutation_parts(chunks: Column, index: Column) -> dict[str, Column]:
    """head, ref, alt and tail of the mutated chunk, and the chunks before and after it.

    The chunk is cut at `[`, `/` and `]`. All are null where it does not read as
    bases round one change; a base outside ACGT cuts head and tail short.
    """
    parts = F.split(F.get(chunks, index), r"[\[/\]]", -1)
    part = lambda k: F.get(parts, F.lit(k))
    one_base = lambda c: (F.length(c) == 1) & (F.translate(c, "ACGT", "") == "")
    ok = (F.size(parts) == 4) & one_base(part(1)) & one_base(part(2))
    return {
        "head": F.when(ok, F.regexp_extract(part(0), r"([ACGT]*)\z", 1)),
        "ref": F.when(ok, part(1)),
        "alt": F.when(ok, part(2)),
        "tail": F.when(ok, F.regexp_extract(part(3), r"\A([ACGT]*)", 1)),
        "before": F.when(ok, F.slice(chunks, F.lit(1), index)),
        "after": F.when(ok, F.slice(chunks, index + 2, F.size(chunks))),
    }


def with_parts(df: DataFrame, marked: str) -> tuple[DataFrame, dict[str, Column]]:
    """df with the parts of its mutations as columns, and those columns by name.

    Chunks and their number are columns first, so that they are made once a row.
    raw_head is the head as it was written, in its own case and not cut short.
    """
    kept = [F.col(c) for c in df.columns]
    split = df.select(*kept, chunks_of(F.col(marked)).alias("__chunks"))
    found = split.select(*kept, "__chunks", mutated_chunk(F.col("__chunks")).alias("__index"))
    parts = mutation_parts(F.col("__chunks"), F.col("__index"))
    raw = F.substring_index(F.get(F.split(F.col(marked), r"\|", -1), F.col("__index")), "[", 1)
    return found.select(*kept, *[c.alias(n) for n, c in parts.items()], raw.alias("raw_head")), {n: F.col(n) for n in parts}


def exon_old(m: dict[str, Column]) -> Column:
    return F.concat(m["head"], m["ref"], m["tail"])


def window(m: dict[str, Column], base: str) -> Column:
    """The bases up to FLANK on either side of the change, with `ref` or `alt` between."""
    return F.concat(F.right(m["head"], F.lit(FLANK)), m[base], F.left(m["tail"], F.lit(FLANK)))


def _letters(seq: Column, width: int) -> list[Column]:
    """For each place of a word, the array of the letters that stand there in the words of that width, first word first."""
    chars, n = F.split(seq, ""), F.greatest(F.lit(0), F.length(seq) - (width - 1))
    return [F.slice(chars, 1 + k, n) for k in range(width)]


def _places(values: Column, is_hit) -> Column:
    """The 1-based places of an array at which its values are hits."""
    return F.array_compact(F.transform(values, lambda x, i: F.when(is_hit(x), i + 1)))


def lost_gained(old: Column, new: Column) -> tuple[Column, Column]:
    """How many places are hits in the one sequence only, old and new."""
    return F.size(F.array_except(old, new)), F.size(F.array_except(new, old))


def share(part: Column, base: Column) -> Column:
    """part / (part + base), null where both are 0."""
    return F.try_divide(part.cast("double"), (part + base).cast("double"))


def motif_bits(motifs: DataFrame, column: str, width: int) -> Column:
    """The set of all motifs of that width as a column: a scalar subquery that gives an array of 4 ** width bits.

    A word of bases is a number with a digit for each base, and its bit stands
    at that number, 64 to an entry. So the set has the same size however many
    motifs there are, and a word is looked up in one step. Words with anything
    but ACGT are in no set.
    """
    word = F.upper(F.col(column))
    numbers = motifs.select(word.alias("m")).filter((F.length("m") == width) & (F.translate("m", "ACGT", "") == "")).select(F.conv(F.translate("m", "ACGT", "0123"), 4, 10).cast("long").alias("n"))
    entries = numbers.groupBy(F.floor(F.col("n") / 64).cast("int").alias("entry")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(n % 64 AS INT))")).alias("bits"))
    found = entries.agg(F.map_from_entries(F.collect_list(F.struct("entry", "bits"))).alias("found"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(max(1, 4**width // 64) - 1)), lambda e: F.coalesce(F.try_element_at("found", e), F.lit(0).cast("long")))
    return found.select(whole.alias("bits")).scalar()


def motif_words(bits: list[int] | None, width: int) -> np.ndarray:
    """The set of motif_bits() as a table with 1 at the number of each word that is in it."""
    if bits is None:
        return np.zeros(4**width, np.uint8)
    return np.unpackbits(np.array(bits, dtype="<i8").view(np.uint8), bitorder="little")[: 4**width]


def motif_hits(bits: str, width: int):
    """A function from a sequence to the places at which a motif of the set in the column `bits` begins.

    The numbers of the words are put together base by base over the whole
    sequence, in time that grows with its length.
    """

    def places(seq: Column) -> Column:
        digits = F.transform(F.split(F.translate(seq, "ACGT", "0123"), ""), lambda c: c.try_cast("int"))
        n = F.greatest(F.lit(0), F.length(seq) - (width - 1))
        numbers = F.slice(digits, F.lit(1), n)
        for k in range(1, width):
            numbers = F.zip_with(numbers, F.slice(digits, F.lit(1 + k), n), lambda x, d: x * 4 + d)
        is_hit = lambda n: F.coalesce(F.getbit(F.get(F.col(bits), F.floor(n / 64).cast("int")), n % 64) == 1, F.lit(False))
        return _places(numbers, is_hit)

    return places


def matrix_hits(name: str):
    """A function from a sequence to the places at which the word's weights reach the matrix's threshold."""
    threshold, weights = MATRICES[name]

    def weight(k: int):
        return lambda b: F.when(b == "A", weights["A"][k]).when(b == "C", weights["C"][k]).when(b == "G", weights["G"][k]).when(b == "T", weights["T"][k])

    def places(seq: Column) -> Column:
        totals = None
        for k, letters in enumerate(_letters(seq, len(weights["A"]))):
            part = F.transform(letters, weight(k))
            totals = part if totals is None else F.zip_with(totals, part, lambda a, b: a + b)
        return _places(totals, lambda t: F.round(t, 6) >= threshold)

    return places


def matrix_words(name: str) -> np.ndarray:
    """A table with 1 at the number of each word whose weights reach the matrix's threshold."""
    threshold, weights = MATRICES[name]
    width = len(weights["A"])
    numbers, totals = np.arange(4**width), np.zeros(4**width)
    for k in range(width):
        totals = totals + np.array([weights[b][k] for b in "ACGT"])[numbers // 4 ** (width - 1 - k) % 4]
    return (np.round(totals, 6) >= threshold).astype(np.uint8)


def motif_feature(m: dict[str, Column], finders: list, counted: Column | None = None) -> dict[str, Column]:
    """n_old, n_lost, n_gained over several finders of hits, and their shares `lost` and `gained`.

    n_old counts hits in the whole mutated chunk, lost and gained the places of
    the window that are hits before or after the change only. Where n_old is
    known, as `counted`, only the window is searched.
    """
    totals = [F.lit(0), F.lit(0), F.lit(0)]
    for find in finders:
        lost, gained = lost_gained(find(window(m, "ref")), find(window(m, "alt")))
        totals = [a + b for a, b in zip(totals, [F.lit(0) if counted is not None else F.size(find(exon_old(m))), lost, gained])]
    totals[0] = totals[0] if counted is None else counted
    n_old, n_lost, n_gained = [F.when(m["ref"].isNotNull(), t) for t in totals]
    return {"n_old": n_old, "n_lost": n_lost, "n_gained": n_gained, "lost": share(n_lost, n_old), "gained": share(n_gained, n_old)}


def makes_cpg(prev: Column, nxt: Column, ref: Column, alt: Column) -> Column:
    """Whether a change makes or breaks a CpG; an absent neighbour ('' or null) makes none."""
    left = F.coalesce((prev == "C") & ((ref == "G") | (alt == "G")), F.lit(False))
    right = F.coalesce((nxt == "G") & ((ref == "C") | (alt == "C")), F.lit(False))
    return left | right


def cpg_ratio(seq: Column) -> Column:
    """Observed over expected CpG: count(CG) * length / (count(C) * count(G)), 0 without C or G."""
    count = lambda word: (F.length(seq) - F.length(F.replace(seq, F.lit(word), F.lit("")))) / len(word)
    return F.coalesce(F.try_divide(count("CG") * F.length(seq), count("C") * count("G")), F.when(seq.isNotNull(), F.lit(0.0)))


def cpg_ratio_of(n_cg: Column, n_c: Column, n_g: Column, n: Column) -> Column:
    """cpg_ratio() of a sequence known by its counts."""
    return F.coalesce(F.try_divide(n_cg.cast("double") * n, n_c.cast("double") * n_g), F.when(n.isNotNull(), F.lit(0.0)))


def _even(chunks: Column) -> Column:
    return F.filter(chunks, lambda x, i: i % 2 == 0)


def relative_positions(marked: Column, m: dict[str, Column]) -> dict[str, Column]:
    """f_premrna and f_mrna: the nearer end's distance over the length.

    f_premrna counts every character before and after the brackets, cut marks
    included; f_mrna only the exons, which are the even chunks on each side.
    """
    pre, post = F.length(F.substring_index(marked, "[", 1)), F.length(F.substring_index(marked, "]", -1))
    before = F.concat(m["before"], F.array(m["head"]))
    after = F.concat(F.array(m["tail"]), m["after"])
    exon_pre, exon_post = F.length(F.array_join(_even(before), "")), F.length(F.array_join(_even(after), ""))
    ratio = lambda a, b: F.least(a, b) / (a + b + 1)
    return {"f_premrna": F.when(m["ref"].isNotNull(), ratio(pre, post)), "f_mrna": F.when(m["ref"].isNotNull(), ratio(exon_pre, exon_post))}


def splice_distance(m: dict[str, Column]) -> Column:
    """Bases to the nearer end of the mutated chunk."""
    return F.least(F.length(m["head"]), F.length(m["tail"]))


def cropped(pre: Column, post: Column, width: int) -> tuple[Column, Column]:
    """2 * width bases round the change: a side that is too short lends its rest to the other; null where both are short."""
    n_pre, n_post = F.length(pre), F.length(post)
    take_pre = F.least(n_pre, F.lit(width) + F.greatest(F.lit(0), F.lit(width) - n_post))
    take_post = F.least(n_post, F.lit(width) + F.greatest(F.lit(0), F.lit(width) - n_pre))
    whole = take_pre + take_post == 2 * width
    return F.when(whole, F.right(pre, take_pre)), F.when(whole, F.left(post, take_post))


def log_ratio(old: Column, new: Column) -> Column:
    """-log10(new / old), null where old is 0 or the ratio is not positive."""
    ratio = F.try_divide(new, old)
    return F.when(ratio > 0, -F.log10(ratio))
