"""Changes on transcripts and a genome: codons, synonymous changes, mutated exons, whole transcripts, protein coordinates.

The genome is a table of chunks. What a change needs of it, three bases of a
codon or the exon round it, is fetched by position, so that no row ever carries
a transcript.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.genetics import is_synonymous, on_strand, reverse_complement, swapped, translated
from varloom.functions.sequence import mutation_string
from varloom.operators.intervals import best_per, cds_offset, cds_position, point_in_interval, premrna_offset, segment_offsets, unique_per
from varloom.sources.genome import CHUNK, counted, regions, turned_words, windows
from varloom.support import stored

#: Bases fetched on either side of a mutated exon; more than any feature looks at.
FLANK = 60

# The words by which CpG is counted, as tables by the number of the word; they are alike on both strands.
CPG_WORDS = {"n_cg": [(np.arange(16) == 6).astype(np.uint8)], "n_c": [(np.arange(4) == 1).astype(np.uint8)], "n_g": [(np.arange(4) == 2).astype(np.uint8)]}

# The codons that end a coding sequence.
STOPS = ["TAA", "TAG", "TGA"]


def placed_transcripts(transcripts: DataFrame) -> DataFrame:
    """Usable transcripts with `rec`, a number of the record, its length and its coding segments in reading direction."""
    fields = ["tx", "gene", "chrom", "strand", "tx_start", "tx_end", "cds_start", "cds_end", "exons"]
    usable = transcripts.filter("reason IS NULL")
    return usable.select(F.xxhash64(*fields).alias("rec"), *fields, segment_offsets(F.col("cds"), F.col("strand")).alias("segments"), "cds_length", (F.col("tx_end") - F.col("tx_start")).alias("tx_length"))


def bases_at(places: DataFrame, chunks: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """keys and `bases`: the letters at the 1-based positions in the array `at` on `chrom`, in its order, N where the genome has none.

    Positions are gathered by chunk, so that no row is joined with a chunk's text.
    """
    each = places.select(*keys, "chrom", F.posexplode("at").alias("__i", "pos"))
    joined = each.join(windows(chunks, each.select("chrom", "pos"), 0, size), ["chrom", "pos"], "left")
    letters = joined.select(*keys, F.struct("__i", F.coalesce("around", F.lit("N")).alias("base")).alias("x"))
    return letters.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["base"]), "").alias("bases"))


def codon_places(offset: Column, segments: Column, strand: Column) -> Column:
    """The three genome positions of the codon that holds an offset of the coding sequence, in reading direction."""
    first = offset - offset % 3
    return F.array(*[cds_position(first + k, segments, strand) for k in range(3)])


def with_around(changes: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """changes (chrom, pos, ...) with `around`, the five bases round each, N where the genome has none."""
    found = windows(chunks, changes.select("chrom", "pos"), 2, size)
    return changes.join(found, ["chrom", "pos"], "left").fillna("NNNNN", ["around"])


def with_split_codons(placed: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """placed with `split_codons`, a map from the offset of each codon that lies in several segments to its bases in reading direction."""
    cut = placed.select("rec", "chrom", "strand", "segments", F.explode(F.array_distinct(F.transform("segments", lambda s: s["before"] - s["before"] % 3))).alias("first"))
    places = cut.select("rec", "first", "chrom", codon_places(F.col("first"), F.col("segments"), F.col("strand")).alias("at")).filter(F.forall("at", lambda x: x.isNotNull()))
    maps = bases_at(places.distinct(), chunks, ["rec", "first"], size).groupBy("rec").agg(F.map_from_entries(F.collect_list(F.struct("first", "bases"))).alias("split_codons"))
    return placed.join(maps, "rec", "left")


def with_codons_round(hits: DataFrame) -> DataFrame:
    """with_codons() of hits that have `around` and `split_codons` of with_around() and with_split_codons(): one projection, no join."""
    position, plus = F.col("pos"), F.col("strand") != "-"
    here = F.get(F.filter("segments", lambda s: (s["start"] < position) & (position <= s["end"])), F.lit(0))
    placed = hits.withColumn("__here", here).withColumn("cds_offset", F.col("__here")["before"] + F.when(plus, position - F.col("__here")["start"] - 1).otherwise(F.col("__here")["end"] - position))
    framed = placed.withColumn("frame", (F.col("cds_offset") % 3).cast("int")).withColumn("__first", F.col("cds_offset") - F.col("frame"))
    before, length = F.col("__here")["before"], F.col("__here")["end"] - F.col("__here")["start"]
    whole = (before <= F.col("__first")) & (F.col("__first") + 3 <= before + length)
    read = F.when(plus, F.substring("around", 3 - F.col("frame"), F.lit(3))).otherwise(F.reverse(F.substring("around", 1 + F.col("frame"), F.lit(3))))
    bases = F.when(whole, read).otherwise(F.try_element_at("split_codons", F.col("__first")))
    turned = framed.withColumn("codon", on_strand(bases, F.col("strand"))).withColumn("s_ref", on_strand(F.col("ref"), F.col("strand"))).withColumn("s_alt", on_strand(F.col("alt"), F.col("strand")))
    found = turned.withColumn("is_synonymous", is_synonymous(F.col("codon"), F.col("frame"), F.col("s_ref"), F.col("s_alt")))
    return found.drop("__here", "__first", "around", "split_codons")


def with_codons(hits: DataFrame, chunks: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """hits with s_ref and s_alt on the transcript's strand, cds_offset, frame, codon and is_synonymous.

    `hits` has `keys`, which name a row, and chrom, pos, ref, alt, strand and
    segments. is_synonymous is null outside the coding sequence, in a codon that
    is not whole or known, and false where the genome does not hold ref.
    """
    offset = cds_offset(F.col("pos"), F.col("segments"), F.col("strand"))
    placed = hits.withColumn("cds_offset", offset)
    coding = placed.filter("cds_offset IS NOT NULL").select(*keys, "chrom", codon_places(F.col("cds_offset"), F.col("segments"), F.col("strand")).alias("at"))
    found = bases_at(coding.filter(F.forall("at", lambda x: x.isNotNull())), chunks, keys, size)
    joined = placed.join(found, keys, "left").withColumn("codon", on_strand(F.col("bases"), F.col("strand"))).drop("bases")
    turned = joined.withColumn("s_ref", on_strand(F.col("ref"), F.col("strand"))).withColumn("s_alt", on_strand(F.col("alt"), F.col("strand"))).withColumn("frame", (F.col("cds_offset") % 3).cast("int"))
    return turned.withColumn("is_synonymous", is_synonymous(F.col("codon"), F.col("frame"), F.col("s_ref"), F.col("s_alt")))


def synonymous_hits(changes: DataFrame, placed: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Every change (variant_id, chrom, pos, ref, alt, ...) with each transcript in which it is synonymous."""
    return coding_hits(changes, placed, chunks, size).filter("is_synonymous")


def coding_hits(changes: DataFrame, placed: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Every change with each transcript whose coding range covers it and what with_codons() says.

    The five bases round a change are fetched before it meets the transcripts,
    and those of codons that lie in several segments once a transcript, so the
    hits, each with a whole transcript's places, are not shuffled.
    """
    return with_codons_round(point_in_interval(with_around(changes, chunks, size), with_split_codons(placed, chunks, size), "chrom", "pos", "cds_start", "cds_end"))


def longest(hits: DataFrame) -> DataFrame:
    """Of each change's hits the one in the longest transcript, by name and place where two are as long."""
    return best_per(hits, ["variant_id"], -F.col("tx_length"), *map(F.col, ("tx", "tx_start", "cds_start", "cds_end", "gene", "rec")))


def looked_up_again(named: DataFrame, placed: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Changes (variant_id, gene, tx, pos, ref, alt) with the record of that name in which they are synonymous, if it is just one."""
    hits = named.join(placed, ["gene", "tx"])
    return unique_per(with_codons(hits, chunks, ["variant_id", "rec"], size).filter("is_synonymous"), ["variant_id"])


def protein_changes(records: DataFrame, placed: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(record_id, gene, tx, chrom, pos, ref, alt) of protein coordinates (record_id, gene, aa_pos, aa, ref, alt).

    A transcript fits if its codon of that number encodes the amino acid and
    just one frame of it holds ref such that alt keeps the amino acid. Of the
    transcripts that fit the longest counts. Letters come out on the genome's
    strand.
    """
    asked = records.select("record_id", "gene", "aa_pos", "aa", F.col("ref").alias("s_ref"), F.col("alt").alias("s_alt")).join(placed, "gene")
    asked = asked.withColumn("at", codon_places((F.col("aa_pos") - 1) * 3, F.col("segments"), F.col("strand"))).filter(F.forall("at", lambda x: x.isNotNull()))
    found = bases_at(asked, chunks, ["record_id", "rec"], size)
    codons = asked.join(found, ["record_id", "rec"]).withColumn("codon", on_strand(F.col("bases"), F.col("strand"))).filter(translated(F.col("codon")) == F.col("aa"))
    fits = F.filter(
        F.array(F.lit(0), F.lit(1), F.lit(2)),
        lambda i: (F.substring(F.col("codon"), i + 1, F.lit(1)) == F.col("s_ref")) & F.coalesce(translated(swapped(F.col("codon"), i, F.col("s_alt"))) == F.col("aa"), F.lit(False)),
    )
    one = codons.withColumn("fits", fits).filter(F.size("fits") == 1).withColumn("pos", F.get("at", F.get("fits", F.lit(0))))
    best = best_per(one, ["record_id"], -F.col("tx_length"), F.col("tx"), F.col("rec"))
    return best.select("record_id", "gene", "tx", "chrom", "pos", on_strand(F.col("s_ref"), F.col("strand")).alias("ref"), on_strand(F.col("s_alt"), F.col("strand")).alias("alt"))


def assembled(placed: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Transcripts with premrna and coding, their whole and their spliced sequence in reading direction, and genome_reason.

    genome_reason says what the sequence itself rules out: no_sequence where the
    genome lacks the chromosome, length where the coding sequence is not as long
    as its segments, stop where it does not end in a stop codon.
    """
    wanted = placed.select(F.col("rec").alias("region_id"), F.col("chrom").alias("name"), F.col("tx_start").alias("start"), F.col("tx_end").alias("end"))
    bases = regions(chunks, wanted, size).select(F.col("region_id").alias("rec"), F.upper("seq").alias("seq"))
    joined = placed.join(bases, "rec", "left")
    turned = joined.withColumn("premrna", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).drop("seq")
    start = lambda s: F.when(F.col("strand") == "-", F.col("tx_end") - s["end"]).otherwise(s["start"] - F.col("tx_start"))
    pieces = F.transform("segments", lambda s: F.substring(F.col("premrna"), (start(s) + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    spliced = turned.withColumn("coding", F.when(F.col("premrna").isNotNull(), F.array_join(pieces, "")))
    reason = F.when(F.col("premrna").isNull(), "no_sequence").when(F.length("coding") != F.col("cds_length"), "length").when(~F.right("coding", F.lit(3)).isin(STOPS), "stop")
    return spliced.withColumn("genome_reason", reason)


def exon_edges() -> Column:
    """The cuts of a transcript in reading direction from 0: its ends and those of its exons."""
    both = F.flatten(F.transform("exons", lambda e: F.array(e["start"], e["end"])))
    at = F.transform(both, lambda p: F.when(F.col("strand") == "-", F.col("tx_end") - p).otherwise(p - F.col("tx_start")))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), F.col("tx_end") - F.col("tx_start")), at)))


def marked_transcripts(hits: DataFrame, whole: DataFrame) -> DataFrame:
    """hits with `marked`, the whole transcript cut at its exons with the change written into it; `whole` as from assembled()."""
    joined = hits.join(whole.select("rec", "premrna"), "rec")
    offset = premrna_offset(F.col("pos"), F.col("tx_start"), F.col("tx_end"), F.col("strand"))
    return joined.withColumn("marked", mutation_string(F.col("premrna"), exon_edges(), offset.cast("int"), F.col("s_ref"), F.col("s_alt"))).drop("premrna")


def mutated_exons(hits: DataFrame, chunks: DataFrame, size: int = CHUNK, flank: int = FLANK) -> DataFrame:
    """hits with head, ref, alt, tail of the mutated exon, the bases before and after it, and the lengths of all cuts.

    Each exon is fetched once, however many changes it has, with `flank` bases
    of the transcript on either side; `before` and `after` are arrays of one
    text each, as the parts of a marked transcript. ref and alt come out on the
    transcript's strand. `cuts` holds the lengths of all cuts and `cut` the
    number of the mutated one, from 0.
    """
    offset = premrna_offset(F.col("pos"), F.col("tx_start"), F.col("tx_end"), F.col("strand"))
    edges = hits.withColumn("edges", exon_edges()).withColumn("premrna_offset", offset)
    cut = F.size(F.filter("edges", lambda e: e <= F.col("premrna_offset"))) - 1
    cuts = F.zip_with(F.slice("edges", F.lit(1), F.size("edges") - 1), F.slice("edges", F.lit(2), F.size("edges") - 1), lambda a, b: b - a)
    ranged = edges.withColumn("cut", cut).withColumn("cuts", cuts).withColumn("low", F.get("edges", F.col("cut"))).withColumn("high", F.get("edges", F.col("cut") + 1)).drop("edges")
    genome = lambda a, b: F.when(F.col("strand") == "-", F.col("tx_end") - b).otherwise(F.col("tx_start") + a)
    first, last = F.greatest(F.lit(0), F.col("low") - flank), F.least(F.col("tx_end") - F.col("tx_start"), F.col("high") + flank)
    ranged = ranged.withColumn("first", first).withColumn("last", last).withColumn("start", genome(F.col("first"), F.col("last"))).withColumn("end", F.col("start") + F.col("last") - F.col("first"))
    wanted = ranged.select(F.col("chrom").alias("name"), "start", "end").distinct().withColumn("region_id", F.xxhash64("name", "start", "end"))
    found = regions(chunks, wanted, size).select(F.col("name").alias("chrom"), "start", "end", F.upper("seq").alias("seq"))
    joined = ranged.join(found, ["chrom", "start", "end"])
    turned = joined.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    at = {n: (F.col(n) - F.col("first")).cast("int") for n in ("low", "high", "premrna_offset")}
    piece = lambda a, b: F.substring("seq", a + 1, b - a)
    return turned.select(
        *[c for c in hits.columns if c not in ("ref", "alt")],
        F.col("s_ref").alias("ref"),
        F.col("s_alt").alias("alt"),
        F.array(piece(F.lit(0), at["low"])).alias("before"),
        piece(at["low"], at["premrna_offset"]).alias("head"),
        piece(at["premrna_offset"] + 1, at["high"]).alias("tail"),
        F.array(F.substring("seq", at["high"] + 1, F.length("seq"))).alias("after"),
        "premrna_offset",
        "cut",
        "cuts",
    )


def mutated_surroundings(hits: DataFrame, chunks: DataFrame, size: int = CHUNK, flank: int = FLANK, words: dict[str, list[np.ndarray]] | None = None) -> DataFrame:
    """mutated_exons() without the exon's text: head, tail, before and after hold no more than `flank` bases round the change.

    Beside them are head_length and tail_length of the whole exon, its counts
    n_cg, n_c, n_g and n, and head_plain, whether the whole head is capital
    bases; and for each name of `words`, tables as counted() takes them, how
    often these words are in the whole exon in reading direction. Exons are
    counted from their ends, and no row carries an exon's text.
    """
    words = words or {}
    sides = CPG_WORDS | words | {f"{n}__minus": [turned_words(t) for t in several] for n, several in words.items()}
    offset = premrna_offset(F.col("pos"), F.col("tx_start"), F.col("tx_end"), F.col("strand"))
    edged = hits.withColumn("edges", exon_edges()).withColumn("premrna_offset", offset)
    cut = F.size(F.filter("edges", lambda e: e <= F.col("premrna_offset"))) - 1
    cuts = F.zip_with(F.slice("edges", F.lit(1), F.size("edges") - 1), F.slice("edges", F.lit(2), F.size("edges") - 1), lambda a, b: b - a)
    ranged = edged.withColumn("cut", cut).withColumn("cuts", cuts).withColumn("low", F.get("edges", F.col("cut"))).withColumn("high", F.get("edges", F.col("cut") + 1)).drop("edges")
    minus = F.col("strand") == "-"
    ranged = ranged.withColumn("start", F.when(minus, F.col("tx_end") - F.col("high")).otherwise(F.col("tx_start") + F.col("low"))).withColumn("end", F.col("start") + F.col("high") - F.col("low"))
    ranged = ranged.withColumns({"head_start": F.when(minus, F.col("pos")).otherwise(F.col("start")), "head_end": F.when(minus, F.col("end")).otherwise(F.col("pos") - 1)})
    heads = ranged.select("chrom", F.col("head_start").alias("start"), F.col("head_end").alias("end"))
    found = stored(counted(chunks, ranged.select("chrom", "start", "end").union(heads), sides, size))
    plain = found.select("chrom", F.col("start").alias("head_start"), F.col("end").alias("head_end"), (F.col("n_other") == 0).alias("plain"))
    joined = ranged.join(found, ["chrom", "start", "end"]).join(plain, ["chrom", "head_start", "head_end"], "left").join(windows(chunks, hits.select("chrom", "pos"), flank, size), ["chrom", "pos"])
    text = F.upper(F.when(minus, reverse_complement(F.col("around"))).otherwise(F.col("around")))
    turned = joined.withColumn("around", text)
    n_pre, n_post = F.least(F.lit(flank), F.col("premrna_offset")).cast("int"), F.least(F.lit(flank), F.col("tx_end") - F.col("tx_start") - F.col("premrna_offset") - 1).cast("int")
    pre, post = F.substring("around", flank + 1 - n_pre, n_pre), F.substring("around", F.lit(flank + 2), n_post)
    head_length, tail_length = F.col("premrna_offset") - F.col("low"), F.col("high") - F.col("premrna_offset") - 1
    n_head, n_tail = F.least(n_pre, head_length.cast("int")), F.least(n_post, tail_length.cast("int"))
    return turned.select(
        *[c for c in hits.columns if c not in ("ref", "alt")],
        F.col("s_ref").alias("ref"),
        F.col("s_alt").alias("alt"),
        F.array(F.left(pre, n_pre - n_head)).alias("before"),
        F.right(pre, n_head).alias("head"),
        F.left(post, n_tail).alias("tail"),
        F.array(F.right(post, n_post - n_tail)).alias("after"),
        head_length.cast("long").alias("head_length"),
        tail_length.cast("long").alias("tail_length"),
        F.coalesce("plain", F.lit(True)).alias("head_plain"),
        *("n_cg", "n_c", "n_g", "n", "premrna_offset", "cut", "cuts"),
        *[F.when(minus, F.col(f"{n}__minus")).otherwise(F.col(n)).alias(n) for n in words],
    )


def places_in_transcript(head: Column | None = None, tail: Column | None = None) -> dict[str, Column]:
    """f_premrna and f_mrna from the lengths of the cuts: what relative_positions gives for the marked transcript."""
    total = lambda lengths: F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    even = lambda lengths: F.filter(lengths, lambda x, i: i % 2 == 0)
    head, tail = (F.length(n).cast("long") if c is None else c for n, c in (("head", head), ("tail", tail)))
    before, after = F.slice("cuts", F.lit(1), F.col("cut")), F.slice("cuts", F.col("cut") + 2, F.size("cuts"))
    pre, post = total(before) + head + F.col("cut"), total(after) + tail + F.size(after)
    exon_pre, exon_post = total(even(F.concat(before, F.array(head)))), total(even(F.concat(F.array(tail), after)))
    ratio = lambda a, b: F.least(a, b) / (a + b + 1)
    return {"f_premrna": ratio(pre, post), "f_mrna": ratio(exon_pre, exon_post)}
