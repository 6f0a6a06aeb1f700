"""Registered queries over sequences drawn from the documents, with their SQL.

A document's sequence is the letters A, C, G and T of its text. Its change
stands at the place doc_id * 7 modulo the length, and cuts stand at the thirds,
so that the first and last third are exons and the middle one an intron.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import genetics, sequence, splice
from varloom.functions.registry import Family, register, with_features
from varloom.operators import generate, models, ranking, scoring, standardize
from varloom.sources import genome
from varloom.support import stored, table

#: Bases of a domain cut out for folding, on either side of the change.
DOMAIN = 20


def bases(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^ACGT]", "")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, offset, ref, alt and the cuts a, b of every document with at least 16 bases."""
    seqs = table(spark, sf_dir, "documents").select("doc_id", bases(F.col("text")).alias("seq")).filter(F.length("seq") >= 16)
    n = F.length("seq")
    placed = seqs.withColumn("offset", F.pmod(F.col("doc_id") * 7, n).cast("int")).withColumn("a", F.floor(n / 3).cast("int")).withColumn("b", F.floor(2 * n / 3).cast("int"))
    ref = F.expr("substring(seq, offset + 1, 1)")
    return placed.withColumn("ref", ref).withColumn("alt", F.translate("ref", "ACGT", "GATC"))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, offset, s_ref, s_alt, marked and the parts of the marked sequence."""
    s = sequences(spark, sf_dir)
    edges = F.array(F.lit(0), F.col("a"), F.col("b"), F.length("seq"), F.lit(0))
    marked = sequence.mutation_string(F.col("seq"), edges, F.col("offset"), F.col("ref"), F.col("alt"))
    return sequence.with_parts(s.select("doc_id", "seq", "offset", F.col("ref").alias("s_ref"), F.col("alt").alias("s_alt"), marked.alias("marked")), "marked")[0]


def src_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of sequences round their changes, clamped at both ends."""
    s = sequences(spark, sf_dir)
    chunks = genome.chunked(s.withColumn("name", F.col("doc_id").cast("string")), "name", "seq", 64)
    wanted = s.select(F.col("doc_id").alias("region_id"), F.col("doc_id").cast("string").alias("name"), (F.col("offset") - 50).alias("start"), (F.col("offset") + 100).alias("end"))
    return genome.regions(chunks, wanted, 64).select("region_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "seq")


def src_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every sequence that has a base, however short."""
    every = table(spark, sf_dir, "documents").select("doc_id", bases(F.col("text")).alias("seq"))
    return genome.sizes(genome.chunked(every, "doc_id", "seq", 64)).select(F.col("name").alias("doc_id"), "size")


def parts() -> dict[str, Column]:
    """The parts of the marked sequence by name, as changed() has them."""
    return {n: F.col(n) for n in ("head", "ref", "alt", "tail", "before", "after")}


def seq_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir).select("doc_id", "marked", "head", "ref", "alt", "tail", sequence.splice_distance(parts()).alias("splice_distance"))


#: The motif sets that stand in for published lists: name, subject whose samples they are drawn from, width.
MOTIFS = (("enh", "science", 8), ("sup", "law", 8), ("sil", "procedure", 6))


def _words(spark: SparkSession, sf_dir: str, subject: str, width: int) -> DataFrame:
    """The words of one width in the sequences of a subject's samples."""
    seqs = table(spark, sf_dir, "subject_samples").filter(F.col("subject") == subject).select(bases(F.col("text")).alias("s")).filter(F.length("s") >= width)
    return seqs.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - (width - 1)), lambda i: F.substring("s", i, F.lit(width)))).alias("motif"))


def with_motifs(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """df with the bits of each motif set."""
    return df.select("*", *[sequence.motif_bits(_words(spark, sf_dir, subject, width), "motif", width).alias(f"bits_{name}") for name, subject, width in MOTIFS])


def _motif_features() -> dict[str, Column]:
    """Lost and gained enhancers and suppressors of eight bases and silencers of six."""
    out = {}
    for name, _, _ in MOTIFS:
        n = {k: F.col(f"{name}_n_{k}") for k in ("old", "lost", "gained")}
        out |= {f"{name}_lost": F.round(sequence.share(n["lost"], n["old"]), 6), f"{name}_gained": F.round(sequence.share(n["gained"], n["old"]), 6)}
    return out


def _motif_counts(counted: bool = False) -> dict[str, Column]:
    out = {}
    for name, _, width in MOTIFS:
        f = sequence.motif_feature(parts(), [sequence.motif_hits(f"bits_{name}", width)], F.col(f"n_{name}") if counted else None)
        out |= {f"{name}_n_{k}": f[f"n_{k}"] for k in ("old", "lost", "gained")}
    return out


def _matrix_counts(counted: bool = False) -> dict[str, Column]:
    f = sequence.motif_feature(parts(), [sequence.matrix_hits(n) for n in sorted(sequence.MATRICES)], F.col("n_sr") if counted else None)
    return {f"sr_n_{k}": f[f"n_{k}"] for k in ("old", "lost", "gained")}


def _matrix_features() -> dict[str, Column]:
    return {f"sr_{k}": F.round(sequence.share(F.col(f"sr_n_{k}"), F.col("sr_n_old")), 6) for k in ("lost", "gained")}


def _cpg_features() -> dict[str, Column]:
    """CpG made or broken, and observed over expected; null where the head holds anything but capital bases."""
    plain = F.translate("raw_head", "ACGT", "") == ""
    cpg = sequence.makes_cpg(F.right("head", F.lit(1)), F.left("tail", F.lit(1)), F.col("ref"), F.col("alt"))
    return {"is_cpg": F.when(plain, cpg.cast("int")), "cpg_exon": F.when(plain, F.round(sequence.cpg_ratio(F.col("exon")), 6))}


def _counted_cpg_features() -> dict[str, Column]:
    """The features of cpg for an exon of which only counts are known."""
    cpg = sequence.makes_cpg(F.right("head", F.lit(1)), F.left("tail", F.lit(1)), F.col("ref"), F.col("alt"))
    ratio = sequence.cpg_ratio_of(*map(F.col, ("n_cg", "n_c", "n_g", "n")))
    return {"is_cpg": F.when(F.col("head_plain"), cpg.cast("int")), "cpg_exon": F.when(F.col("head_plain"), F.round(ratio, 6))}


def _position_features() -> dict[str, Column]:
    f = sequence.relative_positions(F.col("marked"), parts())
    return {"f_premrna": F.round(f["f_premrna"], 6), "f_mrna": F.round(f["f_mrna"], 6)}


def _codons() -> dict[str, Column]:
    codon = genetics.codon_at(F.col("seq"), F.floor(F.col("offset") / 3).cast("int") + 1)
    return {"codon": F.when(F.length(codon) == 3, codon), "frame": F.col("offset") % 3}


def _new_codons() -> dict[str, Column]:
    return {"new_codon": genetics.swapped(F.col("codon"), F.col("frame"), F.col("s_alt")), "codon_number": genetics.codon_number(F.col("codon"))}


def _new_numbers() -> dict[str, Column]:
    return {"new_number": genetics.codon_number(F.col("new_codon")), "amino_acid": genetics.amino_acid(F.col("codon_number"))}


def _synonymous() -> dict[str, Column]:
    return {"is_synonymous": F.col("amino_acid") == genetics.amino_acid(F.col("new_number"))}


def _usage_features() -> dict[str, Column]:
    """The usage of the new codon where the change is synonymous."""
    new, old = genetics.usage(F.col("new_number")), genetics.usage(F.col("codon_number"))
    return {"rscu": F.when(F.col("is_synonymous"), F.round(new, 6)), "d_rscu": F.when(F.col("is_synonymous"), F.round(F.abs(new - old), 6))}


def site_strength(site: Column) -> Column:
    """A plain stand-in for a trained splice-site scorer: a weight for each base."""
    count = lambda b: F.length(site) - F.length(F.replace(site, F.lit(b), F.lit("")))
    return count("G") * 0.75 + count("T") * 0.5 - count("A") * 0.25 - count("C") * 0.125


def _around() -> dict[str, Column]:
    return {f"sp_{n}": c for n, c in splice.spliced(parts()).items()}


def _sp() -> dict[str, Column]:
    return {n: F.col(f"sp_{n}") for n in ("old", "new", "n_pre", "n_post")}


def _junctions() -> dict[str, Column]:
    both = (5, 3)
    return {f"sp_kept{side}": splice.scored_junctions(_sp(), side, site_strength) for side in both} | {f"sp_known{side}": splice.known_junction(_sp(), side) for side in both}


def _splice_features() -> dict[str, Column]:
    """The seven junction features, the larger of both sides."""
    f = splice.either_side(*[splice.junction_features(F.col(f"sp_kept{side}"), F.col(f"sp_known{side}")) for side in (5, 3)])
    return {n: c.cast("int") if n.startswith(("mec", "mes_known")) else c for n, c in f.items()}


def _domains() -> dict[str, Column]:
    pre, post = sequence.cropped(F.expr("left(seq, offset)"), F.expr("substring(seq, offset + 2)"), DOMAIN)
    return {"fold_pre": pre, "fold_post": post}


def pairing_energy(domain: Column) -> Column:
    """A plain stand-in for a folding energy: three for each G or C, two for each other base."""
    gc = F.length(domain) - F.length(F.translate(domain, "GC", ""))
    return -(gc * 3 + (F.length(domain) - gc) * 2) / F.lit(10.0)


def pairing_variety(domain: Column) -> Column:
    """A plain stand-in for an ensemble's diversity: how far the shares of the four bases are from one another."""
    count = lambda b: F.length(domain) - F.length(F.translate(domain, b, ""))
    return F.lit(1.0) * (count("A") + 1) * (count("C") + 1) * (count("G") + 1) * (count("T") + 1) / F.length(domain)


def folding(scorer: Callable[[Column], Column], name: str) -> Family:
    """A family of one feature, the log ratio of a scorer's values for the domain after and before the change."""
    energy = lambda base: scorer(F.concat("fold_pre", base, "fold_post"))
    return Family(name, lambda: {name: F.round(sequence.log_ratio(energy("s_ref"), energy("s_alt")), 9)})


for family in (
    Family("motifs", _motif_features, [_motif_counts]),
    Family("matrices", _matrix_features, [_matrix_counts]),
    Family("motifs_counted", _motif_features, [lambda: _motif_counts(True)]),
    Family("matrices_counted", _matrix_features, [lambda: _matrix_counts(True)]),
    Family("cpg", _cpg_features, [lambda: {"exon": sequence.exon_old(parts())}]),
    Family("cpg_counted", _counted_cpg_features),
    Family("position", _position_features),
    Family("usage", _usage_features, [_codons, _new_codons, _new_numbers, _synonymous]),
    Family("splice", _splice_features, [_around, _junctions]),
    Family("domains", dict, [_domains]),
    folding(pairing_energy, "pdg"),
    folding(pairing_variety, "pvar"),
):
    register(family)

#: The families of the feature matrix, in the order of its columns.
MATRIX = ["usage", "cpg", "matrices", "splice", "motifs", "position", "domains", "pdg", "pvar"]


def seq_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_motifs(spark, sf_dir, changed(spark, sf_dir))
    counts = df.select("doc_id", *[c.alias(n) for n, c in _motif_counts().items()])
    return counts.select("doc_id", *[F.col(f"{n}_n_old").cast("long").alias(f"{n}_old") for n, _, _ in MOTIFS], *[c.alias(n) for n, c in _motif_features().items()])


def seq_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the weight matrices, summed over all four, lost and gained."""
    counts = changed(spark, sf_dir).select("doc_id", *[c.cast("long").alias(n) for n, c in _matrix_counts().items()])
    f = _matrix_features()
    return counts.select("doc_id", F.col("sr_n_old").alias("n_old"), F.col("sr_n_lost").alias("n_lost"), F.col("sr_n_gained").alias("n_gained"), f["sr_lost"].alias("lost"), f["sr_gained"].alias("gained"))


def seq_cpg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(changed(spark, sf_dir), ["doc_id"], ["cpg"])


def seq_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(changed(spark, sf_dir), ["doc_id"], ["position"])


def seq_codon_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codon of each change, whether the change is synonymous, and the usage then."""
    s = sequences(spark, sf_dir).select("doc_id", "seq", "offset", F.col("alt").alias("s_alt"))
    usage = with_features(s, ["doc_id", "codon", "new_codon", "amino_acid", "is_synonymous"], ["usage"]).filter("codon IS NOT NULL")
    return usage.withColumn("reverse", genetics.reverse_complement(F.col("codon")))


def _spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in _around().items()])


def seq_splice_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct candidate sites of both sequences on either side."""
    df, both = _spliced(spark, sf_dir), None
    for side in (5, 3):
        sites = df.select("doc_id", F.lit(side).alias("side"), F.explode(splice.junctions(_sp(), side)).alias("junction"), "sp_old", "sp_new")
        two = sites.select("doc_id", "side", "junction", F.explode(F.array(splice.site(F.col("sp_old"), F.col("junction"), side), splice.site(F.col("sp_new"), F.col("junction"), side))).alias("site"))
        both = two if both is None else both.unionByName(two)
    return both.distinct()


def seq_site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites scored by a Python plug-in, each distinct one once: how a scorer that is no expression is put in."""

    def gc(sites: pd.Series) -> pd.Series:
        return (sites.str.count("[GC]") / sites.str.len()).astype("float64")

    return scoring.scored(seq_splice_sites(spark, sf_dir), "site", gc).select("doc_id", "side", "junction", "site", F.round("score", 9).alias("score"))


def seq_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(changed(spark, sf_dir), ["doc_id"], ["splice"])


def seq_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of a plain pairing energy in a domain cut out round each change."""
    df = with_features(sequences(spark, sf_dir).select("doc_id", "seq", "offset", F.col("ref").alias("s_ref"), F.col("alt").alias("s_alt")), ["doc_id", "fold_pre", "fold_post"], ["domains", "pdg"])
    return df.withColumnsRenamed({"fold_pre": "pre", "fold_post": "post"})


def seq_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of a plain ensemble diversity in the same domain."""
    return with_features(sequences(spark, sf_dir).select("doc_id", "seq", "offset", F.col("ref").alias("s_ref"), F.col("alt").alias("s_alt")), ["doc_id"], ["domains", "pvar"])


def gen_all_synonymous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.synonymous_sites(sequences(spark, sf_dir), "doc_id", "seq", F.array(F.lit(0), F.col("a"), F.col("b")))


def gen_matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random control for each change, alike in CpG and off splice sites where there is one."""
    s = sequences(spark, sf_dir)
    prev, nxt = F.expr("CASE WHEN offset > 0 THEN substring(seq, offset, 1) END"), F.expr("substring(seq, offset + 2, 1)")
    changes = s.select("doc_id", sequence.makes_cpg(prev, nxt, F.col("ref"), F.col("alt")).alias("cpg"))
    return generate.matched_controls(changes, gen_all_synonymous(spark, sf_dir), "doc_id", "cpg", True)


def seq_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of each change in one row, nulls as 0: one scan, one projection a step, no join.

    Conservation is missing: it is known by chromosome and position, which
    documents do not have.
    """
    return with_features(with_motifs(spark, sf_dir, changed(spark, sf_dir)), ["doc_id"], MATRIX).na.fill(0)


def seq_matrix_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change's rank by the linear SVM's score over the feature matrix, standardized against the control.

    The tables name no harmful changes, so documents of even id stand in for
    the control and the others for the examples.
    """
    matrix = stored(seq_feature_matrix(spark, sf_dir).withColumn("label", F.pmod("doc_id", F.lit(2)).cast("int")))
    features = [c for c in matrix.columns if c not in ("doc_id", "label")]
    z = standardize.standardized(matrix, features, matrix.filter("label = 0"))
    ranked = ranking.average_rank(models.scores(models.linear_svm(features, "label").fit(z), z).select("doc_id", "label", "score"), "score", [])
    return ranked.select(ranking.rank_text(F.col("rank")).alias("rank"), "score", "label", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        src_regions, src_sizes, seq_mutations, seq_motifs, seq_matrices, seq_cpg, seq_position, seq_codon_usage, seq_splice_sites,
        seq_site_scores, seq_splice, seq_folding, seq_variety, gen_all_synonymous, gen_matched_controls, seq_feature_matrix, seq_matrix_ranks,
    )
}

_SEQ = """
seqs AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents),
s AS (
  SELECT *, seq[o + 1] AS ref, translate(seq[o + 1], 'ACGT', 'GATC') AS alt, n // 3 AS a, 2 * n // 3 AS b
  FROM (SELECT doc_id, seq, length(seq) AS n, (doc_id * 7) % length(seq) AS o FROM seqs WHERE length(seq) >= 16)
),
m AS (
  SELECT *, seq[lo + 1:o] AS head, seq[o + 2:hi] AS tail, seq[lo + 1:hi] AS exon, o - lo AS n_head, hi - o - 1 AS n_tail
  FROM (SELECT *, CASE WHEN o < a THEN 0 WHEN o < b THEN a ELSE b END AS lo, CASE WHEN o < a THEN a WHEN o < b THEN b ELSE n END AS hi FROM s)
),
w AS (SELECT *, right(head, 7) || ref || left(tail, 7) AS w_ref, right(head, 7) || alt || left(tail, 7) AS w_alt FROM m)
"""

_CODONS = ", ".join(f"('{c}', '{aa}', {u!r})" for c, aa, _, u in genetics.codon_rows())
_CHANGES = ", ".join(f"('{c}', {i}, '{b}')" for c, i, b in genetics.synonymous_changes())


def _motif_sql() -> str:
    ctes, columns, joins = [], [], []
    for name, subject, width in (("enh", "science", 8), ("sup", "law", 8), ("sil", "procedure", 6)):
        k = width - 1
        ctes.append(f"""
        {name}_m AS (SELECT DISTINCT q[i:i + {k}] AS motif FROM (SELECT q, unnest(range(1, length(q) - {k} + 1)) AS i FROM (
            SELECT regexp_replace(upper(text), '[^ACGT]', '', 'g') AS q FROM subject_samples WHERE subject = '{subject}') WHERE length(q) >= {width})),
        {name}_h AS (SELECT doc_id, kind, i FROM (
            SELECT doc_id, kind, i, t[i:i + {k}] AS motif FROM (SELECT doc_id, kind, t, unnest(range(1, length(t) - {k} + 1)) AS i FROM (
              SELECT doc_id, 'old' AS kind, exon AS t FROM w UNION ALL SELECT doc_id, 'ref', w_ref FROM w UNION ALL SELECT doc_id, 'alt', w_alt FROM w) WHERE length(t) >= {width})
          ) SEMI JOIN {name}_m USING (motif)),
        {name} AS (SELECT doc_id, count(*) FILTER (kind = 'old') AS n_old FROM {name}_h GROUP BY 1),
        {name}_c AS (SELECT doc_id, sum(lost) AS n_lost, sum(gained) AS n_gained FROM (
            SELECT doc_id, i, CAST(bool_or(kind = 'ref') AND NOT bool_or(kind = 'alt') AS INT) AS lost, CAST(bool_or(kind = 'alt') AND NOT bool_or(kind = 'ref') AS INT) AS gained
            FROM {name}_h WHERE kind <> 'old' GROUP BY doc_id, i) GROUP BY 1)""")
        old, lost, gained = f"coalesce({name}.n_old, 0)", f"coalesce({name}_c.n_lost, 0)", f"coalesce({name}_c.n_gained, 0)"
        columns.append(f"""{old} AS {name}_old, round(CASE WHEN {lost} + {old} > 0 THEN CAST({lost} AS DOUBLE) / ({lost} + {old}) END, 6) AS {name}_lost,
          round(CASE WHEN {gained} + {old} > 0 THEN CAST({gained} AS DOUBLE) / ({gained} + {old}) END, 6) AS {name}_gained""")
        joins.append(f"LEFT JOIN {name} USING (doc_id) LEFT JOIN {name}_c USING (doc_id)")
    return f"WITH {_SEQ}, {', '.join(ctes)} SELECT doc_id, {', '.join(columns)} FROM w {' '.join(joins)}"


def _matrix_sql() -> str:
    weights = ", ".join(f"('{n}', {t}, {len(ws['A'])}, '{b}', {i}, {x})" for n, (t, ws) in sequence.MATRICES.items() for b in "ACGT" for i, x in enumerate(ws[b]))
    return f"""WITH {_SEQ}, weights(name, threshold, width, base, place, weight) AS (VALUES {weights}),
      texts AS (SELECT doc_id, 'old' AS kind, exon AS t FROM w UNION ALL SELECT doc_id, 'ref', w_ref FROM w UNION ALL SELECT doc_id, 'alt', w_alt FROM w),
      letters AS (SELECT doc_id, kind, length(t) AS n, p, t[p] AS base FROM (SELECT *, unnest(range(1, length(t) + 1)) AS p FROM texts)),
      hits AS (SELECT doc_id, kind, name, p - place AS i FROM letters JOIN weights USING (base) WHERE p - place >= 1 AND p - place + width - 1 <= n
        GROUP BY doc_id, kind, name, threshold, p - place HAVING round(sum(weight), 6) >= threshold),
      olds AS (SELECT doc_id, count(*) AS n_old FROM hits WHERE kind = 'old' GROUP BY 1),
      moved AS (SELECT doc_id, count(*) FILTER (NOT is_alt) AS n_lost, count(*) FILTER (NOT is_ref) AS n_gained FROM (
        SELECT doc_id, bool_or(kind = 'ref') AS is_ref, bool_or(kind = 'alt') AS is_alt FROM hits WHERE kind <> 'old' GROUP BY doc_id, name, i) GROUP BY 1),
      c AS (SELECT doc_id, coalesce(n_old, 0) AS n_old, coalesce(n_lost, 0) AS n_lost, coalesce(n_gained, 0) AS n_gained FROM w LEFT JOIN olds USING (doc_id) LEFT JOIN moved USING (doc_id))
      SELECT *, round(CASE WHEN n_lost + n_old > 0 THEN CAST(n_lost AS DOUBLE) / (n_lost + n_old) END, 6) AS lost, round(CASE WHEN n_gained + n_old > 0 THEN CAST(n_gained AS DOUBLE) / (n_gained + n_old) END, 6) AS gained FROM c"""


def _cpg(prev: str, nxt: str) -> str:
    return f"((coalesce({prev}, '') = 'C' AND (ref = 'G' OR alt = 'G')) OR (coalesce({nxt}, '') = 'G' AND (ref = 'C' OR alt = 'C')))"


_SITES = f"""{_SEQ},
sp AS (SELECT doc_id, pre || head || ref || tail || post AS old, pre || head || alt || tail || post AS new, length(pre) AS n_pre, length(post) AS n_post
  FROM (SELECT *, right(seq[1:lo], 20) AS pre, left(seq[hi + 1:], 6) AS post FROM m)),
cand AS (
  SELECT doc_id, old, new, n_pre, n_post, 5 AS side, 3 AS bef, 6 AS aft, 0 AS shift, 'GT' AS word FROM sp UNION ALL SELECT doc_id, old, new, n_pre, n_post, 3, 20, 3, 2, 'AG' FROM sp
),
known AS (SELECT *, CASE WHEN side = 3 AND n_pre > 0 THEN n_pre WHEN side = 5 AND n_post > 0 THEN length(old) - n_post END AS known FROM cand),
places AS (SELECT *, unnest(list_distinct(
    list_transform(list_filter(range(greatest(n_pre, bef), length(old) - greatest(n_post, aft) - 1), lambda i: old[i + 1:i + 2] = word OR new[i + 1:i + 2] = word), lambda i: i + shift)
    || CASE WHEN known IS NULL THEN [] ELSE [known] END)) AS junction FROM known),
j AS (SELECT doc_id, side, known, junction, old[junction - bef + 1:junction + aft] AS o_site, new[junction - bef + 1:junction + aft] AS n_site FROM places WHERE junction >= bef AND junction + aft <= length(old)),
sites AS (SELECT DISTINCT doc_id, side, junction, site FROM (SELECT doc_id, side, junction, o_site AS site FROM j UNION ALL SELECT doc_id, side, junction, n_site FROM j))
"""


def _strength(c: str) -> str:
    n = lambda b: f"(length({c}) - length(replace({c}, '{b}', '')))"
    return f"({n('G')} * 0.75 + {n('T')} * 0.5 - {n('A')} * 0.25 - {n('C')} * 0.125)"


_GENERATED = f"""{_SEQ}, changes(codon, frame, alt) AS (VALUES {_CHANGES}),
sites AS (
  SELECT doc_id, CAST(k * 3 + frame AS INT) AS site, codon[frame + 1] AS ref, c.alt, seq, a, b
  FROM (SELECT doc_id, seq, a, b, k, seq[k * 3 + 1:k * 3 + 3] AS codon FROM (SELECT *, unnest(range(0, n // 3)) AS k FROM s)) JOIN changes c USING (codon)
),
every AS (SELECT doc_id, site, ref, alt, {_cpg("CASE WHEN site > 0 THEN seq[site] END", "seq[site + 2]")} AS has_cpg, least(site, abs(a - site), abs(b - site)) <= 3 AS near_splice FROM sites)
"""

ORACLE = {
    "src_regions": f"WITH {_SEQ} SELECT doc_id AS region_id, greatest(o - 50, 0) AS start, least(o + 100, n) AS \"end\", seq[greatest(o - 50, 0) + 1:least(o + 100, n)] AS seq FROM s",
    "src_sizes": f"WITH {_SEQ} SELECT doc_id, length(seq) AS size FROM seqs WHERE length(seq) > 0",
    "seq_mutations": f"""WITH {_SEQ} SELECT doc_id, CASE WHEN o < a THEN mark || '|' || seq[a + 1:b] || '|' || seq[b + 1:] WHEN o < b THEN seq[1:a] || '|' || mark || '|' || seq[b + 1:]
        ELSE seq[1:a] || '|' || seq[a + 1:b] || '|' || mark END AS marked, head, ref, alt, tail, CAST(least(n_head, n_tail) AS INT) AS splice_distance
      FROM (SELECT *, head || '[' || ref || '/' || alt || ']' || tail AS mark FROM m)""",
    "seq_motifs": _motif_sql(),
    "seq_matrices": _matrix_sql(),
    "seq_cpg": f"""WITH {_SEQ} SELECT doc_id, CAST({_cpg("right(head, 1)", "left(tail, 1)")} AS INT) AS is_cpg, round(coalesce(CASE WHEN c * g > 0 THEN CAST(cg AS DOUBLE) * length(exon) / (c * g) END, 0), 6) AS cpg_exon
      FROM (SELECT *, (length(exon) - length(replace(exon, 'CG', ''))) // 2 AS cg, length(exon) - length(replace(exon, 'C', '')) AS c, length(exon) - length(replace(exon, 'G', '')) AS g FROM m)""",
    "seq_position": f"""WITH {_SEQ} SELECT doc_id, round(CAST(least(pre, post) AS DOUBLE) / (pre + post + 1), 6) AS f_premrna, round(CAST(least(e_pre, e_post) AS DOUBLE) / (e_pre + e_post + 1), 6) AS f_mrna
      FROM (SELECT *, o + CASE WHEN o < a THEN 0 WHEN o < b THEN 1 ELSE 2 END AS pre, n - o - 1 + CASE WHEN o < a THEN 2 WHEN o < b THEN 1 ELSE 0 END AS post,
        CASE WHEN o < a THEN o WHEN o < b THEN a ELSE a + o - b END AS e_pre, CASE WHEN o < a THEN a - o - 1 + n - b WHEN o < b THEN n_tail ELSE n - o - 1 END AS e_post FROM m)""",
    "seq_codon_usage": f"""WITH {_SEQ}, codons(codon, aa, usage) AS (VALUES {_CODONS}),
      c AS (SELECT doc_id, seq[o // 3 * 3 + 1:o // 3 * 3 + 3] AS codon, o % 3 AS frame, alt FROM s),
      d AS (SELECT *, codon[1:frame] || alt || codon[frame + 2:] AS new_codon FROM c WHERE length(codon) = 3)
      SELECT doc_id, codon, new_codon, x.aa AS amino_acid, x.aa = y.aa AS is_synonymous, CASE WHEN x.aa = y.aa THEN round(y.usage, 6) END AS rscu,
        CASE WHEN x.aa = y.aa THEN round(abs(y.usage - x.usage), 6) END AS d_rscu, reverse(translate(codon, 'ACGT', 'TGCA')) AS reverse
      FROM d JOIN codons x USING (codon) JOIN codons y ON y.codon = new_codon""",
    "seq_splice_sites": f"WITH {_SITES} SELECT doc_id, side, CAST(junction AS INT) AS junction, site FROM sites",
    "seq_site_scores": f"WITH {_SITES} SELECT doc_id, side, CAST(junction AS INT) AS junction, site, round(CAST(length(site) - length(regexp_replace(site, '[GC]', '', 'g')) AS DOUBLE) / length(site), 9) AS score FROM sites",
    "seq_splice": f"""WITH {_SITES}, sc AS (SELECT *, CAST({_strength("o_site")} AS DOUBLE) AS o, CAST({_strength("n_site")} AS DOUBLE) AS n FROM j),
      kept AS (SELECT * FROM sc WHERE abs(o - n) >= 0.1 AND (o >= 2 OR n >= 2)),
      f AS (SELECT doc_id, side, any_value(known) AS known, greatest(max(o), max(n)) AS mes, max(abs(n - o)) AS d_mes, max(n - o) FILTER (n > 2) AS mes_gain, max(o - n) FILTER (o > 2) AS mes_loss,
        max({{'v': o, 'i': junction}}).i AS oi, max({{'v': n, 'i': junction}}).i AS ni, max({{'v': abs(n - o), 'i': junction}}).i AS di FROM kept GROUP BY doc_id, side),
      larger AS (SELECT doc_id, max(mes) AS mes, max(d_mes) AS d_mes, max(mes_gain) AS mes_gain, max(mes_loss) AS mes_loss, bool_or(oi <> ni) AS mc, bool_or(coalesce(ni <> known, true)) AS cs, bool_or(coalesce(di = known, false)) AS km FROM f GROUP BY doc_id)
      SELECT doc_id, mes, d_mes, mes_gain, mes_loss, CAST(coalesce(mc, false) AS INT) AS mec_max_changed, CAST(coalesce(cs, false) AS INT) AS mec_is_cryptic, CAST(coalesce(km, false) AS INT) AS mes_known_most FROM sp LEFT JOIN larger USING (doc_id)""",
    "seq_folding": f"""WITH {_SEQ}, t AS (SELECT doc_id, ref, alt, seq[1:o] AS p, seq[o + 2:] AS q, o AS n_p, n - o - 1 AS n_q FROM s),
      u AS (SELECT *, least(n_p, {DOMAIN} + greatest(0, {DOMAIN} - n_q)) AS tp, least(n_q, {DOMAIN} + greatest(0, {DOMAIN} - n_p)) AS tq FROM t),
      c AS (SELECT doc_id, ref, alt, CASE WHEN tp + tq = {2 * DOMAIN} THEN right(p, tp) END AS pre, CASE WHEN tp + tq = {2 * DOMAIN} THEN left(q, tq) END AS post FROM u),
      e AS (SELECT *, length(pre || post) + 1 AS n, length(regexp_replace(pre || ref || post, '[AT]', '', 'g')) AS g_old, length(regexp_replace(pre || alt || post, '[AT]', '', 'g')) AS g_new FROM c)
      SELECT doc_id, pre, post, round(-log10((-(g_new * 3 + (n - g_new) * 2) / 10.0) / (-(g_old * 3 + (n - g_old) * 2) / 10.0)), 9) AS pdg FROM e""",
    "gen_all_synonymous": f"WITH {_GENERATED} SELECT * FROM every",
    "gen_matched_controls": f"""WITH {_GENERATED}, want AS (SELECT doc_id, {_cpg("CASE WHEN o > 0 THEN seq[o] END", "seq[o + 2]")} AS cpg FROM s)
      SELECT doc_id, site, ref, alt, matched FROM (SELECT e.*, has_cpg = cpg AND NOT near_splice AS matched FROM every e JOIN want USING (doc_id))
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY NOT matched, md5('1:' || doc_id || ':' || site || ':' || alt)) = 1""",
}


def _variety(base: str) -> str:
    whole = f"(pre || {base} || post)"
    n = lambda b: f"(length({whole}) - length(replace({whole}, '{b}', '')) + 1)"
    return f"({n('A')} * {n('C')} * {n('G')} * {n('T')} / length({whole}))"


_DOMAINS = ORACLE["seq_folding"].split("      e AS")[0].rstrip().rstrip(",")
ORACLE["seq_variety"] = f"{_DOMAINS} SELECT doc_id, round(-log10({_variety('alt')} / {_variety('ref')}), 9) AS pvar FROM c"
_ZEROS = {
    "seq_codon_usage": ("rscu", "d_rscu"), "seq_cpg": ("is_cpg", "cpg_exon"), "seq_matrices": ("lost AS sr_lost", "gained AS sr_gained"),
    "seq_splice": ("mes", "d_mes", "mes_gain", "mes_loss", "mec_max_changed", "mec_is_cryptic", "mes_known_most"),
    "seq_motifs": tuple(f"{n}_{k}" for n, _, _ in MOTIFS for k in ("lost", "gained")), "seq_position": ("f_premrna", "f_mrna"), "seq_folding": ("pdg",), "seq_variety": ("pvar",),
}
ORACLE["seq_feature_matrix"] = (
    "SELECT doc_id, "
    + ", ".join(f"coalesce({name}.{c.split(' AS ')[0]}, 0) AS {c.split(' AS ')[-1]}" for name, columns in _ZEROS.items() for c in columns)
    + " FROM ("
    + ORACLE["seq_mutations"]
    + ") every "
    + " ".join(f"LEFT JOIN ({ORACLE[name]}) {name} USING (doc_id)" for name in _ZEROS)
)
