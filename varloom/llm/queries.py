"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import groupsplit, leakage, ledger, mixing, overlap, subjects
from varloom.llm.sql import ORACLE  # noqa: F401
from varloom.support import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.hidden_copies(table(spark, sf_dir, "variants"))


def p1_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct call once, by its smallest id, with the number of its copies."""
    return ledger.hidden_counts(table(spark, sf_dir, "variants")).select(F.col("first").alias("variant_id"), "copies")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sets = groupsplit.record_sets(table(spark, sf_dir, "synonymous"), "syn_id", "gene_id")
    return sets, groupsplit.entity_graph(sets, table(spark, sf_dir, "gene_models"), table(spark, sf_dir, "gene_aliases"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the labelled record-entity graph whose names are not written as approved."""
    found = groupsplit.rewritten_names(*_graph(spark, sf_dir), table(spark, sf_dir, "gene_models"))
    return found.select(F.col("record").alias("syn_id"), F.col("symbol").alias("gene_symbol"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every record: the smallest entity that it is tied to."""
    return groupsplit.record_groups(*_graph(spark, sf_dir)).select(F.col("record").alias("syn_id"), F.col("group").alias("group_id"))


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every record and the group it belongs to."""
    labels = table(spark, sf_dir, "synonymous").select(F.col("syn_id").alias("record"), F.col("cohort").alias("label"))
    groups = groupsplit.record_groups(*_graph(spark, sf_dir))
    split = groupsplit.group_split(groups, labels, table(spark, sf_dir, "split_shares"))
    return split.select(F.col("record").alias("syn_id"), F.col("group").alias("group_id"), "split_name")


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records and groups the split holds, and how many groups stand in one split only."""
    of_group = p2_split(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n"), (F.min("split_name") == F.max("split_name")).alias("one"))
    return of_group.agg(F.sum("n").alias("n_records"), F.count("*").alias("n_groups"), F.count_if("one").alias("n_in_one_split"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each split comes to its share, over all and in each cohort."""
    split = p2_split(spark, sf_dir)
    cohort = table(spark, sf_dir, "synonymous").select("syn_id", "cohort")
    counts = split.join(cohort, "syn_id").groupBy("cohort", "split_name").agg(F.count("*").alias("n"))
    totals = counts.groupBy("cohort").agg(F.sum("n").alias("n_cohort"))
    target = table(spark, sf_dir, "split_shares").select("split_name", "target_share")
    return counts.join(totals, "cohort").join(target, "split_name").select("cohort", "split_name", "n", "target_share", (F.col("n") / F.col("n_cohort")).alias("actual_share"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.overlapping_pairs(overlap.split_rows(table(spark, sf_dir, "split_rows"), []))
    return pairs.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(overlap.split_rows(table(spark, sf_dir, "split_rows"), ["split_name", "source"]))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_passages"), "item_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of which the distance says that ten successive words are equal."""
    return _leaks(spark, sf_dir).filter("distance = 0").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item that leaked, into how many documents, exactly or with an edit."""
    counts = _leaks(spark, sf_dir).groupBy("item").agg(F.count_if(F.col("distance") == 0).alias("n_exact"), F.count_if(F.col("distance") > 0).alias("n_near"))
    sets = table(spark, sf_dir, "eval_passages").select("item_id", "item_set")
    return sets.join(counts, sets.item_id == counts.item).select("item_id", "item_set", "n_exact", "n_near")


def p6_exact_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item that leaked word by word, and into how many documents: the part of p6_items that SQL can express."""
    return p6_items(spark, sf_dir).filter("n_exact > 0").select("item_id", "item_set", "n_exact")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = mixing.token_lengths(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return mixing.mix(lengths, table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the mix and how often it appears."""
    return _mixed(spark, sf_dir).withColumnRenamed("doc", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source that has documents: whether no document is taken too often and the share comes near its target."""
    got = p7_shares(spark, sf_dir).filter("docs > 0")
    near = F.abs(F.col("actual_share") - F.col("target_share")) < 0.001
    return got.select("source", "max_repeats", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"), near.alias("near_share"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subjects.document_subjects(
        table(spark, sf_dir, "documents"), "doc_id", "text", "lang", table(spark, sf_dir, "subject_samples"), table(spark, sf_dir, "subject_areas"), sections=["agenda_item", "source"]
    )
    return found.withColumnRenamed("doc", "doc_id")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters of each source by subject."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return p8_found(spark, sf_dir).join(sizes, "doc_id").groupBy("source", "subject").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


QUERIES = {
    "p1_found": p1_found,
    "p1_calls": p1_calls,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p2_split": p2_split,
    "p2_kept": p2_kept,
    "p2_shares": p2_shares,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p6_exact_items": p6_exact_items,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_kept": p7_kept,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}
