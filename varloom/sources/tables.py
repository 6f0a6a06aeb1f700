"""Readers and writers of matrices, scores, motifs, weights and stage results."""

from __future__ import annotations

import ast
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from varloom.support import hadoop_path, is_whole, remove


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated matrix whose first line is a header, `#` marks in it dropped; `na` reads as null.

    Every value is cast to double; a line of another width fails the read.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("nullValue", "na").option("mode", "FAILFAST").csv(path)
    return raw.select(*[F.col(f"`{c}`").cast("double").alias(c.replace("#", "")) for c in raw.columns])


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(score, major, replicate, file_name) of files named `major-replicate.scored`, one number a line; `na` reads as NaN."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("v"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name")).filter("v <> ''")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return lines.select(
        F.when(F.startswith("v", F.lit("na")), F.lit(float("nan"))).otherwise(F.split("v", r"\s+")[0].try_cast("double")).alias("score"),
        F.get(F.split("v", r"\s+"), F.lit(1)).try_cast("int").alias("label"),
        F.split(stem, "-")[0].alias("major"),
        F.get(F.split(stem, "-"), F.lit(1)).alias("replicate"),
        "file_name",
    )


def read_motifs(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(motif): the words of one width in a list, in capitals; comments, blanks and other widths are left out."""
    words = spark.read.text(path).select(F.upper(F.trim("value")).alias("motif"))
    return words.filter(~F.startswith("motif", F.lit("#")) & (F.length("motif") == width))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(name, threshold, base, place, weight) of files of weight matrices, read as literals and never run.

    A file is parsed by the task that reads it.
    """

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [
                (name, float(m["threshold"]), base, place, float(w))
                for text in pdf["value"]
                for name, m in ast.literal_eval(text).items()
                for base, ws in m["motif"].items()
                for place, w in enumerate(ws)
            ]
            yield pd.DataFrame(rows, columns=["name", "threshold", "base", "place", "weight"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "name string, threshold double, base string, place int, weight double")


def _once(df: DataFrame, path: str) -> DataFrameWriter | None:
    """A writer to the path, or None where a committed table stands there; what a broken run left is written over."""
    return None if is_whole(df.sparkSession, path) else df.write.mode("overwrite")


def write_table(df: DataFrame, path: str) -> None:
    """A tab-separated table with a header that starts with `#`; nothing is done where it stands whole already."""
    first, *rest = df.columns
    marked = df.select(F.col(f"`{first}`").alias(f"#{first}"), *[F.col(f"`{c}`") for c in rest])
    if writer := _once(marked, path):
        writer.option("sep", "\t").option("header", True).option("comment", "\u0001").option("nullValue", "na").csv(path)


def stage(df: DataFrame, path: str) -> DataFrame:
    """df from the table at the path, written there first unless a whole one stands there."""
    if writer := _once(df, path):
        writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    """A fitted model at the path; nothing is done where one stands whole already.

    A model is several folders, of which the metadata come first and the last
    stage last, so it is saved beside the path and moved there as a whole.
    """
    spark = SparkSession.active()
    fs, at = hadoop_path(spark, path)
    if fs.exists(at):
        return
    draft = f"{path}-{uuid.uuid4().hex[:12]}"
    model.save(draft)
    if not fs.rename(hadoop_path(spark, draft)[1], at):
        remove(spark, draft)
        raise RuntimeError(f"could not move the model to {path}")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def run_record(spark: SparkSession, command: str, arguments: dict) -> DataFrame:
    """One row on how a result came about."""
    return spark.createDataFrame([(command, json.dumps(arguments, sort_keys=True))], "command string, arguments string").withColumn("time", F.current_timestamp())


def svm_line(label: Column, features: list[Column]) -> Column:
    """`class qid:1 1:v 2:v ...` of one row, features numbered from 1; null counts as 0."""
    parts = [F.concat(F.lit(f"{i}:"), F.coalesce(f.cast("string"), F.lit("0"))) for i, f in enumerate(features, 1)]
    return F.concat_ws(" ", label.cast("string"), F.lit("qid:1"), *parts)


def train_test(df: DataFrame, path: str, by: list[str]) -> None:
    """Training and test sets in folders by split and role; nothing is done where they stand whole already."""
    if writer := _once(df, path):
        writer.partitionBy(*by).parquet(path)


def read_conservation(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, score) of lines `score chrom pos` parted by white space; comments and lines that hold no numbers are left out."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("#")))
    return rows.select(F.regexp_replace(F.get(f, F.lit(1)), "^chr", "").alias("chrom"), F.get(f, F.lit(2)).try_cast("long").alias("pos"), F.get(f, F.lit(0)).try_cast("double").alias("score")).filter("pos IS NOT NULL AND score IS NOT NULL")
