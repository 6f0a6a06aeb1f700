"""Small helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Every character that Unicode counts as white space, written so
# that Java's and RE2's regular expressions read it alike.
SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: Rows and bytes up to which a side may be broadcast once it has been measured.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the session names in spark.checkpoint.dir.

    All executors see that folder. Where the setting is absent, a session on
    one machine (tests, a notebook) gets a temporary folder; on a cluster that
    is an error, as executors would write where nobody else reads.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path of any scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of one's own; nothing happens where it does not exist."""
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder was committed: Spark puts _SUCCESS there last."""
    fs, at = hadoop_path(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there.

    With spark.cleaner.referenceTracking.cleanCheckpoints the files go once
    nothing refers to them any more.
    """
    shared_dir(df.sparkSession, "x")
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int | None = None, size: int | None = None, keep: bool = True) -> DataFrame:
    """df, stored once, with a broadcast hint if its rows and bytes are measured to be few, else without one.

    For sides that are usually dimensions. A side that grows with the data gets
    no hint at all: adaptive execution measures it when it has been shuffled.
    keep=False says that df is stored already.
    """
    rows, size = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if size is None else size
    kept = stored(df) if keep else df
    found = kept.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("size")).first()
    return F.broadcast(kept) if found.n <= rows and (found["size"] or 0) <= size else kept


def trim_space(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def kept_columns(keep: list[str], taken: set[str]) -> list[Column]:
    """The columns to keep; one whose name the operator itself uses gets `_in` added."""
    return [F.col(f"`{c}`").alias(f"{c}_in" if c in taken else c) for c in keep]
