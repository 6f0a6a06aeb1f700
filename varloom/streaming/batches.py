"""New variant calls as a stream: each micro-batch is annotated as a table would be."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_new(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the Parquet files that arrive in a folder; the schema is that of the files there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def annotate_new(stream: DataFrame, annotate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Writes annotate(batch) of everything new under `out` and ends; later calls go on where this one stopped.

    Each batch has a folder of its own that is written anew when the batch is
    repeated after a failure, so no row comes twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
