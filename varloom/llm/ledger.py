"""Duplicates hidden by formatting: canonical keys and an incremental ledger of counts."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.support import hadoop_path, remove, shared_dir, stored

#: A key is hot when it holds at least one in so many of all rows, so that no
#: more than this many keys can be hot and their table may be broadcast.
HOT_SHARE = 1000

#: Buckets of a new ledger, and keys that a bucket should hold at most; beyond that the number doubles.
BUCKETS, KEYS_PER_BUCKET = 8, 4_000_000

#: A run is merged with a batch unless it has more than so many times the batch's rows.
GROWTH = 4

#: The batch of rows without a time of loading.
NO_YEAR = "none"

COLUMNS = "h1 BIGINT, h2 BIGINT, copies BIGINT, first BIGINT"

# Fixed value: stands for null in a canonical key; no canonical text holds it.
NULL = "~"


def canonical_text(c: Column, also: str = "") -> Column:
    """Lower case, without white space, quotes and punctuation but for `also`."""
    return F.lower(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{also}]+", ""))


def canonical_chrom(c: Column) -> Column:
    """A chromosome name; a `chr` in front does not count, `_random` does."""
    return F.regexp_replace(canonical_text(c), "^chr", "")


def canonical_items(c: Column, separators: str, also: str = "") -> Column:
    """The separated items in canonical form and sorted, as one text; repeats stay."""
    items = F.transform(F.split(c, f"[{separators}]"), lambda x: canonical_text(x, also))
    return F.array_join(F.array_sort(F.filter(items, lambda x: x != "")), ",")


def call_key(chrom: Column, pos: Column, ref: Column, alt: Column, info: Column, sample: Column) -> Column:
    """One text that is equal exactly for calls that say the same."""
    parts = [canonical_chrom(chrom), pos.cast("string"), canonical_text(ref, "*"), canonical_items(alt, ",;|/", "*"), canonical_items(info, ",;|", "=")]
    return F.concat_ws("|", *[F.coalesce(p, F.lit(NULL)) for p in parts], F.when(sample.isNull(), "n").otherwise(F.concat(F.lit("v"), sample)))


def keyed(df: DataFrame, key: Column, row_id: str, batch: Column) -> DataFrame:
    """(h1, h2, id, batch): the key as 128 bits, the row and the batch it came with."""
    text = df.select(key.alias("key"), F.col(f"`{row_id}`").alias("id"), batch.alias("batch"))
    return text.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "id", "batch")


@dataclass(frozen=True)
class Run:
    """One bucketed table of counts: its folder's name, its buckets and its keys."""

    name: str
    buckets: int
    keys: int


class Ledger:
    """Counts of canonical keys in bucketed tables, in a folder that all executors share.

    The ledger is a short list of runs, each a table (h1, h2, copies, first)
    bucketed by key. A batch is aggregated by key, laid out in the same buckets
    and full-outer-joined, bucket by bucket, with the newest runs that are not
    much larger than itself (GROWTH); counts are added and the smallest row id
    stays as representative. Larger runs are left alone, so a ledger of any size
    is rewritten only as often as it grows by a factor. No run is ever shuffled
    unless the number of buckets has grown with the keys.

    Only a line in the manifest makes a merge count: one that is cut off leaves
    a folder without a line, and a label that was merged before is left out.
    """

    def __init__(self, spark: SparkSession, path: str, keys_per_bucket: int = KEYS_PER_BUCKET):
        self.spark, self.path, self.keys_per_bucket = spark, path, keys_per_bucket
        self.runs: list[Run] = []
        self.labels: dict[str, str | None] = {}
        self.copies = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, keys_per_bucket: int = KEYS_PER_BUCKET) -> Ledger:
        """The ledger as its manifest in `path` describes it; an empty one where there is none."""
        ledger = cls(spark, path, keys_per_bucket)
        fs, at = hadoop_path(spark, f"{path}/manifest")
        if fs.exists(at):
            for line in sorted((json.loads(r.value) for r in spark.read.text(f"{path}/manifest/*.json").collect()), key=lambda x: x["number"]):
                ledger._count(line)
        return ledger

    def _count(self, line: dict) -> None:
        self.runs = [r for r in self.runs if r.name not in line["replaces"]]
        self.runs.append(Run(line["run"], line["buckets"], line["keys"]))
        self.labels[line["label"]] = line["staged"]
        self.copies += line["rows"]

    def _table(self, run: Run) -> DataFrame:
        name = f"ledger_{run.name}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({COLUMNS}) USING parquet CLUSTERED BY (h1, h2) INTO {run.buckets} BUCKETS LOCATION '{self.path}/runs/{run.name}'")
        return self.spark.table(name)

    def rows(self) -> DataFrame:
        """(h1, h2, copies, first): every key with the number of its rows and the smallest id."""
        if not self.runs:
            return self.spark.createDataFrame([], COLUMNS)
        return reduce(_added, map(self._table, self.runs))

    def staged(self) -> DataFrame:
        """(h1, h2, id) of the rows of every merged batch whose keys were kept."""
        folders = sorted({s for s in self.labels.values() if s})
        if not folders:
            return self.spark.createDataFrame([], "h1 long, h2 long, id long")
        return self.spark.read.schema("h1 long, h2 long, id long").parquet(*folders)

    def merge(self, batch: DataFrame, label: str, rows: int | None = None, staged: str | None = None) -> None:
        """Adds a batch (h1, h2, id) of so many rows; a label that was merged before is left out."""
        if label in self.labels:
            return
        rows = batch.count() if rows is None else rows
        near = []
        for run in reversed(self.runs):
            if run.keys > GROWTH * (rows + sum(r.keys for r in near)):
                break
            near.append(run)
        most = rows + sum(r.keys for r in self.runs)
        buckets = max([BUCKETS, *(r.buckets for r in self.runs)])
        while buckets * self.keys_per_bucket < most:
            buckets *= 2
        counted = batch.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
        merged = reduce(_added, map(self._table, near), counted.repartition(buckets, "h1", "h2"))
        name = uuid.uuid4().hex
        merged.write.bucketBy(buckets, "h1", "h2").option("path", f"{self.path}/runs/{name}").saveAsTable(f"ledger_{name}")
        keys = self.spark.table(f"ledger_{name}").count()  # from the files' footers
        line = {"number": len(self.labels), "label": label, "run": name, "buckets": buckets, "keys": keys, "rows": rows, "replaces": [r.name for r in near], "staged": staged}
        self._write(line)
        self._count(line)
        for run in near:
            self._drop(run)

    def _write(self, line: dict) -> None:
        """Puts a line into the manifest: written beside it first and then moved, so that it is there whole or not at all."""
        draft, final = f"{self.path}/drafts/{uuid.uuid4().hex}", f"{self.path}/manifest/{line['number']:08d}.json"
        fs, at = hadoop_path(self.spark, draft)
        out = fs.create(at)
        out.writeBytes(json.dumps(line))
        out.close()
        _, to = hadoop_path(self.spark, final)
        fs.mkdirs(to.getParent())
        if not fs.rename(at, to):
            raise RuntimeError(f"another merge has taken number {line['number']}")

    def _drop(self, run: Run) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS ledger_{run.name}")
        remove(self.spark, f"{self.path}/runs/{run.name}")

    def vacuum(self) -> None:
        """Removes the folders of merges that were cut off; for times when no merge is under way."""
        fs, at = hadoop_path(self.spark, f"{self.path}/runs")
        live = {r.name for r in self.runs}
        for status in fs.listStatus(at) if fs.exists(at) else ():
            if status.getPath().getName() not in live:
                fs.delete(status.getPath(), True)

    def remove(self) -> None:
        """Deletes the ledger with its staged keys."""
        for run in self.runs:
            self._drop(run)
        remove(self.spark, self.path)


def _added(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of counts as one: a full outer join by key, counts added, the smaller id kept."""
    right = b.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("copies").alias("o_copies"), F.col("first").alias("o_first"))
    both = a.join(right, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")), "full_outer")
    return both.select(
        F.coalesce("h1", "o1").alias("h1"),
        F.coalesce("h2", "o2").alias("h2"),
        (F.coalesce("copies", F.lit(0)) + F.coalesce("o_copies", F.lit(0))).alias("copies"),
        F.least("first", "o_first").alias("first"),
    )


def copies(rows: DataFrame, ledger: DataFrame, total: int) -> DataFrame:
    """(kept_id, copy_id) of each row (h1, h2, id) that is not its key's representative; `total` rows in all.

    Keys that hold more than one row in HOT_SHARE are looked up in a broadcast
    table, which can have no more than HOT_SHARE rows; their rows get a key of
    their own in the shuffle join, so that no task receives a whole hot group.
    """
    repeated = ledger.filter("copies > 1").select("h1", "h2", "copies", "first")
    hot = repeated.filter(F.col("copies") * HOT_SHARE >= total).select("h1", "h2", F.col("first").alias("hot_first"))
    cold = repeated.filter(F.col("copies") * HOT_SHARE < total).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("first").alias("cold_first"))
    looked = rows.join(F.broadcast(hot), ["h1", "h2"], "left")
    spread = looked.select(
        "id",
        "hot_first",
        F.when(F.col("hot_first").isNull(), F.col("h1")).otherwise(F.xxhash64("id")).alias("k1"),
        F.when(F.col("hot_first").isNull(), F.col("h2")).alias("k2"),
    )
    found = spread.join(cold, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    kept = F.coalesce("hot_first", "cold_first")
    return found.filter(kept.isNotNull() & (kept != F.col("id"))).select(kept.alias("kept_id"), F.col("id").alias("copy_id"))


def hidden_duplicates(variants: DataFrame, path: str | None = None, keys_per_bucket: int = KEYS_PER_BUCKET) -> Ledger:
    """The ledger of a table of calls, fed batch by batch; with `path`, one that stays there for later calls.

    A batch is what was loaded in one calendar year, as a feed would bring it.
    A call on a ledger that exists keys, stages and merges only the batches it
    does not hold yet, so a batch must be whole when it is first seen.

    Defined results: two calls are copies when chrom, ref, alt and info agree
    in canonical form and pos and sample_id are equal; null equals only null;
    an empty cell is not null; repeated rows are copies; ids are unique. An
    empty table gives an empty ledger. Other columns are not read.
    """
    spark = variants.sparkSession
    ledger = Ledger.open(spark, path or shared_dir(spark, "p1-ledger"), keys_per_bucket)
    c = {n: F.col(f"`{n}`") for n in ("chrom", "pos", "ref", "alt", "info", "sample_id")}
    key = call_key(c["chrom"], c["pos"], c["ref"], c["alt"], c["info"], c["sample_id"])
    batch = F.coalesce(F.year("loaded_ts").cast("string"), F.lit(NO_YEAR))
    fresh = variants.filter(~batch.isin(list(ledger.labels))) if ledger.labels else variants
    staged = f"{ledger.path}/keys/{uuid.uuid4().hex}"
    keyed(fresh, key, "variant_id", batch).write.partitionBy("batch").parquet(staged)
    rows = spark.read.schema("h1 long, h2 long, id long, batch string").parquet(staged)
    for label, n in sorted(map(tuple, rows.groupBy("batch").agg(F.count("*").alias("n")).collect())):
        ledger.merge(rows.filter(F.col("batch") == label).select("h1", "h2", "id"), label, n, f"{staged}/batch={label}")
    return ledger


def hidden_copies(variants: DataFrame) -> DataFrame:
    """(kept_id, copy_id) over a whole table, by a ledger that goes once the result is stored."""
    ledger = hidden_duplicates(variants)
    found = stored(copies(ledger.staged(), ledger.rows(), ledger.copies))
    ledger.remove()
    return found


def hidden_counts(variants: DataFrame) -> DataFrame:
    """(first, copies) of each distinct call of a whole table, by a ledger that goes once the result is stored."""
    ledger = hidden_duplicates(variants)
    found = stored(ledger.rows().select("first", "copies"))
    ledger.remove()
    return found
