"""Raw lines into records: valid ones loaded, the others kept with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from varloom.support import SPACE, is_whole, kept_columns

# The fields of a record in their order.
FIELDS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]

#: The highest position that counts as valid.
MAX_POS = 250_000_000

# A tab inside quotes is written as MARK + "0" while the line is split, and a
# MARK that stands in the data as MARK + "1".
MARK = "\ue000"


def _fields(line: Column) -> Column:
    """The line split at the tabs outside quotes; quotes still in place.

    The pieces between double quotes are inside and outside by turns, so no
    backtracking pattern runs over the line and its length does not matter.
    """
    turns = F.transform(
        F.split(F.replace(line, F.lit(MARK), F.lit(MARK + "1")), '"', -1),
        lambda piece, i: F.when(i % 2 == 1, F.replace(piece, F.lit("\t"), F.lit(MARK + "0"))).otherwise(piece),
    )
    return F.split(F.concat_ws('"', turns), "\t", -1)


def _restore(field: Column) -> Column:
    return F.replace(F.replace(field, F.lit(MARK + "0"), F.lit("\t")), F.lit(MARK + "1"), F.lit(MARK))


def _inner(field: Column) -> Column:
    """What stands between the first and the last character."""
    return F.substring(field, F.lit(2), F.length(field) - 2)


def _well_quoted(field: Column) -> Column:
    """No double quote at all, or one at each end and only doubled ones between."""
    lone = F.instr(F.replace(_inner(field), F.lit('""'), F.lit("")), '"') > 0
    return (F.instr(field, '"') == 0) | ((F.length(field) >= 2) & F.startswith(field, F.lit('"')) & F.endswith(field, F.lit('"')) & ~lone)


def _text(field: Column, marked: Column) -> Column:
    plain = F.when(F.startswith(field, F.lit('"')), F.replace(_inner(field), F.lit('""'), F.lit('"'))).otherwise(field)
    return F.when(marked, _restore(plain)).otherwise(field)


def chrom_ok(c: Column) -> Column:
    return c.rlike(r"(?i)\A(chr)?([1-9]|1[0-9]|2[0-2]|X|Y|MT)\z")


def pos_ok(c: Column) -> Column:
    return c.rlike(r"\A0*[0-9]{1,9}\z") & F.coalesce(c.try_cast("long"), F.lit(0)).between(1, MAX_POS)


def ref_ok(c: Column) -> Column:
    return c.rlike(r"(?i)\A[ACGTN]+\z")


def parse_lines(df: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """keep..., the ten fields as nullable text, and `errors`, an array of reasons.

    Every column is loaded as text first; each rule is one vectorised
    expression that adds its name to `errors`, in the order quoting, columns,
    chrom, pos, ref. An empty array means a valid record. A line whose quoting
    or number of fields is wrong has null fields and that one reason. A line
    without a double quote is split at its tabs and needs no test of quoting;
    every step's result is a column of its own, made once a line, and the
    errors come out of an explode, so that a filter on them is not tested by
    parsing the line once more.

    Defined results: lines that start with `#`, lines of white space only and
    null lines are skipped; one carriage return at the end does not count;
    repeated lines stay repeated; lines may be of any length. A kept column
    named like an output column gets `_in` added to its name.
    """
    raw = F.col(f"`{line}`").cast("string")
    source = df.select(*kept_columns(keep, {*FIELDS, "errors"}), raw.alias("__raw"))
    names = [F.col(f"`{n}`") for n in source.columns[:-1]]
    content = source.filter(~F.startswith("__raw", F.lit("#")) & F.col("__raw").rlike(rf"[^{SPACE[1:]}"))
    ended = F.when(F.endswith("__raw", F.lit("\r")), F.substring("__raw", F.lit(1), F.length("__raw") - 1)).otherwise(F.col("__raw"))
    lines = content.select(*names, ended.alias("__line"), (F.instr("__raw", '"') > 0).alias("__marked"))
    fields = F.when(F.col("__marked"), _fields(F.col("__line"))).otherwise(F.split("__line", "\t", -1))
    split = lines.select(*names, "__marked", fields.alias("__fields"))
    quoted = ~F.col("__marked") | F.forall("__fields", _well_quoted)
    shape = F.when(~quoted, "quoting").when(F.size("__fields") != len(FIELDS), "columns")
    shaped = split.select(*names, "__marked", "__fields", shape.alias("__shape"))
    whole = F.col("__shape").isNull()
    text = {f: F.when(whole, _text(F.get("__fields", F.lit(i)), F.col("__marked"))) for i, f in enumerate(FIELDS)}
    rules = [F.when(whole & ~ok(text[f]), f) for f, ok in (("chrom", chrom_ok), ("pos", pos_ok), ("ref", ref_ok))]
    errors = F.array_compact(F.array(F.col("__shape"), *rules))
    judged = shaped.select(*names, "__marked", "__fields", "__shape", F.explode_outer(F.array(errors)).alias("errors"))
    return judged.select(*names, *[text[f].alias(f) for f in FIELDS], "errors")


def valid_rows(parsed: DataFrame) -> DataFrame:
    """The records without an error, typed; text that is no number becomes null."""
    rest = [F.col(f"`{c}`") for c in parsed.columns if c not in {*FIELDS, "errors"}]
    return parsed.filter(F.size("errors") == 0).select(
        *rest,
        "chrom",
        F.col("pos").try_cast("long").alias("pos"),
        "id",
        "ref",
        "alt",
        F.col("qual").try_cast("double").alias("qual"),
        "filter",
        "info",
        "format",
        "sample",
    )


def rejected_rows(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """keep... and `reason`, the first error, of every line that is no valid record."""
    return parsed.filter(F.size("errors") > 0).select(*kept_columns(keep, {"reason"}), F.get("errors", F.lit(0)).alias("reason"))


def loaded_once(parsed: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The valid records and the rejected lines (all kept columns, errors), both from one pass over the lines.

    The parsed lines are written below `path`, which all executors share, by
    whether they are valid; where they stand whole already they are only read.
    """
    spark = parsed.sparkSession
    if not is_whole(spark, path):
        parsed.withColumn("__valid", F.size("errors") == 0).write.mode("overwrite").partitionBy("__valid").parquet(path)
    written = spark.read.schema(StructType([*parsed.schema.fields, StructField("__valid", BooleanType())])).parquet(path)
    valid, others = (written.filter(F.col("__valid") == ok).drop("__valid") for ok in (True, False))
    return valid_rows(valid), others.drop(*FIELDS)
