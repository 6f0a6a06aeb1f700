"""Several values packed into one field: one row per value, with its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.support import SPACE, kept_columns, trim_space

# The two marks round a placeholder. They are private-use
# characters; one that stands in the data is itself taken for a protected span,
# so that no placeholder can be mistaken for data.
OPEN, CLOSE = "\ue000", "\ue001"

PROTECTED = rf"\"[^\"]*\"|'[^']*'|<[^>]*>|[{OPEN}{CLOSE}]"


def _restored(value: Column, spans: Column) -> Column:
    """The value with every placeholder looked up again in the array of spans."""

    def piece(p: Column, i: Column) -> Column:
        index = F.substring_index(p, CLOSE, 1).cast("int")
        rest = F.substring(p, F.length(F.substring_index(p, CLOSE, 1)) + F.lit(2), F.length(p))
        return F.when(i == 0, p).otherwise(F.concat(_unquoted(F.get(spans, index)), rest))

    return F.concat_ws("", F.transform(F.split(value, OPEN, -1), piece))


def _unquoted(span: Column) -> Column:
    return F.when(span.rlike("^[\"']"), F.substring(span, F.lit(2), F.length(span) - 2)).otherwise(span)


def explode_packed(
    df: DataFrame,
    column: str,
    keep: list[str],
    *,
    value: str = "value",
    position: str = "position",
    separators: str = ",;|/",
    min_values: int = 1,
) -> DataFrame:
    """One row (keep..., position, value) for each value packed into `column`.

    Values are parted by one of `separators`, with white space beside it as
    padding, or by white space alone. What stands in quotes or angle brackets
    belongs to the value. Spans of that kind give way to indexed placeholders,
    the rest is split, and the spans come back through a lookup in their array;
    all of it is built-in expressions, so the scan stays in one stage.

    Defined results: positions count from 1; an empty place between two
    separators keeps its number and gives no row; one separator at the end and
    white space at either end add nothing; quotes and the white space next to
    them are dropped from the value; a quote without partner is text; null and
    blank cells give no row; rows whose cell holds fewer than `min_values`
    values give none. Repeated rows stay repeated. A kept column named like an
    output column gets `_in` added to its name.
    """
    seps = "".join(f"\\{s}" for s in separators)
    padded = f"{SPACE}*[{seps}]{SPACE}*"
    source = df.select(*kept_columns(keep, {position, value}), F.col(f"`{column}`").cast("string").alias("__cell"))
    names = source.columns[:-1]
    kept = [F.col(f"`{n}`") for n in names]
    # the spans are a column of their own that the next step reads twice, so that a cell is matched once and not once a span
    matched = source.filter(F.col("__cell").isNotNull()).select(
        *kept, F.split("__cell", PROTECTED, -1).alias("__between"), F.regexp_extract_all("__cell", F.lit(f"({PROTECTED})"), F.lit(1)).alias("__raw")
    )
    last = F.size("__raw")
    placeholders = F.transform("__between", lambda piece, i: F.when(i < last, F.concat(piece, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(piece))
    marked = matched.select(*kept, F.array_join(placeholders, "").alias("__text"), "__raw")
    trimmed = F.regexp_replace(trim_space(F.col("__text")), rf"{SPACE}*[{seps}]\z", "")
    values = F.transform(F.split(trimmed, f"{padded}|{SPACE}+", -1), lambda v: trim_space(_restored(v, F.col("__raw"))))
    if min_values > 1:
        values = F.when(F.size(F.filter(values, lambda v: v != "")) >= min_values, values)
    # the outer form, since for the inner one the optimizer would test the arrays' size on top of the scan and so build them twice
    rows = marked.select(*kept, values.alias("__values")).select(*kept, F.posexplode_outer("__values").alias("__place", "__value"))
    return rows.filter(F.col("__value") != "").select(
        *kept, (F.col("__place") + 1).cast("long").alias(position), F.col("__value").alias(value)
    )
