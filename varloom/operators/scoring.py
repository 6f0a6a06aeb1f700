"""Scores from a plug-in, computed once for each distinct input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(rows: DataFrame, column: str, scorer: Callable[[pd.Series], pd.Series] | DataFrame, name: str = "score") -> DataFrame:
    """rows with the scorer's value for the text in `column`; null texts and unknown ones have none.

    The distinct texts are scored in batches, or looked up if the scorer is a
    table (column, name), and joined back by text.
    """
    if isinstance(scorer, DataFrame):
        table = scorer.select(column, name)
    else:

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield pd.DataFrame({column: pdf[column], name: scorer(pdf[column])})

        table = rows.select(column).filter(F.col(column).isNotNull()).distinct().mapInPandas(batches, f"`{column}` string, `{name}` double")
    return rows.join(table, column, "left")
