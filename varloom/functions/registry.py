"""Families of features by name: what a family reads, the columns it makes on the way, and its features.

A family is plain column expressions, so any choice of families is one
projection over one scan. Others can be added with register(), a scorer of
texts among them, and every matrix built afterwards has their columns too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

Columns = Callable[[], dict[str, Column]]


@dataclass(frozen=True)
class Family:
    """A family of features; `steps` are columns made one after the other, each once a row, before the features."""

    name: str
    features: Columns
    steps: list[Columns] = field(default_factory=list)


REGISTRY: dict[str, Family] = {}


def register(family: Family) -> Family:
    """Adds a family, or puts it in the place of the one of that name."""
    REGISTRY[family.name] = family
    return family


def with_features(df: DataFrame, keep: list[str], families: list[str]) -> DataFrame:
    """keep... and the features of the families, in their order.

    The families' steps are taken side by side, so there are as many
    projections as the longest has steps. Two families must not give a feature
    of the same name.
    """
    chosen = [REGISTRY[f] for f in families]
    for n in range(max([len(f.steps) for f in chosen], default=0)):
        df = df.select("*", *[c.alias(name) for f in chosen if n < len(f.steps) for name, c in f.steps[n]().items()])
    made = [(name, c) for f in chosen for name, c in f.features().items()]
    if len({name for name, _ in made}) < len(made):
        raise ValueError("two families give a feature of the same name")
    return df.select(*keep, *[c.alias(name) for name, c in made])
