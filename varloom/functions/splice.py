"""Splice junctions of a mutated transcript and the features drawn from their scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases of a site before and after its junction, by side.
BEFORE = {5: 3, 3: 20}
AFTER = {5: 6, 3: 3}

# The word that marks a canonical site, and how far behind its start the junction lies.
WORD = {5: ("GT", 0), 3: ("AG", 2)}

# A junction matters if its score changes by CHANGE and reaches GOOD on either side.
CHANGE, GOOD = 0.1, 2.0

INTS = "array<int>"


def spliced(m: dict[str, Column]) -> dict[str, Column]:
    """old and new: the mutated chunk between its nearest bases outside; n_pre, n_post: how many those are."""
    pre = F.right(F.array_join(m["before"], ""), F.lit(BEFORE[3]))
    post = F.left(F.array_join(m["after"], ""), F.lit(AFTER[5]))
    around = lambda base: F.concat(pre, m["head"], m[base], m["tail"], post)
    return {"old": around("ref"), "new": around("alt"), "n_pre": F.length(pre), "n_post": F.length(post)}


def known_junction(s: dict[str, Column], side: int) -> Column:
    """Where the chunk itself ends on that side; null where nothing lies beyond."""
    return F.when(s["n_pre"] > 0, s["n_pre"]) if side == 3 else F.when(s["n_post"] > 0, F.length(s["old"]) - s["n_post"])


def _canonical(seq: Column, s: dict[str, Column], side: int) -> Column:
    word, shift = WORD[side]
    start = F.greatest(s["n_pre"], F.lit(BEFORE[side]))
    end = F.length(s["old"]) - F.greatest(s["n_post"], F.lit(AFTER[side]))
    places = F.when(end - start >= 2, F.sequence(start, end - 2)).otherwise(F.array().cast(INTS))
    return F.transform(F.filter(places, lambda i: F.substring(seq, i + 1, F.lit(2)) == word), lambda i: i + shift)


def junctions(s: dict[str, Column], side: int) -> Column:
    """The sorted places of canonical sites in either sequence and of the known junction.

    A place whose site would begin before the sequence or end behind it is left out.
    """
    known = F.array_compact(F.array(known_junction(s, side)))
    every = F.array_union(F.array_union(_canonical(s["old"], s, side), _canonical(s["new"], s, side)), known)
    return F.array_sort(F.filter(every, lambda i: (i >= BEFORE[side]) & (i + AFTER[side] <= F.length(s["old"]))))


def site(seq: Column, junction: Column, side: int) -> Column:
    """The bases round a junction: 3 + 6 on the 5' side, 20 + 3 on the 3' side."""
    return F.substring(seq, junction - BEFORE[side] + 1, F.lit(BEFORE[side] + AFTER[side]))


def scored_junctions(s: dict[str, Column], side: int, score: Callable[[Column], Column]) -> Column:
    """array<struct<i, old, new>> of the junctions whose score changes and is good before or after."""
    both = F.transform(junctions(s, side), lambda i: F.struct(i.alias("i"), score(site(s["old"], i, side)).alias("old"), score(site(s["new"], i, side)).alias("new")))
    return F.filter(both, lambda j: (F.abs(j["old"] - j["new"]) >= CHANGE) & ((j["old"] >= GOOD) | (j["new"] >= GOOD)))


def junction_features(kept: Column, known: Column) -> dict[str, Column]:
    """The seven features of one side, from its kept junctions (struct<i, old, new>).

    Largest values win ties by the larger place. Without a kept junction the
    first four are null and the rest false.
    """
    some = F.size(kept) > 0
    best = lambda value: F.array_max(F.transform(kept, lambda j: F.struct(value(j).alias("v"), j["i"].alias("i"))))
    old, new, delta = best(lambda j: j["old"]), best(lambda j: j["new"]), best(lambda j: F.abs(j["new"] - j["old"]))
    gains = F.transform(F.filter(kept, lambda j: j["new"] > GOOD), lambda j: j["new"] - j["old"])
    losses = F.transform(F.filter(kept, lambda j: j["old"] > GOOD), lambda j: j["old"] - j["new"])
    return {
        "mes": F.greatest(old["v"], new["v"]),
        "d_mes": delta["v"],
        "mes_gain": F.array_max(gains),
        "mes_loss": F.array_max(losses),
        "mec_max_changed": some & F.coalesce(old["i"] != new["i"], F.lit(False)),
        "mec_is_cryptic": some & F.coalesce(new["i"] != known, F.lit(True)),
        "mes_known_most": some & F.coalesce(delta["i"] == known, F.lit(False)),
    }


def either_side(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The larger of both sides, null below every value; flags count as set when either is."""
    return {k: (a[k] | b[k]) if k.startswith(("mec", "mes_known")) else F.greatest(a[k], b[k]) for k in a}
