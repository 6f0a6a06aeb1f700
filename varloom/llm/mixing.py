"""Mixing sources to target weights: exact token lengths and a bounded knapsack."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.support import small, stored

#: Vocabulary file of a public tokenizer, as ranks.
RANKS = os.environ.get("VARLOOM_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the published pattern that cuts text before byte-pair merging for that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Tokens that the proportional choice leaves to the knapsack.
KNAPSACK = 4096

#: Rows of one source and length that are ranked together at most, on average.
RANKED = 10_000


def token_lengths(df: DataFrame, row_id: str, source: str, text: str, ranks: str = RANKS) -> DataFrame:
    """(doc, source, tokens): the exact token length of every whole text; null and empty texts have 0."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return df.select(F.col(f"`{row_id}`").alias("doc"), F.col(f"`{source}`").alias("source"), count(F.col(f"`{text}`")).alias("tokens"))


def fit(budget: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that the lengths sum up to the budget, or come as near below as can be.

    Bounded knapsack by dynamic programming over reachable sums, held as the
    bits of one integer; a length with many copies enters in doubling lots.
    """
    steps: list[tuple[int, int, int]] = []
    reach = 1
    for length, n in sorted(counts.items()):
        left = min(n, budget // length) if length > 0 else 0
        lot = 1
        while left > 0:
            lot = min(lot, left)
            steps.append((length, lot, reach))
            reach = (reach | (reach << (length * lot))) & ((1 << (budget + 1)) - 1)
            left -= lot
            lot *= 2
        if reach >> budget & 1:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, lot, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + lot
            total -= length * lot
    return taken


def choose(budget: int, max_repeats: int, counts: dict[int, int], knapsack: int = KNAPSACK) -> tuple[int, dict[int, int]]:
    """(full, extra): how often every document is taken, and how many of each length once more.

    As many full rounds as fit; then each length's share of the rest, in
    proportion and by largest remainder, but for about `knapsack` tokens, which
    the bounded knapsack fills from the documents still left.
    """
    size = sum(n * length for length, n in counts.items())
    if size == 0 or budget <= 0:
        return 0, {}
    full = min(max_repeats, budget // size)
    rest = budget - full * size
    if full == max_repeats or rest <= 0:
        return full, {}
    extra = {length: rest * n // size for length, n in counts.items() if length > 0}
    gap = rest - sum(length * x for length, x in extra.items())
    for length in sorted(extra, key=lambda x: (-(rest * counts[x] % size), x)):
        if extra[length] < counts[length] and gap - length >= knapsack:
            extra[length] += 1
            gap -= length
    for length in sorted(extra):
        back = min(extra[length], max(0, -(-(knapsack - gap) // length)))
        extra[length] -= back
        gap += back * length
    for length, x in fit(gap, {k: counts[k] - extra[k] for k in extra if counts[k] > extra[k]}).items():
        extra[length] += x
    return full, {k: x for k, x in extra.items() if x}


def plan(lengths: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, tokens, docs, full, extra) for each source and token length.

    The mix is as large as the sources' caps allow with every share met: the
    least max_repeats * size / share of the sources that have any text, or
    total_tokens where that is less. Each
    source's table of lengths, one row per distinct length, is fitted in a task
    of its own; documents never leave their partitions for it.
    """
    sizes = lengths.groupBy("source").agg(F.sum(F.col("tokens") * F.col("docs")).alias("size"))
    wanted = targets.filter("target_share > 0 AND max_repeats > 0").join(sizes, "source").filter("size > 0")
    most = wanted.agg(F.min(F.col("size") * F.col("max_repeats") / F.col("target_share"))).first()[0] or 0.0
    most = most if total_tokens is None else min(most, float(total_tokens))
    budgets = wanted.select("source", "max_repeats", F.round(F.lit(most) * F.col("target_share")).cast("long").alias("budget"))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(map(int, pdf.tokens), map(int, pdf.docs)))
        full, extra = choose(int(pdf.budget.iloc[0]), int(pdf.max_repeats.iloc[0]), counts)
        return pd.DataFrame({"source": pdf.source, "tokens": pdf.tokens, "docs": pdf.docs, "full": full, "extra": [extra.get(int(t), 0) for t in pdf.tokens]})

    joined = lengths.join(small(budgets), "source")
    return joined.groupBy("source").applyInPandas(fitted, "source string, tokens long, docs long, full long, extra long").filter("full > 0 OR extra > 0")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: int | None = None) -> DataFrame:
    """(doc, source, tokens, times) of every document in the mix; `docs` is (doc, source, tokens).

    Which documents of a length are taken once more is settled by a seeded
    hash. The documents of one source and length are dealt into lots by that
    hash, whole lots are taken and only the lot at the bound is ranked, so a
    hot length is never sorted in one task.

    Defined results: a source without target, or null, is left out; texts
    without tokens come along with full rounds only; no document is taken more
    than max_repeats times; ties in the hash go by id; an empty table gives none.
    """
    docs = stored(docs)
    lengths = docs.groupBy("source", "tokens").agg(F.count("*").alias("docs"))
    chosen = small(plan(lengths, targets, total_tokens))
    lots = F.greatest(F.lit(1), F.ceil(F.col("docs") / RANKED)).cast("long")
    hashed = docs.join(chosen, ["source", "tokens"])
    dealt = hashed.withColumn("h", F.xxhash64(F.lit(seed), "doc")).withColumn("lot", F.pmod("h", lots))
    by_lot = dealt.filter("extra > 0").groupBy("source", "tokens", "lot").agg(F.count("*").alias("n"), F.first("extra").alias("extra"))
    w = Window.partitionBy("source", "tokens").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    left = by_lot.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).select("source", "tokens", "lot", "n", (F.col("extra") - F.col("before")).alias("left"))
    placed = dealt.select("doc", "source", "tokens", "full", "h", "lot").join(left, ["source", "tokens", "lot"], "left")
    cut = (F.col("left") > 0) & (F.col("left") < F.col("n"))
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "lot").orderBy("h", "doc"))
    at_bound = placed.filter(cut).withColumn("once", (rank <= F.col("left")).cast("long"))
    others = placed.filter(~F.coalesce(cut, F.lit(False))).withColumn("once", F.coalesce(F.col("left") >= F.col("n"), F.lit(False)).cast("long"))
    both = at_bound.unionByName(others).select("doc", "source", "tokens", (F.col("full") + F.col("once")).alias("times"))
    return both.filter("times > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of `targets` actually contributes; 0 where it has no text."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("mixed_tokens"), F.count("*").alias("docs"), F.max("times").alias("most_repeats"))
    got = stored(got)
    total = got.agg(F.sum("mixed_tokens")).first()[0] or 0
    joined = targets.join(got, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "source",
        "target_share",
        "max_repeats",
        zero("docs").alias("docs"),
        zero("most_repeats").alias("most_repeats"),
        zero("mixed_tokens").alias("mixed_tokens"),
        F.coalesce(F.col("mixed_tokens") / F.lit(float(total or 1)), F.lit(0.0)).alias("actual_share"),
    )
