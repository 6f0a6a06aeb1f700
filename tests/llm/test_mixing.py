import random

from hypothesis import given, settings
from hypothesis import strategies as st

from varloom.llm import mixing


def mixed(spark, docs, targets, **more):
    d = spark.createDataFrame(docs, "doc long, source string, tokens long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    got = mixing.mix(d, t, **more)
    return got.collect(), {r.source: r for r in mixing.shares(got, t).collect()}


def test_shares_and_caps(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["big"] * 6 + ["small", "mid", "other", None]), rng.choice([0, 7, rng.randint(1, 900)])) for i in range(5000)]
    targets = [("big", 0.5, 1), ("small", 0.3, 4), ("mid", 0.2, 2), ("absent", 0.1, 3)]
    rows, shares = mixed(spark, docs, targets)
    cap = {s: r for s, _, r in targets}
    assert len({r.doc for r in rows}) == len(rows)
    assert all(1 <= r.times <= cap[r.source] for r in rows)
    total = sum(r.tokens * r.times for r in rows)
    for s, share, _ in targets[:3]:
        assert abs(shares[s].actual_share - share) < 2e-4
        assert shares[s].mixed_tokens == sum(r.tokens * r.times for r in rows if r.source == s)
    assert shares["absent"].docs == 0 and sum(r.mixed_tokens for r in shares.values()) == total
    again, _ = mixed(spark, docs, targets)
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    other, _ = mixed(spark, docs, targets, seed=8)
    assert {r.doc for r in other} != {r.doc for r in rows}


def test_total_is_a_bound(spark):
    docs = [(i, "a" if i % 3 else "b", 10 + i % 5) for i in range(900)]
    rows, shares = mixed(spark, docs, [("a", 0.5, 1), ("b", 0.5, 3)], total_tokens=2000)
    assert abs(sum(r.tokens * r.times for r in rows) - 2000) < 20 and abs(shares["a"].actual_share - 0.5) < 0.01
    more, _ = mixed(spark, docs, [("a", 0.5, 1), ("b", 0.5, 3)], total_tokens=10**9)
    assert sorted(map(tuple, more)) == sorted(map(tuple, mixed(spark, docs, [("a", 0.5, 1), ("b", 0.5, 3)])[0]))


def test_hot_length_is_dealt_into_lots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 50)
    docs = [(i, "a", 10) for i in range(2000)] + [(5000 + i, "b", 10) for i in range(300)]
    rows, shares = mixed(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)])
    assert shares["a"].mixed_tokens == shares["b"].mixed_tokens == 6000 and sum(r.source == "a" for r in rows) == 600


def test_empty_tables(spark):
    assert mixed(spark, [], [("a", 1.0, 1)])[0] == []
    assert mixed(spark, [(1, "a", 5)], [])[0] == []
    assert mixed(spark, [(1, "a", 0)], [("a", 1.0, 1)])[0] == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 120), st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=6))
def test_knapsack_is_best(budget, counts):
    taken = mixing.fit(budget, counts)
    assert all(0 <= taken[k] <= counts[k] for k in taken)
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= budget)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 40_000), st.integers(1, 3), st.dictionaries(st.integers(0, 300), st.integers(1, 60), max_size=12))
def test_choice_keeps_its_bounds(budget, repeats, counts):
    full, extra = mixing.choose(budget, repeats, counts, knapsack=500)
    size = sum(k * n for k, n in counts.items())
    assert 0 <= full <= repeats and all(0 < extra[k] <= counts[k] for k in extra)
    assert full < repeats or not extra
    used = full * size + sum(k * n for k, n in extra.items())
    assert used <= budget or not size
    assert used >= min(budget, repeats * size) - max([k for k in counts if k] or [0])


def test_token_lengths(spark):
    texts = ["Hello world", "", None, "naïve 東京 <|endoftext|>", "word " * 50_000, "x" * 20_000]
    df = spark.createDataFrame([(i, "s", t, 1) for i, t in enumerate(texts)], "id long, source string, text string, tokens int")
    got = {r.doc: r.tokens for r in mixing.token_lengths(df, "id", "source", "text").collect()}
    assert got[0] == 2 and got[1] == got[2] == 0 and got[4] >= 50_000 and got[3] > 5 and got[5] > 0
