import datetime as dt
import random
import re

from pyspark.sql import functions as F

from varloom.llm import ledger
from varloom.support import hadoop_path, shared_dir

SCHEMA = "variant_id long, chrom string, pos long, ref string, alt string, info string, sample_id string, loaded_ts timestamp, copies int, h1 string"


def call(i, chrom="1", pos=5, ref="A", alt="C", info="AC=1;AN=2", sample="S", year=2020):
    return (i, chrom, pos, ref, alt, info, sample, None if year is None else dt.datetime(year, 1, 1), 0, "x")


def found(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return sorted(map(tuple, ledger.hidden_copies(df).collect())), {r.first: r.copies for r in ledger.hidden_counts(df).collect()}


def norm(c):
    text = lambda x, also="": None if x is None else re.sub(rf"[^a-z0-9{also}]", "", x.lower())
    items = lambda x, seps, also: None if x is None else tuple(sorted(filter(None, (text(p, also) for p in re.split(seps, x)))))
    _, chrom, pos, ref, alt, info, sample, *_ = c
    return (re.sub("^chr", "", text(chrom)) if chrom is not None else None, pos, text(ref, "*"), items(alt, "[,;|/]", "*"), items(info, "[,;|]", "="), sample)


def test_ways_of_writing(spark):
    same = [
        call(3), call(1, chrom="Chr 1"), call(2, chrom='"chr:1."'), call(4, ref=" a"), call(5, alt="(c)"), call(6, info="an=2 | ac = 1;"), call(7, chrom="\xa01"), call(9, year=2018), call(8, year=None),
    ]
    other = [
        call(20, chrom="1_random"), call(21, chrom=None), call(22, pos=6), call(23, pos=None), call(24, ref=None), call(25, alt=None), call(26, info=None), call(27, info="AC=1;AN=2;LOW"), call(28, sample="s"), call(29, sample=None),
        call(30, alt="C,G"), call(31, info="AC=12"), call(32, ref=""), call(33, alt=""), call(34, info=""), call(35, alt="CG"), call(36, ref="~"), call(37, info="AC=1;AC=1;AN=2"),
    ]
    pairs, counts = found(spark, same + other + [call(40, alt="g / c"), call(41, alt="G;C")])
    assert pairs == sorted([(1, i) for i in (2, 3, 4, 5, 6, 7, 8, 9)] + [(30, 40), (30, 41), (32, 36)])
    assert counts[1] == 9 and counts[30] == 3 and sum(counts.values()) == len(same + other) + 2


def test_against_brute_force_with_hot_groups(spark):
    rng = random.Random(2)
    pick = lambda *xs: rng.choice(xs)
    data = [
        call(i, pick("1", "chr1", " 2", "CHR2", None), pick(1, 2), pick("A", "a ", None), pick("C", "c", "C,G", "g;c", None), pick("AC=1;AN=2", "an=2, ac=1", "AC=1"), pick("S1", "S2"), pick(2018, 2019, 2020, None))
        for i in range(1500)
    ]
    data += [call(i, info="DP=9" if i % 2 else "dp = 9;") for i in range(2000, 3000)]
    pairs, counts = found(spark, data)
    groups = {}
    for c in data:
        groups.setdefault(norm(c), []).append(c[0])
    assert pairs == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert counts == {min(g): len(g) for g in groups.values()}


def test_empty_table(spark):
    assert found(spark, []) == ([], {})


def test_batches_add_up_and_repeat_safely(spark):
    path = shared_dir(spark, "t")
    first = ledger.Ledger(spark, path)
    batch = lambda ids: spark.createDataFrame([(i % 7, i % 7 * 3, i) for i in ids], "h1 long, h2 long, id long")
    first.merge(batch(range(10, 40)), "a")
    first.merge(batch(range(5, 12)), "b")
    first.merge(batch(range(5, 12)), "b")
    again = ledger.Ledger.open(spark, path)
    again.merge(batch([1000]), "c")
    again.merge(batch([1000]), "a")
    want = {}
    for i in [*range(10, 40), *range(5, 12), 1000]:
        n, low = want.get(i % 7, (0, 10**9))
        want[i % 7] = (n + 1, min(low, i))
    spark.sql(f"DROP TABLE ledger_{again.runs[-1].name}")  # as in a session that has not read it yet
    opened = ledger.Ledger.open(spark, path)
    assert {r.h1: (r.copies, r["first"]) for r in opened.rows().collect()} == want
    assert opened.copies == 38 and set(opened.labels) == {"a", "b", "c"}
    folders = [f.getPath().getName() for f in hadoop_path(spark, f"{path}/runs")[0].listStatus(hadoop_path(spark, f"{path}/runs")[1])]
    assert sorted(folders) == sorted(r.name for r in opened.runs)


def test_a_small_batch_leaves_a_large_run_alone(spark):
    big = ledger.Ledger(spark, shared_dir(spark, "t"), keys_per_bucket=20)
    rows = lambda ids: spark.createDataFrame([(i, i, i) for i in ids], "h1 long, h2 long, id long")
    big.merge(rows(range(300)), "a")
    big.merge(rows(range(295, 305)), "b")
    assert [r.keys for r in big.runs] == [300, 10] and big.runs[0].buckets == 16
    assert {r.h1: r.copies for r in big.rows().collect()} == {i: 1 + (295 <= i < 300) for i in range(305)}
    big.merge(rows(range(1000, 1090)), "c")
    assert [r.keys for r in big.runs] == [395] and big.runs[0].buckets == 32
    big.merge(rows(range(200)), "d")
    assert sum(r.copies for r in big.rows().collect()) == 600 == big.copies


def test_the_ledger_is_not_shuffled(spark):
    """In the join of a batch with a run, only the batch passes through an exchange."""
    led = ledger.Ledger(spark, shared_dir(spark, "t"))
    ids = spark.range(5000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"), "id")
    led.merge(ids, "a")
    counted = ids.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("first")).repartition(ledger.BUCKETS, "h1", "h2")
    plan = ledger._added(counted, led._table(led.runs[0]))._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.index("o1#") :]
    assert "SortMergeJoin" in plan or "HashJoin" in plan
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 2 and "Exchange" not in right[right.rindex("FileScan") - 400 :]


def test_later_calls_merge_only_new_batches(spark):
    path = shared_dir(spark, "t")
    data = [call(1, year=2019), call(2, year=2019), call(3, year=2020)]
    ledger.hidden_duplicates(spark.createDataFrame(data, SCHEMA), path)
    more = [*data, call(4, year=2021), call(5, pos=9, year=2021)]
    got = ledger.hidden_duplicates(spark.createDataFrame(more, SCHEMA), path)
    assert sorted(map(tuple, ledger.copies(got.staged(), got.rows(), got.copies).collect())) == [(1, 2), (1, 3), (1, 4)]
    assert got.copies == 5 and {r.first: r.copies for r in got.rows().collect()} == {1: 4, 5: 1}
    fresh = {s.split("/keys/")[1].split("/")[0] for label, s in got.labels.items() if label == "2021"}
    assert len(fresh) == 1 and len(set(got.labels.values())) == 3
    got.vacuum()
    assert got.rows().count() == 2
