import random

from varloom.llm import overlap

SCHEMA = "row_id long, split_name string, source string, chrom string, pos long, ref string, alt string, tokens string, text_id string"
ALSO = ["split_name", "source"]


def change(chrom, pos, ref, alt):
    """The change by the plain rules, or None."""
    if chrom is None or pos is None or alt is None:
        return None
    bare = lambda x: "".join(x.split()).upper()
    chrom, ref, alt = bare(chrom).removeprefix("CHR"), bare(ref or ""), bare(alt).split(",")[0]
    if not chrom or not alt:
        return None
    while len(ref) > 1 and len(alt) > 1 and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        ref, alt, pos = ref[1:], alt[1:], pos + 1
    return chrom, alt, pos


def pairs(data):
    known = [(r[0], r[1], change(*r[3:7])) for r in data if r[1] in ("train", "valid", "test")]
    known = [k for k in known if k[2]]
    return sorted(
        (t, e) for t, s, a in known if s == "train" for e, z, b in known if z != "train" and a[:2] == b[:2] and abs(a[2] - b[2]) <= 1
    )


def test_against_brute_force(spark):
    rng = random.Random(8)
    seq = lambda: "".join(rng.choice("ACac") for _ in range(rng.randint(1, 4)))
    data = []
    for i in range(900):
        alt = rng.choice([seq(), seq() + ",G", " " + seq(), "*", "<NON_REF>", None, "", ",A"]) if i % 3 else seq()
        data.append((i, rng.choice(["train", "train", "valid", "test", "other", None]), rng.choice(["s", None]), rng.choice(["1", "chr1", " CHR 1", "2", None]), rng.choice([None, *range(90, 100)]), rng.choice([seq(), None, ""]), alt, "t", "x"))
    data += [(5000 + i, "train" if i % 2 else "test", "hot", "9", 7, "A", "C", "t", "x") for i in range(60)]
    rows = overlap.split_rows(spark.createDataFrame(data, SCHEMA), ALSO)
    assert sorted(map(tuple, overlap.overlapping_pairs(rows).collect())) == pairs(data)


def test_lots_of_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PAIR_ROWS", 7)
    data = [(i, "train" if i % 2 else "valid", "s", "1", 5 + i % 3, "A", "C", "", "") for i in range(100)]
    rows = overlap.split_rows(spark.createDataFrame(data, SCHEMA), ALSO)
    assert sorted(map(tuple, overlap.overlapping_pairs(rows).collect())) == pairs(data)


def test_report_and_empty(spark):
    data = [(1, "train", "s", "1", 5, "A", "C", "", ""), (2, "test", "s", "1", 6, "A", "C", "", ""), (3, "valid", None, "1", 5, "A", "C", "", ""), (4, "test", "s", "1", 9, "A", "C", "", "")]
    got = {(r.split_name, r.source): (r.n_rows, r.n_same, r.n_near_only) for r in overlap.overlap_report(overlap.split_rows(spark.createDataFrame(data, SCHEMA), ALSO)).collect()}
    assert got == {("train", "s"): (1, 1, 0), ("test", "s"): (2, 0, 1), ("valid", None): (1, 1, 0)}
    none = overlap.split_rows(spark.createDataFrame([], SCHEMA), ALSO)
    assert overlap.overlapping_pairs(none).collect() == [] and overlap.overlap_report(none).collect() == []


def test_long_alleles(spark):
    long = "A" * 30_000
    data = [(1, "train", "s", "1", 5, long + "G", long + "T", "", ""), (2, "test", "s", "1", 30_005, "G", "T", "", "")]
    rows = overlap.split_rows(spark.createDataFrame(data, SCHEMA), ALSO)
    assert sorted(map(tuple, overlap.overlapping_pairs(rows).collect())) == [(1, 2)]


def windows(tokens, m):
    return {tuple(tokens[i : i + m]): i for i in range(len(tokens) - m + 1)}


def brute(texts, m):
    """Covered tokens of each text, and the linked pairs, by comparing all windows."""
    sides = {s: [t for t in texts if t[1] is s] for s in (True, False)}
    of = {s: {w for t in sides[s] for w in windows(t[2], m)} for s in sides}
    covered = {}
    for name, side, tokens in texts:
        places = {i + k for i in range(len(tokens) - m + 1) if tuple(tokens[i : i + m]) in of[not side] for k in range(m)}
        if places:
            covered[name, side] = len(places)
    linked = {(a[0], b[0]) for a in sides[True] for b in sides[False] if windows(a[2], m).keys() & windows(b[2], m).keys()}
    return covered, linked


def test_suffix_array_against_brute_force(spark):
    """Long spans, several texts under one beginning, gaps between spans, partitions in the middle of a beginning."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(6)
        words = [f"w{i}" for i in range(30)]
        shared = [[rng.choice(words) for _ in range(n)] for n in (3, 5, 12, 40)]
        texts = []
        for i in range(70):
            parts = [[rng.choice(words) for _ in range(rng.randint(0, 6))] + rng.choice(shared)[rng.randint(0, 2) :] for _ in range(rng.randint(0, 3))]
            texts.append((f"t{i}", rng.random() < 0.6, [x for p in parts for x in p]))
        texts += [(f"hot{i}", i < 30, ["a", "b", "c", f"x{i}"]) for i in range(60)]
        df = spark.createDataFrame(texts, "text_id string, is_train boolean, tokens array<string>")
        for m, depth in ((3, 3), (3, 8), (5, 6)):
            spans = overlap.cross_spans(df, m, depth)
            covered, linked = brute(texts, m)
            assert {(r.text_id, r.is_train): r.covered for r in overlap.coverage(spans).collect()} == covered
            assert {tuple(r) for r in overlap.linked_texts(spans).collect()} == linked
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_three_texts_under_one_beginning(spark):
    texts = [("t1", True, list("abcx")), ("t2", True, list("abcy")), ("e1", False, list("abcz"))]
    df = spark.createDataFrame(texts, "text_id string, is_train boolean, tokens array<string>")
    assert {tuple(r) for r in overlap.linked_texts(overlap.cross_spans(df, 3)).collect()} == {("t1", "e1"), ("t2", "e1")}
    only = overlap.cross_spans(df.filter("is_train"), 3)
    assert only.collect() == [] and overlap.coverage(only).collect() == []
