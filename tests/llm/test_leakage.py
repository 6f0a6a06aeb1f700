import random
import re

from varloom.llm import leakage

WORDS = [f"w{i}" for i in range(400)]


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string, doc string, w string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc, r.item): r for r in leakage.leaked_passages(d, "doc_id", "text", i, "item_id", "text", **more).collect()}


def plain(text):
    text = text or ""
    for _ in range(2):
        text = re.sub(r"\([^()\[\]]*\)|\[[^()\[\]]*\]", " ", text)
    return re.findall(r"[^\W_]+", text.lower())


def brute(docs, items, n=10):
    runs_of = lambda t: {tuple(w[k : k + n]) for w in [plain(t)] for k in range(len(w) - n + 1)}
    of_item = {i: runs_of(t) for i, t in items}
    out = set()
    for d, text, *_ in docs:
        runs = runs_of(text)
        out |= {(d, i) for i in of_item if of_item[i] & runs}
    return out


def test_passages_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 9, 10, 30, 60])))) for i in range(40)] + [(98, None), (99, "")]
    docs = []
    for d in range(160):
        w = [rng.choice(WORDS) for _ in range(80)]
        part = items[rng.randrange(40)][1].split()
        at, n = rng.randrange(max(1, len(part) - 8)), rng.choice([5, 8, 9, 10, 11, 14, 40])
        piece = part[at : at + n]
        joined = " ".join(w[:40]) + " " + rng.choice([" ", ", ", "\n", " [page (3) x] "]).join(x.upper() if rng.random() < 0.2 else x for x in piece) + ". " + " ".join(w[40:])
        docs.append((d, joined, "a", "b"))
    docs += [(900, None, "a", "b"), (901, "", "a", "b"), docs[0], (902, " ".join(w * 20_000) + " " + items[10][1], "a", "b")]
    got = found(spark, docs, items)
    assert {k for k, r in got.items() if r.distance == 0} == brute(docs, items)


def test_near_passages(spark):
    item = " ".join(WORDS[:30])
    edited = item.replace("w14", "w1x4")
    broken = " ".join(x + "zz" if i % 4 == 3 else x for i, x in enumerate(WORDS[:30]))
    got = found(spark, [(1, " ".join(edited.split()[7:21]), "", ""), (2, broken, "", ""), (3, " ".join(WORDS[3:12]), "", "")], [(5, item)])
    assert set(got) == {(1, 5)} and got[1, 5].distance == 1
    assert set(found(spark, [(1, edited, "", "")], [(5, item)], budget=0)) == {(1, 5)}


def test_near_passages_at_any_word(spark):
    words = WORDS[:30]
    docs, d = [], 0
    for start in range(20):
        run = words[start : start + 10]
        for at in range(1, 9):
            other = [[*run[:at], run[at] + "q", *run[at + 1 :]], [*run[:at], run[at][:1], run[at][1:], *run[at + 1 :]], [*run[: at - 1], run[at - 1] + run[at], *run[at + 1 :]]]
            docs += [(d + i, "so " + " ".join(x) + " on", "", "") for i, x in enumerate(other)]
            d += len(other)
    got = found(spark, docs, [(5, " ".join(words))])
    assert len(got) == len(docs) == 480 and all(r.distance == 1 for r in got.values())


def test_words_of_a_passage_must_be_whole(spark):
    item = " ".join(WORDS[10:20])
    got = found(spark, [(1, "x" + item, "", ""), (2, item + "9", "", ""), (3, item, "", "")], [(5, item)])
    assert {k for k, r in got.items() if r.distance == 0} == {(3, 5)}


def test_items_in_blocks_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 60)
    monkeypatch.setattr(leakage, "STRETCH", 15)
    monkeypatch.setattr(leakage, "HITS_AT_ONCE", 3)
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(50))) for i in range(20)]
    docs = [(i * 100 + at, "so " + " ".join(text.split()[at : at + n]) + " on", "", "") for i, text in items for at in range(0, 40, 7) for n in [rng.choice([9, 10])]]
    got = found(spark, docs, items)
    assert {k for k, r in got.items() if r.distance == 0} == brute(docs, items) and len(got) > 40


def test_near_runs_against_the_distance_of_every_window(spark):
    """Random texts with planted runs of ten to thirteen words, one or two letters changed: exactly those within the budget come out."""
    rng = random.Random(21)
    vocabulary = [rng.choice("abcd") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 24)))) for i in range(12)]
    docs = []
    for d in range(150):
        w = rng.choice(items)[1].split()
        n = min(len(w), rng.randint(9, 13))
        at = rng.randint(0, len(w) - n)
        run = list(" ".join(w[at : at + n]))
        for _ in range(rng.randint(0, 2)):
            k, how = rng.randrange(len(run)), rng.choice("sdi")
            run[k : k + (how != "i")] = [] if how == "d" else [rng.choice("abcdq ")]
        docs.append((d, " ".join(rng.choice(vocabulary) for _ in range(4)) + " " + "".join(run) + " " + " ".join(rng.choice(vocabulary) for _ in range(4)), "", ""))
    got = found(spark, docs, items)
    want = {}
    for d, text, *_ in docs:
        t = f" {' '.join(plain(text))} "
        for i, item in items:
            w = plain(item)
            best = min(leakage.edit_distance(f" {' '.join(w[k : k + 10])} ", t) for k in range(len(w) - 9))
            if best <= 1:
                want[d, i] = best
    assert {k: r.distance for k, r in got.items()} == want and 20 < sum(want.values()) < len(want)


def test_brackets_at_any_depth():
    rng = random.Random(1)
    inner = re.compile(r"\([^()\[\]]*\)|\[[^()\[\]]*\]")
    for _ in range(3000):
        text = want = "".join(rng.choice("ab()[]") for _ in range(rng.randint(0, 14)))
        while inner.search(want):
            want = inner.sub(" ", want)
        assert leakage.unnested(text).split() == want.split()
    assert leakage.unnested("(" * 50_000 + "x" + ")" * 50_000 + " y").split() == ["y"]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c d e f g h i j k")]) == {} and found(spark, [(1, "a b", "", "")], []) == {}


def test_distance_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        p, t = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, n))) for n in (12, 90))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert leakage.edit_distance(p, t) == min(row)
