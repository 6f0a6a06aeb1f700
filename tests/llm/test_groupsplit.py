import random

from varloom.llm import groupsplit

MODELS = [("HLH-DA3L", "t1"), ("KDH2", "t2"), ("UTVR3", "t3"), ("UTVR3", "t3"), (None, "t4"), ("KP21", "t5")]
ALIASES = [("MGX22.2", "KDH2"), ("p17", "UTVR3"), ("KDH 2", "UTVR3"), ("old", "GONE")]


def tables(spark):
    return spark.createDataFrame(MODELS, "name2 string, tx_id string"), spark.createDataFrame(ALIASES, "other_name string, gene_symbol string")


def test_names(spark):
    cells = {
        1: ("KDH2", []), 2: ("kdh2", ["KDH2"]), 3: (" KDH2", ["KDH2"]), 4: ("gene:KDH2", ["KDH2"]), 5: ("Gene: 'kdh-2'", ["KDH2"]), 6: ("GENE=UTVR 3;", ["UTVR3"]),
        7: ("KDH2,UTVR3", ["KDH2", "UTVR3"]), 8: ("mgx22.2 / p17 / P-17", ["KDH2", "UTVR3"]), 9: ("KDH2, UNKNOWN7", ["KDH2"]), 10: ("UNKNOWN7", []), 11: (None, []), 12: ("", []), 13: ("KDH21", []),
        14: ("old", []), 15: ("hlh‑da3l", ["HLH-DA3L"]), 16: ("gene", []), 17: ("GENEKDH2", []), 18: ("p17", ["UTVR3"]), 19: (" , ;", []), 20: ("KP21", []), 21: ("KDH2," * 5000, ["KDH2"]),
    }
    df = spark.createDataFrame([(i, c, "x", 1) for i, (c, _) in cells.items()], "id long, gene_id string, symbol string, record int")
    sets = groupsplit.record_sets(df, "id", "gene_id")
    graph = groupsplit.entity_graph(sets, *tables(spark))
    got = sorted((r.record, r.symbol) for r in groupsplit.rewritten_names(sets, graph, tables(spark)[0]).collect())
    assert got == sorted((i, s) for i, (_, want) in cells.items() for s in want)


def test_components_against_union_find(spark):
    rng = random.Random(4)
    chain = [(f"c{i}", f"n{j}") for i in range(60) for j in (i, i + 1)]
    edges = chain + [(f"r{rng.randint(0, 40)}", f"e{rng.randint(0, 80)}") for _ in range(90)] * 2
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r, e in edges:
        parent[root("R" + r)] = root("E" + e)
    got = {r.entity: r.component for r in groupsplit.components(spark.createDataFrame(edges, "record string, entity string")).collect()}
    for e in got:
        same = [x for x in got if root("E" + x) == root("E" + e)]
        assert got[e] == min(same)
    assert groupsplit.components(spark.createDataFrame([], "record string, entity string")).collect() == []


def test_split_keeps_groups_and_shares(spark):
    rng = random.Random(6)
    models = spark.createDataFrame([(f"G{i}",) for i in range(300)], "name2 string")
    aliases = spark.createDataFrame([], "other_name string, gene_symbol string")
    data = [(i, rng.choice([None, "G0", *[f"g {rng.randint(0, 299)}"] * 6, f"G{rng.randint(0, 299)},U{rng.randint(0, 50)}"]), rng.choice(["a", "b", None]), 9) for i in range(4000)]
    df = spark.createDataFrame(data, "id long, gene_id string, label string, cell int")
    shares = spark.createDataFrame([("train", 0.7), ("valid", 0.1), ("test", 0.2)], "split_name string, target_share double")
    got = {r.record: r for r in groupsplit.related_split(df, "id", "gene_id", "label", models, aliases, shares).collect()}
    assert len(got) == len(data)
    split_of = {}
    for i, cell, _, _ in data:
        for name in (cell or f"#{i}").upper().replace(" ", "").split(","):
            assert split_of.setdefault(name, got[i].split_name) == got[i].split_name
    again = {r.record: r.split_name for r in groupsplit.related_split(df, "id", "gene_id", "label", models, aliases, shares).collect()}
    assert again == {i: r.split_name for i, r in got.items()}
    empty = groupsplit.related_split(df.limit(0), "id", "gene_id", "label", models, aliases, shares)
    assert empty.collect() == []


def test_an_alias_of_two_genes_ties_them(spark):
    models = spark.createDataFrame([("GA",), ("GB",), ("GC",)], "name2 string")
    aliases = spark.createDataFrame([("XX", "GA"), ("XX", "GB"), ("YY", "GB"), ("YY", "GC")], "other_name string, gene_symbol string")
    df = spark.createDataFrame([(1, "GA", "a"), (2, "GB", "a"), (3, "xx", "b"), (4, "GC", "b"), (5, None, "a")], "id long, g string, label string")
    sets = groupsplit.record_sets(df, "id", "g")
    graph = groupsplit.entity_graph(sets, models, aliases)
    group = {r.record: r.group for r in groupsplit.record_groups(sets, graph).collect()}
    assert group == {1: "GA", 2: "GA", 3: "GA", 4: "GC", 5: "#5"}
    assert sorted(map(tuple, groupsplit.rewritten_names(sets, graph, models).collect())) == [(3, "GA", "GA"), (3, "GB", "GA")]


def test_rare_labels_are_pooled_and_frequent_ones_are_not(spark, monkeypatch):
    monkeypatch.setattr(groupsplit, "LABELS", 3)
    rng = random.Random(9)
    rows = [(i, f"g{i}", rng.choice(["a", "b", "c"] * 20 + [f"r{k}" for k in range(40)])) for i in range(6000)]
    groups = spark.createDataFrame([r[:2] for r in rows], "record long, group string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "record long, label string")
    shares = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, target_share double")
    split = {r.record: r.split_name for r in groupsplit.group_split(groups, labels, shares).collect()}
    for label in "abc":
        of = [split[i] for i, _, x in rows if x == label]
        assert abs(of.count("test") / len(of) - 0.2) < 0.02
    assert abs(sum(s == "test" for s in split.values()) / len(rows) - 0.2) < 0.01


def test_balance_comes_near_the_shares():
    rng = random.Random(1)
    cells = [(c, x, rng.randint(1, 60)) for c in range(500) for x in range(4)] + [(1000, x, 900) for x in range(4)]
    out = groupsplit.balance(cells, {"train": 0.7, "valid": 0.1, "test": 0.2, "none": 0.0})
    total = sum(n for _, _, n in cells)
    for name, share in (("train", 0.7), ("valid", 0.1), ("test", 0.2)):
        assert abs(sum(n for c, _, n in cells if out[c] == name) / total - share) < 0.01
    assert groupsplit.balance([], {"a": 1.0}) == {}
