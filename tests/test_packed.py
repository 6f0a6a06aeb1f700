from varloom.operators.packed import CLOSE, OPEN, explode_packed

from tests.conftest import rows

CASES = {
    "A,C": ["A", "C"],
    " G ; T ": ["G", "T"],
    "A C\tG": ["A", "C", "G"],
    "A,,C": ["A", None, "C"],
    "A,": ["A"],
    ",A": [None, "A"],
    "A;C,": ["A", "C"],
    '"A,C";T': ["A,C", "T"],
    "'<DEL> ' / A": ["<DEL>", "A"],
    "<DUP,TANDEM>|<INS;ME>": ["<DUP,TANDEM>", "<INS;ME>"],
    "G]7:123],.": ["G]7:123]", "."],
    '" GA",*': ["GA", "*"],
    'A"C,G': ['A"C', "G"],
    f"{OPEN}0{CLOSE},'x,y'": [f"{OPEN}0{CLOSE}", "x,y"],
    "A\xa0C": ["A", "C"],
    "": [],
    "  ": [],
    None: [],
}


def expected(values):
    return [(i, v) for i, v in enumerate(values, 1) if v is not None]


def test_values_and_places(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "id long, cell string")
    got = rows(explode_packed(df, "cell", ["id"]))
    want = [(i, p, v) for i, cell in enumerate(CASES) for p, v in expected(CASES[cell])]
    assert got == sorted(want, key=lambda r: tuple(map(str, r))) or sorted(got) == sorted(want)


def test_least_number_of_values(spark):
    df = spark.createDataFrame([(1, "A,"), (2, "A,C"), (3, "A,,C"), (4, ",A")], "id long, cell string")
    got = explode_packed(df, "cell", ["id"], min_values=2)
    assert sorted(map(tuple, got.collect())) == [(2, 1, "A"), (2, 2, "C"), (3, 1, "A"), (3, 3, "C")]


def test_repeats_long_cells_and_clashing_names(spark):
    long = ",".join(["'a,b'"] * 20_000)
    df = spark.createDataFrame([(1, long, "x", 5), (1, "A|B", None, 6), (1, "A|B", None, 6)], "id long, cell string, value string, position int")
    got = explode_packed(df, "cell", ["id", "value", "position"])
    assert got.columns == ["id", "value_in", "position_in", "position", "value"]
    assert got.count() == 20_000 + 4
    assert got.filter("value = 'a,b'").count() == 20_000


def test_empty_table(spark):
    assert explode_packed(spark.createDataFrame([], "id long, cell string"), "cell", ["id"]).collect() == []


def test_plan_has_no_shuffle_and_reads_two_columns(spark, tmp_path):
    spark.createDataFrame([(1, "A,C", "z")], "id long, cell string, other string").write.parquet(str(tmp_path / "t"))
    plan = explode_packed(spark.read.parquet(str(tmp_path / "t")), "cell", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "other" not in plan and "Python" not in plan
