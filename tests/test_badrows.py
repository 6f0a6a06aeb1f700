import random

from varloom.operators import badrows
from varloom.operators.badrows import parse_lines, rejected_rows, valid_rows

GOOD = ["1", "100", ".", "A", "C", "30", "PASS", "AC=1", "GT", "0|1"]


def line(**changes):
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]
    return "\t".join(changes.get(n, v) for n, v in zip(names, GOOD))


def brute(text):
    """The reason by a character-wise reading of one line; '' valid, None skipped."""
    if text is None or text.startswith("#") or not text.strip():
        return None
    text = text[:-1] if text.endswith("\r") else text
    fields, i = [], 0
    while True:
        if text[i : i + 1] == '"':
            i += 1
            value = ""
            while True:
                if i >= len(text):
                    return "quoting"
                if text[i : i + 2] == '""':
                    value, i = value + '"', i + 2
                elif text[i] == '"':
                    i += 1
                    break
                else:
                    value, i = value + text[i], i + 1
            if i < len(text) and text[i] != "\t":
                return "quoting"
        else:
            end = text.find("\t", i)
            end = len(text) if end < 0 else end
            value, i = text[i:end], end
            if '"' in value:
                return "quoting"
        fields.append(value)
        if i >= len(text):
            break
        i += 1
    if len(fields) != 10:
        return "columns"
    chrom = fields[0].upper().removeprefix("CHR")
    if chrom not in {*map(str, range(1, 23)), "X", "Y", "MT"}:
        return "chrom"
    if not (fields[1].isascii() and fields[1].isdigit() and 1 <= int(fields[1]) <= 250_000_000):
        return "pos"
    if not fields[3] or set(fields[3].upper()) - set("ACGTN"):
        return "ref"
    return ""


def check(spark, lines):
    parsed = parse_lines(spark.createDataFrame(list(enumerate(lines)), "n long, line string"), "line", ["n"])
    got = {r.n: r.reason for r in rejected_rows(parsed, ["n"]).collect()}
    valid = {r.n for r in valid_rows(parsed).collect()}
    want = {i: brute(x) for i, x in enumerate(lines)}
    assert got == {i: r for i, r in want.items() if r}
    assert valid == {i for i, r in want.items() if r == ""}


def test_reasons(spark):
    check(
        spark,
        [
            line(), line() + "\r", line(chrom='"chrx"'), line(chrom="chr23"), line(chrom="chrchr1"), line(chrom=""), line(chrom=" 1"), line(pos="0"), line(pos="0000250000000"), line(pos="250000001"),
            line(pos="1e6"), line(pos="9" * 40), line(pos="+5"), line(ref="acgtn"), line(ref=""), line(ref="A C"), line(info='"a\tb"'), line(info='"say ""hi"""'), line(info='"say "hi""'),
            line(info='a"b'), line(sample='"x'), line(sample='"'), line(sample='""'), line() + "\t", "\t" * 9, "#x", "# \"", "", "   ", "\t", "\r", None, "1", '"', '""', line(id="0"), line(info='"\t"'),
        ],
    )


def test_random_lines(spark):
    rng = random.Random(5)
    check(spark, ["".join(rng.choice('"\t\ta1') for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [line(info="".join(rng.choice('"\tx') for _ in range(rng.randint(0, 8)))) for _ in range(2000)])


def test_long_lines_repeats_and_clashing_names(spark):
    huge = line(info='"' + 'x""\t' * 100_000 + '"')
    df = spark.createDataFrame([(1, huge, "k"), (1, huge, "k"), (2, "x" + "\t" * 200_000, None)], "pos long, line string, errors string")
    parsed = parse_lines(df, "line", ["pos", "errors"])
    assert valid_rows(parsed).count() == 2
    assert [r.reason for r in rejected_rows(parsed, ["pos_in"]).collect()] == ["columns"]


def test_empty_table(spark):
    parsed = parse_lines(spark.createDataFrame([], "n long, line string"), "line", ["n"])
    assert valid_rows(parsed).collect() == [] and rejected_rows(parsed, ["n"]).collect() == []


def test_both_sides_from_one_pass(spark, tmp_path):
    ok, bad = "1\t5\t.\tA\tC\t9\tPASS\tx\tGT\t0|1", "1\t5"
    df = spark.createDataFrame([(1, ok), (2, bad), (3, "#x")], "line_id long, line string")
    for _ in range(2):
        valid, rejected = badrows.loaded_once(badrows.parse_lines(df, "line", ["line_id"]), str(tmp_path / "p"))
        assert [(r.line_id, r.pos) for r in valid.collect()] == [(1, 5)] and [(r.line_id, r.errors) for r in rejected.collect()] == [(2, ["columns"])]
    none = badrows.loaded_once(badrows.parse_lines(df.limit(0), "line", ["line_id"]), str(tmp_path / "e"))
    assert [d.count() for d in none] == [0, 0]
