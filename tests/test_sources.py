import gzip
import struct

from pyspark.sql import functions as F

from varloom.sources import genome, tables, variants


def packed(sequences):
    """A packed genome file of the given sequences, N stretches as blocks."""
    codes = {"T": 0, "C": 1, "A": 2, "G": 3, "N": 0}
    header = struct.pack("<4I", genome.SIGNATURE, 0, len(sequences), 0)
    index_size = sum(5 + len(n) for n in sequences)
    at, index, bodies = 16 + index_size, b"", b""
    for name, seq in sequences.items():
        blocks, i = [], 0
        while i < len(seq):
            if seq[i] == "N":
                j = i
                while j < len(seq) and seq[j] == "N":
                    j += 1
                blocks.append((i, j - i))
                i = j
            else:
                i += 1
        bits = "".join(f"{codes[b]:02b}" for b in seq).ljust((len(seq) + 3) // 4 * 8, "0")
        body = struct.pack("<2I", len(seq), len(blocks)) + struct.pack(f"<{len(blocks)}I", *[b for b, _ in blocks]) + struct.pack(f"<{len(blocks)}I", *[n for _, n in blocks])
        body += struct.pack("<2I", 0, 0) + bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
        index += bytes([len(name)]) + name.encode() + struct.pack("<I", at + len(bodies))
        bodies += body
    return header + index + bodies


def test_genome_file(spark, tmp_path):
    seqs = {"one": "ACGTNNNACGTTTGCAN" * 9000, "two": "GATTACA", "none": ""}
    (tmp_path / "g.2bit").write_bytes(packed(seqs))
    chunks = genome.read_genome(spark, str(tmp_path / "g.2bit")).cache()
    got = chunks.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "seq"))), lambda x: x["seq"]), "").alias("s")).collect()
    assert {r.name: r.s for r in got} == {n: s for n, s in seqs.items() if s}
    assert {r.name: r["size"] for r in genome.sizes(chunks).collect()} == {"one": 153_000, "two": 7}
    wanted = spark.createDataFrame([(1, "two", -3, 4), (2, "two", 5, 99), (3, "no", 0, 2), (4, "one", 65_530, 65_545), (5, "two", 4, 4)], "region_id long, name string, start long, end long")
    found = {r.region_id: r.seq for r in genome.regions(chunks, wanted).collect()}
    assert found == {1: "GATT", 2: "CA", 4: seqs["one"][65_530:65_545]}
    long = genome.regions(chunks, spark.createDataFrame([(6, "one", 0, 130), (7, "one", 0, 120)], "region_id long, name string, start long, end long"))
    s = seqs["one"]
    assert {r.region_id: r.record for r in genome.fasta(long).collect()} == {6: f">one:0-130\n{s[:60]}\n{s[60:120]}\n{s[120:130]}", 7: f">one:0-120\n{s[:60]}\n{s[60:120]}"}


def test_text_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("#a\t#b\n1\tna\n2\t3\n")
    m = tables.read_matrix(spark, str(tmp_path / "m.tsv"))
    assert m.columns == ["a", "b"] and [tuple(r) for r in m.orderBy("a").collect()] == [(1.0, None), (2.0, 3.0)]
    (tmp_path / "7-2.scored").write_text("0.5\t1\n# c\nna\n0.25 0 # x\n")
    s = tables.read_scores(spark, str(tmp_path / "*.scored")).collect()
    assert [(r.major, r.replicate, r.label) for r in s] == [("7", "2", 1), ("7", "2", None), ("7", "2", 0)] and s[1].score != s[1].score
    (tmp_path / "motifs").write_text("# c\nacgtacgt\nACG\n\nTTTTTTTT\n")
    assert sorted(r.motif for r in tables.read_motifs(spark, str(tmp_path / "motifs"), 8).collect()) == ["ACGTACGT", "TTTTTTTT"]
    (tmp_path / "weights").write_text("{'m': {'threshold': 1.5, 'motif': {'A': [1, 2], 'C': [0.5, -1]}}}")
    assert tables.read_weights(spark, str(tmp_path / "weights")).count() == 4
    with gzip.open(tmp_path / "v.vcf.gz", "wt") as f:
        f.write("#h\n1 5 . A C\n")
    assert variants.vcf_records(variants.read_lines(spark, str(tmp_path / "v.vcf.gz")), "value", []).first().pos == 5


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    for _ in range(2):
        tables.write_table(df.coalesce(1), str(tmp_path / "t"))
    text = next((tmp_path / "t").glob("part-*")).read_text()
    assert text.splitlines() == ["#a\tb", "1\tx", "2\tna"]
    assert tables.stage(df, str(tmp_path / "s")).count() == 2
    assert tables.stage(df.limit(1), str(tmp_path / "s")).count() == 2
    tables.train_test(df.withColumn("role", F.lit("test")), str(tmp_path / "tt"), ["role"])
    assert (tmp_path / "tt" / "role=test").exists()
    assert tables.run_record(spark, "rank", {"b": 1, "a": 2}).first().arguments == '{"a": 2, "b": 1}'
    assert df.select(tables.svm_line(F.col("a"), [F.col("a"), F.lit(None)])).first()[0] == "1 qid:1 1:1 2:0"


def test_what_a_broken_run_left_is_written_over(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    for n, write in enumerate((tables.write_table, tables.stage, lambda d, p: tables.train_test(d, p, ["b"]))):
        path = tmp_path / str(n)
        write(df.limit(1), str(path))
        (path / "_SUCCESS").unlink()
        write(df, str(path))
        write(df.limit(0), str(path))
        assert (path / "_SUCCESS").exists()
    assert spark.read.parquet(str(tmp_path / "1")).count() == spark.read.parquet(str(tmp_path / "2")).count() == 2


def test_models_are_saved_once_and_whole(spark, tmp_path):
    from varloom.operators import models

    df = spark.createDataFrame([(float(i % 2), i % 2) for i in range(40)], "a double, y int")
    fitted = models.linear_svm(["a"], "y", steps=10).fit(df)
    for _ in range(2):
        tables.save_model(fitted, str(tmp_path / "m"))
    assert [p.name for p in tmp_path.iterdir()] == ["m"]
    assert models.scores(tables.load_model(str(tmp_path / "m")), df).count() == 40


def test_conservation_table(spark, tmp_path):
    (tmp_path / "c").write_text("#score chrom pos\n1.5\tchr1\t7\n-2 X 9\nbad X y\n\n")
    assert sorted(map(tuple, tables.read_conservation(spark, str(tmp_path / "c")).collect())) == [("1", 7, 1.5), ("X", 9, -2.0)]


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    import pytest

    from varloom import support

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        support.shared_dir(Session(), "x")


def test_broadcast_hint_goes_by_rows_and_bytes(spark):
    from varloom.support import small

    df = spark.range(10).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(small(df)) and not hinted(small(df, rows=9)) and not hinted(small(df, size=500)) and small(df, rows=9).count() == 10
