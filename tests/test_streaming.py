from varloom.operators.packed import explode_packed
from varloom.streaming.batches import annotate_new, read_new


def test_new_files_are_annotated_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.createDataFrame([(1, "A,C")], "id long, alt string").write.parquet(source)
    for _ in range(2):
        annotate_new(read_new(spark, source), lambda b: explode_packed(b, "alt", ["id"]), out, mark).awaitTermination()
    spark.createDataFrame([(2, "G")], "id long, alt string").write.mode("append").parquet(source)
    annotate_new(read_new(spark, source), lambda b: explode_packed(b, "alt", ["id"]), out, mark).awaitTermination()
    assert sorted((r.id, r.value) for r in spark.read.parquet(out).collect()) == [(1, "A"), (1, "C"), (2, "G")]
