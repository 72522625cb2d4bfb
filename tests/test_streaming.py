from gleanery.operators.quality import quality_gate, quality_score
from gleanery.plans.fixtures import records
from gleanery.streaming.rows import evaluation_stream, gate_stream, write_available


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = records(spark, "/root/testdata/sf0.001").drop("vl")
    rows.write.parquet(str(tmp_path / "in"))
    stream = gate_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    for _ in range(2):  # a second run finds nothing new
        write_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    pick = lambda df: sorted((r["doc_id"], r["quality_verdict"], r["quality_score"]) for r in df.collect())
    assert pick(spark.read.parquet(str(tmp_path / "out"))) == pick(quality_score(quality_gate(rows)))


def test_evaluations(spark, tmp_path):
    spark.createDataFrame([(1, '{"view_angle": "back"}'), (2, "none")], "id int, answer string").write.parquet(str(tmp_path / "in"))
    stream = evaluation_stream(spark.readStream.schema("id int, answer string").parquet(str(tmp_path / "in")))
    write_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["id"]: r["vl"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1]["view_angle"] == "back" and got[2] is None
