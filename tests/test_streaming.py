from pagewright.streaming.reports import stream_reports


def test_reports_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "# a\n<!-- PDF page 1 -->"), (2, "$$")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream_reports(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert {(r.doc_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "PASS"), (2, "FAIL")}
