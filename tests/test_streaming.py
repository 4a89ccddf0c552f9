from pyspark.sql import functions as F

from ldmill.streaming.edges import daily_figures, read_edge_stream, usable_edges


def test_stream_equals_batch(spark, data, tmp_path):
    el = spark.read.parquet(f"{data}/el.parquet")
    el.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = daily_figures(usable_edges(read_edge_stream(spark, str(tmp_path / "in"), files_per_trigger=1), "400 days"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("figures").option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    name = lambda c: F.upper(F.trim(F.col(c)))
    rows = el.where("r2 BETWEEN 0 AND 1 AND computed_at IS NOT NULL").where(name("snp1") != name("snp2")).withColumns({"a": F.least(name("snp1"), name("snp2")), "b": F.greatest(name("snp1"), name("snp2"))})
    # which of two equal rows stays is open, and with it the chromosome named first: days must agree
    days = lambda df: {(str(r["day"]), r["n"]) for r in df.groupBy("day").agg(F.sum("n").alias("n")).collect()}
    want = days(daily_figures(rows.dropDuplicates(["a", "b", "computed_at"])))
    assert days(spark.table("figures")) == want and len(want) > 5
