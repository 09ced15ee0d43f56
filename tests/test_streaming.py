from millrace.streaming import windows


def test_a_stream_gives_the_rows_of_finished_windows(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", "a" if h % 2 else "b", float(h)) for d in range(1, 6) for h in range(8)]
    events = spark.createDataFrame(rows, "t string, k string, v double").selectExpr("to_timestamp(t) AS t", "k", "v")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    windows.run_once(windows.windowed(windows.read_stream(spark, f"{tmp_path}/in", events), "t", "k", "v"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in windows.windowed(events, "t", "k", "v").collect()}
    assert got <= want and len(want) == 10 and 6 <= len(got) < 10
