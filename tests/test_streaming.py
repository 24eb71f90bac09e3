import datetime

from provena.streaming import vote_totals


def test_a_stream_gives_what_the_table_gives(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("d", k % 2, k, t + datetime.timedelta(minutes=20 * k)) for k in range(12)]
    table = spark.createDataFrame(rows, "disc_id string, track_pos int, confidence int, at timestamp")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    keys = ["disc_id", "track_pos"]
    stream = vote_totals(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), keys)
    q = stream.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, vote_totals(table, keys).collect()))
    assert sorted(map(tuple, spark.table("totals").collect())) == want and len(want) == 8
