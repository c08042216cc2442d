"""A stream gives what the table gives, and the final prefix only grows."""

from lagweave.operators.signals import table
from lagweave.streaming import windows

DATA = "/root/testdata/sf0.001"


def test_tumbling_stream_is_the_batch(spark, tmp_path):
    events = table(spark, DATA, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, late="30 days").writeStream.outputMode("update").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r["start"]: r["c"] for r in sorted(spark.table("tumbled").collect(), key=lambda r: r["c"])}
    assert got == {r["start"]: r["c"] for r in windows.tumbling(events).collect()}


def test_final_prefix(spark, tmp_path):
    for k, rows in enumerate([[(1, 10, 5), (2, 0, 4)], [(1, 0, 10)], [(1, 15, 1), (2, 8, 4)]]):
        spark.createDataFrame(rows, "signal long, start long, count long").coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema("signal long, start long, count long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = windows.final_prefix(stream).writeStream.outputMode("update").format("memory").queryName("finals").trigger(availableNow=True).start()
    q.awaitTermination(90)
    best = {}
    for r in spark.table("finals").collect():
        best[r["signal"]] = max(best.get(r["signal"], 0), r["final"])
    assert best == {1: 16, 2: 4}
