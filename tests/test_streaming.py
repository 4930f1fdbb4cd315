"""The stream's level changes equal the batch's."""

from depthweave.operators import levels
from depthweave.operators.lifecycle import lifecycle
from depthweave.sources.synthetic import SCHEMA, hostile_rows
from depthweave.streaming.book import stream_applied, stream_levels


def test_stream_equals_batch(spark, tmp_path):
    feed = spark.createDataFrame(hostile_rows(300, 5), SCHEMA)
    for i in range(3):
        feed.where(f"seq div 100 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = stream_levels(source).writeStream.format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.seq, r.locate, r.side, r.price, r.qty_after) for r in spark.table("levels").where("side is not null").collect())
    want = sorted((r.seq, r.locate, r.side, r.price, r.qty_after) for r in levels.level_series(lifecycle(feed)).collect())
    assert got == want


def test_stream_applies_each_message_once(spark, tmp_path):
    spark.createDataFrame([("s", 1), ("s", 1), ("s", 2)], "session string, msg_seq long").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("session string, msg_seq long").parquet(str(tmp_path / "in"))
    q = stream_applied(source).writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
