"""Streaming operators against their batch forms."""

from datetime import datetime, timedelta

from lodestone.operators import prices
from lodestone.streaming import changes


def test_price_changes_equal_batch(spark, tmp_path):
    rows = [(p, s, (p * 7 + s * 3 + d // 2) % 4 * 100, datetime(2024, 1, 1) + timedelta(days=d)) for p in range(5) for s in range(3) for d in range(12)]
    schema = "product_id long, store_id long, price long, observed_at timestamp_ntz"
    for i in range(3):
        part = [r for r in rows if r[3].day % 12 in range(4 * i, 4 * i + 4)]
        spark.createDataFrame(sorted(part, key=lambda r: r[3]), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    from pyspark.sql import functions as F

    want = prices.changes(batch.withColumns({"order_id": F.lit(0), "line_no": F.lit(0)})).select("product_id", "store_id", "price", "observed_at").collect()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = changes.price_changes(stream).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("changed").select("product_id", "store_id", "price", "observed_at").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_tumbling_stream(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i), i % 3, "view" if i % 2 else "click", float(i)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "in"))
    events = spark.read.parquet(str(tmp_path / "in"))
    want = changes.tumbling(events, "1 hour").collect()
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = changes.tumbling(stream, "1 hour", late="10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, want))
    assert changes.sessions(events, "10 minutes").count() > 0
