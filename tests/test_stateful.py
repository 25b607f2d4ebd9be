"""Streams with keyed state, and the ledger of versions."""

import random
import threading
import time

import pytest

from pyspark.sql import functions as F

from lodestone.functions.urls import normal_url
from lodestone.sources.ledger import Ledger, audit
from lodestone.streaming import stateful

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, old)


def files(spark, at, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def test_addresses_once_up_to_a_cap(rocks, tmp_path):
    rng = random.Random(1)
    spell = lambda i: rng.choice([f"https://Shop.example/p/{i}", f"http://shop.example:80/p/{i}/?utm_source=x", f"https://shop.example/p/{i}#a"])
    parts = [[(spell(rng.randrange(30)),) for _ in range(20)] + [(None,), ("nonsense",)] for _ in range(3)]
    stream = files(rocks, str(tmp_path / "in"), parts[:2], "url string")
    at, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    n = stateful.discover(stream, at, cp)
    files(rocks, str(tmp_path / "in"), parts[2:], "url string")  # the query starts again from its checkpoint
    m = stateful.discover(rocks.readStream.schema("url string").parquet(str(tmp_path / "in")), at, cp)
    batch = rocks.read.parquet(str(tmp_path / "in")).select(normal_url(F.col("url")).alias("normal")).where("normal rlike '^https://[^/]'").distinct()
    got = [r["normal"] for r in stateful.collected(rocks, at).collect()]
    assert sorted(got) == sorted(r["normal"] for r in batch.collect()) and len(got) == m >= n and n == len({normal for normal in got[:n]})
    again = stateful.discover(stream, str(tmp_path / "ttl"), str(tmp_path / "cp3"), ttl_ms=3_600_000)
    assert again == m and stateful.collected(rocks, str(tmp_path / "ttl")).select("normal").distinct().count() == m
    few = stateful.discover(stream, str(tmp_path / "few"), str(tmp_path / "cp2"), most=7)
    assert few == 7 == stateful.collected(rocks, str(tmp_path / "few")).count()


def brute_alerts(events):
    known, fired = {}, []
    for kind, product, alert, amount, at in events:
        if kind == "target":
            if alert not in known or at >= known[alert][3]:
                known[alert] = [product, amount, amount is not None, at]
        else:
            for i, a in known.items():
                if a[0] == product and a[2] and at >= a[3] and amount <= a[1]:
                    a[2] = False
                    fired.append((i, product, amount, at))
    return sorted(fired)


def test_alerts_fire_once(rocks, tmp_path):
    """Prices keep falling, time goes far, a late price comes, an alert is armed again, one is taken back."""
    day = 86_400_000_000
    parts = [
        [("target", 1, 10, 100, 0), ("target", 1, 11, 50, 0), ("target", 2, 12, 100, 0), ("price", 1, None, 120, 1 * day), ("price", 1, None, 99, 2 * day), ("price", 1, None, 98, 3 * day)],
        [("price", 1, None, 97, 400 * day), ("price", 2, None, 100, 401 * day), ("target", 2, 12, None, 402 * day)],
        [("target", 1, 10, 97, 500 * day), ("price", 1, None, 90, 450 * day), ("price", 2, None, 1, 501 * day)],
        [("price", 1, None, 96, 501 * day), ("price", 1, None, 40, 502 * day), ("target", 1, 11, 60, 1 * day)],
    ]
    stream = files(rocks, str(tmp_path / "in"), parts, "kind string, product_id long, alert_id long, amount long, at long")
    q = stateful.fired_once(stream).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted(tuple(r) for r in rocks.table("fired").collect())
    order = [e for p in parts for e in sorted(p, key=lambda e: (e[4], e[0] == "price"))]
    assert got == brute_alerts(order) == [(10, 1, 96, 501 * day), (10, 1, 99, 2 * day), (11, 1, 40, 502 * day), (12, 2, 100, 401 * day)]


def test_ledger(spark, tmp_path):
    table = Ledger(spark, f"file://{tmp_path}/table")
    assert table.latest() == 0
    with pytest.raises(ValueError):
        table.read()
    add = lambda k: lambda old: spark.range(1).select(F.lit(k).alias("k")).unionByName(old if old is not None else spark.createDataFrame([], "k int"))
    assert [table.update(add(i)) for i in range(2)] == [1, 2]
    errors = []

    def many(start):
        try:
            for i in range(3):
                Ledger(spark, f"file://{tmp_path}/table").update(add(start + i))
        except Exception as e:  # seen by the main thread
            errors.append(e)

    threads = [threading.Thread(target=many, args=(s,)) for s in (10, 20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and table.latest() == 8 and sorted(r["k"] for r in table.read().collect()) == [0, 1, 10, 11, 12, 20, 21, 22]
    assert sorted(r["k"] for r in table.read(2).collect()) == [0, 1]


def test_ledger_counts_a_batch_once_and_takes_no_clock(spark, tmp_path, monkeypatch):
    table = Ledger(spark, f"file://{tmp_path}/table", stale_s=0.2)
    write = table.writer_of("stream", lambda old, batch: batch if old is None else old.unionByName(batch))
    rows = spark.range(3)
    write(rows, 0)
    write(rows, 1)
    monkeypatch.setattr(time, "time", lambda: 0.0)  # a clock that went back
    assert write(rows, 1) == 2 and table.read().count() == 6 and write(rows, 2) == 3 and table.read().count() == 9
    monkeypatch.undo()
    open(f"{tmp_path}/table/log/{4:020d}.json", "w").close()  # a writer that was lost before it filled its entry
    assert table.latest() == 3 and table.read().count() == 9
    assert write(rows, 3) == 5 and table.read().count() == 12
    assert table.vacuum(keep=1, older_s=3600) == 0 and table.vacuum(keep=1, older_s=0) == 3 and table.read().count() == 12


def test_audit_never_blocks(spark, tmp_path):
    (tmp_path / "file").write_text("not a folder")
    rows = spark.createDataFrame([(1, "ask")], "offer_id long, action string")
    assert audit(rows, f"{tmp_path}/audit", "action") and not audit(rows, f"{tmp_path}/file/below")
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 1
