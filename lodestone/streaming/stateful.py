"""Keyed state with expiry: each address of a stream once, up to a cap for the run, and alerts that fire once until they are armed again.

Both need the RocksDB state store (``session.session`` sets it).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions.urls import normal_url


class _FirstSeen(StatefulProcessor):
    """Lets the first row of a key pass, and then none until the key has not been let pass for ``ttl_ms``."""

    def __init__(self, ttl_ms: int | None):
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "seen boolean", self._ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = min((u for pdf in rows for u in pdf["url"]), default=None)
        if first is not None and not self._seen.exists():
            self._seen.update((True,))
            yield pd.DataFrame({"normal": [key[0]], "url": [first]})

    def close(self) -> None:
        pass


def unique_urls(stream: DataFrame, *, ttl_ms: int | None = None) -> DataFrame:
    """A stream of addresses (url) -> (normal, url): each address, by its normal form, once within ``ttl_ms`` (ever, without one).

    State is a mark for each address, which expires. Of a batch's spellings the least comes out. Null addresses and those
    without a host are left out.
    """
    keyed = stream.select("url", normal_url(F.col("url")).alias("normal")).where("normal rlike '^https://[^/]'")
    clock = "None" if ttl_ms is None else "ProcessingTime"
    return keyed.groupBy("normal").transformWithStateInPandas(_FirstSeen(ttl_ms), "normal string, url string", "Append", clock)


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def collected(spark, path: str) -> DataFrame:
    """What discover() has written so far: normal, url, batch."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "normal string, url string, batch long")
    return spark.read.schema("normal string, url string, batch long").parquet(path)


def discover(stream: DataFrame, path: str, checkpoint: str, *, most: int = 0, ttl_ms: int | None = None, poll_s: float = 0.5) -> int:
    """Write each address of a stream once to ``path`` and stop at ``most`` (0: no limit); returns how many there are.

    Each micro-batch has a folder of its own and is written again, not added, when it is replayed, and takes only what the batches before it
    left of the limit, in the order of the addresses. Once that is used up the query is stopped, so that the rest of the input is not read.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        found = batch
        if most:
            before = collected(spark, path).where(F.col("batch") < n).count()
            room = max(0, most - before)
            # Without room the batch is computed all the same, as its state has to be committed: a limit of zero would be optimised away.
            found = batch.orderBy("normal").limit(max(1, room)).where(F.monotonically_increasing_id() < room)
        found.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={n}")

    query = (
        unique_urls(stream, ttl_ms=ttl_ms).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    while not query.awaitTermination(poll_s):
        # With an expiry the query would go on with empty batches, to see what expires.
        done = ttl_ms is not None and query.lastProgress is not None and query.lastProgress["numInputRows"] == 0
        if done or (most and collected(spark, path).count() >= most):
            # A batch that this interrupts is not committed, and is made again if the query is started again.
            with contextlib.suppress(StreamingQueryException):
                query.stop()
            break
    return collected(spark, path).count()


class _Alerts(StatefulProcessor):
    """For each alert of a product its target, whether it is armed, and since when."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._alerts = handle.getMapState("alerts", "alert_id long", "target long, armed boolean, since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {k[0]: tuple(v) for k, v in self._alerts.iterator()} if self._alerts.exists() else {}
        fired, changed = [], set()
        for r in pd.concat(list(rows)).sort_values(["at", "kind", "alert_id", "amount"], ascending=[True, False, True, True]).itertuples(index=False):
            if r.kind == "target":
                i = int(r.alert_id)
                if i not in known or r.at >= known[i][2]:  # an older order does not undo a newer one
                    known[i] = (int(r.amount) if pd.notna(r.amount) else -1, bool(pd.notna(r.amount)), int(r.at))
                    changed.add(i)
                continue
            for i, (target, armed, since) in known.items():
                if armed and r.at >= since and r.amount <= target:
                    known[i] = (target, False, since)
                    changed.add(i)
                    fired.append((i, key[0], int(r.amount), int(r.at)))
        for i in changed:
            self._alerts.updateValue((i,), known[i])
        yield pd.DataFrame(fired, columns=["alert_id", "product_id", "price", "at"])

    def close(self) -> None:
        pass


def fired_once(events: DataFrame) -> DataFrame:
    """A stream of orders and prices -> (alert_id, product_id, price, at): an armed alert fires at the first price at or under its target.

    Events: kind ('target' or 'price'), product_id, alert_id (of targets), amount, at (microseconds). A target arms its alert, again too; one
    without an amount takes it back. A price fires only alerts that were armed before it, so that late prices fire nothing that was
    ordered after them. A fired alert stays fired, however far the stream has gone, until it is armed again. State grows with
    the alerts, not with the prices. Rows of a batch are taken in the order of their time, targets first.
    """
    rows = events.where("product_id is not null and at is not null").select("kind", "product_id", "alert_id", "amount", "at")
    shape = "alert_id long, product_id long, price long, at long"
    return rows.groupBy("product_id").transformWithStateInPandas(_Alerts(), shape, "Append", "None")
