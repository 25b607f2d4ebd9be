"""Change capture, alerts, windows and merges over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def price_changes(observations: DataFrame) -> DataFrame:
    """A stream of (product_id, store_id, price, observed_at) -> the first price of each offer and each that differs from the one before.

    State is one price and moment for each offer. Rows of a batch are taken in order of time; a row older than the offer's last one is left out.
    """
    schema = "product_id long, store_id long, price long, previous long, observed_at timestamp_ntz"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price, at = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values(["observed_at", "price"]).itertuples(index=False):
            if at is not None and r.observed_at < pd.Timestamp(at):
                continue
            if r.price != price:
                out.append((*key, r.price, price, r.observed_at))
            price, at = int(r.price), str(r.observed_at)
        if price is not None:
            state.update((price, at))
        yield pd.DataFrame(out, columns=["product_id", "store_id", "price", "previous", "observed_at"]).astype({"previous": "Int64"})

    return observations.groupBy("product_id", "store_id").applyInPandasWithState(step, schema, "price long, at string", "append", GroupStateTimeout.NoTimeout)


def fired_alerts(observations: DataFrame, targets: DataFrame) -> DataFrame:
    """A table of observations against a table of targets: each alert that has fired, with one of its prices. For streams, and alerts that are armed again, there is stateful.fired_once."""
    if observations.isStreaming:
        raise ValueError("a stream needs state for its alerts: use stateful.fired_once")
    return observations.join(targets, "product_id").where("price <= target").dropDuplicates(["alert_id"])


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Counts and sums per window and event type; with ``late``, rows later than that are dropped in a stream."""
    timed = events.withWatermark("ts", late) if late else events
    w = timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of a user, closed by a gap."""
    s = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_batches(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], merge: Callable[[DataFrame, DataFrame], DataFrame]):
    """A writer that merges each micro-batch into a snapshot: ``write`` gets the merged frame and the batch's number, and must put it under a new place before ``read`` returns that."""
    return stream.writeStream.foreachBatch(lambda batch, n: write(merge(read(), batch), n)).outputMode("append")
