"""Streaming forms of the batch state machines: first seen, status, exclusion, health, reports.

Each takes a streaming DataFrame with an event-time column `ts` and returns one; the
caller starts the query. State is bounded by the watermark or by time-outs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(stream: DataFrame, *, keys=("source", "raw_id"), late: str = "7 days") -> DataFrame:
    """The first row of each key, once. Rows later than the watermark are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys)).withColumn("first_seen_at", F.col("ts"))


STATUS_SCHEMA = "source string, raw_id string, status string, on_sale_at timestamp, changed_at timestamp"


def _advance(status: str | None, on_sale_at, signal: str | None, signal_at, now):
    """The state after a signal, or after time alone."""
    if signal in ("SOLD_OUT", "REGISTRATION_CLOSED"):
        return "sold_out", None
    if signal == "IN_STOCK":
        return "on_sale", None
    if signal == "COMING_SOON":
        return "announced", signal_at if signal_at is not None else on_sale_at
    if status == "announced" and on_sale_at is not None and on_sale_at <= now:
        return "on_sale", None
    return status, on_sale_at


def status_changes(stream: DataFrame, *, late: str = "1 hour", idle_ms: int = 90 * 86_400_000) -> DataFrame:
    """(source, raw_id, status, on_sale_at, changed_at) whenever a listing's status changes.

    stream: source, raw_id, signal, on_sale_at, ts. An announced listing turns on_sale when
    its sale start passes in event time, without a row of its own. A key without rows for
    idle_ms beyond the watermark is forgotten.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, at = (state.get[0], state.get[1]) if state.exists else (None, None)
        at = None if at is None or pd.isna(at) else pd.Timestamp(at)
        out = []
        if state.hasTimedOut:
            now = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
            new, new_at = _advance(status, at, None, None, now)
            if (new, new_at) == (status, at):
                state.remove()
                return
            out.append((*key, new, new_at, now))
            status, at = new, new_at
        rows = [r for f in frames for r in f.itertuples(index=False)]
        for r in sorted(rows, key=lambda r: r.ts):
            given = None if pd.isna(r.on_sale_at) else r.on_sale_at
            new, new_at = _advance(status, at, r.signal, given, r.ts)
            if new is not None and (new, new_at) != (status, at):
                out.append((*key, new, new_at, r.ts))
            status, at = new, new_at
        if status is not None:
            state.update((status, None if at is None else at.to_pydatetime()))
            mark = state.getCurrentWatermarkMs()
            due = int(at.timestamp() * 1000) if at is not None and status == "announced" else mark + idle_ms
            state.setTimeoutTimestamp(max(due, mark + 1))
        if out:
            yield pd.DataFrame(out, columns=["source", "raw_id", "status", "on_sale_at", "changed_at"])

    return stream.withWatermark("ts", late).groupBy("source", "raw_id").applyInPandasWithState(
        step, STATUS_SCHEMA, "status string, on_sale_at timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def not_excluded(stream: DataFrame, excluded: DataFrame, *, ttl_days: float = 7, late: str = "1 hour") -> DataFrame:
    """Listings but for those that were excluded in the ttl_days before their ts; each comes once, however often it was.

    excluded: source, raw_id, checked_at. As a stream, it is joined by key and time: an
    exclusion counts from its checked_at on, whenever it comes, within the watermark, and
    its state goes when the watermark has passed its end; listings come once the watermark
    has passed them. As a table, it is read as it stands when the stream starts: one row
    a key with its times, and listings come at once.
    """
    ttl = F.make_dt_interval(secs=F.lit(ttl_days * 86_400))
    if not excluded.isStreaming:
        cache = excluded.groupBy("source", "raw_id").agg(F.collect_set("checked_at").alias("_checked"))
        young = F.exists("_checked", lambda at: (F.col("ts") >= at) & (F.col("ts") < at + ttl))
        return stream.join(cache, ["source", "raw_id"], "left").where(~F.coalesce(young, F.lit(False))).drop("_checked")
    cache = excluded.select(F.col("source").alias("_source"), F.col("raw_id").alias("_raw_id"), "checked_at").withWatermark("checked_at", late)
    same = (F.col("source") == F.col("_source")) & (F.col("raw_id") == F.col("_raw_id"))
    young = (F.col("ts") >= F.col("checked_at")) & (F.col("ts") < F.col("checked_at") + F.expr(f"interval {int(ttl_days * 86_400)} seconds"))
    hit = stream.withWatermark("ts", late).join(cache, same & young, "left")
    return hit.where("checked_at is null").drop("_source", "_raw_id", "checked_at")


HEALTH_SCHEMA = "source string, day timestamp, n long, status string, last_count long"


def daily_counts(stream: DataFrame, *, late: str = "1 day") -> DataFrame:
    """(source, day, n) of rows a source and day, once the day is over."""
    return stream.withWatermark("ts", late).groupBy("source", F.window("ts", "1 day")).agg(F.count_if(F.coalesce("present", F.lit(True))).alias("n")).select("source", F.col("window.start").alias("day"), "n")


def source_health(counts: DataFrame) -> DataFrame:
    """(source, day, n, status, last_count): a day of nothing after something is an anomaly, and stays one until rows come.

    counts: a stream of source, day, n, such as written by daily_counts.
    """

    def step(key, frames, state: GroupState):
        last = state.get[0] if state.exists else 0
        out = []
        for r in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.day):
            bad = r.n == 0 and last > 0
            last = last if bad else int(r.n)
            out.append((key[0], r.day, r.n, "anomaly" if bad else "ok", last))
        state.update((last,))
        yield pd.DataFrame(out, columns=["source", "day", "n", "status", "last_count"])

    return counts.groupBy("source").applyInPandasWithState(step, HEALTH_SCHEMA, "last long", "append", GroupStateTimeout.NoTimeout)


def write_reports(stream: DataFrame, path: str, checkpoint: str):
    """Start the report sink: accepted rows and quarantined rows are appended to two tables under path."""
    from marquee.sources.publish import report_rows

    def each(batch: DataFrame, number: int) -> None:
        for name, rows in zip(("accepted", "quarantined"), report_rows(batch)):
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
