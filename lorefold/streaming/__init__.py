"""Structured Streaming forms of the incremental jobs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorefold.operators.documents import document_chunks
from lorefold.operators.index import reindex_run, with_metadata
from lorefold.operators.registry import insert_new, last_wins, sync
from lorefold.sources.tables import TableSet


def audit_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by event type and tumbling window of a stream of events (ts, event_type)."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def once_each(rows: DataFrame, key: str, table: str, checkpoint: str):
    """A stream's rows appended to a Parquet table, each key once over the life of the table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = insert_new(spark.read.parquet(table), fresh, key)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(table)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def budget(requests: DataFrame, most: int, window_s: int) -> DataFrame:
    """A stream of requests (user_id, event_id, ts) with accepted and retry_after, as operators.answers.budget says of a batch.

    The state of a user holds the times accepted within the window: most at the most. Requests of one batch are taken in time order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ok, wait = [], []
        for t in rows["ts"]:
            now = t.timestamp()
            held = [h for h in held if h >= now - window_s]
            ok.append(len(held) < most)
            wait.append(0 if ok[-1] else max(1, math.ceil(held[0] + window_s - now)))
            if ok[-1]:
                held.append(now)
        state.update((held,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "accepted": ok, "retry_after": wait})

    schema = "user_id long, event_id long, ts timestamp, accepted boolean, retry_after long"
    rows = requests.select("user_id", "event_id", "ts")
    return rows.groupBy("user_id").applyInPandasWithState(run, schema, "held array<double>", "append", GroupStateTimeout.NoTimeout)


DECISION = "user_id long, event_id long, ts timestamp, accepted boolean, retry_after long"


class _TimedBudget(StatefulProcessor):
    """Requests wait until the watermark has passed them, are then decided in time order, and a user's state goes when its window is over."""

    def __init__(self, most: int, window_s: int) -> None:
        self.most, self.window = most, window_s * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, at long")
        self.held = handle.getListState("held", "at long")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(e), int(t)) for b in rows for e, t in zip(b["event_id"], b["at"], strict=True)]
        self.waiting.appendList(new)
        for at in {t // 1000 + 1 for _, t in new}:  # microseconds to the next millisecond
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(((t, e) for e, t in self.waiting.get()), key=lambda x: x)
        ready = [x for x in waiting if x[0] <= passed]
        held, out = [h[0] for h in self.held.get()], []
        for t, e in ready:
            held = [h for h in held if h >= t - self.window]
            ok = len(held) < self.most
            out.append((key[0], e, pd.Timestamp(t, unit="us"), ok, 0 if ok else max(1, -(-(held[0] + self.window - t) // 1_000_000))))
            if ok:
                held.append(t)
        held = [h for h in held if h >= passed - self.window]  # no later request can be before the watermark
        rest = waiting[len(ready) :]
        if rest:
            self.waiting.put([(e, t) for t, e in rest])
        else:
            self.waiting.clear()
        if held:
            self.held.put([(h,) for h in held])
            self.handle.registerTimer((held[-1] + self.window) // 1000 + 1)
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "accepted", "retry_after"])

    def close(self) -> None:
        pass


def timed_budget(requests: DataFrame, most: int, window_s: int, late: str = "1 minute") -> DataFrame:
    """A stream of requests (user_id, event_id, ts), in any order within late, with accepted and retry_after, as operators.answers.budget says of a batch.

    A request is decided once the watermark has passed it; later ones are dropped. A user's state is dropped by a timer once its window is
    over. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = requests.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ts").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(_TimedBudget(most, window_s), DECISION, "append", "eventTime")


def once_each_indexed(rows: DataFrame, tables: TableSet, name: str, checkpoint: str):
    """A stream's rows added to a table of tables, each key (tables.keys) once over its life: a batch reads the buckets of its own keys only.

    A batch's rows are added under its number, so that a batch that runs again adds nothing.
    """
    key = tables.keys[name]

    def write(batch: DataFrame, batch_id: int) -> None:
        if f"batch-{batch_id}" in tables.manifest()["runs"]:
            return
        batch.persist()
        fresh = batch.dropDuplicates([key])
        buckets = tables.touched(fresh, key)
        tables.commit(f"batch-{batch_id}", {name: insert_new(tables.read(name, buckets), fresh, key)}, buckets, add=True)
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def content_index(contents: DataFrame, metadata: DataFrame, tables: TableSet, checkpoint: str, now: Column, **sizes: int):
    """A stream of contents (slug, text): texts that are new for their document are hashed, chunked and put into the stored indexes.

    metadata: documents of index.with_metadata, read anew for each batch; tables: dense, keyword and registry as index.reindex_run has them, and known (slug,
    version_hash). Texts that are known are skipped; what a batch does is put in place at once, under its number.
    """
    keys = ["slug", "version_hash"]

    def write(batch: DataFrame, batch_id: int) -> None:
        run = f"contents-{batch_id}"
        if run in tables.manifest()["runs"]:
            return
        rows = batch.select("slug", F.coalesce("text", F.lit("")).alias("text")).withColumn("version_hash", F.sha2("text", 256)).dropDuplicates(keys)
        rows = rows.join(tables.read("known", tables.touched(rows)).hint("merge"), keys, "left_anti").persist()
        chunks = document_chunks(rows.select(F.col("slug").alias("doc_id"), "text", "version_hash"), **sizes).withColumn("slug", F.col("doc_id"))
        version = F.split_part("chunk_id", F.lit(":"), F.lit(-2))
        made = with_metadata(chunks.withColumn("version_hash", version), metadata)
        reindex_run(tables, run, made, rows.select(*keys), rows.select("slug").where("false"), now, known=rows.select(*keys))
        rows.unpersist()

    return contents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _before(spark, path: str, batch_id: int) -> DataFrame | None:
    """The table that the batch before has written, if there is one."""
    return spark.read.parquet(f"{path}/batch={batch_id - 1}") if batch_id else None


def registry_sync(feeds: DataFrame, path: str, checkpoint: str, now: Column, order: str = "changed_at"):
    """A stream of feed rows (slug, status, changed_at): each batch is one snapshot, synced with the registry of the batch before.

    Batch n writes the whole registry to path/batch=n, so that a batch that runs again writes the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        feed = last_wins(batch.select("slug", "status", "changed_at"), "slug", order).select("slug", "status", "changed_at")
        old = _before(spark, path, batch_id)
        if old is None:
            schema = "slug string, status string, lifecycle_state string, changed_at timestamp, first_seen_at timestamp, last_seen_at timestamp"
            old = spark.createDataFrame([], schema)
        sync(old.drop("change_type"), feed, now).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return feeds.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def content_chunks(contents: DataFrame, path: str, checkpoint: str, **sizes: int):
    """A stream of contents (doc_id, text): texts that are new for their document are hashed and chunked, the others skipped.

    Batch n writes path/chunks/batch=n and path/known/batch=n: all (doc_id, version_hash) so far.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("version_hash")).dropDuplicates(["doc_id", "version_hash"])
        known = _before(batch.sparkSession, f"{path}/known", batch_id)
        keys = ["doc_id", "version_hash"]
        fresh = rows if known is None else rows.join(known.hint("merge"), keys, "left_anti")
        document_chunks(fresh, **sizes).write.mode("overwrite").parquet(f"{path}/chunks/batch={batch_id}")
        seen = fresh.select(*keys) if known is None else known.select(*keys).union(fresh.select(*keys))
        seen.write.mode("overwrite").parquet(f"{path}/known/batch={batch_id}")

    return contents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
