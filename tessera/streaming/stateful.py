"""Stateful streams: windowed dedup, fingerprints, access logs, sliding windows, follow-ups, leases, saturation.

Each operator takes a streaming (or, where it has no state of its own, batch) DataFrame with an event-time column ``ts``. Custom
state has an event-time timeout: a key's state goes once the watermark, ``late`` behind the newest event, shows that it cannot
change a result any more, so state is bounded by the keys of that span. Rows older than the watermark are dropped. Within a
micro-batch a key's rows are put in order of time, so they are held; the source's rate limit bounds a micro-batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tessera.functions.text import content_hash

WINDOW_SECONDS, CAPACITY, LATE, IDLE_SECONDS = 300, 4096, "10 minutes", 30 * 86_400
_MICRO = 1_000_000
#: The state store (spark.sql.streaming.stateStore.providerClass) that ``dedup_rolling`` needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(ts: pd.Timestamp) -> int:
    return ts.value // 1000


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _by_key(stream: DataFrame, key: str, step: Callable, out: str, state: str, mode: str) -> DataFrame:
    """``step(key, batches, state)`` gives rows, the new state, and the time (microseconds) from which on the state says nothing."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows, new, until = step(k, batches, held.get if held.exists else None)
        held.update(new)
        held.setTimeoutTimestamp(max(until // 1000 + 1, held.getCurrentWatermarkMs() + 1))
        yield rows

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {dict(stream.dtypes)[key]}, {out}", state, mode, GroupStateTimeout.EventTimeTimeout)


def dedup_within(stream: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Drops rows whose trimmed content came within the window; state goes with the watermark."""
    return _timed(stream.withColumn("content_hash", content_hash("content")), f"{seconds} seconds").dropDuplicatesWithinWatermark(["content_hash"])


def _rolling(seconds: int, capacity: int) -> type[StatefulProcessor]:
    """A key's rows wait until the watermark has passed them, so they are judged in the order of their time whatever batch they came in."""

    class Rolling(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "t long, hash string")
            self.seen = handle.getMapState("seen", "hash string", "place long")  # what counts as seen, and its place in the order of entry
            self.order = handle.getMapState("order", "place long", "t long, hash string")
            self.ends = handle.getValueState("ends", "first long, next long")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
            known = timerValues.getCurrentWatermarkInMs()
            new = [(_micros(ts), h) for part in rows for ts, h in zip(part["ts"], part["content_hash"], strict=True) if _micros(ts) // 1000 >= known]
            if new:
                self.waiting.appendList(new)
                self.handle.registerTimer(min(new)[0] // 1000 + 1)
            return iter(())

        def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
            due = [x for x in held if x[0] // 1000 < now]
            rest = held[len(due) :]
            if rest and due:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0] // 1000 + 1)
            elif held and not rest:
                self.waiting.clear()
            first, following = self.ends.get() if self.ends.exists() else (0, 0)
            out = []
            for t, h in due:
                while first < following:  # the oldest are first, and go when they are too old
                    at, old = self.order.getValue((first,))
                    if t - at <= seconds * _MICRO:
                        break
                    first = self._drop(first, old)
                fresh = not self.seen.containsKey((h,))
                if fresh:
                    self.seen.updateValue((h,), (following,))
                    self.order.updateValue((following,), (t, h))
                    following += 1
                    if following - first > capacity:
                        first = self._drop(first, self.order.getValue((first,))[1])
                out.append((*key, h, _time(t), fresh))
            if due:
                self.ends.update((first, following))
                self.handle.registerTimer(due[-1][0] // 1000 + seconds * 1000 + 2)  # by then all that is known has aged out
            elif not held and first < following and now > self.order.getValue((following - 1,))[0] // 1000 + seconds * 1000:
                for state in (self.seen, self.order, self.ends):
                    state.clear()
            if out:
                yield pd.DataFrame(out, columns=["key", "content_hash", "ts", "fresh"])

        def _drop(self, place: int, old: str) -> int:
            self.order.removeKey((place,))
            self.seen.removeKey((old,))
            return place + 1

        def close(self) -> None:
            pass

    return Rolling


def dedup_rolling(stream: DataFrame, key: str = "session_id", seconds: int = WINDOW_SECONDS, capacity: int = CAPACITY, late: str = LATE) -> DataFrame:
    """(key, content_hash, ts, fresh): the rolling rule for each key, in the order of time. A copy does not refresh its entry; an entry expires when it is
    older than ``seconds``; beyond ``capacity`` entries the oldest goes first.

    Rows come out once the watermark, ``late`` behind the newest event, has passed them; of rows of one time the lesser hash is first; rows that come behind the watermark are dropped; a null content is empty. So the result does not
    depend on how rows fall into micro-batches. Entries and waiting rows are kept apart in RocksDB, which the session must have for its state store, and go with their time.
    """
    hashed = _timed(stream.select(F.col(key).alias("key"), content_hash(F.coalesce("content", F.lit(""))).alias("content_hash"), "ts"), late)
    rows = hashed.groupBy("key").transformWithStateInPandas(_rolling(seconds, capacity)(), f"key {dict(hashed.dtypes)['key']}, content_hash string, ts timestamp, fresh boolean", "append", "eventTime")
    return rows.withColumnRenamed("key", key)


def dedup_fingerprint(stream: DataFrame, *columns: str) -> DataFrame:
    """A fingerprint passes once, for ever: exact, so its state holds every fingerprint and grows with them. Use ``dedup_within`` where a window will do."""
    return stream.dropDuplicates(list(columns))


def access_log(stream: DataFrame, last: int = 20, idle_seconds: int = IDLE_SECONDS, late: str = LATE) -> DataFrame:
    """(memory_id, n, last_at, n_recent): accesses, the latest of them, and how many of the last ``last`` are held; updated with every
    batch. A memory without access for ``idle_seconds`` begins anew."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], held):
        n, recent = held or (0, [])
        for batch in batches:
            times = [_micros(t) for t in batch["ts"]]
            n, recent = n + len(times), sorted(heapq.nlargest(last, [*recent, *times]))
        return pd.DataFrame([(*k, n, _time(recent[-1]), len(recent))], columns=["memory_id", "n", "last_at", "n_recent"]), (n, recent), recent[-1] + idle_seconds * _MICRO

    return _by_key(_timed(stream.select("memory_id", "ts"), late), "memory_id", step, "n long, last_at timestamp, n_recent int", "n long, recent array<long>", "update")


def sliding_counts(stream: DataFrame, window: str = "1 hour", slide: str = "10 minutes", late: str = LATE) -> DataFrame:
    """Events by type in sliding event-time windows."""
    return _timed(stream, late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def saturation_windows(stream: DataFrame, late: str = LATE) -> DataFrame:
    """By hour: messages, actions, blockers and their ratio."""
    w = _timed(stream, late).groupBy(F.window("ts", "1 hour"))
    g = w.agg(F.count_if(F.col("event_type") == "message").alias("messages"), F.count_if(F.col("event_type") == "action").alias("actions"), F.count_if(F.col("event_type") == "blocker").alias("blockers"))
    return g.select(F.col("window.start").alias("start"), "messages", "actions", "blockers", (F.col("messages") / F.greatest(F.lit(1), F.col("actions"))).alias("chatter"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions of an agent: events with no gap longer than ``gap``."""
    g = _timed(stream, late).groupBy(F.session_window("ts", gap), "agent_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("agent_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def leases(stream: DataFrame, ttl_seconds: int = 600, most_seconds: int = 3600, late: str = LATE) -> DataFrame:
    """(action_id, agent_id, ts, granted, expires_at): one holder at a time; its renewals pass, others' requests fail until it runs out."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], held):
        holder, until = held or (None, 0)
        rows, out = pd.concat(list(batches)).sort_values(["ts", "agent_id"]), []
        for agent, ts, wanted in zip(rows["agent_id"], rows["ts"], rows["ttl"], strict=True):
            t = _micros(ts)
            granted = holder is None or holder == agent or t > until
            if granted:
                holder, until = agent, t + int(min(wanted if wanted and wanted > 0 else ttl_seconds, most_seconds) * _MICRO)
            out.append((*k, agent, ts, granted, _time(until)))
        return pd.DataFrame(out, columns=["action_id", "agent_id", "ts", "granted", "expires_at"]), (holder, until), until

    asked = _timed(stream.select("action_id", "agent_id", "ts", F.col("ttl").cast("double").alias("ttl")), late)
    return _by_key(asked, "action_id", step, "agent_id string, ts timestamp, granted boolean, expires_at timestamp", "holder string, until long", "append")


def follow_ups(stream: DataFrame, within_seconds: int = 300, late: str = LATE) -> DataFrame:
    """(agent_id, ts, is_follow_up): a search soon after the agent's last one that shares no result with it."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], held):
        last, results = held or (None, [])
        out = []
        for t, ids in sorted((_micros(t), tuple(map(int, i))) for b in batches for t, i in zip(b["ts"], b["result_ids"], strict=True)):
            out.append((*k, _time(t), last is not None and t - last <= within_seconds * _MICRO and not set(ids) & set(results)))
            last, results = t, list(ids)
        return pd.DataFrame(out, columns=["agent_id", "ts", "is_follow_up"]), (last, results), last + within_seconds * _MICRO

    return _by_key(_timed(stream.select("agent_id", "ts", "result_ids"), late), "agent_id", step, "ts timestamp, is_follow_up boolean", "last long, results array<long>", "append")


def upsert_sink(stream: DataFrame, path: str, key: str, version: str, checkpoint: str):
    """Writes each micro-batch's last version of every key as a generation; readers take the greatest version. Replays overwrite their own generation."""
    from pyspark.sql import Window

    def write(batch: DataFrame, number: int) -> None:
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
        batch.withColumn("_p", place).where("_p = 1").drop("_p").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
