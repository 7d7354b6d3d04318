"""Stages with state of their own: URLs seen of late, and the outbox relay.

State is kept by key in RocksDB and goes by timers, so that it does not grow
with all that ever was.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .streams import MAX_RETRIES, routed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys over which the URLs of all crawl trees are dealt, and steps of the time that a URL is kept in which it is forgotten.
PARTS, STEPS = 4096, 8
#: The relay, fixed values: seconds between polls, first delay of a retry, failed polls that open the breaker, seconds that it stays open.
POLL, FIRST_DELAY, TRIPS, PAUSE = 2.0, 1.0, 5, 30.0
#: How long a delivered or failed event is remembered, so that it is not sent again.
REMEMBERED_MS = 24 * 3600 * 1000


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state needs."""
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was)


def _sorted(parts: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class _Seen(StatefulProcessor):
    """Lets a URL through that its tree has not had within the time; each sight counts anew.

    A key holds many URLs of many trees: what a batch says of one is read and
    written once. Timers go by whole steps, a few for each key, and clear what
    is due by then; that a sight is too old is seen without them.
    """

    def __init__(self, root: str, root_kind: str, url: str, url_kind: str, at: str, kept_ms: int) -> None:
        self.root, self.url, self.at, self.kept = root, url, at, kept_ms
        self.shape = f"root {root_kind}, url {url_kind}"
        self.step = max(1, kept_ms // STEPS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", self.shape, "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = _sorted(rows, [self.at, self.url])
        millis = part[self.at].astype("datetime64[ns]").astype("int64") // 1_000_000
        known: dict[tuple, int | None] = {}
        changed, due, out = set(), set(), []
        for i, (root, url, now) in enumerate(zip(part[self.root].tolist(), part[self.url].tolist(), millis.tolist(), strict=True)):
            own = (root, url)
            if own not in known:
                found = self.last.getValue(own)
                known[own] = None if found is None else found[0]
            before = known[own]
            if before is None or now - before >= self.kept:
                out.append(i)
            if before is None or now > before:
                known[own] = now
                changed.add(own)
        for own in changed:
            self.last.updateValue(own, (known[own],))
            due.add(-(-(known[own] + self.kept) // self.step) * self.step)
        for when in due:
            self.handle.registerTimer(when)
        if out:
            yield part.iloc[out][[self.root, self.url, self.at]].reset_index(drop=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        for own in [k for k, v in self.last.iterator() if v[0] + self.kept <= due]:
            self.last.removeKey(own)
        return iter(())

    def close(self) -> None:
        pass


def seen_of_late(stream: DataFrame, root: str, url: str, at: str, kept_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(root, url, at): the URLs of each crawl tree that it has not had for the
    time, as of event time; what was not seen for it is forgotten, an eighth of the time later at most. Rows more
    than `late` behind are dropped. All trees' URLs are dealt over PARTS keys."""
    kinds = dict(stream.dtypes)
    timed = stream.select(root, url, F.col(at).cast("timestamp").alias(at)).withWatermark(at, late)
    dealt = timed.where(F.col(root).isNotNull() & F.col(url).isNotNull() & F.col(at).isNotNull()).withColumn("part", F.pmod(F.xxhash64(root, url), PARTS).cast("int"))
    schema = f"{root} {kinds[root]}, {url} {kinds[url]}, {at} timestamp"
    return dealt.groupBy("part").transformWithStateInPandas(_Seen(root, kinds[root], url, kinds[url], at, kept_seconds * 1000), schema, "append", "eventTime")


#: What comes to the relay: events (new) and what came of sending them (ok, failed, held: not tried).
MESSAGES = "event_id string, stream string, kind string, attempt int, at timestamp"
ORDERS = "event_id string, stream string, action string, attempt int, at timestamp"


class _Delivery(StatefulProcessor):
    """Orders to send an event, again with growing delays after failures; delivered or failed at last, once."""

    def __init__(self, event_time: bool, first_delay: float) -> None:
        self.event_time, self.first_delay = event_time, first_delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("delivery", "stream string, status string, failures int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = self.state.get()
        was = (None, None, 0) if found is None else tuple(found)
        # plain lists: there are few rows a key
        part = [row for p in rows for row in zip(p["kind"].tolist(), p["at"].tolist(), p["stream"].tolist(), p["attempt"].tolist(), strict=True)]
        part.sort(key=lambda row: (found is None and row[0] != "new", row[1]))
        out, timer = [], None
        stream, status, failures = was
        now = timerValues.getCurrentProcessingTimeInMs() if not self.event_time else None
        for kind, when, to, attempt in part:
            at = when.value // 1_000_000 if now is None else now
            if status is None and kind == "new":
                stream, status, failures = to, "PENDING", 0
                out.append((key[0], stream, "send", 1, when))
            elif status != "PENDING" or kind == "new" or (not pd.isna(attempt) and attempt != failures + 1):
                continue  # known already
            elif kind == "ok":
                status, timer = "DELIVERED", at + REMEMBERED_MS
                out.append((key[0], stream, "delivered", failures + 1, when))
            elif kind == "held":
                timer = at + int(PAUSE * 1000)
            else:
                failures += 1
                if failures >= MAX_RETRIES:
                    status, timer = "FAILED", at + REMEMBERED_MS
                    out.append((key[0], stream, "failed", failures, when))
                else:  # doubled, and spread over half a second
                    timer = at + int(self.first_delay * 1000 * 2 ** (failures - 1)) + zlib.crc32(key[0].encode()) % 500
        if timer is not None:  # what a batch says last counts: an earlier retry of it is overtaken
            self.handle.registerTimer(timer)
        if status is not None and (stream, status, failures) != was:
            self.state.update((stream, status, failures))
        if out:
            yield pd.DataFrame(out, columns=["event_id", "stream", "action", "attempt", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        found = self.state.get()
        if found is not None:
            stream, status, failures = found
            if status == "PENDING":
                out.append((key[0], stream, "send", failures + 1, pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")))
            else:
                self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=["event_id", "stream", "action", "attempt", "at"])

    def close(self) -> None:
        pass


def deliveries(messages: DataFrame, event_time: bool = False, first_delay: float = FIRST_DELAY, late: str = "10 minutes") -> DataFrame:
    """Orders for a stream of MESSAGES: send (with the attempt's number), delivered, failed.

    An event comes into being with its first `new`; repeats of it, and results
    of an attempt that was counted or of an event that is done, change nothing.
    After MAX_RETRIES failures it has failed. Retries wait first_delay, then
    twice that, by the clock or by event time.
    """
    timed = messages.withWatermark("at", late) if event_time else messages
    keyed = timed.where("event_id is not null").groupBy("event_id")
    return keyed.transformWithStateInPandas(_Delivery(event_time, first_delay), ORDERS, "append", "eventTime" if event_time else "processingTime")


@dataclass
class Breaker:
    """Opens for PAUSE seconds after TRIPS failed polls in a row."""

    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    until: float = field(default=float("-inf"))

    @property
    def open(self) -> bool:
        return self.clock() < self.until

    def note(self, failed: bool) -> None:
        self.failures = self.failures + 1 if failed else 0
        if self.failures >= TRIPS:
            self.failures, self.until = 0, self.clock() + PAUSE


def relay(
    outbox: DataFrame, deliver: Callable[[DataFrame], DataFrame], folder: str, breaker: Breaker | None = None, poll: float = POLL, first_delay: float = FIRST_DELAY
) -> StreamingQuery:
    """Starts the relay of a stream of outbox rows (event_id, event_type, created_at).

    `deliver` gets the events of a poll (event_id, stream, attempt) and returns
    (event_id, ok); what it leaves out, and all of them if it raises, has
    failed. Results are written to `folder`/results, which the relay reads as a
    stream with the outbox; ends are in `folder`/ends (event_id, stream,
    action, attempt). A poll that is run again after a crash sends again, and
    its results count once. The query keeps its state below `folder`.
    """
    spark, breaker = outbox.sparkSession, breaker or Breaker()
    results = f"{folder}/results"
    spark.createDataFrame([], MESSAGES).write.mode("append").parquet(results)
    new = routed(outbox).select(F.col("event_id").cast("string").alias("event_id"), "stream", F.lit("new").alias("kind"), F.lit(None).cast("int").alias("attempt"), F.col("created_at").cast("timestamp").alias("at"))
    messages = new.unionByName(spark.readStream.schema(MESSAGES).parquet(results))

    def act(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/orders/batch={number}")
        orders = spark.read.schema(ORDERS).parquet(f"{folder}/orders/batch={number}")
        orders.where("action != 'send'").select("event_id", "stream", "action", "attempt").write.mode("overwrite").parquet(f"{folder}/ends/batch={number}")
        sends = orders.where("action = 'send'").select("event_id", "stream", "attempt")
        if sends.isEmpty():
            return
        kind = "held"
        if not breaker.open:
            try:
                told = sends.join(deliver(sends).select("event_id", "ok"), "event_id", "left")
                written = told_of(told, F.when(F.col("ok"), "ok").otherwise("failed"))
                breaker.note(written.where("kind = 'ok'").isEmpty())
                return
            except Exception:  # whatever stops a poll counts the same
                breaker.note(True)
                kind = "failed"
        told_of(sends, F.lit(kind))

    def told_of(rows: DataFrame, kind: Column) -> DataFrame:
        """The results, computed once: delivering is part of them."""
        once = f"{folder}/told/{uuid4().hex}"
        rows.select("event_id", "stream", kind.alias("kind"), "attempt", F.current_timestamp().alias("at")).write.parquet(once)
        known = spark.read.schema(MESSAGES).parquet(once)
        known.write.mode("append").parquet(results)
        return known

    with rocks(spark):
        writer = deliveries(messages, first_delay=first_delay).writeStream.foreachBatch(act).option("checkpointLocation", f"{folder}/checkpoint")
        return writer.trigger(processingTime=f"{poll} seconds").start()
