"""The message stages as streams: processing, reporting, dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extraction import processed, record_rows
from ..operators.records import changes
from .streams import DEAD_MOST, STREAM_MOST, each_batch, numbered, put, removed, split_batch


def audited(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """The records of some pages with change_type against the stored ones (url,
    identity_hash, content_hash, first_seen)."""
    rows = record_rows(processed(pages)).withColumns({"identity_hash": F.col("content_hash"), "first_seen": F.current_timestamp()})
    return changes(rows, stored, "url")


def discoveries(records: DataFrame) -> DataFrame:
    """(url, new_count, updated_count) of the pages with a new or changed record."""
    counted = records.groupBy("url").agg(
        F.count_if(F.col("change_type") == "NEW").alias("new_count"), F.count_if(F.col("change_type") == "UPDATED").alias("updated_count")
    )
    return counted.where("new_count > 0 or updated_count > 0")


def process(stream: DataFrame, stored: Callable[[], DataFrame], records_path: str, events_path: str) -> None:
    """Extracts, audits and stores each micro-batch of pages, and leaves an event
    for each page with something new.

    Files carry the batch's number, so that a batch that is run again after a
    failure replaces what it wrote.
    """

    def act(batch: DataFrame, number: int) -> None:
        audited(batch, stored()).write.mode("overwrite").parquet(f"{records_path}/batch={number}")
        written = batch.sparkSession.read.parquet(f"{records_path}/batch={number}")
        discoveries(written).write.mode("overwrite").parquet(f"{events_path}/batch={number}")

    each_batch(stream, act)


def report(stream: DataFrame, channels: dict[str, Callable[[DataFrame, int], None]], ledger: str) -> None:
    """Gives each micro-batch of events to every channel, once to each.

    `ledger` is a folder that keeps which channel took which batch, and the
    batches that a channel has still to take: those are offered to it again,
    in order, before a later one is, at each batch and by `caught_up`. So a
    channel that is away holds up no other, loses nothing and gets nothing
    twice; only a crash between delivery and its entry repeats a delivery, with
    the same number. If all channels fail the batch fails and is given again.
    """

    def act(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting = [name for name in channels if number not in numbered(spark, f"{ledger}/taken/{name}")]
        for name in waiting:
            if number not in numbered(spark, f"{ledger}/waiting/{name}"):
                batch.write.mode("overwrite").parquet(f"{ledger}/waiting/{name}/batch={number}")
        failed = caught_up(spark, {name: channels[name] for name in waiting}, ledger)
        if failed and len(failed) == len(channels):
            raise RuntimeError(f"all channels failed for batch {number}: {failed}")

    each_batch(stream, act, f"{ledger}/checkpoint")


def caught_up(spark: SparkSession, channels: dict[str, Callable[[DataFrame, int], None]], ledger: str) -> dict[str, Exception]:
    """Offers each channel what it has still to take; the channels that failed, and how."""
    failed: dict[str, Exception] = {}
    for name, deliver in channels.items():
        for number in numbered(spark, f"{ledger}/waiting/{name}"):
            own = f"{ledger}/waiting/{name}/batch={number}"
            if number not in numbered(spark, f"{ledger}/taken/{name}"):
                try:
                    deliver(spark.read.parquet(own), number)
                except Exception as e:  # any failure of a channel counts the same
                    failed[name] = e
                    break
                spark.range(1).write.mode("overwrite").parquet(f"{ledger}/taken/{name}/batch={number}")
            removed(spark, own)
    return failed


def consume(stream: DataFrame, failed: Column, done_path: str, retry_path: str, dead_path: str) -> None:
    """Sorts each micro-batch of raw messages into those done, to be tried again,
    and dead, each in a folder of its own by the batch's number. The streams of
    messages and of dead letters keep their newest entries."""

    def act(batch: DataFrame, number: int) -> None:
        done, retry, dead = split_batch(batch, failed)
        done.write.mode("overwrite").parquet(f"{done_path}/batch={number}")
        put(retry, retry_path, number, STREAM_MOST)
        put(dead, dead_path, number, DEAD_MOST)

    each_batch(stream, act)
