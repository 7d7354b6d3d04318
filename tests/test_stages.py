"""Streams of the message stages, and files that people open."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import leads
from sievework.sources import readers, sinks
from sievework.streaming import stages, streams


@pytest.fixture
def pages(spark, tmp_path):
    html = "<html><body><article><h1>{0}</h1><p>" + "a text long enough to count as an article " * 2 + "</p></article></body></html>"
    rows = [(i, f"http://h{i % 2}.org/{i}", html.format(f"title {i}"), 200) for i in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string, status int").repartition(3).write.parquet(f"{tmp_path}/pages")
    return f"{tmp_path}/pages"


def test_processing_stores_records_and_leaves_events(spark, pages, tmp_path):
    stored = lambda: spark.createDataFrame([("http://h0.org/0", "x", "x", None)], "url string, identity_hash string, content_hash string, first_seen timestamp").withColumn("first_seen", F.current_timestamp())
    stream = streams.table_stream(spark, pages, 1)
    stages.process(stream, stored, f"{tmp_path}/records", f"{tmp_path}/events")
    records = {r.url: r.change_type for r in spark.read.parquet(f"{tmp_path}/records").collect()}
    assert records == {f"http://h{i % 2}.org/{i}": "UPDATED" if i == 0 else "NEW" for i in range(6)}
    events = spark.read.parquet(f"{tmp_path}/events")
    assert events.agg(F.sum("new_count"), F.sum("updated_count")).first()[:] == (5, 1)


def test_a_channel_that_was_away_gets_what_it_missed_once(spark, pages, tmp_path):
    got, away = {"file": [], "chat": []}, {"chat"}

    def channel(name):
        def deliver(batch, number):
            if name in away:
                raise OSError("away")
            got[name].append((number, sorted(r.page_id for r in batch.collect())))

        return deliver

    channels, ledger = {n: channel(n) for n in got}, f"{tmp_path}/ledger"
    stages.report(streams.table_stream(spark, pages, 1), channels, ledger)
    assert [n for n, _ in got["file"]] == [0, 1, 2] and not got["chat"]
    assert list(stages.caught_up(spark, channels, ledger)) == ["chat"]
    away.clear()
    spark.read.parquet(pages).limit(0).unionByName(spark.createDataFrame([(9, "u", "h", 200)], "page_id long, url string, html string, status int")).coalesce(1).write.mode("append").parquet(pages)
    stages.report(streams.table_stream(spark, pages, 1), channels, ledger)  # goes on where it was
    assert got["chat"] == got["file"] and [n for n, _ in got["file"]] == [0, 1, 2, 3]
    assert sorted(i for _, ids in got["chat"] for i in ids) == [0, 1, 2, 3, 4, 5, 9]
    assert stages.caught_up(spark, channels, ledger) == {} and len(got["chat"]) == 4


def test_a_batch_fails_if_all_channels_do_and_comes_again(spark, pages, tmp_path):
    seen, broken = [], [True]

    def chat(batch, number):
        if broken[0]:
            raise OSError("away")
        seen.append((number, batch.count()))

    with pytest.raises(Exception, match="all channels failed"):
        stages.report(streams.table_stream(spark, pages), {"chat": chat}, f"{tmp_path}/ledger")
    broken[0] = False
    stages.report(streams.table_stream(spark, pages), {"chat": chat}, f"{tmp_path}/ledger")
    assert seen == [(0, 6)]


def test_streams_let_their_oldest_batches_go(spark, tmp_path):
    for number in range(5):
        streams.put(spark.range(10), f"{tmp_path}/dead", number, 25)
    streams.put(spark.range(10), f"{tmp_path}/dead", 4, 25)  # again after a failure
    assert streams.numbered(spark, f"{tmp_path}/dead") == [2, 3, 4]
    assert streams.numbered(spark, f"{tmp_path}/none") == []


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, "β", None), (1, "a\nb", 1.5)], "record_id long, name string, x double")
    sinks.write_json_array(rows, f"{tmp_path}/array")
    text = "".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*.txt")))
    assert json.loads(text) == [{"record_id": 1, "name": "a\nb", "x": 1.5}, {"record_id": 2, "name": "β", "x": None}]
    assert text.startswith("[\n  {") and "β" in text
    sinks.write_marked_csv(spark.createDataFrame([("Περαία", "x")], "`Περιοχή` string, name string"), f"{tmp_path}/leads")
    parts = [p.read_bytes() for p in (tmp_path / "leads").glob("part-*.csv")]
    assert any(p.startswith("﻿Περιοχή,name\nΠεραία,x".encode()) for p in parts)


def test_result_pages(spark):
    html = '<div class="result"></div><div class="result"><a class="result__a" href="/x">A <b>b</b></a></div><div class="result"><a class="result__a">no link</a></div><div class="result"><a class="result__a" href="/y">Y</a><p class="result__snippet"> s </p></div>'
    got = readers.result_hits(spark.createDataFrame([(1, html), (2, None)], "q int, html string")).collect()
    assert [(r.q, r.rank, r.url, r.title, r.snippet) for r in got] == [(1, 1, "/x", "Ab", ""), (1, 3, "/y", "Y", "s")]


def test_address_tokens(spark):
    one = lambda q: spark.createDataFrame([(q,)], "q string").select(leads.address_tokens(F.col("q"))).first()[0]
    assert one("Νέα Μηχανιώνα Θεσσαλονίκης") == ["νεα μηχανιωνα", "ν. μηχανιωνα"]
    assert one("Thessaloniki Greece") == ["thessaloniki greece", "t. greece"] and one("Greece") == ["greece"] and one("  ") == []
