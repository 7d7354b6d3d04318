"""Pages that share a URL count once each."""

import duckdb

import __spark_entry__ as entry


def test_changes_of_pages_that_share_a_url(spark, tmp_path):
    body = "<html><body><article><h1>Title</h1><p>" + "word " * 20 + "</p></article></body></html>"
    rows = [(0, "http://a/1", body), (1, "http://a/1", body), (2, "http://a/1", body), (3, "http://a/2", body), (4, "http://a/3", body), (6, None, body), (7, None, body)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()["processed_changes"](spark, str(tmp_path))
    assert {r.change_type: r.n for r in got.collect()} == {"NEW": 3, "UPDATED": 4}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert dict(db.execute(entry.oracle_sql()["processed_changes"]).fetchall()) == {"NEW": 3, "UPDATED": 4}
