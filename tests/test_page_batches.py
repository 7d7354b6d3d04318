"""Pages reach Python a few megabytes at a time, whatever a task holds."""

import __spark_entry__ as entry
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name", ["extract_articles", "prompt_pages"])
def test_pages_go_in_small_batches(spark, name):
    spark.conf.unset(SETTING)
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    pages = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("html"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["id"])

    assert max(r.id for r in pages.mapInArrow(sizes, "id long").collect()) < 6_000_000
