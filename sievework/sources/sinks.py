"""Sinks: record files in several formats, reports, and content-addressed artifacts."""

from __future__ import annotations

import json
import re
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_COLUMNS = ("record_id", "record_type", "source_url", "canonical_url", "change_type")
ILLEGAL = re.compile("[^\x09\x0a\x0d\x20-퟿-�\U00010000-\U0010ffff]")


def write_jsonl(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def flattened(records: DataFrame) -> DataFrame:
    """Complex columns as JSON text, for flat files."""
    cell = lambda name, kind: F.to_json(name) if kind.startswith(("struct", "array", "map")) else F.col(name)
    return records.select(*[cell(n, k).alias(n) for n, k in records.dtypes])


def write_csv(records: DataFrame, path: str) -> None:
    flattened(records).write.mode("overwrite").option("header", True).csv(path)


def with_data_columns(records: DataFrame, data: str = "data", order: str = "seq", most: int = 2000) -> DataFrame:
    """Base columns and one column for each key of the JSON column, in the order
    keys first come up; missing cells are empty. The key list is bounded: a
    table with over `most` keys is an error, not a wide table."""
    keys = records.select(order, F.posexplode(F.json_object_keys(data)).alias("pos", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct(order, "pos")).alias("at")).orderBy("at").limit(most + 1).collect()
    if len(first) > most:
        raise ValueError(f"over {most} keys")
    value = lambda k: F.coalesce(F.try_variant_get(F.try_parse_json(data), "$[" + json.dumps(k) + "]", "string"), F.lit(""))
    base = [c for c in BASE_COLUMNS if c in records.columns]
    return records.select(order, *base, *[value(r.key).alias(r.key) for r in first])


#: Columns of the flat artifact, fixed values in their order.
ARTIFACT_COLUMNS = ("record_id", "record_type", "schema_version", "canonical_url", "source_url", "first_seen", "last_seen", "change_type")


def artifact_rows(records: DataFrame) -> DataFrame:
    """The flat artifact: its columns alone, null where a table lacks one."""
    return records.select(*[F.col(c).cast("string").alias(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in ARTIFACT_COLUMNS])


def write_artifact_csv(records: DataFrame, path: str) -> None:
    artifact_rows(records).write.mode("overwrite").option("header", True).csv(path)


def json_lines_of_array(records: DataFrame, key: str) -> DataFrame:
    """(value): the lines of one JSON array of all rows, indented by two, in the
    order of a unique key; the part files, one after the other, are the array."""
    ends = records.agg(F.min(key).alias("low"), F.max(key).alias("high"))
    body = F.to_json(F.struct(*records.columns), {"pretty": "true", "ignoreNullFields": "false"})
    body = F.concat(F.lit("  "), F.regexp_replace(body, "\n", "\n  "))
    lead = F.when(F.col(key) == F.col("low"), "[\n").otherwise("")
    tail = F.when(F.col(key) == F.col("high"), "\n]").otherwise(",")
    rows = records.join(F.broadcast(ends)).repartitionByRange(key).sortWithinPartitions(key)  # one row of ends
    return rows.select(F.concat(lead, body, tail).alias("value"))


def write_json_array(records: DataFrame, path: str, key: str = "record_id") -> None:
    json_lines_of_array(records, key).write.mode("overwrite").text(path)


def write_marked_csv(rows: DataFrame, path: str) -> None:
    """CSV whose every part begins with a byte-order mark, for spreadsheets that need one."""
    first, *others = rows.columns
    rows.select(F.col(f"`{first}`").alias(f"\ufeff{first}"), *[f"`{c}`" for c in others]).write.mode("overwrite").option("header", True).csv(path)


def xml_name(key: str) -> tuple[str, str]:
    """A legal element name, and the attribute that keeps the key where it was not."""
    name = re.sub(r"[^A-Za-z0-9_.\-]", "_", key) or "field"
    name = name if re.match("[A-Za-z_]", name) else f"_{name}"
    return name, "" if name == key else f" name={quoteattr(ILLEGAL.sub('', key))}"


def xml_value(value: object) -> str:
    """Nested elements for objects, <item> for lists, else escaped text."""
    if isinstance(value, dict):
        named = ((*xml_name(str(k)), xml_value(v)) for k, v in value.items())
        return "".join(f"<{name}{attribute}>{inner}</{name}>" for name, attribute, inner in named)
    if isinstance(value, list):
        return "".join(f"<item>{xml_value(v)}</item>" for v in value)
    return escape(ILLEGAL.sub("", str(value)))


def xml_records(records: DataFrame, data: str = "data") -> Column:
    """Each row as a <record> element: text columns, then the JSON column nested."""
    names = [c for c in records.columns if c != data]

    @F.pandas_udf("string")
    def rows(plain: pd.DataFrame, nested: pd.Series) -> pd.Series:
        out = []
        for values, text in zip(plain.itertuples(index=False), nested, strict=True):
            cells = "".join(f"<{n}>{xml_value('' if v is None else v)}</{n}>" for n, v in zip(names, values, strict=True))
            out.append(f"<record>{cells}<data>{xml_value(json.loads(text) if text else {})}</data></record>")
        return pd.Series(out)

    return rows(F.struct(*[F.col(n).cast("string").alias(n) for n in names]), F.col(data))


def write_xml(records: DataFrame, path: str) -> None:
    """Part files of <record> lines; a reader puts <records> around them."""
    records.select(xml_records(records).alias("value")).write.mode("overwrite").text(path)


def write_report(records: DataFrame, path: str) -> None:
    """All, new and updated records, each in a folder of its own, from one table."""
    flat = flattened(records)
    for name, rows in (("all", flat), ("new", flat.where("change_type = 'NEW'")), ("updated", flat.where("change_type = 'UPDATED'"))):
        rows.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def artifacts(blobs: DataFrame, content: str = "content") -> DataFrame:
    """Distinct contents under their hash, with the folders that spread them."""
    hashed = blobs.withColumn("sha256", F.sha2(content, 256))
    return hashed.dropDuplicates(["sha256"]).withColumn("p1", F.substring("sha256", 1, 2)).withColumn("p2", F.substring("sha256", 3, 2))


def store_artifacts(blobs: DataFrame, path: str) -> None:
    """Appends the contents that the store at path does not have yet."""
    new = artifacts(blobs)
    spark = blobs.sparkSession
    try:
        known = spark.read.parquet(path).select("sha256")
    except Exception as e:  # the store's first use
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        new = new.join(known, "sha256", "left_anti")
    new.write.mode("append").partitionBy("p1", "p2").parquet(path)


def chat_messages(records: DataFrame, most: int = 5) -> DataFrame:
    """The first records as one short text, for a chat channel."""
    top = records.orderBy("record_id").limit(most)
    line = F.concat_ws(" ", F.lit("-"), "record_type", "source_url")
    return top.agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("message"))
