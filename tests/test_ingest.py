"""Landing files: headers, one scan per header, unknown columns, exact rule counts."""

import gzip
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stockmill.plans import medallion
from stockmill.schemas import FEEDS
from stockmill.sources import landing
from stockmill.streaming import tables

HEADER = "item_id,location_id,inventory_qty,inventory_value,snapshot_date"
INVENTORY = FEEDS["inventory"]


def put(folder, name, *lines, text=None):
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, name).write_text(text or "\n".join(lines) + "\n")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_scan_per_header_and_one_parse_per_row(spark, fresh):
    for n in range(3):
        put(fresh, f"a{n}.csv", HEADER, f"i{n},w,5,1.5,2025-03-31")
    put(fresh, "b.csv", "location_id,item_id,inventory_qty", "w,j,6")
    rows = landing.read_csv(spark, fresh, INVENTORY, keep_malformed=True)
    assert len(re.findall(r"Relation \[", optimized(rows))) == 2
    assert sorted(r.item_id for r in rows.collect()) == ["i0", "i1", "i2", "j"]
    headers = landing.note_headers(spark, fresh, f"{fresh}-noted")
    lines = spark.read.text(fresh).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = landing.parse_lines(lines, headers, INVENTORY)
    assert optimized(parsed).count("csvtostructs") + optimized(parsed).count("from_csv") == 2
    assert sorted(map(str, parsed.collect())) == sorted(map(str, rows.drop(landing.EXTRA).collect()))


def test_headers_come_from_the_first_bytes(spark, fresh, monkeypatch):
    put(fresh, "blank first.csv", "", "  ", HEADER, "a,w,1,1.0,2025-03-31")
    put(fresh, "no end.csv", text="x" * 5000)
    put(fresh, "mark.csv", "﻿" + HEADER, "b,w,2,1.0,2025-03-31")
    put(fresh, "empty.csv", text="\n")
    with gzip.open(Path(fresh, "packed.csv.gz"), "wt") as f:
        f.write(HEADER + "\nc,w,3,1.0,2025-03-31\n")
    monkeypatch.setattr(landing, "HEADER_BYTES", 1000)
    files = [r.file for r in landing.listed(spark, fresh).collect()]
    found = {Path(f).name: line for f, line in landing.first_lines(spark, files)}
    assert found == {"blank%20first.csv": HEADER, "mark.csv": HEADER, "packed.csv.gz": HEADER,
                     "no%20end.csv": "x" * 1000, "empty.csv": ""}


def test_packed_files_and_odd_names(spark, fresh):
    put(fresh, "a[1]{2}.csv", HEADER, "a,w,1,1.0,2025-03-31")
    put(fresh, "b%20 *?.csv", HEADER, '"b, c",w,2,1.0,2025-03-31', "")
    with gzip.open(Path(fresh, "packed.csv.gz"), "wt") as f:
        f.write(HEADER + "\nc,w,3,1.0,2025-03-31\n")
    got = landing.read_csv(spark, fresh, INVENTORY).collect()
    assert sorted((r.item_id, r.inventory_qty) for r in got) == [("a", 1), ("b, c", 2), ("c", 3)]


def test_unknown_columns_lose_nothing(spark, fresh):
    folder, out = f"{fresh}/inventory", f"{fresh}/out"
    put(folder, "old.csv", HEADER, "a,w,5,1.5,2025-03-31")
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    put(folder, "new.csv", f"shade,{HEADER},shade,\"the aisle\"", "red,b,w,6,1.5,2025-03-31,x,7",
        ",c,w,6,1.5,2025-03-31,,eight")
    with pytest.warns(UserWarning, match="shade, shade#2, the aisle"):
        medallion.ingest_bronze(spark, "inventory", fresh, out)
    bronze = {r.item_id: r._extra for r in spark.read.parquet(f"{out}/bronze/inventory").collect()}
    assert bronze == {"a": None, "b": {"shade": "red", "shade#2": "x", "the aisle": "7"},
                      "c": {"the aisle": "eight"}}
    assert medallion.read_bronze(spark, out, "inventory").columns == INVENTORY.names
    medallion.promote_column(spark, out, "inventory", "the aisle", "string")
    medallion.promote_column(spark, out, "inventory", "the aisle", "bigint")
    rows = medallion.read_bronze(spark, out, "inventory")
    assert rows.columns == [*INVENTORY.names, "the aisle"]
    assert {r.item_id: r["the aisle"] for r in rows.collect()} == {"a": None, "b": 7, "c": None}


def test_a_batch_that_runs_again_adds_no_rows(spark, fresh):
    """The driver is lost after a batch was written and before it was committed."""
    out = f"{fresh}/out"
    for n in range(3):
        put(f"{fresh}/inventory", f"{n}.csv", HEADER, f"i{n},w,5,1.5,2025-03-31")
    medallion.ingest_bronze(spark, "inventory", fresh, out, max_files=1)
    commits = Path(f"{out}/checkpoints/bronze_inventory/commits".removeprefix("file:"))
    for name in ("2", ".2.crc"):
        Path(commits, name).unlink(missing_ok=True)
    success = Path(f"{out}/bronze/inventory/batch=2/_SUCCESS".removeprefix("file:"))
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    assert medallion.read_layer(spark, out, "bronze", "inventory").count() == 3
    for name in ("2", ".2.crc"):
        Path(commits, name).unlink(missing_ok=True)
    success.unlink()  # lost while writing
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    assert sorted(r.item_id for r in medallion.read_layer(
        spark, out, "bronze", "inventory").collect()) == ["i0", "i1", "i2"]


def test_counts_are_exact_after_a_lost_driver(spark, fresh):
    """Many quick batches, a short history of progress, and no count taken while they ran."""
    out, files = f"{fresh}/out", 24
    for n in range(files):
        put(f"{fresh}/inventory", f"{n:02}.csv", HEADER, f"i{n},w,{n % 3 - 1},1.5,2025-03-31",
            f"j{n},w,4,-1.0,2025-03-31")
    medallion.ingest_bronze(spark, "inventory", fresh, out, max_files=2)
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        bronze = tables.read_table_stream(spark, f"{out}/bronze/inventory", INVENTORY, 1)
        tables.write_streaming_table(
            tables.silver_stream(bronze, "inventory"), f"{out}/silver/inventory",
            f"{out}/checkpoints/silver_inventory")  # then the driver is lost
        put(f"{fresh}/inventory", "late.csv", HEADER, ",w,1,1.5,2025-03-31")
        medallion.ingest_bronze(spark, "inventory", fresh, out)
        medallion.refresh_silver(spark, "inventory", out)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)

    def totals():
        found = tables.rule_counts(spark, f"{out}/rule_counts")
        assert found.groupBy("batch", "measure").count().where("count > 1").count() == 0
        return {r.measure: r.n for r in
                found.groupBy("measure").agg(F.sum("row_count").alias("n")).collect()}

    want = {"total_rows": 2 * files + 1, "valid_qty": files // 3, "valid_value": files,
            "has_item": 1}
    assert totals() == want
    medallion.refresh_silver(spark, "inventory", out)
    assert totals() == want


def test_empty_folder(spark, fresh):
    Path(fresh).mkdir(parents=True)
    got = landing.read_csv(spark, fresh, INVENTORY)
    assert got.columns == INVENTORY.names and got.count() == 0
