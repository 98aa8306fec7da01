"""Reading, writing, loading many files, and the row-wise stream."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from tableprobe.operators import merge
from tableprobe.sources import readers, writers
from tableprobe.streaming.rowwise import run_files


def test_csv_has_a_byte_order_mark_and_reads_back(spark, folder):
    df = spark.createDataFrame([("°C", 'say "hi", ok'), (None, "x")], "unit string, note string")
    writers.write_csv(df, f"{folder}/a.csv")
    part = next(p for p in glob.glob(f"{folder}/a.csv/*.csv") if open(p, "rb").read())
    assert open(part, "rb").read().startswith(b"\xef\xbb\xbf")
    back = readers.read_csv(spark, f"{folder}/a.csv")
    assert back.columns == ["unit", "note"] and {tuple(r) for r in back.collect()} == {("°C", 'say "hi", ok'), (None, "x")}


def test_json_keeps_nulls_and_arrays_of_records_load(spark, folder):
    writers.write_json(spark.createDataFrame([(1, None)], "a int, b string"), f"{folder}/a.json")
    text = "".join(open(p).read() for p in glob.glob(f"{folder}/a.json/*.json"))
    assert text.strip() == '{"a":1,"b":null}'
    with open(f"{folder}/b.json", "w") as f:
        f.write('[{"a": 1, "t": "2024-01-01"},\n {"a": 2, "t": "2024-01-02"}]')
    df, report = readers.load_table(spark, f"{folder}/b.json")
    assert df.count() == 2 and report["detected_types"]["t"] == "datetime"


def test_unknown_kinds_are_refused(spark, folder):
    with pytest.raises(ValueError, match="csv, json"):
        readers.load_table(spark, f"{folder}/a.xlsx")
    with pytest.raises(ValueError, match="Unsupported export"):
        writers.export_table(spark.range(1), folder, "xlsx")


def test_export_audit(spark, folder):
    row = writers.export_table(spark.range(7), folder, "CSV (.csv)", "my table!").first()
    assert row["rows"] == 7 and row["columns"] == 1 and row["bytes"] > 0 and re.fullmatch(r"my_table_\d{8}_\d{6}\.csv", row["name"])
    assert writers.export_name("///", "pq").startswith("dataset_")


def test_header_found_below_notes(spark, folder):
    with open(f"{folder}/notes.csv", "w") as f:
        f.write("Machine 7,,\nexported,today,\n Time ,Temp,Temp\n2024-01-01,1.5,\n2024-01-02,Bad,7\n")
    raw = readers.read_csv(spark, f"{folder}/notes.csv", header=False, with_order=True)
    df, report = readers.apply_header_overrides(raw, 2, True)
    assert df.columns == ["Time", "Temp", "Temp_1"]
    assert [tuple(r)[1:] for r in df.orderBy("Time").collect()] == [(1.5, None), (None, 7)]
    assert report["detected_types"]["Time"] == "datetime"
    assert readers.header_names([None, " a", "a", ""]) == ["Unnamed_0", "a", "a_1", "Unnamed_3"]
    assert readers.apply_header_overrides(raw, 99, False)[0].count() == 0


def test_order_follows_the_file(spark, folder):
    with open(f"{folder}/lines.csv", "w") as f:
        f.write("n\n" + "\n".join(str(i) for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = readers.read_csv(spark, f"{folder}/lines.csv", with_order=True)
        assert df.rdd.getNumPartitions() > 1
        assert [int(r["n"]) for r in df.orderBy(readers.ORDER).collect()] == list(range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")


def test_load_many_reports_every_file(spark, folder):
    for name, text in {"a.csv": "k,v\n1,x\n2,y\n", "b.csv": "k,w\n3,5\n", "empty.csv": "k,v\n", "odd.xyz": "1"}.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    paths = [f"{folder}/{n}" for n in ("a.csv", "b.csv", "empty.csv", "odd.xyz", "gone.csv")]
    df, report = readers.load_many(spark, paths)
    assert {r["file"]: r["status"] for r in report["files"].collect()} == {
        "a.csv": "ok", "b.csv": "ok", "empty.csv": "empty", "odd.xyz": "failed", "gone.csv": "failed"
    }
    assert df.columns == ["source_file", "k", "v", "w"] and df.count() == 3 and report["merge"] == "stack"
    assert any("lacks" in m for m in report["messages"])
    one, _ = readers.load_many(spark, paths[:1])
    assert one.columns == ["k", "v"]
    assert readers.load_many(spark, paths[4:])[0] is None


def test_time_align_shift_and_lab(spark):
    minutes = spark.range(720).select(F.timestamp_seconds(F.col("id") * 60).alias("t"), F.col("id").cast("double").alias("temp"))
    lab = spark.createDataFrame([(0, 1.0), (21600, None), (40000, 3.0)], "s int, temp double").select(F.timestamp_seconds("s").alias("when"), "temp", F.lit("ok").alias("grade"))
    tables = {"sensor": minutes, "lab": lab}
    how, axes = merge.choose_merge(tables)
    assert how == "time_align" and axes == {"sensor": "t", "lab": "when"}
    out = merge.time_align(tables, axes)
    assert out.columns == ["source_file", "t", "temp", "temp__lab", "grade", "source_file__lab"]
    rows = {r["temp"]: r for r in out.collect()}
    assert len(rows) == 720 and rows[359.0]["temp__lab"] == 1.0
    assert rows[360.0]["temp__lab"] is None and rows[360.0]["grade"] == "ok" and rows[719.0]["temp__lab"] == 3.0


def test_rowwise_cleaning_on_a_stream(spark, folder):
    df = spark.createDataFrame([(" No Data ", float("inf")), (" ok ", 2.0)], "s string, v double")
    df.write.parquet(f"{folder}/in")
    run_files(spark, f"{folder}/in", df.schema, f"{folder}/out", f"{folder}/progress")
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()} == {(None, None), ("ok", 2.0)}
