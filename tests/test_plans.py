"""What the physical plans must and must not contain."""

from pyspark.sql import functions as F

from tableprobe.operators import filters, merge, profile, relate, timeseries
from tableprobe.plans.ordered import CHUNK
from tests.conftest import SMALL, plan


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_shipdate")
    text = plan(filters.filter_range(df, "l_quantity", 5, 10))
    assert "GreaterThanOrEqual(l_quantity" in text and "LessThanOrEqual(l_quantity" in text
    assert "GreaterThanOrEqual(l_shipdate" in plan(filters.filter_time_range(df, "l_shipdate", "1995-01-01", "1996-01-01"))
    customer = spark.read.parquet(f"{SMALL}/customer.parquet")
    assert "In(c_mktsegment" in plan(filters.filter_in(customer, "c_mktsegment", ["BUILDING", "AUTOMOBILE"]))


def test_scans_read_only_what_is_needed(spark):
    df = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    text = plan(relate.correlation_matrix(df, ["l_quantity", "l_tax"]))
    schema = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "l_tax" in schema and "l_extendedprice" not in schema


def test_chunked_order_never_uses_one_partition_over_rows(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    left = events.where("event_type = 'click'").select("ts", "event_id")
    right = events.where("event_type = 'view'").select("ts", "value")
    spark.conf.set("tableprobe.rowsPerChunk", "50")
    try:
        for df in (
            merge.asof_join(left, right, "ts"),
            timeseries.rolling(events, "ts", "value", 3600),
            timeseries.trend_direction(events, "ts", "value"),
        ):
            text = plan(df)
            # Windows run inside a chunk, or over the one summary row each chunk leaves.
            specs = text.split("windowspecdefinition(")[1:]
            assert specs and all(CHUNK in spec.split(")")[0] for spec in specs)
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    finally:
        spark.conf.unset("tableprobe.rowsPerChunk")


def test_top_lists_are_limited_before_the_shuffle(spark):
    df = spark.read.parquet(f"{SMALL}/part.parquet")
    assert "WindowGroupLimit" in plan(profile.top_values(df, ["p_brand", "p_type"], 5))


def test_every_column_is_aggregated_by_the_same_code(spark):
    wide = spark.range(100).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(150)])
    assert profile.missing_summary(wide).count() == 150
    assert relate.correlation_matrix(wide.select(*[f"c{i}" for i in range(40)])).count() == 780
