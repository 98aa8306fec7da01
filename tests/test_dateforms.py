"""Date texts of many forms against the timestamps they stand for."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tableprobe.functions.dates import infer_timestamp
from tableprobe.operators import detect
from tests.conftest import plan

FORMS = {
    "01/02/24": "2024-01-02", "13/02/24": "2024-02-13", "1-2-99": "1999-01-02", "31.12.68": "2068-12-31", "31.12.69": "1969-12-31",
    "01/02/2024 3:04 PM": "2024-01-02 15:04:00", "01/02/2024 12:04 am": "2024-01-02 00:04:00", "2024-01-02 12:00:05 p.m.": "2024-01-02 12:00:05",
    "12:30": "1970-01-01 12:30:00", "7:05 PM": "1970-01-01 19:05:00", "3 PM": "1970-01-01 15:00:00", "7:05:09": "1970-01-01 07:05:09",
    "Jan 2024": "2024-01-01", "january 2024": "2024-01-01", "Sept. 2023": "2023-09-01", "Jan-2024": "2024-01-01", "2024 Mar": "2024-03-01",
    "2024-01": "2024-01-01", "2024/11": "2024-11-01", "01/2024": "2024-01-01", "11-2024": "2024-11-01",
    "Mon, 02 Jan 2024 10:00:00": "2024-01-02 10:00:00", "Monday, January 2, 2024": "2024-01-02", "Tue 02 Jan 2024 10:00": "2024-01-02 10:00:00",
    "Mon, 02 Jan 2024 10:00:00 GMT": "2024-01-02 10:00:00", "Mon, 02 Jan 2024 10:00:00 +0230": "2024-01-02 07:30:00", "2024-01-02T10:00:00.123456789-01:00": "2024-01-02 11:00:00.123456",
    "2024-01-02 03:04:05.123456789": "2024-01-02 03:04:05.123456", "2024-01-02T03:04:05,5": "2024-01-02 03:04:05.5", "01/02/2024 03:04:05.999999999": "2024-01-02 03:04:05.999999",
    "02-Jan-24": "2024-01-02", "2 Jan 2024, 3:04 pm": "2024-01-02 15:04:00", "Jan 2nd, 2024": "2024-01-02", "3rd March 2021": "2021-03-03", "2024-Jan-02": "2024-01-02",
    "2024-1-2": "2024-01-02", "20240102": "2024-01-02", "02/01/2024 10.11.12": "2024-02-01 10:11:12", "Jan 2, 2024": "2024-01-02",
    "Wednesday, September 02, 2020 10:00:00.123456789 p.m. +00:00": "2020-09-02 22:00:00.123456",
}
NONE = [
    "", "lot 7", "15:04 PM", "0:30 am", "13 pm", "24:00", "12:60", "2024-13", "13/2024/1", "31/02/24", "32/13/24", "1.5", "12,5", "1234", "12345", "2024", "99", "Jan", "Monday", "may 32 2024", "12:30 +9999",
    "1/2", "a 1/2/24", "1:2:3:4", "2024-01-02 pm", "10:00:00 2024-01-02 03", "x" * 5000 + " 1", "1-" * 3000, "abcdefghij" * 300 + "1/2/24",
]


def as_time(text):
    return dt.datetime.fromisoformat(text)


def test_forms(spark):
    texts = [*FORMS, *NONE]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = {r["text"]: r["t"] for r in df.select("text", infer_timestamp(F.col("text")).alias("t")).collect()}
    wrong = {x: got[x] for x in texts if got[x] != (as_time(FORMS[x]) if x in FORMS else None)}
    assert not wrong


def test_day_first_is_tried_first_when_asked(spark):
    df = spark.createDataFrame([("01/02/24",), ("01/13/24",), ("01-02-2024 3 PM",)], "text string")
    got = [r[0] for r in df.select(infer_timestamp(F.col("text"), dayfirst=True)).collect()]
    assert got == [as_time("2024-02-01"), as_time("2024-01-13"), as_time("2024-02-01 15:00:00")]


@pytest.mark.parametrize("form", ["MM/dd/yy", "h:mm a", "MMM yyyy", "yyyy-MM", "EEE, dd MMM yyyy HH:mm:ss", "MM/dd/yyyy h:mm a"])
def test_columns_in_one_form_are_found(spark, form):
    days = spark.sql("SELECT explode(sequence(timestamp'2020-01-01 01:00:00', timestamp'2024-06-01 01:00:00', interval 5 days 7 hours)) AS t")
    df = days.select(F.date_format("t", form).alias("when"), F.lit("no date").alias("word"))
    assert detect.detect_datetime_columns(df) == ["when"]


def test_equal_texts_are_read_once_and_all_are_counted(spark):
    """Reading stands behind a shuffle of different texts; short, long, equal and missing ones all count."""
    texts = ["01/02/24"] * 40 + ["2024-01-02"] * 30 + [" " * 90 + "Jan 2024"] * 15 + ["x" * 90] * 10 + ["soon"] * 5 + [None] * 20
    df = spark.createDataFrame([(x, None) for x in texts], "text string, none string").repartition(3)
    found = detect.datetime_detection_summary(df)
    assert [tuple(r) for r in found.collect()] == [("text", "parseable", 85.0, 15)]
    assert re.search(r"hashpartitioning\(id#\d+, value#\d+, long_parsed#\d+", plan(found))


def test_plain_dates_are_read_without_a_step_of_binding(spark):
    """They take a branch before the one that binds values, with the same result."""
    texts = ["2024-02-29", "2023-02-29", "2024-13-01", "2024-00-10", "1969-12-31", "2024-1-02", "2024/01/02", "soon", None]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    found = df.select(infer_timestamp(F.col("text")).alias("t"))
    days = ["2024-02-29", None, None, None, "1969-12-31", "2024-01-02", "2024-01-02", None, None]
    assert [r[0] for r in found.collect()] == [as_time(x) if x else None for x in days]
    whole = plan(found)
    assert 0 < whole.find("make_timestamp(try_cast(substring(text") < whole.find("transform(")
