"""Names, placeholders and type promotion on small frames."""

import pytest
from pyspark.sql import functions as F

from tableprobe.functions.dates import FORMAT_PRESETS, builder_to_pattern, number_to_timestamp
from tableprobe.functions.text import PLACEHOLDER_TOKENS, parse_number
from tableprobe.operators import dates, detect, prepare, typing


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def values(df, name="x"):
    return [r[name] for r in df.collect()]


def test_names_are_cleaned_and_unique():
    names, renamed, numbered = typing.clean_names(["Plant\nTemp", "a b", "", "Value", "Value", "Value_2", "Value"])
    assert names == ["Plant Temp", "a b", "unnamed_column", "Value", "Value_2", "Value_2_2", "Value_3"]
    assert renamed == {"Plant\nTemp": "Plant Temp", "a b": "a b", "": "unnamed_column"}
    assert numbered == ["Value_2", "Value_2_2", "Value_3"]


def test_dirty_sensor_column(spark):
    df = column(spark, ["120", "130", "No Data", "145", "Bad", "Sensor Fail", "-", ""])
    clean, report = typing.sanitize(df)
    assert values(clean) == [120, 130, None, 145, None, None, None, None]
    assert report["tokens_replaced_total"] == 5 and report["numeric_conversions"][0]["valid"] == 3
    assert len(PLACEHOLDER_TOKENS) == len(set(PLACEHOLDER_TOKENS)) == 83


def test_what_counts_as_a_number(spark):
    texts = ["1d", "1f", "NaN", "1e5", ".5", "5.", "-inf", "+5", "1,234", "12,34", "1,234.5", "", None]
    got = values(column(spark, texts).select(parse_number(F.col("x")).alias("x")))
    assert got == [None, None, None, 1e5, 0.5, 5.0, float("-inf"), 5.0, 1234.0, None, 1234.5, None, None]


@pytest.mark.parametrize(
    "texts, kind",
    [
        (["1", "2", "x", "4"], "bigint"),  # 75 % numbers
        (["1", "x", "y", "4"], "string"),
        (["1.5", "2", "3"], "double"),
        (["yes", "No", " y "], "boolean"),
        (["yes", "yes"], "string"),  # one word only
        (["0", "1"], "bigint"),
        (["2024-01-01", "2/1/2024", "20240301"], "timestamp"),
        (["2024-01-01", None, None], "string"),  # nulls vote against dates
        (["ID-1234", "ID-99"], "string"),
        ([None, None], "string"),
    ],
)
def test_promotion(spark, texts, kind):
    assert dict(typing.sanitize(column(spark, texts))[0].dtypes)["x"] == kind


def test_sanitize_twice_changes_nothing_more(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01", "yes", float("inf"), [1]), ("n/a", "2024-02-01", "no", 2.0, [2])],
        "a string, b string, c string, d double, e array<int>",
    )
    once, first = typing.sanitize(df)
    twice, second = typing.sanitize(once)
    assert once.dtypes == twice.dtypes and once.collect() == twice.collect()
    assert first["infinities_replaced"] == 1 and first["nested_columns"] and second["tokens_replaced_total"] == 0
    assert first["detected_types"] == {"a": "numeric", "b": "datetime", "c": "boolean", "d": "numeric", "e": "string"}


def test_sanitize_an_empty_table(spark):
    clean, report = typing.sanitize(spark.createDataFrame([], "a string, b double"))
    assert clean.count() == 0 and report["warnings"] and report["input_rows"] == 0


def test_infinite_text_becomes_null(spark):
    clean, report = typing.sanitize(column(spark, ["1", "inf", "3"]))
    assert values(clean) == [1.0, None, 3.0] and report["infinities_replaced"] == 1


def test_status_codes(spark):
    df = spark.createDataFrame(
        [(i % 2, i % 2 + 1, i % 3 - 1, i % 3, i % 12, 5, 0.5 * (i % 2)) for i in range(60)],
        "a int, b int, c int, d int, e int, f int, g double",
    )
    got = {r["column"]: r for r in typing.detect_low_unique_numeric(df).collect()}
    assert set(got) == {"a", "b", "c", "d"} and all(r["boolean_like"] for r in got.values())
    assert got["c"]["examples"] == [-1.0, 0.0, 1.0]
    assert {r["column"] for r in typing.detect_low_unique_numeric(df, max_unique=12, max_ratio=0.5).collect()} == set("abcdeg")


def test_presets_round_trip(spark):
    moment = "2025-05-12 14:22:45.123456"
    for fmt in FORMAT_PRESETS:
        pattern = builder_to_pattern(fmt)
        shown = pattern.replace("[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "SSSSSS")
        text = spark.sql(f"SELECT date_format(timestamp'{moment}', \"{shown}\") AS x")
        read = text.select(F.try_to_timestamp("x", F.lit(pattern)).alias("t")).first()["t"]
        assert read is not None, fmt
        assert dates.suggest_formats(text, "x", 19).where(F.col("format") == fmt).count() == 1


def test_compact_stamps(spark):
    df = column(spark, ["20250512142245", "202505121422", "20250512"])
    got = values(dates.parse_datetime(df, "x")[0].select(F.date_format("x", "yyyyMMddHHmmss").alias("x")))
    assert got == ["20250512142245", "20250512142200", "20250512000000"]


def test_spreadsheet_serial(spark):
    df = column(spark, [46004.04167, -1e300, None], "double")
    got = df.select(F.date_format(number_to_timestamp(F.col("x"), "excel_serial"), "yyyy-MM-dd HH:mm:ss").alias("x"))
    assert values(got) == ["2025-12-13 01:00:00", None, None]


def test_detection_of_date_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "abc", 1), ("oops", "def", 2), ("2024-01-03", "x", 3), ("2024-01-04", "y", 4)], "a string, b string, c int")
    rows = [tuple(r) for r in detect.datetime_detection_summary(df).collect()]
    assert rows == [("a", "parseable", 75.0, 1)]
    assert detect.detect_datetime_columns(df) == ["a"]


def test_conversions_asked_for(spark):
    df = column(spark, ["1", "0", "maybe", None])
    out, lost, error = prepare.convert_type(df, "x", "boolean")
    assert values(out) == [True, False, None, None] and lost == 1 and error is None
    half = column(spark, ["1", "2.5"])
    out, lost, error = prepare.convert_type(half, "x", "int")
    assert values(out) == ["1", "2.5"] and error
    assert prepare.convert_type(df, "x", "money")[2]


def test_fill_rules_and_warnings(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, 4, None), (3, 9, "a"), (4, None, "a"), (5, 5, "b")], "k int, n int, s string")
    warnings = []
    out = prepare.fill_missing(df, [("n", "median", None), ("s", "mean", None), ("nope", "mean", None), ("k", "mean", None)], warnings=warnings)
    assert [r["n"] for r in out.orderBy("k").collect()] == [5.0, 4.0, 9.0, 5.0, 5.0]
    assert len(warnings) == 2 and dict(out.dtypes)["k"] == "int"
    assert [r["s"] for r in prepare.fill_missing(df, [("s", "mode", None)]).orderBy("k").collect()] == ["b", "a", "a", "a", "b"]
    assert [r["n"] for r in prepare.fill_missing(df, [("n", "constant", "7")]).orderBy("k").collect()] == [7, 4, 9, 7, 5]
    with pytest.raises(ValueError):
        prepare.fill_missing(df, [("n", "ffill", None)])


def test_prepare_in_its_fixed_order(spark):
    df = spark.createDataFrame(
        [(1, 46004.5, "2024-05-01", "10:00:00", "3"), (2, 46005.5, "bad", None, "x")], "id int, serial double, day string, clock string, n string"
    )
    out, warnings = prepare.prepare(
        df,
        {
            "drop": ["id"],
            "numeric_dates": {"serial": ("excel_serial", "when")},
            "date_times": [{"date": "day", "time": "clock", "output": "at"}],
            "types": {"n": "int"},
            "missing": {"n": ("constant", "0")},
        },
    )
    assert out.columns == ["serial", "day", "clock", "n", "when", "at"]
    assert [r["n"] for r in out.orderBy("serial").collect()] == [3, 0]
    assert len(warnings) == 2
    assert prepare.schema_diff(df, out) == [
        ("id", "dropped", "int", None),
        ("when", "added", None, "timestamp"),
        ("at", "added", None, "timestamp"),
        ("n", "retyped", "string", "bigint"),
    ]
