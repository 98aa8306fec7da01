"""The profile behind findings and reports: as the single operators, in four scans."""

import pytest
from pyspark.sql import functions as F

from catalog.base import derived
from tableprobe.functions.frames import rounded
from tableprobe.operators import findings as op
from tableprobe.operators import profile, relate
from tableprobe.operators.state import table_state
from tests.conftest import SMALL


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, rounded(a, 8).collect())) == sorted(map(repr, rounded(b, 8).collect()))


def counted(spark, df):
    """The table, and how many of its rows have been read so far."""
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(through, df.schema), seen


@pytest.mark.parametrize("name", ["gauges", "stamps", "documents"])
def test_sections_equal_the_single_operators(spark, name):
    df = spark.read.parquet(f"{SMALL}/documents.parquet") if name == "documents" else derived(spark, SMALL, name)
    report = op.report_tables(df)
    same(report["overview"], profile.overview(df))
    same(report["quality"], profile.quality_status(df))
    same(report["types"], profile.type_counts(df))
    same(report["time_coverage"], profile.time_coverage(df))
    same(report["column_health"], profile.column_health(df))
    same(report["numeric"], profile.numeric_statistics(df))
    same(report["correlation"], relate.correlation_matrix(df).drop("position"))
    same(report["top_correlations"], relate.top_correlations(df))


@pytest.mark.parametrize("name", ["gauges", "stamps"])
def test_findings_equal_the_single_rules(spark, name):
    df = derived(spark, SMALL, name)
    rules = [op.findings_missing, op.findings_duplicates, op.findings_correlation, op.findings_skew, op.findings_dominant, op.findings_outliers]
    got = op.findings(df)
    for position, rule in enumerate(rules):
        same(got.where(F.col("position") == position).drop("position"), rule(df))


def test_four_scans(spark):
    df = derived(spark, SMALL, "gauges")
    rows = df.count()
    for build in (lambda t: op.findings(t).collect(), lambda t: [s.collect() for s in op.report_tables(t).values()]):
        table, seen = counted(spark, df)
        build(table)
        assert rows < seen.value <= 4 * rows


def test_long_dominating_text_is_told_whole(spark):
    long = "a notice of more than thirty-two characters, again and again"
    df = spark.createDataFrame([(long,)] * 9 + [("other",), (None,)], "note string")
    (line,) = op.findings(df).where("rule = 'dominant'").collect()
    assert long in line["text"] and line["value"] == pytest.approx(90.0)


def test_edges(spark):
    empty = spark.createDataFrame([], "a double, b string, c timestamp, d array<int>, e double")
    known = table_state(empty)
    assert known.rows == 0 and known.duplicates == 0
    assert [r["rule"] for r in op.findings(empty).collect()] == [r["rule"] for rule in (op.findings_missing, op.findings_duplicates, op.findings_correlation) for r in rule(empty).collect()]
    same(op.report_tables(empty)["column_health"], profile.column_health(empty))
    odd = spark.createDataFrame([(1.0, float("nan"), [1], "x"), (None, 2.0, None, "x"), (1.0, float("nan"), [1], "x")], "`a.b` double, `a b` double, n array<int>, t string")
    report = op.report_tables(odd)
    same(report["numeric"], profile.numeric_statistics(odd))
    same(report["quality"], profile.quality_status(odd))
    same(report["column_health"], profile.column_health(odd))
    one = spark.createDataFrame([("x",)], "t string")
    assert op.report_tables(one)["correlation"].count() == 0
