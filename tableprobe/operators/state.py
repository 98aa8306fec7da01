"""One profile of a table, from which findings and reports are derived.

Four scans, however many sections are asked for: moments, gaps, time spans and a sketch
of every column; the values around the wanted quartiles; pairs of numeric columns together
with the values outside the fences; and counts of equal rows and of equal values. Each
leaves one row per column (and one per pair), small enough to keep; nothing is scanned
again for a section. Very large tables need further scans for exact quartiles
(``plans/selection.py``), and one more if a long text turns out to dominate its column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.functions.columns import as_number, col, is_numeric, is_text, is_time, micros, numeric_columns, percent
from tableprobe.functions.frames import report_frame
from tableprobe.functions.stats import sample_kurtosis, sample_skewness
from tableprobe.functions.text import short_key
from tableprobe.operators.profile import _filled, graded_quality, health_of, row_digest, row_keys, statistics_of, widest_span
from tableprobe.operators.typing import _low_cardinality, stringify_nested
from tableprobe.plans.comoments import column_states, correlations_of
from tableprobe.plans.frequency import value_texts
from tableprobe.plans.selection import ACCURACY, selected_quantiles, sketch_shares
from tableprobe.plans.storage import materialize

QUARTILES = (0.25, 0.5, 0.75)
#: Place of whole rows among the columns, when equal values are counted.
ROWS = -1


@dataclass
class TableState:
    """What is known of each column (a dict by place) and of each pair of numeric columns."""

    spark: SparkSession
    columns: list[dict[str, Any]]
    pairs: DataFrame
    rows: int
    duplicates: int

    def frame(self, fields: dict[str, str], kind: str | None = None) -> DataFrame:
        """(position, column, *fields) of all columns, or of one group of them."""
        chosen = [(k, c) for k, c in enumerate(self.columns) if kind is None or c[kind]]
        rows = [(k, c["column"], *[c[f] for f in fields]) for k, c in chosen]
        return report_frame(self.spark, rows, ", ".join(["position int", "column string", *[f"{f} {t}" for f, t in fields.items()]]))

    # Tables with the columns that the operators of ``profile`` and ``relate`` give.

    def overview(self) -> DataFrame:
        gaps = sum(c["rows"] - c["filled"] for c in self.columns)
        return report_frame(self.spark, [(self.rows, len(self.columns), gaps)], "rows bigint, columns bigint, missing_cells bigint")

    def missing(self) -> DataFrame:
        gap = F.col("rows") - F.col("filled")
        return (
            self.frame({"rows": "bigint", "filled": "bigint"})
            .select("position", "column", gap.alias("missing"), percent(gap, F.col("rows")).alias("missing_pct"))
            .orderBy(F.desc("missing_pct"), "position")
            .drop("position")
        )

    def repeated(self) -> DataFrame:
        one = report_frame(self.spark, [(self.rows, self.duplicates)], "rows bigint, duplicates bigint")
        return one.withColumn("duplicate_pct", percent(F.col("duplicates"), F.col("rows")))

    def quality(self) -> DataFrame:
        return graded_quality(self.overview().withColumn("duplicates", F.lit(self.duplicates).cast("bigint")))

    def types(self) -> DataFrame:
        kinds = ("numeric", "categorical", "datetime")
        return report_frame(self.spark, [(k, sum(1 for c in self.columns if c[k])) for k in kinds], "kind string, columns bigint")

    def coverage(self) -> DataFrame:
        spans = self.frame({"first": "bigint", "last": "bigint", "non_null": "bigint"}, "datetime")
        return widest_span(
            spans.select("position", "column", F.timestamp_micros("first").alias("start"), F.timestamp_micros("last").alias("end"), "non_null")
        )

    def health(self) -> DataFrame:
        return health_of(self.frame({"type": "string", "rows": "bigint", "filled": "bigint", "unique": "bigint"}))

    def statistics(self) -> DataFrame:
        doubles = ("mean", "std", "min", "max", "skew", "kurtosis", "q0", "q1", "q2")
        fields = {"rows": "bigint", "count": "bigint", "unique": "bigint", **dict.fromkeys(doubles, "double")}
        known = self.frame(fields, "numeric").withColumnRenamed("unique", "distinct")
        return statistics_of(known.withColumn("q", F.array("q0", "q1", "q2")))

    def correlations(self) -> DataFrame:
        """(position, a, b, r), a row for each pair of numeric columns whether it ever meets or not."""
        names = self.frame({}, "numeric")
        place = {r["column"]: i for i, r in enumerate(names.collect())}  # one row per column
        labels = report_frame(self.spark, [(i, c) for c, i in place.items()], "at int, name string")
        first = labels.select(F.col("at").alias("i"), F.col("name").alias("a"))
        second = labels.select(F.col("at").alias("j"), F.col("name").alias("b"))
        p = F.lit(len(place))
        # Pairs are listed by their numbers; every join is against one row per column, or per pair.
        spine = first.select("i", "a", F.explode(F.sequence(F.col("i") + 1, p - 1)).alias("j")) if len(place) > 1 else first.select("i", "a", F.col("i").alias("j")).where(F.lit(False))
        position = F.col("i") * (2 * p - F.col("i") - 1) / 2 + F.col("j") - F.col("i") - 1
        return (
            spine.where(F.col("j") > F.col("i"))
            .join(F.broadcast(second), "j")
            .join(self.pairs.select("i", "j", "r"), ["i", "j"], "left")
            .select(position.cast("int").alias("position"), "a", "b", "r")
        )

    def dominant(self) -> DataFrame:
        """The most frequent value of each categorical column."""
        fields = {"top_value": "string", "top_n": "bigint", "counted": "bigint"}
        return self.frame(fields, "categorical").select(
            "column", F.col("top_value").alias("value"), F.col("top_n").alias("n"), percent(F.col("top_n"), F.col("counted")).alias("pct")
        )

    def outliers(self) -> DataFrame:
        known = self.frame({"outliers": "bigint", "count": "bigint"}, "numeric")
        return known.select("column", "outliers", percent(F.col("outliers"), F.col("count")).alias("outlier_pct"))


def _scan_columns(df: DataFrame) -> list[dict[str, Any]]:
    """First scan: a row for each column."""
    nothing, never = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    entries = []
    for at, f in enumerate(df.schema.fields):
        number = as_number(col(f.name), f.dataType) + F.lit(0.0) if is_numeric(f.dataType) else nothing
        time = micros(col(f.name)) if is_time(f.dataType) else never
        entries.append(F.struct(F.lit(at).alias("at"), _filled(df, f.name).isNotNull().alias("here"), number.alias("x"), time.alias("t")))
    if not entries:
        return []
    x = F.col("x")
    shares = [s for pair in sketch_shares(QUARTILES) for s in pair]
    found = (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
        .groupBy("at")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if("here").alias("filled"),
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            sample_skewness(x).alias("skew"),
            sample_kurtosis(x).alias("kurtosis"),
            F.percentile_approx(x, F.array(*[F.lit(s) for s in shares]), F.lit(ACCURACY)).alias("near"),
            F.min("t").alias("first"),
            F.max("t").alias("last"),
            F.count("t").alias("non_null"),
        )
    )
    names = ("rows", "filled", "count", "non_null")
    empty = {f: 0 if f in names else None for f in found.columns}
    got = {r["at"]: r.asDict() for r in found.collect()}  # one row per column
    out = []
    for at, (f, kind) in enumerate(zip(df.schema.fields, (t for _, t in df.dtypes))):
        out.append({**got.get(at, empty), "column": f.name, "type": kind, "numeric": is_numeric(f.dataType), "datetime": is_time(f.dataType)})
    return out


def _scan_values(df: DataFrame, counted: Sequence[str]) -> dict[int, dict[str, Any]]:
    """Last scan: by place of a column (or ROWS) how many different values, and the most frequent one."""
    flat, _ = stringify_nested(df)
    texts = value_texts(flat, list(counted), short=True)
    entries = [(ROWS, F.base64(row_digest(row_keys(flat))))] + [(flat.columns.index(c), t) for c, t in zip(counted, texts)]
    long = flat.select(F.explode(F.array(*[F.struct(F.lit(at).alias("at"), v.alias("value")) for at, v in entries])).alias("e")).select("e.*")
    counts = long.where("value is not null").groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value")))
    per = counts.groupBy("at").agg(F.count(F.lit(1)).alias("unique"), F.sum("n").alias("counted"), best.alias("top"))
    return {r["at"]: r.asDict() for r in per.collect()}  # one row per column


def table_state(df: DataFrame, all_values: bool = True, top_share: float = 0.0) -> TableState:
    """Profile the table. Without ``all_values`` only values of text and booleans are counted.

    ``top_value`` is the whole value where it has at least ``top_share`` per cent of its column;
    below that a long text may be shown by its digest.
    """
    spark = df.sparkSession
    columns = _scan_columns(df)
    numeric = numeric_columns(df)
    places = [df.columns.index(c) for c in numeric]
    numbers = {c: as_number(col(c), df.schema[c].dataType) + F.lit(0.0) for c in numeric}
    near = {}
    for k, at in enumerate(places):
        if columns[at]["count"]:
            found = columns[at]["near"]
            near[k] = (columns[at]["count"], [[found[2 * q], found[2 * q + 1]] for q in range(len(QUARTILES))])
    quartiles = selected_quantiles(df, numbers, QUARTILES, sketched=near) if numeric else {}
    fences = []
    for c, at in zip(numeric, places):
        q1, q2, q3 = quartiles[c]
        columns[at].update(q0=q1, q1=q2, q2=q3, outliers=0)
        fences.append(None if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    pairs = report_frame(spark, [], "i int, j int, n bigint, r double")
    if numeric:
        states = materialize(column_states(df, list(numbers.values()), fences=fences))
        for r in states.select("i", "outside").collect():  # one row per column
            columns[places[r["i"]]]["outliers"] = r["outside"]
        pairs = correlations_of(states)
    flags = [f.name for f in df.schema.fields if is_text(f.dataType) or f.dataType.typeName() == "boolean"]
    found = _scan_values(df, df.columns if all_values else flags)
    rows = columns[0]["rows"] if columns else 0
    for at, (c, f) in enumerate(zip(columns, df.schema.fields)):
        seen = found.get(at)
        c.update(unique=seen["unique"] if seen else 0, counted=seen["counted"] if seen else 0, top_n=seen["top"]["n"] if seen else None, top_value=seen["top"]["value"] if seen else None)
        tagged = (f.metadata or {}).get("logical") == "categorical"
        c["categorical"] = f.dataType.typeName() == "boolean" or (is_text(f.dataType) and (tagged or _low_cardinality(c["unique"], rows)))
        if c["categorical"] and is_text(f.dataType) and seen and len(seen["top"]["value"]) == 64 and 100.0 * c["top_n"] >= top_share * c["counted"]:
            whole = df.where(short_key(col(f.name)) == F.lit(seen["top"]["value"])).select(col(f.name)).limit(1).first()
            c["top_value"] = whole[0]
    repeated = found.get(ROWS)
    return TableState(spark, columns, pairs, rows, repeated["counted"] - repeated["unique"] if repeated else 0)
