"""Exact quantiles by selection: brackets from a sketch, counts around them, values inside.

No value travels unless it lies in the narrow bracket of a wanted rank. A first scan makes a
sketch per column of one row in ten (of all rows where that leaves few values); it gives
two values that should hold the rank between them. The next scan
folds everything outside the brackets to counts and only keeps apart the values inside,
which are so few that they are looked at here. Brackets that would hold too many are
made narrower first, by a sketch of what they hold. A rank that is not between its values
after all is seen from the counts, and its bracket is widened; results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketches are right to one rank in so many.
ACCURACY = 2_000
#: Share of the rows that the first sketch sees, and the values it needs to be trusted.
#: The sample only proposes brackets; ranks are counted over all rows.
SAMPLE, SAMPLED = 0.1, 2_000
#: How far from the wanted share brackets may reach, by the size of the sample.
MARGINS = (0.002, 0.005, 0.015, 0.05)
#: Values inside brackets that the driver looks at, at most, over all columns.
MOST_INSIDE = 400_000

Bracket = tuple[float, float]


def _stacked(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """(at, value): the given columns one below the other, without nulls."""
    return df.select(F.posexplode(F.array(*values)).alias("at", "value")).where("value is not null")


def _edge(brackets: Sequence[Sequence[float]]) -> Column:
    """The literal of the column that a stacked value came from."""
    return F.get(F.array(*[F.array(*[F.lit(x) for x in b]) for b in brackets]), F.col("at"))


def _ranks(count: int, p: float) -> tuple[int, int]:
    at = p * (count - 1)
    return math.floor(at), math.ceil(at)


def _sketched(stacked: DataFrame, width: int, wanted: Sequence[Sequence[float]], inside: Sequence[Sequence[Bracket]] | None) -> dict[int, tuple[int, list[list[float]]]]:
    """Per column: how many values, and the values near the wanted shares of what lies between the ends of each bracket (of all values without brackets)."""
    places = len(wanted[0])
    near = []
    for k in range(places):
        x = F.col("value")
        if inside is not None:
            low, high = (_edge([[b[k][side]] for b in inside])[0] for side in (0, 1))
            x = F.when((x > low) & (x < high), x)
        shares = sorted({w for column in wanted for w in column[k]})
        near.append((shares, F.percentile_approx(x, F.array(*[F.lit(s) for s in shares]), F.lit(ACCURACY))))
    rows = stacked.groupBy("at").agg(F.count("value").alias("n"), *[q.alias(f"q{k}") for k, (_, q) in enumerate(near)]).collect()  # one row per column
    out = {}
    for r in rows:
        found = [dict(zip(shares, r[f"q{k}"])) if r[f"q{k}"] else {} for k, (shares, _) in enumerate(near)]
        out[r["at"]] = (r["n"], [[found[k].get(s) for s in wanted[r["at"]][k]] for k in range(places)])
    return out


def _disjoint(brackets: Sequence[Bracket]) -> list[Bracket]:
    """The same values covered by brackets that do not touch."""
    out: list[Bracket] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _counted(stacked: DataFrame, brackets: Sequence[Sequence[Bracket]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per column: values in order with how often each occurs; NaN stands for all values between two brackets."""
    most = max(map(len, brackets))
    # missing brackets lie where no number is
    flat = [[x for b in [*column, *[(math.inf, math.inf)] * (most - len(column))] for x in b] for column in brackets]
    edges = stacked.withColumn("edges", _edge(flat))
    x, e = F.col("value"), F.col("edges")
    zone, inside = F.lit(0), F.lit(False)
    for k in range(most):
        zone = zone + (x > e[2 * k + 1]).cast("int")
        inside = inside | x.between(e[2 * k], e[2 * k + 1])
    folded = edges.select("at", zone.alias("zone"), F.when(inside, x).alias("value")).groupBy("at", "zone", "value").agg(F.count(F.lit(1)).alias("n"))
    got = folded.toArrow()  # a row per zone and per value inside, see _most_inside
    at, zones, counts = (got.column(c).to_numpy() for c in ("at", "zone", "n"))
    values = got.column("value").to_numpy(zero_copy_only=False).astype(float)
    # the values between two brackets come before those of the next one
    order = np.lexsort((np.where(np.isnan(values), -math.inf, values), zones, at))
    out = {}
    for k in np.unique(at):
        rows = order[at[order] == k]
        out[int(k)] = (values[rows], counts[rows])
    return out


def _picked(values: np.ndarray, counts: np.ndarray, p: float) -> float | None:
    """The interpolated quantile, or None if a rank lies between the brackets."""
    upto = np.cumsum(counts)
    low, high = (float(values[np.searchsorted(upto, rank, side="right")]) for rank in _ranks(int(upto[-1]), p))
    if math.isnan(low) or math.isnan(high):
        return None
    part = p * (int(upto[-1]) - 1) - _ranks(int(upto[-1]), p)[0]
    return low if low == high else (1 - part) * low + part * high


def _shares(ranks: Sequence[int], count: int, margin: float) -> list[float]:
    """Shares of ``count`` values between which the ranks lie, whatever the sketch makes of them."""
    top = max(1, count - 1)
    return [min(1.0, max(0.0, ranks[0] / top - margin)), max(0.0, min(1.0, ranks[1] / top + margin))]


def _proposed(df: DataFrame, stacked: DataFrame, values: Sequence[Column], probabilities: Sequence[float]) -> tuple[float, list, dict]:
    """Margin, wanted shares and first sketch: of a sample, or of all rows if that left a column with few values."""

    def around(margins: Sequence[float]) -> list[list[list[float]]]:
        ends = [[*[max(0.0, p - m) for m in margins], *[min(1.0, p + m) for m in margins]] for p in probabilities]
        return [ends for _ in values]

    sampled = _sketched(_stacked(df.sample(SAMPLE, 11), values), len(values), around(MARGINS), None)
    least = min([sampled.get(k, (0,))[0] for k in range(len(values))])
    if least < SAMPLED:
        margin = 2.0 / ACCURACY
        return margin, around([margin]), _sketched(stacked, len(values), around([margin]), None)
    # the error of the sketch, and four deviations of a rank in the sample
    at = next((i for i, m in enumerate(MARGINS) if m >= 2.0 / ACCURACY + 2.0 / math.sqrt(least)), len(MARGINS) - 1)
    near = {k: (round(n / SAMPLE), [[ends[at], ends[at + len(MARGINS)]] for ends in places]) for k, (n, places) in sampled.items()}
    return MARGINS[at], around([MARGINS[at]]), near


def sketch_shares(probabilities: Sequence[float]) -> list[list[float]]:
    """The two shares around each probability that a sketch of all rows should tell."""
    margin = 2.0 / ACCURACY
    return [[max(0.0, p - margin), min(1.0, p + margin)] for p in probabilities]


def selected_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    probabilities: Sequence[float],
    most_inside: int = MOST_INSIDE,
    sketched: Mapping[int, tuple[int, list[list[float]]]] | None = None,
) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of double columns; None where a column has no values.

    Takes two scans of the columns for tables up to some ten million rows, and two more
    for each further factor of some hundred, as brackets are narrowed in turn. A bracket
    is narrow enough when few values lie between its ends; values equal to an end are
    one value, however many there are, so ties do not keep it wide. A caller that has been
    over all rows already gives what it ``sketched``: per place of a column, how many values
    and those at ``sketch_shares``; that saves the first scan.
    """
    names, places = list(values), range(len(probabilities))
    stacked = _stacked(df, [values[n] for n in names])
    out: dict[str, list[float | None]] = {n: [None] * len(probabilities) for n in names}
    enough = max(100, most_inside // max(1, len(names) * len(probabilities)))
    if sketched is None:
        margin, wanted, near = _proposed(df, stacked, [values[n] for n in names], probabilities)
    else:
        margin, wanted, near = 2.0 / ACCURACY, [sketch_shares(probabilities) for _ in names], dict(sketched)
    # from a sample these are estimates; what is decided by ranks counts first
    counts = {k: n for k, (n, _) in near.items() if n}
    if not counts:
        return out
    whole: Bracket = (-math.inf, math.inf)
    brackets = [[whole] * len(probabilities) for _ in names]
    # values below a bracket, in it, below what lies between its ends, and between its ends
    held = [[(0, counts.get(k, 0), 0, counts.get(k, 0))] * len(probabilities) for k in range(len(names))]

    def narrower() -> list[list[list[float]]]:
        return [[_shares([r - h[2] for r in _ranks(counts.get(k, 1), p)], h[3], margin) for h, p in zip(held[k], probabilities)] for k in range(len(names))]

    while True:
        for k in counts:
            for j in places:
                low, high = near[k][1][j]
                if low is not None and high is not None:
                    brackets[k][j] = (brackets[k][j][0] if wanted[k][j][0] <= 0 else low, brackets[k][j][1] if wanted[k][j][1] >= 1 else high)
        if any(2 * (margin + 1 / ACCURACY) * held[k][j][3] > enough for k in counts for j in places):
            missed = False
            for k, (counts[k], found) in _between(stacked, brackets).items():
                for j, p in enumerate(probabilities):
                    below, inside, _, _ = held[k][j] = found[j]
                    first, last = _ranks(counts[k], p)
                    if not below <= first <= last < below + inside:
                        brackets[k][j], held[k][j], missed = whole, (0, counts[k], 0, counts[k]), True
            margin = min(0.2, 8 * margin) if missed else 2.0 / ACCURACY
            if any(held[k][j][3] > enough for k in counts for j in places):
                wanted = narrower()
                near = _sketched(stacked, len(names), wanted, brackets)
                continue
        missed = False
        for k, (ordered, times) in _counted(stacked, [_disjoint(b) for b in brackets]).items():
            counts[k] = int(times.sum())
            for j, p in enumerate(probabilities):
                out[names[k]][j] = _picked(ordered, times, p)
                missed = missed or out[names[k]][j] is None
        if not missed:
            return out
        # once more from the beginning, with wider brackets
        margin = min(0.2, 8 * margin)
        brackets = [[whole] * len(probabilities) for _ in names]
        held = [[(0, counts.get(k, 0), 0, counts.get(k, 0))] * len(probabilities) for k in range(len(names))]
        wanted = narrower()
        near = _sketched(stacked, len(names), wanted, brackets)


def _between(stacked: DataFrame, brackets: Sequence[Sequence[Bracket]]) -> dict[int, tuple[int, list[tuple[int, int, int, int]]]]:
    """Per column: how many values, and for each bracket how many lie below it, in it, up to its lower end, and between its ends."""
    edges = stacked.withColumn("edges", _edge([[x for b in column for x in b] for column in brackets]))
    x, e = F.col("value"), F.col("edges")
    sums = []
    for j in range(len(brackets[0])):
        low, high = e[2 * j], e[2 * j + 1]
        sums.append(F.struct(F.count_if(x < low), F.count_if(x.between(low, high)), F.count_if(x <= low), F.count_if((x > low) & (x < high))).alias(f"b{j}"))
    return {r["at"]: (r["n"], [tuple(r[f"b{j}"]) for j in range(len(brackets[0]))]) for r in edges.groupBy("at").agg(F.count(x).alias("n"), *sums).collect()}  # one row per column
