"""Scans over long histories and ranks over large groups, as many tasks instead of one a key.

A history is cut into stretches of time.  Inside one a window works as usual; what it needs of the time before is
carried in from one row a stretch, scanned in order: the last value for as-of joins and runs, the sum for running totals.
Ranks come from counts of values: groups are cut at quantiles, counted piece by piece, and the counts of the pieces
before are added, which are a few rows a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a stretch in seconds: a month of hours is some hundred rows, one of minutes some ten thousand.
STRETCH = 30 * 86400
PART = "_part"


def cut(rows: DataFrame, at: str, stretch: int = STRETCH) -> DataFrame:
    return rows.withColumn(PART, F.floor(F.col(at) / stretch))


def _carried(rows: DataFrame, keys: Sequence[str], summary: Column, scan, name: str) -> DataFrame:
    """``rows`` with what ``scan`` makes of the summaries of all stretches before each row's own."""
    by = [*keys, PART]
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*by).agg(summary.alias("_s")).select(*by, scan(F.col("_s")).over(before).alias(name))
    return rows.join(carry, by, "left")


def last_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """``rows`` (with PART, see ``cut``) and the last non-null ``value`` at or before each row, or strictly before it, in ``order``."""
    rows = rows.withColumn("_v", value)
    place = F.when(F.col("_v").isNotNull(), F.struct(*order))
    rows = _carried(rows, keys, F.max_by("_v", place), lambda s: F.last(s, ignorenulls=True), "_c")
    own = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(own), F.col("_c"))).drop("_v", "_c")


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``rows`` (with PART) and the sum of ``value`` up to each row in ``order``."""
    rows = _carried(rows.withColumn("_v", value), keys, F.sum("_v"), F.sum, "_c")
    own = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce("_c", F.lit(0.0)) + F.sum("_v").over(own)).drop("_v", "_c")


# Ranks

#: Pieces that a group is cut into.
PIECES = 64


def value_ranks(rows: DataFrame, keys: Sequence[str], value: str, pieces: int = PIECES) -> DataFrame:
    """(keys, value, same, below, n): of each distinct value how many rows hold it, how many hold a smaller one, and the group's rows.

    Values are counted first, map-side; then their counts are summed inside pieces between quantiles, and the
    pieces' totals in a window of ``pieces`` rows.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("same"))
    edges = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)], 10 * pieces).alias("_cuts"))
    piece = F.size(F.filter("_cuts", lambda e: e < F.col(value)))
    dealt = counts.join(edges, [*keys]).withColumn("_piece", piece).drop("_cuts")
    inside = Window.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_in", F.coalesce(F.sum("same").over(inside), F.lit(0)))
    totals = dealt.groupBy(*keys, "_piece").agg(F.sum("same").alias("_total"))
    w = Window.partitionBy(*keys)
    offsets = totals.select(*keys, "_piece", F.coalesce(F.sum("_total").over(w.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_total").over(w).alias("n"))
    return dealt.join(offsets, [*keys, "_piece"]).select(*keys, value, "same", (F.col("_in") + F.col("_before")).alias("below"), "n")


def with_ranks(rows: DataFrame, keys: Sequence[str], value: str, pieces: int = PIECES) -> DataFrame:
    """``rows`` with ``same``, ``below`` and ``n`` of their ``value`` (not null) in their group."""
    return rows.join(value_ranks(rows, keys, value, pieces), [*keys, value])


def ordinal_ranks(rows: DataFrame, keys: Sequence[str], places: dict[str, str], order: str, pieces: int = PIECES) -> DataFrame:
    """``rows`` with a column for each of ``places`` (name: value): their place from 1 by the value and, where it ties, by ``order``.

    One pass finds approximate quantiles; rows are dealt to the pieces between them, and a value that fills pieces
    on its own is dealt on by the quantiles of ``order``.  Places inside a piece are a window's, before it those of the pieces'
    totals: exact, however the quantiles fall.  Values and orders aren't null.
    """
    at = [i / pieces for i in range(1, pieces)]
    cuts = {c: f"_cuts_{i}" for i, c in enumerate(dict.fromkeys([*places.values(), order]))}
    edges = rows.groupBy(*keys).agg(*(F.percentile_approx(c, at, 10 * pieces).alias(name) for c, name in cuts.items()))
    below = lambda c: F.size(F.filter(cuts[c], lambda e: e < F.col(c)))
    filled = lambda c: F.size(F.filter(cuts[c], lambda e: e == F.col(c))) > 1
    dealt = rows.join(edges, [*keys])
    for i, c in enumerate(places.values()):
        dealt = dealt.withColumn(f"_piece_{i}", F.struct(below(c).alias("a"), F.when(filled(c), 1 + below(order)).otherwise(0).alias("b")))
    dealt = out = dealt.drop(*cuts.values())
    for i, (name, c) in enumerate(places.items()):
        totals = dealt.groupBy(*keys, f"_piece_{i}").agg(F.count("*").alias("_total"))
        before = F.sum("_total").over(Window.partitionBy(*keys).orderBy(f"_piece_{i}").rowsBetween(Window.unboundedPreceding, -1))
        out = out.join(totals.select(*keys, f"_piece_{i}", F.coalesce(before, F.lit(0)).alias("_before")), [*keys, f"_piece_{i}"])
        out = out.withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(*keys, f"_piece_{i}").orderBy(c, order))).drop("_before")
    return out.select(*rows.columns, *places)
