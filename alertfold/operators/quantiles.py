"""Exact quantiles of large columns by distributed selection.

The wanted ranks are narrowed down level by level: the range in which a rank lies is cut into equal cells, the values
are counted per cell where they are, and the cell that holds the rank, with its own smallest and largest value, is the
next range. Once a range holds few different values they are put in order. No task ever sorts a column, and the driver gets
one row per wanted rank and level.
"""

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

CELLS = 4096
FEW = 200_000  # different values that one task may put in order


def _local(spark: SparkSession, rows: list[tuple], row_type: str) -> DataFrame:
    """A few rows as literals of the plan, without a job of their own."""
    literals = [F.struct(*[F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in row]).cast(row_type) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*literals).cast(f"array<{row_type}>")))


def _in_ranges(counts: DataFrame, ranges: list[tuple]) -> DataFrame:
    """Value counts that lie in a wanted range, once per range: target, rank, lo, hi, value, n."""
    wanted = _local(counts.sparkSession, ranges, "struct<target:int,series:string,rank:bigint,lo:double,hi:double>")
    return counts.join(F.broadcast(wanted), "series").where(F.col("value").between(F.col("lo"), F.col("hi")))


def _narrowed(counts: DataFrame, ranges: list[tuple]) -> dict[int, tuple]:
    """``{target: (rows before, lo, hi, different values)}`` of the cell that holds each target's rank."""
    # Halves keep the width of a range finite.
    unit = (F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    cell = F.when(F.col("lo") < F.col("hi"), F.least(F.floor(unit * CELLS), F.lit(CELLS - 1))).otherwise(0)
    cells = _in_ranges(counts, ranges).groupBy("target", "rank", cell.alias("cell")).agg(
        F.sum("n").alias("n"), F.count("*").alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    upto = F.sum("n").over(Window.partitionBy("target").orderBy("cell"))  # at most CELLS rows per target
    hit = cells.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return {r.target: (r.upto - r.n, r.lo, r.hi, r.d) for r in hit.collect()}


def exact_quantiles(
    counts: DataFrame, shares: list[float], series: str | None = None, value: str = "value", n: str = "n",
    few: int = FEW,
) -> DataFrame:
    """Quantiles from value counts, between neighbours by linear interpolation: the column ``q``, in the order of ``shares``.

    With ``series`` one row for each of its values (there should be few, such as feature names), else exactly one row, with
    a null ``q`` if there are no values. Null values don't count; values must be finite. ``counts`` is read once per level,
    so it should be a stored table.
    """
    spark, name = counts.sparkSession, series or "series"
    label = F.col(series).cast("string") if series else F.lit("")
    counts = counts.select(label.alias("series"), F.col(value).cast("double").alias("value"), F.col(n).cast("long").alias("n")).where(
        F.col("value").isNotNull())
    shape = {r.series: r for r in counts.groupBy("series").agg(
        F.sum("n").alias("n"), F.count("*").alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    places = {(s, q): (r.n - 1) * q for s, r in shape.items() for q in shares}
    ranks = sorted({(s, k) for (s, _), x in places.items() for k in (math.floor(x), math.ceil(x))})
    ranges = [(i, s, k, float(shape[s].lo), float(shape[s].hi)) for i, (s, k) in enumerate(ranks)]
    wide = {i for i, s, *_ in ranges if shape[s].d > few}
    while wide:
        found = _narrowed(counts, [r for r in ranges if r[0] in wide])
        for i, (before, lo, hi, different) in found.items():
            target, s, rank, *old = ranges[i]
            ranges[i] = (target, s, rank - before, lo, hi)
            if different <= few or [lo, hi] == old:
                wide.discard(i)
    picked = {}
    if ranges:
        upto = F.sum("n").over(Window.partitionBy("target").orderBy("value"))
        few_values = _in_ranges(counts, ranges).groupBy("target", "rank", "value").agg(F.sum("n").alias("n"))
        rows = few_values.withColumn("upto", upto).where(
            (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        picked = {ranks[r.target]: r.value for r in rows.select("target", "value").collect()}

    def quantile(s: str, x: float) -> float:
        low, high = math.floor(x), math.ceil(x)
        return picked[s, low] if low == high else (high - x) * picked[s, low] + (x - low) * picked[s, high]

    rows = [(s, [quantile(s, places[s, q]) for q in shares]) for s in shape]
    if series is None:
        return _local(spark, [(rows[0][1] if rows else None,)], "struct<q:array<double>>")
    return _local(spark, rows, f"struct<`{name}`:string,q:array<double>>")
