"""Interval join: rows with a value meet the intervals that hold it.

``[lo, hi)`` intervals with arbitrary, also overlapping, edges.  The line is
cut into cells; an interval is listed under every cell that it touches, a row
under its own, so the join is an equality of cells and a comparison.  The cell
width is the median-sized interval's, so that a narrow interval is in one or
two cells; an interval that would be in more than ``most`` cells is
listed under coarser ones, as wide as it is: each level is its own equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CELLS = 8


def interval_join(rows: DataFrame, intervals: DataFrame, value: str, lo: str = "lo", hi: str = "hi", most: int = MOST_CELLS) -> DataFrame:
    """Inner join of ``rows`` and ``intervals`` on lo <= value < hi.  Null and
    NaN values, and intervals with a null edge or hi <= lo, meet nothing."""
    width = F.col(hi) - F.col(lo)
    real = intervals.filter(F.col(lo) < F.col(hi))
    base = real.agg(F.percentile_approx(width, 0.5)).first()[0]
    if base is None:
        return rows.join(intervals, F.lit(False))
    # level L has cells of base * most**L; an interval's level is the least at
    # which it touches most + 1 cells or fewer
    level = F.greatest(F.lit(0), F.ceil(F.log(width / F.lit(float(base))) / F.log(F.lit(float(most))) - 1)).cast("int")
    sized = real.withColumn("_level", level)
    levels = [r["_level"] for r in sized.select("_level").distinct().collect()]   # a handful: logs of widths
    cell = lambda x, n: F.floor(x / (F.lit(float(base)) * F.pow(F.lit(float(most)), n))).cast("long")
    listed = sized.withColumn("_cell", F.explode(F.sequence(cell(F.col(lo), F.col("_level")), cell(F.col(hi), F.col("_level")))))
    v = F.col(value)
    asked = (rows.filter(v.isNotNull() & ~F.isnan(v.cast("double")))
                 .withColumn("_level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)])))
                 .withColumn("_cell", cell(v, F.col("_level"))))
    return (asked.join(listed, ["_level", "_cell"]).filter((F.col(lo) <= v) & (v < F.col(hi))).drop("_level", "_cell"))
