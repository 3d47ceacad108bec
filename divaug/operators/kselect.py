"""The k-th least row of a group without sorting the group.

``last_rows`` finds, for each (group, tag), the row at place k in an order of
columns.  A round counts the rows between two bounds in 256 equal cells and
keeps the cell that holds place k, so the candidates of a group of n rows fit
in a task after about log256(n / 1,024) scans; those few are ordered exactly.
What leaves a scan is one row for each wanted cell, summed before the shuffle.

A draw of the k least rows is then a comparison with a table of one row for
each (group, tag), which is broadcast: its size is that of ``wanted``, a
parameter of the call.  Ranks of all rows are neither computed nor needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 256
FEW = 1024   # rows of a group that are ordered in one task


def key_number(hash_col: str) -> Column:
    """The first 52 bits of a hex digest: a double in the digest's order."""
    return F.conv(F.substring(hash_col, 1, 13), 16, 10).cast("double")


def value_numbers(value: str | Column, descending: bool) -> list[Column]:
    """Numbers in the order of ``value`` with nulls last: NaN is the greatest."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    place = F.when(v.isNull(), 2).when(F.isnan(v), -1 if descending else 1).otherwise(0).cast("double")
    return [place, F.when(place == 0, -v if descending else v).otherwise(F.lit(0.0))]


def _cell(c: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.floor((c - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1)).cast("int")


def spans(rows: DataFrame, group: str, numbers: Sequence[Column]) -> DataFrame:
    """(group, _n, the least and the greatest of each number): where a search
    starts.  A caller that needs the sizes anyway hands it to ``thresholds``."""
    ends = [f(n).alias(f"_{e}{i}") for i, n in enumerate(numbers) for e, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *ends)


def last_rows(rows: DataFrame, wanted: DataFrame, group: str, numbers: Sequence[Column], order: Sequence[str],
              start: DataFrame | None = None) -> list[Row]:
    """``wanted`` (group, tag, k) -> (group, tag, last): ``last`` is the struct
    of the ``order`` columns of the k-th row of its group, that of the last row
    where the group has fewer, and absent where k < 1 or the group is empty.
    The result is as small as ``wanted``.

    ``numbers`` are doubles without nulls whose lexicographic order agrees with
    that of ``order`` (they may tie where ``order`` does not)."""
    m = len(numbers)
    x = rows.select(group, *order, *[n.alias(f"_x{i}") for i, n in enumerate(numbers)])
    ends = [f(f"_x{i}").alias(f"_{e}{i}") for i in range(m) for e, f in (("lo", F.min), ("hi", F.max))]
    start = spans(rows, group, numbers) if start is None else start
    spark = rows.sparkSession
    # one row for each (group, tag): the state of the search
    state = wanted.join(start, group).select(group, "tag", F.least("k", "_n").cast("long").alias("k"), "_n", *[f"_{e}{i}" for i in range(m) for e in ("lo", "hi")])
    schema = state.schema
    found = [r for r in state.collect() if r["k"] >= 1]
    inside = lambda cols: F.lit(True) if not cols else cols[0] & inside(cols[1:])

    def candidates(todo: list) -> DataFrame:
        bounds = F.broadcast(spark.createDataFrame(todo, schema))
        return x.join(bounds, group).filter(inside([F.col(f"_x{i}").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(m)]))

    done = []
    while found:
        done += [r for r in found if r["_n"] <= FEW or all(r[f"_lo{i}"] == r[f"_hi{i}"] for i in range(m))]
        todo = [r for r in found if r not in done]
        if not todo:
            break
        at = F.coalesce(*[F.when(F.col(f"_lo{i}") < F.col(f"_hi{i}"), _cell(F.col(f"_x{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}"))) for i in range(m)])
        cells = candidates(todo).withColumn("_at", at).groupBy(group, "tag", "k", "_at").agg(F.count(F.lit(1)).alias("_n"), *ends)
        before = F.sum("_n").over(Window.partitionBy(group, "tag").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
        hit = (cells.withColumn("_before", F.coalesce(before, F.lit(0)))
                    .filter((F.col("_before") < F.col("k")) & (F.col("k") <= F.col("_before") + F.col("_n")))
                    .withColumn("k", F.col("k") - F.col("_before")))
        found = hit.select(*schema.names).collect()
    if not done:
        return []
    # equal rows are one row with a count, so repeated ids do not gather either
    few = candidates(done).groupBy(group, "tag", "k", F.struct(*order).alias("last")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group, "tag").orderBy("last"))
    ends_at = few.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("k")) & (F.col("_upto") - F.col("_n") < F.col("k")))
    return ends_at.select(group, "tag", "last").collect()


def thresholds(rows: DataFrame, wanted: DataFrame, group: str, numbers: Sequence[Column], order: Sequence[str],
               start: DataFrame | None = None) -> DataFrame:
    """``last_rows`` as a local table (group, tag, last)."""
    last = rows.select(F.struct(*order).alias("last")).schema["last"]
    found = last_rows(rows, wanted, group, numbers, order, start)
    return rows.sparkSession.createDataFrame(found, T.StructType([*wanted.select(group, "tag").schema.fields, last]))


def draw(rows: DataFrame, last: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The rows of each (group, tag) up to its threshold, with their tag."""
    return rows.join(F.broadcast(last), group).filter(F.struct(*order) <= F.col("last")).drop("last")
