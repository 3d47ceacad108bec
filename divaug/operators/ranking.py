"""Exact row numbers over few, possibly huge, groups without a one-task window.

``row_number() over (partition by g order by k)`` puts each group in a single
task; with few groups (labels, strata, categories, or the whole table) one task
would hold a third of the data.  ``rank_within`` computes the same numbers as
a distributed, JVM-only job:

1. range-partition on ``(g, k)`` (Spark samples the composite key, so a group
   larger than a partition is split across several partitions) and sort each
   partition;
2. tag each row with its partition and its position inside the sorted
   partition (``monotonically_increasing_id`` is exactly that position
   counter after a sort; it is never used as a row identity);
3. per (partition, group): first position and row count -> running offsets,
   a table of at most ``P + G`` rows, joined back as Spark sizes it;
4. rank = offset + (position - first position) + 1.

The tagged frame is persisted (MEMORY_AND_DISK): the per-partition counts and
the final join must read one materialisation.  A lost cached block is rebuilt
from the same lineage (same partitioner bounds, same total sort order), so
the positions are reproduced exactly.

The order must be total (end it with a unique id) for the result to be
deterministic; it then equals the window result exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from divaug.session import track


def rank_within(df: DataFrame, order: Sequence[Column], groups: Sequence[str] = (),
                name: str = "rank", count_name: str | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = row_number() over (partition by groups order by order).

    ``order`` is a list of sort Columns (``F.col('s').desc()`` ...) ending in a
    unique key.  ``count_name`` optionally adds the group size.  Use a plain
    partitioned window when groups are many and small.
    """
    spark = df.sparkSession
    groups = list(groups)
    p = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_exprs = [F.col(g).asc_nulls_first() for g in groups] + list(order)
    tagged = (df.repartitionByRange(p, *sort_exprs)
                .sortWithinPartitions(*sort_exprs)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_pos", F.monotonically_increasing_id()))
    tagged = track(tagged.persist(StorageLevel.MEMORY_AND_DISK))

    counts = tagged.groupBy("_pid", *groups).agg(F.min("_pos").alias("_first"),
                                                F.count(F.lit(1)).alias("_cnt"))
    wg = Window.partitionBy(*groups) if groups else Window.partitionBy()
    offsets = (counts
               .withColumn("_off", F.coalesce(F.sum("_cnt").over(
                   wg.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("_gcnt", F.sum("_cnt").over(wg))
               .withColumn("_off", F.col("_off").cast("long")).drop("_cnt"))
    o = offsets.select([F.col(c).alias(f"_o_{c}") for c in offsets.columns])
    cond = [F.col("_pid") == F.col("_o__pid")] + [F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in groups]
    res = tagged.join(o, on=cond, how="inner")
    res = res.withColumn(name, (F.col("_o__off") + (F.col("_pos") - F.col("_o__first")) + 1).cast("long"))
    if count_name:
        res = res.withColumn(count_name, F.col("_o__gcnt").cast("long"))
    return res.drop("_pid", "_pos", *[f"_o_{c}" for c in offsets.columns])
