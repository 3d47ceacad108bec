from pyspark.sql import Window
from pyspark.sql import functions as F

from divaug.operators.ranking import rank_within


def _window_ranks(df, groups, order):
    w = Window.partitionBy(*groups).orderBy(*order) if groups else Window.orderBy(*order)
    return df.withColumn("r2", F.row_number().over(w))


def test_rank_within_equals_window_with_skewed_groups(spark):
    # one group holds two thirds of the rows
    df = spark.range(0, 6000).withColumn("g", F.when(F.col("id") % 3 == 0, 1).otherwise(0)) \
        .withColumn("s", (F.col("id") * 7919) % 13)
    order = [F.col("s").desc(), F.col("id").asc()]
    r = rank_within(df, order, ["g"], count_name="n")
    w = _window_ranks(df, ["g"], order).withColumn("n2", F.count("*").over(Window.partitionBy("g")))
    bad = r.join(w, "id").filter("rank != r2 or n != n2").count()
    assert bad == 0
    assert r.count() == 6000


def test_rank_within_global_and_null_groups(spark):
    df = spark.range(0, 500).withColumn("g", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.lit(1)))
    r = rank_within(df, [F.col("id").asc()], ["g"])
    w = _window_ranks(df, ["g"], [F.col("id").asc()])
    assert r.count() == 500
    assert r.join(w, "id").filter("rank != r2").count() == 0
    g = rank_within(df, [F.col("id").desc()], [])
    assert sorted(x[0] for x in g.select("rank").collect()) == list(range(1, 501))


def test_rank_independent_of_partitioning(spark):
    df = spark.range(0, 1000).withColumn("s", F.col("id") % 7)
    a = rank_within(df.repartition(1), [F.col("s"), F.col("id")], [], num_partitions=1)
    b = rank_within(df.repartition(8), [F.col("s"), F.col("id")], [], num_partitions=8)
    assert a.join(b.withColumnRenamed("rank", "rb"), "id").filter("rank != rb").count() == 0
