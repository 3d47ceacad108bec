import uuid

from pyspark.sql import functions as F

from divaug.operators import dynamics as D
from divaug.session import shared_path
from divaug.sources import fixtures as FX
from divaug.streaming import dynamics_stream as ST

SF = "/root/testdata/sf0.001"


def _run_incremental(spark, query_df, mode, order=(2, 0, 1)):
    src_log = FX.fx_dynamics(spark, SF).persist()
    src = shared_path(spark, "st-src-" + uuid.uuid4().hex)
    out = shared_path(spark, "st-out-" + uuid.uuid4().hex)
    ckpt = shared_path(spark, "st-ckpt-" + uuid.uuid4().hex)
    # the folder must exist before the stream starts
    src_log.limit(0).write.mode("overwrite").parquet(src)

    def sink(batch, bid):
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:
            batch.withColumn("_batch", F.lit(bid)).write.mode("append").parquet(out)
    stream = spark.readStream.schema(ST.LOG_SCHEMA).parquet(src)
    q = query_df(stream).writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", ckpt).start()
    try:
        for e in order:      # epochs arrive one at a time, out of order
            src_log.filter(F.col("epoch") == e).write.mode("append").parquet(src)
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(out), D.score_table(src_log)


def test_running_forgetting_out_of_order_equals_batch(spark):
    res, batch = _run_incremental(spark, ST.running_forgetting, "update")
    latest = ST.latest_rows(res)
    j = latest.join(batch.select("sample_id", F.col("forgetting").alias("fb"), F.col("correctness").alias("cb")), "sample_id")
    assert j.count() == batch.count()
    assert j.filter((F.col("forgetting") != F.col("fb")) | (F.col("correctness") != F.col("cb"))).count() == 0
    assert latest.filter(F.col("n_ep") != 3).count() == 0
    # more than one micro-batch really happened
    assert res.select("_batch").distinct().count() >= 2


def test_running_scores_equal_batch(spark):
    res, batch = _run_incremental(spark, ST.running_scores, "complete")
    j = res.join(batch.select("sample_id", F.col("accumulated_margin").alias("ab"), F.col("el2n").alias("eb"),
                              F.col("correctness").alias("cb")), "sample_id")
    assert j.count() == batch.count()
    bad = j.filter((F.abs(F.col("accumulated_margin") - F.col("ab")) > 1e-9) | (F.abs(F.col("el2n") - F.col("eb")) > 1e-9)
                   | (F.col("correctness") != F.col("cb")))
    assert bad.count() == 0
