"""Training-dynamics scores while the log arrives (ST1, ST2).

The log has no event time, so there is no watermark or time window; state is
bounded by samples x epochs.  Sinks write to shared storage with
``foreachBatch`` (no driver-held memory sink) and checkpoints live below
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divaug.operators import dynamics as D
from divaug.sources.commits import ChangedRows

LOG_SCHEMA = T.StructType([
    T.StructField("sample_id", T.LongType()), T.StructField("epoch", T.IntegerType()),
    T.StructField("iteration", T.IntegerType()), T.StructField("label", T.IntegerType()),
    T.StructField("logp", T.ArrayType(T.DoubleType()))])


def running_scores(stream: DataFrame, max_epoch: int = D.EL2N_MAX_EPOCH) -> DataFrame:
    """ST1: correctness, accumulated margin, EL2N per sample over the log
    seen so far; a record repeated for the same (epoch, iteration) counts
    once, as in the batch table."""
    x = D.with_record_stats(stream.dropDuplicates(["sample_id", "epoch", "iteration"]))
    return x.groupBy("sample_id").agg(
        F.sum("ok").cast("bigint").alias("correctness"),
        F.sum("margin").alias("accumulated_margin"),
        F.coalesce(F.sum(F.when(F.col("epoch") < max_epoch, F.col("err"))), F.lit(0.0)).alias("el2n"),
        F.count(F.lit(1)).alias("n_ep"))


def running_forgetting(stream: DataFrame) -> DataFrame:
    """ST2: 1->0 transitions and correct records per sample over the log seen
    so far.  The state is each sample's set of (epoch, iteration, ok), kept by
    a streaming aggregation; records that arrive out of order or twice give the
    batch answer."""
    x = D.with_record_stats(stream).select("sample_id", F.struct("epoch", "iteration", F.col("ok").cast("int").alias("ok")).alias("r"))
    h = x.groupBy("sample_id").agg(F.array_sort(F.collect_set("r")).alias("_h"))

    def first_of_its_step(r, i):
        before = F.get("_h", i - 1)
        return (i == 0) | (before["epoch"] != r["epoch"]) | ~before["iteration"].eqNullSafe(r["iteration"])
    h = h.withColumn("_h", F.filter("_h", first_of_its_step))
    lost = F.filter("_h", lambda r, i: (i > 0) & (F.get("_h", i - 1)["ok"] == 1) & (r["ok"] == 0))
    return h.select("sample_id", F.size("_h").alias("n_ep"), F.size(lost).cast("long").alias("forgetting"),
                    F.aggregate("_h", F.lit(0).cast("long"), lambda n, r: n + r["ok"]).alias("correctness"))


def run_to_table(spark: SparkSession, stream_df: DataFrame, out_path: str, ckpt: str,
                 mode: str = "update") -> DataFrame:
    """Drive a streaming query to completion (availableNow) into a table of
    changed rows, and read its last row of each sample.  In update mode a
    trigger writes the samples that it changed; a trigger that Spark runs again
    after a failure finds its batch there and writes nothing."""
    table = ChangedRows(spark, out_path)
    q = (stream_df.writeStream.outputMode(mode).foreachBatch(lambda batch, batch_id: table.write(batch, batch_id) and None)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return table.read()


def latest_rows(appended: DataFrame) -> DataFrame:
    """Last emitted row per sample from an update-mode append table."""
    cols = [c for c in appended.columns if c not in ("sample_id", "_batch")]
    return appended.groupBy("sample_id").agg(
        *[F.max_by(c, F.struct("n_ep", "_batch")).alias(c) for c in cols])
