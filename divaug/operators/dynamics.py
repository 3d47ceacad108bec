"""Training-dynamics scores from a log of per-epoch log-probabilities.

Input log: ``sample_id, epoch, iteration, label, logp ARRAY<DOUBLE>`` (one row
per sample and checkpoint).  All scores of a sample come out of one shuffle on
``sample_id``: the forgetting window and the aggregation share the same
partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from divaug.functions import vectors as V

ROUND = 6
EL2N_MAX_EPOCH = 2   # fixed value: EL2N sums epochs < 2


def with_record_stats(log: DataFrame) -> DataFrame:
    """Per log row: probs, prediction, correctness, p[label], margin, error norm."""
    p = V.exp_array("logp")
    return (log.withColumn("p", p)
               .withColumn("pred", V.argmax("p"))
               .withColumn("ok", (F.col("pred") == F.col("label")).cast("int"))
               .withColumn("p_label", V.at("p", F.col("label")))
               .withColumn("margin", V.margin("p", F.col("label")))
               .withColumn("err", V.error_l2("p", F.col("label"))))


def final_metrics(logp_col, label_col) -> dict:
    """Q6: entropy, loss, confidence from final-model log-probabilities."""
    p = V.exp_array(logp_col)
    return {
        "entropy": V.entropy(p),
        "loss": -V.at(logp_col, label_col),
        "confidence": V.at(p, label_col),
    }


def score_table(log: DataFrame, max_epoch: int = EL2N_MAX_EPOCH, pad_to: int | None = None) -> DataFrame:
    """Q7: one row per sample with all reference scores.

    correctness, last_correctness, forgetting (1->0 transitions, initial 0),
    accumulated_margin, variance (population std of p[label] over the history,
    padded with 1.0 up to ``pad_to`` records when given), el2n (sum of error
    norms over epochs < max_epoch), entropy/loss/confidence of the last record.
    """
    # A record repeated for the same (epoch, iteration) counts once.  The
    # repeat is found with lag() over the same window on sample_id that the
    # forgetting count uses, so no extra shuffle is added.
    wd = Window.partitionBy("sample_id").orderBy("epoch", "iteration", "logp")
    log = (log.withColumn("_rep", (F.lag("epoch").over(wd) == F.col("epoch"))
                          & (F.lag("iteration").over(wd) == F.col("iteration")))
              .filter(~F.coalesce(F.col("_rep"), F.lit(False))).drop("_rep"))
    x = with_record_stats(log)
    w = Window.partitionBy("sample_id").orderBy("epoch", "iteration")
    x = x.withColumn("_forget", ((F.lag("ok", 1, 0).over(w) == 1) & (F.col("ok") == 0)).cast("int"))
    order = F.struct("epoch", "iteration")
    agg = x.groupBy("sample_id").agg(
        F.max("label").alias("label"),
        F.count(F.lit(1)).alias("n_records"),
        F.sum("ok").cast("bigint").alias("correctness"),
        F.max_by("ok", order).alias("last_correctness"),
        F.sum("_forget").cast("bigint").alias("forgetting"),
        F.sum("margin").alias("accumulated_margin"),
        F.stddev_pop("p_label").alias("_std"),
        F.sum("p_label").alias("_s"),
        F.sum(F.col("p_label") * F.col("p_label")).alias("_q"),
        F.coalesce(F.sum(F.when(F.col("epoch") < max_epoch, F.col("err"))), F.lit(0.0)).alias("el2n"),
        F.max_by("logp", order).alias("_last_logp"))
    if pad_to is None:
        var = F.col("_std")
    else:
        n_pad = F.lit(pad_to) - F.col("n_records")
        s = F.col("_s") + n_pad
        q = F.col("_q") + n_pad
        var = F.when(F.col("n_records") >= pad_to, F.col("_std")).otherwise(
            F.sqrt(F.greatest(q / pad_to - (s / pad_to) * (s / pad_to), F.lit(0.0))))
    fm = final_metrics(F.col("_last_logp"), F.col("label"))
    return agg.select(
        "sample_id", "label", "n_records", "correctness", "last_correctness", "forgetting",
        "accumulated_margin", var.alias("variance"), "el2n",
        fm["entropy"].alias("entropy"), fm["loss"].alias("loss"),
        fm["confidence"].alias("confidence"))


def max_history(log: DataFrame) -> int:
    """Longest per-sample history (the padding target); a scalar."""
    r = log.groupBy("sample_id").count().agg(F.max("count")).first()[0]
    return int(r or 0)
