"""End-to-end selection job (the reference's coreset step).

log -> score table (one shuffle on sample_id) -> class-balanced bands for every
key from one rank (one range shuffle) + CCS bands -> written per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.operators import coreset as K
from divaug.operators import dynamics as D
from divaug.sources import fixtures as FX
from divaug.functions.vectors import rnd
from divaug.session import stored


def flagship(spark: SparkSession, sf_dir: str, key: str = "variance") -> DataFrame:
    """Training-dynamics log -> score table -> class-balanced top-1/3 and
    mid-1/3 by ``key``: (sample_id, label, score, band)."""
    scores = D.score_table(FX.fx_dynamics(spark, sf_dir))
    b = K.class_balanced_bands(scores, key, bands=("top_1_3", "mid_1_3"))
    return b.select("sample_id", "label", rnd("score", 6).alias("score"), "band")


def coreset_splits(scores: DataFrame, keys=K.CORESET_KEYS) -> DataFrame:
    """All coreset splits of the reference: coreset_{key}_{band} for the score
    keys and coreset_ccs_aum_{band}; columns sample_id, label, split.

    The scores are written once.  All score keys are ranked by one range
    shuffle: the score table is melted to (key, sample_id, label, score) and
    ranked within (key, label)."""
    from divaug.operators.ranking import rank_within
    scores = stored(scores.select("sample_id", "label", *dict.fromkeys([*keys, K.MIS_KEY])), "scores")
    arr = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("score")) for k in keys])
    long = scores.select("sample_id", "label", F.explode(arr).alias("_ks")).select(
        F.col("_ks.key").alias("key"), "sample_id", "label", F.col("_ks.score").alias("score"))
    r = rank_within(long, [F.col("score").desc_nulls_last(), F.col("sample_id").asc()], ["key", "label"],
                    name="rank", count_name="n_label")
    bands = ["top_1_2", "top_1_3", "mid_1_3", "top_2_3"]
    cut = lambda r_: F.floor(F.col("n_label").cast("double") * F.lit(float(r_)))
    arr_b = F.array(*[F.when((F.col("rank") > cut(K.BANDS[b][0])) & (F.col("rank") <= cut(K.BANDS[b][1])),
                             F.lit(b)) for b in bands])
    cb = r.select("sample_id", "label", "key", F.explode(F.filter(arr_b, lambda x: x.isNotNull())).alias("band"))
    cb = cb.select("sample_id", "label", F.concat(F.lit("coreset_"), F.col("key"), F.lit("_"), F.col("band")).alias("split"))
    c = K.ccs_bands(scores)
    ccs = c.select("sample_id", "label", F.concat(F.lit("coreset_ccs_aum_"), F.col("band")).alias("split"))
    return cb.unionByName(ccs)
