"""Registered queries: vector scalars (V4-V8) and training-dynamics scores (Q1-Q7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from divaug.functions import vectors as V
from divaug.operators import dynamics as D
from divaug.plans import sqlparts as S
from divaug.plans.registry import register
from divaug.sources import fixtures as FX
from divaug.functions.vectors import rnd

R = 6
BASE = [S.FX_VEC, S.FX_CENT_ALL, S.FX_DYN]
SCORES = BASE + S.score_table()


def _scores(spark, sf):
    return D.score_table(FX.fx_dynamics(spark, sf))


@register("softmax_probs", S.with_(BASE, """
SELECT sample_id, epoch, CAST(k - 1 AS INTEGER) AS k, round(exp(logp[k]), 6) AS p
FROM (SELECT sample_id, epoch, logp, unnest(generate_series(1, len(logp))) AS k FROM fx_dyn)"""))
def softmax_probs(spark, sf):
    d = FX.fx_dynamics(spark, sf)
    return (d.select("sample_id", "epoch", F.posexplode(V.softmax("logp")).alias("k", "p"))
             .select("sample_id", "epoch", F.col("k").cast("int").alias("k"), rnd("p", R).alias("p")))


@register("score_entropy", S.with_(BASE, """
SELECT sample_id, epoch, round(-list_sum(list_transform(logp, lambda x: exp(x) * ln(exp(x) + 1e-10))), 6) AS entropy
FROM fx_dyn"""))
def score_entropy(spark, sf):
    d = FX.fx_dynamics(spark, sf)
    return d.select("sample_id", "epoch", rnd(V.entropy(V.exp_array("logp")), R).alias("entropy"))


@register("score_loss", S.with_(BASE, """
SELECT sample_id, epoch, round(-logp[label + 1], 6) AS loss FROM fx_dyn"""))
def score_loss(spark, sf):
    d = FX.fx_dynamics(spark, sf)
    return d.select("sample_id", "epoch", rnd(-V.at("logp", F.col("label")), R).alias("loss"))


@register("score_confidence", S.with_(BASE, """
SELECT sample_id, epoch, round(exp(logp[label + 1]), 6) AS confidence FROM fx_dyn"""))
def score_confidence(spark, sf):
    d = FX.fx_dynamics(spark, sf)
    return d.select("sample_id", "epoch", rnd(V.at(V.exp_array("logp"), F.col("label")), R).alias("confidence"))


@register("correctness", S.with_(SCORES, """
SELECT sample_id, label, correctness, last_correctness FROM scores"""))
def correctness(spark, sf):
    return _scores(spark, sf).select("sample_id", "label", "correctness", "last_correctness")


@register("forgetting", S.with_(SCORES, "SELECT sample_id, forgetting FROM scores"))
def forgetting(spark, sf):
    return _scores(spark, sf).select("sample_id", "forgetting")


@register("aum", S.with_(SCORES, "SELECT sample_id, round(accumulated_margin, 6) AS accumulated_margin FROM scores"))
def aum(spark, sf):
    return _scores(spark, sf).select("sample_id", rnd("accumulated_margin", R).alias("accumulated_margin"))


@register("variance", S.with_(SCORES, "SELECT sample_id, round(variance, 6) AS variance FROM scores"))
def variance(spark, sf):
    return _scores(spark, sf).select("sample_id", rnd("variance", R).alias("variance"))


_PAD_SQL = S.with_(BASE + [S.FX_DYN_TRUNC] + S.score_table("fx_dyn_trunc", "scores_t",
                                                             pad_to="(SELECT max(c) FROM (SELECT count(*) AS c FROM fx_dyn_trunc GROUP BY sample_id))"),
                   "SELECT sample_id, n_records, round(variance, 6) AS variance FROM scores_t")


@register("variance_padded", _PAD_SQL)
def variance_padded(spark, sf):
    log = FX.fx_dynamics_truncated(spark, sf)
    t = D.score_table(log, pad_to=D.max_history(log))
    return t.select("sample_id", "n_records", rnd("variance", R).alias("variance"))


@register("el2n", S.with_(SCORES, "SELECT sample_id, round(el2n, 6) AS el2n FROM scores"))
def el2n(spark, sf):
    return _scores(spark, sf).select("sample_id", rnd("el2n", R).alias("el2n"))


@register("post_training_scores", S.with_(SCORES, """
SELECT sample_id, round(entropy, 6) AS entropy, round(loss, 6) AS loss, round(confidence, 6) AS confidence
FROM scores"""))
def post_training_scores(spark, sf):
    t = _scores(spark, sf)
    return t.select("sample_id", *[rnd(c, R).alias(c) for c in ("entropy", "loss", "confidence")])


SCORE_COLS_INT = ["sample_id", "label", "n_records", "correctness", "last_correctness", "forgetting"]
SCORE_COLS_DBL = ["accumulated_margin", "variance", "el2n", "entropy", "loss", "confidence"]


@register("score_table", S.with_(SCORES, "SELECT " + ", ".join(SCORE_COLS_INT) + ", "
                                 + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLS_DBL) + " FROM scores"))
def score_table(spark, sf):
    t = _scores(spark, sf)
    return t.select(*SCORE_COLS_INT, *[rnd(c, R).alias(c) for c in SCORE_COLS_DBL])
