"""Registered queries: evaluation (E1-E5, K11, E2/Q8 re-aimed)."""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import functions as F

from divaug.functions.hashing import h24
from divaug.operators import dynamics as D
from divaug.operators import evaluation as EV
from divaug.operators import sampling as SM
from divaug.operators import training as TR
from divaug.plans import sqlparts as S
from divaug.plans.q_coreset import CB_SQL, CCS_SQL
from divaug.plans.q_dynamics import SCORES
from divaug.plans.registry import register
from divaug.plans.selection import coreset_splits
from divaug.functions.vectors import rnd
from divaug.session import shared_path
from divaug.sources import catalog as CT
from divaug.sources import commits as CM
from divaug.sources import fixtures as FX

HELD_OUT = 5   # every fifth row by hash is test
EVAL_SPLITS = ["reduced_800", "el2n_top_2_3", "entropy_top_2_3", "variance_top_2_3", "ccs_aum_top_2_3"]
SEED_FROM, SEED_TO = FX.EVAL_SEEDS[0], FX.EVAL_SEEDS[-1] + 1
HELD_SQL = S.h24("concat_ws(':', 'test', sample_id)") + f" % {HELD_OUT} = 0"


def e2_sql(train: str, test: str) -> list[str]:
    """CTEs ending in e2_pred(split, seed, sample_id, label, pred)."""
    return ["""e2_cent AS (
  SELECT split, seed, label, list(v ORDER BY d) AS center FROM (
    SELECT split, seed, label, d, sum(w * vec[d]) / sum(w) AS v FROM (
      SELECT split, label, vec, sd.seed, unnest(generate_series(1, len(vec))) AS d,
             -ln((""" + S.h24("concat_ws(':', sd.seed, sample_id)") + f""" + 1) / 16777216.0::DOUBLE) AS w
      FROM {train} CROSS JOIN range({SEED_FROM}, {SEED_TO}) sd(seed))
    GROUP BY split, seed, label, d) GROUP BY split, seed, label)""", f"""e2_pred AS (
  SELECT c.split, CAST(c.seed AS INTEGER) AS seed, r.sample_id, any_value(r.label) AS label,
         arg_min(c.label, {{'d': list_sum(list_transform(list_zip(r.vec, c.center), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 'l': c.label}}) AS pred
  FROM {test} r CROSS JOIN e2_cent c GROUP BY c.split, c.seed, r.sample_id)"""]


# Training sets: the reduction and the coresets that the selection steps draw
# from the training rows; test: the held-out rows.
ACC_SQL = [S.FX_VEC.replace("fx_vec AS (", "fx_all AS (", 1), f"fx_flag AS (SELECT *, {HELD_SQL} AS held FROM fx_all)",
           "fx_vec AS (SELECT sample_id, label, vec, split FROM fx_flag WHERE NOT held)", "fx_test AS (SELECT * FROM fx_flag WHERE held)"] \
    + CB_SQL[1:] + CCS_SQL[len(SCORES):] + [f"""ev_train AS (
  SELECT 'reduced_800' AS split, sample_id, label, vec
  FROM (SELECT *, row_number() OVER (ORDER BY {S.seeded_key(42)}, sample_id) AS pos FROM fx_vec) WHERE pos <= 800
  UNION ALL SELECT c.key || '_top_2_3', v.sample_id, v.label, v.vec FROM cbr c JOIN fx_vec v USING (sample_id)
            WHERE c.rank <= floor(c.n_label * {S.dbl(Fraction(2, 3))})
  UNION ALL SELECT 'ccs_aum_top_2_3', v.sample_id, v.label, v.vec FROM sel_23 JOIN fx_vec v USING (sample_id))"""] \
    + e2_sql("ev_train", "fx_test") + ["""acc AS (
  SELECT split, seed, round(avg(CAST(pred = label AS DOUBLE)), 6) AS accuracy FROM e2_pred GROUP BY split, seed)"""]


def held_out():
    return h24(F.concat(F.lit("test:"), F.col("sample_id").cast("string"))) % HELD_OUT == 0


def acc_df(spark, sf):
    """Accuracy of the classifiers of every training set and seed."""
    v = FX.fx_vec(spark, sf).drop("split")
    train, test = v.filter(~held_out()), v.filter(held_out())
    drawn = coreset_splits(D.score_table(FX.fx_dynamics(spark, sf, vecs=train))).filter(F.col("split").endswith("_top_2_3"))
    first = SM.nested_sample(train.select("sample_id"), (800,)).select("sample_id", F.lit("reduced_800").alias("split"))
    sets = drawn.select("sample_id", F.regexp_replace("split", "^coreset_", "").alias("split")).unionByName(first)
    return EV.accuracy(EV.split_seed_predictions(sets.join(train, "sample_id"), test, EVAL_SPLITS, FX.EVAL_SEEDS))


@register("accuracy", S.with_(ACC_SQL, "SELECT split, seed, accuracy FROM acc"))
def accuracy(spark, sf):
    return acc_df(spark, sf)


@register("seed_summary", S.with_(ACC_SQL, """
SELECT split, round(avg(accuracy), 4) AS avg, round(stddev_samp(accuracy), 4) AS std FROM acc GROUP BY split"""))
def seed_summary(spark, sf):
    return EV.seed_summary(acc_df(spark, sf))


@register("performance_matrix", S.with_(ACC_SQL + ["""plong AS (
  SELECT CAST(seed AS VARCHAR) AS row_key, split, accuracy AS value FROM acc
  UNION ALL SELECT 'avg', split, round(avg(accuracy), 4) FROM acc GROUP BY split
  UNION ALL SELECT 'std', split, round(stddev_samp(accuracy), 4) FROM acc GROUP BY split)"""],
    "SELECT row_key, " + ", ".join(f"max(value) FILTER (WHERE split = '{s}') AS \"{s}\"" for s in EVAL_SPLITS)
    + " FROM plong GROUP BY row_key"))
def performance_matrix(spark, sf):
    return EV.performance_matrix(acc_df(spark, sf), EVAL_SPLITS)


@register("best_coreset_key", S.with_(ACC_SQL + ["""bk AS (
  SELECT 'embeddings' AS dataset, regexp_replace(split, '_top_2_3$', '') AS key, avg(accuracy) AS avg_acc
  FROM acc WHERE split LIKE '%\\_top\\_2\\_3' ESCAPE '\\' GROUP BY split)"""], """
SELECT dataset, arg_max(key, round(avg_acc, 12)) AS best_key, round(max(avg_acc), 6) AS best_avg FROM (
  SELECT * FROM bk QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY round(avg_acc, 12) DESC, key) = 1)
GROUP BY dataset"""))
def best_coreset_key(spark, sf):
    a = acc_df(spark, sf).withColumn("dataset", F.lit("embeddings"))
    return EV.best_key(a)


def _used(spark):
    return CT.active_splits(spark, ["ori", "cst", "aug"], None)


@register("missing_splits", S.with_([S.FX_VEC, S.FX_TEXT], """
SELECT split FROM (VALUES """ + ", ".join(f"('{s}')" for s in
                                          ["reduced_800", "el2n_top_2_3", "entropy_top_2_3", "variance_top_2_3",
                                           "ccs_aum_top_2_3", "dpo_d"]) + """) u(split)
WHERE split NOT IN (SELECT split FROM fx_vec UNION SELECT split FROM fx_text)"""))
def missing_splits(spark, sf):
    data = FX.fx_vec(spark, sf).select("split").unionByName(FX.fx_text(spark, sf).select("split"))
    return EV.missing_splits(_used(spark).select("split"), data)


@register("split_seed_eval", S.with_([S.FX_VEC, f"e2_train AS (SELECT * FROM fx_vec WHERE NOT ({HELD_SQL}))",
                                     f"e2_test AS (SELECT * FROM fx_vec WHERE {HELD_SQL})"] + e2_sql("e2_train", "e2_test"), """
SELECT split, seed, round(avg(CAST(pred = label AS INT)), 6) AS accuracy FROM e2_pred GROUP BY split, seed"""))
def split_seed_eval(spark, sf):
    """E2 re-aimed: per split x seed (37..46) a weighted nearest-centre
    classifier on the split's training rows, scored on the held-out rows."""
    v = FX.fx_vec(spark, sf)
    return EV.split_seed_accuracy(v.filter(~held_out()), v.filter(held_out()), FX.VEC_SPLITS, FX.EVAL_SEEDS)


@register("dynamics_log_ml", S.with_([S.FX_VEC] + TR.oracle_ctes(), """
SELECT sample_id, epoch, iteration, label, CAST(k AS INTEGER) AS k, round(logp, 6) AS logp FROM sm_log"""))
def dynamics_log_ml(spark, sf):
    """Q8 re-aimed: one mini-batch softmax run over the vectors, its
    log-probabilities at the end of each epoch."""
    log = CM.EpochLog(spark, shared_path(spark, "divaug-runs", f"trainlog-{uuid.uuid4().hex}"))
    TR.train_log(FX.fx_vec(spark, sf), log)
    return log.read().select("sample_id", "epoch", "iteration", "label", F.posexplode("logp").alias("k", "logp")).withColumn("logp", rnd("logp", 6))
