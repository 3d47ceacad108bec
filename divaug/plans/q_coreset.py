"""Registered queries: coreset selection (K1-K9)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divaug.operators import coreset as K
from divaug.operators import dynamics as D
from divaug.operators.intervals import interval_join
from divaug.plans import sqlparts as S
from divaug.plans.q_dynamics import SCORES
from divaug.plans.registry import register
from divaug.session import stored
from divaug.sources import fixtures as FX


def scores_of(spark, sf) -> DataFrame:
    return D.score_table(FX.fx_dynamics(spark, sf))


def melt(scores: DataFrame, keys) -> DataFrame:
    """Long form (key, sample_id, label, score): all keys ranked in one shuffle."""
    arr = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("score")) for k in keys])
    return scores.select("sample_id", "label", F.explode(arr).alias("_ks")).select(
        F.col("_ks.key").alias("key"), "sample_id", "label", F.col("_ks.score").alias("score"))


def cb_ranked(spark, sf, keys=K.CORESET_KEYS) -> DataFrame:
    from divaug.operators.ranking import rank_within
    long = melt(scores_of(spark, sf), keys)
    return rank_within(long, [F.col("score").desc_nulls_last(), F.col("sample_id").asc()], ["key", "label"],
                       name="rank", count_name="n_label")


def _sql_case(keys):
    return "CASE k.key " + " ".join(f"WHEN '{k}' THEN s.{k}" for k in keys) + " END"


CB_STEPS = [f"""cb AS (
  SELECT k.key, s.sample_id, s.label, {_sql_case(K.CORESET_KEYS)} AS score
  FROM scores s CROSS JOIN (VALUES ('entropy'), ('el2n'), ('variance')) k(key)),
cbr AS (
  SELECT *, row_number() OVER (PARTITION BY key, label ORDER BY score DESC, sample_id) AS rank,
         count(*) OVER (PARTITION BY key, label) AS n_label FROM cb)"""]
CB_SQL = SCORES + CB_STEPS


def _cut_sql(n, ratio):
    return f"floor({n} * {S.dbl(ratio)})"


@register("class_balanced_top", S.with_(CB_SQL, f"""
SELECT key, sample_id, label, rank FROM cbr WHERE rank <= {_cut_sql('n_label', Fraction(1, 2))}"""))
def class_balanced_top(spark, sf):
    r = cb_ranked(spark, sf)
    return r.filter(F.col("rank") <= F.floor(F.col("n_label").cast("double") * F.lit(0.5))) \
            .select("key", "sample_id", "label", "rank")


_BANDS_SQL = " UNION ALL ".join(
    f"SELECT key, '{b}' AS band, sample_id, label, rank FROM cbr WHERE rank > {_cut_sql('n_label', lo)} "
    f"AND rank <= {_cut_sql('n_label', hi)}"
    for b, (lo, hi) in [("top_1_3", (0, Fraction(1, 3))), ("mid_1_3", (Fraction(1, 3), Fraction(2, 3))),
                        ("top_2_3", (0, Fraction(2, 3)))])


@register("mid_band", S.with_(CB_SQL, _BANDS_SQL))
def mid_band(spark, sf):
    r = cb_ranked(spark, sf)
    bands = ["top_1_3", "mid_1_3", "top_2_3"]
    arr = F.array(*[F.when((F.col("rank") > F.floor(F.col("n_label").cast("double") * F.lit(float(K.BANDS[b][0]))))
                           & (F.col("rank") <= F.floor(F.col("n_label").cast("double") * F.lit(float(K.BANDS[b][1])))),
                           F.lit(b)) for b in bands])
    return (r.withColumn("band", F.explode(F.filter(arr, lambda x: x.isNotNull())))
             .select("key", "band", "sample_id", "label", "rank"))


@register("global_top", S.with_(SCORES + ["""gt AS (
  SELECT sample_id, row_number() OVER (ORDER BY entropy DESC, sample_id) AS grank, count(*) OVER () AS n_total
  FROM scores)"""], f"SELECT sample_id, grank FROM gt WHERE grank <= {_cut_sql('n_total', Fraction(1, 2))}"))
def global_top(spark, sf):
    return K.global_top(scores_of(spark, sf), "entropy", 0.5, True).select("sample_id", "grank")


PRUNE_SQL = SCORES + [f"""pr AS (
  SELECT *, row_number() OVER (ORDER BY accumulated_margin, sample_id) AS grank, count(*) OVER () AS n_total
  FROM scores),
kept AS (SELECT * FROM pr WHERE grank > {_cut_sql('n_total', 0.1)})"""]


@register("mislabel_prune", S.with_(PRUNE_SQL, "SELECT sample_id, grank FROM kept"))
def mislabel_prune(spark, sf):
    return K.mislabel_prune(scores_of(spark, sf)).select("sample_id", "grank")


STRATA_SQL = PRUNE_SQL + [f"""mm AS (SELECT min(accumulated_margin) AS lo, max(accumulated_margin) AS hi FROM kept),
st AS (SELECT lo, (hi + 1e-4 * abs(hi) - lo) / {K.STRATA} AS step FROM mm),
binned AS (
  SELECT k.*, CASE WHEN st.step > 0
                   THEN CAST(least(floor((k.accumulated_margin - st.lo) / st.step), {K.STRATA - 1}) AS INTEGER)
                   ELSE 0 END AS bin
  FROM kept k CROSS JOIN st),
hist AS (
  SELECT b.bin, CAST(coalesce(c.size, 0) AS BIGINT) AS size
  FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {K.STRATA})) b
  LEFT JOIN (SELECT bin, count(*) AS size FROM binned GROUP BY bin) c USING (bin)),
ordb AS (SELECT bin, size, row_number() OVER (ORDER BY size, bin) AS i FROM hist),
binrank AS (
  SELECT sample_id, label, bin,
         row_number() OVER (PARTITION BY bin ORDER BY {S.seeded_key(42)}, sample_id) AS bin_rank
  FROM binned)"""]


def budget_sql(tag: str, ratio) -> str:
    return f"""fold_{tag}(i, bin, budget, rest) AS (
  SELECT CAST(0 AS BIGINT), -1, CAST(0 AS BIGINT), CAST(floor(n * {S.dbl(ratio)}) AS BIGINT)
  FROM (SELECT count(*) AS n FROM scores)
  UNION ALL
  SELECT o.i, o.bin, least(o.size, f.rest // ({K.STRATA} - o.i + 1)),
         f.rest - least(o.size, f.rest // ({K.STRATA} - o.i + 1))
  FROM fold_{tag} f JOIN ordb o ON o.i = f.i + 1),
bud_{tag} AS (SELECT CAST(bin AS INTEGER) AS bin, CAST(budget AS BIGINT) AS budget FROM fold_{tag} WHERE i > 0),
sel_{tag} AS (SELECT r.sample_id, r.label, r.bin FROM binrank r JOIN bud_{tag} b USING (bin) WHERE r.bin_rank <= b.budget)"""


RATIOS = {"12": Fraction(1, 2), "13": Fraction(1, 3), "23": Fraction(2, 3)}
CCS_SQL = STRATA_SQL + [budget_sql(t, r) for t, r in RATIOS.items()]


@register("strata_histogram", S.with_(STRATA_SQL, "SELECT bin, size FROM hist"))
def strata_histogram(spark, sf):
    kept = K.mislabel_prune(scores_of(spark, sf))
    return K.strata_histogram(K.strata_bins(kept, K.MIS_KEY))


@register("strata_bins_join", S.with_(STRATA_SQL, "SELECT sample_id, bin FROM binned"))
def strata_bins_join(spark, sf):
    """K5 by an interval join with the edges of the strata, as a cross-check of
    the arithmetic; the last stratum has no upper edge."""
    kept = stored(K.mislabel_prune(scores_of(spark, sf)).select("sample_id", K.MIS_KEY), "kept")
    mm = kept.agg(F.min(K.MIS_KEY).alias("lo"), F.max(K.MIS_KEY).alias("hi"))
    step = (F.col("hi") + 1e-4 * F.abs("hi") - F.col("lo")) / K.STRATA
    edges = mm.withColumn("step", step).select("lo", "step", F.explode(F.sequence(F.lit(0), F.lit(K.STRATA - 1))).alias("bin")).select(
        "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("low"),
        F.when(F.col("bin") == K.STRATA - 1, F.col("lo") + 2 * K.STRATA * F.col("step")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("high"))
    return interval_join(kept, edges, K.MIS_KEY, "low", "high").select("sample_id", "bin")


@register("strata_budget", S.with_(CCS_SQL, "SELECT bin, budget FROM bud_12"))
def strata_budget(spark, sf):
    s = scores_of(spark, sf)
    n = s.count()
    kept = K.mislabel_prune(s)
    hist = K.strata_histogram(K.strata_bins(kept, K.MIS_KEY))
    return K.strata_budget(hist, int(0.5 * n))


@register("strata_sample", S.with_(CCS_SQL, "SELECT sample_id, bin FROM sel_12"))
def strata_sample(spark, sf):
    return K.ccs_select(scores_of(spark, sf), 0.5).select("sample_id", "bin")


@register("ccs_coreset", S.with_(CCS_SQL, """
SELECT 'top_1_2' AS band, * FROM sel_12 UNION ALL
SELECT 'top_1_3' AS band, * FROM sel_13 UNION ALL
SELECT 'top_2_3' AS band, * FROM sel_23"""))
def ccs_coreset(spark, sf):
    b = K.ccs_bands(scores_of(spark, sf))
    return b.filter(F.col("band") != "mid_1_3").select("band", "sample_id", "label", "bin")


@register("ccs_mid_band", S.with_(CCS_SQL, """
SELECT sample_id, label, bin FROM sel_23 WHERE sample_id NOT IN (SELECT sample_id FROM sel_13)"""))
def ccs_mid_band(spark, sf):
    b = K.ccs_bands(scores_of(spark, sf))
    return b.filter(F.col("band") == "mid_1_3").select("sample_id", "label", "bin")


_ALL_BANDS = [("top_1_2", 0, Fraction(1, 2)), ("top_1_3", 0, Fraction(1, 3)),
              ("mid_1_3", Fraction(1, 3), Fraction(2, 3)), ("top_2_3", 0, Fraction(2, 3))]


@register("coreset_splits", S.with_(CB_SQL + CCS_SQL[len(SCORES):], " UNION ALL ".join(
    [f"SELECT sample_id, label, 'coreset_' || key || '_{b}' AS split FROM cbr WHERE rank > {_cut_sql('n_label', lo)} "
     f"AND rank <= {_cut_sql('n_label', hi)}" for b, lo, hi in _ALL_BANDS]
    + ["SELECT sample_id, label, 'coreset_ccs_aum_top_1_2' FROM sel_12",
       "SELECT sample_id, label, 'coreset_ccs_aum_top_1_3' FROM sel_13",
       "SELECT sample_id, label, 'coreset_ccs_aum_top_2_3' FROM sel_23",
       "SELECT sample_id, label, 'coreset_ccs_aum_mid_1_3' FROM sel_23 WHERE sample_id NOT IN (SELECT sample_id FROM sel_13)"])))
def coreset_splits(spark, sf):
    """Every coreset split the selection step writes (split names as the
    reference's files)."""
    from divaug.plans.selection import coreset_splits as cs
    return cs(scores_of(spark, sf)).select("sample_id", "label", "split")
