"""Registered queries: seeded permutations, quotas, ranges, caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from divaug.operators import sampling as SM
from divaug.plans import sqlparts as S
from divaug.plans.registry import register
from divaug.sources import fixtures as FX

SEED = 42
# Query parameters at test scale (the reference's 20k/100k groups shrink to
# sizes the fixture tables can fill; the structure is unchanged: the second
# draw starts at the first draw's size in both categories).
SFT_GROUPS = 200
DPO_GROUPS = 300
SHARES = {"question": 0.05, "sentence": 0.95}
EVAL_CAP = 4000
NESTED = (1200, 800)


def quotas(target):
    return {c: int(target * s) for c, s in SHARES.items()}


def _quota_case(target):
    q = quotas(target)
    return "CASE category " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in q.items()) + " ELSE 0 END"


GROUP_POS = [S.FX_GROUPS, f"""gpos AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY {S.seeded_key(SEED, 'group_id')}, group_id) AS pos
  FROM fx_groups)"""]
TEXT_POS = [S.FX_TEXT, f"""tpos AS (
  SELECT *, row_number() OVER (ORDER BY {S.seeded_key(SEED)}, sample_id) AS pos FROM fx_text)"""]


@register("seeded_sample", S.with_(TEXT_POS, "SELECT sample_id, pos FROM tpos"))
def seeded_sample(spark, sf):
    return SM.seeded_order(FX.fx_text(spark, sf).select("sample_id"), SEED).select("sample_id", "pos")


@register("quota_sample", S.with_(GROUP_POS, f"""
SELECT group_id, category, pos FROM gpos WHERE pos <= {_quota_case(SFT_GROUPS)}"""))
def quota_sample(spark, sf):
    g = FX.fx_groups(spark, sf).select("group_id", "category")
    return SM.quota_sample(g, "category", SFT_GROUPS, SHARES, 0, SEED, "group_id").select("group_id", "category", "pos")


@register("disjoint_ranges", S.with_(GROUP_POS, f"""
SELECT group_id, category, pos FROM gpos WHERE pos > {SFT_GROUPS} AND pos <= {SFT_GROUPS} + {_quota_case(DPO_GROUPS)}"""))
def disjoint_ranges(spark, sf):
    g = FX.fx_groups(spark, sf).select("group_id", "category")
    return SM.quota_sample(g, "category", DPO_GROUPS, SHARES, SFT_GROUPS, SEED, "group_id").select(
        "group_id", "category", "pos")


@register("nested_sample", S.with_(TEXT_POS, f"""
SELECT sample_id, pos, pos <= {NESTED[0]} AS in_{NESTED[0]}, pos <= {NESTED[1]} AS in_{NESTED[1]}
FROM tpos WHERE pos <= {max(NESTED)}"""))
def nested_sample(spark, sf):
    return SM.nested_sample(FX.fx_text(spark, sf).select("sample_id"), NESTED, SEED).select(
        "sample_id", "pos", f"in_{NESTED[0]}", f"in_{NESTED[1]}")


@register("seed_nonseed_split", S.with_(TEXT_POS + [f"""r800 AS (
  SELECT sample_id, row_number() OVER (ORDER BY {S.seeded_key('42-split')}, sample_id) AS pos2, count(*) OVER () AS n
  FROM tpos WHERE pos <= {NESTED[1]})"""], """
SELECT sample_id, CASE WHEN pos2 <= floor(n / 2) THEN 'seed' ELSE 'nonseed' END AS role FROM r800"""))
def seed_nonseed_split(spark, sf):
    r800 = SM.seeded_order(FX.fx_text(spark, sf).select("sample_id"), SEED).filter(F.col("pos") <= NESTED[1]).drop("pos")
    return SM.two_way_split(r800, None, "42-split")


@register("eval_cap", S.with_([S.FX_TEXT], f"""
SELECT sample_id, pos FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS pos FROM fx_text)
WHERE pos <= {EVAL_CAP}"""))
def eval_cap(spark, sf):
    return SM.head_by(FX.fx_text(spark, sf).select("sample_id"), EVAL_CAP, [F.col("sample_id").asc()]).select("sample_id", "pos")
