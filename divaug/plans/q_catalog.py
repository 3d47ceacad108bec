"""Registered queries: split catalog, dataset dimension, naming, upsert
(C1-C5, S7, S9), each joined to the splits/datasets present in the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from divaug.sources import catalog as CT
from divaug.sources import fixtures as FX
from divaug.plans import sqlparts as S
from divaug.plans.registry import register


# What the catalog must be for the key "variance".
CATALOG_SQL = """(VALUES
  ('test', 'test', 'test.jsonl'),
  ('ori', 'reduced_800', 'reduced_800.jsonl'),
  ('cst', 'el2n_top_2_3', 'coreset_el2n_top_2_3.jsonl'),
  ('cst', 'entropy_top_2_3', 'coreset_entropy_top_2_3.jsonl'),
  ('cst', 'variance_top_2_3', 'coreset_variance_top_2_3.jsonl'),
  ('cst', 'ccs_aum_top_2_3', 'coreset_ccs_aum_top_2_3.jsonl'),
  ('aug', 'dpo_d', 'aug_method_dpo50k_sel_variance_dissimilar.jsonl'),
  ('abl', 'wo_coreset_dpo_d', 'aug_method_dpo50k_wocst_variance_dissimilar.jsonl'),
  ('abl', 'wo_selective_dpo_d', 'aug_method_dpo50k_wosel_variance_dissimilar.jsonl'),
  ('abl', 'sft_s', 'aug_method_sft100k_sel_variance_similar.jsonl'),
  ('abl', 'sft_d', 'aug_method_sft100k_sel_variance_dissimilar.jsonl'),
  ('abl', 'dpo_s', 'aug_method_dpo50k_sel_variance_similar.jsonl'),
  ('bsl', 'ocr', 'baseline_ocr.jsonl'),
  ('bsl', 'typing', 'baseline_keyboard.jsonl'),
  ('bsl', 'eda', 'baseline_eda.jsonl'),
  ('bsl', 'aeda', 'baseline_aeda.jsonl'),
  ('bsl', 'bt', 'baseline_bt.jsonl'),
  ('bsl', 'maskpred', 'baseline_unmask.jsonl'),
  ('bsl', 'auggpt', 'baseline_auggpt.jsonl'),
  ('bsl', 'gramma', 'baseline_grammar.jsonl'),
  ('bsl', 'spell', 'baseline_spell.jsonl'),
  ('bsl', 'chain', 'baseline_chain.jsonl'),
  ('bsl', 'hint', 'baseline_hint.jsonl'),
  ('bsl', 'taboo', 'baseline_taboo.jsonl'),
  ('var', '10k', 'aug_method_dpo10k_sel_variance_dissimilar.jsonl'),
  ('var', '20k', 'aug_method_dpo20k_sel_variance_dissimilar.jsonl'),
  ('var', '50k', 'aug_method_dpo50k_sel_variance_dissimilar.jsonl'),
  ('var', '100k', 'aug_method_dpo100k_sel_variance_dissimilar.jsonl'),
  ('var', 't1.2', 'aug_method_sft100k_sel_variance_dissimilar_t1.2.jsonl'),
  ('var', 'prompt', 'aug_method_sft100k_sel_variance_dissimilar_prompt.jsonl'),
  ('var', 'qwen', 'aug_method_dpo50k_sel_variance_dissimilar_qwen.jsonl')) c("group", split, file)"""


def data_splits(spark, sf):
    v = FX.fx_vec(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n_vec"))
    t = FX.fx_text(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n_text"))
    return v.join(t, "split", "full")


DATA_SPLITS = [S.FX_VEC, S.FX_TEXT, """dsp AS (
  SELECT coalesce(v.split, t.split) AS split, v.n_vec, t.n_text
  FROM (SELECT split, count(*) AS n_vec FROM fx_vec GROUP BY split) v
  FULL JOIN (SELECT split, count(*) AS n_text FROM fx_text GROUP BY split) t USING (split))"""]


@register("split_catalog", S.with_(DATA_SPLITS, f"""
SELECT c."group" AS "group", c.split, c.file, d.n_vec, d.n_text FROM {CATALOG_SQL} LEFT JOIN dsp d USING (split)"""))
def split_catalog(spark, sf):
    cat = CT.split_catalog(spark, "variance")
    return cat.join(data_splits(spark, sf), "split", "left").select("group", "split", "file", "n_vec", "n_text")


_ACTIVE = [("ori", "reduced_800", 0), ("cst", "variance_top_2_3", 1), ("aug", "dpo_d", 2),
           ("abl", "wo_coreset_dpo_d", 3), ("abl", "wo_selective_dpo_d", 4), ("abl", "sft_s", 5),
           ("abl", "sft_d", 6), ("abl", "dpo_s", 7)]


@register("active_splits", S.with_(DATA_SPLITS, """
SELECT a."group" AS "group", a.split, a.position, coalesce(d.n_vec, 0) + coalesce(d.n_text, 0) AS n_rows
FROM (VALUES """ + ", ".join(f"('{g}', '{s}', {p})" for g, s, p in _ACTIVE) + """) a("group", split, position)
LEFT JOIN dsp d USING (split)"""))
def active_splits(spark, sf):
    act = CT.active_splits(spark, ["ori", "cst", "aug", "abl"], "variance")
    d = data_splits(spark, sf)
    return act.join(F.broadcast(d), "split", "left").select(
        "group", "split", "position",
        (F.coalesce("n_vec", F.lit(0)) + F.coalesce("n_text", F.lit(0))).alias("n_rows"))


DATASETS_SQL = """ds AS (
  SELECT (""" + repr(CT.DATASETS) + """)[CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 12 + 1] AS dataset,
         count(*) AS n_docs
  FROM documents GROUP BY ALL)"""


def datasets_df(spark, sf):
    d = FX.table(spark, sf, "documents")
    idx = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % len(CT.DATASETS)
    name = F.element_at(F.array(*[F.lit(x) for x in CT.DATASETS]), idx + 1)
    return d.groupBy(name.alias("dataset")).agg(F.count(F.lit(1)).alias("n_docs"))


def _map_sql(m, default, col="dataset"):
    return "coalesce(CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in m.items()) + f" END, {default!r})"


@register("dataset_dim", S.with_([DATASETS_SQL], f"""
SELECT dataset, n_docs, {_map_sql(CT.CORESET_KEY_OF, CT.DEFAULT_CORESET_KEY)} AS coreset_key,
       CAST({_map_sql(CT.NUM_LABELS_OF, CT.DEFAULT_NUM_LABELS)} AS INTEGER) AS num_labels,
       CASE WHEN dataset IN ({", ".join(repr(x) for x in CT.VALIDATION_SPLIT_DATASETS)}) THEN 'validation' ELSE 'test' END AS eval_split
FROM ds"""))
def dataset_dim(spark, sf):
    d = datasets_df(spark, sf)
    return d.join(CT.dataset_dim(spark, d.select("dataset")), "dataset").select(
        "dataset", "n_docs", "coreset_key", "num_labels", "eval_split")


_M = CT.DEFAULT_BASE_MODEL
# split, stage, size, ablation, polarity, model
VARIANTS = [
    ("dpo_d", "dpo", "50k", "sel", "dissimilar", _M), ("wo_coreset_dpo_d", "dpo", "50k", "wocst", "dissimilar", _M),
    ("wo_selective_dpo_d", "dpo", "50k", "wosel", "dissimilar", _M), ("sft_s", "sft", "100k", "sel", "similar", _M),
    ("sft_d", "sft", "100k", "sel", "dissimilar", _M), ("dpo_s", "dpo", "50k", "sel", "similar", _M),
    ("10k", "dpo", "10k", "sel", "dissimilar", _M), ("20k", "dpo", "20k", "sel", "dissimilar", _M),
    ("100k", "dpo", "100k", "sel", "dissimilar", _M), ("qwen", "dpo", "50k", "sel", "dissimilar", "qwen"),
]


@register("variant_catalog", S.with_([DATASETS_SQL], """
SELECT d.dataset, v.split, 'aug_""" + CT.METHOD_TAG + """_' || v.stage || v.size || '_' || v.abl || '_' || """ + _map_sql(CT.CORESET_KEY_OF, CT.DEFAULT_CORESET_KEY, "d.dataset")
    + """ || '_' || v.pol || CASE WHEN v.model = '""" + CT.DEFAULT_BASE_MODEL + """' THEN '' ELSE '_' || v.model END AS file
FROM ds d CROSS JOIN (VALUES """ + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in VARIANTS)
    + """) v(split, stage, size, abl, pol, model)"""))
def variant_catalog(spark, sf):
    dims = CT.dataset_dim(spark, datasets_df(spark, sf).select("dataset"))
    names = ["split", "stage", "size", "abl", "pol", "model"]
    arr = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names)]) for r in VARIANTS])
    j = dims.select("dataset", "coreset_key", F.explode(arr).alias("v")).select("dataset", "coreset_key", "v.*")
    return j.select("dataset", "split", CT.variant_name(F.col("stage"), F.col("size"), F.col("abl"), F.col("coreset_key"),
                                                         F.col("pol"), F.col("model")).alias("file"))
