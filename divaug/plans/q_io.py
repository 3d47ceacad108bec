"""Registered queries: file round trips, results upsert, streaming scores
(S1, S3, S7, ST1, ST2)."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from divaug.functions.hashing import h24
from divaug.operators import diversity as DV
from divaug.operators import dynamics as D
from divaug.plans import sqlparts as S
from divaug.plans.q_candidates import PREF_DATASET, SFT_DATASET
from divaug.plans.q_dynamics import SCORES
from divaug.plans.q_sampling import DPO_GROUPS, GROUP_POS, SEED, SFT_GROUPS, SHARES
from divaug.plans.registry import register
from divaug.session import shared_path
from divaug.sources import commits as CM
from divaug.sources import fixtures as FX
from divaug.sources import io as IO
from divaug.streaming import dynamics_stream as ST
from divaug.functions.vectors import rnd

ROUNDTRIP_SQL = S.with_([S.FX_TEXT], "SELECT sample_id, label, split, md5(text) AS text_md5 FROM fx_text")


def _scratch(spark, tag):
    return shared_path(spark, "divaug-runs", f"{tag}-{uuid.uuid4().hex}")


@register("write_read_roundtrip", ROUNDTRIP_SQL)
def write_read_roundtrip(spark, sf):
    path = _scratch(spark, "jsonl")
    IO.write_jsonl(FX.fx_text(spark, sf).select("sample_id", "text", "label", "split"), path)
    back = IO.read_jsonl_partitioned(spark, path)
    return back.select("sample_id", "label", "split", F.md5("text").alias("text_md5"))


def _write_splits(spark, sf):
    """One file of JSON lines for each split, from one scan."""
    base, t = _scratch(spark, "splits"), FX.fx_text(spark, sf)
    t.select("sample_id", "text", "label", "split").write.partitionBy("split").json(base)
    return base, {s: f"split={s}" for s in FX.TEXT_SPLITS}


@register("read_splits", ROUNDTRIP_SQL)
def read_splits(spark, sf):
    back = IO.read_splits(spark, *_write_splits(spark, sf))
    return back.select("sample_id", "label", "split", F.md5("text").alias("text_md5"))


def _spoilt(line, key):
    """Every eleventh line is cut, every thirteenth has a label of another
    type, every seventeenth is no object."""
    n = h24(F.concat(F.lit("bad:"), key))
    return (F.when(n % 11 == 0, F.substring(line, 1, 20)).when(n % 13 == 0, F.replace(line, F.lit('"label":'), F.lit('"label":"x",  "was":')))
             .when(n % 17 == 0, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line))


_BAD = S.h24("'bad:' || CAST(sample_id AS VARCHAR)")


@register("read_splits_rejects", S.with_([S.FX_TEXT, f"marked AS (SELECT *, {_BAD} % 11 = 0 OR {_BAD} % 13 = 0 OR {_BAD} % 17 = 0 AS bad FROM fx_text)"], """
SELECT split, count(*) FILTER (NOT bad) AS n_rows, count(*) FILTER (bad) AS n_rejects,
       count(*) AS n_lines, CAST(sum(sample_id) FILTER (NOT bad) AS BIGINT) AS id_sum FROM marked GROUP BY split"""))
def read_splits_rejects(spark, sf):
    base, t = _scratch(spark, "spoilt"), FX.fx_text(spark, sf)
    line = F.to_json(F.struct("sample_id", "text", F.coalesce("label", F.lit(-1)).alias("label")))
    t.select(_spoilt(line, F.col("sample_id").cast("string")).alias("value"), "split").write.partitionBy("split").text(base)
    files = {s: f"split={s}" for s in FX.TEXT_SPLITS}
    good, rejects = IO.read_splits_checked(spark, base, files)
    every = IO.split_lines(spark, base, files).groupBy("split").agg(F.count("*").alias("n_lines"))
    n = good.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("sample_id").alias("id_sum"))
    r = rejects.groupBy("split").agg(F.count("*").alias("n_rejects"))
    return every.join(n, "split", "left").join(r, "split", "left").select(
        "split", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_rejects", F.lit(0)).alias("n_rejects"), "n_lines", "id_sum")


TUNING_CTES = SFT_DATASET + PREF_DATASET[len(GROUP_POS):]
TUNING_SQL = """
SELECT 'sft' AS file, position, instruction, input, output, NULL::VARCHAR AS chosen, NULL::VARCHAR AS rejected FROM sftd
UNION ALL SELECT 'dpo', position, instruction, input, NULL, chosen, rejected FROM dpod"""

_OLD = ["avg_distance", "dissimilarity", "embed_std"]
_NEW = ["dissimilarity", "homogeneity"]


@register("results_upsert", S.with_([S.FX_VEC] + S.class_metrics("fx_vec", "cm") + [
    "old_c AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, 'embeddings' AS row_key, split, round(avg({m}), 6) AS value FROM cm GROUP BY split"
        for m in _OLD) + ")",
    "new_c AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, 'embeddings' AS row_key, split, round(avg({m}), 6) AS value FROM cm GROUP BY split"
        for m in _NEW) + ")"], """
SELECT * FROM new_c UNION ALL
SELECT * FROM old_c o WHERE NOT EXISTS (SELECT 1 FROM new_c n WHERE n.metric = o.metric AND n.row_key = o.row_key AND n.split = o.split)"""))
def results_upsert(spark, sf):
    macro = DV.macro_average(DV.class_metrics(FX.fx_vec(spark, sf)))

    def cells(ms):
        arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ms])
        return macro.select("split", F.explode(arr).alias("c")).select(
            F.col("c.metric").alias("metric"), F.lit("embeddings").alias("row_key"), "split", F.col("c.value").alias("value"))
    return IO.upsert_cells(cells(_OLD), cells(_NEW)).select("metric", "row_key", "split", "value")


# ---- S5: an epoch that is written again, and one that is not finished
@register("log_by_epoch", S.with_([S.FX_VEC, S.FX_CENT_ALL, S.FX_DYN], """
SELECT epoch, sample_id, iteration, label, round(list_sum(logp), 6) AS logp_sum FROM fx_dyn"""))
def log_by_epoch(spark, sf):
    log, rows = CM.EpochLog(spark, _scratch(spark, "epochs")), FX.fx_dynamics(spark, sf)
    log.put(rows.filter("epoch < 2"))
    log.write_epoch(1, rows.filter("epoch = 1 AND sample_id % 2 = 0"))          # a run that was cut short
    log.put(rows)                                                               # again: epochs 1 and 2 only
    rows.filter("epoch = 0").write.parquet(log.log.data("without-a-marker"))    # not finished: nobody reads it
    return log.read().select("epoch", "sample_id", "iteration", "label",
                             rnd(F.aggregate("logp", F.lit(0.0), lambda a, x: a + x), 6).alias("logp_sum"))


# ---- S6: scores of another log are another table
_REUSE = [(1, "short", False), (2, "whole", False), (3, "whole", True), (4, "short", True), (5, "shuffled", True)]


@register("score_table_reuse", S.with_([S.FX_VEC, S.FX_CENT_ALL, S.FX_DYN, "fx_short AS (SELECT * FROM fx_dyn WHERE epoch < 2)"]
                                       + S.score_table("fx_short", "short") + S.score_table("fx_dyn", "whole"), " UNION ALL ".join(
    f"SELECT {n} AS run, {str(was).lower()} AS reused, count(*) AS n_rows, CAST(sum(correctness) AS BIGINT) AS correctness, "
    f"round(sum(accumulated_margin), 4) AS margin FROM {'short' if log == 'short' else 'whole'}" for n, log, was in _REUSE)))
def score_table_reuse(spark, sf):
    kept, whole = CM.DerivedTable(spark, _scratch(spark, "scores")), FX.fx_dynamics(spark, sf)
    logs = {"whole": whole, "short": whole.filter("epoch < 2"), "shuffled": whole.repartition(3, "label")}
    out = []
    for n, log, _ in _REUSE:
        scores, was = kept.get({"log": logs[log]}, {"max_epoch": D.EL2N_MAX_EPOCH}, D.score_table)
        out.append(scores.agg(F.lit(n).alias("run"), F.lit(was).alias("reused"), F.count("*").alias("n_rows"),
                              F.sum("correctness").alias("correctness"), rnd(F.sum("accumulated_margin"), 4).alias("margin")))
    return functools.reduce(lambda a, b: a.unionByName(b), out)


# ---- S7: two writers, a compaction between them, and one that was killed
@register("results_table", S.with_([S.FX_VEC] + S.class_metrics("fx_vec", "cm"), """
SELECT m.metric, 'embeddings' AS row_key, m.split, round(m.value, 6) AS value FROM (
  SELECT 'avg_distance' AS metric, split, avg(avg_distance) AS value FROM cm GROUP BY split
  UNION ALL SELECT 'dissimilarity', split, avg(dissimilarity) + 1 FROM cm GROUP BY split
  UNION ALL SELECT 'homogeneity', split, avg(homogeneity) FROM cm GROUP BY split) m"""))
def results_table(spark, sf):
    macro, path = DV.macro_average(DV.class_metrics(FX.fx_vec(spark, sf))), _scratch(spark, "results")

    def cells(**values):
        arr = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])
        return macro.select("split", F.explode(arr).alias("c")).select(
            "c.metric", F.lit("embeddings").alias("row_key"), "split", rnd("c.value", 6).alias("value"))
    a, b = CM.ResultsTable(spark, path), CM.ResultsTable(spark, path)
    a.upsert(cells(avg_distance=F.col("avg_distance"), dissimilarity=F.col("dissimilarity")))
    b.upsert(cells(homogeneity=F.col("homogeneity"), dissimilarity=F.col("dissimilarity")))
    a.compact()
    b.upsert(cells(dissimilarity=F.col("dissimilarity") + 1))
    cells(avg_distance=F.lit(-1.0)).write.parquet(a.log.data("killed-before-its-marker"))
    return a.read()


# ---- S4: the tuning sets as files
@register("tuning_set_files", S.with_(TUNING_CTES, TUNING_SQL))
def tuning_set_files(spark, sf):
    """The written JSON lines of both sets and the rejects, read back."""
    from divaug.plans import jobs as J
    r = J.prepare_tuning_sets(FX.fx_groups(spark, sf), _scratch(spark, "tuning"), SFT_GROUPS, DPO_GROUPS, SHARES, SEED, on_error="skip")
    null = F.lit(None).cast("string")
    return (r["sft"].select(F.lit("sft").alias("file"), "position", "instruction", "input", "output", null.alias("chosen"), null.alias("rejected"))
            .unionByName(r["dpo"].select(F.lit("dpo").alias("file"), "position", "instruction", "input", null.alias("output"), "chosen", "rejected")))


def _write_log(spark, sf, order=(2, 0, 1)):
    path = _scratch(spark, "dynlog")
    log = FX.fx_dynamics(spark, sf)
    for e in order:
        log.filter(F.col("epoch") == e).write.mode("append").parquet(path)
    return path


@register("stream_running_scores", S.with_(SCORES, """
SELECT sample_id, correctness, round(accumulated_margin, 6) AS accumulated_margin, round(el2n, 6) AS el2n, n_records AS n_ep
FROM scores"""))
def stream_running_scores(spark, sf):
    src = _write_log(spark, sf)
    stream = spark.readStream.schema(ST.LOG_SCHEMA).option("maxFilesPerTrigger", 4).parquet(src)
    out = ST.run_to_table(spark, ST.running_scores(stream), _scratch(spark, "st1-out"), _scratch(spark, "st1-ckpt"))
    return out.select("sample_id", "correctness", rnd("accumulated_margin", 6).alias("accumulated_margin"),
                      rnd("el2n", 6).alias("el2n"), "n_ep")


@register("stream_forgetting", S.with_(SCORES, """
SELECT sample_id, CAST(n_records AS INTEGER) AS n_ep, forgetting, correctness FROM scores"""))
def stream_forgetting(spark, sf):
    src = _write_log(spark, sf)
    stream = spark.readStream.schema(ST.LOG_SCHEMA).option("maxFilesPerTrigger", 4).parquet(src)
    out = ST.run_to_table(spark, ST.running_forgetting(stream), _scratch(spark, "st2-out"), _scratch(spark, "st2-ckpt"))
    return out.select("sample_id", "n_ep", "forgetting", "correctness")
