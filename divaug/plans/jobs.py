"""Stage jobs: the reference's five scripts as Spark jobs over tables.

Each job reads DataFrames (or paths), writes its outputs to the given shared
folder and returns the written DataFrames lazily re-read from storage.

    prepare_tuning_sets   paraphrase groups -> SFT rows, preference rows (L8, S4)
    select_coresets       log + labelled texts -> score table, coreset splits (Q7, K1-K10, S6)
    augment               coreset splits -> augmented split and variants (G1-G10, S9)
    diversity_report      splits -> long metrics upserted into a results table (D*, T*, S7)
    evaluate              splits x seeds -> accuracy matrix (E1-E5, S7)
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divaug.functions import text as TX
from divaug.functions.hashing import h24
from divaug.operators import candidates as CD
from divaug.operators import diversity as DV
from divaug.operators import dynamics as D
from divaug.operators import evaluation as EV
from divaug.operators import sampling as SM
from divaug.operators import tokens as TK
from divaug.sources import catalog as CT
from divaug.sources import commits as CM
from divaug.sources import io as IO
from divaug.session import stored, track
from divaug.functions.vectors import rnd


def prepare_tuning_sets(groups: DataFrame, out_dir: str, sft_groups: int = 20_000,
                        dpo_groups: int = 100_000, shares: dict | None = None, seed: int = 42,
                        suffix: str = "100k_100k", on_error: str = "fail") -> dict[str, DataFrame]:
    """Stage 1: quota draws per category, literal parse, SFT explode and
    preference pairs, each shuffled and written as JSON lines."""
    shares = shares or {"question": 0.05, "sentence": 0.95}
    sft_g = SM.quota_sample(groups, "category", sft_groups, shares, 0, seed, "group_id").drop("pos")
    sft = CD.sft_rows(CD.parse_literals(sft_g), on_error=on_error)   # rows must parse, unless told to skip
    sft = CD.shuffled(sft, seed, F.concat_ws(":", F.col("group_id").cast("string"), F.col("pos").cast("string")))
    dpo_g = SM.quota_sample(groups, "category", dpo_groups, shares, sft_groups, seed, "group_id").drop("pos")
    good, rejects = CD.split_rejects(CD.parse_literals(dpo_g))
    pref = CD.shuffled(CD.preference_pairs(good), seed, F.col("group_id").cast("string"))
    paths = {"sft": f"{out_dir}/paraphrase_sft_{suffix}", "dpo": f"{out_dir}/paraphrase_dpo_{suffix}",
             "rejects": f"{out_dir}/paraphrase_dpo_rejects"}
    for name, df in (("sft", sft), ("dpo", pref)):   # S8 names the columns of each set
        columns = CT.column_roles(f"paraphrase_{name}_100k_100k").values()
        IO.write_jsonl(df.select(*columns, "position"), paths[name], None)
    IO.write_jsonl(rejects.select("group_id", "paraphrases"), paths["rejects"], None)
    spark = groups.sparkSession
    return {k: spark.read.json(p) for k, p in paths.items()}


def select_coresets(log: DataFrame, texts: DataFrame, out_dir: str, seed: int = 42,
                    sizes=(1200, 800), reduce: bool = True) -> dict[str, DataFrame]:
    """Stage 3: nested random reductions, log by epoch, score table (reused for
    an equal log only), every coreset split written under its reference name.
    ``reduce``: coresets come from the largest reduction; else from all rows,
    under names that start with ``full_``."""
    from divaug.plans.selection import coreset_splits
    spark = log.sparkSession
    reduced = SM.nested_sample(texts, sizes, seed)
    red = reduced.select("sample_id", "text", "label", F.explode(F.array(*[
        F.when(F.col(f"in_{s}"), F.lit(f"reduced_{s}")) for s in sizes])).alias("split")).filter(F.col("split").isNotNull())
    IO.write_jsonl(red, f"{out_dir}/reduced")
    prefix = "" if reduce else "full_"
    if reduce:
        log = log.join(reduced.filter(F.col(f"in_{max(sizes)}")).select("sample_id"), "sample_id", "left_semi")
    epochs = CM.EpochLog(spark, f"{out_dir}/{prefix}training_dynamics")                  # S5
    epochs.put(log)
    scores, _ = CM.DerivedTable(spark, f"{out_dir}/{prefix}scores").get(                 # S6
        {"log": epochs.read()}, {"max_epoch": D.EL2N_MAX_EPOCH}, D.score_table, known={"log": epochs.fingerprint()})
    splits = coreset_splits(scores).withColumn("split", F.concat(F.lit(prefix), F.col("split"))).join(
        texts.select("sample_id", "text"), "sample_id")
    IO.write_jsonl(splits.select("sample_id", "text", "label", "split"), f"{out_dir}/{prefix}coresets")
    return {"scores": scores, "coresets": IO.read_jsonl_partitioned(spark, f"{out_dir}/{prefix}coresets"),
            "reduced": IO.read_jsonl_partitioned(spark, f"{out_dir}/reduced")}


def augment(coresets: DataFrame, key: str, out_dir: str, stage: str = "dpo", size: str = "50k",
            variant: str = "sel", model: str = CT.DEFAULT_BASE_MODEL, generator=CD.builtin_generator,
            reduced: DataFrame | None = None, save_sim: bool = False, save_par: bool = False,
            dataset: str = "text") -> dict[str, DataFrame]:
    """Stage 4: seeds/non-seeds by variant, generate, pick extremes, assemble.
    The dataset decides the schema (pair markers or QA columns), the sft stage
    the size.  ``variant``: sel (top 1/3 seeds, mid 1/3 non-seeds), wocst (random half of
    reduced_800), wosel (random half of top 2/3)."""
    def band(b):
        return coresets.filter(F.col("split") == f"coreset_{key}_{b}").drop("split")
    if variant == "sel":
        seeds, non = band("top_1_3"), band("mid_1_3")
    else:
        pool = reduced.filter(F.col("split") == "reduced_800").drop("split") if variant == "wocst" else band("top_2_3")
        half = stored(SM.two_way_split(pool, None, "42-split"), "halves")
        seeds, non = half.filter("role = 'seed'").drop("role"), half.filter("role = 'nonseed'").drop("role")
    schema = CD.SCHEMA_OF.get(dataset, "text")
    size = "100k" if stage == "sft" else size
    seeds, non = CD.project_text(seeds, schema), CD.project_text(non, schema)
    # the generator runs once for all that is written below
    chosen = stored(CD.schema_select(seeds, schema, generator=generator, keep=("carry",)), "chosen")
    out = {}
    for pol, flag in (("dis", True), ("sim", save_sim)):
        if not flag:
            continue
        name = f"aug_{CT.METHOD_TAG}_{stage}{size}_{variant}_{key}_{'dissimilar' if pol == 'dis' else 'similar'}" + \
            ("" if model == CT.DEFAULT_BASE_MODEL else f"_{model}")
        a = CD.restore_schema(CD.augmented_set(seeds, non, chosen, "sample_id", pol, carry=("carry",)), schema, keep=("origin",))
        IO.write_jsonl(a, f"{out_dir}/{name}", None)
        out[name] = a.sparkSession.read.schema(a.schema).json(f"{out_dir}/{name}")
    if save_par:
        par = CD.restore_schema(seeds, schema).join(chosen.select("sample_id", F.col("dis_text").alias("paraphrased_text")), "sample_id")
        IO.write_jsonl(par, f"{out_dir}/para_{CT.METHOD_TAG}_{stage}{size}_{variant}_{key}_dissimilar", None)
    return out


def diversity_report(splits: DataFrame, ref_split: str, results_path: str | None = None,
                     dataset: str = "dataset", embedder=None) -> DataFrame:
    """Stage 6: per split token and embedding diversity plus affinity to
    ``ref_split``; long cells (metric, row_key, split, value), upserted.

    Each step cuts the texts into tokens as it reads them.  The tokens of all
    texts are several times their size and would not fit an executor's memory."""
    t = splits.withColumn("tokens", TX.normalized_tokens("text"))
    vecs = (embedder(t) if embedder else TK.hashed_embedding(t, keep=("split", "label"))).select("split", "label", "sample_id", "vec")
    per_class = DV.class_metrics(vecs)
    wide = (DV.macro_average(per_class)
            .join(DV.affinity(per_class.select("split", "label", "center"), ref_split), "split", "full")
            .join(TK.unique_ngrams(t), "split", "full")
            .join(TK.split_token_count(t), "split", "full"))
    metrics = ["affinity", "avg_distance", "dissimilarity", "embed_std", "homogeneity", "token_count", "unique_3grams"]
    cells = wide.select("split", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                                     for m in metrics])).alias("c")).select(
        F.col("c.metric").alias("metric"), F.lit(dataset).alias("row_key"), "split", rnd("c.value", 6).alias("value"))
    return _upsert(cells, results_path)


MAX_TEST = 4000   # fixed value: test rows that an evaluation uses


def evaluate(splits: DataFrame, test: DataFrame, seeds=range(37, 47), results_path: str | None = None,
             used: list[str] | None = None, max_test: int | None = MAX_TEST) -> DataFrame:
    """Stage 5: one classifier per split (of ``used``; default: all) and seed,
    scored on the first ``max_test`` test rows by id; accuracy cells upserted.
    A used split without rows fails before anything is fitted.  Returns the
    cells; see ``evaluation_matrix``."""
    spark = splits.sparkSession
    there = sorted(r[0] for r in splits.select("split").distinct().collect())   # split names: a bounded catalog
    names = there if used is None else list(used)
    gone = EV.missing_splits(spark.createDataFrame([(n,) for n in names], "split string"), splits).collect() if names else []
    if gone:
        raise ValueError("no rows of split " + ", ".join(sorted(r["split"] for r in gone)))
    if max_test is not None:
        first = SM.head_by(test.select("sample_id"), max_test, [F.col("sample_id").asc()]).select("sample_id")
        test = test.join(first, "sample_id", "left_semi")
    acc = EV.split_seed_accuracy(splits, test, names, list(seeds))
    cells = acc.select(F.lit("accuracy").alias("metric"), F.col("seed").cast("string").alias("row_key"), "split",
                       F.col("accuracy").alias("value"))
    return _upsert(cells, results_path)


def evaluation_matrix(cells: DataFrame) -> DataFrame:
    """E4 of accuracy cells: a row for each seed, then ``avg`` and ``std``;
    splits in the report's order."""
    acc = cells.filter("metric = 'accuracy'").select(F.col("row_key").cast("int").alias("seed"), "split", F.col("value").alias("accuracy"))
    names = [r[0] for r in acc.select("split").distinct().collect()]
    order = F.when(F.col("row_key") == "avg", 1).when(F.col("row_key") == "std", 2).otherwise(0)
    return EV.performance_matrix(acc, names).orderBy(order, F.col("row_key"))


def _upsert(cells: DataFrame, results_path: str | None) -> DataFrame:
    """The cells alone, or the table at ``results_path`` with them."""
    if not results_path:
        return cells
    results = CM.ResultsTable(cells.sparkSession, results_path)
    results.upsert(cells)
    return results.read()


def main(argv=None) -> None:
    p = argparse.ArgumentParser(description="Run one stage on the driver tables of a scale-factor folder.")
    p.add_argument("stage", choices=["prepare", "select", "augment", "evaluate", "report"])
    p.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    p.add_argument("--out", required=True)
    p.add_argument("--full", action="store_true", help="select: coresets of all rows, not of the reduction")
    a = p.parse_args(argv)
    from divaug.session import get_session
    from divaug.sources import fixtures as FX
    spark = get_session()
    if a.stage == "prepare":
        r = prepare_tuning_sets(FX.fx_groups(spark, a.sf_dir), a.out, 200, 300, on_error="skip")
    elif a.stage == "select":
        texts = FX.fx_text(spark, a.sf_dir).drop("split")
        r = select_coresets(FX.fx_dynamics(spark, a.sf_dir), texts, a.out, reduce=not a.full)
    elif a.stage == "augment":
        r = augment(IO.read_jsonl_partitioned(spark, f"{a.out}/coresets"), "variance", a.out)
    elif a.stage == "evaluate":
        v = FX.fx_vec(spark, a.sf_dir)
        held = h24(F.concat(F.lit("test:"), F.col("sample_id").cast("string"))) % 5 == 0   # test rows are no training rows
        cells = evaluate(v.filter(~held), v.filter(held), results_path=f"{a.out}/performance")
        r = {"cells": cells, "matrix": evaluation_matrix(cells)}
    else:
        r = {"report": diversity_report(FX.fx_text(spark, a.sf_dir), "variance_top_2_3", f"{a.out}/results")}
    for k, df in r.items():
        print(k, df.count())


if __name__ == "__main__":
    main()
