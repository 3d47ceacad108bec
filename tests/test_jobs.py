import uuid

from pyspark.sql import functions as F

from divaug.plans import jobs as J
from divaug.session import shared_path
from divaug.sources import catalog as CT
from divaug.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def test_stage_jobs_end_to_end(spark):
    out = shared_path(spark, "jobs-" + uuid.uuid4().hex)
    r = J.prepare_tuning_sets(FX.fx_groups(spark, SF), out, 40, 60, on_error="skip")
    assert r["sft"].count() > 40 and r["sft"].filter("position IS NULL").count() == 0
    texts = FX.fx_text(spark, SF).drop("split")
    sel = J.select_coresets(FX.fx_dynamics(spark, SF), texts, out)
    splits = {x.split for x in sel["coresets"].select("split").distinct().collect()}
    assert "coreset_variance_top_1_3" in splits and "coreset_ccs_aum_mid_1_3" in splits
    aug = J.augment(sel["coresets"], "variance", out, save_sim=True)
    tag = CT.METHOD_TAG
    assert set(aug) == {f"aug_{tag}_dpo50k_sel_variance_dissimilar", f"aug_{tag}_dpo50k_sel_variance_similar"}
    a = aug[f"aug_{tag}_dpo50k_sel_variance_dissimilar"]
    n_seed = a.filter(F.col("origin") == "seed").count()
    assert a.filter(F.col("origin") == "paraphrase").count() == n_seed
    res = f"{out}/results"
    rep = J.diversity_report(FX.fx_text(spark, SF), "variance_top_2_3", res, dataset="docs")
    n1 = rep.count()
    rep2 = J.diversity_report(FX.fx_text(spark, SF), "variance_top_2_3", res, dataset="docs")
    assert rep2.count() == n1   # upsert replaces, never duplicates


def test_evaluate_job_upserts_accuracy(spark):
    out = shared_path(spark, "eval-" + uuid.uuid4().hex)
    v = FX.fx_vec(spark, SF)
    cells = J.evaluate(v, v, seeds=[37, 38], results_path=f"{out}/perf")
    assert cells.count() == 3 * 2
    again = J.evaluate(v, v, seeds=[37, 38], results_path=f"{out}/perf")
    assert again.count() == 3 * 2
    assert all(0.0 <= r.value <= 1.0 for r in again.collect())


def test_sft_rows_fail_on_a_bad_literal(spark):
    import pytest

    from divaug.operators import candidates as CD
    g = CD.parse_literals(spark.createDataFrame([(1, "t", "['a', 'b']"), (2, "t", "['a'] more")], "group_id long, text string, paraphrases string"))
    assert CD.sft_rows(g).count() == 2
    with pytest.raises(Exception, match="no list literal in group 2"):
        CD.sft_rows(g, on_error="fail").collect()


def test_augment_follows_the_dataset_schema(spark):
    import pytest

    from divaug.functions import text as TX
    out = shared_path(spark, "aug-" + uuid.uuid4().hex)
    tag = CT.METHOD_TAG

    def bands(df):
        return df.withColumn("split", F.when(F.col("sample_id") % 2 == 0, F.lit("coreset_variance_top_1_3")).otherwise(F.lit("coreset_variance_mid_1_3")))
    qa = bands(FX.fx_qa_codah(spark, SF))
    a = J.augment(qa, "variance", out, stage="sft", dataset="codah")[f"aug_{tag}_sft100k_sel_variance_dissimilar"]   # sft: size 100k
    assert set(a.columns) == {"sample_id", "origin", "question_propmt", "candidate_answers", "correct_answer_idx"}
    n = {r.origin: r["count"] for r in a.groupBy("origin").count().collect()}
    assert n["seed"] == n["paraphrase"] > 0 and n["seed"] + n["nonseed"] == qa.count()
    pairs = spark.createDataFrame([(0, "Premise: a b c Hypothesis: d e Hypothesis: f", 1), (1, "no markers", 0)], "sample_id long, text string, label int")
    a = J.augment(bands(pairs), "variance", out, dataset="anli")[f"aug_{tag}_dpo50k_sel_variance_dissimilar"]
    par = a.filter("origin = 'paraphrase'").collect()
    assert len(par) == 1 and par[0].label == 1 and TX.NLI_MARKERS[1] in par[0].text and "f" not in par[0].text.split(TX.NLI_MARKERS[1])[1]
    bad = pairs.withColumn("sample_id", F.col("sample_id") * 2)
    with pytest.raises(Exception, match="no pair markers in text of 2"):
        J.augment(bands(bad), "variance", out + "-bad", dataset="mnli")


def _vectors(spark, splits):
    rows = [(s, k % 2, i * 100 + k, [float(k % 2) + 0.1 * (k % 5), 1.0 - k % 2]) for i, s in enumerate(splits) for k in range(20)]
    return spark.createDataFrame(rows, "split string, label int, sample_id long, vec array<double>")


def test_evaluation_matrix_has_summary_rows_and_fixed_columns(spark):
    v = _vectors(spark, ["variance_top_2_3", "reduced_800"])
    cells = J.evaluate(v, v.drop("split"), seeds=[37, 38, 39])
    m = J.evaluation_matrix(cells)
    assert m.columns == ["row_key", "reduced_800", "variance_top_2_3"]
    rows = m.collect()
    assert [r.row_key for r in rows] == ["37", "38", "39", "avg", "std"]
    assert all(r.reduced_800 == 1.0 for r in rows[:4]) and rows[4].reduced_800 == 0.0


def test_evaluation_checks_its_splits_and_caps_its_test_rows(spark):
    import pytest
    v = _vectors(spark, ["reduced_800"])
    with pytest.raises(ValueError, match="no rows of split dpo_d, sft_d"):
        J.evaluate(v, v, seeds=[37], used=["sft_d", "reduced_800", "dpo_d"])
    wrong = v.withColumn("label", F.when(F.col("sample_id") < 5, F.col("label")).otherwise(1 - F.col("label")))
    first = J.evaluate(v, wrong.drop("split"), seeds=[37], max_test=5).collect()
    assert [c.value for c in first] == [1.0]
    assert J.evaluate(v, wrong.drop("split"), seeds=[37]).first().value == 0.25


def test_coresets_of_the_reduction_and_of_all_rows(spark):
    out = shared_path(spark, "reduce-" + uuid.uuid4().hex)
    texts = FX.fx_text(spark, SF).select("sample_id", "text", "label")
    log = FX.fx_dynamics(spark, SF, vecs=FX.fx_doc_vec(spark, SF))
    some = J.select_coresets(log, texts, out, sizes=(60, 40))
    ids = {r.sample_id for r in some["reduced"].filter("split = 'reduced_60'").select("sample_id").collect()}
    assert len(ids) == 60 and {r.sample_id for r in some["coresets"].select("sample_id").collect()} <= ids
    every = J.select_coresets(log, texts, out, sizes=(60, 40), reduce=False)
    assert some["scores"].count() == 60 and every["scores"].count() == texts.count()
    names = {r.split for r in every["coresets"].select("split").distinct().collect()}
    assert names and all(x.startswith("full_coreset_") for x in names)


def test_training_run(spark):
    import pytest

    from divaug.operators import training as TR
    from divaug.sources.commits import EpochLog
    v = _vectors(spark, ["a", "b", "c"]).select("sample_id", "label", "vec")
    odd = spark.createDataFrame([(None, 1, [0.0, 1.0]), (9000, None, [0.0, 1.0]), (9001, 1, None)], v.schema)
    log = EpochLog(spark, shared_path(spark, "run-" + uuid.uuid4().hex))
    models = TR.train_log(v.unionByName(odd), log, seed=1, epochs=4, batches=3)
    assert len(models) == 4 and log.finished() == [0, 1, 2, 3]
    loss = {r.epoch: r.loss for r in log.read().groupBy("epoch").agg(F.avg(-F.element_at("logp", F.col("label") + 1)).alias("loss")).collect()}
    assert loss[3] < loss[2] < loss[1] < loss[0] < 0.69
    assert log.read([0]).count() == 60
    again = EpochLog(spark, shared_path(spark, "run-" + uuid.uuid4().hex))
    assert all(abs(a - b).max() < 1e-9 for a, b in zip(models, TR.train_log(v.repartition(5), again, seed=1, epochs=4, batches=3)))
    for bad, why in ((spark.createDataFrame([(1, 0, [1.0])], v.schema), "has not 2 dimensions"), (spark.createDataFrame([(1, -1, [1.0, 0.0])], v.schema), "is none of")):
        with pytest.raises(Exception, match=why):
            TR.train_log(v.unionByName(bad), EpochLog(spark, shared_path(spark, "bad-" + uuid.uuid4().hex)), batches=1)
