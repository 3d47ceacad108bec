"""Steps that must not grow faster than their input (findings of round 3)."""

import math
import subprocess
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from divaug.functions import text as TX
from divaug.functions import vectors as V
from divaug.operators import candidates as CD
from divaug.operators import evaluation as EV
from divaug.operators import sampling as SM
from divaug.operators import tokens as TK


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_every_ngram_is_shuffled_once(spark):
    rows = [("x", "a b c d"), ("x", "A b c, d e"), ("y", "b c d"), (None, "a b c"), ("z", "a b"), ("y", None)]
    df = spark.createDataFrame(rows, "split string, text string")
    counts = TK.unique_ngrams(df, 3, total="all")
    assert {r["split"]: r["unique_3grams"] for r in counts.collect()} == {"x": 3, "y": 1, None: 1, "all": 3}
    fresh = TK.unique_ngrams(df, 3, total="all")._jdf.queryExecution().executedPlan().toString()
    assert fresh.count("Exchange hashpartitioning(g#") == fresh.count("Exchange hashpartitioning(") == 1
    many = spark.range(150).select(F.concat(F.lit("s"), F.col("id")).alias("split"), F.concat(F.lit("p q r "), F.col("id") % 2).alias("text"))
    got = TK.unique_ngrams(many, 3, total="all").collect()
    assert len(got) == 151 and {r["unique_3grams"] for r in got if r["split"] != "all"} == {2}
    assert [r["unique_3grams"] for r in got if r["split"] == "all"] == [3]
    assert TK.unique_ngrams(df.limit(0)).collect() == []


def test_sketches_beside_exact_counts_move_no_text(spark, tmp_path):
    from divaug.plans import q_text as Q
    rows = [(1, "a b c d", "en", "src-1"), (1, "e f g", "en", "src-1"), (None, "q r s", "en", "src-2"), (3, "x y z", "de", "src-2")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = Q._sketched(spark, str(tmp_path))
    got = {r["split"]: (r["unique_3grams"], r["estimate"]) for r in out.collect()}
    assert got == {"dpo_d": (3, 3), "variance_top_2_3": (2, 1), "all": (5, 4)}   # a row without id is in no sketch
    assert "sample_id" not in out._jdf.queryExecution().executedPlan().toString()


def test_both_fields_of_a_pair_take_one_python_worker(spark):
    df = spark.createDataFrame([("k", "Premise: a b c Hypothesis: d e f")], "sample_id string, text string")
    r = CD.paraphrase_pairs_fields(df, "sample_id")
    assert _plan(r).count("ArrowEvalPython") == 1
    one = CD.paraphrase_select(spark.createDataFrame([("k", "a b c ")], "sample_id string, text string"), "sample_id").first()
    assert r.first().text_dis.startswith(f"Premise: {one.dis_text}. Hypothesis: ")


def test_python_counts_a_slice_of_a_batch_at_a_time(spark, monkeypatch):
    n = 3 * TK.SLICE + 5
    lists = pa.array([[f"w{i % 7}", f"w{i % 11}"] if i % 5 else [] for i in range(n)] + [None])
    seen = []
    whole = TK.token_vectors
    monkeypatch.setattr(TK, "token_vectors", lambda x, *a: seen.append(len(x)) or whole(x, *a))
    out = TK._embedder(16).func(lists)
    assert max(seen) <= TK.SLICE and (np.array(out.to_pylist()) == whole(lists, 16)).all()
    seen.clear()
    cands = pa.array([[["a"], ["b", "c"]] if i % 3 else None for i in range(n + 1)], pa.list_(pa.list_(pa.string())))
    d = CD._distances("l2", 16).func(lists, cands).to_pylist()
    assert max(seen) <= 2 * TK.SLICE and [len(x) for x in d] == [2 if i % 3 else 0 for i in range(n + 1)]
    own, each = whole(lists, 16), whole(pa.array([["a"], ["b", "c"]]), 16)
    assert d[n - 1 if (n - 1) % 3 else n - 2] == np.sqrt(((own[n - 1 if (n - 1) % 3 else n - 2] - each + V.L2_EPS) ** 2).sum(1)).tolist()


def test_literals_are_parsed_without_pandas(spark):
    n = TK.SLICE + 3
    got = CD._literal_eval_udf.func(pa.array([f"('a{i}',)" for i in range(n)] + ["['x'", None, "[1]", "[]"])).to_pylist()
    assert got == [[f"a{i}"] for i in range(n)] + [None, None, None, []]
    assert not hasattr(CD, "pd")


def test_quota_draw_ranks_only_what_it_can_draw(spark):
    rows = [(i, "ab"[i % 2], str(i)) for i in range(4000)] + [(7, "b", "again"), (None, "a", "none"), (None, "b", "none"), (5, None, "x"), (6, "c", "x")]
    df = spark.createDataFrame(rows, "group_id long, category string, text string")
    got = SM.quota_sample(df, "category", 100, {"a": 0.1, "b": 0.9}, 3, 42, "group_id")
    ordered = SM.seeded_order(df.filter("category IN ('a', 'b')").select("group_id", "category"), 42, "group_id", groups=["category"])
    want = df.join(ordered.filter("pos > 3 AND pos <= 3 + CASE category WHEN 'a' THEN 10 ELSE 90 END"), ["group_id", "category"])
    key = lambda d: sorted((r.group_id, r.category, r.text, r.pos) for r in d.collect())
    assert key(got) == key(want) and len(key(got)) >= 100
    assert "md5" not in _plan(got)


def test_shuffled_rows_are_made_once(spark):
    df = spark.range(20).select("id", F.reverse(F.col("id").cast("string")).alias("text"))
    out = CD.shuffled(df, 42, F.col("id").cast("string"))
    assert "reverse(" not in _plan(out)
    order = [r.id for r in out.orderBy("position").collect()]
    assert order == [r.id for r in df.orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")))).collect()]


def test_matrix_evaluates_the_accuracies_once(spark):
    acc = spark.range(4).select((F.col("id") % 2).cast("int").alias("seed"), F.when(F.col("id") < 2, "p").otherwise("q").alias("split"),
                                F.sqrt(F.col("id") / 16).alias("accuracy"))
    m = EV.performance_matrix(acc, ["p", "q"])
    assert "SQRT" not in _plan(m).upper()
    got = {r.row_key: (r.p, r.q) for r in m.collect()}
    assert got["0"] == (0.0, math.sqrt(2 / 16)) and got["avg"][0] == 0.125


def test_scoring_meets_all_centres_in_one_batch(spark):
    rng = np.random.default_rng(3)
    rows = [("p" if i % 2 else "q", i % 4 if i % 2 else i % 4 + 2, i, rng.normal(size=5).tolist()) for i in range(60)]
    train = spark.createDataFrame(rows, "split string, label int, sample_id long, vec array<double>")
    test = [(i, i % 6 if i % 7 else None, rng.normal(size=5).tolist()) for i in range(EV.ROWS + 9)]
    test += [(-1, 0, None), (-2, 0, [1.0, None, 2.0, 3.0, 4.0]), (-3, 0, [1.0]), (-4, 0, [float("nan")] * 5), (-5, 0, [])]
    test = spark.createDataFrame(test, "sample_id long, label int, vec array<double>")
    pred = EV.split_seed_predictions(train, test, ["p", "q", "none"], [37, 38])
    assert "Join" not in _plan(pred)
    near = F.map_from_entries(F.transform("centers", lambda c: F.struct(c["label"], -V.sq_distance(F.col("vec"), c["center"]))))
    scored = test.crossJoin(EV.split_seed_models(train, [37, 38])).withColumn("_near", near)
    want = scored.select("split", "seed", "sample_id", "label", F.transform(
        F.sequence(F.lit(0), F.array_max("centers.label")), lambda k: F.coalesce(F.try_element_at("_near", k), F.lit(float("-inf")))).alias("logits"))
    rows = lambda d: sorted(map(str, d.select("split", "seed", "sample_id", "label", "logits").collect()))
    assert rows(pred) == rows(want)


def test_python_gets_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        df = spark.range(0, 24, 1, 1).select(F.col("id").alias("sample_id"), F.repeat(F.lit("a b "), 1 << 18).alias("text"))
        TK.hashed_embedding(df)
        size = F.arrow_udf(lambda x: pa.array([x.nbytes] * len(x)), "long")
        assert df.select(size("text").alias("n")).agg(F.max("n")).first()[0] < 8 << 20
        spark.conf.set(key, "32m")
        TK.hashed_embedding(df)
        assert spark.conf.get(key) == "32m"
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def test_tokens_are_remembered_from_batch_to_batch(monkeypatch):
    seen = []
    md5 = TK.hashlib.md5
    monkeypatch.setattr(TK.hashlib, "md5", lambda x: seen.append(x) or md5(x))
    batch = pa.array([["a", "b"], ["b", "c"], None])
    embed, distances = TK._embedder(16).func, CD._distances("l2", 16).func
    assert embed(batch).equals(embed(batch)) and len(seen) == 3
    seen.clear()
    cands = pa.array([[["a"], ["d"]], [], [["b", "c"]]])
    assert distances(batch, cands).equals(distances(batch, cands)) and len(seen) == 4


def test_vectors_and_distances_load_no_pandas(tmp_path):
    t = pa.table({"t": pa.array([["a", "b"], None, []]), "c": pa.array([[["a"], ["c"]], [], [["b"]]])})
    with pa.OSFile(f"{tmp_path}/t.arrow", "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    code = f"""import sys, pyarrow as pa
from divaug.operators import candidates as CD, tokens as TK
b = pa.ipc.open_file({str(tmp_path / "t.arrow")!r}).get_batch(0)
n = [len(TK._embedder(8).func(b["t"])), *(len(CD._distances(m, 8).func(b["t"], b["c"])) for m in ("l2", "cosine"))]
print(n, "pandas" in sys.modules)"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=CD.__file__.split("/divaug/")[0], timeout=120)
    assert out.stdout.strip() == "[3, 3, 3] False", out.stderr


def test_a_preference_pair_takes_one_python_worker(spark):
    rows = [(1, "a b c", "['a b', 'x y']"), (2, "a b", "('a', 'b a',)"), (3, "c d", "['c'] and more"), (4, "q", "['it\\'s', 'q']"), (5, "n", None)]
    df = spark.createDataFrame(rows, "group_id long, text string, paraphrases string")
    good, bad = CD.split_rejects(CD.parse_literals(df))
    pairs = CD.preference_pairs(good)
    assert _plan(pairs).count("ArrowEvalPython") == 1 and "ArrowEvalPython" not in _plan(bad)
    assert {r.group_id: (r.chosen, r.rejected) for r in pairs.collect()} == {1: ("x y", "a b"), 2: ("a", "b a"), 4: ("it's", "q")}
    assert {r.group_id for r in bad.collect()} == {3, 5}
