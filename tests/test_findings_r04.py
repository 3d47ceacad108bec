"""Steps that must not grow faster than their input (findings of round 4)."""

import itertools
import math
import re

import numpy as np
from pyspark.sql import functions as F

from divaug.operators import diversity as DV
from divaug.operators import tokens as TK
from divaug.plans import jobs as J


def test_report_holds_no_texts_and_its_vectors_on_disk(spark):
    rows = [(i, "a", i % 2, " ".join(f"w{(i * k) % 7}" for k in range(1, 6))) for i in range(12)]
    cells = J.diversity_report(spark.createDataFrame(rows, "sample_id long, split string, label int, text string"), "a")
    held = re.findall(r"InMemoryRelation \[([^\]]*)\], StorageLevel\(([^)]*)\)", cells._jdf.queryExecution().optimizedPlan().toString())
    assert held and not any(re.search(r"\b(text|tokens)#", cols) for cols, _ in held)
    vectors = [level for cols, level in held if "vec#" in cols]
    assert vectors and all("disk" in x and "memory" not in x for x in vectors)
    assert {r["metric"]: r["value"] for r in cells.collect()}["token_count"] == 7 + 2


def test_texts_are_cut_once_for_the_token_count(spark, tmp_path):
    rows = [("a", "x y"), ("a", None), (None, "x y z"), ("b", ""), ("c", "q q"), ("c", "r s")]
    spark.createDataFrame(rows, "split string, text string").write.parquet(f"{tmp_path}/t")
    got = TK.split_token_count(spark.read.parquet(f"{tmp_path}/t"))
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r["split"]: r["token_count"] for r in got.collect()} == {"a": 4, None: 2, "b": 2, "c": 5}


def test_norm_and_mean_are_computed_once_a_row(spark):
    vecs = [[1.0, 2.0, 4.0], [2.0, -3.5, 0.5], [0.0, 0.0, 3.0]]
    df = spark.createDataFrame([("s", 1, v) for v in vecs], "split string, label int, vec array<double>")
    lin = DV.class_linear_stats(df)
    plan = lin._jdf.queryExecution().optimizedPlan().toString()
    for start in (m.end() for m in re.finditer(r"lambdafunction\(", plan)):
        depth = list(itertools.accumulate((c == "(") - (c == ")") for c in plan[start:]))
        assert "vec#" not in plan[start:start + depth.index(-1)]   # the whole vector is not read for each element
    x = np.array(vecs)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).mean(0)
    r = lin.first()
    assert np.allclose([r.dissimilarity, r.embed_std], [1 - u @ u, np.exp(np.log(x.std(1, ddof=1)).mean())])


def test_blocks_of_huge_classes_grow_to_twice_their_rows(spark):
    m = [1, 10, 11, 160, 161, 320, 321, 1000]
    got = spark.createDataFrame([(v,) for v in m], "m long").select(DV.block_count(F.col("m"), 10).alias("b")).collect()
    assert [r.b for r in got] == [1, 1, 2, 16, 16, 16, 17, 50]
    x = np.random.default_rng(3).normal(size=(200, 3))
    df = spark.createDataFrame([(i, 1, [float(t) for t in v], "s") for i, v in enumerate(x)], "sample_id long, label int, vec array<double>, split string")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    r = DV.class_pair_stats(df, block_rows=5).first()
    assert r.n == 200 and math.isclose(r.avg_distance, d.mean(), rel_tol=1e-9)


def test_pair_kernel_counts_weights_that_vanish():
    x = np.zeros((3, 8))
    x[1, 0], x[2, 0] = 1e-160, 1.0   # the weight of the first two is below any double
    out, _ = DV._pair_sums(x, x, True)
    assert out[3].tolist() == [1, 1, 2]
    a, b = DV._pair_sums(x[:1], x[2:], False)
    assert a[:, 0].tolist() == b[:, 0].tolist() == [1, 1, 0, 1]
