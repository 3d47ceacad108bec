"""Degenerate inputs from SURVEY section 5."""

import math

import pytest
from pyspark.sql import functions as F

from divaug.operators import coreset as K
from divaug.operators import diversity as DV


def _vecs(spark, rows):
    return spark.createDataFrame(rows, "split string, label int, sample_id long, vec array<double>")


def test_affinity_with_label_missing_in_reference(spark):
    rows = [("ref", 0, 1, [1.0, 0.0]), ("ref", 0, 2, [0.0, 1.0]),
            ("s", 0, 3, [1.0, 1.0]), ("s", 1, 4, [5.0, 5.0])]
    c = DV.class_centers(_vecs(spark, rows))
    a = {r.split: r for r in DV.affinity(c, "ref").collect()}
    assert a["ref"].affinity is None                      # split equal to its reference
    assert a["s"].n_unmatched_labels == 1                 # label 1 absent from the reference
    assert a["s"].affinity == pytest.approx(1 / math.dist([1, 1], [0.5, 0.5]), rel=1e-6)


def test_zero_vector_and_single_sample_class(spark):
    rows = [("s", 0, 1, [0.0, 0.0, 0.0]), ("s", 0, 2, [1.0, 2.0, 3.0]), ("s", 1, 3, [1.0, 1.0, 2.0])]
    lin = {r.label: r for r in DV.class_linear_stats(_vecs(spark, rows)).collect()}
    pair = {r.label: r for r in DV.class_pair_stats(_vecs(spark, rows)).collect()}
    # zero vector: cosine clamps its norm, so it contributes 0 similarity
    assert lin[0].dissimilarity == pytest.approx(1 - 0.25)
    assert lin[0].embed_std == pytest.approx(0.5)          # a zero std -> arithmetic mean of (0, 1)
    assert pair[1].n == 1 and pair[1].avg_distance == 0 and pair[1].homogeneity is None


def test_class_with_zero_quota_and_fewer_rows_than_strata(spark):
    rows = [(i, 0 if i < 5 else 1, float(i)) for i in range(6)]   # label 1 has one row
    s = spark.createDataFrame(rows, "sample_id long, label int, variance double")
    top = K.class_balanced_top(s, "variance", 1 / 3).collect()
    assert {r.label for r in top} == {0} and len(top) == 1        # floor(1/3)=0 for label 1
    hist = K.strata_histogram(K.strata_bins(s, "variance"))
    bud = {r.bin: r.budget for r in K.strata_budget(hist, 3).collect()}
    assert sum(bud.values()) == 3 and all(v <= 1 for v in bud.values())


def test_all_equal_and_all_negative_scores(spark):
    eq = spark.createDataFrame([(i, 0, 0.5) for i in range(4)], "sample_id long, label int, x double")
    assert {r.bin for r in K.strata_bins(eq, "x").collect()} == {0}
    neg = spark.createDataFrame([(i, 0, -float(i + 1)) for i in range(4)], "sample_id long, label int, x double")
    bins = {r.sample_id: r.bin for r in K.strata_bins(neg, "x").collect()}
    assert bins[0] == 49 and bins[3] == 0                 # the maximum (-1) stays inside the top bin
    ranked = K.class_balanced_bands(neg, "x").filter(F.col("band") == "top_1_2").collect()
    assert sorted(r.sample_id for r in ranked) == [0, 1]
