import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from divaug.functions import vectors as V
from divaug.operators import dynamics as D


def test_vector_scalars(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 0.0, 3.0], 2)], "a array<double>, b array<double>, y int")
    r = df.select(V.l2_distance("a", "b").alias("l2"), V.cosine_similarity("a", "b").alias("cos"),
                  V.argmax("a").alias("am"), V.entropy(V.softmax("a")).alias("h"),
                  V.margin(V.softmax("a"), F.col("y")).alias("mg")).first()
    a, b = np.array([1.0, 2.0, 3.0]), np.array([1.0, 0.0, 3.0])
    assert r.l2 == pytest.approx(np.linalg.norm(a - b + 1e-6))
    assert r.cos == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert r.am == 2
    p = np.exp(a) / np.exp(a).sum()
    assert r.h == pytest.approx(-(p * np.log(p + 1e-10)).sum())
    assert r.mg == pytest.approx(p[2] - p[1])


def test_argmax_first_index_on_ties(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "a array<double>")
    assert df.select(V.argmax("a")).first()[0] == 1


def _log(spark, rows):
    out = []
    for sid, epoch, label, probs in rows:
        out.append((sid, epoch, 0, label, [math.log(x) for x in probs]))
    return spark.createDataFrame(out, "sample_id long, epoch int, iteration int, label int, logp array<double>")


def test_score_table_hand_computed(spark):
    # sample 1: right, wrong, right -> 1 forgetting event, correctness 2
    rows = [(1, 0, 0, [0.6, 0.4]), (1, 1, 0, [0.3, 0.7]), (1, 2, 0, [0.8, 0.2]),
            # sample 2: epochs arrive out of order; wrong, right, wrong -> 1 event
            (2, 2, 1, [0.9, 0.1]), (2, 0, 1, [0.7, 0.3]), (2, 1, 1, [0.2, 0.8])]
    t = {r.sample_id: r for r in D.score_table(_log(spark, rows)).collect()}
    assert t[1].correctness == 2 and t[1].forgetting == 1 and t[1].last_correctness == 1
    assert t[2].correctness == 1 and t[2].forgetting == 1 and t[2].last_correctness == 0
    assert t[1].accumulated_margin == pytest.approx((0.6 - 0.4) + (0.3 - 0.7) + (0.8 - 0.2))
    assert t[1].variance == pytest.approx(np.std([0.6, 0.3, 0.8]))
    el2n_1 = math.sqrt(0.4 ** 2 + 0.4 ** 2) + math.sqrt(0.7 ** 2 + 0.7 ** 2)
    assert t[1].el2n == pytest.approx(el2n_1)
    assert t[1].confidence == pytest.approx(0.8)
    assert t[1].loss == pytest.approx(-math.log(0.8))


def test_variance_padding(spark):
    rows = [(1, 0, 0, [0.6, 0.4]), (1, 1, 0, [0.3, 0.7]), (1, 2, 0, [0.8, 0.2]),
            (2, 0, 0, [0.5, 0.5])]
    log = _log(spark, rows)
    t = {r.sample_id: r for r in D.score_table(log, pad_to=D.max_history(log)).collect()}
    assert t[2].variance == pytest.approx(np.std([0.5, 1.0, 1.0]))
    assert t[1].variance == pytest.approx(np.std([0.6, 0.3, 0.8]))


def test_duplicated_log_record_counts_once(spark):
    rows = [(1, 0, 0, [0.6, 0.4]), (1, 1, 0, [0.3, 0.7]), (1, 1, 0, [0.3, 0.7]), (1, 2, 0, [0.8, 0.2])]
    t = D.score_table(_log(spark, rows)).first()
    assert t.n_records == 3 and t.correctness == 2 and t.forgetting == 1
