import math

import numpy as np
import pytest

from divaug.functions import text as TX
from divaug.operators import diversity as DV
from divaug.operators import tokens as TK


def _vecs(spark, rng, sizes):
    rows, sid = [], 0
    for lab, m in enumerate(sizes):
        for _ in range(m):
            rows.append(("s", lab, sid, rng.normal(size=6).tolist()))
            sid += 1
    return spark.createDataFrame(rows, "split string, label int, sample_id long, vec array<double>"), rows


def _brute(x):
    m, h = x.shape
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    w = np.where(d > 0, d ** math.log(h), 0.0)
    p = w / w.sum(1, keepdims=True)
    ent = -(p * np.log(p + 1e-10)).sum(1) / m
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return d.mean(), ent.sum() / math.log(m - 1), 1 - (u @ u.T).mean()


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_pair_stats_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(0)
    df, rows = _vecs(spark, rng, [20, 33, 2])
    got = {r.label: r for r in DV.class_pair_stats(df, block_rows=block_rows).collect()}
    lin = {r.label: r for r in DV.class_linear_stats(df).collect()}
    for lab in (0, 1):
        x = np.array([r[3] for r in rows if r[1] == lab])
        dist, hom, dis = _brute(x)
        assert got[lab].avg_distance == pytest.approx(dist, rel=1e-9)
        assert got[lab].homogeneity == pytest.approx(hom, rel=1e-7)
        assert lin[lab].dissimilarity == pytest.approx(dis, abs=1e-9)
        assert 0 <= got[lab].homogeneity <= 1
    assert got[2].homogeneity is None   # m <= 2


def test_identical_vectors_undefined_homogeneity(spark):
    df = spark.createDataFrame([("s", 0, i, [1.0, 2.0, 3.0]) for i in range(4)],
                               "split string, label int, sample_id long, vec array<double>")
    r = DV.class_pair_stats(df).first()
    assert r.avg_distance == 0 and r.homogeneity is None


def test_tokens_and_trigrams(spark):
    df = spark.createDataFrame([(1, "Hello, World! a b.  c?"), (2, "x y"), (3, "")], "sample_id long, text string")
    r = {x.sample_id: x for x in df.select("sample_id", TX.normalized_tokens("text").alias("t")).collect()}
    assert r[1].t == ["hello", "world", "a", "b", "c"] and r[3].t == []
    g = {x.sample_id: x.g for x in df.select("sample_id", TX.word_ngrams(TX.normalized_tokens("text"), 3).alias("g")).collect()}
    assert g[1] == ["hello world a", "world a b", "a b c"] and g[2] == [] and g[3] == []


def test_unique_ngrams_brute(spark):
    texts = ["the cat sat on the mat", "the cat sat there", "on the mat the cat sat"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "sample_id long, text string, split string")
    got = TK.unique_ngrams(df).first()["unique_3grams"]
    exp = set()
    for t in texts:
        w = t.split()
        exp |= {" ".join(w[i:i + 3]) for i in range(len(w) - 2)}
    assert got == len(exp)


def test_hashed_embedding_unit_norm(spark):
    df = spark.createDataFrame([(1, "a b c a"), (2, "...")], "sample_id long, text string")
    r = {x.sample_id: x.vec for x in TK.hashed_embedding(df).collect()}
    assert np.linalg.norm(r[1]) == pytest.approx(1.0)
    assert np.allclose(r[2], 0.0)


@pytest.mark.parametrize("block_rows", [16384, 1])
def test_pair_stats_repeated_ids_and_null_labels(spark, block_rows):
    """Shared ids (a paraphrase keeps its seed's id) and rows without a label
    change nothing; blocks without rows are no error."""
    import numpy as np
    r = np.random.default_rng(5)
    vecs = [[float(v) for v in x] for x in r.normal(size=(6, 4))]
    schema = "sample_id long, label int, vec array<double>, split string"
    own = spark.createDataFrame([(i, None, v, "s") for i, v in enumerate(vecs)], schema)
    shared = spark.createDataFrame([(i // 2, None, v, "s") for i, v in enumerate(vecs)], schema)
    a, b = (DV.class_pair_stats(d, block_rows=block_rows).collect() for d in (own, shared))
    assert len(a) == len(b) == 1 and a[0].n == b[0].n == 6 and a[0].label is None
    assert abs(a[0].homogeneity - b[0].homogeneity) < 1e-9 and abs(a[0].avg_distance - b[0].avg_distance) < 1e-9
    x = np.array(vecs + vecs[:2])
    twice = spark.createDataFrame([(i % 6, 1, v, "s") for i, v in enumerate(vecs + vecs[:2])], schema)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    w = d ** np.log(4)
    p = w / w.sum(1, keepdims=True)
    want = (-(p * np.log(p + 1e-10)).sum(1) / 8).sum() / np.log(7)
    got = DV.class_pair_stats(twice, block_rows=block_rows).first()
    assert abs(got.homogeneity - want) < 1e-6 and abs(got.avg_distance - d.mean()) < 1e-6
    assert DV.class_metrics(own, block_rows=block_rows).first().homogeneity is not None


def test_pair_fields_take_the_first_marker(spark):
    from divaug.functions import text as TX
    df = spark.createDataFrame([("Premise: a Hypothesis: b Hypothesis: c",), ("Premise: a",)], "t string")
    got = [r.p for r in df.select(TX.split_pair("t").alias("p")).collect()]
    assert (got[0].a, got[0].b) == ("a ", "b ") and got[1] is None


def test_encode_keeps_the_separator_and_counts_all_tokens(spark):
    from divaug.operators import tokens as TK
    df = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(20)), "a"), (2, "", "a"), (3, "t1 t1", "b")],
                               "sample_id long, text string, split string")
    got = {r.sample_id: r.input_ids for r in TK.encode(df, TK.vocabulary(df), max_len=8).collect()}
    assert len(got[1]) == 8 and got[1][0] == 2 and got[1][-1] == 3 and got[2] == [2, 3, 0, 0, 0, 0, 0, 0]
    assert got[3] == [2, 4, 4, 3, 0, 0, 0, 0]
    assert {r.split: r.token_count for r in TK.split_token_count(df).collect()} == {"a": 23, "b": 3}


def test_pair_kernel_reads_arrow_and_takes_each_pair_once():
    """A block with itself and with another one, over tile borders, with equal rows, against all pairs."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    x = rng.normal(size=(DV.TILE * 2 + 7, 8))
    x[3] = x[DV.TILE + 1]

    def want(a, b, same):
        d = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))
        if same:
            np.fill_diagonal(d, 0)
        w = np.where(d > 0, d ** np.log(8), 0)
        return np.stack([m.sum(1) for m in (d, w, np.where(w > 0, w * np.log(np.where(w > 0, w, 1)), 0), w > 0)])

    def run(blk, lo, hi):
        n = len(blk)
        t = pa.table({"split": ["a"] * n, "label": pa.array([None] * n, pa.int32()), "_k": pa.array(range(n), pa.int64()), "vec": list(x[:n]),
                      "_blk": pa.array(blk, pa.int32()), "_lo": pa.array([lo] * n, pa.int32()), "_hi": pa.array([hi] * n, pa.int32())})
        r = DV._pair_kernel(t).to_pandas().sort_values("_k")
        return r[["dist_sum", "w_sum", "wlogw_sum", "nnz"]].to_numpy().T

    near = lambda a, b: np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-6)
    near(run([4] * len(x), 4, 4)[:3], want(x, x, True)[:3])
    first = np.arange(len(x)) % 3 == 0
    got = run(np.where(first, 0, 2), 0, 2)
    near(got[:3, first], want(x[first], x[~first], False)[:3])
    near(got[:3, ~first], want(x[~first], x[first], False)[:3])
    assert (run([0] * 5, 0, 1) == 0).all()
