
from divaug.operators import coreset as K


def _scores(spark, n=90, labels=3):
    rows = [(i, i % labels, float((i * 37) % 101), float((i * 53) % 89) - 40.0) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, label int, variance double, accumulated_margin double")


def test_class_balanced_bands_nested_and_disjoint(spark):
    s = _scores(spark)
    b = K.class_balanced_bands(s, "variance").collect()
    band = {}
    for r in b:
        band.setdefault(r.band, set()).add(r.sample_id)
    assert band["top_1_3"] <= band["top_2_3"]
    assert band["mid_1_3"] == band["top_2_3"] - band["top_1_3"]
    assert len(band["top_1_2"]) == 3 * 15 and len(band["top_1_3"]) == 3 * 10
    # per label the kept rows are the best scores
    pdf = s.toPandas()
    for lab, g in pdf.groupby("label"):
        top = set(g.sort_values(["variance", "sample_id"], ascending=[False, True]).head(10).sample_id)
        assert top == {x for x in band["top_1_3"] if x % 3 == lab}


def test_budget_matches_loop(spark):
    sizes = [0, 5, 1, 30, 2, 2, 9, 0, 4, 7]
    hist = spark.createDataFrame(list(enumerate(sizes)), "bin int, size long")

    def loop(total):
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        rest, out = total, {}
        for k, i in enumerate(order):
            take = min(sizes[i], rest // (len(sizes) - k))
            out[i] = take
            rest -= take
        return out
    for total in (0, 7, 25, 45, 60, 200):
        got = {r.bin: r.budget for r in K.strata_budget(hist, total).collect()}
        assert got == loop(total)
        assert sum(got.values()) == min(total, sum(sizes))


def test_strata_bins_edges(spark):
    s = spark.createDataFrame([(1, 0, -5.0), (2, 0, -1.0), (3, 0, -1.0)], "sample_id long, label int, x double")
    b = {r.sample_id: r.bin for r in K.strata_bins(s, "x").collect()}
    assert b[1] == 0 and b[2] == 49 and b[3] == 49     # max < 0 stays binned
    z = spark.createDataFrame([(1, 0, 0.0), (2, 0, 0.0)], "sample_id long, label int, x double")
    assert {r.bin for r in K.strata_bins(z, "x").collect()} == {0}


def test_ccs_bands_sizes(spark):
    s = _scores(spark, n=300)
    b = K.ccs_bands(s).groupBy("band").count().collect()
    counts = {r.band: r["count"] for r in b}
    assert counts["top_1_2"] == 150 and counts["top_1_3"] == 100 and counts["top_2_3"] == 200
    pruned = K.mislabel_prune(s).count()
    assert pruned == 270
