"""The k-th least row of each group against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from divaug.operators import coreset as K
from divaug.operators import kselect as KS


def brute(rows, wanted, key):
    out = {}
    for g, tag, k in wanted:
        mine = sorted(key(r) for r in rows if r[0] == g)
        if mine and k >= 1:
            out[(g, tag)] = mine[min(k, len(mine)) - 1]
    return out


@pytest.mark.parametrize("few, kind", [(3, "plain"), (40, "ties"), (40, "wide"), (1024, "plain")])
def test_thresholds_equal_sorting(spark, monkeypatch, few, kind):
    monkeypatch.setattr(KS, "FEW", few)
    monkeypatch.setattr(KS, "CELLS", 16)
    r = random.Random(few)
    value = {"plain": lambda: r.random(), "ties": lambda: float(r.randrange(3)), "wide": lambda: r.choice([-1, 1]) * 10.0 ** r.randrange(-9, 9)}[kind]
    rows = [(r.choice("aab"), value(), i) for i in range(400)] + [("one", 5.0, 1000)] + [("same", 1.0, 7)] * 60
    wanted = [(g, t, k) for g in ("a", "b", "one", "same", "none") for t, k in (("x", 1), ("y", 57), ("z", 10**6), ("none", 0), ("less", -3))]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = KS.thresholds(df, spark.createDataFrame(wanted, "g string, tag string, k long"), "g", [F.col("v"), F.col("id").cast("double")], ["v", "id"])
    assert {(x.g, x.tag): tuple(x.last) for x in got.collect()} == brute(rows, wanted, lambda x: x[1:])


def test_draw_is_the_first_k_rows(spark, monkeypatch):
    monkeypatch.setattr(KS, "FEW", 8)
    df = spark.range(900).select(F.col("id"), (F.col("id") % 2).cast("int").alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    wanted = spark.createDataFrame([(0, "s", 10), (0, "l", 300), (1, "s", 3)], "g int, tag string, k long")
    last = KS.thresholds(df, wanted, "g", [KS.key_number("h"), F.col("id").cast("double")], ["h", "id"])
    got = {}
    for x in KS.draw(df, last, "g", ["h", "id"]).collect():
        got.setdefault((x.g, x.tag), set()).add(x.id)
    rows = sorted((r.h, r.id, r.g) for r in df.collect())
    for g, t, k in ((0, "s", 10), (0, "l", 300), (1, "s", 3)):
        assert got[(g, t)] == {i for h, i, x in [y for y in rows if y[2] == g][:k]}


def test_values_with_nulls_and_nan(spark):
    vals = [3.0, None, float("nan"), -1.0, 2.5, None, 2.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "sample_id long, m double")
    for desc in (False, True):
        place, num = KS.value_numbers("m", desc)
        x = df.select(F.lit(0).alias("g"), place.alias("p"), num.alias("n"), "sample_id")
        order = [r.sample_id for r in df.orderBy(F.col("m").desc_nulls_last() if desc else F.col("m").asc_nulls_last(), "sample_id").collect()]
        wanted = spark.createDataFrame([(0, str(k), k) for k in range(1, 8)], "g int, tag string, k long")
        last = KS.thresholds(x, wanted, "g", [F.col("p"), F.col("n"), F.col("sample_id").cast("double")], ["p", "n", "sample_id"])
        assert {r["tag"]: r["last"]["sample_id"] for r in last.collect()} == {str(k): order[k - 1] for k in range(1, 8)}


def ranked(rows, ratio, seed=42):
    """The same draw by sorting: prune, bins, budget, md5 order."""
    import hashlib
    import math
    n = len(rows)
    kept = sorted(rows, key=lambda r: (r[2], r[0]))[int(n * 0.1):]
    lo, hi = min(r[2] for r in kept), max(r[2] for r in kept)
    step = (hi + 1e-4 * abs(hi) - lo) / K.STRATA
    bins = {b: [] for b in range(K.STRATA)}
    for r in kept:
        bins[min(math.floor((r[2] - lo) / step), K.STRATA - 1) if step > 0 else 0].append(r[0])
    rest, out = int(ratio * n), set()
    for i, (b, ids) in enumerate(sorted(bins.items(), key=lambda x: (len(x[1]), x[0]))):
        take = min(len(ids), rest // (K.STRATA - i))
        rest -= take
        out |= set(sorted(ids, key=lambda s: (hashlib.md5(f"{seed}:{s}".encode()).hexdigest(), s))[:take])
    return out


@pytest.mark.parametrize("few", [40, 1024])
def test_ccs_draws_equal_sorted_draws(spark, monkeypatch, few):
    monkeypatch.setattr(KS, "FEW", few)
    monkeypatch.setattr(KS, "CELLS", 16)
    r = random.Random(1)
    rows = [(i, i % 3, round(r.gauss(0, 1), 1)) for i in range(500)]
    s = spark.createDataFrame(rows, "sample_id long, label int, accumulated_margin double")
    got = {}
    for x in K.ccs_bands(s).collect():
        got.setdefault(x.band, set()).add(x.sample_id)
    for band, ratio in (("top_1_2", 1 / 2), ("top_1_3", 1 / 3), ("top_2_3", 2 / 3)):
        assert got[band] == ranked(rows, ratio)
    assert got["mid_1_3"] == got["top_2_3"] - got["top_1_3"]


def actions(spark, work):
    """The number of SQL actions of ``work``."""
    def last():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        seen = spark._jsparkSession.sharedState().statusStore().executionsList()
        return max((seen.apply(i).executionId() for i in range(seen.size())), default=-1)
    before = last()
    work()
    return last() - before


def test_ccs_takes_few_actions(spark):
    rows = [(i, i % 3, float((i * 37) % 1013)) for i in range(9000)]
    s = spark.createDataFrame(rows, "sample_id long, label int, accumulated_margin double")
    # write, span, prune (a round, the end), edges, strata sizes, budgets, draw, result,
    # and a round where a group is large
    assert actions(spark, lambda: K.ccs_bands(s).count()) <= 10


def test_empty_and_tiny_tables(spark):
    schema = "sample_id long, label int, accumulated_margin double"
    assert K.ccs_bands(spark.createDataFrame([], schema)).collect() == []
    assert K.ccs_bands(spark.createDataFrame([(1, 0, 1.0)], schema)).collect() == []
