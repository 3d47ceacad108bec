"""Coreset selection over a score table (one row per sample).

Class-balanced and global cuts are filters on exact ranks from ``rank_within``
(range partitioned, no single-task window), all bands of one key from a single
rank; the CCS draws compare rows with the k-th row of their stratum
(``kselect``).  Both stay distributed when one label or one stratum holds a
large share of the rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divaug.functions.hashing import seeded_key
from divaug.operators import kselect as KS
from divaug.operators.ranking import rank_within
from divaug.session import stored

# Fixed values of the reference's selection step.
CORESET_KEYS = ["entropy", "el2n", "variance"]
MIS_KEY = "accumulated_margin"
MIS_RATIO = 0.1
STRATA = 50
DESCENDING_KEYS = ["entropy", "forgetting", "el2n", "ssl"]   # prune direction
BANDS = {"top_1_2": (0.0, 1 / 2), "top_1_3": (0.0, 1 / 3), "top_2_3": (0.0, 2 / 3), "mid_1_3": (1 / 3, 2 / 3)}


def _order(key: str, descending: bool):
    c = F.col(key)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("sample_id").asc()]


def class_balanced_rank(scores: DataFrame, key: str, descending: bool = True) -> DataFrame:
    """Adds ``rank`` within label and ``n_label``."""
    return rank_within(scores, _order(key, descending), ["label"], name="rank",
                       count_name="n_label")


def _cut(n_col, ratio: float):
    return F.floor(F.col(n_col).cast("double") * F.lit(float(ratio)))


def class_balanced_top(scores: DataFrame, key: str, ratio: float, descending: bool = True) -> DataFrame:
    """K1: per label keep floor(n_label * ratio) best rows by ``key``."""
    r = class_balanced_rank(scores, key, descending)
    return r.filter(F.col("rank") <= _cut("n_label", ratio))


def class_balanced_bands(scores: DataFrame, key: str, bands=("top_1_2", "top_1_3", "mid_1_3", "top_2_3"),
                         descending: bool = True) -> DataFrame:
    """Every band of one key from a single rank.

    Output: sample_id, label, score, rank, band (a row per band it belongs to).
    """
    r = class_balanced_rank(scores.select("sample_id", "label", F.col(key).alias("score")),
                            "score", descending)
    arr = F.array(*[F.when((F.col("rank") > _cut("n_label", BANDS[b][0]))
                           & (F.col("rank") <= _cut("n_label", BANDS[b][1])), F.lit(b)) for b in bands])
    return (r.withColumn("band", F.explode(F.filter(arr, lambda x: x.isNotNull())))
             .select("sample_id", "label", "score", "rank", "band"))


def global_rank(scores: DataFrame, key: str, descending: bool) -> DataFrame:
    return rank_within(scores, _order(key, descending), [], name="grank", count_name="n_total")


def global_top(scores: DataFrame, key: str, ratio: float, descending: bool = True) -> DataFrame:
    """K2: keep floor(n * ratio) best rows overall."""
    return global_rank(scores, key, descending).filter(F.col("grank") <= _cut("n_total", ratio))


def mislabel_prune(scores: DataFrame, mis_key: str = MIS_KEY, mis_ratio: float = MIS_RATIO) -> DataFrame:
    """K4: drop the floor(n * mis_ratio) worst rows by ``mis_key``.

    The direction follows the key: descending for entropy, forgetting, el2n,
    ssl; ascending otherwise (small margin = likely mislabelled)."""
    r = global_rank(scores, mis_key, mis_key in DESCENDING_KEYS)
    return r.filter(F.col("grank") > _cut("n_total", mis_ratio))


def strata_bins(scores: DataFrame, key: str, strata: int = STRATA) -> DataFrame:
    """K5: equal-width bins on [min, max + 1e-4*|max|); zero width -> bin 0."""
    mm = scores.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi = (mm["lo"], mm["hi"]) if mm else (None, None)
    if lo is None:
        return scores.withColumn("bin", F.lit(None).cast("int"))
    top = hi + 1e-4 * abs(hi)
    step = (top - lo) / strata
    if step > 0:
        b = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(step)), F.lit(strata - 1)).cast("int")
    else:
        b = F.lit(0)
    return scores.withColumn("bin", b)


def strata_histogram(binned: DataFrame, strata: int = STRATA, counted: bool = False) -> DataFrame:
    """bin, size for all ``strata`` bins (empty bins included); ``counted``:
    ``binned`` has the sizes of the others."""
    spark = binned.sparkSession
    counts = binned if counted else binned.groupBy("bin").agg(F.count(F.lit(1)).alias("size"))
    allb = spark.range(strata).select(F.col("id").cast("int").alias("bin"))
    return allb.join(F.broadcast(counts), "bin", "left").select(
        "bin", F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size"))


def strata_budgets(hist: DataFrame, totals: dict[str, int]) -> DataFrame:
    """K6 for several totals: (tag, bin, budget).  Water-filling of a total over
    bins in ascending size order (ties by bin): take = min(size, rest div
    bins_left).  The fold runs over the <= ``strata``-element array in one
    expression."""
    sorted_bins = F.array_sort(F.collect_list(F.struct(F.col("size"), F.col("bin"))))
    wanted = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(n).cast("bigint").alias("total")) for t, n in totals.items()])
    g = hist.groupBy().agg(sorted_bins.alias("b"), F.count(F.lit(1)).alias("nb")).select("b", "nb", F.explode(wanted).alias("w"))
    init = F.struct(F.col("w.total").alias("rest"), F.lit(0).cast("bigint").alias("i"),
                    F.array().cast("array<struct<bin:int,budget:bigint>>").alias("out"))

    def step(acc, x):
        left = F.col("nb") - acc["i"]
        take = F.least(x["size"], F.floor(acc["rest"] / left)).cast("bigint")
        return F.struct((acc["rest"] - take).alias("rest"), (acc["i"] + 1).alias("i"),
                        F.array_append(acc["out"], F.struct(x["bin"].alias("bin"), take.alias("budget"))).alias("out"))
    folded = g.select("w.tag", F.explode(F.aggregate("b", init, step)["out"]).alias("o"))
    return folded.select("tag", "o.bin", "o.budget")


def strata_budget(hist: DataFrame, total: int) -> DataFrame:
    """K6 for one total: bin, budget."""
    return strata_budgets(hist, {"it": total}).drop("tag")


def ccs_cuts(scores: DataFrame, ratios: dict[str, float], key: str = MIS_KEY, mis_ratio: float = MIS_RATIO,
             strata: int = STRATA, seed: int = 42) -> DataFrame:
    """K4-K8 for all ratios at once: the rows that are left after the
    mislabel prune, with their stratum ``bin`` and a flag ``in_<tag>`` for each
    ratio: whether the row is among the budget's rows of its stratum in the
    seeded md5 order.

    The scores are read many times, so (id, label, key) is written once.  The
    prune and the draws compare rows with the k-th row of their group
    (``kselect``); nothing is sorted or numbered."""
    spark = scores.sparkSession
    place, number = KS.value_numbers(key, key in DESCENDING_KEYS)
    narrow = scores.select("sample_id", "label", key, place.alias("_place"), number.alias("_num"), F.lit(0).alias("_all"))
    order = ["_place", "_num", "sample_id"]
    numbers = [F.col("_place"), F.col("_num"), F.col("sample_id").cast("double")]
    s = stored(narrow, "ccs")
    whole = KS.spans(s, "_all", numbers)
    ends = whole.collect()   # one row
    n = sum(r["_n"] for r in ends)
    prune = spark.createDataFrame([(0, "mis", int(n * float(mis_ratio)))], "_all int, tag string, k long")
    worst = KS.last_rows(s, prune, "_all", numbers, order, spark.createDataFrame(ends, whole.schema))
    kept = s.filter(F.struct(*order) > F.struct(*[F.lit(v).cast(s.schema[c].dataType) for c, v in zip(order, worst[0]["last"])])) if worst else s
    kept = kept.select("sample_id", "label", key)
    rows = strata_bins(kept, key, strata).withColumn("_k", seeded_key(seed))
    numbers = [KS.key_number("_k"), F.col("sample_id").cast("double")]
    sizes = KS.spans(rows.filter("bin IS NOT NULL"), "bin", numbers)
    start = spark.createDataFrame(sizes.collect(), sizes.schema)   # one row for each stratum
    hist = strata_histogram(start.select("bin", F.col("_n").alias("size")), strata, counted=True)
    wanted = strata_budgets(hist, {t: int(float(r) * n) for t, r in ratios.items()}).withColumnRenamed("budget", "k")
    cuts = KS.thresholds(rows, wanted, "bin", numbers, ["_k", "sample_id"], start)
    by_bin = cuts.groupBy("bin").agg(*[F.max(F.when(F.col("tag") == t, F.col("last"))).alias(f"_{t}") for t in ratios])
    out = rows.join(F.broadcast(by_bin), "bin", "left")
    return out.select("sample_id", "label", "bin", *[
        F.coalesce(F.struct("_k", "sample_id") <= F.col(f"_{t}"), F.lit(False)).alias(f"in_{t}") for t in ratios])


def ccs_select(scores: DataFrame, ratio: float, key: str = MIS_KEY, seed: int = 42) -> DataFrame:
    """K7/K8 for one ratio: sample_id, label, bin."""
    return ccs_cuts(scores, {"it": ratio}, key, seed=seed).filter("in_it").drop("in_it")


def ccs_bands(scores: DataFrame, key: str = MIS_KEY, seed: int = 42) -> DataFrame:
    """K8/K9: CCS top_1_2, top_1_3, top_2_3 and mid_1_3 (= top_2_3 without
    top_1_3): sample_id, label, bin, band.

    One md5 order per stratum is shared by all draws, so the 1/3 draw is
    inside the 2/3 draw whenever each stratum's budget grows with the ratio.
    """
    r = ccs_cuts(scores, {"top_1_2": 1 / 2, "top_1_3": 1 / 3, "top_2_3": 2 / 3}, key, seed=seed)
    bands = [F.when(F.col(f"in_{b}"), F.lit(b)) for b in ("top_1_2", "top_1_3", "top_2_3")]
    bands.append(F.when(F.col("in_top_2_3") & ~F.col("in_top_1_3"), F.lit("mid_1_3")))
    return r.select("sample_id", "label", "bin", F.explode(F.array_compact(F.array(*bands))).alias("band"))
