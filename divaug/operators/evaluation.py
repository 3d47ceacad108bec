"""Task evaluation summaries (E1, E3-E5, K11) and the re-aimed trainer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divaug.functions import vectors as V
from divaug.functions.hashing import h24
from divaug.functions.vectors import rnd
from divaug.session import stored

ROUND_ACC = 6
ROUND_SUMMARY = 4


def accuracy(pred: DataFrame, keys=("split", "seed")) -> DataFrame:
    """mean(argmax(logits) == label) per key."""
    ok = (V.argmax("logits") == F.col("label")).cast("double")
    return pred.groupBy(*keys).agg(rnd(F.avg(ok), ROUND_ACC).alias("accuracy"))


def seed_summary(acc: DataFrame) -> DataFrame:
    """Per split mean and sample std over seeds, rounded to 4 (one seed:
    NULL std)."""
    return acc.groupBy("split").agg(rnd(F.avg("accuracy"), ROUND_SUMMARY).alias("avg"),
                                    rnd(F.stddev_samp("accuracy"), ROUND_SUMMARY).alias("std"))


def performance_matrix(acc: DataFrame, splits: list[str]) -> DataFrame:
    """rows = seeds then 'avg', 'std'; columns = splits in fixed order.
    Summary rows are computed from seed rows only (never stored with them).
    The accuracies, one row for each split and seed, are read three times: they
    are written once, so that the fits and the scoring behind them run once."""
    from divaug.sources.catalog import ordered_pivot
    acc = stored(acc.select("seed", "split", "accuracy"), "accuracy")
    s = seed_summary(acc)
    long = (acc.select(F.col("seed").cast("string").alias("row_key"), "split", F.col("accuracy").alias("value"))
               .unionByName(s.select(F.lit("avg").alias("row_key"), "split", F.col("avg").alias("value")))
               .unionByName(s.select(F.lit("std").alias("row_key"), "split", F.col("std").alias("value"))))
    return ordered_pivot(long, "row_key", "split", "value", splits)


def best_key(acc: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """Per dataset the coreset key whose top-2/3 split has the best mean
    accuracy (ties: alphabetically first key)."""
    k = acc.filter(F.col("split").endswith("_top_2_3")).withColumn(
        "key", F.regexp_replace("split", "_top_2_3$", ""))
    m = k.groupBy(dataset_col, "key").agg(F.avg("accuracy").alias("avg_acc"))
    return m.groupBy(dataset_col).agg(
        F.min_by("key", F.struct(-rnd("avg_acc", 12), F.col("key"))).alias("best_key"),
        rnd(F.max("avg_acc"), ROUND_ACC).alias("best_avg"))


def missing_splits(used: DataFrame, data: DataFrame) -> DataFrame:
    """E5: used splits absent from the data (must be empty to proceed)."""
    present = data.select("split").distinct()
    return used.join(present, "split", "left_anti")


def seeded_weight(seed, id_col="sample_id") -> Column:
    """-ln(u) of a hash of (seed, id): a random reweighting of all rows, so the
    seed changes the fit and every training row still counts."""
    u = (h24(F.concat_ws(":", seed.cast("string"), F.col(id_col).cast("string"))) + 1) / F.lit(float(2 ** 24))
    return -F.log(u)


def split_seed_models(train: DataFrame, seeds) -> DataFrame:
    """E2 (re-aimed) fits: per (split, seed) the weighted class centres, all in
    one explode and one aggregation; (split, seed, centers), one row each."""
    rows = train.select("split", "label", "sample_id", array_to_vector("vec").alias("_v"),
                        F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    rows = rows.withColumn("_w", seeded_weight(F.col("seed")))
    mean = Summarizer.metrics("mean").summary(F.col("_v"), F.col("_w"))["mean"]
    # a weight of 0 (u = 1) alone in its class leaves no centre
    centers = rows.filter("_w > 0").groupBy("split", "seed", "label").agg(vector_to_array(mean).alias("center"))
    return centers.groupBy("split", "seed").agg(F.sort_array(F.collect_list(F.struct("label", "center"))).alias("centers"))


ROWS = 256   # test rows scored at a time


def _scorer(models: list[tuple[str, int, list[int], list[list[float]]]], schema: T.StructType):
    """Every (split, seed, labels, centres) against each test row.  A distance is
    summed dimension by dimension, as ``V.sq_distance`` does; a vector that is
    null, has a null or is of another length than the centre has none."""
    names, seeds = pa.array([m[0] for m in models], pa.string()), pa.array([m[1] for m in models], pa.int32())
    centers = [c for m in models for c in m[3]]
    dims = max(map(len, centers))
    table = np.array([c + [0.0] * (dims - len(c)) for c in centers]).T.copy()
    lengths = np.array([len(c) for c in centers])
    starts = np.cumsum([0, *[len(m[3]) for m in models]])
    classes = [range(max(m[2]) + 1) if max(m[2]) >= 0 else range(0, max(m[2]) - 1, -1) for m in models]

    def logits(vec: pa.ListArray) -> np.ndarray:
        size = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False).copy()
        flat = vec.flatten()
        at, place = np.repeat(np.arange(len(vec)), np.maximum(size, 0)), np.concatenate([np.arange(max(n, 0)) for n in size] or [np.zeros(0, int)])
        size[at[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
        x = np.zeros((len(vec), dims))
        inside = place < dims
        x[at[inside], place[inside].astype(np.int64)] = flat.to_numpy(zero_copy_only=False).astype(np.float64)[inside]
        total = np.zeros((len(vec), len(lengths)))
        for d in range(dims):
            step = x[:, d, None] - table[None, d]
            total += np.multiply(step, step, out=step)
        return np.where(size[:, None] == lengths[None], -total, -np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                n, near, values = b.num_rows, logits(b.column("vec")), []
                for k, (_, _, labels, _) in enumerate(models):
                    out = np.full((n, len(classes[k])), -np.inf)
                    for j, label in enumerate(labels):
                        if label in classes[k]:
                            out[:, classes[k].index(label)] = near[:, starts[k] + j]
                    values.append(out.ravel())
                which, row = np.repeat(np.arange(len(models)), n), np.tile(np.arange(n), len(models))
                ends = np.cumsum(np.concatenate([[0], np.repeat([len(c) for c in classes], n)])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), seeds.take(pa.array(which)), b.column("sample_id").take(pa.array(row)),
                                                  b.column("label").take(pa.array(row)), lists], schema.names)
    return run


def split_seed_predictions(train: DataFrame, test: DataFrame, splits, seeds) -> DataFrame:
    """Logits of every split's and seed's nearest-centre classifier for
    the test rows in one scoring pass: split, seed, sample_id, label, logits.
    The logit of class k is the negative squared distance to its centre, and
    minus infinity where the split has no row of the class.

    The centres (splits times seeds times classes times dimensions, whatever the
    number of rows) go out with the plan; a batch of test rows meets all of them
    in numpy."""
    fitted = {(m["split"], m["seed"]): m["centers"]
              for m in split_seed_models(train.filter(F.col("split").isin(list(splits))), seeds).collect()}
    if any(c["label"] is None for m in fitted.values() for c in m):
        raise ValueError("a training row has no label")
    models = [(s, int(k), [c["label"] for c in m], [c["center"] for c in m]) for s in splits for k in seeds if (m := fitted.get((s, int(k))))]
    kinds = test.select("sample_id", "label").schema.fields
    schema = T.StructType([T.StructField("split", T.StringType()), T.StructField("seed", T.IntegerType()), *kinds, T.StructField("logits", T.ArrayType(T.DoubleType()))])
    if not models:
        return test.sparkSession.createDataFrame([], schema)
    return test.select("sample_id", "label", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_scorer(models, schema), schema)


def split_seed_accuracy(train: DataFrame, test: DataFrame, splits, seeds) -> DataFrame:
    """E2 + E1: accuracy of every split and seed on the test rows (ties: least label)."""
    return accuracy(split_seed_predictions(train, test, splits, seeds))
