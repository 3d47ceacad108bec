"""Q8: one mini-batch softmax training run that logs every epoch.

The rows are written once, one folder for each batch, so a step reads its
batch and nothing else.  A row's batch is a hash of its id; the order of the
batches in an epoch is a seeded permutation, so a run can be repeated.  A step
is one Spark job: tasks sum the gradients of their rows in numpy, Spark sums
them by weight, and as many numbers as the model has weights reach the driver
(classes times dimensions, whatever the number of rows).  At the end of an
epoch its model goes out with the plan and one job writes the log-probabilities
of all rows as that epoch's commit.

Rows without id, label or vector have no place in a log and are left out;
repeated rows count as often as they occur; a vector of another length or a
label that is no class is an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divaug.functions.hashing import h24
from divaug.session import shared_path
from divaug.sources.commits import EpochLog

EPOCHS, BATCHES, RATE = 3, 8, 2.0


def batch_of(seed: int, batches: int, id_col: str = "sample_id"):
    return (h24(F.concat(F.lit(f"{seed}:batch:"), F.col(id_col).cast("string"))) % batches).cast("int")


def batch_order(seed: int, epoch: int, batches: int) -> list[int]:
    """The seeded order of an epoch's batches."""
    return sorted(range(batches), key=lambda b: hashlib.md5(f"{seed}:{epoch}:{b}".encode()).hexdigest())


def _inputs(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dims + 1) features with a constant 1, and the labels."""
    vec = batch.column("vec")
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != dims * batch.num_rows or (np.diff(vec.offsets.to_numpy()) != dims).any():
        raise ValueError(f"a vector has not {dims} dimensions")
    return np.hstack([flat.reshape(-1, dims), np.ones((batch.num_rows, 1))]), batch.column("label").to_numpy()


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _gradients(weights: np.ndarray):
    """One row (weight's place, sum over the task's rows) for each weight, and
    the number of rows under place -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(weights), 0
        for b in batches:
            x, label = _inputs(b, weights.shape[1] - 1)
            if len(label) and not 0 <= label.min() <= label.max() < len(weights):
                raise ValueError(f"a label is none of 0 to {len(weights) - 1}")
            err = np.exp(_log_softmax(x @ weights.T))
            err[np.arange(len(label)), label] -= 1.0
            total += err.T @ x
            n += len(label)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, total.size), pa.int32()), pa.array(np.append(float(n), total.ravel()))], ["at", "g"])
    return run


def _scorer(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = _inputs(b, weights.shape[1] - 1)
            logp = _log_softmax(x @ weights.T)
            lists = pa.ListArray.from_arrays(np.arange(0, logp.size + 1, len(weights), dtype=np.int32), pa.array(logp.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), b.column("iteration"), b.column("label"), lists],
                                             ["sample_id", "iteration", "label", "logp"])
    return run


def train_log(data: DataFrame, log: EpochLog, seed: int = 42, epochs: int = EPOCHS, batches: int = BATCHES,
              rate: float = RATE) -> list[np.ndarray]:
    """Trains on ``data`` (sample_id, label, vec) and commits (sample_id,
    iteration, label, logp) to ``log`` at the end of each epoch; returns the
    epochs' weights (classes x (dims + 1)).  ``iteration`` is the place of a
    row's batch in the epoch."""
    spark = data.sparkSession
    rows = data.filter("sample_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").select(
        F.col("sample_id").cast("long").alias("sample_id"), F.col("label").cast("int").alias("label"),
        F.col("vec").cast("array<double>").alias("vec"), batch_of(seed, batches).alias("batch"))
    path = shared_path(spark, "divaug-runs", f"batches-{uuid.uuid4().hex}")
    rows.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    shape = stored.agg(F.max("label").alias("label"), F.max(F.size("vec")).alias("dims")).first()
    models = []
    weights = np.zeros(((shape["label"] or 0) + 1, (shape["dims"] or 0) + 1))
    for epoch in range(epochs):
        order = batch_order(seed, epoch, batches)
        for b in order:
            sums = (stored.filter(F.col("batch") == b).select("label", "vec").mapInArrow(_gradients(weights), "at int, g double")
                          .groupBy("at").agg(F.sum("g").alias("g")).toArrow())
            if sums.num_rows:   # a batch may be empty
                at, g = sums.column("at").to_numpy(), sums.column("g").to_numpy()
                total = np.zeros(weights.size)
                total[at[at >= 0]] = g[at >= 0]
                weights = weights - rate * total.reshape(weights.shape) / g[at < 0][0]
        place = F.create_map(*[x for i, b in enumerate(order) for x in (F.lit(b), F.lit(i))])
        log.write_epoch(epoch, stored.select("sample_id", F.element_at(place, F.col("batch")).alias("iteration"), "label", "vec")
                        .mapInArrow(_scorer(weights), "sample_id long, iteration int, label int, logp array<double>"))
        models.append(weights)
    return models


def oracle_ctes(seed: int = 42, epochs: int = EPOCHS, batches: int = BATCHES, rate: float = RATE) -> list[str]:
    """The run in SQL over ``fx_vec``, a CTE for each step; the last one, sm_log,
    is (sample_id, epoch, iteration, label, k, logp)."""
    from divaug.plans.sqlparts import dbl, h24 as sql_h24
    out = [f"""sm_rows AS MATERIALIZED (SELECT sample_id, label, list_append(vec, 1.0) AS x,
       {sql_h24(f"concat('{seed}:batch:', sample_id)")} % {batches} AS batch FROM fx_vec WHERE label IS NOT NULL)""",
           """sm_w0 AS MATERIALIZED (SELECT k, (SELECT list_transform(any_value(x), lambda v: 0.0::DOUBLE) FROM sm_rows) AS w
       FROM generate_series(0, (SELECT max(label) FROM sm_rows)) t(k))"""]
    scored = """SELECT sample_id, label, x, k, z - ln(sum(exp(z)) OVER (PARTITION BY sample_id)) AS logp
       FROM (SELECT r.sample_id, r.label, r.x, m.k, list_dot_product(m.w, r.x) AS z FROM sm_rows r CROSS JOIN {w} m {where})"""
    step, logs = 0, []
    for epoch in range(epochs):
        order = batch_order(seed, epoch, batches)
        for b in order:
            step += 1
            out.append(f"sm_p{step} AS MATERIALIZED ({scored.format(w=f'sm_w{step - 1}', where=f'WHERE r.batch = {b}')})")
            out.append(f"""sm_w{step} AS MATERIALIZED (SELECT k, list(v ORDER BY d) AS w FROM (
       SELECT m.k, m.d, any_value(m.v) - {dbl(rate)} * coalesce(sum((exp(p.logp) - CAST(p.label = m.k AS INTEGER)) * p.x[m.d]), 0.0)
                        / greatest((SELECT count(DISTINCT sample_id) FROM sm_p{step}), 1) AS v
       FROM (SELECT k, unnest(w) AS v, generate_subscripts(w, 1) AS d FROM sm_w{step - 1}) m LEFT JOIN sm_p{step} p ON p.k = m.k
       GROUP BY m.k, m.d) GROUP BY k)""")
        place = "CASE batch " + " ".join(f"WHEN {b} THEN {i}" for i, b in enumerate(order)) + " END"
        logs.append(f"SELECT s.sample_id, {epoch} AS epoch, {place} AS iteration, s.label, s.k, s.logp FROM ({scored.format(w=f'sm_w{step}', where='')}) s JOIN sm_rows USING (sample_id)")
    return [*out, "sm_log AS (" + " UNION ALL ".join(logs) + ")"]
