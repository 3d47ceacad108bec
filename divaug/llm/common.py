"""Shared helpers of the training-data operators."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.session import ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


BATCH_ROWS = 1000   # of texts that go to a Python worker at once
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ships the package, and lowers Arrow's default batch of 10,000 rows,
    which long texts make too large for a worker (a session's own lower value
    stands)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if not 0 < int(spark.conf.get(_BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def register(name: str, sql: str | None = None):
    """Registers a builder ``(spark, sf_dir) -> DataFrame`` and its oracle."""
    def deco(build):
        @functools.wraps(build)
        def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(spark, sf_dir)
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/divaug-llm/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts
    lineage, is computed once, and survives lost executors."""
    spark = df.sparkSession
    ship_package(spark)
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def first_row(df: DataFrame):
    """The single row of a global aggregate."""
    return df.collect()[0]


class HashBitmap:
    """Membership filter of a fixed size (``2**bits`` bits), so its broadcast
    is bounded whatever the number of keys.  Keys are hashed longs; a set that
    outgrows it only lets more rows through to the exact join that follows."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def contains(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def build_bitmap(df: DataFrame, col: str, bits: int) -> HashBitmap:
    """One row for each non-empty 32-bit word comes to the driver: at most
    ``2**(bits - 5)`` rows."""
    rows = (df.filter(F.col(col).isNotNull())
              .select(F.shiftrightunsigned(col, 64 - bits).alias("at"))
              .selectExpr("cast(at div 32 as int) AS w", "shiftleft(1L, cast(at % 32 as int)) AS v")
              .groupBy("w").agg(F.bit_or("v").alias("v")).toArrow())
    words = np.zeros(1 << (bits - 5), np.uint32)
    words[rows.column("w").to_numpy()] = rows.column("v").to_numpy().astype(np.uint32)
    return HashBitmap(words, bits)
