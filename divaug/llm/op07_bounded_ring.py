"""Sharding on a consistent-hash ring with bounded loads (operator 7), with
DataFrame functions only.

Every shard owns ``vnodes`` points of a ring of 4096 points; a key starts at
the hash of its id and belongs to the first shard point clockwise.  Keys enter
in the order of a second hash; a key whose shard is full continues clockwise
to the next shard with room.  With capacities that differ by at most one row
and add up to the number of rows, every shard ends exactly full (law `rows`);
a larger ``slack`` lets shards end uneven and moves fewer keys.

The order of entry is made exact without a global sort: hash bins of bounded
size are numbered by a running sum over bins, rows within their bin.  What
decides a key's shard is then its place in the order and its arc.  A shard
fills at one place, so there are at most as many changes of routing as shards;
they are found from counts by (interval of places, arc), of bounded size, and
the rows of the one interval in which a shard fills are read exactly.

Degenerate input: a null id hashes like any value; null texts have no bytes;
rows that repeat an id are ordered by text hash and size, and rows equal in
these too take neighbouring places, which of them does not matter; an empty
table gives an empty result; columns of the input with the names added here
are replaced in the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from divaug.llm.common import first_row, materialize, register, table

POINTS, VNODES = 4096, 64
BIN_ROWS, MOST_BINS = 1024, 1 << 16
CHUNK_ROWS, MOST_CHUNKS = 4096, 1 << 14
INTERVALS, EXACT_ROWS = 128, 16384


def ring(shards: int, vnodes: int = VNODES) -> np.ndarray:
    """(POINTS, shards): for each ring point its shards in clockwise order.  A
    shard's points do not depend on the other shards unless two ask for one
    point: then the later shard takes the next free point."""
    owner = np.full(POINTS, -1, np.int64)
    for s in range(shards):
        for v in range(vnodes):
            at = int(hashlib.md5(f"shard:{s}:{v}".encode()).hexdigest()[:8], 16) % POINTS
            while owner[at] >= 0:
                at = (at + 1) % POINTS
            owner[at] = s
    order = np.zeros((POINTS, shards), np.int64)
    following: list[int] = []
    for at in range(2 * POINTS - 1, -1, -1):   # twice round: what follows is then known
        s = int(owner[at % POINTS])
        if s >= 0:
            following = [s] + [x for x in following if x != s]
        if at < POINTS:
            order[at] = following
    return order


def lookup(values: list[int], at: Column) -> Column:
    """values[at], as one literal that the optimizer folds to an array."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ","), at + 1).cast("int")


def place_rows(df: DataFrame, id_col: str, ties: list[str]) -> DataFrame:
    """Adds __place (0 .. n-1 in the order of a hash of the id) and __point."""
    df = materialize(df.withColumn("__prio", F.xxhash64(F.lit("entry"), F.col(id_col).cast("string"), *ties))
                     .withColumn("__point", F.pmod(F.xxhash64(F.lit("ring"), F.col(id_col).cast("string")), F.lit(POINTS)).cast("int")))
    n = first_row(df.agg(F.count("*").alias("n")))["n"]
    bits = min(n // BIN_ROWS, MOST_BINS - 1).bit_length()
    # signed hashes in unsigned order of their top bits
    bin_ = F.shiftrightunsigned("__prio", 64 - bits) if bits else F.lit(0).cast("long")
    binned = df.withColumn("__bin", bin_)
    counts = binned.groupBy("__bin").agg(F.count("*").alias("c"))
    # one row for each bin, MOST_BINS at most
    before = counts.select("__bin", (F.sum("c").over(Window.orderBy("__bin")) - F.col("c")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__bin").orderBy("__prio", F.col(id_col).asc_nulls_first(), *ties)) - 1
    return binned.withColumn("__in", within).join(before, "__bin").withColumn("__place", F.col("__before") + F.col("__in")) \
        .drop("__bin", "__in", "__before", "__prio")


def routing(placed: DataFrame, n: int, order: np.ndarray, capacity: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """[(first place, shard of each arc)]: at most one entry for each shard."""
    shards = order.shape[1]
    arcs, arc_of = np.unique(order, axis=0, return_inverse=True)
    arc_of = arc_of.ravel()
    load = np.zeros(shards, np.int64)

    def route(open_: np.ndarray) -> np.ndarray:
        return np.array([next((s for s in row if open_[s]), row[0]) for row in arcs.tolist()])

    arc = lookup(arc_of.tolist(), F.col("__point"))
    narrow = placed.select("__place", arc.alias("arc"))
    now = route(load < capacity)
    changes = [(0, now)]

    def walk(lo: int, hi: int) -> None:
        """Goes through the places lo .. hi-1, exactly where a shard fills."""
        nonlocal now
        step = max(1, -(-(hi - lo) // INTERVALS))
        part = narrow.filter((F.col("__place") >= lo) & (F.col("__place") < hi))
        if hi - lo <= EXACT_ROWS:
            for place, a in sorted((r["__place"], r["arc"]) for r in part.collect()):
                load[now[a]] += 1
                if load[now[a]] == capacity[now[a]]:
                    now = route(load < capacity)
                    changes.append((place + 1, now))
            return
        rows = part.groupBy(((F.col("__place") - lo) / step).cast("int").alias("i"), "arc").agg(F.count("*").alias("c")).toPandas()
        counts = np.zeros((-(-(hi - lo) // step), len(arcs)), np.int64)
        counts[rows["i"], rows["arc"]] = rows["c"]
        for i, c in enumerate(counts):
            more = np.bincount(now, c, shards).astype(np.int64)
            if (load + more < capacity)[more > 0].all():
                load[:] += more
            else:
                walk(lo + i * step, min(hi, lo + (i + 1) * step))

    walk(0, n)
    return changes


def capacities(n: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """Rows that each shard may hold: with no slack they add up to ``n``."""
    if slack > 0:
        return np.full(shards, -(-int(n * (1 + slack)) // shards) + 1)
    return np.array([n // shards + (s < n % shards) for s in range(shards)])


def shard(df: DataFrame, id_col: str = "doc_id", shards: int = 8, ties: list[str] | None = None,
          slack: float = 0.0, vnodes: int = VNODES) -> DataFrame:
    """``df`` (narrow columns) with shard and slot (gapless from 0)."""
    df = df.drop("shard", "slot")
    placed = materialize(place_rows(df, id_col, ties or []))
    n = first_row(placed.agg(F.count("*").alias("n")))["n"]
    order = ring(shards, vnodes)
    changes = routing(placed, n, order, capacities(n, shards, slack)) if n else [(0, order[:, 0])]
    if n:
        arcs, arc_of = np.unique(order, axis=0, return_inverse=True)
        table_ = [[int(x) for x in now[arc_of.ravel()]] for _, now in changes]
    else:
        table_ = [[int(x) for x in changes[0][1]]]
    where: Column = F.lit(None).cast("int")
    for (first, _), points in zip(changes, table_):
        got = lookup(points, F.col("__point"))
        where = got if first == 0 else F.when(F.col("__place") >= first, got).otherwise(where)
    put = placed.withColumn("shard", where.cast("int")).withColumn("__chunk", F.floor(F.col("__place") / max(CHUNK_ROWS, n // MOST_CHUNKS)))
    put = materialize(put.drop("__point"))
    sizes = put.groupBy("shard", "__chunk").agg(F.count("*").alias("c"))
    # one row for each shard and chunk of places, about MOST_CHUNKS chunks at most
    before = sizes.select("shard", "__chunk", (F.sum("c").over(Window.partitionBy("shard").orderBy("__chunk")) - F.col("c")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("shard", "__chunk").orderBy("__place")) - 1
    return (put.withColumn("__in", within).join(before, ["shard", "__chunk"])
               .withColumn("slot", (F.col("__before") + F.col("__in")).cast("long"))
               .drop("__chunk", "__place", "__in", "__before"))


@register("op7_bounded_ring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    return shard(docs, "doc_id", 8, ["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
