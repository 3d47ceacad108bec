"""Connected components by alternating star contractions.

Each round joins edges with the least neighbour of a node (an aggregate with
map-side combine); no group of neighbours is gathered in a task.  Rounds are
written to the shared folder; only an edge count and a checksum reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divaug.llm.common import first_row, materialize


def _state(edges: DataFrame) -> tuple:
    r = first_row(edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")))
    return r["n"], r["x"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) of any orderable type -> (node, component), where the
    component is the least node of it.  Nodes without an edge to another node
    are not returned; null ends and loops are ignored."""
    now = materialize(edges.select("a", "b").filter("a is not null and b is not null and a <> b")
                      .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        # large star: every larger neighbour of u hangs below u's least neighbour
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").filter(F.col("b") > F.col("a"))
                     .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: u and its smaller neighbours hang below the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = materialize(large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter("a <> b").distinct())
        after = _state(nxt)
        now, done = nxt, after == state
        state = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
