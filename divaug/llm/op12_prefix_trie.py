"""Prefix trie of conversations from vertical bitmaps (operator 12).

A node at depth d is a distinct sequence of d first turns (role and text).

Blocks: a conversation is cut into blocks of 1,024 turns, so one of any length
is many small rows, and each block knows the node it starts at: the key of a
node is a hash of the key of its block's start and the turns since then.

Shards: blocks are range-partitioned by (block number, conv_id).  A shard of at
most 4,096 conversations or 65,536 turns indexes (position, turn) to the bitset
of its conversations.  From each start node it goes depth first: the bitset of
a node, intersected with the posting of a member's next turn, is a child; what
is left gives the next child, so every intersection yields one.  Popcounts,
least members, and the list of the members that end at a node leave the shard;
the list as text in ascending order, for shards follow each other by conv_id.

Merge: the shards' parts of a node are summed by key.  Lists of ends are hashed
part by part in their order, so no list is gathered.  Sums over subtrees run on
nodes with two members or more (below a node with one, everything is known): a
round adds up what hangs at distance 1, 2, 4, ..., so a trie of depth D takes
log2(D) rounds, each an aggregate by key with map-side sums.

Degenerate input: rows without conv_id are left out; null roles and texts are
empty; turns are ordered by turn (null first), ties by the hash of role and
text; repeated rows are turns of their own; a conversation without turns is a
member of the root only; an empty table gives an empty result; other columns
are ignored, also those named like a column used here.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.llm.common import first_row, materialize, register, table



class Sizes(NamedTuple):
    """Bounds of what a task holds; results do not depend on them."""
    block_turns: int = 1024
    shard_convs: int = 4096
    shard_turns: int = 1 << 16
    piece_ids: int = 1024


SIZES = Sizes()
ROOT = hashlib.sha256(b"").digest()
NODE = "key binary, parent binary, depth long, conv_id long, n long, bytes long, ends string"


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- numbered turns ----------------------------------------------------------

def _count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``at``: how many rows of its conversation come before a row in its
    sorted partition."""
    last, seen = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv_id").to_numpy()
        first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        size = np.diff(np.append(first, len(conv)))
        at = np.arange(len(conv)) - np.repeat(first, size)
        if conv[0] == last:
            at[:size[0]] += seen
        last, seen = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "at"])


def turn_rows(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, turn_key, bytes): turns numbered from 0, a hash of role
    and text and the bytes of the text.  Rows are range-partitioned by
    conversation and turn, so a long conversation spans many partitions; only
    those that do (one for each border at most) need an offset."""
    c = conversations
    role, text = (F.coalesce(c[x].cast("string"), F.lit("")) for x in (role_col, text_col))
    rows = c.filter(c[id_col].isNotNull()).select(
        c[id_col].cast("long").alias("conv_id"), c[turn_col].alias("turn"),
        F.substring(_sha(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), 1, 16).alias("turn_key"),
        F.octet_length(text).cast("long").alias("bytes"))
    p = _parts(c.sparkSession)
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("turn_key").asc()]
    sorted_ = rows.repartitionByRange(p, *order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("pid"), "conv_id", "turn_key", "bytes")
    at = materialize(sorted_.mapInArrow(_count_up, "pid int, conv_id long, turn_key binary, bytes long, at long"))
    sizes = at.groupBy("conv_id", "pid").agg(F.count("*").alias("n"))
    long_ones = sizes.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pid", "n"))).alias("x")).filter(F.size("x") > 1)
    offsets = (long_ones.select("conv_id", F.posexplode("x").alias("k", "here"), "x")
                        .select("conv_id", F.col("here.pid").alias("pid"),
                                F.aggregate(F.slice("x", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, v: a + v["n"]).alias("before")))
    return at.join(offsets, ["conv_id", "pid"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "turn_key", "bytes")


# ---- blocks ------------------------------------------------------------------

def _blocks(turns: DataFrame, ids: DataFrame, block_turns: int) -> DataFrame:
    """(block, conv_id, keys, bytes, start): the last block of a conversation
    has less than ``block_turns`` turns, perhaps none."""
    block = F.floor(F.col("pos") / block_turns).cast("long")
    length = turns.groupBy("conv_id").agg(F.count("*").alias("pos"))
    last = ids.join(length, "conv_id", "left").select("conv_id", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"),
                                                      F.lit(None).cast("struct<pos:bigint,turn_key:binary,bytes:bigint>").alias("t"))
    rows = turns.select("conv_id", F.col("pos").cast("long").alias("pos"), F.struct(F.col("pos").cast("long").alias("pos"), "turn_key", "bytes").alias("t"))
    cut = materialize(rows.unionByName(last).withColumn("block", block).groupBy("conv_id", "block")
                          .agg(F.sort_array(F.collect_list("t")).alias("t"))
                          .select("conv_id", "block", F.col("t.turn_key").alias("keys"), F.col("t.bytes").alias("bytes")))
    whole = cut.filter(F.size("keys") == block_turns).select(
        "conv_id", F.struct("block", _sha(F.aggregate("keys", F.lit(b""), lambda a, k: F.concat(a, k))).alias("d")).alias("x"))
    chain = F.aggregate("ds", F.array(F.lit(ROOT)), lambda a, d: F.concat(a, F.array(_sha(F.concat(F.element_at(a, -1), d["d"])))))
    starts = (whole.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("ds"))
                   .select("conv_id", F.posexplode(chain).alias("block", "start")).withColumn("block", F.col("block").cast("long")))
    return cut.join(starts, ["conv_id", "block"], "left").withColumn("start", F.coalesce("start", F.lit(ROOT)))


# ---- shards ------------------------------------------------------------------

def shard_nodes(limits: Sizes, block: int, convs: list[int], starts: list[bytes], keys: list[list[bytes]],
                sizes: list[list[int]]) -> Iterator[tuple]:
    """The shard's part of each node (see NODE) of conversations in ascending
    order.  ``n`` is 0 for a start that only gets ends."""
    postings: list[dict[bytes, int]] = []
    ending: dict[int, int] = defaultdict(int)
    roots: dict[bytes, int] = defaultdict(int)
    for i, (start, turns) in enumerate(zip(starts, keys)):
        bit = 1 << i
        roots[start] |= bit
        if len(turns) < limits.block_turns:
            ending[len(turns)] |= bit
        while len(postings) < len(turns):
            postings.append(defaultdict(int))
        for index, k in zip(postings, turns):
            index[k] |= bit
    base = block * limits.block_turns

    def listed(members: int) -> list[str]:
        out: list[str] = []
        while members:
            low = members & -members
            out.append(str(convs[low.bit_length() - 1]))
            members ^= low
        return [",".join(out[k:k + limits.piece_ids]) for k in range(0, len(out), limits.piece_ids)]

    for start, members in roots.items():
        stack = [(members, 0, hashlib.sha256(), start, None, None)]
        while stack:
            members, depth, state, key, parent, size = stack.pop()
            ended = members & ending.get(depth, 0)
            head = convs[(members & -members).bit_length() - 1]
            pieces = listed(ended)
            counts = members.bit_count() if depth or not block else 0
            if counts or pieces:
                yield key, parent, base + depth, head, counts, size, pieces[0] if pieces else None
            for piece in pieces[1:]:
                yield key, None, base + depth, int(piece.split(",", 1)[0]), 0, None, piece
            left = members ^ ended
            if depth == limits.block_turns:
                continue
            while left:
                i = (left & -left).bit_length() - 1
                turn = keys[i][depth]
                child = left & postings[depth][turn]
                left ^= child
                grown = state.copy()
                grown.update(turn)
                stack.append((child, depth + 1, grown, hashlib.sha256(start + grown.digest()).digest(), key, sizes[i][depth]))


def _walker(limits: Sizes):
    names = [x.split()[0] for x in NODE.split(", ")]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def batch(nodes: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*nodes), kinds)], names)

    def shard(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        nodes = shard_nodes(limits, rows[0][0], *[list(c) for c in zip(*[r[1:] for r in rows])])
        while some := list(islice(nodes, 8192)):
            yield batch(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        turns = 0
        for b in batches:
            for row in zip(*[b.column(k).to_pylist() for k in ("block", "conv_id", "start", "keys", "bytes")]):
                if rows and (row[0] != rows[0][0] or len(rows) >= limits.shard_convs or turns >= limits.shard_turns):
                    yield from shard(rows)
                    rows, turns = [], 0
                rows.append(row)
                turns += len(row[3])
        if rows:
            yield from shard(rows)
    return run


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each key, over its pieces in order."""
    key, state = None, None

    def done(keys: list, hashes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])

    for b in batches:
        keys, hashes = [], []
        for k, piece in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
            if k != key:
                if state is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield done(keys, hashes)
    if state is not None:
        yield done([key], [state.hexdigest()])


# ---- trie --------------------------------------------------------------------

def _subtree_sums(own: DataFrame) -> DataFrame:
    """``own`` (key, parent, depth, leaves, saved) -> (key, leaves, saved) over
    subtrees.  ``up`` is the ancestor at distance 2 ** round."""
    state = materialize(own.select("key", F.col("parent").alias("up"), "depth", "leaves", "saved"))
    deepest = first_row(state.agg(F.max("depth").alias("d")))["d"] or 0
    for k in range(int(deepest).bit_length()):
        below = (state.filter("up is not null").groupBy(F.col("up").alias("key"))
                      .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
        above = state.select(F.col("key").alias("up"), F.col("up").alias("next"))
        state = materialize(
            state.join(below, "key", "left").join(above, "up", "left")
                 .select("key", F.col("next").alias("up"), "depth",
                         (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                         (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
    return state.select("key", "leaves", "saved")


def prefix_trie(turns: DataFrame, ids: DataFrame, limits: Sizes = SIZES) -> DataFrame:
    """``turns`` (conv_id, pos, turn_key, bytes) with positions from 0 without
    gaps, and ``ids`` (conv_id, distinct) of all conversations, also those
    without turns -> one row for each node: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    blocks = materialize(_blocks(turns, ids, limits.block_turns))
    parts = materialize(blocks.repartitionByRange(_parts(spark), "block", "conv_id").sortWithinPartitions("block", "conv_id")
                              .select("block", "conv_id", "start", "keys", "bytes").mapInArrow(_walker(limits), NODE))
    ends = materialize(parts.filter("ends is not null").select("key", "conv_id", "ends", F.split("ends", ",", 2)[0].cast("long").alias("first"))
                            .repartition("key").sortWithinPartitions("key", "first")
                            .select("key", "ends").mapInArrow(_hash_pieces, "key binary, ends_sha256 string"))
    nodes = materialize(parts.filter("n > 0").groupBy("key", "parent", "depth", "bytes")
                             .agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n")).join(ends, "key", "left"))
    shared = nodes.filter("n > 1")
    children = (nodes.filter("parent is not null").groupBy(F.col("parent").alias("key"))
                     .agg(F.count("*").alias("n_children"), F.sum((F.col("n") == 1).cast("long")).alias("lone")))
    shared = materialize(shared.join(children, "key", "left").fillna(0, ["n_children", "lone"]))
    sums = _subtree_sums(shared.select(
        "key", "parent", "depth", (F.col("lone") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        ((F.col("n") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved")))
    # above a node with two members or more are only such; above one with one
    # member is a shared node or a node of the same conversation
    over = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("over"))
    known = shared.join(sums, "key").select("key", "n_children", "leaves", "saved")
    no_ends = hashlib.sha256(b"").hexdigest()
    return (nodes.join(over, "parent", "left").join(known, "key", "left").select(
        "conv_id", "depth",
        F.when(F.col("parent").isNotNull(), F.coalesce("over", "conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.col("ends_sha256").isNull().cast("long")).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(no_ends)).alias("ends_sha256")))


# ---- query -------------------------------------------------------------------

SPLICE, HEADS = 5, 9


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations: c starts with the first h turns of
    conversation c - c % 5 and goes on with its own after its first h."""
    length = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    plan = length.select("conv_id", (F.col("conv_id") - F.col("conv_id") % SPLICE).alias("base"), h.alias("h"))
    base = length.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = materialize(plan.join(base, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).cast("long").alias("taken")))
    own = (turns.filter(F.col("pos") >= h).join(plan, "conv_id")
                .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_key", "bytes"))
    heads = turns.filter((F.col("pos") < HEADS - 1) & (F.col("conv_id") % SPLICE == 0)).withColumnRenamed("conv_id", "base")
    head = (plan.filter("taken > 0").join(heads, "base").filter("pos < taken").select("conv_id", "pos", "turn_key", "bytes"))
    return materialize(own.unionByName(head)), plan.select("conv_id")


# The checksum in SQL: a table of 256 remainders made by eight shifts of each
# byte, then one step for each digit.
ORACLE = """
WITH RECURSIVE
bits AS (SELECT i AS byte, i AS v, 0 AS k FROM range(256) t(i)
         UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY byte) AS tab FROM bits WHERE k = 8),
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos, k, bytes
        FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
                     sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
              FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT c, n, c - c % 5 AS b,
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                               lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h
        FROM (SELECT c, count(*) AS n FROM own GROUP BY c), crc),
plan AS (SELECT i.c, i.b, i.h, least(i.h, coalesce(j.n, 0)) AS taken FROM ids i LEFT JOIN ids j ON j.c = i.b),
built AS (SELECT p.c, o.pos - p.h + p.taken AS pos, o.k, o.bytes FROM own o JOIN plan p ON o.c = p.c AND o.pos >= p.h
          UNION ALL SELECT p.c, o.pos, o.k, o.bytes FROM plan p JOIN own o ON o.c = p.b AND o.pos < p.taken),
path AS (SELECT c, 0 AS depth, '' AS node, NULL::VARCHAR AS up, 0 AS bytes FROM ids
         UNION ALL
         SELECT c, depth, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY depth), ''), bytes
         FROM (SELECT c, pos + 1 AS depth, sha256(string_agg(k, ',') OVER (PARTITION BY c ORDER BY pos)) AS node, bytes FROM built)),
reach AS (SELECT c, max(depth) AS d FROM path GROUP BY c),
nodes AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, min(p.c) AS conv_id, count(*) AS n_convs,
                 (count(*) - 1) * any_value(bytes) AS saved,
                 sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (p.depth = r.d), '')) AS ends_sha256
          FROM path p JOIN reach r ON p.c = r.c GROUP BY node),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
sums AS (SELECT a.node, sum(d.saved) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
         FROM nodes d JOIN path q ON q.c = d.conv_id AND q.depth <= d.depth JOIN nodes a ON a.node = q.node
         LEFT JOIN kids k ON k.up = d.node GROUP BY a.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.node = n.up LEFT JOIN kids k ON k.up = n.node JOIN sums s ON s.node = n.node
"""


@register("op12_prefix_trie", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*spliced(materialize(turn_rows(table(spark, sf_dir, "conversations")))))
