"""Operator 12 against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from divaug.llm import op12_prefix_trie as op

SCHEMA = "conv_id long, turn int, role string, text string, key string, pid int, n long, depth int"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(items):
    """conv_id -> its turns (role, text) in order."""
    out = defaultdict(list)
    for c, turn, role, text in items:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in out.items()}


def splice(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        path = tuple(convs[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        gain = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += gain
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, m in members.items())


def rows(df):
    return sorted(tuple(-1 if v is None and k == "parent_conv_id" else v for k, v in zip(COLS, r)) for r in df.select(*COLS).collect())


def frame(spark, items):
    return spark.createDataFrame([(*x, "k", 1, 2, 3) for x in items], SCHEMA)


def trie(spark, items, limits=op.SIZES):
    turns = op.turn_rows(frame(spark, items))
    return rows(op.prefix_trie(turns, turns.select("conv_id").distinct(), limits))


def talk(r, convs, longest=9):
    items = []
    for c in range(convs):
        for t in range(r.randrange(1, longest)):
            items.append((c, t, r.choice(["user", "bot"]) if t else "user", r.choice(["hi", "ho", "é" * r.randrange(3)])))
    r.shuffle(items)
    return items


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_a_dictionary(spark, seed):
    items = talk(random.Random(seed), 250)
    convs = turns_of(items)
    assert trie(spark, items) == brute(convs)


def test_query_rows(spark):
    items = talk(random.Random(4), 120)
    items += [(1000 + k, t, "user", "same") for k in range(60) for t in range(k % 3 + 1)]
    items += [(None, 1, "user", "x"), (2001, None, None, None), (2001, 3, None, "x"), (2002, 1, "", ""), (2006, 5, "user", None)]
    turns, ids = op.spliced(op.turn_rows(frame(spark, items)))
    got = rows(op.prefix_trie(turns, ids))
    assert got == brute(splice(turns_of(items)))


def test_small_blocks_and_shards(spark):
    """Long conversations over many blocks, some ending at a block's border."""
    items = [(c, t, "user", "a") for c, n in enumerate([3, 4, 5, 8, 8, 8, 12, 13, 40, 41, 8, 8, 8, 8]) for t in range(n)]
    items += [(50 + c, t, "user", "b" if t == c + 5 else "a") for c in range(9) for t in range(20)]
    assert trie(spark, items, op.Sizes(4, 3, 1 << 16, 2)) == brute(turns_of(items))


def test_one_conversation_holds_most_rows(spark):
    """Positions of a conversation that spans all partitions."""
    items = [(7, t, "user", f"t{t % 9}") for t in range(5000)] + [(9, t, "user", f"t{t % 9}") for t in range(2600)] + [(8, 0, "user", "x")]
    turns = op.turn_rows(frame(spark, items))
    got = {(x.conv_id, x.pos) for x in turns.collect()}
    assert got == {(7, t) for t in range(5000)} | {(9, t) for t in range(2600)} | {(8, 0)}
    convs = turns_of(items)
    nodes = trie(spark, items)
    assert len(nodes) == 5002
    by = {x[:2]: x for x in nodes}
    assert by[(7, 2600)][3:6] == (2, 1, 1) and by[(7, 2601)][3:6] == (1, 1, 1) and by[(7, 5000)][4] == 0
    assert by[(7, 0)][3:7] == (3, 2, 2, sum(len(t.encode()) for _, t in convs[9]))


def test_turnless_conversations_and_empty_table(spark):
    ids = spark.createDataFrame([(5,), (3,), (4,)], "conv_id long")
    none = op.turn_rows(frame(spark, []))
    assert rows(op.prefix_trie(none, ids)) == brute({3: [], 4: [], 5: []})
    assert op.prefix_trie(none, ids.limit(0)).collect() == []


def test_ties_of_turns_have_one_order(spark):
    items = [(c, 1, "user", t) for c, ts in ((1, "xyz"), (2, "zyx")) for t in ts]
    assert [x[3] for x in trie(spark, items)] == [2, 2, 2, 2]
