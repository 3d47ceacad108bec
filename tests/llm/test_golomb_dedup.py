"""Operator 13 against a dictionary of texts."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from divaug.llm import op13_golomb_dedup as op

SCHEMA = "doc_id long, text string, part int, sha string, words string, rid long"


def brute(items):
    groups = defaultdict(list)
    for i, t in items:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is None, -(x or 0)))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("n, bits", [(0, 8), (1, 8), (1, 60), (200, 8), (256, 8), (5000, 40), (3000, 61)])
def test_code_round_trip(n, bits):
    r = random.Random(n)
    values = np.array(sorted(r.sample(range(1 << bits), n)) if bits < 20 else sorted({r.randrange(1 << bits) for _ in range(n)}), np.int64)
    k, code = op.golomb_encode(values, 1 << bits)
    assert (op.golomb_decode(code, len(values), k) == values).all()
    if n > 100:   # within two bits of log2(e * span / n)
        assert 8 * len(code) <= len(values) * (np.log2(2.0 ** bits / len(values)) + 2.5) + 8


def test_code_of_crowded_ends():
    for v in ([0], [(1 << 50) - 1], [0, 1, 2, (1 << 50) - 1], list(range(1000))):
        k, code = op.golomb_encode(np.array(v, np.int64), 1 << 50)
        assert op.golomb_decode(code, len(v), k).tolist() == v


def test_owner_answers_only_shared_fingerprints():
    lists = {3: [5, 9, 700], 1: [9, 12], 8: [12, 13, 700]}
    rows = [(p, len(v), *op.golomb_encode(np.array(v, np.int64), 1024)) for p, v in lists.items()]
    part, n, k, code = zip(*rows)
    got = op.answer(pa.table({"owner": [0] * 3, "part": part, "n": n, "k": k, "code": list(code)})).to_pylist()
    for x in got:
        flags = np.unpackbits(np.frombuffer(x["bits"], np.uint8))[:x["n"]].tolist()
        assert flags == [int(sum(f in v for v in lists.values()) > 1) for f in lists[x["part"]]]


def run(spark, items, parts=5):
    docs = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in items], SCHEMA).repartition(parts)
    return sorted((tuple(x) for x in op.exact_dedup(docs).collect()), key=str)


def test_rows_equal_a_dictionary(spark):
    r = random.Random(3)
    long = "word " * 300_000
    items = [(k, r.choice(["hot", f"text {r.randrange(900)}", "Text 1", "text 1 ", ""])) for k in range(3000)]
    items += [(5000, long), (5001, long), (5002, long + " "), (5003, None), (None, "hot"), (None, "lone"), (None, "pair"), (None, "pair"),
              (6000, "again"), (6000, "again"), (-4, "minus"), (-9, "minus"), (7000, "é"), (7001, "é")]
    assert run(spark, items) == brute(items)


def test_few_bits_only_make_more_suspects(spark, monkeypatch):
    """Most fingerprints collide, whole texts still decide."""
    monkeypatch.setattr(op, "SPARE_BITS", -20)
    items = [(k, f"t{k % 70_000}") for k in range(70_300)]
    assert run(spark, items, 3) == brute(items)


def test_one_row_and_empty_table(spark):
    assert run(spark, [(1, "x")]) == brute([(1, "x")])
    assert op.exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_are_not_moved_before_they_are_suspects(spark):
    docs = spark.createDataFrame([(k, f"t{k}", 1, "x", "y", 2) for k in range(50)], SCHEMA)
    home = op._at_home(docs, "doc_id", "text")
    words = op.suspects(home, 50)
    plan = home.join(words.hint("shuffle_hash"), "part")._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.splitlines() if "FileScan" in x and "text" in x]
    assert scan and all("Bucketed: true" in x for x in scan)
    assert not any("Exchange" in x and "text" in x for x in plan.splitlines())
