"""Weighted near-duplicates against the definition of J_P, and words whose
polynomial hashes collide."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from divaug.llm import op09_probminhash as op
from divaug.llm.vectext import code_points, keyed_words, mixed_hashes, run_hashes

SCHEMA = "doc_id long, text string, node string, bands int"
SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def weighted(t, kind="log"):
    w = words(t)
    n = Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else {}
    return {k: 1.0 + math.log(v) if kind == "log" else 1.0 for k, v in n.items()}


def j_p(x, y):
    """By definition, element by element."""
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1.0 / sum(max(x.get(j, 0.0) / x[i], y.get(j, 0.0) / y[i]) for j in x.keys() | y.keys())
    return total


def brute_classes(items, kind="log", least=0.8):
    sets = {i: weighted(t, kind) for i, t in items.items()}
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in items:
        for j in items:
            if i < j and sets[i] and sets[j] and j_p(sets[i], sets[j]) >= least - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in items}


def docs(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], SCHEMA)


def text(r, n):
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def edited(r, w, share):
    w = list(w)
    for k in r.sample(range(len(w)), max(1, int(share * len(w)))):
        w[k] = f"new{r.randrange(10**9)}"
    return w


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def flip(w):
    return w.translate(str.maketrans("ab", "ba"))


# ---- the measure -------------------------------------------------------------------

def test_probability_jaccard_is_its_definition():
    r = random.Random(2)
    for _ in range(200):
        x = {k: r.choice([1.0, 1.0, 1 + math.log(2), 5.5]) for k in r.sample(range(40), r.randrange(1, 30))}
        y = {k: r.choice([1.0, 1.0, 1 + math.log(3), 0.25]) for k in r.sample(range(40), r.randrange(1, 30))}
        a, b = ((np.array(sorted(s), np.uint32), np.array([s[k] for k in sorted(s)])) for s in (x, y))
        assert math.isclose(op.prob_jaccard(a, b), j_p(x, y), abs_tol=1e-12)
        assert (op.prob_jaccard(a, b, 0.3) >= 0.3) == (j_p(x, y) >= 0.3)
    unit = (np.arange(10, dtype=np.uint32), np.ones(10)), (np.arange(4, 16, dtype=np.uint32), np.ones(12))
    assert math.isclose(op.prob_jaccard(*unit), 6 / 16)
    assert op.prob_jaccard((np.zeros(0, np.uint32), np.zeros(0)), unit[0]) == 0.0


def test_sets_pack_and_unpack():
    for h, n in (([], []), ([5], [1]), ([1, 2, 9], [1, 70000, 3])):
        got, w = op.unpack_set(op.pack_set(np.array(h, np.uint64), np.array(n, np.int64)), "log")
        assert got.tolist() == h and np.allclose(w, 1 + np.log(n) if n else [])
    with pytest.raises(ValueError):
        op.weight_of(np.ones(1), "idf")


def test_registers_agree_with_probability_jaccard():
    r = np.random.default_rng(5)
    h = r.integers(0, 1 << 48, 260).astype(np.uint64)
    x, y = {k: 1.0 + (k % 5 == 0) * 3.0 for k in range(200)}, {k: 1.0 + (k % 7 == 0) * 2.0 for k in range(60, 260)}
    row = np.repeat([0, 1], 200)
    el = np.concatenate([h[list(x)], h[list(y)]])
    sig = op.prob_min_hash(row, el, np.array([*x.values(), *y.values()]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - j_p(x, y)) < 0.03


# ---- classes -----------------------------------------------------------------------

def test_classes_of_texts_that_repeat_passages(spark):
    """With buckets of one as large ones: leaders, blocks and the sift decide."""
    small = 1
    r = random.Random(small)
    items = {}
    for g in range(3):
        w = text(r, 150)
        items[100 * g] = " ".join(w)
        for k in range(1, 8):
            v = edited(r, w, 0.006 * k)
            items[100 * g + k] = " ".join(v + v[:40] * (0, 1, 2, 6, 20, 60, 0)[k - 1])
        v = w + w[:60] * 8
        items[100 * g + 20], items[100 * g + 21] = " ".join(v), " ".join(edited(r, v, 0.002))
    want = brute_classes(items)
    got = op.near_duplicates(docs(spark, items.items()), small=small).toPandas()
    assert dict(zip(got.doc_id, got.class_id)) == want
    plain = brute_classes(items, "unit")
    assert want != plain    # the weights matter here
    unit = op.near_duplicates(docs(spark, items.items()), small=small, weights="unit").toPandas()
    assert dict(zip(unit.doc_id, unit.class_id)) == plain


def test_recall_by_similarity_on_given_documents(spark):
    """All pairs of the given texts, by an inverted index of their shingles."""
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {x.doc_id: x.class_id for x in op.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    sets = {i: weighted(t) for i, t in rows}
    lists = {}
    for i, s in sets.items():
        for k in s:
            lists.setdefault(k, []).append(i)
    shared = Counter((a, b) for ids in lists.values() if len(ids) < 200 for x, a in enumerate(ids) for b in ids[x + 1:])
    bands = Counter()
    code = {k: n for n, k in enumerate(lists)}
    array = {i: (np.array(sorted(code[k] for k in s), np.uint32), np.array([w for _, w in sorted((code[k], w) for k, w in s.items())])) for i, s in sets.items()}
    for (a, b), n in shared.items():
        if n < 0.5 * min(len(sets[a]), len(sets[b])):
            continue
        j = op.prob_jaccard(array[a], array[b])   # equal to its definition, see above
        if j >= 0.8 - 1e-9:
            bands["0.95" if j >= 0.95 else "0.9" if j >= 0.9 else "0.8", got[a] == got[b]] += 1
    print(bands)
    missed = sum(n for (_, ok), n in bands.items() if not ok)
    assert sum(bands.values()) > 50 and missed == 0


# ---- words that collide in a polynomial modulo 2**64 --------------------------------

@pytest.mark.parametrize("n", [1024, 4096, 65536])
def test_word_hashes_of_thue_morse_words(n):
    a, b = thue_morse(n), flip(thue_morse(n))
    cps = code_points(f"{a} {b} {a}")
    starts, ends = np.array([0, n + 1, 2 * n + 2]), np.array([n, 2 * n + 1, 3 * n + 2])
    old, new = run_hashes(cps, starts, ends), mixed_hashes(cps, starts, ends)
    assert old[0] == old[1]                       # what the words' hash must not do
    assert new[0] == new[2] and new[0] != new[1]
    _, _, keys = keyed_words([a, b, a + "!", f"{a} {b}", f"{b} {a}", None, "..."])
    assert keys[0] == keys[2] and len({*keys[:2], *keys[3:5]}) == 4 and keys[5] is keys[6] is None


def test_keys_are_of_the_words_however_they_are_cut():
    t = "Ärger über  Äpfel,\tund x1-x2 " * 50
    whole, cut = keyed_words([t, t.upper(), "y " + t]), keyed_words([t, t.upper(), "y " + t], limit=40)
    assert whole[2] == cut[2] and (whole[0] == cut[0]).all() and whole[2][0] == whole[2][1] != whole[2][2]
    assert keyed_words(["ab c"])[2] != keyed_words(["a bc"])[2]


def test_near_duplicates_keep_texts_of_colliding_words(spark):
    a = thue_morse(1024)
    b = flip(a)
    items = [(1, a), (2, b), (3, f"{a} {a} one"), (4, f"{b} {b} one"), (5, f"{a}")]
    kept = {x.doc_id for x in op.keep_one(docs(spark, items)).collect()}
    assert kept == {1, 2, 3, 4}


def test_encoding_of_colliding_words():
    import json

    from tokenizers import Tokenizer

    from divaug.llm import op04_transducer_bpe as bpe
    path = bpe.tokenizer_path()
    with open(path, encoding="utf-8") as f:
        merges = bpe.Merges(json.load(f))
    import os
    import tempfile
    folder = tempfile.mkdtemp(prefix="lexicon-test-")
    bpe.Lexicon.write(os.path.join(folder, "l.bin"), [b" the", b"the"], merges)
    enc = bpe.Encoder(merges, bpe.Lexicon(os.path.join(folder, "l.bin")))
    tok = Tokenizer.from_file(path)
    a = thue_morse(1024)
    special = sorted(merges.special, key=len)
    mixed = [a + " x", flip(a), "the " + flip(a) + " " + a, "".join(special) * 3, f"the{special[0]} {special[0]}the" if special else "the", ""]
    got = enc.encode(mixed)
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in mixed]
    # words whose hashes are made equal are still told apart by their bytes
    w = bpe.Words(["aa bb aa cc", "bb aaa cc"])
    w.hash[:] = 7
    first, back = enc._distinct(w, np.arange(len(w.start)))
    assert [w.word(int(first[k])) for k in back] == [w.word(k) for k in range(len(w.start))]
    assert len({w.word(int(i)) for i in first}) == len(first)


def test_many_special_strings_take_linear_time():
    import json
    import time

    from divaug.llm import op04_transducer_bpe as bpe
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        merges = bpe.Merges(json.load(f))
    import os
    import tempfile
    folder = tempfile.mkdtemp(prefix="lexicon-test-")
    bpe.Lexicon.write(os.path.join(folder, "l.bin"), [b" the"], merges)
    enc = bpe.Encoder(merges, bpe.Lexicon(os.path.join(folder, "l.bin")))
    s = next(iter(merges.special))
    took = []
    for n in (20_000, 80_000):
        t = time.time()
        ids = enc.encode([(s + "x") * n])[0]
        took.append(time.time() - t)
        assert len(ids) == 2 * n
    assert took[1] < 10 * took[0] + 1


def test_decontamination_tells_colliding_words_apart(spark):
    from divaug.llm.op02_spaced_seed import decontaminate
    a = thue_morse(1024)
    item = " ".join([a, "one", a, "two", a, "three", a, "four", a, "five", a, "six", a, "seven"])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = docs(spark, [(1, item), (2, item.replace(a, flip(a)))])
    assert [x.doc_id for x in decontaminate(rows, bench).collect()] == [2]
