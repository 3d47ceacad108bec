"""Operator 11 against a quadratic search on every diagonal."""

import hashlib
import random
import re
import zlib

import pytest

from divaug.llm import op11_periodic_runs as op

SCHEMA = "doc_id long, text string, runs string, n_words int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    n, out = len(w), {}
    for d in range(1, n):
        i = d
        while i < n:
            if w[i] != w[i - d]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - d]:
                j += 1
            if j - i + d >= max(24, 3 * d):
                out.setdefault((i - d, j), d)   # the least period of a stretch comes first
            i = j
    return sorted((s, e - s, d) for (s, e), d in out.items())


def brute_edit(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute_row(doc_id, text):
    w = brute_edit(doc_id, text)
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, n, q = best or (None, None, None)
    return (doc_id, len(runs), s, n, q, 1000 * n // q if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_text(r):
    a = r.choice([1, 2, 3, 5, 400])
    w = [f"w{r.randrange(a)}" for _ in range(r.randrange(0, 90))]
    for _ in range(r.randrange(4)):
        p = r.randrange(1, 30)
        block = [f"w{r.randrange(a)}" for _ in range(p)]
        if r.random() < 0.4:
            block = (block[:3] * 10)[:p - 1] + ["end"]
        size, at = r.randrange(20, 150), r.randrange(0, len(w) + 1)
        w[at:at] = (block * (size // p + 1))[:size]
    return r.choice([" ", "\n", "\t \x0b", "\r\x0c"]).join(w)


def test_runs_equal_a_search_on_all_diagonals():
    r = random.Random(5)
    texts = [periodic_text(r) for _ in range(400)]
    found = 0
    for k in range(0, len(texts), 40):
        part = texts[k:k + 40]
        names, counts = op.name_words([t.encode() for t in part], {})
        of, s, n, q = (x.tolist() for x in op.find_runs(names, counts))
        for i, t in enumerate(part):
            want = brute_runs(WORD.findall(t))
            found += len(want)
            assert [x[1:] for x in zip(of, s, n, q) if x[0] == i] == want
    assert found > 300


def test_words_without_squares_have_no_run():
    names = [0, 1, 2]
    while len(names) < 5000:   # the square-free word of 0 -> 012, 1 -> 02, 2 -> 1
        names = [y for x in names for y in ((0, 1, 2), (0, 2), (1,))[x]]
    code, counts = op.name_words([" ".join(map(str, names)).encode()], {})
    assert not len(op.find_runs(code, counts)[0])


@pytest.mark.parametrize("words, run", [
    (["a"] * 300_000, (0, 300_000, 1)), (["a", "b"] * 100_000, (0, 200_000, 2)),
    ([f"x{k % 997}" for k in range(200_000)], (0, 200_000, 997))])
def test_long_repetitive_texts_take_linear_work(words, run):
    code, counts = op.name_words([" ".join(words).encode()], {})
    of, *rest = op.find_runs(code, counts)
    assert [tuple(int(x[0]) for x in rest)] == [run] and len(of) == 1


def test_query_rows(spark):
    from divaug.llm.common import prepare
    prepare(spark)
    r = random.Random(9)
    items = [(i, periodic_text(r)) for i in range(300)] + [(None, "a " * 40), (7, None), (7, ""), (7, " \n"), (8, "b " * 30), (8, "b " * 30)]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in items], SCHEMA)
    edited = op.with_planted_runs(docs)
    assert sorted((x.doc_id or -1, WORD.findall(x.text or "")) for x in edited.collect()) == sorted((i or -1, brute_edit(i, t)) for i, t in items)
    out = [(x.doc_id, x.runs, x.collapsed) for x in op.periodic_runs(docs).collect()]
    want = [(i, brute_runs(WORD.findall(t or ""))) for i, t in items]
    key = lambda x: (x[0] or -1, x[1])
    assert sorted(((i, [tuple(x) for x in y]) for i, y, _ in out), key=key) == sorted(want, key=key)


def test_registered_query_on_given_documents(spark):
    from divaug.llm.registry import QUERIES
    sf = "/root/testdata/sf0.001"
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {x[0]: tuple(x) for x in QUERIES["op11_periodic_runs"](spark, sf).select(*cols).collect()}
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(docs) and sum(g[1] for g in got.values()) > 5
    for i, t in docs:
        if len(t or "") < 12_000:
            assert got[i] == brute_row(i, t)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert op.periodic_runs(docs).collect() == [] and op.with_planted_runs(docs).collect() == []
