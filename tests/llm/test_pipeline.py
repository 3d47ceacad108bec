"""The corpus pipeline on a small corpus, stage by stage, against plain Python."""

import hashlib
import json
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as P

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r):
    return " ".join(r.choice(["amber", "river", "stone", "north", "glass", "paper", "field", "cloud", "house", "bread"]) + str(r.randrange(60)) for _ in range(12)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables: clean texts, copies, near copies, junk, a benchmark passage, personal data."""
    r = random.Random(11)
    clean = {i: " ".join(sentence(r) for _ in range(14)) for i in range(60)}
    items = dict(clean)
    items[100], items[101] = clean[3], clean[3]                                       # exact copies
    w = clean[4].split()
    w[5] = "changed"
    items[102] = " ".join(w)                                                          # a near copy
    for k in range(25):
        items[200 + k] = f"BUY!!! $$$ NOW {k} *** !!! ||| " * 30                      # junk
    bench = {1: " ".join(sentence(r) for _ in range(4)), 2: "too short"}
    items[300] = clean[5][:200] + " " + bench[1] + " " + sentence(r)
    items[301] = sentence(r) + " Please mail anna.lee@firm.com now. " + " ".join(sentence(r) for _ in range(12)) + " Later anna.lee@firm.com wrote again."
    items[302] = ""
    rows = [(i, t, "en", f"s{i % 4}" if i < 200 or i >= 300 else "junk", len(t)) for i, t in items.items()] + [(303, None, None, None, None)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLS).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(200 + k, 0, 0) for k in range(0, 25, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {x[0]: x for x in rows}, bench


def as_dict(df):
    out = {x.doc_id: x for x in df.collect()}
    assert len(out) == df.count()
    return out


def test_stages_one_by_one(spark, corpus):
    d, rows, bench = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "bpe"]
    stage = dict(P.STAGES)

    good = stage["quality"](spark, docs, d)
    kept = as_dict(good)
    assert good.columns == docs.columns
    assert set(kept) == {i for i in rows if not 200 <= i < 300} and all(tuple(kept[i]) == rows[i] for i in kept)

    one = stage["near_dedup"](spark, good, d)
    kept = as_dict(one)
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bags = {i: {tuple(words(x[1])[k:k + 5]) for k in range(max(1, len(words(x[1])) - 4))} for i, x in rows.items() if not 200 <= i < 300}
    want, seen = set(), []
    for i in sorted(bags):
        if not words(rows[i][1]):
            want.add(i)
        elif not any(len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j]) for j in seen):
            want.add(i)
            seen.append(i)
    assert one.columns == docs.columns and set(kept) == want and not {100, 101, 102} & want

    free = stage["decontamination"](spark, one, d)
    kept = as_dict(free)
    assert free.columns == docs.columns
    assert set(kept) == {i for i in want if bench[1] not in (rows[i][1] or "")} and 300 in want - set(kept)

    private = stage["pii"](spark, free, d)
    hidden = as_dict(private)
    assert private.columns == docs.columns and set(hidden) == set(kept)
    for i, x in hidden.items():
        if i != 301:
            assert tuple(x) == rows[i]
    before, after = rows[301][1], hidden[301].text
    mails = re.findall(r"[\w.]+@[\w.]+", after)
    assert "anna.lee" not in after and len(mails) == 2 and mails[0].rstrip(".") == mails[1].rstrip(".")
    assert before.replace("anna.lee@firm.com", "") == after.replace(mails[1], "") and hidden[301].n_chars == len(after)

    from tokenizers import Tokenizer

    from divaug.llm.op04_transducer_bpe import tokenizer_path
    tok = Tokenizer.from_file(tokenizer_path())
    coded = as_dict(stage["bpe"](spark, private, d))
    assert set(coded) == set(hidden)
    for i, x in coded.items():
        ids = tok.encode(hidden[i].text or "", add_special_tokens=False).ids
        assert x.ids == ids and x.n_tokens == len(ids)
        assert x.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_all_stages(spark, corpus):
    """The documents that are left, with the digests of their own tokens."""
    d, rows, bench = corpus
    from tokenizers import Tokenizer

    from divaug.llm.op04_transducer_bpe import tokenizer_path
    tok = Tokenizer.from_file(tokenizer_path())
    got = as_dict(P.run(spark, d))
    gone = {100, 101, 102, 300} | set(range(200, 225))
    assert set(got) == set(rows) - gone
    for i, x in got.items():
        ids = tok.encode(rows[i][1] or "", add_special_tokens=False).ids
        assert (x.ids == ids) == (i != 301)
        assert x.ids_sha256 == hashlib.sha256(b"".join(n.to_bytes(4, "little") for n in x.ids)).hexdigest()


def test_stages_on_empty_repeated_and_odd_rows(spark, corpus):
    """Rows without id or text, repeated rows, and columns of other operators' names."""
    d, rows, _ = corpus
    extra = COLS + ", n_entities int, posterior double, class_id long, hits int"
    odd = [(None, rows[1][1], "en", "s1", 5, 1, 0.5, 7, 2)] * 2 + [(1, rows[1][1], "en", "s1", 5, 1, 0.5, 7, 2)] * 2 + [(2, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(odd, extra)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), d).count() == 0
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        texts = Counter(x.text for x in out.collect())
        assert texts[None] == 1 and texts[rows[1][1]] == (1 if name == "near_dedup" else 4), name
    assert P.STAGES[-1][1](spark, docs, d).count() == len(odd)
    assert json.dumps(P.ORACLE_SQL) == "null"
