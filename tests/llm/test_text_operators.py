"""Brute-force checks of the operators that read texts."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands string, node int"


def rows(spark, items):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7) for i, t in items], SCHEMA)


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingle_set(t, n=5):
    w = words(t)
    return {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def vary(base, seed, share):
    r = np.random.default_rng(seed)
    w = base.split()
    for k in r.choice(len(w), max(1, int(share * len(w))), replace=False):
        w[k] = f"q{seed}x{k}"
    return " ".join(w)


def base_text(seed, n=200):
    r = np.random.default_rng(seed)
    return " ".join("w" + str(x) for x in r.integers(0, 5000, n))


def brute_classes(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


# ---- words and shingles ----

def test_words_and_shingles_match_python():
    from divaug.llm.vectext import shingles, word_hashes
    texts = ["Ärger, über 3 Äpfel!", None, "", "a b c", " ".join("x%d" % i for i in range(40)), "a b c", "ß" * 10, "._-"]
    h, n = word_hashes(texts, limit=16)
    assert n.tolist() == [len(words(t)) for t in texts]
    name = {}
    for x, w in zip(h.tolist(), [w for t in texts for w in words(t)]):
        assert name.setdefault(w, x) == x
    assert len(set(name.values())) == len(name)
    s, at = shingles(h, n, 5)
    assert Counter(at.tolist()) == {i: len([0 for k in range(max(1, len(words(t)) - 4))]) for i, t in enumerate(texts) if words(t)}


# ---- near duplicates ----

@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates_brute_force(spark, small):
    from divaug.llm.op09_probminhash import near_duplicates
    items = {}
    for g in range(4):
        base = base_text(g)
        for k in range(12):
            items[g * 100 + k] = vary(base, g * 50 + k, 0.01 * (k % 6)) if k else base
        items[g * 100 + 50] = base.upper() + "!"
    items.update({900: "short text", 901: "short  TEXT.", 902: "other", 903: "", 904: None, 905: "", 906: "?!"})
    got = near_duplicates(rows(spark, items.items()), small=small).toPandas()
    want = brute_classes({i: t or "" for i, t in items.items()})
    assert dict(zip(got.doc_id, got.class_id)) == want
    assert len(got) == len(items)


def test_near_duplicates_hub_group(spark):
    """Copies that are near their base but not each other form one class."""
    from divaug.llm.op09_probminhash import keep_one, near_duplicates
    base = base_text(99, 300)
    items = {0: base, **{k: vary(base, k, 0.03) for k in range(1, 60)}, 500: base_text(7), 501: base_text(8)}
    want = brute_classes(items)
    docs = rows(spark, items.items())
    got = near_duplicates(docs).toPandas()
    assert dict(zip(got.doc_id, got.class_id)) == want
    kept = sorted(r.doc_id for r in keep_one(docs).collect())
    assert kept == sorted(set(want.values()))


def test_near_duplicates_degenerate(spark):
    from divaug.llm.op09_probminhash import keep_one, near_duplicates
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0
    items = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z y x w v u"), (2, ""), (3, None)]
    got = near_duplicates(rows(spark, items)).collect()
    assert [r.class_id for r in got if r.doc_id == 1] == [1, 1]
    assert sorted(str(r.class_id) for r in got if r.doc_id is None) == ["1", "None"]
    kept = keep_one(rows(spark, items))
    assert kept.columns == rows(spark, items).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"]


def test_keep_one_by_row_and_text(spark):
    """Ids that repeat over different texts, or are null, lose no clean text and keep no near copy."""
    from divaug.llm.op09_probminhash import keep_one, near_duplicates
    a, b, c, d = (base_text(300 + k) for k in range(4))
    items = [(1, a), (1, b), (2, vary(b, 1, 0.01)), (None, c), (None, vary(c, 2, 0.01)), (None, c), (None, d), (3, vary(d, 3, 0.01)), (1, a), (None, None)]
    docs = rows(spark, items)
    got = near_duplicates(docs).collect()
    assert len(got) == len(items) and len({r.class_key for r in got if r.node is not None}) == 4
    assert sum(r.class_key is None for r in got) == 1
    kept = [(r.doc_id, r.text) for r in keep_one(docs).collect()]
    assert len(kept) == 5 and (1, a) in kept and (1, b) in kept and (3, items[7][1]) in kept and (None, None) in kept
    assert sum(t in (c, items[4][1]) for _, t in kept) == 1


def repeated_pairs(n, times):
    """Pairs of texts at plain Jaccard >= 0.8, one of which repeats half of its words' passage."""
    out = []
    for k in range(n):
        w = base_text(400 + k, 240).split()
        x = w[:215] + ["new%d" % i for i in range(10)]
        out.append((" ".join(w), " ".join(x + x[:105] * times)))
    return out


def test_signature_holds_for_repeated_passages():
    """With unit weights, registers that band and sift agree as often as plain Jaccard says."""
    import pyarrow as pa

    from divaug.llm.op09_probminhash import BAND_ROWS, REGISTERS, SHINGLE_WORDS, SIFT_SIGMAS, SIMILARITY, _signer
    least = REGISTERS * SIMILARITY - SIFT_SIGMAS * (REGISTERS * SIMILARITY * (1 - SIMILARITY)) ** 0.5
    texts = [t for p in repeated_pairs(12, 50) for t in p]
    batch = pa.RecordBatch.from_arrays([pa.array(range(24)), pa.array(range(24)), pa.array(texts)], ["rk", "doc_id", "text"])
    low = np.array([np.frombuffer(x, np.uint8) for b in _signer(REGISTERS, BAND_ROWS, SHINGLE_WORDS, "unit")([batch]) for x in b.column("low").to_pylist()])
    for k in range(12):
        assert jaccard(shingle_set(texts[2 * k]), shingle_set(texts[2 * k + 1])) >= 0.8
        assert (low[2 * k] == low[2 * k + 1]).sum() >= least


def test_repeated_passages_in_large_buckets(spark):
    """As above, where all buckets count as large ones: their leader is a hub of many near copies."""
    from divaug.llm.op09_probminhash import near_duplicates
    items = {100 * k + i: t for k, p in enumerate(repeated_pairs(3, 50)) for i, t in enumerate(p)}
    for k in range(3):
        items.update({100 * k + 10 + i: vary(items[100 * k], 9000 + 20 * k + i, 0.004 * i) for i in range(1, 8)})
    got = near_duplicates(rows(spark, items.items()), small=1, weights="unit").toPandas()
    assert dict(zip(got.doc_id, got.class_id)) == brute_classes(items)


def test_signature_estimates_weighted_similarity():
    from divaug.llm.op09_probminhash import prob_min_hash
    r = np.random.default_rng(0)
    h = r.integers(0, 1 << 48, 300).astype(np.uint64)
    sig = prob_min_hash(np.repeat([0, 1], 200), np.concatenate([h[:200], h[100:]]), np.ones(400), 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - 100 / 300) < 0.06
    # weights: the share that an element of weight w among unit weights gets
    w = np.array([8.0] + [1.0] * 24)
    one = prob_min_hash(np.zeros(25, int), h[:25], w, 1, 2048)
    assert abs((one[0] == h[0]).mean() - 8 / 32) < 0.05


# ---- decontamination ----

def test_decontamination_brute_force(spark):
    from divaug.llm.op02_spaced_seed import decontaminate, overlaps
    item, other, tiny = base_text(1, 30), base_text(2, 20), "one two three four"
    w = item.split()
    swapped = " ".join("zz%d" % k if k in (5, 14, 25) else x for k, x in enumerate(w))
    clean = base_text(50, 400)
    items = [(1, clean + " " + item + " " + clean), (2, swapped), (3, base_text(51, 100)), (4, "x " + tiny + " y"),
             (5, "one two three five"), (6, " ".join(w[:20]) + " " + clean), (7, " ".join(w[:10])), (8, None), (9, ""),
             (10, other.upper()), (10, other), (None, item)]
    docs = rows(spark, items)
    bench = spark.createDataFrame([(1, item, "x"), (2, other, "x"), (3, tiny, "x"), (4, None, "x"), (5, "", "x"), (None, "?", "x")],
                                  "item_id long, text string, hits string")
    out = overlaps(docs, bench).collect()
    assert len(out) == 7 and {r.item_id for r in out} == {1, 2, 3}
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 7, 8, 9]
    none = spark.createDataFrame([], bench.schema)
    assert decontaminate(docs, none).count() == len(items)
    assert decontaminate(spark.createDataFrame([], SCHEMA), bench).count() == 0


def test_decontamination_passages_and_shifts(spark):
    """A passage of a long item, and an item with words inserted and dropped, count; a short passage does not."""
    from divaug.llm.op02_spaced_seed import decontaminate, overlaps
    one, two = base_text(61, 59).split(), base_text(62, 100).split()
    around = base_text(63, 200)
    inserted = two[:20] + ["i1"] + two[20:40] + ["i2", "i3"] + two[40:60] + ["i4"] + two[60:80] + ["i5"] + two[80:]
    dropped = one[:11] + one[12:24] + one[25:37] + one[38:49] + one[50:]
    broken = [x for k in range(0, 59, 12) for x in one[k:k + 12] + ["j%d" % k]]   # no stretch of 13
    items = [(1, one[5:33]), (2, two[30:79]), (3, inserted), (4, dropped), (5, one[20:32]), (6, two[50:62]), (7, one[:13]), (8, broken),
             (9, one[:12] + around.split()[:50] + one[12:24])]
    docs = rows(spark, [(i, around + " " + " ".join(w) + " " + around) for i, w in items])
    bench = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "item_id long, text string")
    got = {r.doc_id: r for r in docs.selectExpr("doc_id", "xxhash64(text) as doc_key").join(overlaps(docs, bench), "doc_key").collect()}
    assert sorted(got) == [1, 2, 3, 4, 7, 8]
    assert (got[1].matched, got[1].doc_start, got[1].doc_end) == (28, 200, 228)
    assert got[2].matched == 49 and got[7].matched == 13 and got[8].matched == 59
    assert sorted(r.doc_id for r in decontaminate(docs, bench).collect()) == [5, 6, 9]


def test_masks_survive_two_substitutions():
    from divaug.llm.op02_spaced_seed import MASKS, SPAN
    for n in (15, 20, 30):
        for a in range(n):
            for b in range(a, n):
                assert any(all(m[p - at] == "0" for p in (a, b) if at <= p < at + SPAN)
                           for at in range(n - SPAN + 1) for m in MASKS), (n, a, b)


# ---- BPE ----

def bpe_texts():
    r = np.random.default_rng(3)
    alphabet = ["a", "b", "'s", "'", "'re", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "٣", "!", "...", "日本", "😀", "'ll", "'d", "S",
                "\x1c", "<|endoftext|>", "I'm", "''s", " 's", "½", "\r\n", "\0", "　", "the ", "ing"]
    texts = ["".join(r.choice(alphabet, r.integers(0, 40))) for _ in range(800)]
    return texts + ["a" * 5000, "ab" * 3000 + " " * 2000, "", "é" * 999 + " ", "\n\n a", "<|endoftext|>" * 2, "thereinafter " * 300]


def test_bpe_equals_the_library(spark):
    from hashlib import sha256

    from tokenizers import Tokenizer

    from divaug.llm.op04_transducer_bpe import TransducerTokenizer, tokenizer_path
    texts = bpe_texts()
    docs = rows(spark, [*enumerate(texts), (9000, None), (9001, texts[3]), (9001, texts[3]), (None, "null id")])
    got = TransducerTokenizer(tokenizer_path(), lexicon_words=300).fit(docs).encode(docs).collect()
    assert len(got) == len(texts) + 4
    lib = Tokenizer.from_file(tokenizer_path())
    for r in got:
        t = "" if r.doc_id == 9000 else "null id" if r.doc_id is None else texts[3] if r.doc_id == 9001 else texts[r.doc_id]
        ids = lib.encode(t, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    empty = spark.createDataFrame([], SCHEMA)
    assert TransducerTokenizer(tokenizer_path()).fit(empty).encode(empty).count() == 0


def test_automaton_is_minimal_and_numbers_words():
    from divaug.llm.op04_transducer_bpe import build_automaton
    ws = sorted({w.encode() for w in ("tap", "taps", "top", "tops", "stop", "stops", "a", "ab")})
    a = build_automaton(ws)
    slot, final = a["slot"], a["final"]
    arcs = {int(k): (int(t), int(o)) for k, t, o in slot if k >= 0}
    for n, w in enumerate(ws):
        s, total = 0, 0
        for b in w:
            s, o = arcs[s << 8 | b]
            total += o
        assert final[s] and total == n
    # states by their right languages: the minimum
    lang = lambda s: frozenset({b""} if final[s] else set()) | {bytes([k & 255]) + x for k, (t, _) in arcs.items() if k >> 8 == s for x in lang(t)}
    states = {0} | {t for t, _ in arcs.values()}
    assert len({frozenset(lang(s)) for s in states}) == len(states) == a["states"][0]


# ---- language, toxicity ----

def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def test_language_held_out_accuracy(spark):
    from divaug.llm.registry import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_centroid_lang"](spark, sf).toPandas().set_index("doc_id")
    want = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")["lang"]
    assert len(got) == len(want)
    assert all(bool(got.held_out[i]) == held(i, 4, 2) for i in got.index)
    test = got[got.held_out].join(want)
    assert (test.lang == test.lang_pred).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_language_degenerate(spark):
    from divaug.llm.op06_centroid_lang import fit, identify
    learn = spark.createDataFrame([("der die das und nicht", "de"), ("the and of with not", "en"), (None, "en"), ("x", None)], "text string, lang string")
    model = fit(learn)
    items = [(1, "und das nicht"), (2, "WITH THE AND"), (3, None), (4, ""), (5, "123 !?"), (6, "the " * 300000), (None, "und")]
    got = {r.doc_id: r for r in identify(rows(spark, items), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["de", "en", "und", "und", "und", "en"] and got[None].lang_pred == "de"
    assert got[3].score == got[4].score == got[5].score == 0
    nothing = fit(learn.limit(0))
    assert {r.lang_pred for r in identify(rows(spark, items), nothing).collect()} == {"und"}
    # distance-based rejection: a text of other letters is far from all centroids
    far = identify(rows(spark, [(1, "зима лето осень")]), model).first()
    assert far.rejected


def test_toxicity_held_out(spark):
    from divaug.llm.registry import QUERIES
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_mil_toxicity"](spark, sf).toPandas().set_index("doc_id")
    lab = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    assert all(bool(got.held_out[i]) == held(i, 3, 1) for i in got.index[:500])
    test = got[got.held_out].join(lab, how="inner")
    y, s = test.toxic.to_numpy(), test.score.rank().to_numpy()
    auc = (s[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc >= 0.95
    assert (test.predicted == (test.score >= 0.7)).all()
    assert test[test.predicted == 1].toxic.mean() >= 0.9


def test_toxicity_locates_sentences_and_degenerate(spark):
    from divaug.llm.op10_mil_toxicity import fit, toxicity
    r = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(120):
        t = [" ".join("w%d" % x for x in r.integers(0, 300, 12)) for _ in range(5)]
        if i % 4 == 0:
            t[r.integers(0, 5)] += " vileword"
        docs.append((i, ". ".join(t) + "."))
        labels.append((i, int(i % 4 == 0)))
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = fit(rows(spark, docs), lab)
    probe = [(1, "w1 w2 w3. w4 vileword w5! w6 w7"), (2, "w1 w2. w3"), (3, ""), (4, None), (5, "..."), (6, "w1 w2. " * 200000 + "vileword.")]
    got = {x.doc_id: x for x in toxicity(rows(spark, probe), model).collect()}
    assert got[1].score > 0.7 > got[2].score and got[1].offending == [10] and got[1].worst_at == 10
    assert got[3].score == got[4].score == got[5].score == 0 and got[3].offending == []
    assert got[6].score > 0.5
    none = fit(rows(spark, docs), lab.limit(0))
    assert max(x.score for x in toxicity(rows(spark, probe), none).collect()) < 1e-6


def test_samples_do_not_follow_file_order(spark):
    """Long texts, and copies, in the first file leave every language and label its share."""
    import divaug.llm.op06_centroid_lang as lang
    import divaug.llm.op10_mil_toxicity as tox
    r = np.random.default_rng(5)
    plain = [" ".join("w%d" % x for x in r.integers(0, 300, 12)) + "." for _ in range(160)]
    long = [(1000 + k, "w1 w2 w3 w4 und das nicht ein. " * 280000 + str(k)) for k in range(4)]   # 8 MB each
    docs = [(i, t + (" vileword." if i % 4 == 0 else "")) for i, t in enumerate(plain)]
    copies = [(2000 + k, "the same words again and again.") for k in range(300)]
    labels = spark.createDataFrame([(i, int(i < 160 and i % 4 == 0)) for i, _ in long + docs + copies], "doc_id long, toxic int")
    table = rows(spark, long + copies + docs).coalesce(1)
    model = tox.fit(table, labels, sample_rows=200)
    got = {x.doc_id: x for x in tox.toxicity(rows(spark, [(1, "w1 w2 w3. w4 vileword w5! w6 w7"), (2, "w1 w2. w3")]), model).collect()}
    assert got[1].score > 0.7 > got[2].score and got[1].offending == [10]
    learn = spark.createDataFrame([(t, "de") for _, t in long] + [(t, "xx") for _, t in copies] + [("зима лето осень %d" % k, "ru") for k in range(3)],
                                  "text string, lang string").coalesce(1)
    model = lang.fit(learn, sample_rows=9)
    assert sorted(set(model.of.tolist())) == [0, 1, 2]
    probe = rows(spark, [(1, "und das nicht ein"), (2, "зима осень"), (3, "the words again")])
    assert {x.doc_id: x.lang_pred for x in lang.identify(probe, model).collect()} == {1: "de", 2: "ru", 3: "xx"}
