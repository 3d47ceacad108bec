
from pyspark.sql import functions as F

from divaug.operators import candidates as CD
from divaug.sources import io as IO
from divaug.session import shared_path


def test_parse_literals_edge_rows(spark):
    rows = [(1, "['a', \"it's\"]"), (2, "['caf\\xe9']"), (3, "['x', 'y'"), (4, "[]"), (5, "['one']"),
            (6, "['dup', 'dup']"), (7, "['back\\\\slash']")]
    df = spark.createDataFrame(rows, "group_id long, paraphrases string")
    got = {r.group_id: r.items for r in CD.parse_literals(df).collect()}
    assert got[1] == ["a", "it's"]
    assert got[2] == ["café"]
    assert got[3] is None
    assert got[4] == [] and got[5] == ["one"] and got[6] == ["dup", "dup"]
    assert got[7] == ["back\\slash"]


def test_edit_candidates(spark):
    df = spark.createDataFrame([(1, "a b c d e")], "sample_id long, text string")
    c = {r.cand_idx: r.cand_text for r in CD.builtin_generator(df).collect()}
    assert c == {0: "b c d e a", 1: "e d c b a", 2: "a b d e", 3: "b a d c e", 4: "a b c a b c d e"}


def test_extremes_tie_break_first_index(spark):
    o = spark.createDataFrame([(1, "x y z")], "k long, text string")
    c = spark.createDataFrame([(1, 0, "z y x"), (1, 1, "x y z"), (1, 2, "q r s")], "k long, cand_idx int, cand_text string")
    r = CD.select_extremes(o, c, "k").first()
    assert r.sim_idx == 0 and r.dis_idx == 2


def test_augmented_set_counts(spark):
    seeds = spark.createDataFrame([(i, f"t {i} a b", i % 2) for i in range(6)], "sample_id long, text string, label int")
    non = spark.createDataFrame([(i, f"n {i}", 0) for i in range(10, 13)], "sample_id long, text string, label int")
    ch = CD.paraphrase_select(seeds, "sample_id")
    a = CD.augmented_set(seeds, non, ch)
    assert a.count() == 2 * 6 + 3
    lab = {(r.origin, r.sample_id): r.label for r in a.collect()}
    assert all(lab[("paraphrase", i)] == lab[("seed", i)] for i in range(6))


def test_upsert(spark):
    old = spark.createDataFrame([("m", "d", "s1", 1.0), ("m", "d", "s2", 2.0)], "metric string, row_key string, split string, value double")
    new = spark.createDataFrame([("m", "d", "s2", 9.0), ("m", "d", "s3", 3.0)], "metric string, row_key string, split string, value double")
    got = {r.split: r.value for r in IO.upsert_cells(old, new).collect()}
    assert got == {"s1": 1.0, "s2": 9.0, "s3": 3.0}


def test_preference_pairs_degenerate(spark):
    g = spark.createDataFrame([(1, "a b c", ["a b c d"]), (2, "x y", ["x y", "p q r"])],
                              "group_id long, text string, items array<string>")
    keep = {r.group_id: r for r in CD.preference_pairs(g).collect()}
    assert keep[1].chosen == keep[1].rejected == "a b c d"
    assert keep[2].chosen == "p q r" and keep[2].rejected == "x y"
    drop = {r.group_id for r in CD.preference_pairs(g, drop_degenerate=True).collect()}
    assert drop == {2}


def test_pandas_generator_hook(spark):
    def upper_variants(texts):
        return [[t.upper(), t[::-1], t + " !"] for t in texts]
    gen = CD.pandas_generator(upper_variants)
    df = spark.createDataFrame([(1, "ab cd"), (2, "x")], "sample_id long, text string")
    c = sorted((r.sample_id, r.cand_idx, r.cand_text) for r in gen(df).collect())
    assert c == [(1, 0, "AB CD"), (1, 1, "dc ba"), (1, 2, "ab cd !"), (2, 0, "X"), (2, 1, "x"), (2, 2, "x !")]   # none is cut
    import pytest
    with pytest.raises(Exception, match="generator gave no candidate"):
        CD.pandas_generator(lambda texts: [[] for _ in texts])(df).collect()
    # through the selection path (checkpointed because it is not deterministic)
    sel = {r.sample_id: r for r in CD.paraphrase_select(df, "sample_id", generator=gen).collect()}
    assert set(sel) == {1, 2}


def test_list_literals_as_python_reads_them(spark):
    import ast

    from divaug.operators.candidates import parse_literals
    cases = ["['x', 'y']", "['x', 'y'] trailing", "['a',]", "['a' 'b']", "('a','b')", "[u'a']", r"['a\qb']", "['a', 1]", "[]", "[ ]",
             "[\"it's\", 'b']", r"['it\'s']", r"['\x41é']", "['a\nb']", "['a'", "a", "", None, "['a']\n", "[['a']]", "['']", "['é', 'ß']"]

    def want(s):
        try:
            v = ast.literal_eval(s)
        except Exception:  # noqa: BLE001
            return None
        return list(v) if isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v) else None
    df = spark.createDataFrame(list(enumerate(cases)), "i int, paraphrases string")
    got = {r.i: r["items"] for r in parse_literals(df).collect()}
    assert got == {i: want(s) for i, s in enumerate(cases)}


def test_streams_equal_batch_on_repeated_steps(spark):
    """Two iterations in an epoch and a record that arrives twice."""
    from divaug.operators.dynamics import score_table
    from divaug.streaming import dynamics_stream as ST
    log = spark.createDataFrame([(1, 0, 0, 0, [-0.1, -2.0]), (1, 0, 1, 0, [-2.0, -0.1]), (1, 0, 1, 0, [-2.0, -0.1]), (1, 1, 0, 0, [-0.1, -2.0]),
                                 (2, 0, 0, 1, [-0.1, -2.0])], ST.LOG_SCHEMA)
    batch = {r.sample_id: r for r in score_table(log).collect()}
    for r in ST.running_forgetting(log).collect():   # the same plan runs on a stream in update mode
        b = batch[r.sample_id]
        assert (r.n_ep, r.forgetting, r.correctness) == (b.n_records, b.forgetting, b.correctness)
    for r in ST.running_scores(log).collect():
        b = batch[r.sample_id]
        assert r.correctness == b.correctness and abs(r.accumulated_margin - b.accumulated_margin) < 1e-12


def test_fan_out_cuts_a_text_once(spark):
    """No filter below the explode makes the candidates (and the tokens, once for each token) again."""
    df = spark.range(2).select(F.col("id").alias("sample_id"), F.when(F.col("id") == 0, "a b c d").alias("text"))
    c = CD.builtin_generator(df)
    plan = c.select("sample_id", F.md5("cand_text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    rows = sorted((r.sample_id, r.cand_idx, r.cand_text) for r in c.filter("sample_id = 0").collect())
    assert [r[2] for r in rows] == ["b c d a", "d c b a", "a b d", "b a d c", "a b c a b c d"]
    assert [r[1] for r in rows] == [0, 1, 2, 3, 4] and c.filter("sample_id = 1").count() == 5
    lists = CD.Generator(lambda d, text, name: d.withColumn(name, F.when(F.col("sample_id") == 0, F.array(F.lit("x"), F.lit(None).cast("string")))))
    assert [(r.cand_idx, r.cand_text) for r in lists(df).collect()] == [(0, "x"), (1, None)]
