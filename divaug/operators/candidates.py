"""Paraphrase sets and augmentation.

Candidate generation is a pluggable batch hook (``mapInPandas``-shaped); the
built-in generator makes five deterministic token edits with native array
functions.  The candidates of a text stay an array in its row: distances use
the default hashed embedder, and the first greatest and least distance name the
chosen candidates, as the reference's argmax/argmin do.  No shuffle is needed.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divaug.functions import text as TX
from divaug.functions import vectors as V
from divaug.operators import tokens as TK
from divaug.functions.vectors import rnd
from divaug.session import small_batches, stored

# The paraphrase instruction and the multilingual note.
INSTRUCTION = "You will be given a sentence. Please paraphrase the sentence. "
MULTILINGUAL_NOTE = ("Note that the sentence maybe either english, french, german, spanish, italian, "
                     "portuguese, or hindi. ")
N_CANDIDATES = 5
# A list of plain quoted strings: no backslash, line end or second quote inside.
_PLAIN = r"(?:'[^'\\\n\r]*+'|\"[^\"\\\n\r]*+\")"
SIMPLE_LIST = rf"^[ \t]*+\[[ \t]*+(?:{_PLAIN}[ \t]*+(?:,[ \t]*+{_PLAIN}[ \t]*+)*+)?+\][ \t]*+$"


# --------------------------------------------------------------------- L1/L2
def _literal(x: str | None) -> list[str] | None:
    try:
        v = ast.literal_eval(x)
    except Exception:  # noqa: BLE001
        return None
    return list(v) if isinstance(v, (list, tuple)) and all(isinstance(e, str) for e in v) else None


@F.arrow_udf(T.ArrayType(T.StringType()))
def _literal_eval_udf(s: pa.Array) -> pa.Array:
    """Python objects are made for a slice of the batch at a time."""
    kind = pa.list_(pa.string())
    parts = [pa.array([_literal(x) for x in s.slice(i, TK.SLICE).to_pylist()], kind) for i in range(0, len(s), TK.SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def parse_literals(df: DataFrame, col: str = "paraphrases", out: str = "items") -> DataFrame:
    """L1: list literal -> ARRAY<STRING>; NULL when malformed.

    Lists of plain quoted strings, which is how the pieces are written, are
    read natively; every other literal (escapes, trailing commas, adjacent
    strings, prefixes, tuples) takes the Python literal parser, so what is
    accepted and what it means is what Python says.  Its rows are written once:
    a filter on them does not parse them again, and a later step in Python does
    not add its worker to the parser's in one task."""
    simple = F.coalesce(F.col(col).rlike(SIMPLE_LIST), F.lit(True))
    opts = {"allowSingleQuotes": "true", "allowUnquotedControlChars": "true", "mode": "PERMISSIVE"}
    native = df.filter(simple).withColumn(out, F.from_json(F.col(col), "array<string>", opts))
    small_batches(df.sparkSession)
    py = stored(df.filter(~simple).withColumn(out, _literal_eval_udf(F.col(col))), "literals")
    return native.unionByName(py)


def split_rejects(parsed: DataFrame, out: str = "items"):
    """L2: (good rows, rejected rows)."""
    return parsed.filter(F.col(out).isNotNull()), parsed.filter(F.col(out).isNull())


# ------------------------------------------------------------------- L3/L8
def sft_rows(groups: DataFrame, id_col: str = "group_id", on_error: str = "skip") -> DataFrame:
    """L3: one SFT row per paraphrase: instruction, input, output (+ids).
    ``on_error``: groups whose literal did not parse are skipped, or fail the
    job (`fail`, as the reference does on this path)."""
    items = F.col("items")
    if on_error == "fail":
        items = F.when(items.isNull(), F.raise_error(F.concat(F.lit("no list literal in group "), F.col(id_col).cast("string")))).otherwise(items)
    return groups.select(id_col, F.col("text").alias("input"),
                         F.posexplode(items).alias("pos", "output")).select(
        id_col, F.col("pos").cast("int").alias("pos"), F.lit(INSTRUCTION).alias("instruction"),
        "input", "output")


# ---------------------------------------------------------------------- L6
def chat_messages(df: DataFrame, text_col: str = "text", multilingual: bool = False) -> DataFrame:
    system = F.lit(INSTRUCTION + (MULTILINGUAL_NOTE if multilingual else ""))
    return df.withColumn("messages", F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), F.col(text_col).alias("content"))))


# ---------------------------------------------------------------------- G1
def raw_tokens(text) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def edit_candidates(tokens) -> Column:
    """The five built-in edits: rotate left 1, reverse, drop every 3rd,
    swap neighbours, repeat the first 3 (joined with spaces)."""
    t = tokens
    n = F.size(t)
    rot = F.concat(F.slice(t, 2, F.greatest(n, F.lit(1))), F.slice(t, 1, 1))
    rev = F.reverse(t)
    drop3 = F.filter(t, lambda x, i: (i + 1) % 3 != 0)
    swap = F.transform(t, lambda x, i: F.when(i % 2 == 0, F.coalesce(F.try_element_at(t, i + 2), x))
                       .otherwise(F.element_at(t, i)))
    rep = F.concat(F.slice(t, 1, 3), t)
    return F.array(*[F.array_join(e, " ") for e in (rot, rev, drop3, swap, rep)])


class Generator:
    """G1 hook: ``arrays`` adds a column with the candidates of each text;
    called, it gives (key..., cand_idx, cand_text) rows."""

    def __init__(self, arrays: Callable[[DataFrame, str, str], DataFrame]):
        self.arrays = arrays

    def __call__(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        keys = [c for c in df.columns if c != text_col]
        # an inner explode has its list's size tested below the projections, which
        # makes the candidates and, for each of their tokens, the tokens again
        c = self.arrays(df, text_col, "_cands").select(*keys, F.posexplode_outer("_cands").alias("cand_idx", "cand_text"))
        return c.filter(F.col("cand_idx").isNotNull()).withColumn("cand_idx", F.col("cand_idx").cast("int"))


def _edits(df: DataFrame, text_col: str, name: str) -> DataFrame:
    return df.withColumn("_tk", raw_tokens(F.col(text_col))).withColumn(name, edit_candidates(F.col("_tk"))).drop("_tk")


builtin_generator = Generator(_edits)


def pandas_generator(fn: Callable[[list[str]], list[list[str]]]) -> Generator:
    """Wrap a batch text->candidates function (e.g. a model loaded once per
    task) as a generator hook with the same contract as builtin_generator.
    Every candidate is kept; a text without any is an error.  Each Arrow batch
    of texts is handed to ``fn`` at once, and what it returns is read once: a
    sampling model need not give the same candidates twice."""
    def arrays(df: DataFrame, text_col: str, name: str) -> DataFrame:
        def run(it):
            for pdf in it:
                outs = [[x for x in c if x is not None] for c in fn(pdf[text_col].tolist())]
                empty = [i for i, c in enumerate(outs) if not c]
                if empty:
                    keys = [c for c in pdf.columns if c != text_col]
                    raise ValueError(f"generator gave no candidate for {len(empty)} text(s), first key {pdf.loc[empty[0], keys].to_dict()}")
                yield pdf.assign(**{name: outs})
        return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))]))
    return Generator(arrays)


# ---------------------------------------------------------------------- G2/L4
def _distances(metric: str, dims: int):
    memo: dict = {}   # of a task

    def some(tokens: pa.Array, cands: pa.Array) -> np.ndarray:
        own, each = TK.token_vectors(tokens, dims, memo), TK.token_vectors(cands.flatten(), dims, memo)
        of = np.repeat(np.arange(len(own)), TK.from_arrow(pc.list_value_length(cands)))
        if metric == "l2":
            return np.sqrt(((own[of] - each + V.L2_EPS) ** 2).sum(1))
        # cosine: dissimilar = lowest similarity
        size = lambda x: np.maximum(np.sqrt((x * x).sum(1)), V.COS_EPS)
        return -(own[of] * each).sum(1) / (size(own[of]) * size(each))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(tokens: pa.Array, cands: pa.Array) -> pa.Array:
        """Counts and vectors exist for a slice of the batch at a time."""
        cands = cands.fill_null(pa.scalar([], cands.type)) if cands.null_count else cands
        d = [some(tokens.slice(i, TK.SLICE), cands.slice(i, TK.SLICE)) for i in range(0, len(cands), TK.SLICE)]
        return TK.double_lists(np.cumsum(TK.from_arrow(pc.list_value_length(cands)), dtype=np.int64), np.concatenate([np.zeros(0), *d]))
    # so that no filter on the result moves below it and makes the candidates again
    return run.asNondeterministic()


def with_distances(df: DataFrame, text_col: str, cands_col: str, name: str = "_d", metric: str = "l2", dims: int = 64) -> DataFrame:
    """V2/V3, row-local: the distance of every candidate to its text.  Rounded
    to 12 places, so mathematically tied candidates tie exactly (then the lower
    index wins, as in the reference's argmax/argmin)."""
    return _with_distances(df, [(text_col, cands_col, name)], metric, dims)


def _with_distances(df: DataFrame, fields, metric: str = "l2", dims: int = 64) -> DataFrame:
    """The distances of several (text, candidates, name) of a row in one pass
    through Python, so a task has one worker whatever the number of fields."""
    lists = lambda x: F.coalesce(TX.normalized_tokens(x), F.array().cast("array<string>"))
    small_batches(df.sparkSession)
    raw = {f"_raw{i}": _distances(metric, dims)(lists(t), F.transform(c, lists)) for i, (t, c, _) in enumerate(fields)}
    d = df.withColumns(raw)
    return d.withColumns({name: F.transform(f"_raw{i}", lambda x: rnd(x, 12)) for i, (_, _, name) in enumerate(fields)}).drop(*raw)


def with_extremes(df: DataFrame, text_col: str, cands_col: str, metric: str = "l2", suffix: str = "") -> DataFrame:
    """G2/L4/L5, row-local: adds dis_idx, dis_text, sim_idx, sim_text, the most
    dissimilar and the most similar candidate.  Rows without a candidate go.
    No row moves and no text is fetched again."""
    return _with_extremes(df, [(text_col, cands_col, suffix)], metric)


def _with_extremes(df: DataFrame, fields, metric: str = "l2") -> DataFrame:
    """``with_extremes`` for several (text, candidates, suffix) of a row."""
    d = _with_distances(df, [(t, c, f"_d{s}") for t, c, s in fields], metric)
    for _, _, s in fields:
        d = d.filter(F.size(f"_d{s}") > 0)
    at = lambda f, s: (F.array_position(f"_d{s}", f(f"_d{s}")) - 1).cast("int")
    for _, cands, s in fields:
        d = d.withColumn(f"dis_idx{s}", at(F.array_max, s)).withColumn(f"sim_idx{s}", at(F.array_min, s))
        d = (d.withColumn(f"dis_text{s}", F.get(cands, f"dis_idx{s}"))
              .withColumn(f"sim_text{s}", F.get(cands, f"sim_idx{s}")).drop(f"_d{s}"))
    return d


def select_extremes(originals: DataFrame, cands: DataFrame, key: str, metric: str = "l2") -> DataFrame:
    """G2 where the candidates are a table of their own: ``originals``(key,
    text); ``cands``(key, cand_idx, cand_text), a few for each key.  Returns key,
    dis_idx, dis_text, sim_idx, sim_text."""
    lists = cands.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("cand_idx", "cand_text"))).alias("_c"))
    rows = originals.select(key, "text").join(lists, key).withColumn("_t", F.col("_c.cand_text"))
    x = with_extremes(rows, "text", "_t", metric)
    idx = lambda c: F.get("_c.cand_idx", c).alias(c)
    return x.select(key, idx("dis_idx"), "dis_text", idx("sim_idx"), "sim_text")


def preference_pairs(groups: DataFrame, metric: str = "l2", id_col: str = "group_id",
                     drop_degenerate: bool = False) -> DataFrame:
    """chosen = farthest paraphrase, rejected = nearest.

    With one candidate (or all tied) chosen == rejected; such pairs are kept
    by default, as the reference keeps them (quirk Z12), and dropped with
    ``drop_degenerate=True``."""
    sel = with_extremes(groups.select(id_col, "text", "items"), "text", "items", metric)
    if drop_degenerate:
        sel = sel.filter(F.col("dis_idx") != F.col("sim_idx"))
    return sel.select(id_col, F.lit(INSTRUCTION).alias("instruction"), F.col("text").alias("input"),
                      F.col("dis_text").alias("chosen"), F.col("sim_text").alias("rejected"))


def paraphrase_select(df: DataFrame, key: str, text_col: str = "text", generator: Generator = builtin_generator,
                      metric: str = "l2", keep=()) -> DataFrame:
    """G1+G2 for one text column: key, *keep, dis_idx, dis_text, sim_idx, sim_text."""
    base = generator.arrays(df.select(key, *keep, F.col(text_col).alias("text")), "text", "_cands")
    return with_extremes(base, "text", "_cands", metric).select(key, *keep, "dis_idx", "dis_text", "sim_idx", "sim_text")


def paraphrase_pairs_fields(df: DataFrame, key: str, markers=TX.NLI_MARKERS, generator: Generator = builtin_generator, keep=()) -> DataFrame:
    """Split into two fields, paraphrase each, re-render: key, *keep,
    text_dis, text_sim.  Both fields stay in their row."""
    s = df.withColumn("_pr", TX.split_pair(F.col("text"), markers)).filter(F.col("_pr").isNotNull())
    x = s.select(key, *keep, F.col("_pr.a").alias("_a"), F.col("_pr.b").alias("_b"))
    for f in ("_a", "_b"):
        x = generator.arrays(x, f, f"_c{f}")
    x = _with_extremes(x, [(f, f"_c{f}", f) for f in ("_a", "_b")])
    return x.select(key, *keep, TX.render_pair("dis_text_a", "dis_text_b", markers).alias("text_dis"),
                    TX.render_pair("sim_text_a", "sim_text_b", markers).alias("text_sim"))


# ---------------------------------------------------------------------- G5-G9
def augmented_set(seeds: DataFrame, nonseeds: DataFrame, chosen: DataFrame, key: str = "sample_id",
                  polarity: str = "dis", carry=("label",)) -> DataFrame:
    """Seeds, their chosen paraphrases (carried columns kept), non-seeds,
    with an ``origin`` column.  Where ``chosen`` has the carried columns, no row
    moves."""
    cols = [key, "text", *carry]
    text = F.col(f"{polarity}_text").alias("text")
    whole = set(carry) <= set(chosen.columns)
    para = chosen.select(key, *carry, text) if whole else seeds.select(key, *carry).join(chosen.select(key, text), key)
    return (seeds.select(*cols).withColumn("origin", F.lit("seed"))
                 .unionByName(para.select(*cols).withColumn("origin", F.lit("paraphrase")))
                 .unionByName(nonseeds.select(*cols).withColumn("origin", F.lit("nonseed"))))


def shuffled(df: DataFrame, seed: int, id_expr: Column) -> DataFrame:
    """Final seeded shuffle of an output set (B1 on a composite id that is
    unique): only ids are ranked, the rows meet their position by id.  The rows
    are written once: the ranking reads its input twice, the join a third time."""
    from divaug.operators.ranking import rank_within
    k = stored(df.withColumn("_sid", id_expr), "shuffled")
    ids = k.select("_sid").withColumn("_sk", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_sid"))))
    ranked = rank_within(ids, [F.col("_sk").asc(), F.col("_sid").asc()], [], name="position").drop("_sk")
    return k.join(ranked, "_sid").drop("_sid")


# ---------------------------------------------------------------------- P8
# Text column and carried columns per input schema, the schema of
# each dataset that is not plain text, the markers of the pair schemas.
SCHEMAS = {
    "text": ("text", ["label"]),
    "nli": ("text", ["label"]),
    "sts": ("text", ["label"]),
    "csqa": ("question", ["choices", "answerKey"]),
    "codah": ("question_propmt", ["candidate_answers", "correct_answer_idx"]),
}

SCHEMA_OF = {"anli": "nli", "mnli": "nli", "mrpc": "sts", "rte": "sts", "csqa": "csqa", "codah": "codah"}
PAIR_MARKERS = {"nli": TX.NLI_MARKERS, "sts": TX.STS_MARKERS}


def schema_select(seeds: DataFrame, schema: str, key: str = "sample_id", generator=builtin_generator, keep=()) -> DataFrame:
    """G1-G4 by schema: ``key, *keep, dis_text, sim_text`` for every seed.  Pair
    texts are paraphrased field by field; one without its markers is an error."""
    if schema not in PAIR_MARKERS:
        return paraphrase_select(seeds, key, generator=generator, keep=keep).select(key, *keep, "dis_text", "sim_text")
    markers = PAIR_MARKERS[schema]
    bad = F.raise_error(F.concat(F.lit("no pair markers in text of "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    whole = seeds.withColumn("text", F.when(TX.split_pair(F.col("text"), markers).isNotNull(), F.col("text")).otherwise(bad.cast("string")))
    return paraphrase_pairs_fields(whole, key, markers, generator, keep).select(
        key, *keep, F.col("text_dis").alias("dis_text"), F.col("text_sim").alias("sim_text"))


def project_text(df: DataFrame, schema: str, key: str = "sample_id") -> DataFrame:
    """(key, text, carry) where ``carry`` is a struct of the schema's
    pass-through columns; the text column is configuration, not code."""
    text_col, carried = SCHEMAS[schema]
    return df.select(key, F.col(text_col).alias("text"), F.struct(*carried).alias("carry"))


def restore_schema(df: DataFrame, schema: str, key: str = "sample_id", keep=()) -> DataFrame:
    """Inverse of project_text: rows written back under the input's own
    column names (the codah text column keeps its input name)."""
    text_col, carried = SCHEMAS[schema]
    return df.select(key, *keep, F.col("text").alias(text_col), *[F.col(f"carry.{c}").alias(c) for c in carried])
