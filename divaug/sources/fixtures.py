"""Views over the driver tables that give the reference's inputs a shape.

Each view is a formula over the given parquet tables, so its work grows with
them, and each has a DuckDB twin in ``divaug.plans.sqlparts``.

Fixed values (names of the splits the views assign rows to, the language
order that defines a text label, the quota category rule) are stated below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.functions import vectors as V
from divaug.functions.hashing import h24

# Split names used by the fixture views.
VEC_SPLITS = ["reduced_800", "variance_top_2_3", "dpo_d"]          # by vec_id % 3
TEXT_SPLITS = ["reduced_800", "dpo_d", "variance_top_2_3", "sft_d"]  # by source number % 4
LANG_ORDER = ["de", "en", "es", "fr"]                                # text label = rank of lang
QUESTION_SHARE_PCT = 59                                              # fx_groups category rule
EVAL_SEEDS = list(range(37, 47))                                     # evaluation seeds 37..46
PIECE_PATTERN = r"[.\n]+\s*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: list[str], idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(s) for s in names]), (idx + 1).cast("int"))


def fx_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, label, vec ARRAY<DOUBLE>, split."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_id"),
        F.col("label"),
        V.as_double_array("embedding").alias("vec"),
        _pick(VEC_SPLITS, F.col("vec_id") % 3).alias("split"))


def fx_doc_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, label, vec of every document: the default embedding of its
    whole text under its language label."""
    from divaug.operators.tokens import hashed_embedding
    return hashed_embedding(fx_text(spark, sf_dir), keep=("label",))


def fx_dynamics(spark: SparkSession, sf_dir: str, epochs: int = 3,
                scale: float = 8.0, noise: float = 2.0, vecs: DataFrame | None = None) -> DataFrame:
    """Training-dynamics log: one row per (sample, epoch) of ``vecs``
    (sample_id, label, vec; by default the embeddings table).

    Logits of a nearest-centre classifier that sharpens with the epoch plus a
    hash-salted noise term: z_k = (epoch+1)*scale*<vec, centre_k>
    + noise*h24('id:epoch:k')/2^24; logp = log_softmax(z).
    """
    from divaug.operators.diversity import class_centers, attach_model
    v = fx_vec(spark, sf_dir) if vecs is None else vecs
    cents = class_centers(v.filter(F.col("label").isNotNull()), ["label"]).select(F.col("label").alias("k"), F.col("center"))
    rows = attach_model(v, cents, "cents", order_col="k")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    z = F.transform(
        F.col("cents"),
        lambda c: (F.col("epoch") + 1) * F.lit(scale) * V.dot(F.col("vec"), c["center"])
        + F.lit(noise) * h24(F.concat_ws(":", F.col("sample_id").cast("string"),
                                         F.col("epoch").cast("string"), c["k"].cast("string"))) / F.lit(float(2 ** 24)))
    rows = rows.select("sample_id", F.col("epoch").cast("int").alias("epoch"),
                       (F.col("sample_id") / 32).cast("int").alias("iteration"), "label", z.alias("_z"))
    return V.with_log_softmax(rows, "_z", "logp").drop("_z")


def fx_dynamics_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a run stopped before its final batch: the last epoch misses
    the last iteration, so those samples have a shorter history (padding)."""
    d = fx_dynamics(spark, sf_dir)
    last_it = d.agg(F.max("iteration")).first()[0]
    return d.filter(~((F.col("epoch") == 2) & (F.col("iteration") == F.lit(last_it))))


def fx_text(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    """sample_id, text, label (language rank), split (source number % 4), and
    the columns of ``keep``."""
    d = table(spark, sf_dir, "documents")
    lang_rank = F.array_position(F.array(*[F.lit(x) for x in LANG_ORDER]), F.col("lang")) - 1
    src_no = F.regexp_extract(F.col("source"), r"(\d+)$", 1).cast("int")
    return d.select(F.col("doc_id").alias("sample_id"), "text",
                    lang_rank.cast("int").alias("label"),
                    _pick(TEXT_SPLITS, src_no % 4).alias("split"), *keep)


GROUP_PIECES = 6          # one text and up to five paraphrases
GROUP_ID_STEP = 1 << 20   # group_id = doc_id * step + number of the group in its document


def fx_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paraphrase groups: group_id, text, paraphrases (list literal), category.

    All pieces of all documents, six at a time (a document's last group may be
    shorter).  Some literals are written in other ways that Python reads (a
    trailing comma, a tuple) and some with text after the list, which it
    rejects."""
    d = table(spark, sf_dir, "documents")
    pieces = F.filter(F.split(F.col("text"), PIECE_PATTERN), lambda x: x != "")
    p = d.select("doc_id", pieces.alias("_p")).filter(F.size("_p") > 0)
    last = F.floor((F.size("_p") - 1) / GROUP_PIECES).cast("int")
    # groups are cut before they become rows, so that no row carries its document
    cut = F.transform(F.sequence(F.lit(0), last), lambda c: F.struct(
        c.alias("c"), F.get("_p", c * GROUP_PIECES).alias("text"), F.slice("_p", c * GROUP_PIECES + 2, F.lit(GROUP_PIECES - 1)).alias("items")))
    g = p.select("doc_id", F.explode(cut).alias("_g")).select(
        (F.col("doc_id") * GROUP_ID_STEP + F.col("_g.c")).alias("group_id"), F.col("_g.text").alias("text"), F.col("_g.items").alias("_items"))
    plain = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    quoted = F.array_join(F.transform("_items", lambda x: F.concat(F.lit("'"), plain(x), F.lit("'"))), ", ")
    key = F.col("group_id").cast("string")
    form, n = h24(F.concat(F.lit("lit:"), key)) % 16, F.size("_items")
    literal = (F.when(form == 0, F.concat(F.lit("["), quoted, F.lit("] and more")))
                .when((form == 1) & (n >= 1), F.concat(F.lit("["), quoted, F.lit(",]")))
                .when((form == 2) & (n >= 2), F.concat(F.lit("("), quoted, F.lit(")")))
                .otherwise(F.concat(F.lit("["), quoted, F.lit("]"))))
    cat = F.when(h24(F.concat(F.lit("cat:"), key)) % 100 < QUESTION_SHARE_PCT,
                 F.lit("question")).otherwise(F.lit("sentence"))
    return g.select("group_id", "text", literal.alias("paraphrases"), cat.alias("category"))


def fx_pairs(spark: SparkSession, sf_dir: str, marker_a: str = "Premise: ",
             marker_b: str = "Hypothesis: ") -> DataFrame:
    """A user turn joined to the next assistant turn, rendered as a pair text."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("a"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                       F.col("text").alias("b"))
    j = u.join(a, ["conv_id", "turn"])
    return j.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sample_id"),
                    F.concat(F.lit(marker_a), F.col("a"), F.lit(" " + marker_b), F.col("b")).alias("text"),
                    (F.col("conv_id") % 3).cast("int").alias("label"))


def fx_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA rows (form 1): question, choices (4 tokens of the text), answerKey."""
    b = table(spark, sf_dir, "benchmark")
    toks = F.split(F.col("text"), r"\s+")
    return b.select(F.col("item_id").alias("sample_id"), F.col("text").alias("question"),
                    F.slice(toks, 1, 4).alias("choices"),
                    _pick(["A", "B", "C", "D"], F.col("item_id") % 4).alias("answerKey"))


def fx_qa_codah(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA rows (form 2): question_propmt, candidate_answers, correct_answer_idx."""
    b = table(spark, sf_dir, "benchmark")
    toks = F.split(F.col("text"), r"\s+")
    return b.select(F.col("item_id").alias("sample_id"), F.col("text").alias("question_propmt"),
                    F.slice(toks, 1, 4).alias("candidate_answers"),
                    (F.col("item_id") % 4).cast("int").alias("correct_answer_idx"))
