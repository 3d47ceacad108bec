"""Token-level diversity and encoding (T3-T5) and the default embedder (V1)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divaug.functions import text as TX
from divaug.operators.hooks import Hook
from divaug.operators.ranking import rank_within
from divaug.session import small_batches

# Reserved token ids of the encoder vocabulary.
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
N_RESERVED = 4


def _ngram_rows(df: DataFrame, n: int, *keep) -> DataFrame:
    """(keep..., g): the word n-grams of ``tokens``.  The shifted copies become
    columns of a row before they are joined, once for each n-gram."""
    toks = F.col("tokens")
    shifted = [F.slice(toks, k + 1, F.greatest(F.size(toks), F.lit(1))).alias(f"t{k}") for k in range(n)]
    z = df.select(*keep, F.explode(F.arrays_zip(*shifted)).alias("z"))
    last = z.filter(F.col(f"z.t{n - 1}").isNotNull())   # the ends of the longer copies have no partner
    return last.select(*keep, F.concat(*[x for k in range(n) for x in (F.lit(" "), F.col(f"z.t{k}"))][1:]).alias("g"))


BITS = 62   # values of ``by`` in one mask


def unique_ngrams(df: DataFrame, n: int = 3, by: str = "split", total: str | None = None) -> DataFrame:
    """Exact count of distinct word n-grams per ``by`` value, and of all
    rows under the name ``total`` if one is given.

    The tokens become a column first, so they are computed once per row.  Every
    n-gram is shuffled once, with a bit for each ``by`` value (a catalog of
    splits) that has it: the count of a value is that of its bits, the total
    that of the n-grams, and no value's name goes with an n-gram."""
    names = [r[0] for r in df.select(by).distinct().collect()]
    if not names:
        return df.sparkSession.createDataFrame([], f"`{by}` {df.schema[by].dataType.simpleString()}, unique_{n}grams long")
    parts = [names[i:i + BITS] for i in range(0, len(names), BITS)]
    bit = [F.coalesce(*[F.when(F.col(by).eqNullSafe(F.lit(v)), F.lit(1 << i).cast("long")) for i, v in enumerate(p)], F.lit(0).cast("long")).alias(f"_m{k}")
           for k, p in enumerate(parts)]
    masks = [f"_m{k}" for k in range(len(parts))]
    g = _ngram_rows(df.select(*bit, TX.tokens_of(df).alias("tokens")), n, *masks)
    each = g.groupBy("g").agg(*[F.bit_or(m).alias(m) for m in masks])
    counts = [F.struct(F.lit(v).cast(df.schema[by].dataType).alias(by), F.coalesce(F.sum(F.getbit(m, F.lit(i)).cast("long")), F.lit(0)).alias("c"))
              for m, p in zip(masks, parts) for i, v in enumerate(p)]
    if total is not None:
        counts.append(F.struct(F.lit(total).cast(df.schema[by].dataType).alias(by), F.count(F.lit(1)).alias("c")))
    rows = each.agg(F.array(*counts).alias("_c")).select(F.explode("_c").alias("_c")).filter(F.col("_c.c") > 0)
    return rows.select(F.col(f"_c.{by}").alias(by), F.col("_c.c").alias(f"unique_{n}grams"))


def ngram_sketches(df: DataFrame, n: int = 3, by=("split", "source"), lg_k: int = 14) -> DataFrame:
    """T3, mergeable: one HLL sketch of the n-grams of each ``by`` value (at
    most 2**lg_k registers, whatever its rows); see ``merge_sketches``."""
    g = _ngram_rows(df.select(*by, TX.tokens_of(df).alias("tokens")), n, *by)
    return g.groupBy(*by).agg(F.hll_sketch_agg("g", lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, by=("split",), name: str = "estimate") -> DataFrame:
    """Distinct n-grams of any union of the parts that have a sketch, from the
    sketches alone: no text is read again, no n-gram is shuffled.  The standard
    error is about 1.04 / sqrt(2**lg_k)."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))


def vocabulary(df: DataFrame) -> DataFrame:
    """T5 vocabulary: all normalised tokens by frequency (ties by token), ids
    from N_RESERVED; numbered without a one-task window."""
    freq = (df.select(F.explode(TX.tokens_of(df)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))
    ranked = rank_within(freq, [F.col("freq").desc(), F.col("token").asc()], name="_rank")
    return ranked.select("token", "freq", (F.col("_rank") + N_RESERVED - 1).cast("int").alias("token_id"))


HOT_SHARE = 1000   # a token with one in so many of all occurrences is hot


def with_ids(rows: DataFrame, vocab: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """Adds ``id`` to (token, ...) rows.  A token that holds 1 / ``hot_share``
    of all occurrences or more would fill the task it is shuffled to; there are
    at most ``hot_share`` such tokens by counting, so they go out to the rows.
    The others are joined by a shuffle, in which no key is large."""
    total = vocab.agg(F.sum("freq").alias("n")).first()["n"] or 0
    hot = vocab.filter(F.col("freq") * hot_share >= total).select("token", F.col("token_id").alias("hot_id"))
    near = rows.join(F.broadcast(hot), "token", "left")
    done = F.col("hot_id").isNotNull() | F.col("token").isNull()
    cold = near.filter(~done).drop("hot_id").join(
        vocab.filter(F.col("freq") * hot_share < total).select("token", "token_id"), "token", "left")
    return near.filter(done).withColumnRenamed("hot_id", "id").unionByName(cold.withColumnRenamed("token_id", "id"))


def encode(df: DataFrame, vocab: DataFrame | None = None, max_len: int | None = 512, pad: bool = True,
           tokenizer: Hook | None = None) -> DataFrame:
    """T5: [CLS] ids [SEP], the body truncated so that all fits in ``max_len``
    (None: whole text), padded with PAD to ``max_len``, attention mask.  Ids
    are those of ``vocab`` (only the tokens that are kept are exploded, and
    documents without tokens go through the same group), or what ``tokenizer``,
    a hook that gives a list of ids for each text, returns."""
    if tokenizer is not None:
        ids = tokenizer.apply(df.select("sample_id", "text"), "text", "ids array<int>").select("sample_id", F.coalesce("ids", F.array().cast("array<int>")).alias("_s"))
        out = ids if max_len is None else ids.withColumn("_s", F.slice("_s", 1, max_len - 2))
        body = F.col("_s")
    else:
        toks = TX.tokens_of(df)
        if max_len is not None:
            toks = F.slice(toks, 1, max_len - 2)
        rows = df.select("sample_id", F.posexplode_outer(toks).alias("pos", "token"))
        kept = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK_ID)).alias("id")))
        out = with_ids(rows, vocab).groupBy("sample_id").agg(F.sort_array(F.collect_list(kept)).alias("_s"))
        body = F.transform("_s", lambda x: x["id"])
    out = out.withColumn("_seq", F.concat(F.array(F.lit(CLS_ID)), body, F.array(F.lit(SEP_ID))))
    n = F.size("_seq")
    if pad and max_len is not None:
        ids_col = F.concat("_seq", F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - n))
    else:
        ids_col = F.col("_seq")
    mask = F.transform(ids_col, lambda x, i: F.when(i < n, 1).otherwise(0))
    return out.select("sample_id", ids_col.alias("input_ids"), mask.alias("attention_mask"),
                      n.alias("n_tokens"))


def split_token_count(df: DataFrame, by: str = "split") -> DataFrame:
    """T4: distinct token ids per ``by`` over whole texts padded to the
    longest sequence of the split: all its distinct tokens, CLS and SEP, and
    PAD when sequence lengths differ."""
    rows = df.select(by, TX.tokens_of(df).alias("tokens"))
    rows = rows.select(by, (F.size("tokens") + 2).alias("n"), F.explode_outer("tokens").alias("token"))
    each = rows.groupBy(by, "token").agg(F.min("n").alias("_least"), F.max("n").alias("_most"))
    named = F.when(F.col(by).isNotNull(), F.col("token"))   # rows of no split count none
    got = each.groupBy(by).agg(F.count(named).alias("_ids"), (F.min("_least") < F.max("_most")).cast("int").alias("_pad"))
    return got.select(by, (F.col("_ids") + 2 + F.col("_pad")).alias("token_count"))


SLICE = 128        # rows whose tokens are counted at a time
MEMO = 1 << 16     # tokens whose bucket is remembered


# ``pa.array``, ``pa.scalar`` and ``to_numpy`` load pandas, some 36 MB in each
# Python worker; these do not.
def from_arrow(x: pa.Array) -> np.ndarray:
    """Numbers without nulls."""
    return np.from_dlpack(x)


def to_arrow(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(x), [None, pa.py_buffer(x)])


def double_lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """ARRAY<DOUBLE> rows that end at ``ends``."""
    return pa.ListArray.from_arrays(to_arrow(np.concatenate(([0], ends)).astype(np.int32), pa.int32()), to_arrow(values, pa.float64()))


def token_vectors(lists: pa.Array, dims: int, memo: dict | None = None) -> np.ndarray:
    """(rows, dims): the hashed bag of each row's tokens, L2-normalised (zeros
    without tokens).  Every distinct token is hashed once, and not again where
    ``memo`` remembers it."""
    memo = {} if memo is None else memo
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = len(lists)
    sizes = from_arrow(pc.coalesce(pc.list_value_length(lists), to_arrow(np.zeros(n, np.int32), pa.int32()))).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    if len(memo) > MEMO:
        memo.clear()
    table = np.zeros(len(coded.dictionary), np.int64)
    for i, t in enumerate(coded.dictionary.to_pylist()):
        b = memo.get(t)
        if b is None:
            b = memo[t] = int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % dims
        table[i] = b
    row = np.repeat(np.arange(n, dtype=np.int64), sizes)
    bucket = table[from_arrow(coded.indices)] if len(table) else np.zeros(0, np.int64)
    c = np.bincount(row * dims + bucket, minlength=n * dims).astype(np.float64).reshape(n, dims)
    norm = np.sqrt((c * c).sum(axis=1))
    return np.divide(c, norm[:, None], out=np.zeros_like(c), where=norm[:, None] > 0)


def _embedder(dims: int):
    memo: dict = {}   # of a task

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(tokens: pa.Array) -> pa.Array:
        v = np.zeros((len(tokens), dims))
        for i in range(0, len(tokens), SLICE):
            v[i:i + SLICE] = token_vectors(tokens.slice(i, SLICE), dims, memo)
        return double_lists(np.arange(dims, v.size + 1, dims), v.ravel())
    return run


def hashed_embedding(df: DataFrame, dims: int = 64, text_col: str = "text", keep=None,
                     id_col: str = "sample_id") -> DataFrame:
    """V1 default embedder: bag of normalised tokens hashed to ``dims`` buckets
    (h24(token) mod dims), counts L2-normalised.

    Returns ``id_col, *keep, vec``; ``keep`` defaults to every column except
    the text and tokens.  Row-local and shuffle-free: texts are cut into tokens
    in the JVM, and a vectorised helper hashes each distinct token of a batch
    once and counts.  Documents without tokens get the zero vector."""
    if keep is None:
        keep = [c for c in df.columns if c not in (id_col, text_col, "tokens")]
    small_batches(df.sparkSession)
    return df.select(id_col, *keep, _embedder(dims)(TX.tokens_of(df, text_col)).alias("vec"))


def model_embedding(df: DataFrame, model: Hook, text_col: str = "text", keep=(), id_col: str = "sample_id") -> DataFrame:
    """V1 with an encoder behind a hook that gives a vector for each text:
    ``id_col, *keep, vec``."""
    return model.apply(df.select(id_col, *keep, text_col), text_col, "vec array<double>").drop(text_col)
