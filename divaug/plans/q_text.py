"""Registered queries: text scalars, n-grams, vocabulary, encoding, embedder
(T1-T5, V1, L7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from divaug.functions import text as TX
from divaug.operators import tokens as TK
from divaug.plans import sqlparts as S
from divaug.plans.registry import register
from divaug.sources import fixtures as FX
from divaug.functions.vectors import rnd
from divaug.session import stored

TOKEN_CAP = 1024   # fixed value: cutoff_len of the tuning configs
ENCODER_LEN = 512  # fixed value: encoder max length


@register("normalized_tokens", S.with_([S.FX_TEXT], f"""
SELECT sample_id, CAST(len(tk) AS INTEGER) AS n_tokens, md5(array_to_string(tk, ' ')) AS tokens_md5
FROM (SELECT sample_id, {S.toks()} AS tk FROM fx_text)"""))
def normalized_tokens(spark, sf):
    t = FX.fx_text(spark, sf).select("sample_id", TX.normalized_tokens("text").alias("tk"))
    return t.select("sample_id", F.size("tk").alias("n_tokens"),
                    F.md5(F.array_join("tk", " ")).alias("tokens_md5"))


@register("trigrams", S.with_([S.FX_TEXT], f"""
SELECT sample_id, CAST(len(g) AS INTEGER) AS n_trigrams, CAST(len(list_distinct(g)) AS INTEGER) AS n_distinct_trigrams,
       md5(array_to_string(g, '|')) AS trigrams_md5
FROM (SELECT sample_id, {S.trigrams('tk')} AS g FROM (SELECT sample_id, {S.toks()} AS tk FROM fx_text))"""))
def trigrams(spark, sf):
    t = FX.fx_text(spark, sf).select("sample_id", TX.normalized_tokens("text").alias("tk"))
    g = t.select("sample_id", TX.word_ngrams("tk", 3).alias("g"))
    return g.select("sample_id", F.size("g").alias("n_trigrams"),
                    F.size(F.array_distinct("g")).alias("n_distinct_trigrams"),
                    F.md5(F.array_join("g", "|")).alias("trigrams_md5"))


@register("unique_3grams", S.with_([S.FX_TEXT], f"""
SELECT split, count(DISTINCT g) AS unique_3grams
FROM (SELECT split, unnest({S.trigrams('tk')}) AS g FROM (SELECT split, {S.toks()} AS tk FROM fx_text))
GROUP BY split"""))
def unique_3grams(spark, sf):
    return TK.unique_ngrams(FX.fx_text(spark, sf), 3)


_TOKCOUNT_SQL = S.with_([S.FX_TEXT, S.vocab_sql("fx_text", "voc"), f"""tids AS (
  SELECT f.split, coalesce(v.id, 1) AS id FROM voc_t t JOIN fx_text f USING (sample_id) LEFT JOIN voc v USING (tok)),
tlen AS (SELECT split, CAST(min(n) < max(n) AS INTEGER) AS pad
  FROM (SELECT split, len({S.toks()}) + 2 AS n FROM fx_text) GROUP BY split),
tcnt AS (SELECT l.split, coalesce(d.c, 0) + 2 + l.pad AS token_count
  FROM tlen l LEFT JOIN (SELECT split, count(DISTINCT id) AS c FROM tids GROUP BY split) d USING (split))"""],
    "SELECT split, token_count FROM tcnt")


def _sketched(spark, sf):
    """Splits and all texts: exact count beside the estimate from the merged
    sketches of (split, source).  One pass over the texts makes the sketches, one
    all exact counts; no text is shuffled."""
    t = FX.fx_text(spark, sf, keep=("source",))
    parts = stored(TK.ngram_sketches(t.filter("sample_id IS NOT NULL")), "sketches")
    every = lambda df: df.withColumn("split", F.lit("all"))
    exact = TK.unique_ngrams(t, total="all")
    merged = TK.merge_sketches(parts).unionByName(TK.merge_sketches(every(parts)))
    return exact.join(merged, "split").withColumn("error", F.col("estimate") / F.col("unique_3grams") - 1)


@register("unique_3grams_sketch", None)
def unique_3grams_sketch(spark, sf):
    return _sketched(spark, sf).select("split", "unique_3grams", "estimate", rnd("error", 6).alias("error"))


SKETCH_BOUND = 0.04   # five standard errors of 2**14 registers


@register("unique_3grams_sketch_bound", S.with_([S.FX_TEXT, f"""g3 AS (
  SELECT split, unnest({S.trigrams('tk')}) AS g FROM (SELECT split, {S.toks()} AS tk FROM fx_text))"""], """
SELECT split, count(DISTINCT g) AS unique_3grams, true AS within FROM g3 GROUP BY split
UNION ALL SELECT 'all', count(DISTINCT g), true FROM g3 HAVING count(*) > 0"""))
def unique_3grams_sketch_bound(spark, sf):
    return _sketched(spark, sf).select("split", "unique_3grams", (F.abs("error") <= SKETCH_BOUND).alias("within"))


@register("token_vocab", _TOKCOUNT_SQL)
def token_vocab(spark, sf):
    return TK.split_token_count(FX.fx_text(spark, sf))


@register("encode_pad", S.with_([S.FX_TEXT, S.vocab_sql("fx_text", "voc"), f"""enc AS (
  SELECT f.sample_id,
         [2] || coalesce((SELECT list(coalesce(v.id, 1) ORDER BY t.pos) FROM voc_t t LEFT JOIN voc v USING (tok)
                          WHERE t.sample_id = f.sample_id), [])[1:{ENCODER_LEN - 2}] || [3] AS s
  FROM fx_text f)"""], f"""
SELECT sample_id, CAST(len(s) AS INTEGER) AS n_tokens,
       md5(array_to_string(s || list_transform(generate_series(1, {ENCODER_LEN} - len(s)), lambda x: 0), ',')) AS ids_md5,
       CAST(len(s) AS BIGINT) AS mask_sum
FROM enc"""))
def encode_pad(spark, sf):
    t = FX.fx_text(spark, sf)
    e = TK.encode(t, TK.vocabulary(t), max_len=ENCODER_LEN, pad=True)
    return e.select("sample_id", F.col("n_tokens").cast("int").alias("n_tokens"),
                    F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids_md5"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"))


@register("token_cap", S.with_([S.FX_TEXT], f"""
SELECT sample_id, CAST(least(len(tk), {TOKEN_CAP}) AS INTEGER) AS n_tokens, len(tk) > {TOKEN_CAP} AS truncated,
       md5(array_to_string(tk[1:{TOKEN_CAP}], ' ')) AS kept_md5
FROM (SELECT sample_id, {S.toks()} AS tk FROM fx_text)"""))
def token_cap(spark, sf):
    t = FX.fx_text(spark, sf).select("sample_id", TX.normalized_tokens("text").alias("tk"))
    kept = F.slice("tk", 1, TOKEN_CAP)
    return t.select("sample_id", F.size(kept).alias("n_tokens"), (F.size("tk") > TOKEN_CAP).alias("truncated"),
                    F.md5(F.array_join(kept, " ")).alias("kept_md5"))


@register("hashed_embedding", S.with_([S.FX_TEXT, S.hashed_vec("fx_text", "hv")], """
SELECT sample_id, CAST(b - 1 AS INTEGER) AS b, round(vec[b], 6) AS value
FROM (SELECT sample_id, vec, unnest(generate_series(1, len(vec))) AS b FROM hv)
WHERE vec[b] <> 0"""))
def hashed_embedding(spark, sf):
    e = TK.hashed_embedding(FX.fx_text(spark, sf), keep=())
    return (e.select("sample_id", F.posexplode("vec").alias("b", "value"))
             .filter(F.col("value") != 0)
             .select("sample_id", F.col("b").cast("int").alias("b"), rnd("value", 6).alias("value")))
