"""Language identification by nearest centroids (operator 6).

A text is a vector of hashed character 1- to 3-grams (letters of the
lower-cased text; every other run is one blank), damped by 1 + ln, weighted by
the inverse document frequency, and scaled to length one.  Document
frequencies are counted over all learning rows.  Each language gets several
centroids by spherical k-means on a bounded sample of distinct learning texts
(``sample_rows`` in all, shared equally by the languages), those with the least
hashes, so whatever the order of files; the driver gets their vectors and no
text, so long texts count whole.  A text gets the
language of the centroid with the greatest cosine; it is rejected when that
cosine is below the distance at which the given share of the learning sample
of that language lies (``rejected``).

Degenerate input: null texts and texts without a letter are `und` with score
0; empty texts too.  Rows without a language are never learnt from.  When no
row can be learnt from, every text is `und`.  Ties go to the language that
sorts first.  Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.llm.common import materialize, register, table
from divaug.llm.vectext import code_points, mix64, slices

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE_ROWS = 4000
REJECT_SHARE = 0.002
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000))
    return _LETTERS[0]


def gram_counts(text: str, dims: int = DIMENSIONS) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams; None without a letter.  Long texts are
    counted piece by piece."""
    total = None
    table_ = _letters()
    for at in range(0, len(text), 1 << 20):
        # a piece reaches two characters back, whose own grams were counted
        cps = code_points(text[max(0, at - 2):at + (1 << 20)].lower())
        letter = table_[cps]
        if not letter.any():
            continue
        c = np.where(letter, cps, 32).astype(np.uint64)
        keep = np.concatenate(([True], letter[1:] | letter[:-1]))
        c = np.concatenate(([np.uint64(32)], c[keep], [np.uint64(32)]))
        one = c[c != 32]
        two = (c[:-1] << np.uint64(21)) | c[1:] | np.uint64(1 << 62)
        three = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
        h = mix64(np.concatenate([one + np.uint64(1), two, three])) >> np.uint64(64 - (dims.bit_length() - 1))
        n = np.bincount(h.astype(np.int64), minlength=dims)
        total = n if total is None else total + n
    return total


def _matrix(texts: list[str | None], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(damped counts, whether the row has a letter)."""
    out = np.zeros((len(texts), dims), np.float32)
    has = np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        n = gram_counts(t, dims) if t else None
        if n is not None:
            has[i] = True
            some = np.flatnonzero(n)
            out[i, some] = 1 + np.log(n[some])
    return out, has


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _frequencies(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, np.int64), 0
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20, 512):
                x, has = _matrix(batch.column("text").to_pylist(), dims)
                df += (x > 0).sum(0)
                n += int(has.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df], pa.list_(pa.int64()))], ["n", "df"])
    return run


def _vectors(dims: int):
    """(lang, key, at, value): the damped counts of each text with a letter that are not 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20, 512):
                x, has = _matrix(batch.column("text").to_pylist(), dims)
                some = [np.flatnonzero(row) for row in x]
                out = pa.RecordBatch.from_arrays(
                    [batch.column("lang"), batch.column("key"), pa.array([i.astype(np.uint16).tobytes() for i in some], pa.binary()),
                     pa.array([row[i].tobytes() for row, i in zip(x, some)], pa.binary())], ["lang", "key", "at", "value"])
                yield out.filter(pa.array(has))
    return run


def _letter_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key) of the texts with a letter."""
    for whole in batches:
        for batch in slices(whole, "text"):
            has = [any(c.isalpha() for c in t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(has, pa.bool_())).select(["lang", "key"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows; starts from the farthest rows, so is deterministic."""
    start = [0]
    near = x @ x[0]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        of = np.argmax(x @ c.T, 1)
        c = _unit(np.stack([x[of == i].sum(0) if (of == i).any() else c[i] for i in range(len(c))]))
    return c.astype(np.float32)


class CentroidModel:
    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, reject: np.ndarray):
        self.langs, self.idf, self.centroids, self.of, self.reject = langs, idf, centroids, of, reject

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        x, has = _matrix(texts, len(self.idf))
        if not len(self.langs):
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = _unit(x * self.idf) @ self.centroids.T
        best = np.argmax(cos, 1)
        score = np.where(has, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0).astype(np.float64)
        lang = self.of[best]
        return ([self.langs[i] if h else "und" for i, h in zip(lang.tolist(), has.tolist())], score,
                ~has | (score < self.reject[lang]))


def fit(learn: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMENSIONS, k: int = CENTROIDS,
        sample_rows: int = SAMPLE_ROWS) -> CentroidModel:
    """``learn``: rows to learn from.  The driver gets one vector of document
    frequencies, the language counts and the bounded sample."""
    rows = learn.select(learn[text_col].cast("string").alias("text"), learn[lang_col].alias("lang")).filter("lang is not null and text is not null")
    found = rows.mapInArrow(_frequencies(dims), "n long, df array<long>")
    sums = (found.select("n", F.posexplode("df").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
                 .toPandas())
    keyed = rows.withColumn("lang", F.col("lang").cast("string")).withColumn("key", F.xxhash64("text"))
    keys = materialize(keyed.mapInArrow(_letter_keys, "lang string, key long").distinct())
    by_lang = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count("*").alias("n"))
               .orderBy(F.desc("n"), "lang").limit(sample_rows).collect()}
    if not by_lang:
        return CentroidModel([], np.ones(dims, np.float32), np.zeros((0, dims), np.float32), np.zeros(0, int), np.zeros(0))
    langs = sorted(by_lang)
    n = int(sums["n"].max())
    df = np.zeros(dims)
    df[sums["i"]] = sums["v"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    each = max(1, sample_rows // len(langs))
    # a hash threshold that some more than `each` pass, then the least hashes: at most 3 * sample_rows + 40 a language
    many = keys.sparkSession.createDataFrame([(lang, min(1.0, (3 * each + 40) / count)) for lang, count in by_lang.items()], "lang string, share double")
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near: dict = {lang: [] for lang in langs}
    for r in keys.join(F.broadcast(many), "lang").filter(unit < F.col("share")).select("lang", "key", unit.alias("u")).collect():
        near[r["lang"]].append((r["u"], r["key"]))
    drawn = keys.sparkSession.createDataFrame([(lang, key) for lang in langs for _, key in sorted(near[lang])[:each]], "lang string, key long")
    # copies of a text fall together before they are read
    picked = (keyed.join(F.broadcast(drawn), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))
                   .mapInArrow(_vectors(dims), "lang string, key long, at binary, value binary").collect())
    picked.sort(key=lambda r: (r["lang"], r["key"]))
    x = np.zeros((len(picked), dims), np.float32)
    for row, r in zip(x, picked):
        row[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float32)
    x, y = _unit(x * idf), np.array([r["lang"] for r in picked], object)
    centroids, of, reject = [], [], []
    for i, lang in enumerate(langs):
        mine = x[y == lang]
        if not len(mine):
            reject.append(0.0)
            continue
        c = spherical_kmeans(mine, k)
        centroids.append(c)
        of += [i] * len(c)
        reject.append(float(np.quantile((mine @ c.T).max(1), REJECT_SHARE)) * 0.8)
    if not centroids:
        return CentroidModel([], idf, np.zeros((0, dims), np.float32), np.zeros(0, int), np.zeros(0))
    return CentroidModel(langs, idf, np.concatenate(centroids), np.array(of), np.array(reject))


def identify(docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row.  The model is a
    fixed number of floats for each language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20, 512):
                lang, score, rejected = shared.value.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score),
                                                  pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])
    return (docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
                .mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean"))


@register("op6_centroid_lang")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 4 is not 2, predicts all."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
