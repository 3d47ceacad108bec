"""Toxicity by multiple-instance learning (operator 10).

A document is a bag of sentences (cut at . ! ? and line ends).  A sentence is
scored by a logistic function of its distinct hashed features (words, and the
first 4 and 5 characters of longer words, so inflected forms share evidence);
the document's probability is the noisy-or of its sentences, 1 - prod(1 - p).  Weights are
trained from document labels only, by gradient steps on the noisy-or's
likelihood with weight decay, on a bounded sample of distinct labelled texts
(``sample_rows``; texts of label 1 first take up to half of it), drawn by a
hash of the text, so whatever the order of files.  Each label has half of the
bytes of the sample; texts longer than a 32nd of that are learnt from, the
shortest first, while the drawn ones leave room for them (one at least, where
a label has no others).  Only features
tied to label 1 beyond chance (log-likelihood ratio over twice the log of the
number of features seen) get a weight.  The sentences whose own
probability is 0.5 or more are the offending ones.

Degenerate input: null, empty and wordless texts have no sentence and score 0;
when no row of label 1 is known every text scores 0; rows with a null label
are not learnt from; repeated rows are scored alike; ties between sentences go
to the first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.llm.common import materialize, register, table
from divaug.llm.vectext import alnum_table, code_points, run_hashes, slices

DIMENSIONS = 1 << 16
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 24 << 20
LONG_SHARE = 32
STEMS = (4, 5)
THRESHOLD = 0.7
PIECE = 1 << 20


def sentences(text: str, dims: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, sentence) of the distinct features of each sentence with a word,
    and the start position of these sentences.  Sentences are numbered from 0;
    a very long text is read in pieces cut at a line end or blank."""
    table_ = alnum_table()
    parts, starts_all, base, at = [], [], 0, 0
    while at < len(text):
        to = len(text)
        if to - at > PIECE:
            cut = text.find("\n", at + PIECE)
            cut = text.find(" ", at + PIECE) if cut < 0 else cut
            to = len(text) if cut < 0 else cut + 1
        piece = text[at:to]
        low = piece.lower()
        low = piece if len(low) != len(piece) else low
        cps = code_points(low)
        word = np.zeros(len(cps) + 2, np.int8)
        word[1:-1] = table_[cps]
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            stop = np.cumsum((cps == 46) | (cps == 33) | (cps == 63) | (cps == 10) | (cps == 0x3002))
            raw = stop[start]
            _, first, of = np.unique(raw, return_index=True, return_inverse=True)
            shift = np.uint64(64 - (dims.bit_length() - 1))
            key = [(of + base) * dims + (run_hashes(cps, start, end) >> shift).astype(np.int64)]
            for size in STEMS:
                longer = end - start > size
                stem = run_hashes(cps, start[longer], start[longer] + size) >> shift
                key.append((of[longer] + base) * dims + stem.astype(np.int64))
            key = np.unique(np.concatenate(key))
            parts.append(key)
            starts_all.append(start[first] + at)
            base += len(first)
        at = to
    key = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return key % dims, key // dims, np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)


def _flat(texts: list[str | None], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, sentence of all, document of each sentence, starts)."""
    bucket, of, doc, start, n = [], [], [], [], 0
    for i, t in enumerate(texts):
        b, s, at = sentences(t or "", dims)
        bucket.append(b)
        of.append(s + n)
        doc.append(np.full(len(at), i))
        start.append(at)
        n += len(at)
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return cat(bucket), cat(of), cat(doc), cat(start)


class NoisyOr:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def sentence_scores(self, bucket: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(of, self.weights[bucket], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document scores, sentence scores, their documents, their starts)."""
        bucket, of, doc, start = _flat(texts, len(self.weights))
        p = self.sentence_scores(bucket, of, len(doc))
        return combine(p, doc, len(texts)), p, doc, start


def combine(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Noisy-or of the sentences of each document; no sentence: 0."""
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def train(texts: list[str], toxic: np.ndarray, dims: int = DIMENSIONS, steps: int = 200, rate: float = 0.15,
          decay: float = 2e-3) -> NoisyOr:
    """Gradient steps (Adam) on the mean negative log likelihood."""
    bucket, of, doc, _ = _flat(texts, dims)
    y = toxic.astype(bool)
    n = len(doc)
    seen = np.unique(doc[of] * dims + bucket)
    positive, negative = (np.bincount(seen[mask] % dims, minlength=dims) for mask in (y[seen // dims], ~y[seen // dims]))
    ones, zeros = y.sum(), (~y).sum()
    rate_1 = (positive + negative) / max(1, len(y))
    gain = 2 * (positive * np.log(np.maximum(positive, 1) / np.maximum(rate_1 * ones, 1e-9))
                + negative * np.log(np.maximum(negative, 1) / np.maximum(rate_1 * zeros, 1e-9)))
    lift = np.log((positive + 0.1) / (ones + 0.2)) - np.log((negative + 0.1) / (zeros + 0.2))
    may = (lift > 1) & (gain > 2 * np.log(max(2, (positive + negative > 0).sum())))
    w = np.where(may, np.clip(lift, 0, 8), 0.0)
    b = -7.0
    bucket, of = bucket[may[bucket]], of[may[bucket]]   # the others weigh nothing
    mean, square, step_b = np.zeros(dims), np.zeros(dims), np.zeros(2)
    for k in range(1, steps + 1):
        p = NoisyOr(w, b).sentence_scores(bucket, of, n)
        whole = np.clip(combine(p, doc, len(texts)), 1e-9, 1 - 1e-9)
        # of the log likelihood by a sentence's logit: p (1 - P) / P, or -p
        slope = np.where(y[doc], p * (1 - whole[doc]) / whole[doc], -p) / max(1, len(texts))
        grad = -np.bincount(bucket, slope[of], dims) + decay * w / max(1, len(texts))
        grad_b = -float(slope.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad ** 2
        step_b = np.array([0.9 * step_b[0] + 0.1 * grad_b, 0.99 * step_b[1] + 0.01 * grad_b ** 2])
        w = w - rate * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-8)
        w = np.where(may, w, 0.0)
        b = min(-4.0, b - rate * (step_b[0] / (1 - 0.9 ** k)) / (np.sqrt(step_b[1] / (1 - 0.99 ** k)) + 1e-8))
    return NoisyOr(w, b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> NoisyOr:
    """``labels``: the rows that may be learnt from.  The driver gets counts
    and sizes by label and the drawn texts; the drawn keys are broadcast to the
    documents, so only drawn texts are shuffled."""
    rows = labels.select(labels[id_col].cast("long").alias("doc_id"), (labels[label_col].cast("int") > 0).cast("int").alias("y")).dropna().distinct()
    found = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).filter("text is not null")
    budget = sample_bytes // 2
    most = budget // LONG_SHARE
    # one row for each label and distinct text, that of its least id
    texts = materialize(found.select("doc_id", F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("size"))
                        .join(rows, "doc_id").groupBy("y", "key").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size")))
    plain = F.col("size") <= most
    sums = {r["y"]: r for r in texts.groupBy("y").agg(F.count(F.when(plain, 1)).alias("n"), F.sum(F.when(plain, F.col("size")).otherwise(0)).alias("size")).collect()}
    if 1 not in sums:
        return NoisyOr(np.zeros(DIMENSIONS), -30.0)
    ones = min(sums[1]["n"], sample_rows // 2)
    share, left = {}, {}
    for y, want in ((1, ones), (0, sample_rows - ones)):
        n, size = (sums[y]["n"], sums[y]["size"]) if y in sums else (0, 0)
        share[y] = min(1.0, want / max(1, n), budget / max(1, size))
        left[y] = budget - share[y] * size
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = texts.filter(plain & (unit < F.when(F.col("y") > 0, share[1]).otherwise(share[0]))).select("y", "key", "doc_id").collect()
    picked = [tuple(r) for r in picked]
    for y in sums:
        own = sum(1 for r in picked if r[0] == y)
        for r in texts.filter(~plain & (F.col("y") == y)).orderBy("size", "key").limit(LONG_SHARE).collect():
            if r["size"] > left[y] and own:
                break
            picked.append((y, r["key"], r["doc_id"]))
            left[y] -= r["size"]
            own += 1
    drawn = F.broadcast(docs.sparkSession.createDataFrame(picked, "y int, key long, doc_id long"))
    sample = (found.withColumn("key", F.xxhash64("text")).join(drawn, ["doc_id", "key"])
                   .groupBy("y", "key").agg(F.min("text").alias("text")).collect())
    sample.sort(key=lambda r: (r["key"], r["y"]))
    return train([r["text"] for r in sample], np.array([r["y"] > 0 for r in sample]))


def toxicity(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, worst_at, worst_score, offending) of every row:
    worst_at is the start position of the sentence with the highest score,
    offending the start positions of those with 0.5 or more.  The model is a
    fixed number of floats."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n = batch.num_rows
                score, p, doc, start = shared.value.score(batch.column("text").to_pylist())
                ends = np.searchsorted(doc, np.arange(n), "right")
                begins = np.searchsorted(doc, np.arange(n), "left")
                worst = [int(a + np.argmax(p[a:e])) if e > a else -1 for a, e in zip(begins.tolist(), ends.tolist())]
                bad = p >= 0.5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.clip(score, 0, 1)),
                     pa.array([int(start[k]) if k >= 0 else None for k in worst], pa.int64()),
                     pa.array([float(p[k]) if k >= 0 else None for k in worst], pa.float64()),
                     pa.array([start[a:e][bad[a:e]] for a, e in zip(begins.tolist(), ends.tolist())], pa.list_(pa.int64()))],
                    ["doc_id", "score", "worst_at", "worst_score", "offending"])
    return (docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
                .mapInArrow(run, "doc_id long, score double, worst_at long, worst_score double, offending array<long>"))


@register("op10_mil_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns labels from rows whose crc32(doc_id) mod 3 is not 1, scores all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = toxicity(docs, fit(docs, labels.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                         "worst_at", "worst_score", "offending")
