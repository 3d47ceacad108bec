"""Benchmark decontamination by spaced-seed hashing (operator 2).

A seed is a window of 12 words seen through a fixed mask that ignores some
positions, so a hit survives substituted words at those positions.  The seeds
of all benchmark items and of all whole documents are joined on their hash.
Documents are first sifted by a bitmap of the benchmark's hashes, whose size is
fixed, so its broadcast is bounded; a larger benchmark only lets more seeds
through to the same join.  Each hit gives a diagonal (document position minus
item position), on which the words of item and document are compared around
the hit: a document is contaminated when, on one diagonal, a stretch scores
best with +1 for an equal and -2 for a substituted word, and its equal words
are at least 8 and at least half of the item's words, or at least 13 however
long the item is.  Where no diagonal has that, stretches of 5 or more equal
words on neighbouring diagonals (up to 8 words apart, so that words may be
inserted or dropped) are added up, each word of item and document once, and
need 8 and half of the item's words, too.

Masks (1: the word counts), 8 of 12 positions each: whichever two words of an
item of 15 or more words are substituted, some seed of the item stays whole.  Items of
fewer than 12 words use one seed of all their words and need all of them.

Degenerate input: null and wordless texts (on either side) never match; an
item or a document that repeats is judged each time; null ids are carried as
they are; empty tables give empty results; other columns are ignored or, in
the filter, kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.llm.common import HashBitmap, build_bitmap, materialize, register, table
from divaug.llm.vectext import BASE, mix64, slices, word_hashes

# The masks of the seeds.
MASKS = ("111010110011", "100111101011", "101100111110")
SPAN = 12
FILTER_BITS = 25
LEAST_WORDS, LEAST_SHARE = 8, 0.5
LEAST_RUN = 13
SHIFT, LEAST_PIECE = 8, 5


def seed_hashes(words: np.ndarray, counts: np.ndarray, lengths: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, row, position) of the seeds, mask by mask; ``lengths``: whole
    short windows of these numbers of words too."""
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    patterns = [(SPAN, [k for k, c in enumerate(m) if c == "1"], i) for i, m in enumerate(MASKS)]
    patterns += [(n, list(range(n)), 100 + n) for n in lengths]
    for span, at, salt in patterns:
        n = len(words) - span + 1
        if n <= 0:
            continue
        h = np.full(n, salt + 1, np.uint64)
        for k in at:
            h += words[k:k + n] * np.uint64(pow(BASE, k + 1, 1 << 64))
        keep = np.flatnonzero(row[:n] == row[span - 1:])
        yield mix64(h[keep]), row[keep], keep - first[keep]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = word_hashes(batch.column("text").to_pylist())
        key = batch.column("item_key").to_numpy()
        parts = list(seed_hashes(words, counts))
        ends = np.cumsum(counts)
        for i in np.flatnonzero((counts > 0) & (counts < SPAN)).tolist():
            n = int(counts[i])
            for h, _, at in list(seed_hashes(words[ends[i] - n:ends[i]], counts[i:i + 1], (n,)))[-1:]:
                parts.append((h, np.full(len(h), i), at))
        for h, row, at in parts:
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key[row]), pa.array(at.astype(np.int32))],
                                             ["h", "item_key", "item_at"])


def _doc_seeds(known: HashBitmap, lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, counts = word_hashes(batch.column("text").to_pylist())
                key = batch.column("doc_key").to_numpy()
                for h, row, at in seed_hashes(words, counts, lengths):
                    hit = known.contains(h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[hit].view(np.int64)), pa.array(key[row[hit]]), pa.array(at[hit].astype(np.int32))],
                        ["h", "doc_key", "doc_at"])
    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = word_hashes(batch.column("text").to_pylist())
        ends = np.cumsum(counts)
        sets = [words[e - c:e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("item_key"), pa.array(sets, pa.binary())], ["item_key", "words"])


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the best stretch, +1 equal, -2 other."""
    score = np.concatenate(([0], np.cumsum(np.where(equal, 1, -2))))
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.argmin(score[:end + 1]))
    return start, end, int(equal[start:end].sum())


def needed(n: int) -> tuple[float, float]:
    """Equal words that one stretch, and that several need of an item of n words."""
    several = n if n < LEAST_WORDS else max(LEAST_WORDS, LEAST_SHARE * n)
    return min(several, max(LEAST_WORDS, LEAST_RUN)), several


def pieces(equal: np.ndarray) -> list[tuple[int, int]]:
    """All stretches as ``best_stretch`` finds them with LEAST_PIECE equal words or more."""
    out, todo = [], [(0, len(equal))]
    while todo:
        lo, hi = todo.pop()
        if int(equal[lo:hi].sum()) < LEAST_PIECE:
            continue
        start, end, same = best_stretch(equal[lo:hi])
        if same >= LEAST_PIECE:
            out.append((lo + start, lo + end))
            todo += [(lo, lo + start), (lo + end, hi)]
    return out


def chained(item: np.ndarray, doc: np.ndarray, diagonals: list[int]) -> tuple[int, int, int]:
    """(equal words, start, end) in the document of the best group of
    neighbouring diagonals around the hits."""
    best, at = (0, 0, 0), 0
    hit = sorted(set(diagonals))
    while at < len(hit):
        to = at + 1
        while to < len(hit) and hit[to] - hit[to - 1] <= SHIFT:
            to += 1
        mine, theirs = [], []
        for d in sorted({d + k for d in hit[at:to] for k in range(-SHIFT, SHIFT + 1)}):
            lo, hi = max(0, -d), min(len(item), len(doc) - d)
            if hi - lo < LEAST_PIECE:
                continue
            equal = item[lo:hi] == doc[lo + d:hi + d]
            for start, end in pieces(equal):
                same = lo + start + np.flatnonzero(equal[start:end])
                mine.append(same)
                theirs.append(same + d)
        at = to
        if mine:
            theirs = np.unique(np.concatenate(theirs))
            found = min(len(np.unique(np.concatenate(mine))), len(theirs))
            if found > best[0]:
                best = (found, int(theirs[0]), int(theirs[-1]) + 1)
    return best


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            words, counts = word_hashes(batch.column("text").to_pylist())
            ends = np.cumsum(counts)
            out: dict[str, list] = {"doc_key": [], "item_key": [], "doc_start": [], "doc_end": [], "matched": [], "item_words": []}
            for i, (doc, hits) in enumerate(zip(batch.column("doc_key").to_pylist(), batch.column("hits").to_pylist())):
                mine = words[ends[i] - counts[i]:ends[i]]
                best: dict = {}
                others: dict = {}
                for hit in hits:
                    item = np.frombuffer(hit["words"], np.uint64)
                    d = hit["diagonal"]
                    lo, hi = max(0, -d), min(len(item), len(mine) - d)
                    if hi <= lo:
                        continue
                    start, end, same = best_stretch(item[lo:hi] == mine[lo + d:hi + d])
                    others.setdefault(hit["item_key"], (item, []))[1].append(d)
                    if same >= needed(len(item))[0] and same > best.get(hit["item_key"], (0,))[0]:
                        best[hit["item_key"]] = (same, lo + d + start, lo + d + end, len(item))
                for item_key, (item, diagonals) in others.items():
                    if item_key not in best and len(item) >= SPAN:
                        same, start, end = chained(item, mine, diagonals)
                        if same >= needed(len(item))[1]:
                            best[item_key] = (same, start, end, len(item))
                for item_key, (same, start, end, n) in best.items():
                    for k, v in zip(out, (doc, item_key, start, end, same, n)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_key"], pa.int64()), pa.array(out["item_key"], pa.int64())]
                + [pa.array(out[k], pa.int32()) for k in ("doc_start", "doc_end", "matched", "item_words")], list(out))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_key, item_id, doc_start, doc_end, matched, item_words): the best
    verified overlap of each contaminated text with each item, in words.
    doc_key is a hash of the text, so copies are judged once."""
    spark = docs.sparkSession
    items = materialize(benchmark.select(benchmark[item_col].alias("item_id"), benchmark[item_text].cast("string").alias("text"))
                        .filter("text is not null").withColumn("item_key", F.xxhash64("text")))
    texts = items.groupBy("item_key").agg(F.min("text").alias("text"))
    seeds = materialize(texts.mapInArrow(_item_seeds, "h long, item_key long, item_at int"))
    short = texts.mapInArrow(_item_words, "item_key long, words binary")
    lengths = tuple(sorted(r["n"] for r in short.select(F.expr("cast(length(words) div 8 as int)").alias("n"))
                           .filter(f"n > 0 and n < {SPAN}").distinct().collect()))   # at most 11 values
    known = build_bitmap(seeds, "h", FILTER_BITS)
    base = docs.select(docs[text_col].cast("string").alias("text")).filter("text is not null") \
               .select(F.xxhash64("text").alias("doc_key"), "text")
    hits = base.mapInArrow(_doc_seeds(known, lengths), "h long, doc_key long, doc_at int")
    near = (hits.join(seeds, "h").groupBy("doc_key", "item_key", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
                .agg(F.count("*").alias("hits")))
    # a common passage hits many documents; a document hits a bounded number of (item, diagonal) for its length
    near = materialize(near.join(short, "item_key"))
    per_doc = near.groupBy("doc_key").agg(F.collect_list(F.struct("item_key", "diagonal", "words")).alias("hits"))
    wanted = build_bitmap(near.select("doc_key"), "doc_key", FILTER_BITS)
    texts_hit = (base.mapInArrow(_only(wanted), "doc_key long, text string")
                     .groupBy("doc_key").agg(F.min("text").alias("text")))
    found = texts_hit.join(per_doc, "doc_key").mapInArrow(
        _verify, "doc_key long, item_key long, doc_start int, doc_end int, matched int, item_words int")
    return found.join(items.select("item_key", "item_id"), "item_key").drop("item_key")


def _only(wanted: HashBitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.contains(batch.column("doc_key").to_numpy())))
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows; all columns stay."""
    bad = materialize(overlaps(docs, benchmark, text_col=text_col).select("doc_key").distinct())
    cols = docs.columns
    rows = docs.withColumn("__doc_key", F.xxhash64(docs[text_col].cast("string")))
    return rows.join(bad.withColumnRenamed("doc_key", "__doc_key"), "__doc_key", "left_anti").select(*cols)


@register("op2_spaced_seed")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and item."""
    docs = table(spark, sf_dir, "documents")
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    ids = docs.select("doc_id", F.xxhash64("text").alias("doc_key"))
    return ids.join(found, "doc_key").select("doc_id", "item_id", "doc_start", "doc_end", "matched", "item_words")
