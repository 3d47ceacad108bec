"""Periodic runs of words by an online sparse diagonal DP (operator 11).

A word is a run of bytes other than space, tab, LF, VT, FF and CR.  A run is a
stretch of consecutive words with smallest period q and a length of at least
max(24, 3 q) that no neighbouring word extends.

The DP goes over the words in order.  A word that follows an earlier
occurrence of itself lies on the diagonal of their distance (lag); the match
length of an active lag grows by one for each word that matches, and a
diagonal that ends with max(24 - q, 2 q) matches or more is emitted there and
then as a run of that period.  Keeping every earlier occurrence of a common
word would be quadratic, so only diagonals that can become runs are active:
a run of period q repeats at least max(16, 2 q) words, hence for a length m of
16 or the power of two with q <= m < 2 q, each of its last words ends a gram of
m words whose *latest* earlier occurrence is exactly q words back (a primitive
word occurs in its square at the ends only).  So one lag is active for each
word and m: the distance to the latest earlier occurrence of the gram that ends
there, if that is at most m.  Conversely a stretch of constant lag that is long
enough is maximal and has no smaller period (both follow from Fine and Wilf's
theorem), so nothing is emitted twice and nothing has to be taken back.  A text
of n words costs n events for each m up to n / 1.5, however repetitive it is.

Grams are named exactly, not hashed: the name of 2 m words is that of the pair
of the names of their halves.  A gram whose half does not repeat in the text
cannot repeat, so texts without a repeated gram drop out after a few steps.

Degenerate input: null, empty and blank texts have no words, no run and an
empty collapsed text; rows are independent, so ids may be null or repeat; texts
of any length are read whole, words cut by piece; an empty table gives an empty
result; other columns are ignored, also those named like a column used here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.llm.common import register, table
from divaug.llm.vectext import slices

LEAST_WORDS, LEAST_PERIODS = 24, 3
WORD_GAP = r"[\x20\x09-\x0D]+"
PIECE = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
RUNS = "array<struct<start:long,length:long,period:long>>"


def text_pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, cut at white space."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size)
        to = gap.start() if gap else len(data)
        yield data[at:to]
        at = to


def name_words(texts: list[bytes], names: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The names of all words in order and the number of words of each text.
    bytes.split() cuts at the six ASCII white space bytes and no others."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    for i, data in enumerate(texts):
        for piece in text_pieces(data):
            words = piece.split()
            parts.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
            counts[i] += len(words)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), counts


def find_runs(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period."""
    found: list[tuple[np.ndarray, ...]] = []
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)   # where the word's text begins
    at = np.arange(len(names))                              # gram of m words that ends at word ``at``
    gram, m = names, 1
    while len(at):
        if m >= 16:
            lag = at - _latest(gram, at, first[at])
            _emit(found, at, lag, m, text, first)
        # only grams that repeat in their text can be half of one that does
        keep = _repeats(gram, text[at])
        at, gram = at[keep], gram[keep]
        # the name of 2 m words ending at i: names of m ending at i - m and at i
        spot = np.searchsorted(at, at - m)
        ok = (at - m >= first[at] + m - 1)
        ok &= at[np.minimum(spot, len(at) - 1)] == at - m
        left, right = gram[spot[ok]], gram[ok]
        at = at[ok]
        if len(at):
            gram = pd.factorize(left * (int(gram.max()) + 1) + right)[0].astype(np.int64)
        m *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 4
    out = [np.concatenate(x) for x in zip(*found)]
    order = np.lexsort((out[3], out[1], out[0]))
    return tuple(x[order] for x in out)


def _latest(gram: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The latest earlier end of the same gram in the same text (far away: none)."""
    order = np.argsort(gram, kind="stable")   # ``at`` rises, so equal grams stay in order
    same = gram[order[1:]] == gram[order[:-1]]
    out = np.full(len(at), -(1 << 60), np.int64)
    out[order[1:][same]] = at[order[:-1][same]]
    out[out < first] = -(1 << 60)
    return out


def _repeats(gram: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether the gram ends at another place of the same text, too."""
    order = np.argsort(gram, kind="stable")   # and so do those of one text
    same = (gram[order[1:]] == gram[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    keep = np.zeros(len(gram), np.bool_)
    keep[order[1:][same]] = True
    keep[order[:-1][same]] = True
    return keep


def _emit(found: list, at: np.ndarray, lag: np.ndarray, m: int, text: np.ndarray, first: np.ndarray) -> None:
    """Ends the diagonals of gram length m: stretches of words on one lag."""
    low = 1 if m == 16 else m // 2 + 1
    on = np.flatnonzero((lag >= low) & (lag <= m))
    if not len(on):
        return
    a, d = at[on], lag[on]
    new = np.ones(len(a), np.bool_)
    new[1:] = (a[1:] != a[:-1] + 1) | (d[1:] != d[:-1]) | (text[a[1:]] != text[a[:-1]])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(a)) - 1
    period = d[begin]
    matches = a[end] - a[begin] + m
    go = matches >= np.maximum(LEAST_WORDS - period, (LEAST_PERIODS - 1) * period)
    begin, period, matches = begin[go], period[go], matches[go]
    start = a[begin] - m + 1 - period
    found.append((text[a[begin]], start - first[a[begin]], matches + period, period))


def dropped_words(counts: np.ndarray, runs: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether any run has the word behind its first period."""
    begin = np.cumsum(counts) - counts
    of, start, length, period = runs
    edge = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(edge, begin[of] + start + period, 1)
    np.add.at(edge, begin[of] + start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            names: dict[bytes, int] = {}
            code, counts = name_words([t or b"" for t in texts], names)
            runs = find_runs(code, counts)
            n_runs = np.bincount(runs[0], minlength=len(counts))
            drop = dropped_words(counts, runs)
            words = list(names)
            ends = np.cumsum(counts)
            collapsed = []
            for i, t in enumerate(texts):
                mine = slice(ends[i] - counts[i], ends[i])
                if n_runs[i]:
                    collapsed.append(b" ".join(words[c] for c in code[mine][~drop[mine]].tolist()))
                else:
                    collapsed.append(b" ".join(chain.from_iterable(p.split() for p in text_pieces(t or b""))))
            offsets = pa.array(np.concatenate(([0], np.cumsum(n_runs))).astype(np.int32))
            spans = pa.StructArray.from_arrays([pa.array(x) for x in runs[1:]], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(offsets, spans),
                 pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs by start and
    period, and its words without those that a run repeats, joined by spaces."""
    return (docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
                .mapInArrow(_finder, f"doc_id long, n_words long, runs {RUNS}, collapsed string"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The query's edit: one id in ten (by checksum) gets a periodic tail."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"), g.alias("g"))
    words = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", WORD_GAP), lambda x: x != "")))
    n = F.size("w").cast("long")
    edit = words.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn(
        "p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    tail = F.transform(F.sequence(F.col("a"), n - 1),
                       lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return edit.select("doc_id", F.when((F.col("h") % 10 == 0) & F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


@register("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs and the collapsed text, and the run of the greatest
    exponent (an exact comparison of fractions; ties: least start, then period)."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # runs come by start and period, so the first of equal exponents stands
    best = F.aggregate("runs", F.element_at("runs", 1),
                       lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])), "\n")
    some = F.size("runs") > 0
    b = found.withColumn("best", F.when(some, best))
    return b.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(some, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
