"""Vectorised words and shingles of text batches (numpy, inside Spark tasks).

A word is a run of letters and digits of the lower-cased text.  Texts are cut
into bounded groups, so memory follows the group and not the Arrow batch.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _TABLES or len(_TABLES["pow"]) < n:
        size = max(n, 1 << 20)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("pow", BASE), ("inv", inverse)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            done = 1
            while done < size:   # doubling: out[done:2*done] = out[:done] * base**done
                step = min(done, size - done)
                out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            _TABLES[name] = out
    return _TABLES["pow"], _TABLES["inv"]


def alnum_table() -> np.ndarray:
    if "alnum" not in _TABLES:
        _TABLES["alnum"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.bool_, 0x110000)
    return _TABLES["alnum"]


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 2 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of a bounded size (one row at least).
    After a batch the worker gives freed memory back: it lives on for other
    stages."""
    n = batch.num_rows
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < n:
        limit = (ends[at - 1] if at else 0) + max_bytes
        to = max(at + 1, min(at + max_rows, int(np.searchsorted(ends, limit, "right"))))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if "trim" not in _TABLES:
        _TABLES["trim"] = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if _TABLES["trim"] is not None:
        _TABLES["trim"](0)


def _pieces(texts: list[str | None], limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (row, lower-cased piece); a text longer than ``limit`` is
    cut at white space."""
    rows, out, total = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        at = 0
        while at < len(t):
            to = len(t)
            if to - at > limit:
                space = t.find(" ", at + limit)
                to = len(t) if space < 0 else space
            piece = t[at:to].lower()
            rows.append(i)
            out.append(piece)
            total += len(piece) + 1
            at = to
            if total >= limit:
                yield rows, out
                rows, out, total = [], [], 0
    if out:
        yield rows, out


def run_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``cps[starts:ends]`` by prefix sums: for features
    that may share a place.  A polynomial modulo 2**64 has known collisions;
    what tells words apart takes ``mixed_hashes``."""
    power, inverse = _powers(len(cps) + 1)
    total = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * power[:len(cps)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _salts(n: int) -> np.ndarray:
    """A fixed random number for each place in a run."""
    if len(_TABLES.get("salt", ())) < n:
        _TABLES["salt"] = mix64(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * np.uint64(BASE))
    return _TABLES["salt"]


def mixed_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the disjoint runs ``cps[starts:ends]``, in order: each
    unit is mixed with its place before it is added, so no arrangement of units
    cancels out, as it would in a polynomial modulo a power of two."""
    size = ends - starts
    first = np.cumsum(size) - size
    n = int(size.sum())
    place = np.arange(n) - np.repeat(first, size)
    v = cps[place + np.repeat(starts, size)].astype(np.uint64)
    v ^= _salts(int(size.max(initial=0)))[place]
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(32)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    return mix64(total[first + size] - total[first] + size.astype(np.uint64) * np.uint64(BASE))


def _words(texts: list[str | None], limit: int, keyed: bool) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    counts = np.zeros(len(texts), np.int64)
    parts: list[np.ndarray] = []
    digests: dict = {}
    table = alnum_table()
    for rows, pieces in _pieces(texts, limit):
        cps = code_points("\n".join(pieces) + "\n")
        word = np.zeros(len(cps) + 1, np.int8)
        word[1:] = table[cps]
        edge = np.diff(word)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        parts.append(mixed_hashes(cps, starts, ends))
        first = np.concatenate(([0], np.cumsum([len(p) + 1 for p in pieces])))
        here = np.diff(np.searchsorted(starts, first))
        np.add.at(counts, rows, here)
        if keyed:   # the words of a text, each with a line end, whatever stood between them
            keep = (word[1:] | word[:-1]).astype(np.bool_)
            kept = np.where(word[1:][keep], cps[keep], np.uint32(10)).astype("<u4")
            cut = np.concatenate(([0], np.cumsum(keep)))[first]
            for i, some, a, b in zip(rows, here.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
                if some:
                    digests.setdefault(i, hashlib.blake2b(digest_size=16)).update(kept[a:b].tobytes())
    keys = [digests[i].digest() if i in digests else None for i in range(len(texts))] if keyed else []
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts, keys


def word_hashes(texts: list[str | None], limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    return _words(texts, limit, False)[:2]


def keyed_words(texts: list[str | None], limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """As ``word_hashes``, and a 128-bit cryptographic key of the words of each
    text themselves (None: no words)."""
    return _words(texts, limit, True)


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of all runs of ``size`` words; a text with fewer
    words, but one at least, has one shingle of all its words."""
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(words) - size + 1
    if n > 0:
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h += words[k:k + n] * np.uint64(pow(BASE, k + 1, 1 << 64))
        keep = row[:n] == row[size - 1:]
        h, at = mix64(h[keep]), row[:n][keep]
    else:
        h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        ends = np.cumsum(counts)
        extra = []
        for i in short:
            v = 0
            for k, w in enumerate(words[ends[i] - counts[i]:ends[i]].tolist()):
                v = (v + w * pow(BASE, k + 1, 1 << 64)) & MASK64
            extra.append(v)
        h, at = np.concatenate([h, mix64(np.array(extra, np.uint64))]), np.concatenate([at, short])
    return h, at
