"""BPE encoding and decoding with a minimal acyclic transducer (operator 4).

The words of the whole corpus (pieces of the byte-level split) are counted by
a grouped aggregation; the most frequent ``lexicon_words`` are compiled into a
minimal acyclic automaton with shared suffixes.  Its arcs carry additive
outputs that number the accepted words (a perfect hash), and the number points
to the word's ids.  The automaton is written as one array file, handed to
every executor with ``addFile``, and memory-mapped there.  Tasks walk it for
all words of a batch at once; words it does not accept are merged exactly by
rank, many words at a time.

The split follows the byte-level pattern
's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces; special token
strings in a text become their id, as the tokenizer does by default.

Degenerate input: null texts count as empty (no ids); texts of white space,
of one unbroken run, or of megabytes are encoded whole; repeated rows are
encoded alike; an empty table gives an empty lexicon and result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.llm.common import materialize, register, table
from divaug.llm.vectext import code_points, mixed_hashes, slices

LEXICON_WORDS = 131072
LEXICON_BYTES = 24      # longer words are merged
PART_BYTES = 1 << 20    # of texts that are encoded at once
TOKENIZER = "byte_bpe_50k.json"
# The contractions that the split keeps as words.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_KINDS: list[np.ndarray] = []


# ---- the split -------------------------------------------------------------

def _kinds() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, by code point."""
    if not _KINDS:
        white = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)}
        code = {"L": 1, "N": 2}
        out = np.fromiter((code.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
        out[list(white)] = 3
        _KINDS.append(out)
    return _KINDS[0]


def split_starts(cps: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Start positions of the words of the code points; a word never crosses
    the positions in ``cut`` (first positions of texts)."""
    n = len(cps)
    kind = _kinds()[cps]
    first = np.zeros(n + 1, bool)
    first[cut] = True
    first[n] = True
    change = np.concatenate(([True], kind[1:] != kind[:-1])) | first[:n]
    start = change.copy()
    white = kind == 3
    # the last white space before a word: a blank joins it, any other stands alone
    nxt = np.concatenate((~white[1:], [False])) & ~first[1:]
    last = white & nxt
    start |= last
    after = np.flatnonzero(last & (cps == 32)) + 1
    start[after] = False
    # contractions: an apostrophe that starts a word
    for i in np.flatnonzero((cps == 39) & start).tolist():
        if i + 1 < n and kind[i + 1] == 1 and not first[i + 1]:
            two = chr(cps[i + 1])
            if two in "stmd":
                size = 1
            elif i + 2 < n and not first[i + 2] and two + chr(cps[i + 2]) in ("re", "ve", "ll"):
                size = 2
            else:
                continue
            start[i + 1] = False
            if i + 1 + size < n:
                start[i + 1 + size] = True
    return np.flatnonzero(start)


class Words:
    """The words of some texts, as byte ranges of one buffer."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        cps = code_points(joined)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        at = np.cumsum(sizes) - sizes
        starts = split_starts(cps, at[sizes > 0]) if len(cps) else np.zeros(0, np.int64)
        width = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000).astype(np.int64)
        byte_at = np.concatenate(([0], np.cumsum(width)))
        self.buffer = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        self.start = byte_at[starts]
        self.end = np.append(self.start[1:], len(self.buffer)) if len(starts) else self.start
        self.of = np.searchsorted(at, starts, "right") - 1
        if len(at):   # an empty text shares its start with the next one
            self.of = np.searchsorted(np.cumsum(sizes), starts, "right")
        self.hash = mixed_hashes(self.buffer, self.start, self.end) if len(starts) else np.zeros(0, np.uint64)

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i]:self.end[i]].tobytes()


# ---- the merges ------------------------------------------------------------

def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE tokenizer file."""

    def __init__(self, spec: dict):
        chars = _byte_chars()
        vocab = spec["model"]["vocab"]
        raw = lambda s: bytes(chars[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * n
        for s, i in vocab.items():
            self.tokens[i] = raw(s)
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        left, right, out = [], [], []
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            left.append(vocab[a])
            right.append(vocab[b])
            out.append(vocab[a + b])
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.rank, self.out = np.arange(len(key))[order], np.array(out, np.int64)[order]
        self.key = key[order]
        # an open hash of the pairs: a few probes each instead of a binary search
        self.bits = 18
        size = 1 << self.bits
        self.slot = np.full(size, -1, np.int64)
        todo = np.arange(len(key))
        spot = self._spot(self.key)
        while len(todo):
            free = self.slot[spot] < 0
            self.slot[spot[free]] = todo[free]
            left_over = self.slot[spot] != todo
            todo, spot = todo[left_over], (spot[left_over] + 1) & (size - 1)

    def _spot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair in ``key``, or -1."""
        key = (a << 32) | b
        at = self._spot(key)
        out = np.full(len(key), -1, np.int64)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        at = at[todo]
        while len(todo):
            s = self.slot[at]
            hit = (s >= 0) & (self.key[s] == key[todo])
            out[todo[hit]] = s[hit]
            go = (s >= 0) & ~hit
            todo, at = todo[go], (at[go] + 1) & (len(self.slot) - 1)
        return out

    def encode_ranges(self, buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, their numbers): exact ids of the words
        ``buffer[start:start + size]``.  The least-ranked pair is merged first,
        the leftmost of equal rank; many words of like length at a time."""
        count, parts = np.zeros(len(size), np.int64), []
        low = 0
        for top in (4, 8, 12, 16, 24, 32, 48, 64):
            pick = np.flatnonzero((size > low) & (size <= top))
            low = top
            for part in np.array_split(pick, max(1, len(pick) // 20000)):
                if len(part):
                    ids = self._matrix(buffer, start[part], size[part], top)
                    real = ids >= 0
                    count[part] = real.sum(1)
                    parts.append((part, ids[real]))
        for i in np.flatnonzero(size > 64).tolist():
            ids = self._long(buffer[start[i]:start[i] + size[i]])
            count[i] = len(ids)
            parts.append((np.array([i]), ids))
        at = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.uint32)
        for part, ids in parts:
            flat[gather(at[part], count[part])] = ids
        return flat, count

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        size = np.fromiter((len(w) for w in words), np.int64, len(words))
        flat, count = self.encode_ranges(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        return np.split(flat, np.cumsum(count)[:-1]) if words else []

    def _matrix(self, buffer: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """(words, width) ids, -1 behind a word's last."""
        n, column = len(start), np.arange(width)
        raw = buffer[np.minimum(start[:, None] + column, len(buffer) - 1)]
        ids = np.where(column < size[:, None], self.byte_id[raw], -1)
        none = len(self.key)
        found = self.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.full((n, 0), -1)
        rank = np.where(found >= 0, self.rank[found], none)
        live = np.arange(n)
        while len(live) and width > 1:
            r = rank[live]
            at = r.argmin(1)
            best = r[np.arange(len(live)), at]
            go = best < none
            live, at = live[go], at[go]
            if not len(live):
                break
            x = ids[live]
            k = np.arange(len(live))
            merged = self.out[self.find(x[k, at], x[k, at + 1])]
            shift = np.minimum(column + (column > at[:, None]), width - 1)
            x = np.take_along_axis(x, shift, 1)
            x[:, -1] = -1
            x[k, at] = merged
            ids[live] = x
            r = np.take_along_axis(rank[live], np.minimum(column[:-1] + (column[:-1] > at[:, None]), width - 2), 1)
            r[:, -1] = none
            for p in (at - 1, at):
                ok = (p >= 0) & (p < width - 1)
                f = self.find(x[k[ok], p[ok]], x[k[ok], p[ok] + 1])
                r[k[ok], p[ok]] = np.where(f >= 0, self.rank[f], none)
            rank[live] = r
        return ids

    def _long(self, word: np.ndarray) -> np.ndarray:
        """A long word: a heap of pairs over a linked list, n log n."""
        ids = self.byte_id[word]
        f = self.find(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(ids)
        heap = [(int(self.rank[x]), i, int(x), ids[i], ids[i + 1]) for i, x in enumerate(f.tolist()) if x >= 0]
        heapq.heapify(heap)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        memo: dict = {}
        while heap:
            _, i, x, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.out[x]), -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for p, q in ((prev[i], i), (i, nxt[i])):
                if p >= 0 and q < n:
                    pair = (ids[p], ids[q])
                    if pair not in memo:
                        memo[pair] = int(self.find(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if memo[pair] >= 0:
                        heapq.heappush(heap, (int(self.rank[memo[pair]]), p, memo[pair], *pair))
        return np.array([v for v in ids if v >= 0], np.int64)


# ---- the transducer --------------------------------------------------------

def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of sorted distinct words.  Arc outputs
    number the words: the sum along a word's path is its place in the order."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict = {}

    def settle(path: list, keep: int) -> None:
        while len(path) > keep:
            parent, byte, child = path.pop()
            sign = (final[child], tuple(arcs[child].items()))
            same = known.setdefault(sign, child)
            if same != child:
                arcs[parent][byte] = same
                if child == len(arcs) - 1:
                    arcs.pop()
                    final.pop()

    path: list = []
    last = b""
    for w in words:
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        settle(path, k)
        state = path[-1][2] if path else 0
        for byte in w[k:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte, len(arcs) - 1))
            state = len(arcs) - 1
        final[state] = True
        last = w
    settle(path, 0)
    count: dict[int, int] = {}
    stack = [0]
    while stack:   # words below each state, children first
        s = stack[-1]
        todo = [t for t in arcs[s].values() if t not in count]
        if todo:
            stack += todo
        else:
            stack.pop()
            count[s] = int(final[s]) + sum(count[t] for t in arcs[s].values())
    key, target, out = [], [], []
    for s in count:
        skipped = int(final[s])
        for byte in sorted(arcs[s]):
            t = arcs[s][byte]
            key.append(s << 8 | byte)
            target.append(t)
            out.append(skipped)
            skipped += count[t]
    bits = max(8, (4 * max(1, len(key)) - 1).bit_length())
    slot = np.full((1 << bits, 3), -1, np.int32)
    key, target, out = (np.array(v, np.int64) for v in (key, target, out))
    spot = arc_spot(key, bits)
    todo = np.arange(len(key))
    while len(todo):
        free = slot[spot, 0] < 0
        slot[spot[free]] = np.stack([key[todo[free]], target[todo[free]], out[todo[free]]], 1)
        left = slot[spot, 0] != key[todo]
        todo, spot = todo[left], (spot[left] + 1) & ((1 << bits) - 1)
    return {"slot": slot, "final": np.array(final, np.int32), "states": np.array([len(count)], np.int32)}


def arc_spot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Lexicon:
    """The automaton and the ids of its words, memory-mapped from one file of
    int32: a header of 5 sizes, slots, final states, id offsets, ids."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int32, "r")
        bits, states, n_words, n_ids, longest = data[:5].tolist()
        self.bits, self.longest = bits, longest
        cuts = np.cumsum([5, 3 << bits, states, n_words + 1, n_ids])
        self.slot = data[cuts[0]:cuts[1]].reshape(-1, 3)
        self.final, self.offset, self.ids = (data[a:b] for a, b in zip(cuts[1:-1], cuts[2:]))

    @staticmethod
    def write(path: str, words: list[bytes], merges: Merges) -> None:
        words = sorted(set(words))
        ids = merges.encode_words(words)
        a = build_automaton(words)
        bits = len(a["slot"]).bit_length() - 1
        sizes = [len(x) for x in ids]   # words are sorted: ids follow their numbers
        head = [bits, len(a["final"]), len(words), sum(sizes), max(map(len, words), default=0)]
        np.concatenate([np.array(head), a["slot"].ravel(), a["final"], np.cumsum([0, *sizes]), *ids]).astype(np.int32).tofile(path)

    def find(self, w: Words) -> np.ndarray:
        """The number of each word in the lexicon, or -1."""
        n = len(w.start)
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        size = w.end - w.start
        out = np.full(n, -1, np.int64)
        live = np.flatnonzero((size > 0) & (size <= self.longest))
        for k in range(self.longest):
            if not len(live):
                break
            key = state[live] << 8 | w.buffer[w.start[live] + k]
            at = arc_spot(key, self.bits)
            got = self.slot[at, 0]
            wrong = np.flatnonzero((got != key) & (got >= 0))
            while len(wrong):
                at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
                got[wrong] = self.slot[at[wrong], 0]
                wrong = wrong[(got[wrong] != key[wrong]) & (got[wrong] >= 0)]
            ok = got == key
            live, at = live[ok], at[ok]
            state[live] = self.slot[at, 1]
            number[live] += self.slot[at, 2]
            done = live[size[live] == k + 1]
            out[done] = np.where(self.final[state[done]] > 0, number[done], -1)
            live = live[size[live] > k + 1]
        return out


# ---- batches ---------------------------------------------------------------

class Encoder:
    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon = merges, lexicon
        self.lexicon_ids = lexicon.ids.astype(np.uint32)
        # the leftmost special string, of those that start there the longest
        names = sorted(merges.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.byte_size = np.fromiter((len(t) for t in merges.tokens), np.int64, len(merges.tokens))
        self.byte_at = np.concatenate(([0], np.cumsum(self.byte_size)))
        self.bytes = np.frombuffer(b"".join(merges.tokens), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if self.cut is None or not any(self.cut.search(t) for t in texts):
            return self._plain(texts)
        parts, plan = [], []
        for t in texts:   # special strings stand at the odd places
            pieces = self.cut.split(t)
            plan.append([-1 - self.merges.special[x] if k % 2 else len(parts) + k // 2 for k, x in enumerate(pieces)])
            parts += pieces[::2]
        ids = self._plain(parts)
        return [np.concatenate([ids[p] if p >= 0 else np.array([-1 - p], np.uint32) for p in mine]) for mine in plan]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        w = Words(texts)
        if not len(w.start):
            return [np.zeros(0, np.uint32)] * len(texts)
        at = self.lexicon.find(w)
        # unseen words of this part, merged once each
        unseen = np.flatnonzero(at < 0)
        first, back = self._distinct(w, unseen)
        own, own_size = self.merges.encode_ranges(w.buffer, w.start[first], w.end[first] - w.start[first])
        own_at = np.cumsum(own_size) - own_size
        # one pool: the lexicon's ids, then those of the unseen words
        base = len(self.lexicon_ids)
        pool = np.concatenate([self.lexicon_ids, own])
        seen = np.maximum(at, 0)
        start = np.where(at >= 0, self.lexicon.offset[seen], 0).astype(np.int64)
        size = np.where(at >= 0, self.lexicon.offset[np.minimum(seen + 1, len(self.lexicon.offset) - 1)] - start, 0)
        start[unseen], size[unseen] = base + own_at[back], own_size[back]
        flat = pool[gather(start, size)]
        ends = np.cumsum(np.bincount(w.of, size, len(texts)).astype(np.int64))
        return np.split(flat, ends[:-1])

    @staticmethod
    def _distinct(w: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of each of the words ``of`` and which of them each one is.  The
        hash only sorts: words are one where their bytes are."""
        _, first, back = np.unique(w.hash[of], return_index=True, return_inverse=True)
        one = of[first][back]
        size, wanted = w.end[of] - w.start[of], w.end[one] - w.start[one]
        same = size == wanted
        at = np.flatnonzero(same)
        unlike = w.buffer[gather(w.start[of[at]], size[at])] != w.buffer[gather(w.start[one[at]], size[at])]
        wrong = np.add.reduceat(np.append(unlike, False), np.cumsum(size[at]) - size[at]) > 0 if len(at) else np.zeros(0, np.bool_)
        same[at[wrong]] = False
        if same.all():
            return of[first], back
        names = {w.word(i): k for k, i in enumerate(of[first].tolist())}
        extra = [of[first]]
        for k in np.flatnonzero(~same).tolist():
            word = w.word(int(of[k]))
            if word not in names:
                names[word] = len(names)
                extra.append(of[k:k + 1])
            back[k] = names[word]
        return np.concatenate(extra), back

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes[gather(self.byte_at[ids], self.byte_size[ids])].tobytes().decode("utf-8", "replace")


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + size[i] - 1 of all i, in order."""
    if not len(size):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(start - (ends - size), size)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, times) of the words of up to LEXICON_BYTES, once for each task
    batch; repeated words are summed before the shuffle."""
    for whole in batches:
        for batch in slices(whole, "text", PART_BYTES):
            w = Words([t for t in batch.column("text").to_pylist() if t])
            short = np.flatnonzero(w.end - w.start <= LEXICON_BYTES)
            _, first, times = np.unique(w.hash[short], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([w.word(i) for i in short[first].tolist()], pa.binary()),
                                              pa.array(times)], ["word", "times"])


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(docs[text_col].cast("string").alias("text"))


class TransducerTokenizer:
    """Fits the lexicon on the whole corpus and encodes it."""

    def __init__(self, path: str, lexicon_words: int = LEXICON_WORDS):
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f))
        self.lexicon_words = lexicon_words
        self.name = ""

    def fit(self, docs: DataFrame, text_col: str = "text") -> "TransducerTokenizer":
        spark = docs.sparkSession
        counts = materialize(_texts(docs, text_col).mapInArrow(_count_words, "word binary, times long")
                             .groupBy("word").agg(F.sum("times").alias("times")).filter("times > 1"))
        # only words at or above the count that the last lexicon word can have are ordered
        steps = counts.groupBy(F.floor(F.log2("times") * 8).alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect()
        least, seen = 0, 0
        for r in steps:   # one row for each eighth of a power of two
            least, seen = r["b"], seen + r["n"]
            if seen >= self.lexicon_words:
                break
        top = counts.filter(F.floor(F.log2("times") * 8) >= least).orderBy(F.desc("times"), "word").limit(self.lexicon_words).select("word").toArrow()
        folder = tempfile.mkdtemp(prefix="lexicon-")   # the driver's own copy; executors fetch theirs
        self.name = f"lexicon-{uuid.uuid4().hex}.bin"
        Lexicon.write(os.path.join(folder, self.name), top.column("word").to_pylist(), self.merges)
        spark.sparkContext.addFile(os.path.join(folder, self.name))
        return self

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every row."""
        name = self.name
        shared = docs.sparkSession.sparkContext.broadcast(self.merges)   # the vocabulary: a fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = Encoder(shared.value, Lexicon(SparkFiles.get(name)))
            sha = lambda b: hashlib.sha256(b).hexdigest()
            for whole in batches:
                for batch in slices(whole, "text", PART_BYTES):
                    ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                    decoded = [encoder.decode(x) for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                         pa.array([len(x) for x in ids], pa.int64()),
                         pa.array([sha(x.astype("<u4").tobytes()) for x in ids], pa.string()),
                         pa.array([sha(t.encode("utf-8", "replace")) for t in decoded], pa.string())],
                        ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])
        return (docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
                    .mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The public tokenizer file (a parameter of the operator, never copied)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op4_transducer_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tok = TransducerTokenizer(tokenizer_path()).fit(docs)
    return tok.encode(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
