"""MinHash near-duplicates by ProbMinHash (operator 9).

A text is the weighted set of its five-word shingles: one that occurs ``times``
times weighs 1 + ln(times) (``weights="unit"``: 1).  The similarity of two texts
is the probability Jaccard similarity J_P of their sets, which does not depend
on the sets' scales and for unit weights is plain Jaccard; the signature, its
bands, the sift and the verification all use this one measure.

Signature: every shingle sends a Poisson process of the rate of its weight to
registers chosen at random; a register keeps the earliest arrival and the
shingle that sent it.  An element stops as soon as its next arrival is later
than all registers (early termination).  Two registers agree with probability J_P.

Banding: 128 registers in 32 bands of 4; a pair at similarity 0.8 misses all
bands with probability 5e-8.  Texts with the same words are one node before
banding, so copies never meet as pairs; a node is named by a cryptographic hash
of its words themselves.

Verification: the exact J_P of the weighted sets (as 32-bit hashes with their
counts) must be 0.8 or more.  Buckets of up to 16 nodes are compared in
full.  In a larger bucket the node that sits in the most crowded buckets leads
and is compared with the others.  Where a large bucket then still holds more
than one component, the nodes outside its largest component are compared, in
blocks of bounded size, with that component and with each other: the low bytes
of the registers sift (a pair at 0.8 fails with probability 1e-6), the weighted
sets decide, and one link for each node and other component is returned.  So
no link between components of a bucket is lost, and no bucket emits its pairs.

Degenerate input: null, empty and wordless texts are classes of their own
(one for each row); a text of 1 to 4 words has one shingle of all its words;
rows that repeat share a class; rows are told apart by id and text, so ids may
be null or repeat; the class id is the least non-null id (null where there is
none), and class_key, of the class's words, names every class with words, also
those without an id; an empty table gives an empty result; other columns are
ignored, also those named like a column used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.llm.common import HashBitmap, build_bitmap, first_row, materialize, register, table
from divaug.llm.components import connected_components
from divaug.llm.vectext import keyed_words, mix64, shingles, slices

SHINGLE_WORDS = 5
SIMILARITY = 0.8
REGISTERS, BAND_ROWS = 128, 4
SMALL_BUCKET = 16
BLOCK_NODES, BLOCK_BYTES = 2048, 64 << 20
SIFT_SIGMAS = 4.75
FILTER_BITS = 25


def distinct_shingles(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, 48-bit shingle) and how often each occurs."""
    key, times = np.unique((row.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)), return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), times


def weight_of(times: np.ndarray, weights: str) -> np.ndarray:
    if weights not in ("log", "unit"):
        raise ValueError(f"weights are 'log' or 'unit', not {weights!r}")
    return 1.0 + np.log(times) if weights == "log" else np.ones(len(times))


def pack_set(h: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted 32-bit shingles, then the places and counts of those that repeat."""
    more = np.flatnonzero(times > 1)
    return np.concatenate([[len(h)], h, more, np.minimum(times[more], (1 << 32) - 1)]).astype(np.uint32).tobytes()


def unpack_set(data: bytes, weights: str) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(data, np.uint32)
    n = int(a[0])
    rest = a[n + 1:]
    times = np.ones(n)
    times[rest[:len(rest) // 2]] = rest[len(rest) // 2:]
    return a[1:n + 1], weight_of(times, weights)


def prob_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], least: float = 0.0) -> float:
    """J_P of two weighted sets: the sum over their common elements i of
    1 / sum_j max(x_j / x_i, y_j / y_i), by sorting the ratios x_j / y_j.  0 at
    once where the common share of either set shows that it is below ``least``."""
    (hx, wx), (hy, wy) = x, y
    if not len(hx) or not len(hy):
        return 0.0
    at = np.minimum(np.searchsorted(hy, hx), len(hy) - 1)
    both = hy[at] == hx
    a, b = wx[both], wy[at[both]]
    size_x, size_y = wx.sum(), wy.sum()
    if a.sum() < (least - 1e-9) * size_x or b.sum() < (least - 1e-9) * size_y or not len(a):
        return 0.0
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    ratio, a, b = ratio[order], a[order], b[order]
    below = np.searchsorted(ratio, ratio, "left")   # elements of a smaller ratio: y decides there
    sum_a, sum_b = np.concatenate(([0.0], np.cumsum(a))), np.concatenate(([0.0], np.cumsum(b)))
    x_part = size_x - sum_a[below]                  # with those that only x has
    y_part = size_y - sum_b[-1] + sum_b[below]      # with those that only y has
    return float((1.0 / (x_part / a + y_part / b)).sum())


def alike(x: bytes | tuple, y: bytes, least: float, weights: str) -> bool:
    x = unpack_set(x, weights) if isinstance(x, bytes) else x
    return prob_jaccard(x, unpack_set(y, weights), least) >= least - 1e-9


def prob_min_hash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """(rows, m) signatures; a row without elements keeps zeros."""
    earliest = np.full(rows * m, np.inf)
    sig = np.zeros(rows * m, np.uint64)
    t = np.zeros(len(h))
    last = np.full(rows, np.inf)
    k = 0
    while len(h):
        k += 1
        u = mix64(h + np.uint64((2 * k * 0x9E3779B97F4A7C15) % (1 << 64)))
        j = mix64(u ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - (m.bit_length() - 1))
        t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53) / weight
        at = row * m + j.astype(np.int64)
        better = t < earliest[at]
        np.minimum.at(earliest, at[better], t[better])
        won = t == earliest[at]
        sig[at[won]] = h[won]
        touched = np.unique(row)
        last[touched] = earliest.reshape(rows, m)[touched].max(1)
        go = t < last[row]
        row, h, weight, t = row[go], h[go], weight[go], t[go]
    return sig.reshape(rows, m)


def band_keys(sig: np.ndarray, rows_each: int) -> np.ndarray:
    parts = sig.reshape(sig.shape[0], sig.shape[1] // rows_each, rows_each)
    out = np.zeros(parts.shape[:2], np.uint64)
    for k in range(rows_each):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(k + 1))
    return out.view(np.int64)


def _signer(registers: int, band_rows: int, words_each: int, weights: str = "log"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, counts, keys = keyed_words(batch.column("text").to_pylist())
                h, at = shingles(words, counts, words_each)
                row, h, times = distinct_shingles(h, at)
                sig = prob_min_hash(row, h, weight_of(times, weights), len(counts), registers)
                some = np.flatnonzero(counts > 0)
                bands = band_keys(sig[some], band_rows)
                lists = np.empty(len(counts), object)
                for i, b in zip(some.tolist(), bands):
                    lists[i] = b
                low = sig.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rk"), batch.column("doc_id"), pa.array(keys, pa.binary()),
                     pa.array(lists, pa.list_(pa.int64())), pa.array([x.tobytes() for x in low], pa.binary())],
                    ["rk", "doc_id", "node", "bands", "low"])
    return run


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rk: a hash of id and text."""
    i, t = docs[id_col].cast("long"), docs[text_col].cast("string")
    return docs.select(F.xxhash64(i, t).alias("rk"), i.alias("doc_id"), t.alias("text"))


def _set_maker(wanted: HashBitmap, words_each: int):
    """Sorted 32-bit shingles with counts of the texts whose key may be wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rk = mix64(whole.column("rk").to_numpy().view(np.uint64))
            whole = whole.filter(pa.array(wanted.contains(rk)))
            for batch in slices(whole, "text"):
                words, counts, keys = keyed_words(batch.column("text").to_pylist())
                h, at = shingles(words, counts, words_each)
                key, times = np.unique((at.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)), return_counts=True)
                ends = np.searchsorted(key >> np.uint64(32), np.arange(len(counts)), "right")
                low = key & np.uint64(0xFFFFFFFF)
                sets = [pack_set(low[a:b], times[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())],
                                                 ["node", "shingles"])
    return run


def _mix64_long(batches):
    for b in batches:
        rk = mix64(b.column("rk").to_numpy().view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rk)], ["h"])


def _verifier(least: float, weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(x, y, least, weights) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    registers: int = REGISTERS, band_rows: int = BAND_ROWS, small: int = SMALL_BUCKET,
                    weights: str = "log") -> DataFrame:
    """One row for each row of ``docs``: rk (a hash of id and text), doc_id,
    node (key of its words), class_id, links (distinct other texts in its class
    that verification linked it to), class_key (least node of the class)."""
    spark = docs.sparkSession
    base = _row_key(docs, id_col, text_col)
    signed = materialize(base.mapInArrow(_signer(registers, band_rows, SHINGLE_WORDS, weights),
                                         "rk long, doc_id long, node binary, bands array<long>, low binary"))
    nodes = signed.filter("node is not null").groupBy("node").agg(
        F.min("rk").alias("rk"), F.min("doc_id").alias("doc_id"), F.min(F.struct("rk", "bands", "low")).alias("x"))
    members = nodes.select("node", "rk", F.posexplode("x.bands").alias("band", "val"))
    crowded = members.groupBy("band", "val").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(members.join(crowded, ["band", "val"]).select("band", "val", "n", "node", "rk"))

    left = members.filter(F.col("n") <= small).select("band", "val", F.col("node").alias("a"))
    pairs = (left.join(left.select("band", "val", F.col("a").alias("b")), ["band", "val"])
                 .filter(F.col("a") < F.col("b")).select("a", "b"))
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    big = materialize(members.filter(F.col("n") > small).join(score, "node").select("band", "val", "node", "score"))
    lead = (big.groupBy("band", "val").agg(F.max(F.struct("score", "node")).alias("m"))
               .select("band", "val", F.col("m.node").alias("leader")))
    pairs = pairs.unionAll(big.join(lead, ["band", "val"]).filter("node <> leader").select(
        F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))).distinct()

    keys = members.select("rk").distinct().mapInArrow(_mix64_long, "h long")
    wanted = build_bitmap(keys, "h", FILTER_BITS)
    sets = base.select("rk", "text").mapInArrow(_set_maker(wanted, SHINGLE_WORDS), "node binary, shingles binary")
    # repeated rows and rows let through by the filter fall away here
    real = members.select("node").distinct()
    sets = materialize(sets.join(real, "node").groupBy("node").agg(F.min("shingles").alias("shingles")))

    links = materialize(_verified(pairs, sets, similarity, weights))
    comps = connected_components(links)
    rest = _rest(big, comps)
    if first_row(rest.agg(F.count("*").alias("n")))["n"]:
        low = nodes.select("node", F.col("x.low").alias("low"))
        links = materialize(links.unionAll(_blocks(rest, sets, low, similarity, weights)).distinct())
        comps = connected_components(links)

    degree = (links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node")))
                   .groupBy("node").agg(F.count("*").alias("links")))
    labelled = nodes.select("node", "doc_id").join(comps, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    class_id = labelled.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    named = labelled.join(class_id, "component").join(degree, "node", "left").select(
        "node", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.col("component").alias("class_key"))
    alone = signed.filter("node is null").select(
        "rk", "doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"),
        F.lit(None).cast("binary").alias("class_key"))
    return (signed.filter("node is not null").select("rk", "doc_id", "node").join(named, "node")
                  .select("rk", "doc_id", "node", "class_id", "links", "class_key").unionByName(alone))


def _rest(big: DataFrame, comps: DataFrame) -> DataFrame:
    """(main, node, component): for each main component of a bucket that holds
    other components too, its nodes and the outside nodes that met it."""
    labelled = materialize(big.select("band", "val", "node").join(comps, "node", "left")
                           .withColumn("component", F.coalesce("component", "node")))
    sizes = labelled.groupBy("band", "val", "component").agg(F.count("*").alias("c"))
    main = (sizes.groupBy("band", "val").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("k"))
                 .filter("k > 1").select("band", "val", F.col("m.component").alias("main")))
    outside = (labelled.join(main, ["band", "val"]).filter("component <> main")
                       .select("main", "node", "component").distinct())
    inside = (labelled.select("node", "component").distinct()
                      .join(main.select(F.col("main").alias("component")).distinct(), "component")
                      .select(F.col("component").alias("main"), "node", "component"))
    return materialize(outside.unionByName(inside))


def _blocks(rest: DataFrame, sets: DataFrame, low: DataFrame, similarity: float, weights: str) -> DataFrame:
    """Links of the outside nodes, found in blocks of nodes."""
    rows = materialize(rest.join(sets, "node").join(low, "node"))
    out = F.col("component") != F.col("main")
    cut = lambda n, size: F.ceil(F.greatest(n / F.lit(float(BLOCK_NODES)), size / F.lit(float(BLOCK_BYTES)))).cast("int")
    bytes_ = F.length("shingles")
    shape = rows.groupBy("main").agg(
        cut(F.count("*"), F.sum(bytes_)).alias("blocks"),
        cut(F.sum(out.cast("int")), F.sum(F.when(out, bytes_).otherwise(0))).alias("chunks"))
    rows = rows.join(shape, "main").withColumn("h", F.xxhash64("node"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    against = rows.select("*", F.pmod("h", "blocks").cast("int").alias("block"), F.explode(upto(F.col("chunks"))).alias("chunk"),
                          F.lit(False).alias("asks"))
    asking = rows.filter(out).select("*", F.explode(upto(F.col("blocks"))).alias("block"),
                                     F.pmod("h", "chunks").cast("int").alias("chunk"), F.lit(True).alias("asks"))
    # one key column: rows dealt by `main` alone would satisfy a grouping by the three
    cols = [F.struct("main", "block", "chunk").alias("cell"), "asks", "node", "component", "low", "shingles"]
    return (against.select(*cols).unionByName(asking.select(*cols)).groupBy("cell")
                   .applyInArrow(_block_links(similarity, weights), "a binary, b binary"))


def _block_links(similarity: float, weights: str):
    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        x, y = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
        low = lambda t: np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        of_y, names = y.column("component").to_pylist(), y.column("node").to_pylist()
        ids = {c: i for i, c in enumerate(dict.fromkeys(of_y))}
        code = np.array([ids[c] for c in of_y], np.int64)
        theirs, sets = low(y), y.column("shingles").to_pylist()
        m = theirs.shape[1] if len(of_y) else 1
        least = m * similarity - SIFT_SIGMAS * (m * similarity * (1 - similarity)) ** 0.5
        found = []
        for node, comp, mine, words in zip(x.column("node").to_pylist(), x.column("component").to_pylist(),
                                           low(x), x.column("shingles").to_pylist()):
            same = (theirs == mine).sum(1)
            near = np.flatnonzero((same >= least) & (code != ids.get(comp, -1)))
            own, done = unpack_set(words, weights), set()
            for j in near[np.argsort(-same[near], kind="stable")].tolist():
                if code[j] not in done and alike(own, sets[j], similarity, weights):
                    done.add(code[j])
                    found.append((min(node, names[j]), max(node, names[j])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})
    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, weights: str) -> DataFrame:
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
                 .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
                 .mapInArrow(_verifier(similarity, weights), "a binary, b binary"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each class (least id; of rows with
    the same id and text one stays).  Rows without words all stay."""
    cols = docs.columns
    classes = near_duplicates(docs, id_col, text_col)
    first = (classes.filter("node is not null").groupBy("class_key")
                    .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("x"))
                    .select(F.col("x.rk").alias("__rk"), F.col("x.doc_id").alias("__kept")))
    i, t = docs[id_col].cast("long"), docs[text_col].cast("string")
    has_words = F.coalesce(docs[text_col].rlike(r"[\p{L}\p{N}]"), F.lit(False))
    rows = docs.withColumn("__id", i).withColumn("__rk", F.xxhash64(i, t))
    same = (F.col("r.__rk") == F.col("f.__rk")) & F.col("r.__id").eqNullSafe(F.col("f.__kept"))
    words = (rows.filter(has_words).alias("r").join(first.alias("f"), same, "left_semi")
                 .dropDuplicates(["__rk", "__id"]))
    return words.select(*cols).unionByName(rows.filter(~has_words).select(*cols))


@register("op9_probminhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its class id, its number of links and the
    key of its class, which also tells classes without an id apart."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links", F.hex("class_key").alias("class_key"))
