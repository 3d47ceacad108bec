"""Exact duplicates by an exchange of Golomb-coded fingerprints (operator 13).

1. The rows get a home: every input partition writes its rows, with the SHA-256
   of the text and a row number, into one bucket of a table in the shared
   folder.  No row is shuffled; later steps know each row by that number.
2. Every partition cuts the hashes to about log2(rows) + 10 bits, sorts the
   distinct ones and sends each owner (a range of fingerprints) its part as a
   Golomb-Rice code of the gaps: for partitions of a share s of the rows that
   is 11.5 + log2(1 / s) bits a fingerprint.  Copies within a partition are one
   fingerprint, so a text that holds a third of all rows costs one code a
   partition.
3. An owner decodes its lists, finds the fingerprints that came from two
   partitions or more, and answers each list with a bitmap.
4. Every partition turns the answers into a bitmap of its rows in their order
   (a fingerprint that repeats at home counts, too).  Joined by partition with
   the bucketed table, where it moves no text, it marks the suspects: all
   copies, and about one other row in a thousand.
5. Only suspects are shuffled, summed by text before the shuffle, and their
   bytes compared: rows that share a fingerprint but not the text fall apart.

Of equal texts the row with the largest id stays.  Degenerate input: a null
text is an empty one; null ids come after all others, and where all ids of a
group are null one of its rows stays (keep_id null); of repeated rows with the
same id and text one stays; texts of any length are compared whole; an empty
table gives an empty result; other columns are ignored, also those named like
a column used here.
"""

from __future__ import annotations

import contextlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.llm.common import materialize, register, shared_folder, table

SPARE_BITS = 10          # one unequal row in 2 ** SPARE_BITS is a suspect
OWNER_ROWS = 1 << 20     # fingerprints of an owner at most, about
ROW_BITS = 33            # of monotonically_increasing_id: the row within its partition
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes]:
    """Sorted distinct ``values`` of [0, span) as the remainder's width k and
    the code of their gaps: all quotients in unary, then all remainders."""
    if not len(values):
        return 0, b""
    k = max(0, int(math.log2(max(1.0, span / len(values) * math.log(2)))))
    gap = np.diff(values, prepend=-1) - 1
    ends = np.cumsum((gap >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = (gap[:, None] >> np.arange(k - 1, -1, -1)) & 1
    return k, np.packbits(np.concatenate([unary, rest.ravel().astype(np.uint8)])).tobytes()


def golomb_decode(code: bytes, n: int, k: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n]
    at = int(ends[-1]) + 1
    rest = bits[at:at + n * k].reshape(n, k).astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum((((np.diff(ends, prepend=-1) - 1) << k) | rest) + 1) - 1


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _at_home(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The bucketed table (part, rid, doc_id, text, sha): a partition's rows
    go into one bucket in the order they have, so no sort is needed."""
    spark = docs.sparkSession
    rid = F.monotonically_increasing_id()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.spark_partition_id().alias("part"), rid.alias("rid"), "doc_id", "text", F.unhex(F.sha2("text", 256)).alias("sha"))
    name = f"exact_dedup_{uuid.uuid4().hex}"
    with _setting(spark, WRITERS, "16"):
        (rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
             .option("path", shared_folder(spark)).format("parquet").saveAsTable(name))
    return spark.table(name)


def _prints(home: DataFrame, bits: int) -> DataFrame:
    """(part, at, fp): at is the row's place in its partition."""
    return home.select("part", F.col("rid").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("at"),
                       F.expr(f"shiftrightunsigned(cast(conv(hex(substr(sha, 1, 8)), 16, -10) AS bigint), {64 - bits})").alias("fp"))


def _sender(bits: int, owner_bits: int):
    shift = bits - owner_bits

    def run(group: pa.Table) -> pa.Table:
        fp = np.unique(group.column("fp").to_numpy())
        cuts = np.searchsorted(fp, np.arange(1 << owner_bits, dtype=np.int64) << shift)
        rows = []
        for owner, (a, b) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(fp)])):
            if b > a:
                rows.append((owner, b - a, *golomb_encode(fp[a:b] - (owner << shift), 1 << shift)))
        owner, n, k, code = zip(*rows)
        return pa.table({"owner": pa.array(owner, pa.int32()), "part": pa.array([group.column("part")[0].as_py()] * len(rows), pa.int32()),
                         "n": pa.array(n, pa.int32()), "k": pa.array(k, pa.int32()), "code": pa.array(code, pa.binary())})
    return run


def answer(group: pa.Table) -> pa.Table:
    """For each list of an owner the bitmap of its fingerprints that another
    list has, too."""
    n = group.column("n").to_numpy()
    values = np.concatenate([golomb_decode(c, m, k) for c, m, k in
                             zip(group.column("code").to_pylist(), n.tolist(), group.column("k").to_pylist())])
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    twice = np.zeros(len(values), np.bool_)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    maps = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum(n)[:-1])]
    return pa.table({"part": group.column("part"), "owner": group.column("owner"), "n": group.column("n"), "bits": pa.array(maps, pa.binary())})


def mark(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """The suspects of a partition as 64-bit words, by the rows' places."""
    fp, at = rows.column("fp").to_numpy(), rows.column("at").to_numpy()
    _, back, times = np.unique(fp, return_inverse=True, return_counts=True)
    answers = answers.sort_by("owner")
    elsewhere = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in
                                zip(answers.column("bits").to_pylist(), answers.column("n").to_pylist())])
    bits = np.zeros(-(-(int(at.max()) + 1) // 64) * 64, np.uint8)
    bits[at] = ((times > 1) | (elsewhere > 0))[back]
    words = np.packbits(bits, bitorder="little").view(np.int64)
    return pa.table({"part": rows.column("part").slice(0, 1), "words": pa.array([words], pa.list_(pa.int64()))})


def suspects(home: DataFrame, rows: int) -> DataFrame:
    """(part, words): the bitmap of each partition's suspects."""
    parts = int(home.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(62, max(16, math.ceil(math.log2(max(2, rows))) + SPARE_BITS))
    owner_bits = min(bits, math.ceil(math.log2(max(parts, rows / OWNER_ROWS))))
    prints = _prints(home, bits)
    sent = prints.groupBy("part").applyInArrow(_sender(bits, owner_bits), "owner int, part int, n int, k int, code binary")
    answers = sent.groupBy("owner").applyInArrow(answer, "part int, owner int, n int, bits binary")
    return prints.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(mark, "part int, words array<bigint>")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    home = _at_home(docs, id_col, text_col)
    words = materialize(suspects(home, home.count()))
    at = f"rid & {(1 << ROW_BITS) - 1}"
    marked = home.join(words.hint("shuffle_hash"), "part").withColumn(
        "suspect", F.expr(f"shiftrightunsigned(get(words, cast(({at}) div 64 AS int)), cast(({at}) % 64 AS int)) & 1 = 1"))
    doubt = marked.filter("suspect")
    # largest id; its row's number tells repeated rows apart
    groups = (doubt.groupBy("sha", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"),
                                               F.coalesce(F.max_by("rid", "doc_id"), F.max("rid")).alias("keep_rid"))
                   .select("sha", "keep_id", "group_size", "keep_rid"))
    named = materialize(groups)
    out = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")]
    compared = doubt.select("sha", "rid", "doc_id").join(named, "sha").withColumn("kept", F.col("rid") == F.col("keep_rid"))
    alone = marked.filter(~F.col("suspect")).select("sha", "doc_id", F.col("doc_id").alias("keep_id"),
                                                    F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return compared.select(*out).unionByName(alone.select(*out))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""


@register("op13_golomb_dedup", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
