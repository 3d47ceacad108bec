"""Document fingerprints by bottom-k sketches (operator 8), with DataFrame
functions only.

The sketch of a text is the k least distinct 64-bit hashes of its five-word
shingles (lower-cased runs of letters and digits; a text of 1 to 4 words has
one shingle of all its words), with k = 128.  Sketches merge by uniting,
sorting and cutting to k, so parts of a text or of a corpus can be sketched
apart.  The k-th least hash estimates the number of distinct shingles, and the
k least of a union, with the share of them in both sketches, the resemblance;
containment follows from both.  Sets of up to k shingles are exact.

Degenerate input: null texts count as empty; an empty or wordless text has an
empty sketch, whose likeness is 1 to another empty one and 0 to any other;
equal texts have equal fingerprints; a null id comes first, rows of one id
follow each other by text; with one row, the next document is that row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from divaug.llm.common import first_row, materialize, register, table

K = 128
WORDS = 5
BUCKET_ROWS, FAN = 256, 128


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the shingles, with repeats."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # each word is hashed once; the inner transform sees the hashes as one value
    hashed = F.transform(F.array(F.transform(parts, lambda w: F.xxhash64(w))), lambda h: F.when(F.size(h) < words, F.array(F.xxhash64(h))).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(words)]))))
    return F.element_at(hashed, 1)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    """The sketch of a text: an ascending array of up to k hashes."""
    none = F.array().cast("array<bigint>")
    return F.when(F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False)), bottom_k(shingle_hashes(text), k)).otherwise(none)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def distinct_estimate(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity."""
    least = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that lies in the second."""
    r = resemblance(a, b, k)
    na, nb = distinct_estimate(a, k), distinct_estimate(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((r + 1) * na)))


def fingerprint(a: Column) -> Column:
    """The sketch as text: its hashes in hexadecimal, 16 digits each."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def sketch_groups(df: DataFrame, by: list[str], col: str, k: int = K, fan: int = 512) -> DataFrame:
    """One sketch for each group of sketches (null keys are a group): merged
    about ``fan`` at a time, so no group is gathered in a task, however large."""
    rows = df.select(*by, col).distinct()
    largest = first_row(rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")))["n"] or 1
    while True:
        salts = -(-largest // fan)
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(col), F.lit(salts)))
        rows = materialize(salted.groupBy(*by, "__salt").agg(bottom_k(F.flatten(F.collect_list(col)), k).alias(col)).drop("__salt"))
        if salts == 1:
            return rows
        largest = salts


def _bounds(df: DataFrame, col: str, n: int) -> list[list[int]]:
    """Two levels of bucket bounds over a bigint column, FAN each at most."""
    buckets = min(FAN * FAN, max(1, n // BUCKET_ROWS))
    if buckets < 2:
        return [[]]
    cuts = first_row(df.agg(F.percentile_approx(col, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("q")))["q"] or []
    cuts = sorted(set(cuts))
    return [cuts[i:i + FAN] for i in range(0, len(cuts), FAN)]


def _bucket(col: Column, bounds: list[list[int]]) -> Column:
    """The number of bounds at or below the value (-1: null), by two short
    searches over folded literals."""
    if not bounds[0]:
        return F.when(col.isNull(), -1).otherwise(0)
    nested = F.from_json(F.lit(str(bounds)), "array<array<bigint>>")
    heads = F.from_json(F.lit(str([b[0] for b in bounds])), "array<bigint>")
    top = F.size(F.filter(heads, lambda b: b <= col))
    inside = F.size(F.filter(F.element_at(nested, F.greatest(top, F.lit(1))), lambda b: b <= col))
    return F.when(col.isNull(), -1).when(top == 0, 0).otherwise((top - 1) * FAN + inside)


def with_next(docs: DataFrame, id_col: str, col: str, derived: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Adds the columns derived from ``col`` and next_<col>, next_<derived> of
    the following row by ascending id (after the last: the first).  Rows are
    dealt by ranges of ids into buckets; a bucket's last row gets the first row
    of the next bucket by a join on the bucket's number."""
    n = first_row(docs.agg(F.count("*").alias("n")))["n"]
    bucketed = docs.withColumn("__b", _bucket(F.col(id_col), _bounds(docs.select(id_col), id_col, n)))
    w = Window.partitionBy("__b").orderBy(F.col(id_col).asc_nulls_first(), col)
    carried = [col, *derived]
    rows = bucketed.withColumns({k: f(F.col(col)) for k, f in derived.items()})
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried], F.lead(F.lit(True)).over(w).alias("__has"))
    # the first row of each bucket, for the bucket before it
    first = bucketed.groupBy("__b").agg(F.min(F.struct(id_col, col)).alias("f")).select("__b", F.col(f"f.{col}").alias("f"))
    links = materialize(first.select("__b").withColumn("__n", F.coalesce(
        F.lead("__b").over(Window.orderBy("__b")), F.first("__b").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)))))
    first = links.join(first.withColumnRenamed("__b", "__n"), "__n").select("__b", "f", F.lit(True).alias("__last"))
    rows = rows.withColumn("__last", F.when(F.col("__has").isNull(), True))
    out = rows.join(first, ["__b", "__last"], "left")
    last = {col: F.col("f")} | {k: f(F.col("f")) for k, f in derived.items()}
    return out.select(*docs.columns, *derived, *[F.when(F.col("__last"), last[c]).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in carried])


@register("op8_bottom_k")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its edited text (the last half replaced by the start of
    the next document) and their likeness."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", "text", {"fp": sketch})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)))
    rows = rows.withColumn("efp", sketch(F.col("edited")))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint(F.col("fp")).alias("fingerprint"), fingerprint(F.col("efp")).alias("edited_fingerprint"),
                       resemblance(F.col("fp"), F.col("efp")).alias("near_edited"),
                       resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"))
