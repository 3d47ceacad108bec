"""Readers and writers.

Paths are always shared storage: callers pass them, or ``session.shared_path``
places them below ``spark.checkpoint.dir``.  JSON Lines replaces the
reference's single indented JSON array (which cannot be written in
parallel).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED_SCHEMA = T.StructType([
    T.StructField("sample_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType())])


def write_jsonl(df: DataFrame, path: str, partition_by: str | None = "split", mode: str = "overwrite") -> None:
    """One JSON object per row, one folder per split."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def _missing(spark: SparkSession, paths: list[str]) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    return [p for p in paths if not path(p).getFileSystem(conf).exists(path(p))]


def split_lines(spark: SparkSession, base: str, files: dict[str, str]) -> DataFrame:
    """Every line that is not blank of the named files {split: relative path}:
    split, file, line, in one scan.  Files that are not there fail by name."""
    root = base.rstrip("/")
    paths = [f"{root}/{f}" for f in files.values()]
    if gone := _missing(spark, paths):
        raise FileNotFoundError("no such split file: " + ", ".join(sorted(gone)))
    bare = re.sub(r"^file:", "", root)
    # the first path component below ``base`` names the file (or the folder
    # of part files) the row came from: an equi-join key
    file = F.col("_metadata.file_path")
    rel = F.regexp_extract(file, "^.*?" + re.escape(bare) + "/([^/]+)", 1)
    lines = spark.read.text(paths).select(F.col("value").alias("line"), file.alias("file"), rel.alias("_file")).filter(F.trim("line") != "")
    names = spark.createDataFrame([(s, f.split("/", 1)[0]) for s, f in files.items()], "split string, _file string")
    return lines.join(F.broadcast(names), "_file").select("split", "file", "line")


def parse_lines(lines: DataFrame, schema: T.StructType = LABELLED_SCHEMA) -> DataFrame:
    """Adds ``row`` (null: rejected) to the lines.  A line must be one JSON
    object whose fields have the types of ``schema``; fields may be absent or
    null, others are ignored."""
    bad = "_corrupt_record"
    with_bad = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    parsed = F.from_json("line", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    fits = F.trim("line").startswith("{") & parsed[bad].isNull()
    return lines.withColumn("row", F.when(fits, F.struct(*[parsed[f.name].alias(f.name) for f in schema.fields])))


def read_splits_checked(spark: SparkSession, base: str, files: dict[str, str],
                        schema: T.StructType = LABELLED_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(rows with their split, rejected lines as split, file, line): every
    line that is not blank is in one of the two."""
    parsed = parse_lines(split_lines(spark, base, files), schema)
    good = parsed.filter("row IS NOT NULL").select("row.*", "split")
    return good, parsed.filter("row IS NULL").select("split", "file", "line")


def read_splits(spark: SparkSession, base: str, files: dict[str, str],
                schema: T.StructType = LABELLED_SCHEMA, rejects_path: str | None = None) -> DataFrame:
    """The rows of named files.  Malformed lines go to a table of rejects
    at ``rejects_path``; where none is named they fail the read."""
    good, rejects = read_splits_checked(spark, base, files, schema)
    if rejects_path:
        rejects.write.mode("overwrite").parquet(rejects_path)
        return good
    parsed = parse_lines(split_lines(spark, base, files), schema)
    stop = F.raise_error(F.concat(F.lit("malformed line in "), "file", F.lit(": "), F.substring("line", 1, 200)))
    row = F.when(F.col("row").isNull(), stop.cast(good.drop("split").schema)).otherwise(F.col("row"))
    return parsed.select(row.alias("row"), "split").select("row.*", "split")


def read_jsonl_partitioned(spark: SparkSession, path: str, schema: T.StructType = LABELLED_SCHEMA) -> DataFrame:
    """Read a ``write_jsonl`` folder back; ``split`` comes from the folder
    names (partition pruning on ``split`` filters)."""
    s = T.StructType(schema.fields + [T.StructField("split", T.StringType())])
    return spark.read.schema(s).json(path)


def upsert_cells(old: DataFrame, new: DataFrame, keys=("metric", "row_key", "split")) -> DataFrame:
    """Results upsert: new cells win; untouched old cells are kept."""
    keep = old.join(new.select(*keys), list(keys), "left_anti")
    return new.unionByName(keep)
