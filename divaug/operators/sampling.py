"""Seeded permutations, quota samples, nested samples, ranges and caps
(B1-B5, P5-P7).

A permutation is the order of ``md5('<seed>:' || id)`` (ties by id), numbered
exactly by ``rank_within`` (range-partitioned, never one task), so every
positional selection of the reference (``select(range(a, b))`` after a seeded
shuffle) becomes a filter on a position column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divaug.functions.hashing import seeded_key
from divaug.operators import kselect as KS
from divaug.operators.ranking import rank_within
from divaug.session import stored


def seeded_order(df: DataFrame, seed: int = 42, id_col: str = "sample_id", groups=(),
                 name: str = "pos", count_name: str | None = None) -> DataFrame:
    """B1: 1-based position of every row in the seeded permutation (per group)."""
    k = df.withColumn("_sk", seeded_key(seed, id_col))
    return rank_within(k, [F.col("_sk").asc(), F.col(id_col).asc()], groups, name=name,
                       count_name=count_name).drop("_sk")


def position_range(df: DataFrame, lo, hi, pos: str = "pos") -> DataFrame:
    """Rows with lo < pos <= hi (the reference's select(range(lo, hi)))."""
    return df.filter((F.col(pos) > F.lit(lo)) & (F.col(pos) <= F.lit(hi)))


def quota_sample(df: DataFrame, category: str, target: int, shares: dict, offset: int = 0,
                 seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """Per category the positions (offset, offset + int(target*share)]
    of one seeded permutation per category.  Ids are unique: only (id,
    category) is written, once, and only the rows up to a category's last
    position (``kselect``) are ranked; the other columns are joined to the
    drawn rows, as many as the call asks for."""
    wanted = df.filter(F.col(category).isin(list(shares)))   # other categories are never ranked
    ids = stored(wanted.select(id_col, category), "quota").withColumn("_sk", seeded_key(seed, id_col))
    order = ["_sk", id_col]
    ends = df.sparkSession.createDataFrame([(c, "end", offset + int(target * s)) for c, s in shares.items()], T.StructType([
        T.StructField(category, df.schema[category].dataType), T.StructField("tag", T.StringType()), T.StructField("k", T.LongType())]))
    last = KS.thresholds(ids, ends, category, [F.coalesce(KS.key_number("_sk"), F.lit(-1.0))], order)   # nulls are first
    first = KS.draw(ids, last, category, order).select(id_col, category)
    ordered = seeded_order(first, seed, id_col, groups=[category])
    quota = F.create_map(*[x for c, s in shares.items() for x in (F.lit(c), F.lit(int(target * s)))])
    q = F.coalesce(F.element_at(quota, F.col(category)), F.lit(0))
    drawn = stored(ordered.filter((F.col("pos") > offset) & (F.col("pos") <= offset + q)), "drawn")
    return wanted.join(drawn, [id_col, category]).select(*df.columns, "pos")


def nested_sample(df: DataFrame, sizes=(1200, 800), seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """Nested prefixes of one permutation; one flag column per size.  Ids
    are unique: only they are ranked."""
    o = seeded_order(df.select(id_col), seed, id_col)
    out = df.join(o.filter(F.col("pos") <= max(sizes)), id_col).select(*df.columns, "pos")
    for s in sizes:
        out = out.withColumn(f"in_{s}", F.col("pos") <= s)
    return out


def two_way_split(df: DataFrame, first: int | None, seed: int | str = 42, id_col: str = "sample_id",
                  name: str = "role", labels=("seed", "nonseed")) -> DataFrame:
    """First ``first`` rows of the permutation (None: half of them, rounded
    down) vs the rest.  Ids are unique: only they are ranked, the other columns
    meet their position by id."""
    o = seeded_order(df.select(id_col), seed, id_col, count_name="_n", name="_p")
    cut = F.floor(F.col("_n") / 2) if first is None else F.lit(first)
    role = F.when(F.col("_p") <= cut, F.lit(labels[0])).otherwise(F.lit(labels[1]))
    return df.join(o.select(id_col, role.alias(name)), id_col).select(*df.columns, name)


def head_by(df: DataFrame, n: int, order_cols, groups=(), name: str = "pos") -> DataFrame:
    """First ``n`` rows in a fixed order (per group), exact and
    distributed (not a bare ``limit``)."""
    r = rank_within(df, order_cols, groups, name=name)
    return r.filter(F.col(name) <= n)
