"""Vector and probability expressions over ARRAY<DOUBLE> columns.

Everything is a JVM higher-order-function expression: no Python on the row
path.  Indexes are 0-based unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference's numerics.
L2_EPS = 1e-6        # pairwise_distance adds eps inside the norm
COS_EPS = 1e-8       # each norm clamped from below
ENTROPY_EPS = 1e-10  # -sum p * ln(p + eps)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, k: int) -> Column:
    """Round to ``k`` places on the binary value: round(x * 10^k) / 10^k.

    Spark's ``round`` on a double rounds its shortest decimal string, so at a
    decimal tie (0.12115 stored as 0.121149999...) it rounds up where the
    float arithmetic of numpy/pandas (and DuckDB) rounds down.  Rounding the
    scaled double to an integer is identical in both."""
    m = float(10 ** k)
    return F.round(_c(x) * F.lit(m), 0) / F.lit(m)


def as_double_array(x) -> Column:
    return _c(x).cast("array<double>")


def vsum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_distance(a, b, eps: float = L2_EPS) -> Column:
    """||a - b + eps||_2 (eps added to every coordinate)."""
    d = F.zip_with(_c(a), _c(b), lambda x, y: x - y + F.lit(eps))
    return F.sqrt(dot(d, d))


def cosine_similarity(a, b, eps: float = COS_EPS) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def scale(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def log_softmax(z) -> Column:
    z = _c(z)
    m = F.array_max(z)
    lse = m + F.log(vsum(F.transform(z, lambda x: F.exp(x - m))))
    return F.transform(z, lambda x: x - lse)


def with_log_softmax(df, z: str, out: str):
    """DataFrame form of log_softmax that evaluates the max and the
    log-sum-exp once per row (as columns) instead of once per element."""
    m = F.array_max(F.col(z))
    df = df.withColumn("_lsm_m", m)
    df = df.withColumn("_lsm_lse", F.col("_lsm_m") + F.log(vsum(F.transform(F.col(z), lambda x: F.exp(x - F.col("_lsm_m"))))))
    return df.withColumn(out, F.transform(F.col(z), lambda x: x - F.col("_lsm_lse"))).drop("_lsm_m", "_lsm_lse")


def softmax(z) -> Column:
    z = _c(z)
    m = F.array_max(z)
    den = vsum(F.transform(z, lambda x: F.exp(x - m)))
    return F.transform(z, lambda x: F.exp(x - m) / den)


def exp_array(a) -> Column:
    return F.transform(_c(a), lambda x: F.exp(x))


def entropy(p, eps: float = ENTROPY_EPS) -> Column:
    return -vsum(F.transform(_c(p), lambda x: x * F.log(x + F.lit(eps))))


def argmax(a) -> Column:
    """0-based index of the first maximum."""
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def at(a, i) -> Column:
    """Element at 0-based index ``i`` (NULL when out of range)."""
    i = _c(i) if not isinstance(i, int) else F.lit(i)
    return F.try_element_at(_c(a), i + 1)


def margin(p, label) -> Column:
    """p[label] - max over the other classes; the label slot counts as 0."""
    p, label = _c(p), _c(label)
    others = F.transform(p, lambda x, i: F.when(i == label, F.lit(0.0)).otherwise(x))
    return at(p, label) - F.array_max(others)


def error_l2(p, label) -> Column:
    """sqrt(sum_i (onehot(label)_i - p_i)^2)."""
    p, label = _c(p), _c(label)
    sq = F.transform(p, lambda x, i: F.pow(F.when(i == label, F.lit(1.0)).otherwise(F.lit(0.0)) - x, 2))
    return F.sqrt(vsum(sq))


def sq_distance(a, b):
    """Squared L2 distance, no epsilon."""
    return vsum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
