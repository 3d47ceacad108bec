"""Quality classifier by hierarchical empirical Bayes (operator 5).

Document evidence: a naive Bayes log odds over binned shares of the whole text
(upper-case letters, symbols, distinct words), with bin counts over all
labelled rows.  Site evidence: the document classifier's good probabilities are
summed by host (source) and by host and path (source and language), for all
documents, by grouped aggregation.  A host's rate shrinks toward the global
rate and a path's rate toward its host's, each with a strength found from the
variance between sites (method of moments), so sparse sites stay near their
parent.  A document's posterior combines its path's rate, as prior, with its
own evidence; documents below one half are rejected.

A document that the sites were summed over is taken out of its own host's and
path's sums before they become its prior, so its evidence enters once, and a
site of one document has its parent's rate.  A path that was not seen has its
host's rate, a host that was not seen the global one.

Texts are read twice: once to fit, which keeps ids, sites and bins, and once to
judge.

Degenerate input: null texts count as empty; null hosts and paths are sites of
their own; labels that are null or of unknown documents do not count, and
without labels every document gets the posterior of one half and stays; rows
that repeat count each time; an empty table gives an empty result; other
columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.llm.common import first_row, materialize, register, table

# Upper bounds of the bins of each share.
BINS = {"up": [0.005, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7],
        "sy": [0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2],
        "un": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]}
SYMBOLS = r"[!|$%&*#@^~=<>{}\[\]\\_+]"
BLANKS = r"[ \t\n\r]+"
THRESHOLD = 0.5
EDGE = 1e-4          # site rates stay this far from 0 and 1
LEAST, MOST = 1.0, 1e6   # bounds of the strength of shrinkage


def shares(text: Column) -> dict[str, Column]:
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(t)
    without = lambda p: n - F.length(F.regexp_replace(t, p, ""))
    words = F.split(t, BLANKS)
    return {"up": without(r"\p{Lu}") / (without(r"\p{L}") + F.lit(1.0)), "sy": without(SYMBOLS) / (n + F.lit(1.0)),
            "un": F.size(F.array_distinct(words)) / F.size(words).cast("double")}


def binned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds __up, __sy, __un: the number of bounds at or below the share."""
    s = shares(docs[text_col])
    return docs.withColumns({f"__{k}": sum((s[k] >= F.lit(b)).cast("int") for b in BINS[k]) for k in BINS})


class SiteBayes:
    """Fitted model: log odds for each bin (of fixed size), tables of the sums
    and rates of hosts and of (host, path), the global rate and the strengths of
    shrinkage toward it and toward a host."""

    def __init__(self, odds: dict[str, list[float]], base: float):
        self.odds, self.base = odds, base
        self.rate, self.to_rate, self.to_host = base, LEAST, LEAST
        self.sites: DataFrame | None = None
        self.hosts: DataFrame | None = None

    def evidence(self) -> Column:
        return sum(F.element_at(F.array(*[F.lit(x) for x in self.odds[k]]), F.col(f"__{k}") + 1) for k in BINS)

    def own(self, evidence: Column) -> Column:
        """The document classifier's probability of being good."""
        return _sigmoid(F.lit(_odds(self.base)) + evidence)

    def prior(self, less: Column, rows: Column) -> Column:
        """Rate of a path from its sums (a, n) and its host's (host_a, host_n),
        without ``rows`` documents of probability ``less``; null sums: unseen."""
        without = lambda a, n: (F.when(F.col(n).isNull(), 0.0).otherwise(F.col(a) - less),
                                F.when(F.col(n).isNull(), 0.0).otherwise(F.col(n) - rows))
        host_a, host_n = without("host_a", "host_n")
        a, n = without("a", "n")
        host = (host_a + self.to_rate * self.rate) / (host_n + self.to_rate)
        shrunk = (a + self.to_host * host) / (n + self.to_host)
        return F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), shrunk))


def _odds(x: float) -> float:
    return math.log(x / (1 - x))


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _strength(rates: DataFrame, parent: Column, rate: float) -> float:
    """Strength of shrinkage from the variance of rates (n, a) about a parent."""
    r = first_row(rates.agg(F.sum("n").alias("n"), F.count("*").alias("k"),
                            F.sum(F.col("n") * F.pow(F.col("a") / F.col("n") - parent, F.lit(2.0))).alias("s")))
    if not r["n"]:
        return LEAST
    spread = rate * (1 - rate)
    between = max(r["s"] / r["n"] - spread * r["k"] / r["n"], 1e-6)
    return min(MOST, max(LEAST, spread / between - 1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        host_col: str = "source", path_col: str = "lang") -> SiteBayes:
    # all that the fit needs of a text, so that texts are read once here
    rows = materialize(binned(docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"), docs[host_col].alias("host"), docs[path_col].alias("path")), "__text")
                       .drop("__text"))
    marks = labels.select(labels[id_col].alias("__id"), (labels[label_col].cast("int") > 0).cast("int").alias("__y")).dropna()
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__{k}").alias("b")) for k in BINS])).alias("c")
    counts = (rows.select("__id", *[f"__{k}" for k in BINS]).join(marks, "__id")
                  .select("__y", cells).groupBy("c.k", "c.b", "__y").agg(F.count("*").alias("n")).collect())  # one row for each bin and label
    n = {(r["k"], r["b"], r["__y"]): r["n"] for r in counts}
    total = {y: sum(v for (k, _, z), v in n.items() if k == "up" and z == y) for y in (0, 1)}
    odds = {k: [0.0 if not sum(total.values()) else
                math.log((n.get((k, b, 1), 0) + 0.5) / (total[1] + 0.5 * (len(BINS[k]) + 1)))
                - math.log((n.get((k, b, 0), 0) + 0.5) / (total[0] + 0.5 * (len(BINS[k]) + 1)))
                for b in range(len(BINS[k]) + 1)] for k in BINS}
    base = (total[1] + 1) / (sum(total.values()) + 2)
    model = SiteBayes(odds, base)
    # rows of a site with the same bins have the same evidence: counts first
    cells = rows.groupBy("host", "path", *[f"__{k}" for k in BINS]).agg(F.count("*").alias("n"))
    paths = materialize(cells.select("host", "path", "n", (F.col("n") * model.own(model.evidence())).alias("a"))
                        .groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("a").alias("a")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    whole = first_row(hosts.agg(F.sum("n").alias("n"), F.sum("a").alias("a")))
    model.rate = whole["a"] / whole["n"] if whole["n"] else base
    model.to_rate = _strength(hosts, F.lit(model.rate), model.rate)
    model.hosts = materialize(hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("a").alias("host_a")))
    paths = paths.join(model.hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    rate = (F.col("host_a") + model.to_rate * model.rate) / (F.col("host_n") + model.to_rate)
    model.to_host = _strength(paths, rate, model.rate)
    model.sites = materialize(paths.withColumn("site_rate", model.prior(F.lit(0.0), F.lit(0))))
    return model


def judge(docs: DataFrame, model: SiteBayes, text_col: str = "text", host_col: str = "source", path_col: str = "lang",
          fitted: bool = True) -> DataFrame:
    """``docs`` with evidence, site_rate and posterior (of being good).
    ``fitted``: these are the documents that the model was fitted on."""
    cols = [c for c in docs.columns if c not in ("evidence", "site_rate", "posterior")]
    plain = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(cols)], docs[text_col].alias("__text"),
                        docs[host_col].alias("__host"), docs[path_col].alias("__path"))
    rows = binned(plain, "__text").withColumn("__e", model.evidence()).drop("__text")
    sites = model.sites.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "n", "a")
    hosts = model.hosts.select(F.col("h").alias("__g"), "host_n", "host_a")
    rows = rows.join(sites, F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__p")), "left")
    rows = rows.join(hosts, F.col("__host").eqNullSafe(F.col("__g")), "left")
    r = model.prior(model.own(F.col("__e")), F.lit(1)) if fitted else model.prior(F.lit(0.0), F.lit(0))
    rows = rows.withColumn("__r", r)
    posterior = _sigmoid(F.log(F.col("__r") / (F.lit(1.0) - F.col("__r"))) + F.col("__e"))
    return rows.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(cols)], F.col("__e").alias("evidence"),
                       F.col("__r").alias("site_rate"), posterior.alias("posterior"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows; all columns stay."""
    return judge(docs, fit(docs, labels)).filter(F.col("posterior") >= THRESHOLD).select(*docs.columns)


def _bin_sql(value: str, k: str) -> str:
    return "(" + " + ".join(f"CAST(({value}) >= {b} AS INT)" for b in BINS[k]) + ")"


def _without(pattern: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"


ORACLE = rf"""
WITH t AS (SELECT *, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, lang, t, regexp_split_to_array(t, '[ \t\n\r]+') AS words FROM t),
x AS (SELECT doc_id, source, lang, {_bin_sql(_without(chr(92) + 'p{Lu}') + ' / (' + _without(chr(92) + 'p{L}') + ' + 1.0::DOUBLE)', 'up')} AS up,
  {_bin_sql(_without(SYMBOLS) + ' / (length(t) + 1.0::DOUBLE)', 'sy')} AS sy,
  {_bin_sql('len(list_distinct(words)) / len(words)::DOUBLE', 'un')} AS un FROM w),
cells AS (SELECT (quality > 0)::INT AS y, unnest([('up', up), ('sy', sy), ('un', un)]) AS c
  FROM x JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
n AS (SELECT c[1] AS k, c[2] AS b, y, count(*)::DOUBLE AS n FROM cells GROUP BY ALL),
total AS (SELECT coalesce(sum(n) FILTER (y = 1), 0) AS n1, coalesce(sum(n) FILTER (y = 0), 0) AS n0 FROM n WHERE k = 'up'),
size(k, m) AS (VALUES {', '.join(f"('{k}', {len(v) + 1})" for k, v in BINS.items())}),
grid AS (SELECT k, m, unnest(generate_series(0, m - 1)) AS b FROM size),
odds AS (SELECT g.k, g.b, CASE WHEN n1 + n0 = 0 THEN 0 ELSE
    ln((coalesce(max(n) FILTER (y = 1), 0) + 0.5) / (any_value(n1) + 0.5 * any_value(m)))
    - ln((coalesce(max(n) FILTER (y = 0), 0) + 0.5) / (any_value(n0) + 0.5 * any_value(m))) END AS o
  FROM grid g CROSS JOIN total LEFT JOIN n ON n.k = g.k AND n.b = g.b GROUP BY g.k, g.b, n1, n0),
e AS (SELECT doc_id, source, lang, a.o + s.o + u.o AS ev FROM x JOIN odds a ON a.k = 'up' AND a.b = up
  JOIN odds s ON s.k = 'sy' AND s.b = sy JOIN odds u ON u.k = 'un' AND u.b = un),
base AS (SELECT (n1 + 1) / (n1 + n0 + 2) AS b FROM total),
paths AS (SELECT source, lang, count(*)::DOUBLE AS n, sum(1 / (1 + exp(-(ln(b / (1 - b)) + ev)))) AS a FROM e, base GROUP BY source, lang),
hosts AS (SELECT source, sum(n) AS n, sum(a) AS a FROM paths GROUP BY source),
whole AS (SELECT sum(a) / sum(n) AS r, sum(n) AS n FROM hosts),
k1 AS (SELECT least({MOST}, greatest({LEAST}, any_value(r) * (1 - any_value(r))
    / greatest(sum(h.n * pow(h.a / h.n - r, 2)) / any_value(w.n) - any_value(r) * (1 - any_value(r)) * count(*) / any_value(w.n), 1e-6) - 1)) AS k
  FROM hosts h, whole w),
host_rate AS (SELECT source, h.a AS ha, h.n AS hn, (a + k * r) / (h.n + k) AS hr FROM hosts h, whole w, k1),
p2 AS (SELECT p.*, ha, hn, hr FROM paths p JOIN host_rate h ON p.source IS NOT DISTINCT FROM h.source),
k2 AS (SELECT least({MOST}, greatest({LEAST}, any_value(r) * (1 - any_value(r))
    / greatest(sum(p.n * pow(p.a / p.n - hr, 2)) / any_value(w.n) - any_value(r) * (1 - any_value(r)) * count(*) / any_value(w.n), 1e-6) - 1)) AS k
  FROM p2 p, whole w),
own AS (SELECT e.*, 1 / (1 + exp(-(ln(b / (1 - b)) + ev))) AS q FROM e, base),
site AS (SELECT doc_id, ev, greatest({EDGE}, least(1 - {EDGE},
    (p.a - q + k2.k * ((ha - q + k1.k * r) / (hn - 1 + k1.k))) / (p.n - 1 + k2.k))) AS sr
  FROM own o JOIN p2 p ON o.source IS NOT DISTINCT FROM p.source AND o.lang IS NOT DISTINCT FROM p.lang CROSS JOIN k1 CROSS JOIN k2 CROSS JOIN whole),
post AS (SELECT doc_id, ev, sr, 1 / (1 + exp(-(ln(sr / (1 - sr)) + ev))) AS p FROM site)
SELECT doc_id, round(ev, 6) AS evidence, round(sr, 6) AS site_rate, round(p, 6) AS posterior, (p >= {THRESHOLD})::INT AS kept FROM post
"""


@register("op5_site_bayes", ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = judge(docs.select("doc_id", "text", "source", "lang"), fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("evidence", "site_rate", "posterior")],
                      (F.col("posterior") >= THRESHOLD).cast("int").alias("kept"))
