"""DuckDB twins of the fixture views and shared steps, as CTE snippets.

The oracle SQL for every registered query is assembled from these pieces, so a
fixture is defined once per engine: here for DuckDB, in
``divaug.sources.fixtures`` for Spark.
"""

from __future__ import annotations

from fractions import Fraction


def h24(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 6)) AS BIGINT)"


def dbl(x) -> str:
    """A double literal equal to Python's float(x) (no DECIMAL arithmetic)."""
    if isinstance(x, Fraction):
        return f"(CAST({x.numerator} AS DOUBLE) / {x.denominator})"
    return f"CAST({float(x)!r} AS DOUBLE)"


def seeded_key(seed, id_col="sample_id") -> str:
    return f"md5('{seed}:' || CAST({id_col} AS VARCHAR))"


def with_(ctes: list[str], body: str) -> str:
    seen, out = set(), []
    for c in ctes:
        if c not in seen:
            seen.add(c)
            out.append(c)
    if not out:
        return body
    return "WITH RECURSIVE\n" + ",\n".join(out) + "\n" + body


FX_VEC = """fx_vec AS (
  SELECT vec_id AS sample_id, label, CAST(embedding AS DOUBLE[]) AS vec,
         (['reduced_800', 'variance_top_2_3', 'dpo_d'])[CAST(vec_id % 3 AS INTEGER) + 1] AS split
  FROM embeddings)"""

FX_CENT_ALL = """fx_cent AS (
  SELECT k, list(v ORDER BY d) AS center FROM (
    SELECT label AS k, d, avg(vec[d]) AS v
    FROM (SELECT label, vec, unnest(generate_series(1, len(vec))) AS d FROM fx_vec)
    GROUP BY label, d) GROUP BY k)"""

FX_DYN = """fx_dyn_z AS (
  SELECT v.sample_id, v.label, e.epoch, c.k,
         (e.epoch + 1) * 8.0 * list_dot_product(v.vec, c.center)
         + 2.0 * """ + h24("concat_ws(':', v.sample_id, e.epoch, c.k)") + """ / 16777216.0 AS z
  FROM fx_vec v CROSS JOIN range(0, 3) e(epoch) CROSS JOIN fx_cent c),
fx_dyn_zl AS (
  SELECT sample_id, label, epoch, list(z ORDER BY k) AS zl FROM fx_dyn_z GROUP BY sample_id, label, epoch),
fx_dyn AS (
  SELECT sample_id, CAST(epoch AS INTEGER) AS epoch, CAST(sample_id // 32 AS INTEGER) AS iteration, label,
         list_transform(zl, lambda x: x - (list_max(zl) + ln(list_sum(list_transform(zl, lambda y: exp(y - list_max(zl))))))) AS logp
  FROM fx_dyn_zl)"""

FX_DYN_TRUNC = """fx_dyn_trunc AS (
  SELECT * FROM fx_dyn
  WHERE NOT (epoch = 2 AND iteration = (SELECT max(iteration) FROM fx_dyn)))"""


def rec_stats(src: str, name: str) -> str:
    return f"""{name}_p AS (
  SELECT sample_id, epoch, iteration, label, logp, list_transform(logp, lambda x: exp(x)) AS p FROM {src}),
{name} AS (
  SELECT *, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred,
         CAST((list_position(p, list_max(p)) - 1) = label AS INTEGER) AS ok,
         p[label + 1] AS p_label,
         p[label + 1] - list_max(list_transform(p, lambda x, i: CASE WHEN i - 1 = label THEN 0.0 ELSE x END)) AS margin,
         sqrt(list_sum(list_transform(p, lambda x, i: pow((CASE WHEN i - 1 = label THEN 1.0 ELSE 0.0 END) - x, 2)))) AS err
  FROM {name}_p)"""


def score_table(src: str = "fx_dyn", name: str = "scores", pad_to: str | None = None) -> list[str]:
    """CTE list ending in ``name``: the Q7 score table over log ``src``."""
    rs = rec_stats(src, f"{name}_rec")
    if pad_to is None:
        var = "std"
    else:
        var = (f"CASE WHEN n_records >= {pad_to} THEN std ELSE sqrt(greatest("
               f"(q + ({pad_to} - n_records)) / {pad_to} - ((s + ({pad_to} - n_records)) / {pad_to}) * ((s + ({pad_to} - n_records)) / {pad_to}), 0.0)) END")
    agg = f"""{name}_f AS (
  SELECT *, CAST((lag(ok, 1, 0) OVER (PARTITION BY sample_id ORDER BY epoch, iteration) = 1 AND ok = 0) AS INTEGER) AS fgt
  FROM {name}_rec),
{name}_a AS (
  SELECT sample_id, max(label) AS label, count(*) AS n_records,
         CAST(sum(ok) AS BIGINT) AS correctness,
         arg_max(ok, epoch * 1000000 + iteration) AS last_correctness,
         CAST(sum(fgt) AS BIGINT) AS forgetting,
         sum(margin) AS accumulated_margin,
         stddev_pop(p_label) AS std, sum(p_label) AS s, sum(p_label * p_label) AS q,
         coalesce(sum(err) FILTER (WHERE epoch < 2), 0.0) AS el2n,
         arg_max(logp, epoch * 1000000 + iteration) AS lp
  FROM {name}_f GROUP BY sample_id),
{name} AS (
  SELECT sample_id, label, n_records, correctness, last_correctness, forgetting, accumulated_margin,
         {var} AS variance, el2n,
         -list_sum(list_transform(lp, lambda x: exp(x) * ln(exp(x) + 1e-10))) AS entropy,
         -lp[label + 1] AS loss,
         exp(lp[label + 1]) AS confidence
  FROM {name}_a)"""
    return [rs, agg]


FX_TEXT = """fx_text AS (
  SELECT doc_id AS sample_id, text,
         CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER) AS label,
         (['reduced_800', 'dpo_d', 'variance_top_2_3', 'sft_d'])[CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 4 + 1] AS split
  FROM documents)"""


def toks(text: str = "text") -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[.,?!]', '', 'g'), '\\s+'), "
            f"lambda x: x <> '')")


def trigrams(tok_list: str) -> str:
    return (f"(CASE WHEN len({tok_list}) >= 3 THEN list_transform(generate_series(1, len({tok_list}) - 2), "
            f"lambda i: array_to_string({tok_list}[i:i + 2], ' ')) ELSE [] END)")


def hashed_vec(src: str, name: str, dims: int = 64) -> str:
    """CTE ``name``(sample_id, vec) over ``src``(sample_id, text): V1."""
    return f"""{name}_t AS (SELECT sample_id, unnest({toks()}) AS tok FROM {src}),
{name}_b AS (SELECT sample_id, CAST({h24('tok')} % {dims} AS INTEGER) AS b, count(*) AS c FROM {name}_t GROUP BY ALL),
{name}_n AS (SELECT sample_id, sqrt(sum(c * c)) AS nrm FROM {name}_b GROUP BY sample_id),
{name} AS (
  SELECT f.sample_id, list(CASE WHEN n.nrm > 0 THEN coalesce(CAST(hb.c AS DOUBLE), 0.0) / n.nrm ELSE 0.0 END ORDER BY g.b) AS vec
  FROM {src} f CROSS JOIN (SELECT CAST(range AS INTEGER) AS b FROM range(0, {dims})) g
  LEFT JOIN {name}_b hb ON hb.sample_id = f.sample_id AND hb.b = g.b
  LEFT JOIN {name}_n n ON n.sample_id = f.sample_id
  GROUP BY f.sample_id)"""


# Vectors of whole documents under the name the dynamics log reads (fx_vec).
FX_DOC_VEC = hashed_vec("fx_text", "fx_dv") + """,
fx_vec AS (SELECT t.sample_id, t.label, v.vec FROM fx_text t JOIN fx_dv v USING (sample_id))"""


def class_metrics(x: str, name: str) -> list[str]:
    """CTEs ending in ``name``(split, label, n, avg_distance, dissimilarity,
    embed_std, homogeneity) over ``x``(split, label, sample_id, vec); pairs by
    brute-force self-join (the oracle form)."""
    return [f"""{name}_pairs AS (
  SELECT a.split, a.label, a.sample_id AS i, len(a.vec) AS h,
         sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS d,
         list_dot_product(a.vec, b.vec) / (greatest(sqrt(list_dot_product(a.vec, a.vec)), 1e-8)
                                            * greatest(sqrt(list_dot_product(b.vec, b.vec)), 1e-8)) AS cs
  FROM {x} a JOIN {x} b ON a.split = b.split AND a.label = b.label),
{name}_w AS (SELECT split, label, i, d, cs, CASE WHEN d > 0 THEN pow(d, ln(h)) ELSE 0.0 END AS w FROM {name}_pairs),
{name}_s AS (SELECT split, label, i, sum(w) AS s FROM {name}_w GROUP BY ALL),
{name}_m AS (SELECT split, label, count(*) AS n FROM {x} GROUP BY ALL),
{name}_e AS (
  SELECT w.split, w.label, w.i, min(s.s) AS s,
         -sum(CASE WHEN s.s > 0 THEN (w.w / s.s) * ln(w.w / s.s + 1e-10) END) / min(m.n) AS ent
  FROM {name}_w w JOIN {name}_s s USING (split, label, i) JOIN {name}_m m USING (split, label)
  GROUP BY ALL),
{name}_pair AS (
  SELECT p.split, p.label, avg(p.d) AS avg_distance, 1 - avg(p.cs) AS dissimilarity
  FROM {name}_w p GROUP BY ALL),
{name}_hom AS (
  SELECT e.split, e.label, CASE WHEN min(m.n) > 2 AND min(e.s) > 0 THEN sum(e.ent) / ln(min(m.n) - 1) END AS homogeneity
  FROM {name}_e e JOIN {name}_m m USING (split, label) GROUP BY ALL),
{name}_sd AS (
  SELECT split, label, CASE WHEN min(sd) <= 0 THEN avg(sd) ELSE exp(avg(ln(CASE WHEN sd > 0 THEN sd END))) END AS embed_std
  FROM (SELECT split, label, sqrt(list_sum(list_transform(vec, lambda t: (t - list_avg(vec)) * (t - list_avg(vec)))) / (len(vec) - 1)) AS sd FROM {x})
  GROUP BY ALL),
{name} AS (
  SELECT m.split, m.label, m.n, p.avg_distance, p.dissimilarity, sd.embed_std, hm.homogeneity
  FROM {name}_m m JOIN {name}_pair p USING (split, label) JOIN {name}_sd sd USING (split, label)
  JOIN {name}_hom hm USING (split, label))"""]


def centers(x: str, name: str) -> str:
    return f"""{name}_l AS (
  SELECT split, label, d, avg(vec[d]) AS v
  FROM (SELECT split, label, vec, unnest(generate_series(1, len(vec))) AS d FROM {x}) GROUP BY ALL),
{name} AS (SELECT split, label, list(v ORDER BY d) AS center FROM {name}_l GROUP BY ALL)"""


def affinity(cent: str, name: str, ref: str) -> str:
    return f"""{name} AS (
  SELECT c.split,
         CASE WHEN avg(list_distance(c.center, r.center)) > 0 THEN round(1.0 / avg(list_distance(c.center, r.center)), 6) END AS affinity,
         count(*) FILTER (WHERE r.center IS NULL) AS n_unmatched_labels
  FROM {cent} c LEFT JOIN (SELECT label, center FROM {cent} WHERE split = '{ref}') r USING (label)
  GROUP BY c.split)"""


def vocab_sql(src: str, name: str) -> str:
    """CTE ``name``(tok, id): frequency-ranked vocabulary from ids 4 up."""
    return f"""{name}_t AS (SELECT sample_id, unnest(tk) AS tok, unnest(generate_series(1, len(tk))) AS pos
  FROM (SELECT sample_id, {toks()} AS tk FROM {src})),
{name} AS (
  SELECT tok, CAST(rn + 3 AS INTEGER) AS id FROM (
    SELECT tok, row_number() OVER (ORDER BY count(*) DESC, tok) AS rn FROM {name}_t GROUP BY tok))"""


FX_GROUPS = r"""fx_groups AS (
  SELECT group_id, text, CASE WHEN form = 0 THEN NULL ELSE its END AS items,
         CASE WHEN form = 0 THEN '[' || q || '] and more' WHEN form = 1 AND len(its) >= 1 THEN '[' || q || ',]'
              WHEN form = 2 AND len(its) >= 2 THEN '(' || q || ')' ELSE '[' || q || ']' END AS paraphrases,
         CASE WHEN """ + h24("'cat:' || CAST(group_id AS VARCHAR)") + r""" % 100 < 59 THEN 'question' ELSE 'sentence' END AS category
  FROM (SELECT *, """ + h24("'lit:' || CAST(group_id AS VARCHAR)") + r""" % 16 AS form,
               array_to_string(list_transform(its, lambda x: '''' || replace(replace(x, '\', '\\'), '''', '\''') || ''''), ', ') AS q
        FROM (SELECT doc_id * 1048576 + c AS group_id, p[6 * c + 1] AS text, p[6 * c + 2:6 * c + 6] AS its
              FROM (SELECT doc_id, p, unnest(generate_series(0, (len(p) - 1) // 6)) AS c
                    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.\n]+\s*'), lambda x: x <> '') AS p FROM documents)
                    WHERE len(p) > 0))))"""

PARSE = "items"


def raw_toks(text: str = "text") -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> '')"


def edits(t: str) -> str:
    """The five built-in candidate edits over token list ``t`` (G1)."""
    return ("[" + ", ".join(f"array_to_string({e}, ' ')" for e in [
        f"{t}[2:] || {t}[1:1]",
        f"list_reverse({t})",
        f"list_filter({t}, lambda x, i: i % 3 <> 0)",
        f"list_transform({t}, lambda x, i: CASE WHEN i % 2 = 1 THEN coalesce({t}[i + 1], x) ELSE {t}[i - 1] END)",
        f"{t}[1:3] || {t}"]) + "]")


def l2eps(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2] + 1e-6) * (t[1] - t[2] + 1e-6))))"


def cosine(a: str, b: str) -> str:
    return (f"(list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-8) * "
            f"greatest(sqrt(list_dot_product({b}, {b})), 1e-8)))")


def extremes(orig: str, cand: str, name: str, metric: str = "l2") -> list[str]:
    """CTEs ending in ``name``(k, dis_idx, dis_text, sim_idx, sim_text).

    ``orig``(k VARCHAR, text); ``cand``(k VARCHAR, cand_idx, cand_text)."""
    d = l2eps("o.vec", "c2.vec") if metric == "l2" else "-" + cosine("o.vec", "c2.vec")
    return [f"""{name}_os AS (SELECT k AS sample_id, text FROM {orig}),
{name}_cs AS (SELECT k || '#' || CAST(cand_idx AS VARCHAR) AS sample_id, text FROM (SELECT k, cand_idx, cand_text AS text FROM {cand})),""" + "\n"
            + hashed_vec(f"{name}_os", f"{name}_ov") + ",\n" + hashed_vec(f"{name}_cs", f"{name}_cv") + f""",
{name}_d AS (
  SELECT c.k, c.cand_idx, c.cand_text, round({d}, 12) AS d
  FROM {cand} c JOIN {name}_cv c2 ON c2.sample_id = c.k || '#' || CAST(c.cand_idx AS VARCHAR)
  JOIN {name}_ov o ON o.sample_id = c.k),
{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC, cand_idx) AS rdis,
            row_number() OVER (PARTITION BY k ORDER BY d, cand_idx) AS rsim FROM {name}_d),
{name} AS (
  SELECT k, max(cand_idx) FILTER (WHERE rdis = 1) AS dis_idx, max(cand_text) FILTER (WHERE rdis = 1) AS dis_text,
            max(cand_idx) FILTER (WHERE rsim = 1) AS sim_idx, max(cand_text) FILTER (WHERE rsim = 1) AS sim_text
  FROM {name}_r GROUP BY k)"""]
