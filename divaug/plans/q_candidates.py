"""Registered queries: paraphrase sets (L1-L8, P7, S8) and augmentation."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from divaug.functions import text as TX
from divaug.operators import candidates as CD
from divaug.operators import coreset as K
from divaug.operators import dynamics as D
from divaug.operators import sampling as SM
from divaug.plans import sqlparts as S
from divaug.plans.q_coreset import CB_STEPS
from divaug.plans.q_sampling import GROUP_POS, SFT_GROUPS, DPO_GROUPS, SHARES, _quota_case, SEED, NESTED
from divaug.plans.registry import register
from divaug.sources import catalog as CT
from divaug.sources import fixtures as FX
from divaug.functions.vectors import rnd
from divaug.session import stored

INS = CD.INSTRUCTION
SFT_CAP, DPO_CAP = 100_000, 50_000   # fixed values: max_samples of the tuning configs


def parsed_groups(spark, sf):
    return CD.parse_literals(FX.fx_groups(spark, sf))


# ------------------------------------------------------------------ L1-L3
@register("parse_list_literal", S.with_([S.FX_GROUPS], f"""
SELECT group_id, CAST(len({S.PARSE}) AS INTEGER) AS n_items, md5(array_to_string({S.PARSE}, '|')) AS items_md5
FROM fx_groups"""))
def parse_list_literal(spark, sf):
    p = parsed_groups(spark, sf)
    return p.select("group_id", F.size("items").alias("n_items"), F.md5(F.array_join("items", "|")).alias("items_md5"))


@register("parse_rejects", S.with_([S.FX_GROUPS], """
SELECT group_id, paraphrases FROM fx_groups WHERE items IS NULL"""))
def parse_rejects(spark, sf):
    _, bad = CD.split_rejects(parsed_groups(spark, sf))
    return bad.select("group_id", "paraphrases")


SFT_ROWS = f"""SELECT group_id, CAST(unnest(generate_series(0, len({S.PARSE}) - 1)) AS INTEGER) AS pos,
       '{INS}' AS instruction, text AS input, unnest({S.PARSE}) AS output"""


@register("sft_explode", S.with_([S.FX_GROUPS], SFT_ROWS + " FROM fx_groups"))
def sft_explode(spark, sf):
    return CD.sft_rows(parsed_groups(spark, sf))


def _shuffle_sql(src, id_sql):
    return (f"SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || {id_sql}), {id_sql}) AS position FROM {src}")


SFT_DATASET = GROUP_POS + [f"""sftq AS (SELECT * FROM gpos WHERE pos <= {_quota_case(SFT_GROUPS)}),
sftr AS ({SFT_ROWS} FROM sftq),
sftd AS ({_shuffle_sql('sftr', "CAST(group_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR)")})"""]


def sft_dataset_df(spark, sf):
    g = SM.quota_sample(FX.fx_groups(spark, sf), "category", SFT_GROUPS, SHARES, 0, SEED, "group_id").drop("pos")
    rows = CD.sft_rows(CD.parse_literals(g))
    return CD.shuffled(rows, SEED, F.concat_ws(":", F.col("group_id").cast("string"), F.col("pos").cast("string")))


@register("sft_dataset", S.with_(SFT_DATASET, "SELECT group_id, pos, instruction, input, output, position FROM sftd"))
def sft_dataset(spark, sf):
    return sft_dataset_df(spark, sf).select("group_id", "pos", "instruction", "input", "output", "position")


# ------------------------------------------------------------------ L4/L5/L8
def _pref_sql(src, name, metric):
    return [f"""{name}_o AS (SELECT CAST(group_id AS VARCHAR) AS k, text FROM {src}),
{name}_c AS (SELECT CAST(group_id AS VARCHAR) AS k, CAST(unnest(generate_series(0, len({S.PARSE}) - 1)) AS INTEGER) AS cand_idx,
                    unnest({S.PARSE}) AS cand_text FROM {src})"""] + S.extremes(f"{name}_o", f"{name}_c", f"{name}_x", metric) + [
        f"""{name} AS (SELECT g.group_id, '{INS}' AS instruction, g.text AS input, x.dis_text AS chosen, x.sim_text AS rejected
  FROM {src} g JOIN {name}_x x ON x.k = CAST(g.group_id AS VARCHAR))"""]


@register("preference_pairs", S.with_([S.FX_GROUPS] + _pref_sql("fx_groups", "pp", "l2"),
                                      "SELECT group_id, instruction, input, chosen, rejected FROM pp"))
def preference_pairs(spark, sf):
    good, _ = CD.split_rejects(parsed_groups(spark, sf))
    return CD.preference_pairs(good, "l2")


@register("preference_pairs_cosine", S.with_([S.FX_GROUPS] + _pref_sql("fx_groups", "pc", "cosine"),
                                             "SELECT group_id, instruction, input, chosen, rejected FROM pc"))
def preference_pairs_cosine(spark, sf):
    good, _ = CD.split_rejects(parsed_groups(spark, sf))
    return CD.preference_pairs(good, "cosine")


PREF_DATASET = GROUP_POS + [f"""dpoq AS (SELECT * FROM gpos WHERE pos > {SFT_GROUPS} AND pos <= {SFT_GROUPS} + {_quota_case(DPO_GROUPS)})"""] \
    + _pref_sql("dpoq", "dp", "l2") + [f"dpod AS ({_shuffle_sql('dp', 'CAST(group_id AS VARCHAR)')})"]


def preference_dataset_df(spark, sf):
    g = SM.quota_sample(FX.fx_groups(spark, sf), "category", DPO_GROUPS, SHARES, SFT_GROUPS, SEED, "group_id")
    good, _ = CD.split_rejects(CD.parse_literals(g.drop("pos")))
    pairs = CD.preference_pairs(good, "l2")
    return CD.shuffled(pairs, SEED, F.col("group_id").cast("string"))


@register("preference_dataset", S.with_(PREF_DATASET, "SELECT group_id, instruction, input, chosen, rejected, position FROM dpod"))
def preference_dataset(spark, sf):
    return preference_dataset_df(spark, sf).select("group_id", "instruction", "input", "chosen", "rejected", "position")


@register("max_samples_cap", S.with_(SFT_DATASET + PREF_DATASET[len(GROUP_POS):], f"""
SELECT 'paraphrase_sft_100k_100k' AS dataset, group_id, position FROM sftd WHERE position <= {SFT_CAP}
UNION ALL
SELECT 'paraphrase_dpo_100k_100k' AS dataset, group_id, position FROM dpod WHERE position <= {DPO_CAP}"""))
def max_samples_cap(spark, sf):
    a = sft_dataset_df(spark, sf).filter(F.col("position") <= SFT_CAP).select(
        F.lit("paraphrase_sft_100k_100k").alias("dataset"), "group_id", "position")
    b = preference_dataset_df(spark, sf).filter(F.col("position") <= DPO_CAP).select(
        F.lit("paraphrase_dpo_100k_100k").alias("dataset"), "group_id", "position")
    return a.unionByName(b)


@register("column_map", S.with_(SFT_DATASET + PREF_DATASET[len(GROUP_POS):], """
SELECT 'paraphrase_sft_100k_100k' AS dataset, group_id, position, instruction AS prompt, input AS query, output AS response,
       NULL::VARCHAR AS chosen, NULL::VARCHAR AS rejected FROM sftd
UNION ALL
SELECT 'paraphrase_dpo_100k_100k', group_id, position, instruction, input, NULL, chosen, rejected FROM dpod"""))
def column_map(spark, sf):
    """Both registered sets under the names of their roles."""
    sets = {"paraphrase_sft_100k_100k": sft_dataset_df, "paraphrase_dpo_100k_100k": preference_dataset_df}
    parts = [CT.by_role(make(spark, sf), name, keep=(F.lit(name).alias("dataset"), "group_id", "position")) for name, make in sets.items()]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


@register("chat_messages", S.with_([S.FX_TEXT], f"""
SELECT sample_id, 0 AS idx, 'system' AS role, '{INS + CD.MULTILINGUAL_NOTE}' AS content FROM fx_text
UNION ALL SELECT sample_id, 1 AS idx, 'user' AS role, text AS content FROM fx_text"""))
def chat_messages(spark, sf):
    m = CD.chat_messages(FX.fx_text(spark, sf), multilingual=True)
    return m.select("sample_id", F.posexplode("messages").alias("idx", "m")).select(
        "sample_id", F.col("idx").cast("int").alias("idx"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


# ------------------------------------------------------------------ G1-G10
def _band_sql(lo, hi):
    return (f"c.key = 'variance' AND c.rank > floor(c.n_label * {S.dbl(lo)}) "
            f"AND c.rank <= floor(c.n_label * {S.dbl(hi)})")


# Scores of the documents themselves: every document is in the log.
DOC_SCORES = [S.FX_TEXT, S.FX_DOC_VEC, S.FX_CENT_ALL, S.FX_DYN] + S.score_table()
DOC_CB = DOC_SCORES + CB_STEPS
AUG_BASE = DOC_CB + [f"""aseed AS (SELECT c.sample_id, c.label, f.text FROM cbr c JOIN fx_text f USING (sample_id)
  WHERE {_band_sql(0, Fraction(1, 3))}),
anon AS (SELECT c.sample_id, c.label, f.text FROM cbr c JOIN fx_text f USING (sample_id)
  WHERE {_band_sql(Fraction(1, 3), Fraction(2, 3))})"""]


def _cands_sql(src, name, key="sample_id"):
    return f"""{name} AS (SELECT CAST({key} AS VARCHAR) AS k, CAST(unnest(generate_series(0, 4)) AS INTEGER) AS cand_idx,
       unnest({S.edits('tk')}) AS cand_text FROM (SELECT {key}, {S.raw_toks()} AS tk FROM {src})),
{name}_o AS (SELECT CAST({key} AS VARCHAR) AS k, text FROM {src})"""


AUG = AUG_BASE + [_cands_sql("aseed", "ac")] + S.extremes("ac_o", "ac", "ax")


def doc_scores(spark, sf):
    return D.score_table(FX.fx_dynamics(spark, sf, vecs=FX.fx_doc_vec(spark, sf)))


def aug_base(spark, sf):
    scores = doc_scores(spark, sf)
    bands = K.class_balanced_bands(scores, "variance", bands=("top_1_3", "mid_1_3"))
    t = FX.fx_text(spark, sf).select("sample_id", "text")
    b = stored(bands.join(t, "sample_id").select("band", "sample_id", "label", "text"), "bands")   # both filters read it
    return (b.filter(F.col("band") == "top_1_3").select("sample_id", "label", "text"),
            b.filter(F.col("band") == "mid_1_3").select("sample_id", "label", "text"))


@register("candidate_fanout", S.with_(AUG, "SELECT CAST(k AS BIGINT) AS sample_id, cand_idx, md5(cand_text) AS cand_md5 FROM ac"))
def candidate_fanout(spark, sf):
    seeds, _ = aug_base(spark, sf)
    c = CD.builtin_generator(seeds.select("sample_id", "text"))
    return c.select("sample_id", "cand_idx", F.md5("cand_text").alias("cand_md5"))


@register("dissimilar_select", S.with_(AUG, "SELECT CAST(k AS BIGINT) AS sample_id, dis_idx, sim_idx FROM ax"))
def dissimilar_select(spark, sf):
    seeds, _ = aug_base(spark, sf)
    return CD.paraphrase_select(seeds, "sample_id").select("sample_id", "dis_idx", "sim_idx")


def _aug_sql(seed, non, x, pol):
    return f"""
SELECT 'seed' AS origin, sample_id, label, md5(text) AS text_md5 FROM {seed}
UNION ALL SELECT 'paraphrase', s.sample_id, s.label, md5(x.{pol}_text) FROM {seed} s JOIN {x} x ON x.k = CAST(s.sample_id AS VARCHAR)
UNION ALL SELECT 'nonseed', sample_id, label, md5(text) FROM {non}"""


def _aug_df(seeds, non, pol="dis"):
    chosen = CD.paraphrase_select(seeds, "sample_id", keep=("label",))
    a = CD.augmented_set(seeds, non, chosen, "sample_id", pol)
    return a.select("origin", "sample_id", "label", F.md5("text").alias("text_md5"))


@register("augmented_set", S.with_(AUG, _aug_sql("aseed", "anon", "ax", "dis")))
def augmented_set(spark, sf):
    seeds, non = aug_base(spark, sf)
    return _aug_df(seeds, non, "dis")


@register("augmented_set_similar", S.with_(AUG, _aug_sql("aseed", "anon", "ax", "sim")))
def augmented_set_similar(spark, sf):
    seeds, non = aug_base(spark, sf)
    return _aug_df(seeds, non, "sim")


@register("paraphrase_pairs", S.with_(AUG, """
SELECT s.sample_id, s.label, md5(s.text) AS text_md5, md5(x.dis_text) AS paraphrased_md5
FROM aseed s JOIN ax x ON x.k = CAST(s.sample_id AS VARCHAR)"""))
def paraphrase_pairs(spark, sf):
    seeds, _ = aug_base(spark, sf)
    ch = CD.paraphrase_select(seeds, "sample_id", keep=("label", F.col("text").alias("original")))
    return ch.select("sample_id", "label", F.md5("original").alias("text_md5"),
                                              F.md5("dis_text").alias("paraphrased_md5"))


def _half_split_sql(src, name):
    return f"""{name}_r AS (SELECT *, row_number() OVER (ORDER BY {S.seeded_key('42-split')}, sample_id) AS p2,
                            count(*) OVER () AS n2 FROM {src}),
{name}_s AS (SELECT sample_id, label, text FROM {name}_r WHERE p2 <= floor(n2 / 2)),
{name}_n AS (SELECT sample_id, label, text FROM {name}_r WHERE p2 > floor(n2 / 2))"""


def _half_split(df, texts):
    """Seeded halves of ``df`` (sample_id, label), texts joined after the rank."""
    ranked = SM.seeded_order(df.select("sample_id", "label"), "42-split", count_name="n2", name="p2")
    o = ranked.join(texts.select("sample_id", "text"), "sample_id")
    cut = F.floor(F.col("n2") / 2)
    return (o.filter(F.col("p2") <= cut).select("sample_id", "label", "text"),
            o.filter(F.col("p2") > cut).select("sample_id", "label", "text"))


WOC = DOC_SCORES + [f"""lab AS (SELECT c.sample_id, c.label, f.text FROM scores c JOIN fx_text f USING (sample_id)),
r800 AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {S.seeded_key(SEED)}, sample_id) AS p1 FROM lab)
         WHERE p1 <= {NESTED[1]})""", _half_split_sql("r800", "wc"), _cands_sql("wc_s", "wcc")] + S.extremes("wcc_o", "wcc", "wcx")


@register("variant_wo_coreset", S.with_(WOC, _aug_sql("wc_s", "wc_n", "wcx", "dis")))
def variant_wo_coreset(spark, sf):
    lab = FX.fx_text(spark, sf).select("sample_id", "label")   # every document is in the log
    r800 = SM.seeded_order(lab, SEED).filter(F.col("pos") <= NESTED[1]).drop("pos")
    seeds, non = _half_split(r800, FX.fx_text(spark, sf))
    return _aug_df(seeds, non, "dis")


WOS = AUG_BASE + [f"""t23 AS (SELECT c.sample_id, c.label, f.text FROM cbr c JOIN fx_text f USING (sample_id)
  WHERE {_band_sql(0, Fraction(2, 3))})""", _half_split_sql("t23", "ws"), _cands_sql("ws_s", "wsc")] + S.extremes("wsc_o", "wsc", "wsx")


@register("variant_wo_selective", S.with_(WOS, _aug_sql("ws_s", "ws_n", "wsx", "dis")))
def variant_wo_selective(spark, sf):
    t23 = K.class_balanced_bands(doc_scores(spark, sf), "variance", bands=("top_2_3",))
    seeds, non = _half_split(t23, FX.fx_text(spark, sf))
    return _aug_df(seeds, non, "dis")


def _pair_sql(markers, name):
    ma, mb = markers
    return [f"""fx_pairs AS (
  SELECT concat_ws(':', u.conv_id, u.turn) AS sample_id, '{ma}' || u.text || ' {mb}' || a.text AS text,
         CAST(u.conv_id % 3 AS INTEGER) AS label
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')""", f"""{name}_f AS (
  SELECT CAST(sample_id AS VARCHAR) || '|0' AS k, sample_id, string_split(string_split(text, '{ma}')[2], '{mb}')[1] AS text
  FROM fx_pairs WHERE text LIKE '%{ma}%' AND text LIKE '%{mb}%'
  UNION ALL
  SELECT CAST(sample_id AS VARCHAR) || '|1' AS k, sample_id, string_split(text, '{mb}')[2] AS text
  FROM fx_pairs WHERE text LIKE '%{ma}%' AND text LIKE '%{mb}%'),
{name}_c AS (SELECT k, CAST(unnest(generate_series(0, 4)) AS INTEGER) AS cand_idx, unnest({S.edits('tk')}) AS cand_text
  FROM (SELECT k, {S.raw_toks()} AS tk FROM {name}_f)),
{name}_o AS (SELECT k, text FROM {name}_f)"""] + S.extremes(f"{name}_o", f"{name}_c", f"{name}_x") + [f"""{name} AS (
  SELECT a.sample_id,
         '{ma}' || xa.dis_text || '. {mb}' || xb.dis_text || '.' AS text_dis,
         '{ma}' || xa.sim_text || '. {mb}' || xb.sim_text || '.' AS text_sim
  FROM (SELECT DISTINCT sample_id FROM {name}_f) a
  JOIN {name}_x xa ON xa.k = CAST(a.sample_id AS VARCHAR) || '|0'
  JOIN {name}_x xb ON xb.k = CAST(a.sample_id AS VARCHAR) || '|1')"""]


def _pairs_df(spark, sf, markers):
    p = FX.fx_pairs(spark, sf, *markers)
    r = CD.paraphrase_pairs_fields(p, "sample_id", markers)
    return r.select("sample_id", F.md5("text_dis").alias("dis_md5"), F.md5("text_sim").alias("sim_md5"))


@register("pair_fields_nli", S.with_(_pair_sql(TX.NLI_MARKERS, "nli"),
                                     "SELECT sample_id, md5(text_dis) AS dis_md5, md5(text_sim) AS sim_md5 FROM nli"))
def pair_fields_nli(spark, sf):
    return _pairs_df(spark, sf, TX.NLI_MARKERS)


@register("pair_fields_sts", S.with_(_pair_sql(TX.STS_MARKERS, "sts"),
                                     "SELECT sample_id, md5(text_dis) AS dis_md5, md5(text_sim) AS sim_md5 FROM sts"))
def pair_fields_sts(spark, sf):
    return _pairs_df(spark, sf, TX.STS_MARKERS)


QA = ["""fx_qa AS (SELECT item_id AS sample_id, text AS question, string_split_regex(text, '\\s+')[1:4] AS choices,
  (['A', 'B', 'C', 'D'])[CAST(item_id % 4 AS INTEGER) + 1] AS answerKey FROM benchmark)""",
      f"""qr AS (SELECT *, row_number() OVER (ORDER BY {S.seeded_key('42-split')}, sample_id) AS p2, count(*) OVER () AS n2 FROM fx_qa),
qs AS (SELECT * FROM qr WHERE p2 <= floor(n2 / 2)),
qc AS (SELECT CAST(sample_id AS VARCHAR) AS k, CAST(unnest(generate_series(0, 4)) AS INTEGER) AS cand_idx,
       unnest({S.edits('tk')}) AS cand_text FROM (SELECT sample_id, {S.raw_toks('question')} AS tk FROM qs)),
qc_o AS (SELECT CAST(sample_id AS VARCHAR) AS k, question AS text FROM qs)"""] + S.extremes("qc_o", "qc", "qx")


def _qa_sql(form, key):
    return f"""
SELECT '{form}' AS form, CASE WHEN p2 <= floor(n2 / 2) THEN 'seed' ELSE 'nonseed' END AS origin, sample_id, md5(question) AS question_md5,
       array_to_string(choices, '|') AS choices, {key} AS answer FROM qr
UNION ALL
SELECT '{form}', 'paraphrase', q.sample_id, md5(x.dis_text), array_to_string(q.choices, '|'), {key}
FROM qs q JOIN qx x ON x.k = CAST(q.sample_id AS VARCHAR)"""


@register("augmented_set_qa", S.with_(QA, _qa_sql("csqa", "answerKey") + "\nUNION ALL" + _qa_sql("codah", "CAST(sample_id % 4 AS VARCHAR)")))
def augmented_set_qa(spark, sf):
    """Both QA schemas; a seeded half are seeds, the rest non-seeds."""
    def one(df, schema):
        o = SM.seeded_order(CD.project_text(df, schema), "42-split", count_name="n2", name="p2")
        cut = F.floor(F.col("n2") / 2)
        seeds, non = o.filter(F.col("p2") <= cut), o.filter(F.col("p2") > cut)
        a = CD.augmented_set(seeds, non, CD.schema_select(seeds, schema, keep=("carry",)), carry=("carry",))
        text, (choices, answer) = CD.SCHEMAS[schema]
        return CD.restore_schema(a, schema, keep=("origin",)).select(
            F.lit(schema).alias("form"), "origin", "sample_id", F.md5(text).alias("question_md5"),
            F.array_join(choices, "|").alias("choices"), F.col(answer).cast("string").alias("answer"))
    return one(FX.fx_qa(spark, sf), "csqa").unionByName(one(FX.fx_qa_codah(spark, sf), "codah"))


@register("l2_distance", S.with_([S.FX_GROUPS] + _pref_sql("fx_groups", "ld", "l2"), """
SELECT CAST(k AS BIGINT) AS group_id, cand_idx, round(d, 6) AS distance FROM ld_x_d"""))
def l2_distance(spark, sf):
    good, _ = CD.split_rejects(parsed_groups(spark, sf))
    d = CD.with_distances(good.select("group_id", "text", "items"), "text", "items").select("group_id", F.posexplode("_d").alias("cand_idx", "_d"))
    return d.select("group_id", F.col("cand_idx").cast("int").alias("cand_idx"), rnd("_d", 6).alias("distance"))


@register("qa_schema_projection", S.with_([], """
SELECT 'csqa' AS form, item_id AS sample_id, text,
       array_to_string(string_split_regex(text, '\\s+')[1:4], '|') || '#' || (['A', 'B', 'C', 'D'])[CAST(item_id % 4 AS INTEGER) + 1] AS carried
FROM benchmark
UNION ALL
SELECT 'codah', item_id, text,
       array_to_string(string_split_regex(text, '\\s+')[1:4], '|') || '#' || CAST(item_id % 4 AS VARCHAR)
FROM benchmark"""))
def qa_schema_projection(spark, sf):
    """Both QA schemas projected to (text, carried struct) by configuration."""
    a = CD.project_text(FX.fx_qa(spark, sf), "csqa").select(
        F.lit("csqa").alias("form"), "sample_id", "text",
        F.concat(F.array_join("carry.choices", "|"), F.lit("#"), F.col("carry.answerKey")).alias("carried"))
    b = CD.project_text(FX.fx_qa_codah(spark, sf), "codah").select(
        F.lit("codah").alias("form"), "sample_id", "text",
        F.concat(F.array_join("carry.candidate_answers", "|"), F.lit("#"),
                 F.col("carry.correct_answer_idx").cast("string")).alias("carried"))
    return a.unionByName(b)
