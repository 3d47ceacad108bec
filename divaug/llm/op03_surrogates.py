"""PII surrogates (operator 3), with DataFrame functions only.

Entities found by one pattern are replaced by keyed surrogates of their own
type: a digest of (key, type, normal form, attempt) drives the new characters.
Digits become digits, lower-case letters lower-case, upper-case upper-case, and
punctuation stays, so script and format match; e-mail addresses keep the shape
of the local part and get a host below a reserved domain; telephone numbers
keep their country code; card numbers keep their first digit and pass the Luhn
check when the original does; IP addresses have octets of 1 to 223; access
keys keep their prefix, secrets (a label in any case, then a value of 8 or more
characters up to white space, a quote or an angle bracket) their label; a titled name gets a name of the
title's gender and of its own script (Latin or Cyrillic) with as many words.

One entity gets one surrogate in the whole corpus (coreference): e-mail
addresses ignore case, telephone and card numbers are their digits, names their
title and words; each mention shows the surrogate in its own spelling.
Collision check: a surrogate claimed by two entities, or equal to an entity that
occurs, is given to the least claimant only (none, if it occurs) and the others
draw again, among surrogates that nobody drew before, until all are distinct.
After some attempts names, local parts and secrets get longer, so their spaces
never run out.  A round writes the losers' new draws only; only entities that
had to draw again are joined back to texts, the rest is computed in place.

Degenerate input: null and empty texts stay as they are; texts without an
entity are unchanged; repeated rows and entities get equal surrogates; an
empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.llm.common import first_row, materialize, register, table

# Labels of secrets in any case, what stands between label and
# value, and the value: 8 characters or more up to white space, a quote or an
# angle bracket; marks that end a sentence are left out where 8 others remain.
LABELS = "(?iu:password|passwd|secret|api_key|token)"
GIVES = r"(?: {0,3}[=:] {0,3}\"?)"
VALUE = r"(?=[^\s\"'`<>]*[\p{L}\p{N}])(?:[^\s\"'`<>]{7,}[^\s\"'`<>.,;:!?)\]}]|[^\s\"'`<>]{8,})"
# The patterns of the types, in order of precedence.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,4}\.[A-Za-z]{2,24}",
    "access": r"\bAKIA[A-Z0-9]{16}\b",
    "secret": r"\b" + LABELS + GIVES + VALUE,
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}(?!\d)",
    "card": r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])",
    "name": r"\b(?:Mr|Mrs|Ms|Herr|Frau|Monsieur|Madame|Señora|Señor|Г-н|Г-жа)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?",
}
# Titles of women; the others above are titles of men.
FEMALE = r"^(?:Mrs|Ms|Frau|Madame|Señora|Г-жа)"
# Parts that names are made of.
ONSETS = {"latin": ["Bel", "Car", "Dan", "El", "Fer", "Gil", "Hel", "Jor", "Kal", "Lor", "Mar", "Nor", "Ros", "Sal", "Tam", "Vel"],
          "cyrillic": ["Бел", "Кар", "Дан", "Ел", "Фер", "Гил", "Хел", "Жор", "Кал", "Лор", "Мар", "Нор", "Рос", "Сал", "Там", "Вел"]}
MIDDLES = {"latin": ["an", "ar", "el", "en", "er", "il", "in", "ir", "ol", "on", "or", "ov", "ul", "un", "ur", "av"],
           "cyrillic": ["ан", "ар", "ел", "ен", "ер", "ил", "ин", "ир", "ол", "он", "ор", "ов", "ул", "ун", "ур", "ав"]}
ENDS = {"latin": {"female": "a", "male": "o"}, "cyrillic": {"female": "а", "male": "ий"}}
RESERVED_HOST = "example.org"
ANY = "(?u)" + "|".join(
    # the back reference of the card pattern moves with the group numbers: named instead
    p.replace("([ -]?)", "(?<gap>[ -]?)").replace(r"\1", r"\k<gap>") for p in PATTERNS.values())
# Cheap test before the pattern: every entity has one of these.
HINT = r"[@0-9]|(?:Mr|Ms|Herr|Frau|Monsieur|Madame|Señor|Г-)|AKIA|" + LABELS
GROWS_AFTER = 4   # attempts after which surrogates of names, local parts and secrets get longer
# Country codes of one and two digits; the others have three.
COUNTRY = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    # the label first: a secret may hold an @
    for kind in ("card", "phone", "ip", "access", "email", "secret"):
        whole = {"secret": "^" + LABELS + GIVES, "email": "@", "access": "^AKIA",
                 "ip": r"^\d{1,3}(?:\.\d{1,3}){3}$", "phone": r"^\+", "card": r"^\d[\d -]{15,}$"}[kind]
        out = F.when(value.rlike(whole), F.lit(kind)).otherwise(out)
    return out


def normal_form(value: Column, kind: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return (F.when(kind == "email", F.lower(value)).when(kind == "phone", F.concat(F.lit("+"), digits)).when(kind == "card", digits)
             .when(kind == "name", F.regexp_replace(value, r"^(\S+?)\.? ", "$1 ")).otherwise(value))


def digest(*parts: Column) -> Column:
    """60 bits of a cryptographic digest of the parts, each with its length."""
    whole = F.concat(*[x for p in parts for x in (F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))])
    return F.conv(F.substring(F.sha2(whole, 256), 1, 15), 16, 10).cast("long")


def _poured(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""
    before = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), r"\D", ""))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.between("0", "9"), F.substr(digits, before(i), F.lit(1))).otherwise(c)), "")


def _draw(seed: Column, at: Column, below: int) -> Column:
    """A number of 0 .. below-1 for a place in the value."""
    return F.pmod(F.xxhash64(seed, at), F.lit(below))


def _shaped(value: Column, seed: Column) -> Column:
    """Each digit, lower-case or upper-case letter by one of its class."""
    chars = F.split(value, "")
    pick = lambda letters, c, i: F.substring(F.lit(letters), (_draw(seed, i, len(letters)) + 1).cast("int"), F.lit(1))
    one = lambda c, i: (F.when(c.between("0", "9"), pick("0123456789", c, i))
                        .when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz", c, i))
                        .when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", c, i)).otherwise(c))
    return F.array_join(F.transform(chars, one), "")


def _hex_shaped(value: Column, seed: Column) -> Column:
    """As ``_shaped``, but values of lower-case hexadecimal digits stay so."""
    chars = F.split(value, "")
    hexed = F.array_join(F.transform(chars, lambda c, i: F.substring(F.lit("0123456789abcdef"), (_draw(seed, i, 16) + 1).cast("int"), F.lit(1))), "")
    return F.when(value.rlike("^[0-9a-f]+$"), hexed).otherwise(_shaped(value, seed))


def _secret(value: Column, seed: Column, attempt: Column) -> Column:
    """Letters outside a to z become lower-case letters; later attempts are
    longer, as a value of few letters and digits has few surrogates."""
    chars = F.split(_hex_shaped(value, seed), "")
    other = lambda c, i: F.when((c > "\x7f") & c.rlike(r"[\p{L}\p{M}\p{N}]"),
                                F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (_draw(seed, i, 26) + 1).cast("int"), F.lit(1))).otherwise(c)
    return F.concat(F.array_join(F.transform(chars, other), ""), _longer(seed, attempt))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last digit is the check digit."""
    d = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")),
                    lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def _card(value: Column, seed: Column) -> Column:
    own = F.regexp_replace(value, r"\D", "")
    drawn = F.concat(F.substring(own, 1, 1), _shaped(F.substring(own, 2, 1 << 20), seed))
    base = F.concat(F.substring(drawn, 1, 15), F.lit("0"))
    check = F.pmod(F.lit(10) - luhn_sum(base) % 10, F.lit(10)).cast("string")
    return _poured(value, F.when(luhn_sum(own) % 10 == 0, F.concat(F.substring(drawn, 1, 15), check)).otherwise(drawn))


def _phone(value: Column, seed: Column) -> Column:
    own = F.regexp_replace(value, r"\D", "")
    code = F.regexp_extract(own, COUNTRY, 0)
    area = (_draw(seed, F.lit(-1), 8) + 2).cast("string")   # an area code starts with 2 to 9
    return _poured(value, F.concat(code, area, _shaped(F.substr(own, F.length(code) + 2), seed)))


def _longer(seed: Column, attempt: Column) -> Column:
    """Letters and digits that later attempts add; more than are left of one
    digest come from the next."""
    n = attempt - GROWS_AFTER
    return F.when(n > 0, F.substr(F.lower(F.concat(F.hex(seed), F.hex(F.xxhash64(seed)), F.hex(F.xxhash64(seed, seed)))), F.lit(1), n)).otherwise("")


def _email(value: Column, seed: Column, attempt: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    return F.concat(_shaped(local, seed), _longer(seed, attempt), F.lit("@m"), (_draw(seed, F.lit(-2), 9000) + 1000).cast("string"),
                    F.lit("." + RESERVED_HOST))


def _ip(seed: Column) -> Column:
    octet = lambda i: (_draw(seed, F.lit(i), 223) + 1).cast("string")
    return F.concat_ws(".", octet(-3), octet(-4), octet(-5), octet(-6))


def _name(value: Column, seed: Column, attempt: Column) -> Column:
    title = F.regexp_extract(value, r"^\S+ ", 0)
    words = F.split(F.substring(value, F.length(title) + 1, F.length(value)), " ")
    gender = F.when(value.rlike(FEMALE), "female").otherwise("male")

    def made(script: str) -> Column:
        part = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (_draw(seed, i, len(names)) + 1).cast("int"))
        middles = F.sequence(F.lit(1), F.lit(3) + F.greatest(F.lit(0), attempt - GROWS_AFTER))
        word = lambda w, i: F.concat(part(ONSETS[script], i * 64),
                                     F.array_join(F.transform(middles, lambda k: part(MIDDLES[script], i * 64 + k)), ""),
                                     F.when(gender == "female", ENDS[script]["female"]).otherwise(ENDS[script]["male"]))
        return F.array_join(F.transform(words, word), " ")
    return F.concat(title, F.when(value.rlike(r"[Ѐ-ӿ]\S*$"), made("cyrillic")).otherwise(made("latin")))


def surrogate(value: Column, key: str, attempt: Column) -> Column:
    """The surrogate that an entity draws on an attempt."""
    kind = kind_of(value)
    seed = digest(F.lit(key), kind, normal_form(value, kind), attempt)
    label = F.regexp_extract(value, "^" + LABELS + GIVES, 0)
    own = F.when(kind == "email", _email(F.lower(value), seed, attempt))
    own = own.when(kind == "access", F.concat(F.lit("AKIA"), _shaped(F.substring(value, 5, 16), seed)))
    own = own.when(kind == "secret", F.concat(label, _secret(F.substring(value, F.length(label) + 1, F.length(value)), seed, attempt)))
    own = own.when(kind == "ip", _ip(seed)).when(kind == "phone", _phone(value, seed))
    return own.when(kind == "card", _card(value, seed)).otherwise(_name(value, seed, attempt))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(value): the distinct entities of all texts, in normal form."""
    found = docs.select(docs[text_col].cast("string").alias("t")).filter(F.col("t").rlike(HINT))
    value = F.explode(F.regexp_extract_all("t", F.lit(ANY), F.lit(0))).alias("v")
    return found.select(value).select(normal_form(F.col("v"), kind_of(F.col("v"))).alias("value")).distinct()


def redraws(found: DataFrame, key: str, max_rounds: int = 60) -> DataFrame | None:
    """(value, attempt) of the entities whose first draw was not theirs to
    keep; None when there are none.  A round draws for the losers of the last
    one and compares with the entities, with all that was drawn before, and
    among themselves; what others have is not written again."""
    found = materialize(found)
    real = found.select(F.col("value").alias("s"))
    drawn = [materialize(found.select("value", surrogate(F.col("value"), key, F.lit(0)).alias("s")))]
    won: list[DataFrame] = []
    for attempt in range(1, max_rounds + 1):
        now = drawn[-1]
        taken = functools.reduce(DataFrame.unionByName, [real, *[d.select("s") for d in drawn[:-1]]])
        mine = now.groupBy("s").agg(F.min("value").alias("value"))   # of equal claims the least entity's
        kept = mine.join(taken.distinct(), "s", "left_anti")
        lost = materialize(now.join(kept.select("value"), "value", "left_anti").select("value"))
        if attempt > 1:
            won.append(now.join(lost, "value", "left_anti").select("value", F.lit(attempt - 1).alias("attempt")))
        if first_row(lost.agg(F.count("*").alias("n")))["n"] == 0:
            return functools.reduce(DataFrame.unionByName, won) if won else None
        drawn.append(materialize(lost.select("value", surrogate(F.col("value"), key, F.lit(attempt)).alias("s"))))
    raise RuntimeError("surrogates stay ambiguous: the format has too few values")


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and a column n_entities (in
    place of one that ``docs`` has)."""
    again = redraws(entities(docs, text_col), key)
    cols = [c for c in docs.columns if c != "n_entities" or c == text_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(cols)], docs[text_col].cast("string").alias("__text"))
    hit = F.coalesce(F.col("__text").rlike(HINT), F.lit(False))
    rows = rows.withColumn("__m", F.when(hit, F.regexp_extract_all("__text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    n = F.size("__m")
    norm = lambda v: normal_form(v, kind_of(v))
    attempt = lambda v: F.lit(0)
    if again is not None:
        again = materialize(again)
        # texts with an entity that drew again, by a digest and once each; only
        # texts with entities are shuffled
        hits = rows.filter(n > 0).withColumn("__t", F.unhex(F.sha2("__text", 256)))
        parts = hits.select("__t", "__m").dropDuplicates(["__t"]).select("__t", F.explode(F.array_distinct(F.transform("__m", norm))).alias("value"))
        special = parts.join(again, "value").groupBy("__t").agg(F.map_from_entries(F.collect_list(F.struct("value", "attempt"))).alias("__again"))
        rows = (rows.filter(n == 0).withColumn("__again", F.lit(None).cast("map<string,int>"))
                    .unionByName(hits.join(special, "__t", "left").drop("__t")))
        attempt = lambda v: F.coalesce(F.try_element_at("__again", norm(v)), F.lit(0))
    rows = rows.withColumn("__s", F.transform("__m", lambda v: surrogate(v, key, attempt(v))))
    pieces = F.split("__text", ANY, -1)
    new = F.when(n == 0, F.col("__text")).otherwise(F.array_join(
        F.zip_with(pieces, F.concat("__s", F.array(F.lit(""))), lambda p, s: F.concat(p, s)), ""))
    return rows.select(*[(new if c == text_col else F.col(f"__c{i}")).alias(c) for i, c in enumerate(cols)], n.alias("n_entities"))


@register("op3_surrogates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return replace(docs, key="corpus-2024").select("doc_id", "text", "n_entities")
