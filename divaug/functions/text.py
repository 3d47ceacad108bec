"""Text expressions: normalisation, n-grams, list literals, pair fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from divaug.functions.hashing import h24

# Punctuation deleted before the whitespace split, and the
# markers of the two pair-text formats.
STRIP_CHARS = ".,?!"
NLI_MARKERS = ("Premise: ", "Hypothesis: ")
STS_MARKERS = ("Sentence 1: ", "Sentence 2: ")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalized_tokens(text) -> Column:
    """Lower-case, delete . , ? !, split on whitespace runs, drop empties."""
    t = F.lower(_c(text))
    for c in STRIP_CHARS:   # byte searches; translate() looks every character up
        t = F.replace(t, F.lit(c), F.lit(""))
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def tokens_of(df, text_col: str = "text") -> Column:
    """The normalised tokens of ``df``: the precomputed ``tokens`` column when
    the caller materialised it once, else T1 on ``text_col``."""
    return F.col("tokens") if "tokens" in df.columns else normalized_tokens(text_col)


def word_ngrams(tokens, n: int = 3) -> Column:
    """Sliding word n-grams joined by a space (empty when too short).

    Built from n shifted copies zipped together: linear in the text length
    (zip_with pads the shorter side with NULL, which the filter drops)."""
    toks = _c(tokens)
    grams = toks
    for k in range(2, n + 1):
        shifted = F.slice(toks, k, F.greatest(F.size(toks), F.lit(1)))
        grams = F.zip_with(grams, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(grams, lambda g: g.isNotNull())


def hashed_bucket(token, dims: int = 64) -> Column:
    return (h24(token) % dims).cast("int")


def split_pair(text, markers=NLI_MARKERS) -> Column:
    """G3/G4: 'A: a B: b' -> struct(a, b); NULL fields when a marker is missing."""
    t = _c(text)
    ma, mb = markers
    has = (F.locate(ma, t) > 0) & (F.locate(mb, t) > 0)
    # the text after the first marker, up to the next occurrence of either
    after = lambda m: F.element_at(F.split(t, rf"\Q{m}\E"), 2)
    a = F.substring_index(after(ma), mb, 1)
    b = after(mb)
    return F.when(has, F.struct(a.alias("a"), b.alias("b")))


def render_pair(a, b, markers=NLI_MARKERS) -> Column:
    """'Premise: {a}. Hypothesis: {b}.' (the reference's rendering)."""
    ma, mb = markers
    return F.concat(F.lit(ma), _c(a), F.lit(". " + mb), _c(b), F.lit("."))
