"""Text expressions: ids, keys, headline categories and lexicon sentiment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import HEADLINE_RULES, NEGATIVE, OTHER, POSITIVE


def clean_ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


def article_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by a bar; nulls count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.substring(F.sha1(joined.cast("binary")), 1, 16)


def text_key(text: Column, model: str) -> Column:
    """Key of a text for a model: white space collapsed, first 20 hex digits of a SHA-1."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.substring(F.sha1(F.concat(F.lit(f"{model}|"), plain).cast("binary")), 1, 20)


def headline_category(headline: Column) -> Column:
    """Category of the first rule that matches; OTHER for none and for null."""
    out = F.lit(OTHER)
    for name, pattern in reversed(HEADLINE_RULES):
        out = F.when(F.coalesce(headline.rlike(f"(?iU){pattern}"), F.lit(False)), name).otherwise(out)
    return out


def lexicon_score(text: Column) -> Column:
    """(positive - negative) / (positive + negative) words, 0 where there are none; repeats count."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    n = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    pos, neg = n(POSITIVE), n(NEGATIVE)
    return F.coalesce(F.try_divide((pos - neg).cast("double"), (pos + neg).cast("double")), F.lit(0.0))
