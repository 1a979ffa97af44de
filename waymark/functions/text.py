"""Names, addresses and dates as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import vocabulary as V
from waymark.functions.judges import condition_of_text as condition  # noqa: F401
from waymark.functions.names import dated as day  # noqa: F401


def strength(score: Column) -> Column:
    return F.when(score >= V.STRONG_SCORE, "strong").when(score >= V.GOOD_SCORE, "good").otherwise("weak")


def norm(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def article(noun: Column) -> Column:
    return F.concat(F.when(F.lower(noun).rlike("^[aeiou]"), "an ").otherwise("a "), noun)


def slug(label: Column, name: Column, lat: Column, lng: Column) -> Column:
    """label:name-slug:lat,lng."""
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(label, F.lit(":"), plain, F.lit(":"), F.format_string("%.5f,%.5f", lat, lng))


def entities(text: Column) -> Column:
    """The five XML entities, &#47; and &nbsp; resolved."""
    for entity, letter in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return text


def html_text(html: Column) -> Column:
    """Visible text: without scripts, styles, tags and doubled white space; the five XML entities and &nbsp; resolved."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, letter in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(letter))
    return squashed(out)
