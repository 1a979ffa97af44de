"""Quality rules: a threshold table compiled into one projection. No user functions; the plan is a scan and a projection.

Null and empty texts: all counts 0, so they fail on length. Repeated rows: each is judged alone. Empty tables: empty result.
Extra columns pass through `judge`; its own columns replace any of the same name. Very long texts: linear in their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on as with was be by are this or from at an but not have had his her they you "
    "der die das und ist nicht ein eine zu mit den von auf im dem des sich als auch es "
    "le la les et de des un une est que qui dans pour par sur pas du en au avec "
    "el los las y del una por con para su se lo al no como más"
).split()

#: Each row: name, measure, least, most. A document is kept if every measure lies within its bounds.
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("length", "n_words", 20, None),
    ("mean word length", "word_chars / n_words", 2.0, 14.0),
    ("symbols per word", "n_symbols / n_words", None, 0.25),
    ("stop words", "n_stop_words / n_words", 0.03, None),
    ("repeated lines", "n_dup_lines / n_lines", None, 0.5),
    ("exclamation marks per word", "n_exclaims / n_words", None, 0.5),
    ("repeated windows", "n_repeat_words / n_words", None, 0.3),
]


STATISTICS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stop_words n_exclaims".split()


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, width: int = 8) -> Column:
    """Words that lie in some window of `width` words found twice or more among them."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k: F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False))
            marked = F.transform(s, lambda x, k: F.when(same(k) | ((k > 0) & same(F.greatest(k - 1, F.lit(0)))), x["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        def total(p: Column) -> Column:
            gap = F.transform(p, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - i, F.lit(width))))
            return F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(ordered, lambda s: let(starts(s), total))

    at = F.sequence(F.lit(1), F.size(words) - (width - 1))
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(words, i, width)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > width, found).otherwise(F.lit(0).cast("long"))


def statistics(body: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words and n_exclaims (all long) of a text."""
    drop = lambda pattern: F.length(F.regexp_replace(body, pattern, "")).cast("long")

    def counted(words: Column, lines: Column) -> Column:
        counts = {
            "n_words": F.size(words),
            "word_chars": drop(SPACE),
            "n_symbols": drop(r"[^#*$%&|<>]+"),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeat_words(words),
            "n_lines": F.size(lines),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
            "n_exclaims": drop(r"[^!]+"),
        }
        return F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])

    words = F.filter(F.split(body, SPACE), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words, lambda w: let(lines, lambda x: counted(w, x)))


def verdict(s: Column, table=THRESHOLDS) -> Column:
    """The table as one boolean over a struct of statistics; a measure over nothing (0 / 0) passes."""
    kept = F.lit(True)
    for _, measure, least, most in table:
        top, _, under = measure.partition(" / ")
        value = F.try_divide(s[top].cast("double"), s[under].cast("double")) if under else s[top]
        for bound, holds in ((least, lambda v, b: v >= b), (most, lambda v, b: v <= b)):
            if bound is not None:
                kept = kept & F.coalesce(holds(value, F.lit(bound)), F.lit(True))
    return kept


def judgement(text: str = "text", table=THRESHOLDS) -> Column:
    """struct of the statistics, base_failed and kept, each computed once for a row wherever the column is used."""

    def judged(s: Column) -> Column:
        failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
        return F.struct(*[s[n].alias(n) for n in STATISTICS], failed.alias("base_failed"), (~failed & verdict(s, table)).alias("kept"))

    return let(statistics(text_of(text)), judged)


def judge(docs: DataFrame, text: str = "text", table=THRESHOLDS) -> DataFrame:
    """docs with the statistics, base_failed and kept."""
    made = [*STATISTICS, "base_failed", "kept"]
    return docs.drop(*made).withColumn("__j", judgement(text, table)).select("*", *[F.col(f"__j.{n}").alias(n) for n in made]).drop("__j")


def kept_documents(docs: DataFrame, text: str = "text", table=THRESHOLDS) -> DataFrame:
    """The rows that the rules keep, with docs' own columns only."""
    return docs.where(judgement(text, table)["kept"])
