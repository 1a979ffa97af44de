"""Council papers: where a report says that a place stands empty, which application that belongs to, and the lists that papers are found in.

A paper is a row (paper, pages: the text of each). Places in its text are rows: positions come from the lengths of what stands between two finds, so everything stays in native columns
and in the paper's own row, without a shuffle. Null pages count as empty; papers without pages, or without a phrase, give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import vocabulary as V
from waymark.functions.names import given, let, postcode_of, says
from waymark.functions.text import entities, squashed

CONTEXT = 400  # fixed value: characters looked at on either side of a phrase
UNIX = "(?Ud)"  # Unicode classes; lines end with \n alone



def _phrases() -> str:
    """All phrases as one pattern: those that begin with the same word stand together, behind a look at the first letter, so that most places of a text are given up at once."""
    by: dict[str, list[str]] = {}
    for phrase in V.PAPER_PHRASES:
        first, *rest = phrase.split()
        by.setdefault(first, []).append("".join(rf"\s+{word}" for word in rest))
    letters = "".join(sorted({first[0] for first in by}))
    return f"(?=[{letters}])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items()) + ")"


PHRASE = _phrases()


def running(lengths: Column) -> Column:
    """The sum of all numbers before each of an array."""
    none = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("before"))
    return F.aggregate(lengths, none, lambda a, x: F.struct((a["n"] + x).alias("n"), F.concat(a["before"], F.array(a["n"])).alias("before")))["before"]


def located(text: Column, pattern: str, flags: str = "U") -> Column:
    """array<struct<at, upto, words>>: all finds of a pattern, one after another; at and upto are characters before and up to the end of each. The pattern's own groups aren't looked at. \\G holds each try to the end of the find before, so that text after the last one is read once."""
    parts = lambda g: F.regexp_extract_all(text, F.lit(rf"(?{flags}s)\G(.*?)({pattern})"), F.lit(g))
    at = lambda x, s: s + F.length(x["gap"])

    def placed(both: Column) -> Column:
        starts = running(F.transform(both, lambda x: F.length(x["gap"]) + F.length(x["words"])))
        return F.zip_with(both, starts, lambda x, s: F.struct(at(x, s).alias("at"), (at(x, s) + F.length(x["words"])).alias("upto"), x["words"].alias("words")))

    return let(F.arrays_zip(parts(1).alias("gap"), parts(2).alias("words")), placed)


def last_before(finds: Column, at: Column) -> Column:
    """The last find that ends at or before a place."""
    return F.try_element_at(F.filter(finds, lambda f: f["upto"] <= at), F.lit(-1))


def part(text: Column, start: Column, end: Column) -> Column:
    """Characters of text from start (counted from 0) up to end."""
    low = F.greatest(F.lit(0), start)
    return F.substr(text, low + 1, F.greatest(F.lit(0), end - low))


def sentence_around(text: Column, at: Column, upto: Column) -> Column:
    """The sentence, or the clause of a list, that holds the characters from at up to upto, without its paragraph number. Where no full stop is near, 200 characters on either side."""
    end = V.SENTENCE_END
    before, after = squash(part(text, at - CONTEXT, at)), squash(part(text, upto, upto + CONTEXT))
    ended, stops = before.rlike(f"{UNIX}{end}"), after.rlike(f"{UNIX}{end}")
    head = F.when(ended, F.regexp_extract(before, f"{UNIX}(?s)^.*(?:{end})(.*)$", 1)).otherwise(F.right(before, F.lit(200)))
    tail = F.when(stops, F.regexp_extract(after, f"{UNIX}(?s)^(.*?(?:{end}))", 1)).otherwise(F.left(after, F.lit(200)))
    whole = F.concat(F.substring_index(head, ";", -1), squash(part(text, at, upto)), F.substring_index(tail, ";", 1))
    return F.regexp_replace(F.regexp_replace(whole, r"(?U)^\s+|\s+$", ""), r"(?U)^\d+(?:\.\d+)+\.?\s+", "")


def squash(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def passages(papers: DataFrame) -> DataFrame:
    """(paper, at, upto, page, phrase, text, head_at, head, ref, easting, northing) of each phrase in each paper: its application is the last one labelled before it, on whatever page.

    Without a label: the first reference that stands alone after a point 1,500 characters before the last site named before it (or 20,000 characters before the phrase). head: the text from there up to the phrase."""
    pages = F.transform(F.coalesce("pages", F.array().cast("array<string>")), lambda p: F.concat(F.coalesce(p, F.lit("")), F.lit("\n")))
    told = papers.select("paper", pages.alias("pages"), F.array_join(pages, "").alias("text")).where(F.col("text").rlike(f"(?iU){PHRASE}"))
    # labels are located before phrases become rows: once for each paper, not for each phrase in it
    labelled = told.select(
        "paper", "text", running(F.transform("pages", lambda p: F.length(p))).alias("starts"), located(F.col("text"), V.PAPER_REF).alias("refs"), located(F.col("text"), V.PAPER_SITE + ".", "Ud").alias("sites"),
    )
    found = labelled.select("paper", "text", "starts", "refs", "sites", F.explode(located(F.col("text"), PHRASE, "iU")).alias("hit"))
    at, ref = F.col("hit.at"), last_before(F.col("refs"), F.col("hit.at"))
    site = last_before(F.col("sites"), at)
    start = F.coalesce(ref["at"], F.greatest(F.lit(0), site["at"] - 1500), F.greatest(F.lit(0), at - 20_000))
    headed = found.select("paper", "text", "starts", "hit", start.alias("head_at"), part(F.col("text"), start, at).alias("head"), ref["words"].alias("labelled"))
    head = F.col("head")
    number = F.coalesce(F.regexp_extract("labelled", f"(?U){V.PAPER_REF}", 1), F.regexp_extract(F.left(head, F.lit(3000)), f"(?U){V.PAPER_BARE_REF}", 0))
    grid = lambda g: F.regexp_extract(F.left(head, F.lit(5000)), f"(?iU){V.PAPER_GRID}", g).try_cast("int")
    return headed.select(
        "paper", "hit.at", "hit.upto", F.size(F.filter("starts", lambda s: s <= at)).alias("page"), F.lower(squash(F.col("hit.words"))).alias("phrase"), "text", "head_at", "head",
        F.regexp_replace(number, r"[.,]+$", "").alias("ref"), grid(1).alias("easting"), grid(2).alias("northing"),
    )


def statements(papers: DataFrame) -> DataFrame:
    """(paper, at, page, phrase, sentence, ref, site, proposal, easting, northing): sentences that say it of the site itself, not of a neighbour, a rule, or a building that has gone; questions and very long ones are left out."""
    # as a row of its own, a sentence is made once, whatever is asked of it
    rows = passages(papers).select("*", F.explode(F.array(sentence_around(F.col("text"), F.col("at"), F.col("upto")))).alias("sentence"))
    said = F.col("sentence")
    fits = ~says(said, V.PAPER_ELSEWHERE) & ~says(said, V.PAPER_RULE) & ~says(said, V.PAPER_GONE) & ~F.endswith(said, F.lit("?")) & (F.length(said) <= V.LONGEST_SENTENCE)
    value = lambda label: F.regexp_replace(squash(F.regexp_extract("head", f"{UNIX}(?s){label}{V.PAPER_VALUE}", 1)), "^[ ,]+|[ ,]+$", "")
    site = F.left(F.regexp_replace(value(V.PAPER_SITE), r"(?U)^(?:Comments|Details)\s+", ""), F.lit(200))
    return rows.where(fits).select("paper", "at", "page", "phrase", "sentence", "ref", site.alias("site"), F.left(value(V.PAPER_PROPOSAL), F.lit(300)).alias("proposal"), "easting", "northing")


def tidy_address(site: Column) -> Column:
    """An address without its postcode, and without a last part in capitals (a parish) unless all are."""
    bare = F.regexp_replace(F.coalesce(site, F.lit("")), r"(?U)\b([A-Z]{1,2}\d[A-Z\d]?) ?(\d[A-Z]{2})\b", "")
    parts = F.filter(F.transform(F.split(bare, ","), lambda p: F.trim(p)), lambda p: p != "")
    loud = lambda p: (p == F.upper(p)) & (p != F.lower(p))
    drop = (F.size(parts) > 1) & loud(F.try_element_at(parts, F.lit(-1))) & F.exists(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: ~loud(p))
    return F.array_join(F.when(drop, F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))).otherwise(parts), ", ")


def addressed(rows: DataFrame) -> DataFrame:
    """Statements with the address and postcode of their site."""
    return rows.withColumns({"address": tidy_address(F.col("site")), "postcode": postcode_of(F.col("site"))})


def wound_up(name: Column) -> Column:
    """Whether a committee's name tells years that ended before papers are worth reading."""
    last = F.regexp_extract(name, r"(?U)\b(?:19|20)\d\d\s*[-–]\s*((?:19|20)\d\d)\b", 1)
    return F.coalesce(last.try_cast("int") < V.COMMITTEES_SINCE, F.lit(False))


def search_hits(pages: DataFrame) -> DataFrame:
    """(id, n, committee, meeting, item, url, title) of the papers on saved pages of search results (id, base, html), in their order; meetings without a paper are left out, dates that don't exist are empty."""
    blocks = located(F.col("html"), V.SEARCH_MEETING)
    upto = F.transform(blocks, lambda b, i: F.coalesce(F.try_element_at(blocks, i + 2)["at"], F.length("html")))
    rows = pages.select("id", "base", "html", F.posexplode(F.arrays_zip(blocks.alias("m"), upto.alias("upto"))).alias("n", "b"))
    rows = rows.select("id", "base", "n", F.col("b.m.words").alias("meeting"), part(F.col("html"), F.col("b.m.upto"), F.col("b.upto")).alias("block"))
    of = lambda g: F.regexp_extract("meeting", f"(?Us){V.SEARCH_MEETING}", g)
    document, plain = lambda g: F.regexp_extract("block", V.SEARCH_DOCUMENT, g), lambda c: squashed(entities(F.regexp_replace(c, "<[^>]+>", " ")))
    day = F.concat_ws("-", of(3), of(2), of(1)).try_cast("date")
    told = rows.where(given(document(1)).isNotNull())
    return told.select(
        "id", "n", plain(of(4)).alias("committee"), F.coalesce(day.cast("string"), F.lit("")).alias("meeting"), plain(F.regexp_extract("block", V.SEARCH_ITEM, 1)).alias("item"),
        F.concat("base", F.lit("/"), entities(document(1))).alias("url"), plain(document(2)).alias("title"),
    )
