"""Names and their words, plain-English evidence, dates and numbers, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import vocabulary as V


def rx(pattern: str) -> str:
    """A pattern of the vocabulary for Spark: case aside, with Unicode letters and word bounds."""
    return f"(?iU){pattern}"


def says(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(rx(pattern)), F.lit(False))


def first_of(text: Column, table, default: Column | None = None) -> Column:
    """The value of the first (pattern, value) whose pattern is in the text."""
    return F.coalesce(*[F.when(says(text, p), v if isinstance(v, Column) else F.lit(v)) for p, v in table], F.lit(None) if default is None else default)


def given(text: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(text, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


# --- words of names


def cased(word: Column, first: Column) -> Column:
    """One word of a shouted name as it would be written."""
    low = F.lower(word)
    plain = F.concat(F.upper(F.substr(low, F.lit(1), F.lit(1))), F.substr(low, F.lit(2)))
    return F.when(low.isin(V.ACRONYMS) | (says(low, V.ROMAN) & ~first), F.upper(low)).when(low.isin(V.SMALL_WORDS) & ~first, low).otherwise(plain)


def unshouted(name: Column) -> Column:
    """Every word of a name in capitals, cased; what lies between words stays."""
    runs = F.regexp_extract_all(F.trim(name), F.lit(r"(\p{L}+(?:['’]\p{L}+)?|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w, i: F.when(w.rlike(r"^\p{L}"), cased(w, i == 0)).otherwise(w)), "")


def title(name: Column) -> Column:
    """A name that a register gives in capitals, as it would be written; any other stays."""
    return F.when(name.rlike(r"\p{Lu}") & ~name.rlike(r"\p{Ll}"), unshouted(name)).otherwise(name)


def capitalised(text: Column) -> Column:
    """Each run of letters with a capital."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


FEATURE = "|".join(p for p, *_ in V.RECORD_TYPES) + V.FEATURE_WORDS


def parts_of(text: Column) -> Column:
    """The non-empty parts between commas."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def tidy_name(name: Column, shouting: bool = False) -> Column:
    """A register's name with the thing first and where it is after it; without what stands in brackets."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"\s*\[[^\]]*\]", "")
    parts = parts_of(unshouted(bare) if shouting else bare)
    at = F.array_max(F.transform(parts, lambda p, i: F.when(says(p, FEATURE), i)))
    led = lambda ps: F.when(F.coalesce(at > 0, F.lit(False)), F.array(F.get(ps, at), F.get(ps, at - 1))).otherwise(ps)
    return F.array_join(led(parts), ", ")


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and apostrophes, without numbers, Roman ones included."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9']+)"), F.lit(1)), lambda w: ~w.rlike(r"^([ivx]+|\d+)$"))


NUMBER_BEHIND = r"\s+(?:[ivx]+|\d+)$"


def complexes(name: Column) -> Column:
    """array<struct<words, spelt>> of the parts of a name that name a whole complex (a kind of place with a distinctive word): the words without numbers, and the part as spelt, without a number behind it. The first of equal words."""
    common = V.COMPLEX_KINDS + V.COMPLEX_PARTS
    parts = F.transform(F.split(F.coalesce(name, F.lit("")), ","), lambda p: F.struct(words(p).alias("ws"), F.regexp_replace(F.trim(p), rx(NUMBER_BEHIND), "").alias("spelt")))
    kept = F.filter(parts, lambda p: F.exists(p["ws"], lambda w: w.isin(V.COMPLEX_KINDS)) & F.exists(p["ws"], lambda w: ~w.isin(common)))
    told = F.transform(kept, lambda p: F.struct(F.array_join(p["ws"], " ").alias("words"), p["spelt"].alias("spelt")))
    return F.filter(told, lambda p, i: F.array_position(F.transform(told, lambda q: q["words"]), p["words"]) == i + 1)


def complex_parts(name: Column) -> Column:
    """The words of those parts."""
    return F.transform(complexes(name), lambda p: p["words"])


def without_number(name: Column) -> Column:
    """The whole that a numbered part belongs to: its name without the number; null if it isn't one."""
    feature = F.regexp_replace(F.trim(F.split(name, ",")[0]), rx(NUMBER_BEHIND), "")
    return F.when(numbered(name).isNotNull(), F.concat_ws(", ", feature, F.trim(F.get(F.split(name, ","), F.lit(1)))))


def numbered(name: Column) -> Column:
    """"feature|place" of a name of two parts whose first ends in a number; null otherwise."""
    parts = F.transform(F.split(name, ","), lambda x: F.trim(x))
    fits = (F.size(parts) == 2) & F.get(parts, F.lit(0)).rlike(rx(r"\s+(?:[ivx]+|\d+)$"))
    return F.when(fits, F.concat_ws("|", F.array_join(words(F.get(parts, F.lit(0))), " "), F.array_join(words(F.get(parts, F.lit(1))), " ")))


def telling_words(name: Column, plain: list[str]) -> Column:
    """Words of more than three letters that aren't plain ones."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"([a-z']+)"), F.lit(1)), lambda w: (F.length(w) > 3) & ~w.isin(plain)))


def share_a_name(a: Column, b: Column) -> Column:
    return F.arrays_overlap(telling_words(a, V.PLAIN_WORDS), telling_words(b, V.PLAIN_WORDS))


def distinctive(name: Column) -> Column:
    return telling_words(name, V.PLAIN_PLACE_WORDS)


def common_start(names: Column) -> Column:
    """The words with which all names of an array begin, case aside, as the first spells them."""
    split = F.transform(names, lambda n: F.split(F.trim(n), r"\s+"))
    head = F.get(split, F.lit(0))
    same = F.transform(head, lambda w, i: F.forall(split, lambda ws: F.coalesce(F.lower(F.get(ws, i)) == F.lower(w), F.lit(False))))
    stop = F.coalesce(F.array_position(same, False), F.lit(0))
    return F.array_join(F.slice(head, F.lit(1), F.when(stop > 0, stop.cast("int") - 1).otherwise(F.size(head))), " ")


def shown_name(name: Column) -> Column:
    """A name without the state that it may end in, unless nothing else is left."""
    return F.coalesce(given(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), rx(V.STATE_IN_NAME), ""))), name)


def unnamed(name: Column) -> Column:
    return F.coalesce(name.startswith("Unnamed "), F.lit(False))


def listed_word(text: Column, listed: list[str]) -> Column:
    """The first of the listed words and phrases that stands in a text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.get(F.filter(F.array(*map(F.lit, listed)), lambda w: F.rlike(low, F.concat(F.lit(r"(?U)\b"), w, F.lit(r"\b")))), F.lit(0))


def first_segment(name: Column) -> Column:
    return F.trim(F.substring_index(name, ",", 1))


def units(said: Column) -> Column:
    """Into how many flats, dwellings or the like; null if it isn't said."""
    pattern = rx(r"\binto (\d+|" + "|".join(V.NUMBER_WORDS) + r")\s+(?:no\.?\s+)?(?:[\w-]+\s+){0,2}?(?:flats|dwellings|apartments|units|homes)\b")
    found = given(F.lower(F.regexp_extract(said, pattern, 1)))
    return F.coalesce(found.try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, V.NUMBER_WORDS)), found), F.lit(0)).cast("int"))


def excerpt(said: Column, pattern: str, size: int = 160) -> Column:
    """A text of at most `size` letters, or the part of a longer one around the first match."""
    hit = F.regexp_extract(said, f"({rx(pattern)})", 1)
    at = F.when(hit != "", F.instr(said, hit) - 1)  # from 0
    start = F.when(at.isNull() | (at + F.length(hit) <= size - 20), 0).otherwise(F.greatest(F.lit(0), at - 60))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substr(said, start + 1, F.lit(size)), F.when(start + size < F.length(said), "…").otherwise(""))
    return F.when(F.length(said) <= size, said).otherwise(cut)


def postcode_of(text: Column) -> Column:
    found = lambda g: F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), r"\b([A-Z]{1,2}\d[A-Z\d]?) ?(\d[A-Z]{2})\b", g)
    return F.when(found(1) != "", F.concat_ws(" ", found(1), found(2)))


def short_address(address: Column, n: int = 60) -> Column:
    """The first two parts of an address without postcodes, cut at a word if longer than n."""
    parts = F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.regexp_replace(F.regexp_replace(p, rx(V.POSTCODE), ""), "^[ ,]+|[ ,]+$", ""))
    name = F.array_join(F.slice(F.filter(parts, lambda p: p != ""), 1, 2), ", ")
    return F.when(F.length(name) > n, F.regexp_replace(F.substr(name, F.lit(1), F.lit(n)), r" [^ ]*$", "")).otherwise(name)


def house_key(council: Column, address: Column) -> Column:
    """council|the first three words of an address, however it goes on; null if it says too little."""
    plain = F.trim(F.regexp_replace(F.coalesce(address, F.lit("")), rx(V.POSTCODE), " "))
    ws = F.regexp_extract_all(F.lower(F.regexp_replace(plain, rx(V.NEAR_WORDS), "")), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.when((F.size(ws) >= 2) & (council != ""), F.concat_ws("|", council, F.array_join(F.slice(ws, 1, 3), " ")))


# --- evidence in plain English


def a(thing: Column) -> Column:
    return F.concat(F.when(F.lower(thing).rlike("^[aeiou]"), "an ").otherwise("a "), thing)


def plain_tag_evidence(evidence: Column) -> Column:
    """What a map's tags say of a place."""
    form, named = r"^OSM: (abandoned|disused):(\w+)=([^\s(]+)\s*(.*)$", r"^OSM: (\w+) says '(.+)'$"
    state, key, value, rest = (F.regexp_extract(evidence, form, i) for i in range(1, 5))
    thing = F.concat(F.replace(F.when(value == "yes", key).otherwise(value), F.lit("_"), F.lit(" ")), F.when((key == "shop") & (value != "yes"), " shop").otherwise(""))
    life = F.concat(F.lit("OpenStreetMap lists it as "), a(F.concat_ws(" ", state, thing)), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise(""))
    where, word = (F.regexp_extract(evidence, named, i) for i in (1, 2))
    text = F.concat(F.when(where == "name", "Its name says '").otherwise(F.concat(F.lit("Its OpenStreetMap "), where, F.lit(" says '"))), word, F.lit("'"))
    out = F.when(evidence.rlike(form), life).when(evidence.rlike(named), text)
    for prefix, said in V.PLAIN_TAG_EVIDENCE:
        out = out.when(evidence.startswith(prefix), F.concat(F.lit(said), F.substr(evidence, F.lit(len(prefix) + 1))))
    return out.otherwise(F.concat(F.lit("OpenStreetMap: "), F.regexp_replace(evidence, "^OSM: ", "")))


def plain_item_evidence(evidence: Column) -> Column:
    """array: what an item's record says of a place, then whatever else is told after semicolons."""
    parts = F.split(evidence, "; ")
    first, out = F.get(parts, F.lit(0)), None
    for form, said in (
        (r"^Wikidata: state of use is '(.+)'$", "Wikidata records its state of use as '$1'"), (r"^Wikidata: closed in (\d{4})$", "Wikidata says it closed in $1"),
        (r"^Wikidata: old (.+)$", "Wikidata lists it as an old $1"), (r"^Wikidata: listed as (.+)$", "Wikidata lists it as $1"), (r"^Wikidata: (.+)$", "Wikidata lists it as a $1"),
    ):
        made = F.regexp_replace(first, form, said)
        out = F.when(first.rlike(form), made) if out is None else out.when(first.rlike(form), made)
    return F.concat(F.array(out.otherwise(first)), F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))))


# --- names from tags


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def best_name(tags: Column) -> Column:
    return F.coalesce(*[given(tag(tags, k)) for k in V.NAME_KEYS])


def alt_names(tags: Column) -> Column:
    lists = [F.split(F.coalesce(tag(tags, k), F.lit("")), ";") for k in V.ALT_NAME_KEYS]
    listed = F.transform(F.flatten(F.array(*lists)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(listed, lambda n: (n != "") & ~n.eqNullSafe(tag(tags, "name"))))


def kind_of_tags(tags: Column) -> Column:
    told = [F.when(~v.isin("yes", "ruins", ""), F.replace(v, F.lit("_"), F.lit(" "))) for k in V.KIND_KEYS for v in (tag(tags, p + k) for p in ("", "abandoned:", "disused:"))]
    return F.when(tag(tags, "natural") == "cave_entrance", "cave entrance").otherwise(F.coalesce(*told, F.lit("structure")))


def article_title(url: Column) -> Column:
    """The title of an encyclopaedia's page."""
    return F.replace(F.try_url_decode(F.replace(F.substring_index(url, "/", -1), F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))


# --- dates and numbers


def dated(text: Column) -> Column:
    """A register's date as a day (ISO text) or a bare year: from ISO text, or day, month and year between slashes, dots or dashes, whatever follows."""
    plain = F.trim(text)
    dmy = lambda g: F.regexp_extract(plain, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", g)
    made = F.try_to_date(F.concat_ws("-", dmy(3), dmy(2), dmy(1)), "yyyy-M-d")
    return F.coalesce(given(F.regexp_extract(plain, r"^\d{4}-\d{2}-\d{2}", 0)), F.when(dmy(1) != "", F.date_format(made, "yyyy-MM-dd")), given(F.regexp_extract(plain, r"^\d{4}$", 0)))


def dated_ms(ms: Column) -> Column:
    """The day (ISO text) of milliseconds since 1970, in UTC; fractions are dropped."""
    return F.date_format(F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(ms / 86_400_000).cast("int")), "yyyy-MM-dd")


def day_month_year(text: Column, separator: str = "/") -> Column:
    """A day of numbers between separators, or null."""
    part = lambda g: F.regexp_extract(F.trim(text), rf"^(\d{{1,2}}){separator}(\d{{1,2}}){separator}(\d{{4}})$", g)
    return F.try_to_date(F.concat_ws("-", part(3), part(2), part(1)), "yyyy-M-d")


def named_day(text: Column) -> Column:
    """A day such as 3 March 2021."""
    return F.coalesce(F.try_to_date(text, "d MMMM yyyy"), F.try_to_date(text, "d MMM yyyy"))


def years_since(day: Column, as_of: Column) -> Column:
    return F.datediff(as_of, day) / 365.25


def closed_school_day(text: Column) -> Column:
    """The day a school closed; years before 1950 stand for 'not recorded'."""
    found = day_month_year(text, "-")
    return F.when(F.year(found) >= 1950, found)


def number(text: Column) -> Column:
    """A number with thousands separators; 0 for anything else."""
    return F.coalesce(F.replace(text, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def year_end(when: Column) -> Column:
    """A date (text) to sort by: a bare year counts as its end."""
    return F.concat(when, F.when(F.length(when) == 4, "-12-31").otherwise(""))


def latest_date(dates: Column, as_of: Column) -> Column:
    """The latest of an array of struct<what, when> that isn't still to come; the first of equal ones. A bare year has come once it has begun."""
    past = F.filter(dates, lambda d: given(d["when"]).isNotNull() & (F.when(F.length(d["when"]) > 4, d["when"]).otherwise(F.concat(d["when"], F.lit("-01-01"))) <= as_of))
    best = F.array_max(F.transform(past, lambda d, i: F.struct(year_end(d["when"]).alias("at"), (-i).alias("seq"), d["what"].alias("what"), d["when"].alias("when"))))
    return F.when(best.isNotNull(), F.struct(best["what"].alias("what"), best["when"].alias("when")))


def site_dates(dates: Column, visited: Column, as_of: Column) -> Column:
    """struct<any, all>: the last day (ISO text) that any source dates a place by, and that or a visitor's report. Future years count as today, future days not."""
    days = F.transform(dates, lambda d: F.when(F.length(d["when"]) == 4, F.least(F.concat(d["when"], F.lit("-12-31")), as_of)).otherwise(F.substr(d["when"], F.lit(1), F.lit(10))))
    latest = F.array_max(F.filter(days, lambda d: given(d).isNotNull() & (d <= as_of)))
    return F.struct(latest.alias("any"), F.greatest(latest, F.when(visited <= as_of, visited)).alias("all"))


def clamped(x: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
