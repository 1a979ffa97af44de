"""PII: surrogate generation. DataFrame functions only.

Entities are found by one pattern: e-mail addresses, IPv4 addresses, phone, card and social-security numbers, access tokens, and
names after a title. Each is broken into units (a name has a given name and a surname; the rest are one), each with a normal form, so that all
spellings of a unit share it. A keyed hash of kind and normal form makes the unit's surrogate of the same kind: digits for digits with
the same length and separators (card numbers keep whether their check digit holds, phone numbers their country code), hexadecimal
for hexadecimal in the same case, names of the same gender and script. Collision checks run over all distinct units: a surrogate that another unit
has, or that is itself a unit of the corpus, is drawn again until there is none; so different units stay different and equal ones equal, over all documents.
Surnames are taken whole, with apostrophes, hyphens, inner capitals and particles; one surrogate word stands for all of a compound. A surname found after a title is replaced wherever it recurs in the same text, with or without one; a word that is no one's surname there is left alone.

The pattern goes over each text once: rows are kept in the shared folder with their entities and a number of their own, and all that follows reads
that table. Only texts with entities are split and joined.

Null text: stays null. Empty texts and texts without entities: unchanged. Repeated rows and ties: each rewritten alike. Empty table: no rows. Very
long texts: linear in their length. Null ids and nulls in other columns: kept. All columns pass through, whatever their names; n_replaced replaces a column of
that name. A very common entity is one row of the table of entities; the join back is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spare, staged

# Words that stand before a surname and belong to it.
PARTICLES = "(?i:van|von|vom|zu|zum|zur|der|den|de|del|della|di|da|do|dos|das|du|des|la|las|le|los|ter|ten|bin|ibn|al|el|st)"
#: A word of a name: capitals within it, apostrophes, hyphens and marks belong to it; a possessive 's doesn't.
WORD = r"\p{Lu}(?:[\p{L}\p{M}]|-(?=\p{L})|['’](?!s(?![\p{L}\p{M}]))(?=\p{L}))+"
SURNAME = rf"(?:{PARTICLES}\.? ){{0,3}}{WORD}"
# Patterns of each kind, tried in this order.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "card": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){3}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d\w])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "token": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}])(?:Mrs|Mr|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Г-н|Г-жа|господин|госпожа)\.? {SURNAME}(?: {SURNAME})?",
}
# Titles by gender; Dr tells none.
TITLES = {"m": "Mr Herr Monsieur Señor Sr Г-н господин".split(), "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Г-жа госпожа".split()}
# Syllables of surrogate names, sixteen for each script, and endings by gender.
SYLLABLES = {"latin": "ba de fi ga ho ka le mi no pa ro sa ti ve wi zo".split(), "cyrillic": "ба де фи га хо ка ле ми но па ро са ти ве ви зо".split()}
ENDINGS = {"latin": {"m": "rt", "f": "na", "n": "l"}, "cyrillic": {"m": "р", "f": "на", "n": "ль"}}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def given_of(entity: Column) -> Column:
    """The given name of a name after a title; empty if there is none: the first of several words that isn't a surname's particle."""
    return F.regexp_extract(entity, rf"^\S+ ((?!{PARTICLES}\.? ){WORD}) ", 1)


def surname_of(entity: Column) -> Column:
    """The surname of a name after a title, with its particles and all parts of a compound."""
    given = given_of(entity)
    return F.substr(entity, F.instr(entity, F.lit(" ")) + 1 + F.when(given == "", 0).otherwise(F.length(given) + 1))


def units_of(kind: Column, entity: Column) -> Column:
    """array<struct<kind, norm>>, in the order of the text."""
    unit = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    title = F.regexp_extract(entity, r"^[^. ]+", 0)
    gender = F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")
    script = F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    plainly = lambda n: F.translate(F.lower(n), "’", "'")
    surname, given = unit(F.concat_ws(" ", F.lit("surname"), script, F.lit("n")), plainly(surname_of(entity))), unit(F.concat_ws(" ", F.lit("given"), script, gender), plainly(given_of(entity)))
    named = F.when(given_of(entity) == "", F.array(surname)).otherwise(F.array(given, surname))
    plain = F.when(kind == "phone", F.right(_digits(entity), F.lit(10))).when(kind.isin("card", "ssn"), _digits(entity)).when(kind.isin("email", "token"), F.lower(entity)).otherwise(entity)
    return F.when(kind == "name", named).otherwise(F.array(unit(kind, plain)))


def _luhn(digits: Column) -> Column:
    """Sum of the card check over digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _item(of: Column):
    return lambda i: F.get(of, i)


def surrogate(kind: Column, norm: Column, attempt: Column, secret: str) -> Column:
    """The unit's surrogate in normal form; another one for each attempt."""
    seed = F.concat_ws("\x1f", F.lit(secret), kind, norm, attempt.cast("string"))
    hexes = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))
    nibble = lambda i: F.conv(F.substr(hexes, i, F.lit(1)), 16, 10).cast("int")
    byte = lambda i: F.conv(F.substr(hexes, i, F.lit(2)), 16, 10).cast("int")
    digit = lambda i: F.pmod(byte(2 * i - 1), F.lit(10)).cast("string")
    number = F.array_join(F.transform(F.sequence(F.lit(1), F.length(norm)), digit), "")
    # a phone's first digit is never 0 or 1
    phone = F.concat((2 + F.pmod(nibble(F.lit(1)), F.lit(8))).cast("string"), F.substr(number, F.lit(2)))
    stem = F.substr(number, F.lit(1), F.length(number) - 1)
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(stem, F.lit("0"))), F.lit(10)), F.lit(10))
    holds = F.pmod(_luhn(norm), F.lit(10)) == 0
    last = F.when(holds, check).otherwise(F.pmod(check + 1 + F.pmod(nibble(F.lit(60)), F.lit(9)), F.lit(10))).cast("string")
    octets = F.concat_ws(".", *[(1 + F.pmod(byte(F.lit(4 * i + 1)) * 256 + byte(F.lit(4 * i + 3)), F.lit(223))).cast("string") for i in range(4)])
    email = F.concat(F.lit("user"), F.substr(hexes, F.lit(1), F.lit(16)), F.lit("@example."), F.substring_index(norm, ".", -1))
    token = F.substr(hexes, F.lit(1), F.length(norm))
    out = F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", F.concat(stem, last)).when(kind == "ssn", number).when(kind == "phone", phone).when(kind == "token", token)
    for script, syllables in SYLLABLES.items():
        listed = F.array(*map(F.lit, syllables))
        # one more syllable for each attempt, so that names never run out
        drawn = F.transform(F.sequence(F.lit(1), F.lit(3) + F.least(attempt, F.lit(20))), nibble)
        stem = F.array_join(F.transform(drawn, _item(listed)), "")
        for gender, ending in ENDINGS[script].items():
            out = out.when(kind.endswith(f"{script} {gender}"), F.concat(stem, F.lit(ending)))
    return out


def render(kind: Column, entity: Column, fresh: Column) -> Column:
    """entity with the surrogates of its units (array, in order) in its own format."""
    first = F.get(fresh, F.lit(0))
    after = lambda i: F.length(_digits(F.substr(entity, i + 1)))  # noqa: E731  digits from here on
    shaped = F.array_join(
        F.transform(F.split(entity, ""), lambda ch, i: F.when(ch.rlike("[0-9]") & (after(i) <= F.length(first)), F.substr(first, F.length(first) - after(i) + 1, F.lit(1))).otherwise(ch)), ""
    )
    # names in capitals stay so
    loud = F.upper(surname_of(entity)) == surname_of(entity)
    named = F.concat_ws(" ", F.substring_index(entity, " ", 1), F.array_join(F.transform(fresh, lambda x: F.when(loud, F.upper(x)).otherwise(F.initcap(x))), " "))
    # a token in capitals stays one; of mixed case, each letter keeps the case of its place
    mixed = F.array_join(F.transform(F.split(entity, ""), lambda ch, i: F.when(ch.rlike("[A-F]"), F.upper(F.substr(first, i + 1, F.lit(1)))).otherwise(F.substr(first, i + 1, F.lit(1)))), "")
    token = F.when(~entity.rlike("[A-F]"), first).when(~entity.rlike("[a-f]"), F.upper(first)).otherwise(mixed)
    return F.when(kind == "name", named).when(kind.isin("card", "ssn", "phone"), shaped).when(kind == "token", token).otherwise(first)


def distinct_surrogates(units: DataFrame, secret: str) -> DataFrame:
    """(kind, norm, fresh) of distinct units (kind, norm): no two alike within a kind, none a unit itself."""
    known = staged(units.distinct(), "units")
    mapped = known.withColumn("attempt", F.lit(0))
    for step in range(30):
        mapped = mapped.withColumn("fresh", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), secret))
        taken = known.select("kind", F.col("norm").alias("fresh"), F.lit(True).alias("taken"))
        rank = F.row_number().over(Window.partitionBy("kind", "fresh").orderBy("attempt", "norm"))
        judged = mapped.withColumn("rank", rank).join(taken, ["kind", "fresh"], "left").withColumn("again", (F.col("rank") > 1) | F.coalesce("taken", F.lit(False)))
        judged = staged(judged.select("kind", "norm", "attempt", "fresh", "again"), f"surrogates-{step}")
        if judged.where("again").isEmpty():
            return judged.select("kind", "norm", "fresh")
        mapped = judged.select("kind", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    raise RuntimeError("surrogates keep colliding")


def replace(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """docs with the entities of `text` replaced, and n_replaced."""
    docs = docs.drop("n_replaced")
    held, row, fresh = (spare(docs.columns, n) for n in ("__entities", "__row", "__fresh"))
    marked = staged(docs.withColumns({held: F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)), row: F.monotonically_increasing_id()}), "marked")
    hits = marked.where(F.size(held) > 0)
    found = hits.select(F.explode(held).alias("entity")).distinct().withColumn("kind", kind_of(F.col("entity")))
    found = staged(found.withColumn("units", units_of(F.col("kind"), F.col("entity"))), "entities")
    each = found.select("entity", F.posexplode("units").alias("at", "unit")).select("entity", "at", "unit.kind", "unit.norm")
    table = distinct_surrogates(each.select("kind", "norm"), secret)
    drawn = each.join(table, ["kind", "norm"]).groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "fresh"))), lambda x: x["fresh"]).alias("fresh"))
    lookup = staged(found.join(drawn, "entity").select("entity", (F.col("kind") == "name").alias("named"), render(F.col("kind"), F.col("entity"), F.col("fresh")).alias("surrogate")), "lookup")
    placed = hits.select(F.col(row), F.posexplode(held).alias("at", "entity")).join(lookup, "entity")
    lists = placed.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("at", "surrogate", "entity", "named"))).alias(fresh))
    made = F.transform(F.col(fresh), lambda x: x["surrogate"])
    joined = F.array_join(F.flatten(F.zip_with(F.split(F.col(text), ANY, -1), made, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    last = lambda c: F.substring_index(c, " ", -1)  # noqa: E731  a surrogate surname is one word
    surnames = F.array_distinct(F.transform(F.filter(F.col(fresh), lambda x: x["named"]), lambda x: F.struct(surname_of(x["entity"]).alias("old"), last(x["surrogate"]).alias("new"))))
    alone = lambda name: F.concat(F.lit(r"(?<![\p{L}'’-])"), name, F.lit(r"(?![\p{L}’-]|'\p{L}{2})"))  # noqa: E731  a possessive 's is no part of a name
    whole = F.aggregate(surnames, joined, lambda body, x: F.regexp_replace(body, alone(x["old"]), x["new"]))
    changed = hits.join(lists, row).withColumn(text, whole).withColumn("n_replaced", F.size(fresh).cast("long"))
    same = marked.where(F.coalesce(F.size(held) <= 0, F.lit(True))).withColumn("n_replaced", F.lit(0).cast("long"))
    columns = [*[F.col(f"`{c}`") for c in docs.columns], "n_replaced"]
    return same.select(*columns).unionAll(changed.select(*columns))
