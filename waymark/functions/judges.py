"""Judges: what a record says of a place, what that is worth, and the evidence in words. Native columns, in ordered cascades built from the vocabulary.

A judge is null where a record is no lead. Days are date columns, `as_of` is the day that counts as today.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import names as N
from waymark.functions import vocabulary as V
from waymark.functions.names import first_of, given, let, rx, says, tag

NULL = F.lit  # NULL(None)


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def first_match(cases: list[tuple[Column, dict]], fields: list[str]) -> Column:
    """A struct of the fields of the first case that holds."""
    made = [F.when(F.coalesce(c, F.lit(False)), F.struct(*[(v[f] if isinstance(v[f], Column) else F.lit(v[f])).alias(f) for f in fields])) for c, v in cases]
    return F.coalesce(*made)


def cases_of(rows) -> list:
    return [(c, {"evidence": e, "weight": w}) for c, e, w in rows]


def leads(judged: Column) -> Column:
    """The fields of what a judge says, in rows for records that are leads alone. A filter on the judge would move below what it is made of, and work out each tag anew wherever the judge names it."""
    return F.inline(F.filter(F.array(judged), lambda j: j.isNotNull()))


def with_lead(rows: DataFrame, judged: Column) -> DataFrame:
    """The rows that a judge takes for leads, with what it says as j; see `leads`."""
    return rows.select("*", F.explode(F.filter(F.array(judged), lambda j: j.isNotNull())).alias("j"))


# --- tagged map features


def not_a_place(tags: Column) -> Column:
    keys = [p + k for k in ("amenity", "man_made", "street_furniture") for p in ("", "disused:", "abandoned:")]
    return F.exists(F.array_compact(F.transform(F.array(*map(F.lit, keys)), lambda k: F.try_element_at(tags, k))), lambda v: v.isin(V.NOT_PLACES))


def is_heritage_site(tags: Column) -> Column:
    visited = tag(tags, "historic").isin("castle", "abbey", "monastery", "archaeological_site") | tag(tags, "tourism").isin("attraction", "museum")
    return F.coalesce(visited, F.lit(False)) | given(tag(tags, "opening_hours")).isNotNull() | given(tag(tags, "fee")).isNotNull() | says(tag(tags, "operator"), V.HERITAGE_OPERATORS)


def _lifecycle(tags: Column, state: str) -> Column:
    """What stands behind the first lifecycle prefix on a feature's own key. Lines on the ground count in tunnels alone."""
    tunnel = F.coalesce(tag(tags, "tunnel") != "no", F.lit(False))
    held = F.transform(F.array(*map(F.lit, V.FEATURE_KEYS)), lambda base: F.struct(base.alias("base"), F.try_element_at(tags, F.concat(F.lit(f"{state}:"), base)).alias("v")))
    first = F.get(F.filter(held, lambda x: x["v"].isNotNull() & (tunnel | ~x["base"].isin(V.LINEAR_KEYS) | ~x["v"].isin(V.LINEAR_VALUES))), F.lit(0))
    return F.when(tunnel & first["v"].isin(V.LINEAR_VALUES), f"{state} railway tunnel").otherwise(F.concat(F.lit(f"{state}:"), first["base"], F.lit("="), first["v"]))


def classify_tags(tags: Column, element: Column) -> Column:
    """struct<evidence, weight> of a feature's tags; element: node, way or relation."""
    t = lambda k: tag(tags, k)
    tunnel = F.coalesce(t("tunnel") != "no", F.lit(False))
    dead = F.coalesce(*[F.when(says(t(k), V.DEAD_WORDS), F.concat(F.lit(f"OSM: {k} says '"), F.lower(F.regexp_extract(t(k), rx(V.DEAD_WORDS), 1)), F.lit("'"))) for k in V.TEXT_KEYS])
    gone, left = _lifecycle(tags, "abandoned"), _lifecycle(tags, "disused")
    mine = F.coalesce(*[F.when(t(k) == v, F.lit(f"OSM: old mine or quarry ({k}={v})")) for k, v in V.MINE_TAGS])
    bunker = (t("military") == "bunker") | (t("building") == "bunker") | t("historic").isin("bunker", "pillbox")
    any_of = lambda *cs: F.greatest(*[F.coalesce(c, F.lit(False)) for c in cs])
    judged = first_match(
        cases_of([
            (any_of(t("building").isin("ruins", "abandoned"), t("ruins") == "yes"), F.concat(F.lit("OSM: building="), F.coalesce(t("building"), F.lit("ruins"))), V.TAG_STRONG),
            (t("abandoned") == "yes", "OSM: abandoned=yes", V.TAG_STRONG),
            (gone.isNotNull(), F.concat(F.lit("OSM: "), gone), V.TAG_STRONG),
            (tunnel & t("railway").isin("abandoned", "disused"), F.concat(F.lit("OSM: "), t("railway"), F.lit(" railway tunnel")), V.TAG_STRONG),
            (dead.isNotNull(), dead, V.TAG_MEDIUM),
            (t("disused") == "yes", "OSM: disused=yes", V.TAG_MEDIUM),
            (left.isNotNull(), F.concat(F.lit("OSM: "), left), V.TAG_MEDIUM),
            (mine.isNotNull(), mine, V.TAG_MEDIUM),
            (any_of(t("military") == "bunker", t("building") == "bunker", t("historic").isin("bunker", "pillbox")), F.concat(F.lit("OSM: military bunker ("), F.coalesce(given(t("bunker_type")), given(t("historic")), F.lit("bunker")), F.lit(")")), V.TAG_MEDIUM),
            (t("historic") == "railway_station", "OSM: former railway station (historic=railway_station)", V.TAG_MEDIUM),
            (t("natural") == "cave_entrance", "OSM: cave entrance", V.TAG_CAVE),
            (t("historic") == "ruins", "OSM: historic=ruins (often a heritage site)", V.TAG_WEAK),
            (t("landuse") == "brownfield", "OSM: landuse=brownfield", V.TAG_WEAK),
        ]),
        ["evidence", "weight"],
    )
    pair = lambda e, w: F.struct(e.alias("evidence"), F.lit(w).alias("weight"))

    def demoted(j: Column) -> Column:
        open_ruin = (j["weight"] == V.TAG_STRONG) & j["evidence"].rlike("building=|ruins") & is_heritage_site(tags)
        unit = (element == "node") & (j["weight"] == V.TAG_MEDIUM) & j["evidence"].rlike("^OSM: (" + "|".join(V.POINT_UNIT_KEYS) + ")")
        return F.when(open_ruin, pair(F.concat(j["evidence"], F.lit(" (heritage site open to visitors)")), V.TAG_WEAK)).when(unit, pair(F.concat(j["evidence"], F.lit(" (a single shop unit)")), V.TAG_UNIT)).otherwise(j)

    return F.when(~not_a_place(tags), let(judged, demoted))


def is_candidate(tags: Column) -> Column:
    """Whether any tag of a feature is worth a closer look: the cheap first check over all features."""

    def interesting(e: Column) -> Column:
        k, v = e["key"], e["value"]
        base = F.when(F.instr(k, ":") > 0, F.regexp_replace(k, "^[^:]*:", "")).otherwise("")
        life = k.rlike("^(abandoned|disused)")
        listed = F.lit(False)
        for key, values in V.INTERESTING.items():
            listed = listed | ((k == key) & v.isin(values))
        visited = ((k == "tourism") & v.isin(list(V.ATTRACTIONS))) | ((k == "usage") & (v == "tourism")) | ((k == "operator") & says(v, V.HERITAGE_OPERATORS))
        gone = F.substring_index(k, ":", 1).isin(V.GONE_PREFIXES) | (k.isin("landuse", "building") & (v == "construction"))
        return F.when(life, base.isin(V.FEATURE_KEYS) | ((base == "") & (v == "yes"))).otherwise(listed | visited | gone | (k.isin(V.TEXT_KEYS) & says(v, V.DEAD_WORDS)))

    return F.exists(F.map_entries(tags), interesting)


def gone_as(tags: Column) -> Column:
    razed = F.exists(F.map_entries(tags), lambda e: F.substring_index(e["key"], ":", 1).isin(V.GONE_PREFIXES) & (e["value"] != "no"))
    return F.when(razed, "Demolished").when((tag(tags, "landuse") == "construction") | (tag(tags, "building") == "construction"), "Building site")


def in_use_as(tags: Column) -> Column:
    visited = F.coalesce(*[F.when(tag(tags, "tourism") == k, v) for k, v in V.ATTRACTIONS.items()])
    railway = tag(tags, "railway").isin("station", "halt") & (tag(tags, "usage").eqNullSafe("tourism") | tag(tags, "railway:preserved").eqNullSafe("yes"))
    return F.coalesce(visited, F.when(railway, "Heritage railway"), F.when(says(tag(tags, "operator"), V.HERITAGE_OPERATORS), "Heritage site"))


def entrance_of_tags(tags: Column) -> Column:
    made = F.coalesce(*[given(tag(tags, k)) for k in ("man_made", "disused:man_made", "abandoned:man_made")])
    old, air = tag(tags, "historic"), tag(tags, "mineshaft_type").isin("air", "ventilation")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(tag(tags, "natural") == "cave_entrance"), "Cave entrance").when(yes(made == "adit") | yes(old.isin("mine_adit", "adit")), "Adit")
        .when(yes(made == "mineshaft") | yes(old.isin("mine_shaft", "mineshaft")), F.when(yes(air), "Air shaft").otherwise("Shaft"))
    )


def entrance_of_text(text: Column) -> Column:
    return first_of(text, V.ENTRANCE_WORDS)


# --- items with types and states


def classify_item(label: Column, types: Column, states: Column, ended: Column) -> Column:
    """struct<evidence, weight, kind> of an item; types, states: arrays."""
    known = F.filter(types, lambda x: given(x).isNotNull())
    soft = lambda x: x.rlike(rx(V.SOFT_EXCLUDE))
    kind = given(F.coalesce(F.get(F.filter(known, lambda x: ~soft(x) & (x != "protected area")), F.lit(0)), F.get(known, F.lit(0))))
    joined = F.array_join(known, " | ")
    text = F.concat(label, F.lit(" | "), joined)
    dead = F.get(F.filter(states, lambda s: says(s, V.DEAD_STATES)), F.lit(0))
    under = given(F.lower(F.regexp_extract(text, f"({rx(V.UNDERGROUND)})", 1)))
    word = F.coalesce(*[F.when(under == k, F.lit(v)) for k, v in V.UNDERGROUND_NAMES.items()], under)
    no_lead = says(joined, V.HARD_EXCLUDE) | ((F.size(known) > 0) & F.forall(known, soft)) | F.exists(states, lambda s: says(s, V.GONE_STATES))
    told = F.concat(F.lit("Wikidata: state of use is '"), dead, F.lit("'"))
    station = says(joined, V.STATION)
    one = lambda c, e, w, k: (c, {"evidence": e, "weight": w, "kind": k})
    or_ = lambda k: F.coalesce(kind, F.lit(k) if isinstance(k, str) else k)
    return F.when(
        ~no_lead,
        first_match(
            [
                one(dead.isNotNull() & station & says(label, V.HALT), told, 10, or_("railway station")),
                one(dead.isNotNull() & station, told, 20, or_("railway station")),
                one(dead.isNotNull(), told, 30, or_("structure")),
                one(under.isNotNull(), F.concat(F.lit("Wikidata: old "), word), 25, or_(word)),
                one(given(ended).isNotNull() & says(text, V.BUILDINGISH), F.concat(F.lit("Wikidata: closed in "), F.substr(ended, F.lit(1), F.lit(4))), 20, or_("building")),
                one(says(label, V.FORMER) & says(text, V.BUILDINGISH), "Wikidata: listed as a former building", 10, or_("building")),
                one(says(text, V.TUNNEL), "Wikidata: tunnel", 10, or_("tunnel")),
                one(says(joined, V.MILL_TYPES), "Wikidata: historic mill or factory", 10, F.coalesce(kind, F.lit(""))),
                one(says(joined, V.MILITARY), "Wikidata: military site", 5, or_("military site")),
            ],
            ["evidence", "weight", "kind"],
        ),
    )


def judge_intro(text: Column) -> Column:
    """struct<delta, reason, snippet> of an article's first paragraph; delta -999: the place is gone."""

    def judged(sentences: Column) -> Column:
        quote = lambda p: F.substr(F.trim(F.get(F.filter(sentences, lambda s: says(s, p)), F.lit(0))), F.lit(1), F.lit(220))
        gone, dead, active, reused = (quote(p) for p in (V.INTRO_GONE, V.INTRO_DEAD, V.INTRO_ACTIVE, V.INTRO_REUSED))
        made = lambda d, r, s: F.struct(d.cast("int").alias("delta"), r.cast("string").alias("reason"), s.alias("snippet"))
        change = F.when(dead.isNotNull(), 15).otherwise(0) - F.when(active.isNotNull(), 20).otherwise(0) - F.when(reused.isNotNull(), 15).otherwise(0)
        reason = F.when(active.isNotNull(), "Wikipedia says it's still in use").when(reused.isNotNull(), "Wikipedia says it has a new use").when(dead.isNotNull(), "Wikipedia describes it as disused")
        return F.when(gone.isNotNull(), made(F.lit(-999), F.lit("Wikipedia says it's gone"), gone)).otherwise(made(change, reason, F.coalesce(active, reused, dead)))

    return let(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"(?<=[.!?])\s+"), judged)


def attraction_type(types: Column) -> Column:
    """What an item of these types is open as; the first type that tells."""
    return F.get(F.filter(F.transform(types, lambda x: first_of(x, V.ATTRACTION_TYPES)), lambda k: k.isNotNull()), F.lit(0))


def evaluate(items: DataFrame, intros: DataFrame) -> DataFrame:
    """Items (qid, label, lat, lng, types, states, ended, wiki, aliases) that are leads, with evidence, weight, kind, in_use and snippet.

    intros (title, extract): one for each article. An item whose intro takes its weight to nothing is left out."""
    titled = items.withColumn("title", N.article_title(F.col("wiki")))
    joined = titled.join(intros.select("title", "extract"), "title", "left").withColumn("j", classify_item(F.col("label"), F.col("types"), F.col("states"), F.col("ended")))
    judged = joined.where("j is not null").withColumn("i", F.when(given(F.col("extract")).isNotNull(), judge_intro(F.col("extract"))))
    weight = F.col("j.weight") + F.coalesce("i.delta", F.lit(0))
    evidence = F.concat(F.col("j.evidence"), F.coalesce(F.concat(F.lit("; "), F.col("i.reason")), F.lit("")))
    kept = judged.withColumns({"weight": weight, "evidence": evidence, "kind": F.col("j.kind"), "snippet": F.col("i.snippet"), "in_use": attraction_type(F.col("types"))})
    return kept.where("weight > 0").drop("j", "i", "extract", "title")


# --- registers


def sounds_gone(text: Column) -> Column:
    return says(text, V.GONE)


def judge_record(site_type: Column, name: Column | None = None) -> Column:
    """struct<weight, kind> of a register's own description; the name only tells wrecks and what's gone."""
    said = F.concat_ws(" ", site_type, F.lit("") if name is None else name)
    wreck = F.when(says(said, V.WRECK), 8).otherwise(0)
    found = first_match([(says(site_type, p), {"weight": F.lit(w) + wreck, "kind": k}) for p, w, k in V.RECORD_TYPES], ["weight", "kind"])
    return F.when(~sounds_gone(said), found)


def judge_segments(site_type: Column, name: Column) -> Column:
    """struct<weight, kind, what> of the first telling part of a list of everything recorded on a spot."""

    def one(raw: Column) -> Column:
        what = F.lower(F.trim(F.regexp_replace(raw, r"\([^)]*\)", "")))
        return let(judge_record(raw, name), lambda j: F.when(j.isNotNull(), F.struct(j["weight"].alias("weight"), j["kind"].alias("kind"), what.alias("what"))))

    return F.get(F.filter(F.transform(F.split(F.coalesce(site_type, F.lit("")), "[,;]"), one), lambda j: j.isNotNull()), F.lit(0))


def dates_of(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(what).alias("what"), when.cast("string").alias("when")) for what, when in pairs])


def item(rows: DataFrame, judged: Column, ref: Column, name: Column, evidence, kind=None, weight=None, aliases: Column | None = None, dates: Column | None = None) -> DataFrame:
    """The rows that a judge keeps (with a ref), as items: lat, lng (where rows have them), ref, name, kind, evidence, weight, aliases, dates. Nameless ones are named by kind."""
    kept = with_lead(rows, judged)
    j = F.col("j")
    made = {"ref": _text(ref), "kind": j["kind"] if kind is None else kind(j), "evidence": evidence(j), "weight": (j["weight"] if weight is None else weight(j)).cast("int")}
    made |= {"aliases": F.array().cast("array<string>") if aliases is None else aliases, "dates": F.array().cast("array<struct<what:string,when:string>>") if dates is None else dates}
    own = [c for c in ("lat", "lng") if c in rows.columns]
    out = kept.select(*own, *[v.alias(k) for k, v in made.items()], _text(name).alias("name")).where("ref <> ''")
    return out.withColumns({"dates": F.filter("dates", lambda d: given(d["when"]).isNotNull()), "name": F.coalesce(given(F.col("name")), F.concat(F.lit("Unnamed "), F.col("kind")))})


def collect(items: DataFrame, dataset: str, as_of: Column) -> DataFrame:
    """Items ready for the store: with their dataset, and the latest date that isn't still to come."""
    found = items.withColumn("l", N.latest_date(F.col("dates"), as_of))
    return found.withColumns({"dataset": F.lit(dataset), "reported": F.col("l.when"), "reported_as": F.col("l.what")}).drop("l")


def heritage_at_risk(rows: DataFrame) -> DataFrame:
    """rows: HeritageCa, EntryName, List_Entry, uid."""
    judged = first_match([(F.col("HeritageCa") == k, {"kind": kind, "weight": w}) for k, (kind, w) in V.AT_RISK_KINDS.items()], ["kind", "weight"])
    said = lambda j: F.concat(F.lit("Historic England has it on the Heritage at Risk register ("), j["kind"], F.lit(")"))
    return item(rows, judged, F.coalesce(given(F.col("List_Entry")), F.col("uid")), F.col("EntryName"), said, dates=dates_of(("on the register in", F.lit(str(V.AT_RISK_YEAR)))))


def brownfield(rows: DataFrame) -> DataFrame:
    """rows: site_address, name, notes, entity, reference, start_date, entry_date."""
    notes = _text(F.col("notes"))
    address = F.trim(F.coalesce(given(F.col("site_address")), F.col("name"), F.lit("")))
    judged = F.when(~says(notes, V.BUILT), F.struct(F.lit("brownfield land").alias("kind"), F.lit(10).alias("weight")))
    said = lambda j: F.concat(F.lit("On the council's brownfield land register"), F.when(notes != "", F.concat(F.lit(": "), F.substr(notes, F.lit(1), F.lit(120)))).otherwise(""))
    dates = dates_of(("first on the register", N.dated(F.col("start_date"))), ("register entry updated", N.dated(F.col("entry_date"))))
    return item(rows, judged, F.coalesce(given(F.col("entity")), F.col("reference")), F.substr(F.substring_index(address, ",", 1), F.lit(1), F.lit(120)), said, dates=dates)


def monuments(rows: DataFrame, register: str, shouting: bool) -> DataFrame:
    """rows: ref, name, alt_names (or null), site_type, entered, updated. `register` says whose record it is; shouting: names in capitals."""
    judged = judge_segments(F.col("site_type"), _text(F.col("name")))
    name = N.tidy_name(F.trim("name"), shouting)
    other = F.transform(F.filter(F.split(F.coalesce("alt_names", F.lit("")), ";"), lambda x: F.trim(x) != ""), lambda x: N.tidy_name(x, shouting))
    said = lambda j: F.concat(F.lit(f"{register} records "), N.a(j["what"]), F.lit(" here"))
    dates = dates_of(("recorded", N.dated(F.col("entered"))), ("record updated", N.dated(F.col("updated"))))
    return item(rows, judged, F.col("ref"), name, said, aliases=F.filter(other, lambda x: (x != "") & (x != name)), dates=dates)


def closed_schools(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows: urn, name, type, phase, reason, close_date (day-month-year)."""
    reason, closed = F.col("reason"), N.closed_school_day(F.col("close_date"))
    years = N.years_since(closed, as_of)
    weight = F.when(years <= 5, 22).when(years <= 15, 15).otherwise(8)
    said = F.lower(F.concat_ws(" ", F.coalesce("type", F.lit("")), F.coalesce("phase", F.lit(""))))
    kind = F.when(said.contains("nursery"), "nursery school").when(said.contains("special"), "special school").when(said.contains("referral"), "school (pupil referral unit)").otherwise("school")
    fits = ~F.coalesce(F.col("type").isin(V.SCHOOL_ELSEWHERE), F.lit(False)) & F.coalesce(reason.isin(V.SCHOOL_CLOSURES), F.lit(False))
    evidence = F.concat(
        F.lit("The Department for Education records it as closed"), F.coalesce(F.concat(F.lit(" in "), F.year(closed).cast("string")), F.lit("")),
        F.when(reason == "Result of Amalgamation/Merger", ", merged into another school").otherwise(""),
    )
    return item(rows, F.when(fits, F.struct(kind.alias("kind"), weight.alias("weight"))), F.col("urn"), F.col("name"), lambda j: evidence, dates=dates_of(("closed", closed)))


def derelict_land(rows: DataFrame) -> DataFrame:
    """rows: authority, code, site_name, address, site_type, use, since, survey."""
    kind_text, use, since = (_text(F.col(c)) for c in ("site_type", "use", "since"))
    bonus = F.coalesce(*[F.when(use == k, F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n"))) for k, (kind, n) in V.LAND_USES.items()], F.struct(F.lit("site").alias("kind"), F.lit(0).alias("n")))
    vacant, standing = kind_text == "Vacant Land", kind_text.contains("Buildings")
    judged = let(bonus, lambda b: F.struct(b["kind"].alias("kind"), F.when(vacant, 6).when(standing, 22 + b["n"]).otherwise(16 + b["n"]).alias("weight")))
    said = F.concat(
        F.lit("Scotland's land survey lists "), F.when(vacant, "it as cleared vacant land").when(standing, "its buildings as vacant").otherwise("it as derelict"),
        F.when((since != "") & (since != "Unknown"), F.concat(F.lit(" since "), since)).otherwise(""), F.when(~use.isin("", "Unknown", "Other"), F.concat(F.lit(", previously "), F.lower(use))).otherwise(""),
    )
    name = F.coalesce(given(N.tidy_name(F.col("site_name"), True)), N.tidy_name(F.substring_index(F.coalesce("address", F.lit("")), ",", 1), True))
    return item(rows, judged, F.concat(_text(F.col("authority")), F.lit(":"), _text(F.col("code"))), name, lambda j: said, dates=dates_of(("land survey of", F.col("survey"))))


def care_closures(rows: DataFrame, as_of: Column) -> DataFrame:
    """Closed care homes, hospitals and day centres (see registers.closed_care): ref, name, category, ended (date), care_home, beds, centre."""
    years, year = N.years_since(F.col("ended"), as_of), F.year("ended").cast("string")
    said = F.concat_ws(" ", "name", "category")
    centre, home = given(F.col("centre")), F.coalesce("care_home", F.lit(False))
    nursing = F.when(says(said, "nursing"), "nursing home").otherwise("care home")
    ward = F.when(says(said, "hospice"), "hospice").otherwise("hospital")
    kind = F.when(centre.isNotNull(), "day centre").when(home, nursing).otherwise(ward)
    base = F.when(home & (F.col("beds") < 40), 16).otherwise(20)
    aged = F.when(years <= 5, base + 4).when(years > 12, F.least(base, F.lit(8))).when(years > 8, base - 6).otherwise(base)
    weight = F.when(centre.isNotNull(), F.when(years <= 5, 22).when(years > 14, 8).when(years > 10, 12).otherwise(20)).otherwise(aged)
    what = F.when(home, F.concat(N.a(kind), F.lit(" with "), F.col("beds").cast("string"), F.lit(" beds"))).otherwise(N.a(kind))
    head = F.concat(F.lit("The Care Quality Commission records it as closed in "), year)
    day_service = F.concat(head, F.lit(": the last care service at "), centre, F.lit(" ended then, and none is registered there now"))
    evidence = F.when(centre.isNotNull(), day_service).otherwise(F.concat(head, F.lit(" ("), what, F.lit("); no care service is registered there now")))
    return item(rows, F.struct(kind.alias("kind"), weight.alias("weight")), F.col("ref"), F.coalesce(centre, F.col("name")), lambda j: evidence, dates=dates_of(("closed", F.col("ended"))))


def empty_estates(rows: DataFrame) -> DataFrame:
    """rows: ref, name, trust, whole, unoccupied_m2, empty_m2, floor_m2, pre_1948, year (2023/24)."""
    amount = lambda c: F.format_number(F.floor(F.col(c)), 0)
    own = N.title(_text(F.col("name")))
    name = F.when(own.rlike(rx(r"^other reportable sites?$")), F.substr(F.concat(F.lit("Empty site of "), N.title(_text(F.col("trust")))), F.lit(1), F.lit(80))).otherwise(own)
    kind = F.when(says(name, "hospital|infirmary|asylum|sanatori"), "hospital").otherwise("NHS building")
    weight = F.when(F.col("whole"), F.when(F.coalesce("pre_1948", F.lit(0.0)) >= 50, 26).otherwise(22)).otherwise(18)
    area = F.when(F.col("unoccupied_m2") != 0, amount("unoccupied_m2")).when(F.col("floor_m2") != 0, amount("floor_m2"))
    head = F.concat(F.lit("NHS estates return ("), F.col("year"), F.lit("): "))
    whole = F.concat(head, F.lit("the whole site"), F.coalesce(F.concat(F.lit(" ("), area, F.lit(" m²)")), F.lit("")), F.lit(" is unoccupied"))
    part = F.concat(head, amount("empty_m2"), F.lit(" of its "), amount("floor_m2"), F.lit(" m² stand empty"))
    to = lambda g: F.regexp_extract("year", r"^(\d{4})/(\d{2})", g)
    ends = F.when(to(1) != "", F.concat(F.substr(to(1), F.lit(1), F.lit(2)), to(2), F.lit("-03-31")))
    return item(rows, F.struct(kind.alias("kind"), weight.alias("weight")), F.col("ref"), name, lambda j: F.when(F.col("whole"), whole).otherwise(part), dates=dates_of(("estates return for the year to", ends)))


def railway_estate(rows: DataFrame) -> DataFrame:
    """rows: ref, name, kind (tunnel or viaduct), line, path, updated."""
    tunnel, reused = F.col("kind") == "tunnel", F.coalesce(F.col("path").isin("Railway Path", "Sustrans"), F.lit(False))
    kind = F.when(tunnel, "railway tunnel").otherwise("railway viaduct")
    line = F.coalesce(F.concat(F.lit(" ("), given(F.col("line")), F.lit(")")), F.lit(""))
    said = F.concat(F.lit("National Highways' Historical Railways Estate: "), N.a(F.col("kind")), F.lit(" on a closed railway"), line, F.when(reused, "; the line is now a path, so it has a new use").otherwise(""))
    weight = F.when(reused, 10).when(tunnel, 26).otherwise(14)
    name = F.coalesce(given(F.col("name")), F.concat(F.concat(F.upper(F.substr(kind, F.lit(1), F.lit(1))), F.substr(kind, F.lit(2))), line))
    return item(rows, F.struct(kind.alias("kind"), weight.alias("weight")), F.col("ref"), name, lambda j: said, dates=dates_of(("list updated", F.col("updated"))))


def land_disposals(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows: ref, establishment, parcel, status, year, reported. Parcels that are only land are left out (keep them out before looking up positions)."""
    place, parcel, year = N.title(_text(F.col("establishment"))), N.title(_text(F.col("parcel"))), F.when(F.col("year").rlike(r"^\d+$"), F.col("year").try_cast("int"))
    whole = (parcel == "") | F.lower(parcel).isin("various parcels") | (F.lower(parcel) == F.lower(place))
    name = F.when(whole, place).when(F.contains(F.lower(parcel), F.lower(place)), parcel).otherwise(F.concat_ws(", ", parcel, place))
    kind = F.coalesce(first_of(parcel, V.DISPOSAL_KINDS), first_of(place, V.DISPOSAL_KINDS), F.lit("military site"))
    past = year <= F.year(as_of)
    weight = F.when((kind == "cadet hut") | F.coalesce(~past, F.lit(True)), 8).otherwise(18)
    head = F.lit("The Ministry of Defence ")
    said = F.when(past, F.concat(head, F.lit("lists it as surplus, to be sold from "), year)).when(year.isNotNull(), F.concat(head, F.lit("is due to close it and sell it from "), year)).otherwise(F.concat(head, F.lit("lists it as surplus, to be sold")))
    stage = F.coalesce(F.concat(F.lit(" (stage: "), given(F.lower(_text(F.col("status")))), F.lit(")")), F.lit(""))
    return item(rows, F.struct(kind.alias("kind"), weight.alias("weight")), F.col("ref"), F.substr(name, F.lit(1), F.lit(90)), lambda j: F.concat(said, stage), dates=dates_of(("reported to Parliament", F.col("reported"))))


def old_map_labels(rows: DataFrame) -> DataFrame:
    """rows: pin_id, final_text, parish, air_shafts (null, or how many are near a quarry)."""
    label = F.trim(F.regexp_replace(F.coalesce("final_text", F.lit("")), r"\s+", " "))
    low, shafts = F.lower(label), F.coalesce(F.col("air_shafts"), F.lit(0))
    ruined, disused = says(low, r"\bruins?\b|\(in ruins?\)"), F.contains(low, F.lit("(disused)")) | low.startswith("old ")
    bare = F.trim(F.regexp_replace(label, rx(V.OLD_MAP_SAID), " "))
    base = F.trim(F.regexp_replace(bare, rx(r"^old\s+"), ""))
    kinds = first_match([(says(base, rf"(?:^|\b){p}$"), {"kind": k, "lasting": lasting}) for p, k, lasting in V.OLD_MAP_KINDS], ["kind", "lasting"])
    long_enough = F.length(base) + F.when(low.endswith("(pumping)"), 10).otherwise(0) >= 3
    then = F.when(ruined, " (in ruins even then)").when(disused, " (disused even then)").otherwise("")
    read = F.concat(F.lit(f"The Ordnance Survey six-inch map of {V.OLD_MAP_YEARS[0]}-{V.OLD_MAP_YEARS[1]} marks \""), label, F.lit('" here'))
    under = F.concat(read, F.lit(", with "), shafts.cast("string"), F.lit(" air shaft"), F.when(shafts == 1, "").otherwise("s"), F.lit(f" within {V.UNDERGROUND_WITHIN_M} m: worked underground"))
    pair = lambda k, w: F.struct(k.alias("kind"), w.alias("weight"))
    plain = let(kinds, lambda j: F.when(j.isNotNull() & long_enough & (ruined | disused | j["lasting"]), pair(j["kind"], F.when(ruined | disused, 10).otherwise(6))))
    judged = F.when(shafts > 0, pair(F.lit("underground quarry"), F.lit(20))).otherwise(plain)
    parish = given(N.capitalised(F.lower(_text(F.col("parish")))))
    quarry = F.when(low.isin(V.QUARRY_LABELS) & parish.isNotNull(), F.concat(F.lit("Underground quarry, "), parish)).otherwise(label)
    name = F.when(shafts > 0, quarry).otherwise(F.when(bare.rlike(r"\p{Lu}"), bare).otherwise(N.capitalised(bare)))
    return item(rows, judged, F.col("pin_id"), name, lambda j: F.when(shafts > 0, under).otherwise(F.concat(read, then)), dates=dates_of(("on the map by", F.lit(V.OLD_MAP_YEARS[1]))))


# The fields of a disclaimer notice, each up to whichever field comes next; lead-ins and endings around a property.
NOTICE_FIELDS = {
    "company": r"Company Name:\s*(.+?)\s*\.?\s*(?:Previous Names? of (?:the )?Company:|Company Number:|Company No)",
    "number": r"Company (?:Number|No)\.?:\s*([A-Z]{0,2}\d{5,8})",
    "interest": r"Interest:\s*(Freehold|Leasehold|Commonhold)",
    "title": r"Title [Nn]umbers?:\s*([A-Z]{1,4}\s?\d+)",
    "dissolved": r"Dissolution Date:\s*(\d{1,2} \w+ \d{4})",
    "property": r"Property:\s*(.+?)\s*(?:Title [Nn]umbers?:|Interest:|Lease:|Dissolution Date:|Company (?:Name|Number):|(?:The )?(?:Treasury|Duchy) Solicitor|\b2\.?\s+In pursuance|$)",
}
LEAD = r"^.*?\b(?:situated at|situate at|known as|described as)\s+|^(?:the )?(?:property|premises)\s+(?:being\s+)?|^lease of [\w ]+? at\s+"
TAIL = r"\s*,?\s*being (?:the|all the) land .*$|\s*,?\s*(?:and )?(?:as )?(?:the same is )?registered .*$"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def parse_notice(text: Column) -> Column:
    """struct of the fields of a disclaimer notice, with the property's postcode and the day it was signed; null without a property."""
    field = {k: given(F.trim(F.regexp_extract(text, f"(?s){p}", 1))) for k, p in NOTICE_FIELDS.items()}
    stripped = F.regexp_replace(F.regexp_replace(field["property"], "^[ \"']+|[ \"']+$", ""), "(?i)(?:" + LEAD + ")", "")
    prop = F.regexp_replace(F.regexp_replace(stripped, rx(TAIL), ""), "^[ .,\"']+|[ .,\"']+$", "")
    signed = N.named_day(F.element_at(F.regexp_extract_all(text, F.lit(rf"\b(\d{{1,2}} (?:{MONTHS}) \d{{4}})\b"), F.lit(1)), -1))
    made = {**field, "property": prop, "postcode": N.postcode_of(prop), "dissolved": N.named_day(field["dissolved"]), "signed": F.when(text.rlike(rf"\b\d{{1,2}} (?:{MONTHS}) \d{{4}}\b"), signed)}
    return F.when(field["property"].isNotNull(), F.struct(*[v.alias(k) for k, v in made.items()]))


def disclaimers(rows: DataFrame) -> DataFrame:
    """rows: id, property, interest, company, number, title, dissolved, signed (dates): buildings of dissolved companies that the Crown disclaimed."""
    prop = _text(F.col("property"))
    pieces = F.transform(F.split(F.regexp_replace(prop, rx(V.POSTCODE), ""), ","), lambda p: F.regexp_replace(F.trim(p), "^[ ()]+|[ ()]+$", ""))
    part = F.coalesce(F.get(F.filter(pieces, lambda p: p != ""), F.lit(0)), F.lit(""))
    kind = first_of(F.regexp_replace(part, rx(V.STREET), ""), V.DISCLAIMED_KINDS + V.PLANNED_KINDS)
    freehold = F.lower(F.coalesce("interest", F.lit(""))) == "freehold"
    judged = F.when((prop != "") & ~says(prop, V.NOT_A_BUILDING) & kind.isNotNull(), F.struct(kind.alias("kind"), F.when(freehold, 20).otherwise(12).alias("weight")))
    company = F.coalesce(given(N.title(_text(F.col("company")))), F.lit("a company"))
    on = F.coalesce(F.concat(F.lit(" on "), F.col("signed").cast("string")), F.lit(""))
    when = F.coalesce(F.concat(F.lit(" in "), F.year("dissolved").cast("string")), F.lit(""))
    owned = F.concat(F.lit("The Crown disclaimed it"), on, F.lit(": "), company, F.lit(", which owned the freehold, was dissolved"), when, F.lit(" and nobody took it on, so it's ownerless"))
    leased = F.concat(company, F.lit(", which held the lease, was dissolved"), when, F.lit(", and the Crown disclaimed the lease"), on, F.lit(": it went back to the landlord"))
    source = F.concat(F.lit(" (The Gazette"), F.coalesce(F.concat(F.lit(", title "), given(F.col("title"))), F.lit("")), F.lit(")"))
    aliases = F.when(given(F.col("number")).isNotNull(), F.array(F.concat(company, F.lit(" ("), F.col("number"), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    dates = dates_of(("dissolved", F.col("dissolved")), ("disclaimed", F.col("signed")))
    return item(rows, judged, F.col("id"), F.substr(part, F.lit(1), F.lit(90)), lambda j: F.concat(F.when(freehold, owned).otherwise(leased), source), aliases=aliases, dates=dates)


def imported(places: DataFrame, label: str, as_of: Column) -> DataFrame:
    """Places of an imported file (name, lat, lng, kind, note, aliases) as items."""
    name, own, note = (_text(F.col(c)) for c in ("name", "kind", "note"))
    said = F.concat_ws(" ", given(own), given(note), given(name))
    verdict = judge_record(said)
    kind = F.coalesce(given(own), verdict["kind"], F.lit("place"))
    weight = F.when(sounds_gone(said), V.IMPORT_GONE_WEIGHT).otherwise(F.coalesce(verdict["weight"], F.lit(V.IMPORT_WEIGHT)))
    detail = F.coalesce(given(own), given(F.substr(note, F.lit(1), F.lit(120))))
    evidence = F.concat(F.lit(f'From your import "{label}"'), F.coalesce(F.concat(F.lit(": "), detail), F.lit("")))
    slug = F.substr(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(1), F.lit(60))
    ref = F.concat(F.lit(f"{label}:"), slug, F.lit(":"), F.format_string("%.5f,%.5f", "lat", "lng"))
    return item(places, F.struct(kind.alias("kind"), weight.alias("weight")), ref, name, lambda j: evidence, aliases=F.coalesce(F.col("aliases"), F.array().cast("array<string>")), dates=dates_of(("imported", as_of)))


# --- planning applications


def squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def house_state(said: Column) -> Column:
    """struct<stalled, unlivable, doing_up> (booleans): begun and never finished, can't be lived in, being done up."""
    home = says(said, V.UNLIVABLE_HOME) | ~says(said, V.UNLIVABLE_PART)
    unlivable = says(said, V.UNLIVABLE) & home & ~says(said, V.TREE_WORK)
    return F.struct(says(said, V.STALLED).alias("stalled"), unlivable.alias("unlivable"), (says(said, V.DOING_UP) & ~says(said, V.NOT_DOING_UP)).alias("doing_up"))


def _any_state(said: Column) -> Column:
    return let(house_state(said), lambda h: h["stalled"] | h["unlivable"] | h["doing_up"])


def worth_a_second_look(said: Column, started: Column, as_of: Column) -> Column:
    """An application about a house's state, made long enough ago that it should have been sorted out."""
    return F.coalesce(~says(said, V.FOLLOW_UP) & ~says(said, "demoli") & _any_state(said) & (started < F.date_sub(as_of, V.DONE_AFTER_DAYS)), F.lit(False))


def gave_up_on(said: Column, started: Column, since: Column) -> Column:
    """A later application that says the work never got done."""
    again = F.coalesce(started >= F.date_add(since, V.DONE_AFTER_DAYS), F.lit(False))
    return ~says(said, V.FOLLOW_UP) & (says(said, V.REPLACED) | (again & _any_state(said)))


def planned_kind(text: Column) -> Column:
    return F.coalesce(first_of(text, V.PLANNED_KINDS), F.when(says(text, V.HOME_WORDS), "house"))


def planning(rows: DataFrame, as_of: Column) -> DataFrame:
    """Planning applications worth knowing of. rows: name, address, description, app_state, start_date, decided_date (dates), and later: array of struct<said, started, decided, state, ref> of
    later applications about the same house (see operators.applications).
    Adds kind, weight, state and evidence."""
    said, decided, started = squashed(F.col("description")), F.col("decided_date"), F.col("start_date")
    demolition, follow_up = says(said, "demoli"), says(said, V.FOLLOW_UP)
    known = rows.withColumn("h", house_state(said))
    h = F.col("h")
    stalled, unlivable, doing_up = h["stalled"], h["unlivable"], h["doing_up"]
    told = F.lower(F.regexp_extract(said, f"({rx(V.STALLED)})", 1))
    unfinished = F.when(told.contains("occupied"), F.coalesce(planned_kind(said), F.lit("building"))).when(says(told, "dwelling|house|home"), "unfinished house").otherwise("unfinished building")
    record = judge_record(F.regexp_replace(said, rx(r"demoli\w*"), ""))
    plain_kind = first_of(said, V.PLANNED_KINDS, F.lit("building"))
    barn = ~demolition & (plain_kind == "farm buildings")
    pair = lambda k, w: F.struct(k.alias("kind"), w.alias("weight"))
    other = let(record, lambda r: F.when(r.isNotNull(), pair(r["kind"], r["weight"])).otherwise(pair(plain_kind, F.when(barn, 8).when(says(said, V.FALLING_DOWN), 20).otherwise(12))))
    fits = F.when(demolition, says(said, V.RUNDOWN) & ~says(said, V.SMALL_JOB)).otherwise(says(said, V.STATE_WORDS) & ~says(said, V.SMALL_THING) & ~says(said, V.TREE_WORK))
    judged = (
        F.when(says(said, V.NO_DECISION) & ~(unlivable | doing_up), F.lit(None)).when(stalled, pair(unfinished, F.lit(14))).when(unlivable, pair(F.coalesce(planned_kind(said), F.lit("building")), F.lit(18)))
        .when(doing_up, pair(F.coalesce(planned_kind(said), F.lit("house")), F.lit(12))).when(fits, other)
    )
    outcome = F.coalesce(*[F.when(F.col("app_state") == k, v) for k, v in V.DECIDED.items()])
    long_ago = decided < F.date_sub(as_of, V.DONE_AFTER_DAYS)
    approved = (outcome == "approved") & decided.isNotNull()
    on = F.coalesce(F.concat(F.lit(" on "), decided.cast("string")), F.lit(""))
    state = (
        F.when(follow_up, F.concat(F.when(demolition, "demolition").otherwise("the work"), F.lit(" approved earlier; this follows it up, so the work may be under way")))
        .when(approved & demolition, F.concat(F.lit("demolition approved"), on, F.when(long_ago, ", so it may well be gone").otherwise("")))
        .when(approved, F.concat(F.lit("approved"), on, F.when(long_ago, ", so the work may well be done").otherwise("")))
        .when(outcome.isNotNull(), F.concat(F.when(demolition, "demolition ").otherwise(""), outcome, on))
        .otherwise(F.concat(F.when(demolition, "applied to demolish it on ").otherwise("applied for on "), F.coalesce(started.cast("string"), F.lit("")), F.lit(", no decision yet")))
    )
    kept = with_lead(known, judged)
    again = F.filter(F.col("later"), lambda x: gave_up_on(x["said"], x["started"], started))
    # the latest; of equal days the first
    last = F.array_max(F.transform(again, lambda x, i: F.struct(x["started"].alias("started"), (-i).alias("seq"), x["said"].alias("said"), x["decided"].alias("decided"), x["state"].alias("state"), x["ref"].alias("ref"))))
    kept = kept.withColumn("last", F.when((stalled | unlivable | doing_up) & ~demolition & ~follow_up, last))
    last = F.col("last")
    then = F.coalesce(*[F.when(last["state"] == k, v) for k, v in V.DECIDED.items()], F.lit("undecided"))
    lapsed = F.coalesce((then == "approved") & says(last["said"], V.REPLACED) & (last["decided"] < F.date_sub(as_of, 3 * 365)), F.lit(False))
    weight = F.when(last.isNotNull(), F.when(lapsed, 12).otherwise(20)).when(follow_up | F.coalesce(approved & long_ago, F.lit(False)), 5).otherwise(F.col("j.weight"))
    shown = F.when(last.isNotNull(), F.replace(state, F.lit(", so the work may well be done"), F.lit(""))).otherwise(state)
    focus = "|".join((V.STALLED, V.UNLIVABLE, V.DOING_UP))
    decided_on = F.when(last["decided"].isNotNull() & (then != "undecided"), F.concat(F.lit(" on "), last["decided"].cast("string"))).otherwise("")
    since = F.concat(
        F.lit("; then, in "), F.coalesce(F.year(last["started"]).cast("string"), F.lit("")), F.lit(", another application here ("), last["ref"], F.lit(", "), then, decided_on, F.lit('): "'), N.excerpt(last["said"], "(?!)", 120),
        F.lit('", so it seems the work was never finished'), F.when(lapsed, ", and it may since have gone").otherwise(""),
    )
    quoted = F.when(stalled | unlivable | doing_up, N.excerpt(said, focus)).otherwise(N.excerpt(said, V.STATE_WORDS))
    caravan = F.when(doing_up & ~stalled & ~unlivable, "; someone was to live in a caravan on the plot meanwhile, so it couldn't be lived in then").otherwise("")
    evidence = F.concat(F.lit("Planning application ("), shown, F.lit('): "'), quoted, F.lit('"'), caravan, F.coalesce(since, F.lit("")))
    out = kept.withColumns({"evidence": evidence, "state": shown, "kind": F.col("j.kind"), "weight": weight.cast("int"), "place": N.short_address(F.col("address"))})
    return out.drop("h", "j", "last")


def committee(rows: DataFrame, as_of: Column) -> DataFrame:
    """A planning officer's words in a report. rows: council, ref, site, proposal, sentence, phrase, meeting (date), committee."""
    said, proposal = F.col("sentence"), F.get(F.split(F.coalesce("proposal", F.lit("")), rx(V.PROPOSED)), F.lit(0))
    kind = F.coalesce(planned_kind(said), planned_kind(proposal), F.lit("building"))
    years = F.coalesce(N.years_since(F.col("meeting"), as_of), F.lit(0.0))
    begun = F.col("phrase").rlike("partially|unfinished")
    unit = says(said, V.SHOP_UNIT) & kind.isin("building", "industrial building")
    bare = says(said, V.LAND_WORDS) & ~says(said, V.STANDING)
    base = F.when(begun, 16).when(unit | bare, 8).otherwise(22)
    weight = F.when(years > 10, F.least(base, F.lit(6))).when(years > 5, base - 8).otherwise(base)
    shown = F.when(begun, F.when(kind == "house", "unfinished house").otherwise(kind)).when(~unit & bare, "vacant land").otherwise(kind)
    where = F.coalesce(F.concat(F.lit(", "), F.col("committee"), F.lit(", "), F.col("meeting").cast("string")), F.lit(""))
    evidence = F.concat(F.col("council"), F.lit("'s planning report ("), F.col("ref"), where, F.lit('): "'), F.substr(said, F.lit(1), F.lit(280)), F.lit('"'))
    return item(rows, F.struct(shown.alias("kind"), weight.alias("weight")), F.concat_ws(":", "council", "ref"), N.short_address(F.col("site")), lambda j: evidence, dates=dates_of(("committee meeting", F.col("meeting"))))


# --- sites


def category(name: Column, members: Column) -> Column:
    """A site's category: settled by the kind of its strongest evidence, or by the first pattern over all it is called. members: array of struct with kind, evidence, weight."""
    best = F.array_max(F.transform(members, lambda m, i: F.struct(m["weight"].alias("w"), (-i).alias("seq"), F.coalesce(m["kind"], F.lit("")).alias("kind"))))["kind"]
    told = F.transform(members, lambda m: F.concat(F.coalesce(m["kind"], F.lit("")), F.lit(" "), F.coalesce(m["evidence"], F.lit(""))))
    text = F.array_join(F.concat(F.array(F.coalesce(name, F.lit(""))), told), " ")
    return F.coalesce(first_of(best, V.KIND_CATEGORIES), first_of(text, [(p, k) for k, _, p in V.CATEGORIES]), F.lit(V.OTHER_CATEGORY[0]))


def condition_of_text(evidence: Column) -> Column:
    """The state that an evidence text tells, or null."""
    text, out = F.lower(evidence), F.lit(None).cast("string")
    for pattern, name in reversed(V.CONDITIONS):
        told = F.concat(F.lit("Closed "), F.regexp_extract(text, pattern, 1)) if pattern.startswith("closed in") else F.lit(name)
        out = F.when(text.rlike(f"(?U){pattern}"), told).otherwise(out)
    return out


def condition(name: Column, members: Column, gone: Column, in_use: Column) -> Column:
    """A site's condition; gone, in_use: what it is now (null: neither)."""
    ordered = F.array_sort(F.transform(members, lambda m, i: F.struct((-m["weight"]).alias("w"), i.alias("seq"), m["evidence"].alias("evidence"))))
    under = F.when(F.exists(members, lambda m: says(m["evidence"], V.UNDERGROUND_EVIDENCE)), "Underground")
    told = F.get(F.filter(F.transform(ordered, lambda m: condition_of_text(m["evidence"])), lambda c: c.isNotNull()), F.lit(0))
    word = N.listed_word(name, V.DEAD_NAME_WORDS)
    named = F.coalesce(*[F.when(word == k, v) for k, v in V.NAME_CONDITIONS.items()])
    return F.coalesce(gone, in_use, under, told, named, F.lit("Historic"))
