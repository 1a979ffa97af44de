"""Queries of council papers, beside those of `queries`: papers are the documents, with headers and officers' sentences set among their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import judges
from waymark.functions import vocabulary as V
from waymark.operators import papers
from waymark.plans import views as v
from waymark.plans.queries import query

#: | is the border of two pages.
HEADERS = [
    "APPLICATION NO. {k}/00362/FULLS\nSITE Golden Hill , Belbins, Romsey, SO51 0PE, ROMSEY EXTRA\nPROPOSAL Demolition of sheds and erection of a dwelling\nCASE OFFICER A Person\n",
    "BO/{k}/00620/FUL\n\nSite Burnes Shipyard Westbrook Field Bosham\nProposal Redevelopment of previously developed land.\nMap Ref (E) 480388 (N) 104217\n",
    "Minutes of the meeting\n", "Application Reference: P/{k}/0156/OUT.\nLocation: The Old Chapel, High Street\nDescription: Conversion to flats\n\nEasting: 350123 Northing: 1204217\n",
]
SAYINGS = [
    "2.1 The dwelling has not been occupied since 1998. It is of stone.", "The site has been redundant for more than twenty years, with the buildings in a poor state of repair.", "The mill has been vacant| for ten years and is boarded\n up. Trees grow.",
    "The neighbouring house has been empty since 2001.", "A site is permitted only if it has been vacant for two years.", "The hall, vacant since 2013, was demolished.", "Has the barn fallen into disrepair?", "Nothing is told here.", "(i) no harm; the yard is in a derelict condition; (ii) no cost.",
    "There is a partially built dwelling at No. 4 Mill Rd. The rest is grass.",
]


def council_papers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (n % len(xs)).cast("int"))
    half = F.floor(F.length("t") / 2).cast("int")
    head = lambda n: F.replace(pick(HEADERS, n), F.lit("{k}"), F.lpad(F.pmod(n, F.lit(100)).cast("string"), 2, "0"))
    whole = F.concat(head(k), F.lit("\n"), F.left("t", half), F.lit(" . "), pick(SAYINGS, k), F.lit("\n|"), head(F.floor(k / 3)), F.substr("t", half + 1), F.lit(" . "), pick(SAYINGS, F.floor(k / 7)))
    return v.table(spark, sf, "documents").withColumn("t", F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit(" "))).select(k.alias("paper"), F.split(whole, r"\|").alias("pages"))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _pick(xs: list[str], n: str) -> str:
    return f"([{', '.join(map(_text, xs))}])[1 + {n} % {len(xs)}]"


def _head(n: str) -> str:
    return f"replace({_pick(HEADERS, n)}, '{{k}}', lpad(({n} % 100)::varchar, 2, '0'))"


PAPERS = f"""(select doc_id as paper, string_split({_head('doc_id')} || chr(10) || left(t, length(t) // 2) || ' . ' || {_pick(SAYINGS, 'doc_id')} || chr(10) || '|' || {_head('(doc_id // 3)')} || substr(t, length(t) // 2 + 1) || ' . ' || {_pick(SAYINGS, '(doc_id // 7)')}, '|') as pages
 from (select doc_id, replace(coalesce(text, ''), '|', ' ') as t from documents))"""
_PHRASE, _SITE = _text("(?i)" + "|".join(r"\s+".join(p.split()) for p in V.PAPER_PHRASES)), _text(V.PAPER_SITE + "(?s:.)")
_SIZES = "list_sum(list_transform({}, lambda x: length(x)))"


@query(f"""with t as (select paper, pages, array_to_string(list_transform(pages, lambda p: p || chr(10)), '') as text from {PAPERS}), f as (select *, regexp_extract_all(text, {_PHRASE}) words, regexp_split_to_array(text, {_PHRASE}) gaps from t),
 h as (select paper, pages, text, words[i] as word, ({_SIZES.format('gaps[1:i]')} + coalesce({_SIZES.format('words[1:i - 1]')}, 0))::int as place from (select *, unnest(range(1, len(words) + 1)) i from f)),
 b as (select *, left(text, place) as before from h), r as (select *, regexp_extract_all(before, {_text(V.PAPER_REF)}) refs, regexp_split_to_array(before, {_text(V.PAPER_REF)}) after_ref, regexp_extract_all(before, {_SITE}) sites, regexp_split_to_array(before, {_SITE}) after_site from b),
 s as (select *, case when len(refs) > 0 then length(after_ref[-1]) + length(refs[-1]) when len(sites) > 0 then least(length(before), length(after_site[-1]) + length(sites[-1]) + 1500) else least(length(before), 20000) end as n from r),
 g as (select *, right(before, n) as head from s)
 select paper, place as at, lower(regexp_replace(word, '\\s+', ' ', 'g')) as phrase, len(list_filter(range(1, len(pages) + 1), lambda i: coalesce({_SIZES.format('pages[1:i - 1]')}, 0) + i - 1 <= place))::int as page,
  regexp_replace(case when len(refs) > 0 then regexp_extract(refs[-1], {_text(V.PAPER_REF)}, 1) else regexp_extract(left(head, 3000), {_text(V.PAPER_BARE_REF)}) end, '[.,]+$', '') as ref,
  try_cast(regexp_extract(left(head, 5000), {_text('(?i)' + V.PAPER_GRID)}, 1) as int) as easting, try_cast(regexp_extract(left(head, 5000), {_text('(?i)' + V.PAPER_GRID)}, 2) as int) as northing from g""")
def paper_passages(spark, sf):
    """Where papers use the phrases, and the application that each belongs to."""
    return papers.passages(council_papers(spark, sf)).select("paper", "at", "phrase", "page", "ref", "easting", "northing")


@query()
def paper_statements(spark, sf):
    """Sentences that say it of the site itself; tested against a plain reading of each paper."""
    return papers.addressed(papers.statements(council_papers(spark, sf)))


@query()
def committee_leads(spark, sf):
    """Statements judged as leads: kind, weight and evidence."""
    told = papers.statements(council_papers(spark, sf)).withColumns({
        "council": F.lit("Test Valley"), "committee": F.lit("Southern Area Planning Committee"), "meeting": F.date_add(F.lit("2012-01-01").cast("date"), (F.col("paper") % 4000).cast("int")),
    })
    return judges.committee(told, F.lit("2026-01-10").cast("date"))


RESULTS = (
    '<p><a title="x" href="ieListDocuments.aspx?CId={k}&amp;MId=7">{d}&#47;0{m}&#47;2021 - Planning &amp; Plans Committee (1)</a> said <a href="ieListDocuments.aspx?CId={k}&amp;MId=7#AI9">Item <b>{k}</b></a> and <a href="documents/s{k}/Report &amp; plan.pdf#search=x">Report  on {t}</a></p>'
    '<p><a href="ieListDocuments.aspx?CId=1&MID=8">31&#47;02&#47;2020 - Cabinet (22)</a> <a href="mgConvert2PDF.aspx?ID={k}&amp;T=1">Paper</a></p><p><a href="ieListDocuments.aspx?CId=1&MID=9">01&#47;02&#47;2020 - Other (2)</a> nothing</p>'
)


def result_pages(spark, sf):
    k = F.col("page_id")
    put = F.lit(RESULTS)
    for mark, value in (("{k}", k.cast("string")), ("{d}", F.lpad((1 + k % 28).cast("string"), 2, "0")), ("{m}", (1 + k % 9).cast("string")), ("{t}", F.regexp_extract("html", "<title>([^<]*)</title>", 1))):
        put = F.replace(put, F.lit(mark), value)
    return v.table(spark, sf, "pages").select(k.alias("id"), F.lit("https://papers.example").alias("base"), put.alias("html"))


@query("""with p as (select page_id as id, page_id::varchar as k, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) as t from pages)
 select id, 0 as n, 'Planning & Plans Committee' as committee, '2021-0' || (1 + id % 9) || '-' || lpad((1 + id % 28)::varchar, 2, '0') as meeting, 'Item ' || k as item, 'https://papers.example/documents/s' || k || '/Report & plan.pdf' as url,
  trim('Report on ' || replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')) as title from p
 union all select id, 1, 'Cabinet', '', '', 'https://papers.example/mgConvert2PDF.aspx?ID=' || k || '&T=1', 'Paper' from p""")
def paper_search_hits(spark, sf):
    """Papers listed on pages of search results."""
    return papers.search_hits(result_pages(spark, sf))
