"""Council papers against a plain reading, one paper at a time, and on texts of our own."""

import re

from pyspark.sql import functions as F

from waymark.functions import vocabulary as V
from waymark.operators import papers
from waymark.plans import paper_queries as pq

SF = "/root/testdata/sf0.001"


def squash(text):
    return re.sub(r"\s+", " ", text)


def plain_sentence(text, at, upto):
    """By walking over full stops."""
    end = re.compile(V.SENTENCE_END)
    before, after = squash(text[max(0, at - 400) : at]), squash(text[upto : upto + 400])
    stops = [m.end() for m in end.finditer(before)]
    head = before[stops[-1] :] if stops else before[-200:]
    stop = end.search(after)
    tail = after[: stop.end()] if stop else after[:200]
    out = (head.split(";")[-1] + squash(text[at:upto]) + tail.split(";")[0]).strip()
    return re.sub(r"^\d+(\.\d+)+\.?\s+", "", out)


def plain_reading(pages):
    """(at, page, phrase, sentence, ref, site, proposal, grid) of one paper."""
    text = "".join((p or "") + "\n" for p in pages or [])
    value = lambda label, head: squash(m[1]).strip(" ,") if (m := re.search(label + V.PAPER_VALUE, head, re.S)) else ""
    out = []
    for m in re.finditer("|".join(r"\s+".join(p.split()) for p in V.PAPER_PHRASES), text, re.I):
        said, before = plain_sentence(text, m.start(), m.end()), text[: m.start()]
        if any(re.search(p, said, re.I) for p in (V.PAPER_ELSEWHERE, V.PAPER_RULE, V.PAPER_GONE)) or said.endswith("?") or len(said) > 320:
            continue
        refs, sites = list(re.finditer(V.PAPER_REF, before)), list(re.finditer(V.PAPER_SITE + V.PAPER_VALUE, before, re.S))
        start = refs[-1].start() if refs else max(0, sites[-1].start() - 1500 if sites else len(before) - 20000)
        head = before[start:]
        bare = re.search(V.PAPER_BARE_REF, head[:3000])
        ref = refs[-1][1] if refs else bare[0] if bare else ""
        grid = re.search(V.PAPER_GRID, head[:5000], re.I)
        page, seen = 0, 0
        for p in pages:
            page += seen <= m.start()
            seen += len(p or "") + 1
        site = re.sub(r"^(Comments|Details)\s+", "", value(V.PAPER_SITE, head))[:200]
        out.append((m.start(), page, squash(m[0]).lower(), said, ref.rstrip(".,"), site, value(V.PAPER_PROPOSAL, head)[:300], *((int(grid[1]), int(grid[2])) if grid else (None, None))))
    return out


COLUMNS = ["at", "page", "phrase", "sentence", "ref", "site", "proposal", "easting", "northing"]
ODD = [
    (1, None), (2, []), (3, [None, ""]), (4, ["Nothing here."]), (5, ["The barn has stood", "empty for years."]), (6, ["x " * 9000 + "It is dilapidated. " + "y " * 9000]),
    (7, ["APPLICATION NUMBER 22/00362/FULLS\n\nSITE: Details Mill House,\n Low Road\nPROPOSAL - Sheds\nWARD x\n", None, "3.10.2. The mill is boarded\n\nup! Then", "APPLICATION REF: 1/2/3A.\nIt has been empty since e.g. 2001, approx. May; no; fallen into   disrepair"]),
    (8, ["Site Old Yard\n12/12345/OUT Map Ref (E) 480388 (N) 104217 the yard has become derelict, at No. 4 St. John's Rd. Mr. X said. And", "Is it out of use since 1990?"]), (9, ["Dilapidated dilapidated DILAPIDATED"]), (9, ["Dilapidated dilapidated DILAPIDATED"]),
    (10, ["It has been vacant for " + "long " * 100 + "."]), (11, ["Höfe, Ünïcode 日本語. Das Haus has never been occupied. 👍 safety fencing"]),
]


def told(df):
    return sorted((r.paper, *[r[c] for c in COLUMNS]) for r in papers.statements(df).collect())


def order(rows):
    return sorted(rows, key=repr)


def test_statements_of_odd_papers(spark):
    df = spark.createDataFrame(ODD, "paper long, pages array<string>")
    want = [(k, *row) for k, pages in ODD for row in plain_reading(pages)]
    got = [(r.paper, *[r[c] for c in COLUMNS]) for r in papers.statements(df).collect()]
    assert order(got) == order(want) and len(want) >= 9
    assert papers.statements(df.limit(0)).count() == 0


def test_statements_of_the_documents(spark):
    df = pq.council_papers(spark, SF).cache()
    want = [(r.paper, *row) for r in df.collect() for row in plain_reading(r.pages)]
    got = [(r.paper, *[r[c] for c in COLUMNS]) for r in papers.statements(df).collect()]
    assert order(got) == order(want) and len(want) > 50


def test_addresses_and_committees(spark):
    sites = [("Golden Hill , Belbins, Romsey, SO51 0PE, ROMSEY EXTRA", "Golden Hill, Belbins, Romsey", "SO51 0PE"), ("OLD YARD, LOW ROAD", "OLD YARD, LOW ROAD", None), ("", "", None), (None, "", None), ("The Mill", "The Mill", None), ("Mill Ba11aa", "Mill Ba11aa", "BA1 1AA")]
    df = spark.createDataFrame([(i, s) for i, (s, *_) in enumerate(sites)], "i long, site string")
    got = {r.i: (r.address, r.postcode) for r in papers.addressed(df).collect()}
    assert got == {i: (a, p) for i, (_, a, p) in enumerate(sites)}
    names = spark.createDataFrame([("Development Control (1998-2003)", True), ("Planning 2009 – 2019", False), ("Planning", False), (None, False)], "n string, w boolean")
    assert all(r.w == r.x for r in names.withColumn("x", papers.wound_up(F.col("n"))).collect())
