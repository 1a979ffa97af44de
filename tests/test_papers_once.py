"""What is dear is worked out once for each record: nothing of it moves below a filter, or above the rows that it is asked for."""

from waymark.operators import papers
from waymark.plans.paper_queries import council_papers

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_labels_of_a_paper_are_located_once(spark):
    told = plan(papers.passages(council_papers(spark, SF)))
    above, _, below = told.partition("Generate explode")
    assert "regexp_extract_all" not in above
    assert below.count("regexp_extract_all") == 6  # gaps and finds of phrases, references and sites


def test_a_sentence_is_made_once(spark):
    assert plan(papers.statements(council_papers(spark, SF))).count("(?<!\\bNos)") <= 5  # as often as sentence_around itself names it
