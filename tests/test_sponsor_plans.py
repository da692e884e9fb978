"""Sponsor jobs: names are exchanged and sorted once, and pairs of name and company are ranked, not a study's rows."""

from pyspark.sql import functions as F

from signaldesk.operators import sponsors as P
from signaldesk.sources import views as V

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lead_sponsor_groups_after_the_exchange(spark):
    rows = spark.createDataFrame([("a", 2, "Two", "Lead"), ("a", 1, "One", None), ("b", 3, "Three", None), ("b", 4, None, "lead")],
                                 "nct_id string, id long, name string, lead_or_collaborator string")
    out = P.lead_sponsor(rows)
    above, below = _plan(out).split("Exchange", 1)
    assert above.count("SortAggregate") == 2 and above.count("Sort [") == 1 and "Aggregate" not in below
    assert sorted(map(tuple, out.collect())) == [("a", "Two"), ("b", "Three")]


def test_sponsor_pairs_are_dealt_before_they_are_made_distinct(spark):
    below = _plan(V.sponsors(spark, SF)).split("Exchange hashpartitioning(l_partkey", 1)[1]
    assert "Aggregate" not in below.split("BroadcastExchange")[0]


def test_best_match_ranks_pairs(spark):
    rows = spark.createDataFrame([("n1", "Acme Bio Inc"), ("n1", "acme bio"), ("n1", "Other"), ("n2", "Bio Acme"), ("n2", "acme bio"), ("n3", "Bio Acme"), ("n1", "acme bio"), ("gone", "acme bio")],
                                 "nct_id string, name string")
    companies = spark.createDataFrame([(1, "AB", "Acme Bio", [], []), (2, "OT", "Other", [], []), (3, "BA", "Bio Acme", [], ["Acme Bio"])],
                                      "company_id long, ticker string, name string, aliases array<string>, trial_aliases array<string>")
    out = P.best_matches(spark.createDataFrame([("n1",), ("n2",), ("n3",)], "nct_id string"), rows, P.sponsor_aliases(companies))
    assert "Window" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [
        (1, "n1", "acme bio", "Acme Bio", 320), (1, "n2", "acme bio", "Acme Bio", 320), (2, "n1", "Other", "Other", 320),
        (3, "n1", "acme bio", "Acme Bio", 320), (3, "n2", "Bio Acme", "Bio Acme", 320), (3, "n3", "Bio Acme", "Bio Acme", 320)]


def test_parts_and_spellings_never_pass_the_driver(spark):
    """The parts of names outgrow the estimate of their table many times, so that even those of a small file are not broadcast."""
    names = V.table(spark, SF, "supplier").select(F.translate("s_name", "#", " ").alias("name"))
    aliases = P.sponsor_aliases(V.sponsor_companies(spark, SF))
    for out in (P.name_matches(names, aliases), P.name_scores(names, aliases)):
        assert "Broadcast" not in _plan(out) and out.count() > 0


def test_rows_of_studies_never_pass_the_driver(spark):
    """Names are gathered for every study: the tables grow with the studies, whatever their estimate."""
    rows = V.conditions(spark, SF).select("*", F.length("name").alias("id"), F.lit("lead").alias("lead_or_collaborator"))
    out = P.study_rows(V.studies(spark, SF), rows, V.conditions(spark, SF), V.interventions(spark, SF))
    assert "Broadcast" not in _plan(out) and out.count() == V.studies(spark, SF).count()
