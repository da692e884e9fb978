"""Queries that once did less than their whole job."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_every_trial_is_listed_in_its_phase(spark):
    rows = E.queries()["agg_11_trial_phases"](spark, SF).collect()
    assert sum(len(r.trials.split(",")) for r in rows) == spark.read.parquet(f"{SF}/part.parquet").count()
    assert all(r.trials.split(",")[0] == r.latest_trial and len(r.trials.split(",")) == r.n for r in rows)


def test_the_dashboard_has_highlights_of_every_watchlist(spark):
    rows = E.queries()["ds_15_dashboard"](spark, SF).collect()
    shown = {r.section for r in rows if r.section.startswith("highlights-")}
    from signaldesk.sources import views as V

    assert shown == {f"highlights-{r.watchlist_id}" for r in V.watchlist_members(spark, SF).select("watchlist_id").distinct().collect()}
    assert len(shown) > 3
