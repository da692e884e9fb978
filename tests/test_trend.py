"""Company trends take the mean of the changes as the SQL does, to the last bit."""

from signaldesk.operators import ranking as RK


def test_trend_is_the_mean_of_consecutive_changes(spark):
    rows, want = [], {}
    for k, (i, j) in enumerate((i, j) for i in range(0, 3000, 7) for j in range(0, 9000, 370)):
        scores = (i / 100, j / 100, (i + 1000) / 100)
        mean = ((scores[1] - scores[0]) + (scores[2] - scores[1])) / 2
        want[k] = "improving" if mean > 5 else "stable"
        rows += [(k, n, n, "complete", s, 0, 0) for n, s in enumerate(scores)]
    f = spark.createDataFrame(rows, "company_id long, filing_id long, filed_at int, status string, composite_score double, risk_n int, opp_n int")
    got = {r.company_id: r.direction for r in RK.company_trend(f).collect()}
    assert got == want
