"""Expression units on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from signaldesk.functions import classify as C, dates as D, scores as M, summaries as R, text as T

NOW = "2026-03-29 12:00:00"


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def lit(x):
    return F.lit(x)


def test_forms_keys_and_labels(spark):
    r = one(spark, a=T.normalize_form(lit(" 10-q/a ")), b=T.comparable_group(lit("20-F/A")), c=T.comparable_group(lit("8-K")),
            d=T.pad_key(lit("123")), e=T.pad_key(lit(None).cast("string")), f=T.reason_label(lit("sic-allowlist")),
            g=T.reason_label(lit("odd-case")))
    assert r == ("10-Q", "annual", "interim", "0000000123", "0000000000", "Core life sciences SIC filter", "Odd Case")


def test_six_k_and_eight_k_gates(spark):
    r = one(spark,
            a=C.is_periodic_6k(lit("Interim results"), lit(None).cast("string"), lit("Quarterly results and six months ended 2024")),
            b=C.is_periodic_6k(lit("Other announcement"), lit(None).cast("string"), lit("Executive appointment")),
            c=C.is_material_8k(F.array(lit("7.01")), lit("Note"), lit("nothing here")),
            d=C.is_material_8k(F.array(lit("2.02")), lit("Note"), lit("nothing here")))
    assert tuple(r) == (True, False, False, True)


def test_urls_and_html(spark):
    r = one(spark, a=T.canonical_url(lit("https://x.example/a/b;v=1?utm=test#top")),
            b=T.inline_text(lit("A &amp; B  <b>bold</b>\n text")), c=T.resolve_url(lit("https://x.example/a/b.html"), lit("c.html")),
            d=T.resolve_url(lit("https://x.example"), lit("/n")), e=T.resolve_url(lit("https://x.example/a"), lit("//y.example/z")))
    assert tuple(r) == ("https://x.example/a/b", "A & B bold text", "https://x.example/a/c.html", "https://x.example/n",
                        "https://y.example/z")


def test_names(spark):
    r = one(spark, a=T.sponsor_text(lit("Société Générale & Co.")), b=T.sponsor_text_full(lit("Société Générale & Co.")),
            c=T.core_compact_name(lit("Apex Bio Holdings, Inc.")), d=T.core_compact_name(lit("SE")), e=T.compact_name(lit("A-B c")))
    assert tuple(r) == ("societe generale and co", "societe generale and co", "apexbio", "se", "abc")


def test_noise_and_clean(spark):
    text = "Revenue rose\r\n\xa0 Revenue rose\n12\nus-gaap:X\nmrk:A us-gaap:B 2024-12-31 0000310158\nTRUE\nhttps://a.b/c\nNote: cash – flow"
    got = one(spark, a=T.clean_extracted(lit(text)))[0]
    assert got == "Revenue rose\nNote: cash - flow"


def test_dates(spark):
    r = one(spark, a=D.parse_lenient_date(lit("May 2024")), b=D.parse_lenient_date(lit("2024-13-01")),
            c=D.parse_published(lit("Mon, 05 Feb 2024 10:00:00 -0500")), d=D.parse_calendar(lit("04/30/2026")),
            e=D.parse_acceptance(lit("20240102030405")), f=D.display_date(lit("2026-04-05 00:00:00").cast("timestamp")),
            g=D.parse_month_day_year(lit("March  4, 2024")))
    assert r.a == dt.date(2024, 5, 1) and r.b is None
    assert r.c == dt.datetime(2024, 2, 5, 15) and r.d == dt.datetime(2026, 4, 30)
    assert r.e == dt.datetime(2024, 1, 2, 3, 4, 5) and r.f == "Apr 5, 2026" and r.g == dt.datetime(2024, 3, 4)


def test_digest_windows_cross_summer_time(spark):
    s, e = D.digest_window("2026-03-09 12:00:00", "daily")
    w, x = D.digest_window("2026-03-11 12:00:00", "weekly")
    r = one(spark, s=s, e=e, w=w, x=x)
    assert (r.s, r.e) == (dt.datetime(2026, 3, 8, 5), dt.datetime(2026, 3, 9, 4))
    assert (r.w, r.x) == (dt.datetime(2026, 3, 2, 5), dt.datetime(2026, 3, 9, 4))


def test_recency_steps(spark):
    hours = [0, 24, 72, 168, 169, 100000, -5]
    rows = spark.createDataFrame([(h,) for h in hours], "h int").withColumn(
        "ts", D.at(NOW) - F.make_dt_interval(F.lit(0), F.col("h"))).select("h", D.recency_score("ts", NOW).alias("s")).collect()
    got = {r.h: r.s for r in rows}
    assert [got[h] for h in (0, 24, 72, 168, 100000, -5)] == [100, 100, 80, 60, 10, 100]
    assert 22.99 < got[169] < 23.0


def test_material_and_delta(spark):
    r = one(spark, a=M.material_score(lit("FDA approval and guidance")), b=M.material_score(lit(None).cast("string")),
            c=M.quantitative_delta(lit(45.0), lit(5.0)), d=M.quantitative_delta(lit(None).cast("double"), lit(5.0)),
            e=M.quantitative_delta(lit(3.0), lit(None).cast("double")), f=M.mean_of(M.number_list(lit("rose 45% to $12.5"))))
    assert tuple(r) == (78.0, 0.0, 100.0, 10.0, 55.0, 28.75)


def test_novelty(spark):
    a, b = "Revenue increased 45%. FDA approval expected", "Revenue increased 5%."
    w = lambda t: M.word_set(lit(t))
    r = one(spark, x=M.novelty(w(a), w(a)), y=M.novelty(w(a), M.word_set(lit(None).cast("string"))), z=M.novelty(w(""), w(b)),
            w=M.novelty(w("a b"), w("b c")))
    assert (r.x, r.y, r.z, r.w) == (0.0, 65.0, 0.0, 66.67)


def test_complete_and_pending_scores(spark):
    done = M.filing_complete(lit(80.0), lit(100.0), lit(54.0), lit(90.0), lit(100.0), lit(100.0))
    wait = M.filing_pending(lit("8-K"), lit(54.0), lit(100.0), lit(0.0))
    news = M.news_complete(lit(90.0), lit(0.95), lit(0.0), lit(100.0), lit(False))
    r = one(spark, a=done["impact_score"], b=wait["composite_score"], c=news["composite_score"], d=news["confidence"])
    assert r.a > 70 and r.b == round(0.4 * (0.35 * 75 + 0.3 * 54 + 35) + 25, 2) and r.c > 70 and r.d == "medium"


def test_rule_summary_and_list_line(spark):
    df = spark.createDataFrame([("T", "One rises.  Two falls! Risk of delay, warning and litigation; approval of trial.")], "t string, x string")
    r = R.with_rule_summary(df, "t", "x").first()
    assert r.summary == "One rises. Two falls!" and r.risk_flags == ["Risk: risk", "Risk: warning", "Risk: litigation", "Risk: delay"]
    assert r.importance_score == 50.0 and r.material_changes == ["Detected: trial"]
    line = R.list_summary(lit("6-K"), lit("Q2"), lit("foreign-issuer-update"), F.array(lit("1.01")), None, lit(None).cast("string"))
    assert one(spark, a=line)[0] == "Foreign issuer update: Q2"
