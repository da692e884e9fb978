"""Operators against brute force and on small literal frames."""

import datetime as dt
import random

from pyspark.sql import functions as F

from signaldesk.operators import admission, filters as O, linking as L, ranking as RK, sponsors as P, sync, tagging as G
from signaldesk.sources import pages as PG


def companies(spark):
    return spark.createDataFrame(
        [(1, "Apex Bio", "ABIO", 1_500_000_000, True), (2, "Beta Therapeutics", "BETA", 900_000_000, True), (3, "Short", "AB", None, True)],
        "company_id bigint, name string, ticker string, market_cap bigint, is_active boolean")


def test_tagging_whole_words_only(spark):
    texts = spark.createDataFrame([
        (1, "Abstract manufacturing note"), (2, "Apex Bio and Beta Therapeutics sign; apex bio again (ABIO)."), (3, "AB reports")], "k int, t string")
    got = {r.k: (r.company_tag_ids, r.mentioned) for r in G.tag_entities(texts, "k", "t", G.alias_dictionary(companies(spark))).collect()}
    assert got == {2: ([2, 1], ["Beta Therapeutics", "Apex Bio", "ABIO", "BETA"]), 3: ([3], ["AB"])}


def test_tagging_equals_brute_force(spark):
    rnd = random.Random(5)
    words = ["a", "b", "c", "d"]
    phrase = lambda lo, hi: " ".join(rnd.choice(words) for _ in range(rnd.randint(lo, hi)))
    aliases = sorted({(phrase(1, 7), rnd.randint(1, 14)) for _ in range(60)})
    docs = [(i, phrase(1, 40)) for i in range(60)]
    dictionary = spark.createDataFrame([(a, c, a) for a, c in aliases], "alias string, company_id bigint, mention string")
    got = {r.k: (r.company_tag_ids, r.mentioned) for r in G.tag_entities(
        spark.createDataFrame(docs, "k int, t string"), "k", "t", dictionary).collect()}
    want = {}
    for k, text in docs:
        ids, names = [], []
        for alias, company in sorted(aliases, key=lambda x: (-len(x[0]), x[0], x[1])):
            if f" {alias} " not in f" {text} ":
                continue
            if company not in ids:
                if len(ids) >= 10:
                    continue
                ids.append(company)
            if alias not in names:
                names.append(alias)
        if ids:
            want[k] = (ids, names)
    assert got == want


def test_percentile_single_ties_and_blocks(spark, monkeypatch):
    c = companies(spark)
    assert {r.company_id: r.pct for r in RK.market_percentiles(c).collect()} == {1: 100.0, 2: 0.0}
    assert RK.market_percentiles(c.filter("company_id = 1")).first().pct == 100.0
    monkeypatch.setattr(RK, "ID_BLOCK", 7)
    rnd = random.Random(1)
    rows = [(i, rnd.choice([5, 5, 5, 900, rnd.randint(1, 10**12)]), True) for i in range(300)]
    df = spark.createDataFrame(rows, "company_id bigint, market_cap bigint, is_active boolean")
    want = {r[0]: i / 299 * 100.0 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.company_id: r.pct for r in RK.market_percentiles(df).collect()} == want


def filings(spark, n=200, seed=3):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3]), rnd.choice(["10-K", "10-Q", "8-K", "S-1"]),
             dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 200))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "filing_id bigint, company_id bigint, normalized_form_type string, filed_at timestamp")


def test_prior_links_equal_brute_force(spark):
    rows, df = filings(spark)
    grp = lambda f: "annual" if f == "10-K" else "interim"
    strict, seq = {}, {}
    for i, c, f, t in rows:
        before = [(t2, i2) for i2, c2, f2, t2 in rows if c2 == c and grp(f2) == grp(f) and f2 != "S-1" and t2 < t]
        strict[i] = max(before)[1] if before else None
        prev = [(t2, i2) for i2, c2, f2, t2 in rows if c2 == c and grp(f2) == grp(f) and (t2, i2) < (t, i)]
        seq[i] = max(prev)[1] if prev else None
    assert {r.filing_id: r.prior_id for r in L.prior_strict(df).collect()} == strict
    assert {r.filing_id: r.prior_id for r in L.prior_sequential(df.repartition(7)).collect()} == seq


def test_rank_filters_push_a_group_limit(spark):
    _, df = filings(spark)
    plan = RK.top_n(df, ["company_id"], [F.col("filed_at").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_anti_joins_are_idempotent(spark):
    rows = spark.createDataFrame([(1, "u1", "h1"), (2, "u1", "h2"), (3, "u2", "h3"), (4, "u3", "h3")], "o int, url string, h string")
    none = rows.limit(0)
    first = sync.new_by_either(rows, none, ("url", "h"), "o")
    assert sorted(r.o for r in first.collect()) == [1, 3]
    assert sync.new_by_either(first, first, ("url", "h"), "o").count() == 0


def test_a_row_that_was_turned_away_takes_no_key(spark):
    rows = spark.createDataFrame([(1, "u1", "h1"), (2, "u2", "h1"), (3, "u2", "h3")], "o int, url string, h string")
    assert sorted(r.o for r in sync.new_by_either(rows, rows.limit(0), ("url", "h"), "o").collect()) == [1, 3]


def test_either_key_acceptance_follows_the_order(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", None]) and f"u{rng.randint(0, 90)}", f"h{rng.randint(0, 90)}" if rng.random() < 0.9 else None) for i in range(400)]
    rows += [(1000 + i, f"chain{i // 2}", f"link{(i + 1) // 2}") for i in range(12)]
    stored = [(-1, "u1", "h1"), (-2, "u2", "x")]
    schema = "o int, url string, h string"
    got = sync.new_by_either(spark.createDataFrame(rows, schema).repartition(5), spark.createDataFrame(stored, schema), ("url", "h"), "o")
    urls, hashes, want = {s[1] for s in stored}, {s[2] for s in stored}, []
    for o, url, h in rows:
        if url not in urls and h not in hashes:
            want.append(o)
            urls |= {url} - {None}
            hashes |= {h} - {None}
    assert sorted(r.o for r in got.collect()) == want


def test_sponsor_candidates_stay_near_the_matches(spark):
    rng = random.Random(4)
    # All names and aliases lead with the same words.
    code = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    codes = sorted({code() for _ in range(300)})
    names = spark.createDataFrame([(f"International Pharma Holdings {c.title()} {k}",) for c in codes for k in ("GmbH", "Ltd", "Trust")], "name string")
    aliases = P.sponsor_aliases(spark.createDataFrame([(i, f"T{i}", f"International Pharma Holdings {c}", [], []) for i, c in enumerate(codes)],
                                                             "company_id long, ticker string, name string, aliases array<string>, trial_aliases array<string>"))
    n = names.withColumn("_low", F.lower("name"))
    pairs = P.phrase_candidates(n, aliases).count()
    found = {(r["name"], r["company_id"]) for r in P.name_matches(names, aliases).collect()}
    want = {(r["name"], a["company_id"]) for r in names.collect() for a in aliases.collect() if a["loose"] and a["loose"] in r["name"].lower()}
    assert found == want and len(want) == 3 * len(codes)
    assert pairs <= 3 * len(want)


def test_snapshot_sync_insert_update_prune_and_failed_scope(spark):
    schema = "company_id int, nct_id string, title string, meta map<string,string>"
    new = spark.createDataFrame([(1, "N1", "new title", {"a": "2"}), (1, "N2", "x", {}), (2, "N5", "y", {})], schema)
    old = spark.createDataFrame([(1, "N1", "old title", {"a": "1", "b": "1"}), (1, "N9", "gone", {}), (2, "N8", "stay", {})], schema)
    ok = spark.createDataFrame([(1,)], "company_id int")
    got = {(r.company_id, r.nct_id): (r.action, r.meta) for r in sync.snapshot_actions(
        new, old, "company_id", "nct_id", ["title"], ok, "meta").collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, "N1"): "update", (1, "N2"): "insert", (1, "N9"): "delete", (2, "N8"): "keep"}
    assert got[(1, "N1")][1] == {"a": "2", "b": "1"}


def test_coverage_filter(spark):
    issuers = spark.createDataFrame([("0000000123", "IN", "2836"), ("0000000124", "OUT", "7372"), ("0000000125", "MAN", "7372"),
                                     ("0000000126", "NO", "2834")], "cik string, ticker string, sic string")
    codes = lambda *v: spark.createDataFrame([(x,) for x in v], "code string")
    got = {r.ticker: r.universe_reason for r in O.covered_companies(issuers, codes("man"), codes("0000000126")).collect()}
    assert got == {"IN": "sic-allowlist", "MAN": "manual-allowlist"}


def test_sponsor_matching(spark):
    c = spark.createDataFrame([(1, "QRTZ", "Quartz Hill Biologics Inc", ["QRTZ", "Qhb", "Silent Splice"], ["Quartz Trials"])],
                              "company_id bigint, ticker string, name string, aliases array<string>, trial_aliases array<string>")
    aliases = P.sponsor_aliases(c)
    assert [r.original for r in aliases.orderBy("alias_pos").collect()] == ["Quartz Trials", "Quartz Hill Biologics Inc", "Silent Splice"]
    sp = spark.createDataFrame([(1, "N1", "Rosequartz Trials LLC"), (2, "N2", "Quartz Trials"), (3, "N3", "Quartz Hill Biologics Inc."),
                                (4, "N4", "Friends of Silent Splice")], "id int, nct_id string, name string")
    st = sp.select("nct_id")
    got = {r.nct_id: (r.matched_alias, r.score) for r in P.best_matches(st, sp, aliases).collect()}
    assert got == {"N2": ("Quartz Trials", 320), "N3": ("Quartz Hill Biologics Inc", 300), "N4": ("Silent Splice", 150)}


def test_admission_spills_and_overrides(spark):
    rows = [("q", i, i, i in (3, 5), "full_ai" if i < 4 else "short_ai", 0) for i in range(1, 8)]
    cand = spark.createDataFrame(rows, "queue string, item_id bigint, rank int, eligible boolean, tier string, micro bigint")
    got = [(r.item_id, r.budget_kind, r.tier) for r in admission.admit(cand, [F.col("rank").asc()], 2, 2, 1, 3, 10).orderBy("rank").collect()]
    assert got == [(1, "primary", "full_ai"), (2, "primary", "short_ai"), (3, "override", "short_ai"), (5, "override", "short_ai")]


def test_link_entries_and_article_time(spark):
    html = ('<ul><li><a href="/news/long-title?x=1">A sufficiently long title</a> March 4, 2024</li><li><a href="mailto:x">Mail us right now please</a></li>'
            '<li><a href="/news/long-title">A sufficiently long title again</a></li><li><a href="/s">short</a></li></ul>')
    pages = spark.createDataFrame([(1, "https://ir.example.com/n", html), (2, "https://a.example/", '<meta property="article:published_time" '
                                   'content="2024-02-03T04:05:06Z"><article><p>Hello <b>there</b></p></article>')], "k int, u string, h string")
    got = PG.link_entries(pages, "k", "u", "h").collect()
    assert [(r.title, r.link, r.date_text) for r in got] == [
        ("A sufficiently long title", "https://ir.example.com/news/long-title", "March 4, 2024")]
    r = pages.filter("k = 2").select(PG.published_time("h").alias("t"), PG.article_text("u", "h").alias("b")).first()
    assert r.t == dt.datetime(2024, 2, 3, 4, 5, 6) and r.b == "Hello there"


def test_repeated_and_unmatched_quotes(spark):
    c = spark.createDataFrame([(1, "A", 5, "old"), (2, "B", 7, "old")], "company_id int, ticker string, market_cap long, market_cap_source string")
    q = spark.createDataFrame([("a", 10, "x", 1), ("A", 9, "y", 2)], "symbol string, market_cap long, source string, ordinal int")
    got = {r.company_id: (r.market_cap, r.market_cap_source, r.refreshed) for r in sync.market_cap_refresh(c, q).collect()}
    assert got == {1: (9, "y", True), 2: (7, "old", False)}
    assert [tuple(r) for r in sync.quote_fallback(c.select("ticker"), q, q.limit(0)).collect()] == [("A", 9, "batch")]


def test_repeated_incoming_key_counts_once(spark):
    new = spark.createDataFrame([("k", 1, 1), ("k", 2, 2), ("m", 3, 3)], "id string, v int, at int")
    old = spark.createDataFrame([("k", 2), ("z", 0)], "id string, v int")
    got = {r.id: (r.v, r.action) for r in sync.upsert_actions(new, old, ["id"], ["v"], ordinal="at").collect()}
    assert got == {"k": (2, "unchanged"), "m": (3, "insert"), "z": (0, "keep")}
