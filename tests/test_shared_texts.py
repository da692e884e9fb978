"""Texts that many filings share: exchanged once, read once, compared once a pair."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from signaldesk.functions import scores as M

SF = "/root/testdata/sf0.001"


def joins(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(" Join " in f" {line.lstrip(' :+-|')}" for line in plan.splitlines())


def test_a_filing_text_takes_part_in_one_join(spark):
    for name in ("flt_3_periodic_6k", "flt_4_material_8k", "flt_5_ingest_gate", "str_14_filing_event_type", "str_27_staleness",
                 "str_28_rule_summary", "str_29_list_summary", "agg_15_number_mean"):
        assert joins(E.queries()[name](spark, SF)) == 1, name


def test_pairs_of_shared_texts_have_the_novelty_of_whole_texts(spark):
    from signaldesk.operators import texts as X

    bodies = spark.createDataFrame([(1, "A b  c"), (2, "b\nD "), (3, ""), (4, None)], "doc_id long, text string")
    heads = spark.createDataFrame([("a B",), ("c",), ("",), (None,)], "head string")
    now = bodies.crossJoin(heads).withColumn("raw", F.concat_ws("\n", "head", "text"))
    prior = now.select(*[F.col(c).alias(f"prior_{c}") for c in now.columns])
    both = now.crossJoin(prior)
    whole = both.select(*X.PAIR, M.novelty(M.word_set("raw"), M.word_set("prior_raw")).alias("novelty"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(X.pair_novelty(both.select(*X.PAIR), bodies).collect(), key=key) == sorted(whole.collect(), key=key)
    # A row without a prior filing keeps the value of no prior text, and repeated rows each keep theirs.
    rows = spark.createDataFrame([(7, 1, None, None, None), (8, 1, None, None, None)],
                                 "filing_id long, doc_id long, head string, prior_doc_id long, prior_head string")
    out = X.with_pairs(rows, X.scored_pairs(rows, bodies)).collect()
    assert sorted((r.filing_id, r.novelty) for r in out) == [(7, 65.0), (8, 65.0)]


def test_words_of_pairs_go_in_waves_that_leave_no_exchange(spark, monkeypatch):
    """The words of all pairs are never exchanged at once, and no text is: the result only reads what its waves wrote."""
    from signaldesk.operators import texts as X

    bodies = spark.createDataFrame([(i, " ".join(f"w{i * k % 11}" for k in range(1, 9)) + f" {i}.5") for i in range(12)], "doc_id long, text string")
    pairs = spark.createDataFrame([(i, h, j, p) for i in range(12) for j in (i, 3, 7, 99, None) for h, p in (("w1 FDA 3", "x"), (None, None))],
                                  "doc_id long, head string, prior_doc_id long, prior_head string")
    at_once = X.pair_novelty(pairs, bodies)
    monkeypatch.setattr(X, "WAVE_BYTES", 2000)
    calls, compare = [], X._compare
    monkeypatch.setattr(X, "_compare", lambda *a: calls.append(a) or compare(*a))
    in_waves = X.pair_novelty(pairs, bodies)
    assert len(calls) > 2
    for out in (at_once, in_waves):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(in_waves.collect(), key=key) == sorted(at_once.collect(), key=key) and at_once.count() == pairs.distinct().count()
    found = X.features(pairs.select("doc_id", "head"), bodies)
    assert "text" not in "".join(c for c in found._jdf.queryExecution().executedPlan().toString().splitlines(True) if "Exchange" in c)
    whole = pairs.select("doc_id", "head").distinct().join(bodies, "doc_id").withColumn("raw", F.concat_ws("\n", "head", "text")).withColumn(
        "nums", M.number_list("raw")).select("doc_id", "head", M.material_score("raw").alias("material"), M.mean_of("nums").alias("mean"))
    assert sorted(found.collect(), key=key) == sorted(whole.collect(), key=key)


def test_filings_leave_no_exchange_to_the_stories_behind_them(spark):
    """Both halves of the rerank never hold their exchanges together."""
    plan = E.queries()["ds_6_caps_then_rerank"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "filing_id" not in plan
