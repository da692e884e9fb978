"""Registered queries on the smallest tables; streams and reruns."""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from signaldesk.catalog import load_all
from signaldesk.streaming import flows as ST

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark".split()
SAMPLE = ["flagship_pending_filings", "win_1_representative", "jn_6_prior_asof", "jn_9_entity_tags", "jn_16_best_match", "agg_8_usage_stats",
          "set_2_catalysts", "ds_3_news_ingest", "ds_14_watchlist_briefing", "ds_17_enrichment_queue", "stm_1_incremental_ingest",
          "stm_3_usage_totals"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(*cols).collect()), key=repr)
    rel = duck.execute(oracle_sql()[name])
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in cols]
    want = sorted((plain([r[i] for i in order]) for r in rel.fetchall()), key=repr)
    assert got == want and got


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_every_query_has_a_callable_and_most_an_oracle():
    every = load_all()
    without = sorted(n for n, (_, sql) in every.items() if not sql)
    assert without == []
    assert len(every) > 165


def test_appends_over_many_batches_and_reruns(spark, tmp_path):
    stored = spark.createDataFrame([(900,), (5,)], "k int")
    handle = ST.append_new(str(tmp_path), "k", "o", stored, buckets=16)
    batches = [[(1, 2, "b"), (1, 1, "a"), (5, 1, "x")], [(2, 1, "c"), (1, 0, "late")], [(3, 1, "d"), (2, 9, "again"), (900, 1, "x")], [(1, 1, "z"), (4, 1, "e")]]
    want = [{(1, "a")}, {(2, "c")}, {(3, "d")}, {(4, "e")}]
    for n in (0, 1, 1, 2, 3, 3, 2):   # batches run again after a failure
        handle(spark.createDataFrame(batches[n], "k int, o int, v string"), n)
        assert {(r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/rows/batch={n}").collect()} == want[n]
    assert sorted(r["v"] for r in ST.appended(spark, str(tmp_path)).collect()) == ["a", "c", "d", "e"]


def test_a_batch_reads_and_rewrites_only_its_buckets(spark, tmp_path):
    initial = spark.range(400).selectExpr("id AS k", "id * 10 AS v")
    handle = ST.upsert_snapshot(str(tmp_path), ["k"], ["v"], initial, buckets=32)
    state = ST.Buckets(f"{tmp_path}/state", ["k"], 32)
    rows = [[(1, 10), (2, 21)], [(2, 22), (1000, 7)], [(3, 30), (2, 22), (1000, 8)]]
    for n, batch in enumerate(rows):
        df = spark.createDataFrame(batch, "k long, v long")
        touched = state.touched(state.placed(df))
        read = {int(b) for f in state.read(spark, "k long, v long", n, touched).inputFiles() for b in re.findall(r"bucket=(\d+)", f)}
        assert read <= set(touched) and len(touched) < 4
        handle(df, n)
        assert {b for b, v in state.manifest(spark, n + 1).items() if v == n} == set(touched)
    handle(spark.createDataFrame(rows[2], "k long, v long"), 2)
    found = {r["k"]: r["v"] for r in ST.snapshot(spark, str(tmp_path), ["k"], "k long, v long").collect()}
    assert found == {k: k * 10 for k in range(400)} | {2: 22, 1000: 8}
    log = {(r["batch"], r["k"]): r["action"] for r in ST.actions(spark, str(tmp_path)).collect()}
    assert log == {(0, 1): "unchanged", (0, 2): "update", (1, 2): "update", (1, 1000): "insert", (2, 3): "unchanged", (2, 2): "unchanged", (2, 1000): "update"}
