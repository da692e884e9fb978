"""Admission and candidates over long queues against a plain walk and a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from signaldesk.operators.admission import admit
from signaldesk.plans import enrichment as ENR


def walk(rows, primary, override, full, short, limit, primary_micro, override_micro):
    """rows in order: (item_id, eligible, tier, micro)."""
    counts, money, tiers, taken = {"primary": primary, "override": override}, {"primary": primary_micro, "override": override_micro}, {"full_ai": full, "short_ai": short}, []
    for item, eligible, tier, micro in rows:
        kinds = [k for k in counts if counts[k] > 0 and money[k] > 0 and (k == "primary" or eligible)]
        open_tiers = [t for t in (("full_ai", "short_ai") if tier == "full_ai" else ("short_ai",)) if tiers[t] > 0]
        if len(taken) < limit and kinds and open_tiers:
            counts[kinds[0]] -= 1
            money[kinds[0]] -= micro
            tiers[open_tiers[0]] -= 1
            taken.append((item, kinds[0], open_tiers[0]))
    return taken


@pytest.mark.parametrize("budgets", [
    dict(primary=12, override=8, full=8, short=30, limit=25), dict(primary=3, override=40, full=2, short=60, limit=30),
    dict(primary=50, override=5, full=9, short=7, limit=60), dict(primary=30, override=30, full=30, short=30, limit=40, primary_micro=400, override_micro=90)])
def test_admission_walks_the_whole_queue(spark, budgets):
    rng, rows = random.Random(1), []
    for queue, share in (("a", 0.5), ("b", 0.002), ("c", 0.0)):
        # Eligible rows are rare and far behind in some queues.
        rows += [(queue, len(rows) + i, float(i), rng.random() < share and i > 500, rng.choice(["full_ai", "short_ai"]), rng.randint(0, 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "queue string, item_id long, place double, eligible boolean, tier string, micro long")
    found = admit(df, [F.col("place").asc()], **budgets)
    assert "Python" not in found._jdf.queryExecution().toString()
    got = sorted(map(tuple, found.collect()))
    money = {"primary_micro": 1 << 60, "override_micro": 1 << 60}
    want = []
    for queue in "abc":
        mine = [(r[1], r[3], r[4], r[5]) for r in sorted(rows, key=lambda r: r[2]) if r[0] == queue]
        want += [(queue, item, k, kind, tier) for k, (item, kind, tier) in enumerate(walk(mine, **(money | budgets)), 1)]
    assert got == sorted(want)


def test_best_rows_read_few_texts(spark):
    rng = random.Random(2)
    rows = [("q", i, f"2024-01-{rng.randint(1, 28):02d} 00:00:00", float(rng.randint(0, 60)), round(rng.random() * 100, 2)) for i in range(3000)]
    texts = [(i, rng.choice(["plain words", "a merger and an acquisition", "guidance"])) for i in range(3000)]
    queue = spark.createDataFrame(rows, "queue string, item_id long, ts string, cheap double, base double").withColumn("ts", F.col("ts").cast("timestamp"))
    bodies = spark.createDataFrame(texts, "item_id long, body string")
    score = lambda m: F.round(F.col("base") + 0.3 * m, 2)
    whole = ENR.read(queue, bodies, score).orderBy(*ENR.order()).limit(20).select("item_id", "priority").collect()
    best = ENR.best_rows(queue, bodies, ["queue"], 20, score).orderBy(*ENR.order()).select("item_id", "priority").collect()
    assert best == whole
    assert ENR.reading_list(queue, bodies, ["queue"], 20, score).count() < 1200
    assert ENR.best_rows(queue, bodies, ["queue"], 5000, score).count() == 3000
