"""The corpus pipeline's stages, each against a plain version on its own input."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from signaldesk.llm import bpe, quality_rules, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into every stage and what comes out, on the smallest documents with edited copies planted among them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng, planted = random.Random(1), []
    for i, r in enumerate(docs.where("n_chars > 900").orderBy("doc_id").limit(12).collect()):
        words = r["text"].split(" ")
        for k, share in enumerate((0.01, 0.03, 0.2)):
            text = " ".join("zebra" if rng.random() < share else w for w in words)
            planted.append((900_000 + 10 * i + k, text, r["lang"], r["source"], len(text)))
    base = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    base = base.unionByName(spark.createDataFrame([(None, planted[0][1], None, None, None), (990_001, None, "en", "a", 0), (990_002, "", "en", "a", 0)], docs.schema))
    base = base.withColumn("node", F.lit(7)).withColumn("Row_", F.lit("x"))
    out = [base]
    for _, stage in CP.STAGES:
        df = stage(spark, out[-1], SF)
        rows = df.collect()
        out.append(spark.createDataFrame(rows, df.schema))
    return out


def test_stages_keep_the_columns(stages):
    assert [s.columns for s in stages[:-1]] == [stages[0].columns] * len(stages[:-1])
    assert [name for name, _ in CP.STAGES] == ["quality rules", "toxicity", "near copies", "decontamination", "tokens"]
    counts = [s.count() for s in stages]
    assert all(a >= b > 0 for a, b in zip(counts, counts[1:])) and counts[4] == counts[5]


def test_quality_stage_equals_the_sql(stages):
    con = duckdb.connect()
    con.register("frame", stages[0].select("doc_id", "text").toArrow())
    con.execute("CREATE TABLE documents AS SELECT * FROM frame")
    verdicts = con.execute(quality_rules.QUALITY_SQL)
    names = [d[0] for d in verdicts.description]
    want = sorted((r[names.index("doc_id")] for r in verdicts.fetchall() if r[names.index("kept")]), key=str)
    assert sorted((r["doc_id"] for r in stages[1].collect()), key=str) == want and 990_001 not in want and 990_002 not in want


def test_near_copy_stage_equals_all_pairs(stages):
    rows = [(r["doc_id"], simhash.shingles_of((r["text"] or "").encode())) for r in stages[2].collect()]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = rows[i][1], rows[j][1]
            shared = len(x & y)
            if x == y or (shared and 5 * shared >= 4 * (len(x) + len(y) - shared)):
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    want = sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=str)
    assert sorted((r["doc_id"] for r in stages[3].collect()), key=str) == want


def test_token_stage_equals_the_library(stages):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(bpe.vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    for r in stages[5].collect():
        ids = model.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
