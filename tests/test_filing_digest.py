"""Filing gates on a document's digest equal those on its text, and each document is read once."""

from pyspark.sql import functions as F

from signaldesk.catalog import q_datasets as Q
from signaldesk.functions import classify as C, scores as M

SF = "/root/testdata/sf0.001"


def test_digest_holds_the_words_that_the_text_holds(spark):
    filler = "x " * 300
    texts = [None, "", "plain", filler + "Phase 3 data", "executive " + filler, filler + "warning\nletter", filler + "FDA ΟΣ RESULTS", "Ended six months " + filler + "approvals"]
    heads = [(None, None), ("Chief", "5.02"), ("Six months", "warning"), ("", "")]
    rows = [(f, t, i, x) for f in ("6-K", "8-K", "10-K") for t, i in heads for x in texts]
    df = spark.createDataFrame(rows, "f string, t string, i string, x string")

    def made(text):
        return (C.passes_ingest_gate("f", F.lit("a"), "i", "t", text), C.filing_event_type("f", F.array("i"), "t", text), M.material_score(text),
                C.is_periodic_6k("t", "i", text), C.is_material_8k(F.array("i"), "t", text))

    whole, short = df.withColumn("r", F.concat_ws("\n", "t", "x")), df.withColumn("r", F.concat_ws("\n", "t", C.filing_digest("x")))
    assert whole.select(*made("r")).collect() == short.select(*made("r")).collect()
    # Straight behind a title, without a line break, too.
    assert df.select(C.is_periodic_6k("t", "i", "x"), C.is_material_8k(F.array("i"), "t", "x")).collect() == df.withColumn("x", C.filing_digest("x")).select(
        C.is_periodic_6k("t", "i", "x"), C.is_material_8k(F.array("i"), "t", "x")).collect()


def test_ingest_joins_no_whole_text(spark):
    raw, _ = Q._raw_filings(spark, SF)
    assert raw.agg(F.max(F.length("raw_text"))).first()[0] < 1_000


def test_ingest_reads_texts_once(spark):
    from signaldesk.catalog import load_all

    out = load_all()["ds_2_filing_ingest"][0](spark, SF)
    assert "documents.parquet" not in out._jdf.queryExecution().executedPlan().toString()
