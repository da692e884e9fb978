"""A large alias dictionary: texts' grams are filtered where they are read, and no match is lost."""

from pyspark.sql import functions as F

from signaldesk.operators import tagging as G


def test_filter_keeps_every_match_and_drops_the_rest_before_the_exchange(spark):
    pieces = spark.range(5000).select((F.col("id") * 7).alias("company_id"), F.concat(F.lit("t"), (F.col("id") * 7).cast("string")).alias("_gram"))
    grams = spark.range(35000).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("_gram"))
    found = G.meet_pieces(grams, pieces, rows=10)
    assert sorted(r["id"] for r in found.collect()) == [7 * i for i in range(5000)]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    blooms, blocks = G.gram_filter(pieces.select("_gram"), 5000)
    assert blooms.count() == blocks and {r[0] for r in blooms.select(F.size("_bits")).collect()} == {G.BLOCK_WORDS}
    block, word, bits = G._place("_gram", blocks)
    passed = grams.join(F.broadcast(blooms), (block == F.col("_block")) & (F.get("_bits", word).bitwiseAND(bits) == bits)).count()
    assert 5000 <= passed < 8000


def test_large_dictionary_tags_like_a_small_one(spark, monkeypatch):
    companies = spark.createDataFrame([(1, "Acme Gene Works Of Ohio", "AGW"), (2, "Bolt", None), (3, "", "Z9")], "company_id long, name string, ticker string")
    texts = spark.createDataFrame([(1, "Acme gene works of OHIO and z9"), (2, "acme gene works"), (3, ""), (4, None), (5, "bolt, bolt")], "k long, t string")

    def tags():
        return {r["k"]: (r["company_tag_ids"], r["mentioned"]) for r in G.with_tags(texts, "k", "t", G.alias_dictionary(companies)).collect()}

    want = tags()
    assert want[1] == ([1, 3], ["Acme Gene Works Of Ohio", "Z9"]) and want[5] == ([2], ["Bolt"]) and want[2] == want[3] == want[4] == ([], [])
    monkeypatch.setattr(G, "is_small", lambda df, rows=0: False)
    assert tags() == want


def test_runs_that_no_piece_begins_are_not_built(spark, monkeypatch):
    built, plain = [], G.meet_pieces
    monkeypatch.setattr(G, "meet_pieces", lambda grams, pieces: (built.append(grams.count()), plain(grams, pieces))[1])
    companies = spark.createDataFrame([(1, "Acme Gene Works Of Ohio", None)], "company_id long, name string, ticker string")
    texts = spark.createDataFrame([(1, "other words " * 50 + "Acme gene works of Ohio")], "k long, t string")
    hits = G.phrase_matches(texts, "k", "t", G.alias_dictionary(companies)).collect()
    assert [(r["k"], r["company_id"]) for r in hits] == [(1, 1)]
    # Pieces begin with "acme" and "works": three runs each, of 105 words.
    assert built == [6]
