"""Company tagging: alias dictionary, whole-phrase matching, tag look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signaldesk.functions import text as T
from signaldesk.functions.dates import col
from signaldesk.operators.ranking import top_n
from signaldesk.runtime import BROADCAST_ROWS, is_small

ANCHOR_WORDS = 3
BLOCK_WORDS = 1024      # 64-bit words in a block of the filter
FILTER_BITS = 1 << 29   # at most: 64 MB; beyond it the filter passes more, and loses nothing


def alias_dictionary(companies: DataFrame, extra: str | None = None) -> DataFrame:
    """Names, tickers and extra aliases, normalised: (alias, company_id, mention, short).

    The first spelling wins when two normalise to one alias of a company.
    """
    spellings = [F.col("name")]
    if "ticker" in companies.columns:
        spellings.append(F.col("ticker"))
    listed = F.array(*spellings)
    if extra is not None:
        listed = F.concat(listed, F.coalesce(F.col(extra), F.array().cast("array<string>")))
    rows = companies.select("company_id", F.posexplode(listed).alias("pos", "mention")).withColumn(
        "alias", T.entity_text("mention")).filter("alias <> ''")
    first = rows.groupBy("company_id", "alias").agg(F.min_by("mention", "pos").alias("mention"))
    return first.withColumn("short", F.length("alias") < 3)


def _grams(words: DataFrame, key: str, heads: DataFrame | None = None) -> DataFrame:
    """(key, _pos, _gram) for every run of 1..ANCHOR_WORDS words of the array column ``_words``.

    Each word is set beside the next ones, so that all of it runs in compiled code; runs past the end are null and go.
    With ``heads`` (few rows ``_head``, broadcast) only runs that begin with one of these words are built.
    """
    ahead = F.arrays_zip(*[F.slice("_words", k + 1, F.size("_words")).alias(f"w{k}") for k in range(ANCHOR_WORDS)])
    at = words.select(key, F.posexplode(ahead).alias("_pos", "_z"))
    said = [F.col(f"_z.w{k}") for k in range(ANCHOR_WORDS)]
    if heads is not None:
        at = at.join(F.broadcast(heads), said[0] == F.col("_head"), "left_semi")
    runs = [F.concat(*[x for w in said[:n] for x in (F.lit(" "), w)][1:]) for n in range(1, ANCHOR_WORDS + 1)]
    return at.select(key, "_pos", F.explode(F.array(*runs)).alias("_gram")).filter(F.col("_gram").isNotNull())


def _alias_pieces(aliases: DataFrame) -> DataFrame:
    """Each alias as one gram, or, when longer, as the grams that cover it, with their word offsets."""
    words = aliases.select("alias", "company_id", "mention", F.split("alias", " ").alias("_w"))
    last = F.size("_w") - ANCHOR_WORDS
    offsets = F.when(last <= 0, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(ANCHOR_WORDS)), F.array(last))))
    return words.select("alias", "company_id", "mention", "_w", F.size(offsets).alias("_pieces"),
                        F.explode(offsets).alias("_offset")).withColumn(
        "_gram", F.array_join(F.slice("_w", F.col("_offset") + 1, ANCHOR_WORDS), " ")).drop("_w")


def _place(gram: str, blocks: int) -> tuple[Column, Column, Column]:
    """Block, word and bits of a gram in a filter of ``blocks`` blocks."""
    h = F.xxhash64(gram)
    one = F.lit(1).cast("bigint")
    bits = F.call_function("shiftleft", one, F.shiftright(h, 40).bitwiseAND(63).cast("int")).bitwiseOR(
        F.call_function("shiftleft", one, F.shiftright(h, 46).bitwiseAND(63).cast("int")))
    return F.pmod(h, F.lit(blocks)), F.shiftright(h, 52).bitwiseAND(BLOCK_WORDS - 1).cast("int"), bits


def gram_filter(grams: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """A Bloom filter of ``rows`` grams as a table (_block, _bits), about 16 bits a gram, and its number of blocks."""
    blocks = max(1, min(FILTER_BITS, 16 * rows) // (64 * BLOCK_WORDS))
    block, word, bits = _place("_gram", blocks)
    marked = grams.select(block.alias("_block"), word.alias("_word"), bits.alias("_b"))
    clear = grams.sparkSession.range(blocks * BLOCK_WORDS).select(
        F.floor(F.col("id") / BLOCK_WORDS).alias("_block"), (F.col("id") % BLOCK_WORDS).cast("int").alias("_word"), F.lit(0).cast("bigint").alias("_b"))
    words = marked.unionByName(clear).groupBy("_block", "_word").agg(F.bit_or("_b").alias("_b"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("_word", "_b"))), lambda x: x["_b"])
    return words.groupBy("_block").agg(packed.alias("_bits")), blocks


def meet_pieces(grams: DataFrame, pieces: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join the grams of texts to alias pieces on ``_gram``.

    Pieces are broadcast when they are counted to be few.  Else a broadcast Bloom filter of them drops nearly all grams that
    are in no alias where the text is read, and only the others are sorted and merged.
    """
    if is_small(pieces, rows):
        return grams.join(F.broadcast(pieces), "_gram")
    found, blocks = gram_filter(pieces.select("_gram"), pieces.count())
    block, word, bits = _place("_gram", blocks)
    held = F.get("_bits", word).bitwiseAND(bits) == bits
    passed = grams.join(F.broadcast(found), (block == F.col("_block")) & held).select(*grams.columns)
    return passed.hint("merge").join(pieces, "_gram")


def phrase_matches(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """(key, alias, company_id, mention) once per place where an alias stands as whole words.

    One pass over the text: its grams meet the aliases' grams in an equi join,
    and an alias matches where all its pieces line up.  The dictionary is
    broadcast only when it is counted to be small, else a filter of it; the text side never is.
    """
    words = texts.select(F.col(key), F.split(T.entity_text(text), " ").alias("_words"))
    pieces = _alias_pieces(aliases)
    # Most words of a text begin no piece of a small dictionary: one look-up a word instead of one for each of its runs.
    heads = pieces.select(F.substring_index("_gram", " ", 1).alias("_head")).distinct() if is_small(pieces) else None
    found = meet_pieces(_grams(words, key, heads), pieces)
    lined_up = found.groupBy(key, "alias", "company_id", "mention", (F.col("_pos") - F.col("_offset")).alias("_start")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_pieces").alias("_pieces"))
    return lined_up.filter(F.col("_n") == F.col("_pieces")).select(key, "alias", "company_id", "mention")


def tag_entities(texts: DataFrame, key: str, text: str, aliases: DataFrame,
                 limit: int | None = None) -> DataFrame:
    """(key, company_tag_ids, mentioned): companies by longest alias first.

    All companies of a text, or the first ``limit``; a mention is kept only for
    a kept company.
    """
    order = F.struct((-F.length("alias")).alias("l"), F.col("alias").alias("a"), F.col("company_id").alias("c"))
    hits = phrase_matches(texts, key, text, aliases).withColumn("_at", order)
    # A company's matched spellings are few: at most its aliases.
    per_company = hits.groupBy(key, "company_id").agg(
        F.min("_at").alias("_at"), F.collect_set(F.struct("_at", "mention")).alias("_said"))
    kept = per_company if limit is None else top_n(per_company, [key], [F.col("_at").asc()], limit)
    both = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "company_id"))).alias("_c"),
                                 F.sort_array(F.flatten(F.collect_list("_said"))).alias("_m"))
    return both.select(
        key, F.transform("_c", lambda x: x["company_id"]).alias("company_tag_ids"),
        F.array_distinct(F.transform("_m", lambda x: x["mention"])).alias("mentioned"))


def with_tags(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """All rows of ``texts`` with their (possibly empty) tag arrays."""
    return with_found_tags(texts, key, tag_entities(texts, key, text, aliases))


def with_found_tags(rows: DataFrame, key: str, tags: DataFrame) -> DataFrame:
    """All rows with the tags that were found for their key, else empty arrays."""
    return rows.join(tags, key, "left").withColumns({
        "company_tag_ids": F.coalesce("company_tag_ids", F.array().cast("array<bigint>")),
        "mentioned": F.coalesce("mentioned", F.array().cast("array<string>")),
    })


def seed_first(seed, tags) -> Column:
    """Put the feed's own company in front, once."""
    seeds = F.array_compact(F.array(col(seed)))
    return F.array_distinct(F.concat(seeds, col(tags)))


def tag_names(df: DataFrame, key: str, tags: str, companies: DataFrame, out: str = "company_names") -> DataFrame:
    """Names for a tag array in tag order; unknown ids are dropped."""
    pairs = df.select(key, F.posexplode(tags).alias("_pos", "company_id"))
    named = pairs.join(companies.select("company_id", "name"), "company_id").groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "name"))), lambda x: x["name"]).alias(out))
    return df.join(named, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def best_tag_score(df: DataFrame, key: str, tags: str, scores: DataFrame, score: str = "pct",
                   out: str = "market") -> DataFrame:
    """Highest score over a row's tags, else 0."""
    best = df.select(key, F.explode(tags).alias("company_id")).join(scores, "company_id").groupBy(key).agg(
        F.max(score).alias(out))
    return df.join(best, key, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def flag_watched(df: DataFrame, members: DataFrame, key: str, tags: str = "company_tag_ids",
                 name: str = "watched") -> DataFrame:
    """Does any tag belong to a watchlist?"""
    hit = df.select(key, F.explode(F.array_distinct(tags)).alias("company_id")).join(
        members.select("company_id").distinct(), "company_id", "left_semi").select(key).distinct().withColumn(
        "_hit", F.lit(True))
    return df.join(hit, key, "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def member_universe(lists: DataFrame, array_col: str) -> DataFrame:
    """Distinct ids over many id arrays."""
    return lists.select(F.explode(array_col).alias("company_id")).distinct()
