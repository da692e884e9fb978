"""Matching trial sponsors to companies, and the relational trial scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from signaldesk import constants as K
from signaldesk.functions import text as T
from signaldesk.functions.dates import at
from signaldesk.operators.ranking import top_n
from signaldesk.runtime import is_small, staged

ANCHOR_CHARS = 8
SHORTEST = 3
# Parts of names and spellings of aliases are many times the tables they are cut from, which is all that Spark's estimate
# sees; so the joins on them name their way and are never turned into a broadcast through the driver.
BROADCAST_PAIRS = 50_000


def sponsor_aliases(companies: DataFrame) -> DataFrame:
    """Trial-specific aliases, then the name, then general aliases; one row per compact form.

    General aliases are dropped when short and single-word, or equal to the ticker.
    """
    def listed(c: str, source: int) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")),
                           lambda a: F.struct(F.lit(source).alias("source"), F.trim(a).alias("original")))

    name = F.array(F.struct(F.lit(1).alias("source"), F.trim("name").alias("original")))
    rows = companies.select("company_id", "ticker", F.posexplode(
        F.concat(listed("trial_aliases", 0), name, listed("aliases", 2))).alias("alias_pos", "a")).select(
        "company_id", "ticker", "alias_pos", "a.source", "a.original")
    shaped = rows.withColumns({"norm": T.sponsor_text("original"), "compact": T.compact_name("original"),
                               "core": T.core_compact_name("original")})
    weak = (F.col("source") == 2) & (
        ((F.length("compact") < 6) & ~F.contains("norm", F.lit(" ")))
        | F.coalesce(F.upper("original") == F.upper("ticker"), F.lit(False)))
    usable = shaped.filter((F.col("compact") != "") & ~weak)
    first = top_n(usable, ["company_id", "compact"], [F.col("alias_pos").asc()], 1)
    loose = F.when(F.contains("norm", F.lit(" ")) | (F.length("norm") >= 10), F.col("norm"))
    return first.select("company_id", "alias_pos", "original", F.lower("original").alias("raw_lower"), "norm", "compact",
                        "core", loose.alias("loose"))


def _char_grams(text: str, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.when(F.length(text) >= size, F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(size)))).otherwise(
        F.array().cast("array<string>"))


def _grams_up_to(text: str) -> Column:
    return F.array_distinct(F.flatten(F.array(*[_char_grams(text, size) for size in range(SHORTEST, ANCHOR_CHARS + 1)])))


def rarest_part(aliases: DataFrame, parts: Column, held: DataFrame) -> DataFrame:
    """aliases with ``_k``: of each alias's parts the one that the fewest names hold.

    A name that has all parts has the rarest one, so one equi join on it finds every match, and a part that most names
    share is used only where an alias has no other.  ``held``: a row (_k) for each part that a name holds.  Aliases with a
    part that no name holds are left out.
    """
    cols = aliases.columns
    split = aliases.select(*cols, F.explode(F.array_distinct(parts)).alias("_k"))
    known = held.groupBy("_k").agg(F.count("*").alias("_n"))
    best = split.join(known.hint("merge"), "_k", "left").groupBy(*cols).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_k")).alias("_part"))
    return best.where("_part.n > 0").select(*cols, F.col("_part._k").alias("_k"))


def phrase_candidates(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, company_id, loose): names that hold the rarest characters in a row of an alias phrase."""
    phrases = aliases.filter(F.length("loose") >= SHORTEST).select("company_id", "loose").distinct()
    # A phrase is cut into grams as long as itself, up to ANCHOR_CHARS; two-word phrases have at least 3 characters.
    own = F.when(F.length("loose") <= ANCHOR_CHARS, F.array("loose")).otherwise(_char_grams("loose", ANCHOR_CHARS))
    held = names.select("name", F.explode(_grams_up_to("_low")).alias("_k"))
    return held.join(rarest_part(phrases, own, held.select("_k")).hint("merge"), "_k").drop("_k")


def name_matches(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, company_id) pairs that pass the existence test.

    Equal trimmed text, equal compact text, or an alias phrase inside the name; every join is an equi join.
    """
    n = names.select("name").distinct().withColumn("_low", F.lower("name"))
    by_text = n.withColumn("raw_lower", F.trim("_low")).join(
        aliases.select("raw_lower", "company_id").hint("merge"), "raw_lower").select("name", "company_id")
    by_compact = n.withColumn("compact", F.regexp_replace("_low", "[^a-z0-9]+", "")).join(
        aliases.select("compact", "company_id").hint("merge"), "compact").select("name", "company_id")
    inside = phrase_candidates(n, aliases).filter(F.contains(F.lower("name"), F.col("loose"))).select("name", "company_id")
    return by_text.unionByName(by_compact).unionByName(inside).distinct()


def match_score(name_norm: Column, name_raw: Column, name_compact: Column, name_core: Column) -> Column:
    """320 same text, 300 same compact, 240 same core, 180 alias words lead, 150 all words present."""
    tokens, alias_tokens = F.split(name_norm, " "), F.split("norm", " ")
    return (
        F.when(name_raw == F.col("raw_lower"), 320)
        .when((name_compact != "") & (name_compact == F.col("compact")), 300)
        .when((name_core != "") & (name_core == F.col("core")), 240)
        .when((F.col("norm") != "") & F.startswith(F.concat(name_norm, F.lit(" ")), F.concat("norm", F.lit(" "))), 180)
        .when((F.size(alias_tokens) >= 2) & (F.size(F.array_except(alias_tokens, tokens)) == 0), 150)
        .otherwise(0)
    )


def lead_sponsor(sponsors: DataFrame) -> DataFrame:
    """(nct_id, lead_sponsor): the first lead by id, else the first sponsor by id.

    Rows are dealt by study before the grouping: names are sorted once, and not before an exchange as well.
    """
    is_lead = F.lower(F.coalesce("lead_or_collaborator", F.lit(""))) == "lead"
    rows = sponsors.select("nct_id", "id", "name", is_lead.alias("_lead")).repartition("nct_id")
    return rows.groupBy("nct_id").agg(F.coalesce(
        F.min_by("name", F.when(F.col("_lead"), F.col("id"))), F.min_by("name", "id")).alias("lead_sponsor"))


def sorted_names(rows: DataFrame, out: str) -> DataFrame:
    """(nct_id, out): distinct names in order.  Duplicates go before the arrays are built."""
    one = rows.filter(F.col("name").isNotNull()).select("nct_id", "name").distinct()
    return one.groupBy("nct_id").agg(F.sort_array(F.collect_list("name")).alias(out))


def current_studies(studies: DataFrame, as_of, recent_days: int = 365) -> DataFrame:
    cutoff = F.date_sub(at(as_of).cast("date"), recent_days)
    return studies.filter(
        F.lower(F.coalesce("overall_status", F.lit(""))).isin(*K.CURRENT_STATUSES)
        | (F.col("last_update_posted_date") >= cutoff) | (F.col("primary_completion_date") >= cutoff))


def study_rows(studies: DataFrame, sponsors: DataFrame, conditions: DataFrame, interventions: DataFrame) -> DataFrame:
    """Studies with lead sponsor and the three ordered name arrays."""
    out = studies.join(lead_sponsor(sponsors).hint("shuffle_hash"), "nct_id", "left")
    for rows, name in ((sponsors, "sponsor_names"), (conditions, "conditions"), (interventions, "interventions")):
        out = out.join(sorted_names(rows, name).hint("shuffle_hash"), "nct_id", "left").withColumn(
            name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def company_studies(studies: DataFrame, sponsors: DataFrame, aliases: DataFrame) -> DataFrame:
    """(company_id, nct_id): studies with a matching sponsor."""
    pairs = name_matches(sponsors, aliases)
    return (sponsors.select("nct_id", "name").distinct().join(pairs, "name").select("company_id", "nct_id").distinct()
            .join(studies.select("nct_id"), "nct_id", "left_semi"))


def name_scores(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Best alias of each (name, company) with a positive score.

    Scores depend on names only, so they are made once per distinct name.
    Every way to score is reached by an equi join: equal text, compact or core
    form; an alias that is a leading part of the name; or an alias whose
    rarest word is one of the name's words (the rest is then checked).
    """
    n = names.select("name").distinct().withColumns({
        "n_raw": F.lower(F.trim("name")), "n_norm": T.sponsor_text("name"), "n_compact": T.compact_name("name"),
        "n_core": T.core_compact_name("name")}).withColumn("_words", F.split("n_norm", " "))
    a = aliases.select("company_id", "alias_pos", "original", "raw_lower", "norm", "compact", "core")
    by_word = n.withColumn("_k", F.explode(F.array_distinct("_words")))
    heads = F.transform("_words", lambda w, i: F.array_join(F.slice("_words", 1, i + 1), " "))
    keyed = [
        (n.withColumn("_k", F.col("n_raw")), a.withColumn("_k", F.col("raw_lower"))),
        (n.withColumn("_k", F.col("n_compact")), a.withColumn("_k", F.col("compact"))),
        (n.withColumn("_k", F.col("n_core")), a.withColumn("_k", F.col("core"))),
        (n.withColumn("_k", F.explode(heads)), a.withColumn("_k", F.col("norm"))),
        (by_word, rarest_part(a.filter(F.contains("norm", F.lit(" "))), F.split("norm", " "), by_word.select("_k"))),
    ]
    score = match_score(F.col("n_norm"), F.col("n_raw"), F.col("n_compact"), F.col("n_core"))
    found = None
    for left, right in keyed:
        part = left.join(right.hint("merge"), "_k").select("name", "company_id", "alias_pos", "original", score.alias("score"))
        found = part if found is None else found.unionByName(part)
    return top_n(found.filter("score > 0"), ["name", "company_id"], [F.col("score").desc(), F.col("alias_pos").asc()], 1)


def best_matches(studies: DataFrame, sponsors: DataFrame, aliases: DataFrame) -> DataFrame:
    """The winning (sponsor, alias) of each (company, study); pairs without a score drop out.

    Ties go to the first sponsor in name order, then to the first alias.  A (name, company) pair is matched and scored once
    and takes its place among the company's pairs, so a study's rows meet the pairs in one join and only places are compared.
    """
    rows = staged(sponsors.select("nct_id", "name"), "study-names")
    aliases = staged(aliases, "aliases")
    names = staged(rows.select("name").distinct(), "names")
    matched = name_matches(names, aliases).withColumn("_wanted", F.lit(True))
    both = name_scores(names, aliases).join(matched, ["name", "company_id"], "full")
    place = F.row_number().over(W.partitionBy("company_id").orderBy(F.col("score").desc_nulls_last(), "name"))
    pairs = staged(both.withColumn("_place", place), "pairs")
    few = is_small(pairs, BROADCAST_PAIRS)
    known = pairs.select("name", "company_id", F.coalesce("_wanted", F.lit(False)).alias("_wanted"), F.when(F.col("score").isNotNull(), F.col("_place")).alias("_place"))
    met = rows.join(F.broadcast(known) if few else known.hint("shuffle_hash"), "name").select("nct_id", "company_id", "_wanted", "_place")
    best = met.repartition("nct_id").groupBy("nct_id", "company_id").agg(F.max("_wanted").alias("_wanted"), F.min("_place").alias("_place"))
    kept = best.where(F.col("_wanted") & F.col("_place").isNotNull()).join(studies.select("nct_id").hint("shuffle_hash"), "nct_id", "left_semi")
    shown = pairs.select("company_id", "_place", F.col("name").alias("matched_sponsor"), F.col("original").alias("matched_alias"), "score")
    return kept.join(F.broadcast(shown) if few else shown.hint("shuffle_hash"), ["company_id", "_place"]).select(
        "company_id", "nct_id", "matched_sponsor", "matched_alias", "score")
