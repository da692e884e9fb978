"""Feed registry: which addresses to read, and with what tags and weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signaldesk import constants as K
from signaldesk.operators.ranking import top_n

SOURCE = "struct<kind:string,url:string>"


def static_feeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, n, u, w, list(t)) for i, (n, u, w, t) in enumerate(K.STATIC_FEEDS)],
        "ordinal bigint, name string, feed_url string, source_weight double, topic_tags array<string>")


def builtin_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.BUILTIN_IR_SOURCES), "ticker string, kind string, url string")


def _one(kind: str, url: Column) -> Column:
    present = F.nullif(url, F.lit("")).isNotNull()
    return F.when(present, F.array(F.struct(F.lit(kind).alias("kind"), url.alias("url")))).otherwise(
        F.array().cast(f"array<{SOURCE}>"))


def company_sources(companies: DataFrame, builtins: DataFrame) -> DataFrame:
    """One row per source of a company, in order.

    ``ir_sources`` (array of kind and url), when it holds any address, is the
    whole answer; else the feed, the page and the built-in entry of the ticker.
    """
    known = builtins.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("kind", "url"))).alias("_known")).withColumnRenamed("ticker", "_t")
    c = companies.join(known, F.upper("ticker") == F.col("_t"), "left")
    own = F.filter(F.coalesce("ir_sources", F.array().cast(f"array<{SOURCE}>")),
                   lambda s: F.nullif(s["url"], F.lit("")).isNotNull())
    own = F.transform(own, lambda s: F.struct(F.coalesce(s["kind"], F.lit("rss")).alias("kind"), s["url"].alias("url")))
    parts = F.concat(_one("rss", F.col("ir_feed_url")), _one("html_page", F.col("ir_news_page_url")),
                     F.coalesce("_known", F.array().cast(f"array<{SOURCE}>")))
    return c.select("company_id", "name", "sic", F.posexplode(
        F.when(F.size(own) > 0, own).otherwise(parts)).alias("pos", "s")).select(
        "company_id", "name", "sic", "pos", "s.kind", "s.url")


def registry(spark: SparkSession, companies: DataFrame, sources: DataFrame, members: DataFrame, top: int = 50) -> DataFrame:
    """Static feeds, then sources of the largest and of the watched companies; first address wins.

    ``top`` is the feature: only that many of the largest companies are polled.
    """
    active = companies.filter("is_active").select("company_id", "market_cap")
    largest = active.orderBy(F.coalesce("market_cap", F.lit(0)).desc(), F.col("company_id").asc()).limit(top).select("company_id")
    watched = active.join(members.select("company_id").distinct(), "company_id", "left_semi").select("company_id")
    chosen = sources.join(largest.unionByName(watched).distinct(), "company_id", "left_semi")
    tags = F.array_compact(F.array(F.lit("company-pr"), F.when(F.col("sic") == "2834", "pharma").when(
        F.col("sic") == "2836", "biotech")))
    company = chosen.select(
        (F.lit(len(K.STATIC_FEEDS)) + F.col("company_id")).alias("ordinal"), F.col("pos").alias("sub"),
        F.concat("name", F.lit(" Investor Relations")).alias("name"), F.col("url").alias("feed_url"), "kind",
        F.lit(K.OFFICIAL_FEED_WEIGHT).alias("source_weight"), tags.alias("topic_tags"),
        F.lit(True).alias("is_official"), F.col("company_id").alias("seed_company_id"))
    static = static_feeds(spark).withColumns({
        "sub": F.lit(0), "kind": F.lit("rss"), "is_official": F.lit(False), "seed_company_id": F.lit(None).cast("bigint")})
    return top_n(static.unionByName(company), ["feed_url"], [F.col("ordinal").asc(), F.col("sub").asc()], 1)
