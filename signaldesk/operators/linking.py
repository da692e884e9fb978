"""Links between records: prior comparable filing, related news, wide detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from signaldesk import constants as K
from signaldesk.functions import text as T
from signaldesk.operators.ranking import top_n

PRIOR_FORMS = ("10-K", "20-F", "40-F", "10-Q", "6-K", "8-K")


def running_max_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, day: str) -> DataFrame:
    """Largest ``value`` over the rows before this one in each key's order.

    A key's history is cut into days, so that a company holding a large share
    of all rows is spread over many tasks: a running maximum inside each day,
    then a running maximum over the (few) day totals, joined back on the
    partitioning the first window already made.
    """
    part = [*keys, "_day"]
    cut = df.withColumn("_day", F.col(day).cast("date"))
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    days = cut.groupBy(*part).agg(F.max(value).alias("_top"))
    across = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_earlier", F.max("_top").over(across)).drop("_top")
    out_df = cut.withColumn("_inside", F.max(value).over(inside)).join(days, part, "left")
    return out_df.withColumn(out, F.greatest("_inside", "_earlier")).drop("_inside", "_earlier", "_day")


def prior_strict(filings: DataFrame) -> DataFrame:
    """Prior comparable filing: strictly earlier, latest first, then highest id.

    Distinct instants are reduced first, so ties never link and never cost.
    """
    grouped = filings.withColumn("grp", T.comparable_group("normalized_form_type"))
    usable = F.when(F.col("normalized_form_type").isin(*PRIOR_FORMS), F.struct("filed_at", "filing_id"))
    instants = grouped.groupBy("company_id", "grp", "filed_at").agg(F.max(usable).alias("_best"))
    linked = running_max_before(instants, ["company_id", "grp"], ["filed_at"], "_best", "_prior", "filed_at")
    links = linked.select("company_id", "grp", "filed_at", F.col("_prior.filing_id").alias("prior_id"),
                          F.col("_prior.filed_at").alias("prior_filed_at"))
    return grouped.join(links, ["company_id", "grp", "filed_at"], "left")


def prior_sequential(filings: DataFrame, *carried: str) -> DataFrame:
    """Previous row by (filed_at, id) in the group; equal instants do link.  ``carried`` columns of it come as ``prior_<name>``."""
    grouped = filings.withColumn("grp", T.comparable_group("normalized_form_type")).withColumn(
        "_at", F.struct("filed_at", "filing_id", *carried))
    linked = running_max_before(grouped, ["company_id", "grp"], ["filed_at", "filing_id"], "_at", "_prior", "filed_at")
    return linked.withColumns({
        "prior_id": F.col("_prior.filing_id"), **{f"prior_{c}": F.col(f"_prior.{c}") for c in carried}}).drop("_at", "_prior")


def related_news(links: DataFrame, news: DataFrame, per_filing: int = 5) -> DataFrame:
    """Best linked stories of each filing by confidence."""
    best = top_n(links, ["filing_id"], [F.col("confidence").desc(), F.col("news_id").desc()], per_filing, rank="pos")
    return best.join(news, "news_id")


def filing_detail(filings: DataFrame, companies: DataFrame, links: DataFrame, news: DataFrame) -> DataFrame:
    """Filing with company, prior filing and up to five related stories."""
    stories = related_news(links, news.select("news_id", "title")).groupBy("filing_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("title").alias("story")))),
                    lambda x: x["story"]).alias("related"))
    prior = prior_strict(filings).select("filing_id", "prior_id")
    return (
        filings.join(companies.select("company_id", "name", "ticker"), "company_id")
        .join(prior, "filing_id", "left").join(stories, "filing_id", "left")
        .withColumn("related", F.coalesce("related", F.array().cast("array<string>")))
    )
