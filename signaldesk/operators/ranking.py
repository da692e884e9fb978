"""Windows, ranks, sorts and pages.

``row_number() <= n`` plans with a partial WindowGroupLimit before the
shuffle: each map task keeps at most ``n`` rows of a group, so a hot group
(untagged stories, one giant issuer) never travels whole to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from signaldesk import constants as K
from signaldesk.functions.dates import col
from signaldesk.functions.scores import cents


def top_n(df: DataFrame, keys: list, order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def importance_order(ts: str, key: str, score: str = "composite_score") -> list[Column]:
    return [F.col(score).desc(), F.col(ts).desc(), F.col(key).desc()]


def freshness_order(ts: str, key: str, score: str = "composite_score") -> list[Column]:
    return [F.col(ts).desc(), F.col(score).desc(), F.col(key).desc()]


def personal_order(ts: str, key: str, relevance: str = "relevance") -> list[Column]:
    return [F.col(relevance).desc(), F.col(ts).desc(), F.col(key).desc()]


def form_rank(form) -> Column:
    out = F.when(col(form) == K.FORM_LIST_ORDER[0], 0)
    for i, name in enumerate(K.FORM_LIST_ORDER[1:], 1):
        out = out.when(col(form) == name, i)
    return out.otherwise(99)


def company_list_order(key: str = "filing_id") -> list[Column]:
    return [form_rank("normalized_form_type").asc(), F.col("filed_at").desc(), F.col("composite_score").desc(),
            F.col(key).desc()]


def representatives(news: DataFrame, group: str = "dedupe_group_id") -> DataFrame:
    """One story per duplicate group: official first, then score, time and id.

    Filter before calling: the choice is made among the rows given.
    """
    story = F.coalesce(F.col(group), F.concat(F.lit("news:"), F.col("news_id").cast("string")))
    order = [F.col("is_official").desc(), F.col("composite_score").desc(), F.col("published_at").desc(),
             F.col("news_id").desc()]
    return top_n(news.withColumn("story", story), ["story"], order, 1)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a global order (planned as a top-k of offset + limit)."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page whose rows carry the total; the total is a separate scalar aggregate, not a global window."""
    return page(df, order, limit, offset).withColumn("total", df.agg(F.count(F.lit(1))).scalar())


def ranked_ids(df: DataFrame, key: str, order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """Ids of the best rows with their position: the window sees only ``limit`` rows."""
    best = page(df.select("*"), order, limit)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)) - 1).select(key, rank)


def refetch(wide: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Fetch wide rows for ranked ids, keeping the rank; ids with no row are dropped."""
    return wide.join(F.broadcast(ids), key)


ID_BLOCK = 1_000_000  # ids per tie block


def global_index(df: DataFrame, value: str, key: str, index: str = "idx", total: str = "n") -> DataFrame:
    """Zero-based position by (value, key) over all rows, and the row count.

    No whole-table window: rows are numbered inside blocks of equal value and
    id range; block sizes are then summed inside value bands of similar
    magnitude, and the few bands are summed at the end.  Values are positive.
    """
    band = F.floor(F.log(F.col(value).cast("double")) * 64)
    blocked = df.withColumn("_block", F.floor(F.col(key) / ID_BLOCK))
    blocks = blocked.groupBy(value, "_block").agg(F.count(F.lit(1)).alias("_size")).withColumn("_band", band)
    in_band = Window.partitionBy("_band").orderBy(value, "_block")
    blocks = blocks.withColumn("_in_band", F.sum("_size").over(in_band) - F.col("_size"))
    bands = blocks.groupBy("_band").agg(F.sum("_size").alias("_band_size"))
    # At most a few thousand bands exist whatever the row count (64 per e-fold).
    across = Window.orderBy("_band")
    bands = bands.select(
        "_band", (F.sum("_band_size").over(across) - F.col("_band_size")).alias("_before"),
        F.sum("_band_size").over(Window.partitionBy()).alias(total))
    starts = blocks.join(F.broadcast(bands), "_band").select(
        value, "_block", (F.col("_before") + F.col("_in_band")).alias("_start"), total)
    numbered = blocked.withColumn(
        "_pos", F.row_number().over(Window.partitionBy(value, "_block").orderBy(key)) - 1)
    return numbered.join(starts, [value, "_block"]).withColumn(index, F.col("_start") + F.col("_pos")).drop(
        "_start", "_pos", "_block")


def market_percentiles(companies: DataFrame) -> DataFrame:
    """(company_id, pct): rank of market value among active companies with one, 0..100."""
    valued = companies.filter(F.col("is_active") & (F.col("market_cap") != 0)).select("company_id", "market_cap")
    return global_index(valued, "market_cap", "company_id").select(
        "company_id",
        F.when(F.col("n") == 1, 100.0).otherwise(F.col("idx") / (F.col("n") - 1) * 100.0).alias("pct"))


def company_trend(filings: DataFrame, last: int = 4) -> DataFrame:
    """Direction of score and flags over each company's last complete filings.

    The mean is taken over the consecutive changes themselves, summed from the oldest: (last - first) / (n - 1) differs from
    it in the last bits, and so at the bounds.
    """
    recent = top_n(filings.filter(F.col("status") == "complete"), ["company_id"],
                   [F.col("filed_at").desc(), F.col("filing_id").desc()], last)
    # At most ``last`` filings of a company, oldest first.
    ends = recent.groupBy("company_id").agg(F.count(F.lit(1)).alias("filings_analyzed"), F.array_sort(F.collect_list(
        F.struct("filed_at", "filing_id", "composite_score", "risk_n", "opp_n"))).alias("_list"))

    def step(c: str) -> Column:
        values = F.transform("_list", lambda r: r[c].cast("double"))
        changes = F.filter(F.zip_with(F.slice(values, 2, last), F.slice(values, 1, last), lambda now, before: now - before), lambda x: x.isNotNull())
        return F.aggregate(changes, F.lit(0.0), lambda total, x: total + x) / F.nullif(F.size(changes), F.lit(0))

    def course(c: str) -> Column:
        return F.when(step(c) > 0.5, "increasing").when(step(c) < -0.5, "decreasing").otherwise("stable")

    return ends.select(
        "company_id", "filings_analyzed",
        F.when(F.col("filings_analyzed") < 2, "insufficient_data").when(step("composite_score") > 5, "improving")
        .when(step("composite_score") < -5, "deteriorating").otherwise("stable").alias("direction"),
        F.coalesce(cents(step("composite_score")), F.lit(0.0)).alias("trend_score"),
        course("risk_n").alias("risk_trend"), course("opp_n").alias("opportunity_trend"))


def latest_per_company(df: DataFrame, ts: str, key: str) -> DataFrame:
    return top_n(df, ["company_id"], [F.col(ts).desc(), F.col("composite_score").desc(), F.col(key).desc()], 1)


def form_runs(filings: DataFrame) -> DataFrame:
    """Runs of neighbouring equal form types in each company's list, over its whole history.

    The list is cut into pieces (form priority, day), so one company's history is spread over many tasks.  A piece is
    summed up by its runs: their rows, its first and its last form.  Where a piece starts with the form that the piece
    before ends with, the two runs are one; run numbers and places are running sums over the (few) pieces.
    """
    form, piece = F.col("normalized_form_type"), ["company_id", "_rank", "_day"]
    rows = filings.withColumns({"_rank": form_rank("normalized_form_type"), "_day": F.col("filed_at").cast("date")})
    inside = Window.partitionBy(*piece).orderBy(*company_list_order())
    starts = F.when(F.row_number().over(inside) == 1, 0).otherwise(F.coalesce((form != F.lag(form).over(inside)).cast("int"), F.lit(1)))
    rows = rows.withColumns({"_start": starts, "_at": F.row_number().over(inside)}).withColumn("_run", F.sum("_start").over(inside))
    runs = rows.groupBy(*piece, "_run", form).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_at"))
    pieces = runs.groupBy(*piece).agg(
        F.sum("n").alias("_rows"), F.max("_run").alias("_inner"), F.min_by(form, "_run").alias("_first"), F.max_by(form, "_run").alias("_last"))
    across = Window.partitionBy("company_id").orderBy(F.col("_rank").asc(), F.col("_day").desc())
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col("_first") != F.lag("_last").over(across)).cast("int"), F.lit(1))
    pieces = pieces.withColumn("_opens", opens).select(
        *piece, (F.coalesce(F.sum(F.col("_opens") + F.col("_inner")).over(before), F.lit(0)) + F.col("_opens")).alias("_run0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_at0"))
    return runs.join(pieces, piece).groupBy("company_id", (F.col("_run0") + F.col("_run")).alias("run"), form).agg(
        F.sum("n").alias("n"), F.min(F.col("_at0") + F.col("_at")).cast("int").alias("first_pos"))


def page_local_personal(df: DataFrame, page_order: list[Column], order: list[Column], limit: int,
                        offset: int = 0) -> DataFrame:
    """Choose a page by one order, then reorder only that page."""
    return page(df, page_order, limit, offset).orderBy(*order)
