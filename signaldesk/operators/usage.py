"""Usage roll-ups, budgets and token cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signaldesk import constants as K
from signaldesk.functions.dates import at, local_date
from signaldesk.functions.scores import rounded

MEASURES = ("calls", "prompt_tokens", "completion_tokens", "reasoning_tokens", "cached_input_tokens", "micro_usd")


def _rate(model: Column, prices, place: int, mode: str) -> Column:
    """One column of the price list for a model name: a CASE, so pricing needs no join and also runs in a stream.

    A family matches a model of the same name or ``name-...``.  Several can
    match: the longest wins (``first``: the first in list order).
    """
    ordered = sorted(prices, key=lambda p: -len(p[0])) if mode == "longest" else prices
    out = F.when(F.lit(False), F.lit(0.0))
    for row in ordered:
        out = out.when((model == row[0]) | model.startswith(row[0] + "-"), F.lit(row[place]))
    return out


def priced(calls: DataFrame, prices=K.PRICES_PER_MILLION, mode: str = "longest") -> DataFrame:
    """Add ``cost_usd`` (six places, 0 for unknown models) and ``micro_usd``.

    ``prices``: a short list of (family, input, cached input, output) per million tokens.
    """
    model = F.trim("model")
    fresh = F.greatest(F.col("prompt_tokens") - F.col("cached_input_tokens"), F.lit(0))
    cost = (fresh * _rate(model, prices, 1, mode) / 1e6 + F.col("cached_input_tokens") * _rate(model, prices, 2, mode) / 1e6
            + F.col("completion_tokens") * _rate(model, prices, 3, mode) / 1e6)
    return calls.withColumn("cost_usd", F.coalesce(rounded(cost, 6), F.lit(0.0))).withColumn(
        "micro_usd", F.round(F.col("cost_usd") * 1e6).cast("bigint"))


def _not_empty() -> Column:
    test = F.lit(False)
    for m in MEASURES:
        test = test | (F.col(m) != 0)
    return test


def daily_usage(calls: DataFrame) -> DataFrame:
    """Totals per local day and kind.  Money is summed in whole micro-dollars, so order never matters."""
    rows = calls.filter(_not_empty()).withColumn("usage_date", local_date("used_at"))
    return rows.groupBy("usage_date", "kind").agg(*[F.sum(m).alias(m) for m in MEASURES])


def model_breakdown(calls: DataFrame) -> DataFrame:
    """Totals per local day, kind and model, then a map model -> totals per (day, kind)."""
    rows = calls.filter(_not_empty()).withColumn("usage_date", local_date("used_at"))
    per_model = rows.groupBy("usage_date", "kind", "model").agg(*[F.sum(m).alias(m) for m in MEASURES])
    entry = F.struct("model", F.struct(*MEASURES).alias("totals"))
    return per_model.groupBy("usage_date", "kind").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("models"))


def usd(micro) -> Column:
    return rounded((F.col(micro) if isinstance(micro, str) else micro) / 1e6, 4)


def _today(as_of) -> Column:
    return local_date(at(as_of))


def spend_by_model(breakdown: DataFrame, as_of, days: int) -> DataFrame:
    """Spend per model over the last ``days`` local days, today included."""
    recent = breakdown.filter(F.col("usage_date") >= F.date_sub(_today(as_of), max(days - 1, 0)))
    flat = recent.select(F.explode("models").alias("model", "t")).select("model", "t.*")
    return flat.groupBy("model").agg(*[F.sum(m).alias(m) for m in MEASURES])


def limits_table(spark: SparkSession) -> DataFrame:
    rows = [(k, K.DAILY_LIMITS[k], round(K.DAILY_BUDGET_USD * K.BUDGET_SHARES[k] * 1e6)) for k in K.BUDGET_KINDS]
    return spark.createDataFrame(rows, "kind string, day_limit bigint, limit_micro bigint")


def budget_snapshot(daily: DataFrame, limits: DataFrame, as_of) -> DataFrame:
    today = daily.filter(F.col("usage_date") == _today(as_of)).select("kind", F.col("calls"), "micro_usd")
    both = limits.join(today, "kind", "left").withColumns({
        "used": F.coalesce("calls", F.lit(0)), "used_micro": F.coalesce("micro_usd", F.lit(0))})
    return both.select(
        "kind", "used", F.col("day_limit"), F.greatest(F.col("day_limit") - F.col("used"), F.lit(0)).alias("remaining"),
        usd("used_micro").alias("used_usd"), usd("limit_micro").alias("limit_usd"),
        usd(F.greatest(F.col("limit_micro") - F.col("used_micro"), F.lit(0))).alias("remaining_usd"))


def budget_overview(daily: DataFrame, limits: DataFrame, as_of) -> DataFrame:
    """Today's totals and the seven-day average (always divided by seven)."""
    today = _today(as_of)
    used = daily.filter((F.col("usage_date") == today) & F.col("kind").isin(*K.BUDGET_KINDS)).agg(
        F.coalesce(F.sum("micro_usd"), F.lit(0))).scalar()
    week = daily.filter(F.col("usage_date") >= F.date_sub(today, 6)).agg(F.coalesce(F.sum("micro_usd"), F.lit(0))).scalar()
    total = limits.agg(F.sum("limit_micro").alias("limit_micro"))
    return total.select(
        usd(used).alias("total_used_usd"), usd("limit_micro").alias("total_limit_usd"),
        usd(F.greatest(F.col("limit_micro") - used, F.lit(0))).alias("total_remaining_usd"),
        usd(week / 7.0).alias("seven_day_average_usd"))


def usage_stats(daily: DataFrame, as_of, days: int) -> DataFrame:
    """Daily rows and one totals row (null date and kind) since ``days`` before today.

    The span is one day wider than in ``spend_by_model``.
    """
    recent = daily.filter(F.col("usage_date") >= F.date_sub(at(as_of).cast("date"), days))
    sums = [F.sum(m).alias(m) for m in MEASURES]
    out = recent.groupingSets([["usage_date", "kind"], []], "usage_date", "kind").agg(*sums)
    return out.select(
        "usage_date", "kind", "calls", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        usd("micro_usd").alias("cost_usd"),
        F.when(F.col("kind").isNull(), usd(F.col("micro_usd") / max(days, 1))).alias("rolling_average_usd"))
