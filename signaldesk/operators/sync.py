"""Idempotent loading: anti joins, change detection, snapshots with prune."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from signaldesk.operators.ranking import top_n
from signaldesk.runtime import staged


def new_by_key(incoming: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    return incoming.join(stored.select(*keys), list(keys), "left_anti")


def new_by_either(incoming: DataFrame, stored: DataFrame, keys: tuple[str, ...], ordinal: str) -> DataFrame:
    """Rows to store when they come in the order of ``ordinal`` and each needs all of its keys to be free.

    A key is taken by stored rows and by earlier rows that were stored themselves; a row that was turned away takes
    nothing.  In each round the rows without an open earlier rival are accepted and their rivals turned away, until no
    row is open.  A null key is no key; rows of one ordinal come in any one order.  Every join is an equi join.
    """
    rows = incoming
    for key in keys:
        rows = new_by_key(rows, stored, key)
    if len(keys) == 1:
        nulls = rows.where(F.col(keys[0]).isNull())
        return top_n(rows.where(F.col(keys[0]).isNotNull()), [keys[0]], [F.col(ordinal).asc()], 1).unionByName(nulls)
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "either-rows")
    open_, accepted = rows.select(*keys, F.struct(ordinal, "_row").alias("_at")), []
    while True:
        first = open_
        for key in keys:
            least = open_.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_at").alias(f"_{key}"))
            first = first.join(least, key, "left")
        won = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_{key}") == F.col("_at"), F.col(key).isNull()) for key in keys])
        accepted.append(staged(first.where(won).select(*keys, "_at"), "either-won"))
        rest = open_.join(accepted[-1].select("_at"), "_at", "left_anti")
        for key in keys:
            rest = new_by_key(rest, accepted[-1], key)
        open_ = staged(rest, "either-open")
        if open_.isEmpty():
            break
    taken = reduce(DataFrame.unionByName, accepted).select("_at._row")
    return rows.join(taken, "_row", "left_semi").drop("_row")


def _any_differs(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a | b, [~old.eqNullSafe(new) for old, new in pairs])


def last_of_key(rows: DataFrame, keys: list[str], compared: list[str], ordinal: str | None) -> DataFrame:
    order = [F.col(ordinal).desc()] if ordinal else []
    return top_n(rows, keys, order + [F.col(c).desc_nulls_last() for c in compared], 1)


def upsert_actions(incoming: DataFrame, stored: DataFrame, keys: list[str], compared: list[str],
                   keep_old_when_null: tuple[str, ...] = (), ordinal: str | None = None) -> DataFrame:
    """Full outcome of an upsert: every key once, new values, and an action.

    action is insert, update, unchanged, or keep (stored only).  Of rows that
    repeat a key the last by ``ordinal`` counts, else the greatest.
    """
    incoming = last_of_key(incoming, keys, compared, ordinal)
    old = stored.select(*keys, *[F.col(c).alias(f"old_{c}") for c in compared], F.lit(True).alias("_old"))
    new = incoming.select(*keys, *compared, F.lit(True).alias("_new"))
    both = new.join(old, keys, "full_outer")
    for c in keep_old_when_null:
        both = both.withColumn(c, F.coalesce(c, f"old_{c}"))
    changed = _any_differs([(F.col(f"old_{c}"), F.col(c)) for c in compared])
    action = (
        F.when(F.col("_new").isNull(), "keep").when(F.col("_old").isNull(), "insert")
        .when(changed, "update").otherwise("unchanged")
    )
    values = [F.when(F.col("_new").isNull(), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in compared]
    return both.withColumn("action", action).select(*keys, *values, "action")


def snapshot_actions(incoming: DataFrame, stored: DataFrame, scope: str, key: str, compared: list[str],
                     succeeded: DataFrame, metadata: str | None = None, ordinal: str | None = None) -> DataFrame:
    """Per-scope snapshot: insert, update, delete what is gone; failed scopes stay as they are.

    ``succeeded`` lists scopes whose fetch worked, even with no rows.  Repeated keys count once, as in an upsert.
    """
    incoming = last_of_key(incoming, [scope, key], compared, ordinal)
    cols = compared + ([metadata] if metadata else [])
    ok = succeeded.select(scope).distinct().withColumn("_ok", F.lit(True))
    old = stored.select(scope, key, *[F.col(c).alias(f"old_{c}") for c in cols], F.lit(True).alias("_old"))
    new = incoming.join(ok.select(scope), scope, "left_semi").select(scope, key, *cols, F.lit(True).alias("_new"))
    both = new.join(old, [scope, key], "full_outer").join(ok, scope, "left")
    if metadata:
        both = both.withColumn(metadata, merge_maps(F.col(f"old_{metadata}"), F.col(metadata)))
    pairs = [(F.col(f"old_{c}"), F.col(c)) for c in compared]
    if metadata:
        pairs.append((sorted_entries(F.col(f"old_{metadata}")), sorted_entries(F.col(metadata))))
    action = (
        F.when(F.col("_ok").isNull(), "keep")
        .when(F.col("_new").isNull(), "delete")
        .when(F.col("_old").isNull(), "insert")
        .when(_any_differs(pairs), "update")
        .otherwise("unchanged")
    )
    values = [F.when(F.col("_new").isNull(), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    return both.withColumn("action", action).select(scope, key, *values, "action")


def merge_maps(old: Column, new: Column) -> Column:
    """Right side wins; a null side counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, a, b: F.coalesce(b, a))


def sorted_entries(m: Column) -> Column:
    """A map as a comparable array."""
    return F.array_sort(F.map_entries(m))


def action_counts(actions: DataFrame, *by: str) -> DataFrame:
    return actions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scanned"),
        *[F.count_if(F.col("action") == a).alias(f"{a}_n") for a in ("insert", "update", "delete", "unchanged")])


def one_per_symbol(quotes: DataFrame, *values: str) -> DataFrame:
    """One quote for each upper-case symbol: the last by ``ordinal`` where there is one, else the greatest value."""
    last = F.struct(*values)
    last = F.max_by(last, "ordinal") if "ordinal" in quotes.columns else F.max(last)
    return quotes.groupBy(F.upper("symbol").alias("symbol")).agg(last.alias("_q")).select("symbol", "_q.*")


def market_cap_refresh(companies: DataFrame, quotes: DataFrame) -> DataFrame:
    """Overwrite matched values; unmatched companies keep value and source."""
    q = one_per_symbol(quotes, "market_cap", "source").select(
        F.col("symbol").alias("_t"), F.col("market_cap").alias("_cap"), F.col("source").alias("_src"))
    old_source = F.col("market_cap_source") if "market_cap_source" in companies.columns else F.lit(None).cast("string")
    return (
        companies.withColumn("_t", F.upper("ticker")).join(q, "_t", "left")
        .withColumn("refreshed", F.col("_cap").isNotNull())
        .withColumn("market_cap_source", F.when(F.col("_cap").isNotNull(), F.col("_src")).otherwise(old_source))
        .withColumn("market_cap", F.coalesce("_cap", "market_cap")).drop("_t", "_cap", "_src")
    )


def refresh_counts(refreshed: DataFrame) -> DataFrame:
    with_ticker = refreshed.filter(F.nullif(F.col("ticker"), F.lit("")).isNotNull())
    return with_ticker.agg(
        F.count(F.lit(1)).alias("companies"), F.count_if("refreshed").alias("refreshed"),
        F.count_if(~F.col("refreshed")).alias("failed"))


def quote_fallback(tickers: DataFrame, batch: DataFrame, single: DataFrame) -> DataFrame:
    """Batch quote, else the single quote, with its source label; unmatched tickers are dropped."""
    b = one_per_symbol(batch, "market_cap").select("symbol", F.struct("market_cap", F.lit("batch").alias("source")).alias("_b"))
    s = one_per_symbol(single, "market_cap").select("symbol", F.struct("market_cap", F.lit("single").alias("source")).alias("_s"))
    return tickers.select(F.upper("ticker").alias("symbol")).join(b, "symbol", "left").join(s, "symbol", "left").withColumn(
        "_q", F.coalesce("_b", "_s")).filter(F.col("_q").isNotNull()).select("symbol", "_q.market_cap", "_q.source")
