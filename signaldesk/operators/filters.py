"""Row filters as DataFrame transformations.  All keep pushdown-friendly predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from signaldesk import constants as K
from signaldesk.functions import classify as C
from signaldesk.functions.dates import at, col, days_before
from signaldesk.operators.ranking import top_n


def covered_companies(issuers: DataFrame, allow: DataFrame | None = None, deny: DataFrame | None = None,
                      only_tickers: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Issuers in the covered industries, with manual include and exclude lists.

    ``allow`` and ``deny`` have one column ``code`` (a padded cik or a ticker).
    Deny wins over allow, allow wins over the industry test.  ``limit`` keeps the first covered ones by cik.
    """
    rows = issuers.withColumn("ticker", F.nullif(F.upper(F.trim(F.col("ticker"))), F.lit("")))
    if only_tickers:
        rows = rows.filter(F.col("ticker").isin(*[t.upper() for t in only_tickers]))
    def flag(df: DataFrame, codes: DataFrame | None, name: str) -> DataFrame:
        if codes is None:
            return df.withColumn(name, F.lit(False))
        one = codes.select(F.upper("code").alias("code")).distinct()
        by_cik = one.select(F.col("code").alias("cik"), F.lit(True).alias(f"{name}_c"))
        by_ticker = one.select(F.col("code").alias("ticker"), F.lit(True).alias(f"{name}_t"))
        return (
            df.join(by_cik, "cik", "left").join(by_ticker, "ticker", "left")
            .withColumn(name, F.coalesce(f"{name}_c", f"{name}_t", F.lit(False))).drop(f"{name}_c", f"{name}_t")
        )

    rows = flag(flag(rows, allow, "allowed"), deny, "denied")
    covered = (
        rows.filter(~F.col("denied") & (F.col("allowed") | F.col("sic").isin(*K.COVERED_SIC)))
        .withColumn("universe_reason", F.when(F.col("allowed"), "manual-allowlist").otherwise("sic-allowlist"))
        .drop("allowed", "denied")
    )
    return covered if limit is None else covered.orderBy("cik").limit(limit)


def recent(df: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    return df.filter(F.col(ts) >= days_before(as_of, days))


def in_window(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Half-open [start, end)."""
    return df.filter((F.col(ts) >= at(start)) & (F.col(ts) < at(end)))


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Case-insensitive contains on any column; ``%`` and ``_`` stay wildcards."""
    tests = [F.col(c).ilike(f"%{text}%") for c in columns]
    return df.filter(reduce(lambda a, b: a | b, tests))


def facets(df: DataFrame, **equals) -> DataFrame:
    """Equality filters; a value of None means no filter."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def overlapping(df: DataFrame, tags: str, members: DataFrame, key: str, member: str = "company_id") -> DataFrame:
    """Rows whose tag array meets a membership table (explode and semi join, no wide literal)."""
    hits = df.select(key, F.explode(F.array_distinct(tags)).alias(member)).join(
        members.select(member).distinct(), member, "left_semi").select(key).distinct()
    return df.join(hits, key, "left_semi")


def flag_members(df: DataFrame, members: DataFrame, key: str = "company_id", name: str = "watched") -> DataFrame:
    """Add a boolean: is ``key`` in the membership table?"""
    marks = members.select(F.col("company_id").alias(key)).distinct().withColumn("_hit", F.lit(True))
    return df.join(marks, key, "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def pending_queue(df: DataFrame, ts: str, as_of, backlog_days: int, origin_col: str | None = None,
                  origin: str = K.POLL_ORIGIN) -> DataFrame:
    rows = df.filter(C.in_queue("status", "attempts", ts, as_of, backlog_days))
    return rows if origin_col is None else rows.filter(F.col(origin_col) == origin)


def backfill_cut(df: DataFrame, key: str, filed: str, as_of=None, years_back: int | None = None, since=None,
                 per_key: int | None = None) -> DataFrame:
    """Rows since a date, or within N years of ``as_of``; newest first, at most ``per_key`` per key."""
    if since is not None:
        df = df.filter(F.col(filed).cast("date") >= F.lit(since).cast("date"))
    elif years_back:
        df = df.filter(F.col(filed).cast("date") >= F.add_months(at(as_of).cast("date"), -12 * years_back))
    if per_key is None:
        return df
    return top_n(df, [key], [F.col(filed).desc(), F.col("filing_id").desc()], per_key)


def calendar_range(df: DataFrame, as_of, past_days: int | None, ahead_days: int | None) -> DataFrame:
    if past_days is not None:
        df = df.filter(F.col("starts_at") >= days_before(as_of, past_days))
    if ahead_days is not None:
        df = df.filter(F.col("starts_at") <= at(as_of) + F.make_dt_interval(F.lit(ahead_days)))
    return df


def focus_scope(df: DataFrame, old_tags: str, new_tags: str, focus_ids) -> DataFrame:
    """Keep rows whose old or new tags meet the (short, caller-given) focus list."""
    wanted = F.array(*[F.lit(int(i)) for i in focus_ids]).cast("array<bigint>")
    return df.filter(F.arrays_overlap(col(old_tags), wanted) | F.arrays_overlap(col(new_tags), wanted))
