"""Issuer universe and market values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signaldesk import constants as K
from signaldesk.functions import text as T
from signaldesk.operators import filters as O, sync
from signaldesk.operators.ranking import top_n


def sync_universe(issuers: DataFrame, stored: DataFrame, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
    """Covered issuers against the stored companies: one row per cik with an action.

    ``issuers``: cik, ticker, name, exchange, sic (raw).  Companies that are no
    longer covered stay as they are.
    """
    padded = issuers.withColumn("cik", T.pad_key("cik"))
    covered = top_n(O.covered_companies(padded, allow, deny), ["cik"], [F.col(c).asc() for c in ("ticker", "name", "exchange", "sic")], 1)
    described = F.create_map(*[F.lit(v) for pair in K.COVERED_SIC.items() for v in pair])[F.col("sic")]
    rows = covered.withColumns({
        "name": F.coalesce(F.nullif(F.col("name"), F.lit("")), "cik"),
        "sic_description": F.coalesce("sic_description", described) if "sic_description" in covered.columns else described,
        "is_active": F.lit(True),
    })
    compared = ["name", "ticker", "exchange", "sic", "universe_reason", "is_active"]
    return sync.upsert_actions(rows, stored, ["cik"], compared)


def refreshed_companies(companies: DataFrame, batch: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """Companies with market values from the quotes (single quotes fill what the batch misses)."""
    quotes = batch if single is None else sync.quote_fallback(companies.select("ticker"), batch, single)
    return sync.market_cap_refresh(companies, quotes)
