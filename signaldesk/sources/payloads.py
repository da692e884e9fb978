"""Decoding of raw JSON payloads into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as Y

from signaldesk.functions import text as T
from signaldesk.functions.dates import col, parse_calendar, parse_lenient_date
from signaldesk.operators.ranking import top_n


# ---- issuer submissions ------------------------------------------------------
def rows_from_columns(df: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Parallel arrays to rows; the first array sets the row count."""
    zipped = F.slice(F.arrays_zip(*arrays), 1, F.size(arrays[0]))
    return df.select(key, F.inline(zipped))


def rows_from_matrix(df: DataFrame, key: str, fields: str, data: str, wanted: list[str]) -> DataFrame:
    """A header array and an array of row arrays to named columns."""
    rows = df.select(key, F.col(fields).alias("_f"), F.explode(data).alias("_r"))
    named = rows.withColumn("_m", F.map_from_entries(F.arrays_zip("_f", "_r")))
    return named.select(key, *[F.col("_m")[w].alias(w) for w in wanted])


def rows_from_keyed(df: DataFrame, key: str, json_map: str, schema: str) -> DataFrame:
    """Fallback shape: an object whose values are the rows."""
    decoded = F.from_json(json_map, f"map<string,struct<{schema}>>")
    return df.select(key, F.explode(F.map_values(decoded)).alias("_v")).select(key, "_v.*")


def full_history(recent: DataFrame, older: DataFrame, name: str = "name") -> DataFrame:
    """Recent rows and older paged blocks; blocks without a name are skipped."""
    named = older.filter(F.nullif(F.col(name), F.lit("")).isNotNull()).drop(name)
    return recent.unionByName(named, allowMissingColumns=True)


# ---- market quotes -------------------------------------------------------------
CAP_KEYS = ("marketCap", "market_cap", "marketCapitalization", "market_capitalization")
_QUOTE = Y.StructType([Y.StructField(k, Y.StringType()) for k in ("symbol", "ticker", *CAP_KEYS)])
_WRAPPED = Y.StructType([Y.StructField("data", Y.StringType())])


def quote_rows(df: DataFrame, payload: str) -> DataFrame:
    """Quotes from a list, ``{"data": [...]}`` or a single object: (symbol, market_cap).

    Missing, empty, zero or non-numeric values drop the row.
    """
    raw = F.trim(payload)
    inner = F.from_json(raw, _WRAPPED)["data"]
    body = F.when(raw.startswith("["), raw).when(inner.startswith("["), inner).otherwise(
        F.concat(F.lit("["), raw, F.lit("]")))
    rows = df.select(F.explode(F.from_json(body, Y.ArrayType(_QUOTE))).alias("q"))

    def usable(field: str) -> Column:
        text = F.trim(F.col(f"q.{field}"))
        return F.when(~text.isin("", "0", "false"), text)

    cap = F.coalesce(*[usable(k) for k in CAP_KEYS]).try_cast("double").try_cast("bigint")
    symbol = F.coalesce(*[F.nullif(F.trim(F.col(f"q.{k}")), F.lit("")) for k in ("symbol", "ticker")])
    return rows.select(F.upper(symbol).alias("symbol"), cap.alias("market_cap")).filter(
        F.col("symbol").isNotNull() & F.col("market_cap").isNotNull())


# ---- trial registry ---------------------------------------------------------------
STUDY_SCHEMA = """protocolSection struct<
  identificationModule: struct<nctId: string, briefTitle: string>,
  statusModule: struct<overallStatus: string, startDateStruct: struct<date: string>,
    primaryCompletionDateStruct: struct<date: string>, lastUpdatePostDateStruct: struct<date: string>>,
  designModule: struct<phases: array<string>, studyType: string, enrollmentInfo: struct<count: int>>,
  sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string>>,
  conditionsModule: struct<conditions: array<string>>,
  armsInterventionsModule: struct<interventions: array<struct<name: string>>>>"""


def study_rows_from_json(df: DataFrame, key: str, payload: str) -> DataFrame:
    p = df.select(key, F.from_json(payload, STUDY_SCHEMA)["protocolSection"].alias("p"))
    names = F.filter(F.transform(F.col("p.armsInterventionsModule.interventions"), lambda i: i["name"]),
                     lambda n: F.nullif(n, F.lit("")).isNotNull())
    empty = F.array().cast("array<string>")
    return p.select(
        key,
        F.coalesce("p.identificationModule.nctId", F.lit("")).alias("nct_id"),
        F.coalesce(F.nullif(F.col("p.identificationModule.briefTitle"), F.lit("")), F.lit("Untitled")).alias("title"),
        F.get("p.designModule.phases", F.lit(0)).alias("phase"),
        F.coalesce("p.statusModule.overallStatus", F.lit("Unknown")).alias("status"),
        F.coalesce("p.conditionsModule.conditions", empty).alias("conditions"),
        F.coalesce(names, empty).alias("interventions"),
        F.col("p.sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"),
        parse_lenient_date("p.statusModule.startDateStruct.date").alias("start_date"),
        parse_lenient_date("p.statusModule.primaryCompletionDateStruct.date").alias("primary_completion_date"),
        parse_lenient_date("p.statusModule.lastUpdatePostDateStruct.date").alias("last_update_date"),
        F.col("p.designModule.enrollmentInfo.count").alias("enrollment"),
        F.col("p.designModule.studyType").alias("study_type"),
    )


# ---- regulator calendar ---------------------------------------------------------------
ANCHOR = r'(?is)<a\s[^>]*?href\s*=\s*["\']([^"\']*)["\'][^>]*>(.*?)</a>'


def calendar_rows(df: DataFrame, base_url: str, ordinal: str, limit: int | None = None) -> DataFrame:
    """Calendar cells to events.

    The title must hold a link; a repeated address keeps its first row; a row
    whose start cannot be read is skipped.  Newest start first when limited.
    """
    href = F.regexp_extract("title", ANCHOR, 1)
    inner = T.inline_text(F.regexp_extract("title", ANCHOR, 2))
    rows = df.filter(F.col("title").rlike(ANCHOR)).select(
        F.col(ordinal),
        F.coalesce(F.nullif(inner, F.lit("")), T.inline_text("title")).alias("clean_title"),
        T.resolve_url(F.lit(base_url), href).alias("canonical_url"),
        parse_calendar("field_start_date").alias("starts_at"),
        parse_calendar("field_end_date").alias("ends_at"),
        T.inline_text("field_center").alias("center"),
        T.inline_text("field_contributing_office").alias("office"),
    ).filter(F.col("starts_at").isNotNull())
    first = top_n(rows, ["canonical_url"], [F.col(ordinal).asc()], 1)
    out = first.select(
        ordinal, F.col("clean_title").alias("title"), "canonical_url", "starts_at", "ends_at",
        T.committee_name("clean_title").alias("committee_name"),
        F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("clean_title", "center", "office")]).alias("context_text"),
        "center")
    if limit is None:
        return out
    return out.orderBy(F.col("starts_at").desc(), F.col(ordinal).asc()).limit(limit)


# ---- field pulls ---------------------------------------------------------------------------
def importance_of(summary_json) -> Column:
    return F.coalesce(F.get_json_object(col(summary_json), "$.importance_score").try_cast("double"), F.lit(0.0))


def flags_of(summary_json, name: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(col(summary_json), f"$.{name}"), "array<string>"),
                      F.array().cast("array<string>"))


def origin_of(metadata_json) -> Column:
    return F.get_json_object(col(metadata_json), "$.ingest_origin")
