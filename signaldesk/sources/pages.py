"""Links, article text and times from a table of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from signaldesk import constants as K
from signaldesk.functions import text as T
from signaldesk.functions.dates import col, parse_month_day_year, parse_published
from signaldesk.operators.ranking import top_n
from signaldesk.sources.payloads import ANCHOR

NOT_LINKS = r"^(mailto:|javascript:|#)|^$"


def link_entries(pages: DataFrame, key: str, url: str, html: str, path_patterns: tuple[str, ...] = (),
                 min_title: int = 15, per_page: int | None = None) -> DataFrame:
    """Usable links of each page (all, or the first ``per_page``): (key, pos, title, link, date_text).

    The date is the nearest one after the link, inside its surrounding list
    item or block when the page marks one.
    """
    clean = F.regexp_replace(col(html), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    base = pages.select(F.col(key), F.col(url).alias("_base"), clean.alias("_html"))
    # Each piece runs from one link to the next, so it also holds the text beside its link.
    pieces = base.select(key, "_base", F.posexplode(F.split("_html", r"(?i)(?=<a\s)")).alias("_pos", "_piece")).filter(
        F.col("_piece").rlike(ANCHOR))
    beside = T.inline_text(F.regexp_replace(
        F.regexp_replace(F.col("_piece"), r"(?is)^.*?</a>", " "), r"(?is)</(?:li|tr|div|article|section|p|ul)>.*$", " "))
    links = pieces.select(
        key, "_base", "_pos", F.regexp_extract("_piece", ANCHOR, 1).alias("_href"),
        T.inline_text(F.regexp_extract("_piece", ANCHOR, 2)).alias("title"), T.date_text(beside).alias("date_text"))
    usable = links.filter(~F.col("_href").rlike(NOT_LINKS)).withColumn(
        "link", T.canonical_url(T.resolve_url("_base", "_href")))
    if path_patterns:
        test = F.lit(False)
        for p in path_patterns:
            test = test | F.lower("link").contains(p.lower())
        usable = usable.filter(test)
    usable = usable.filter(F.length("title") >= min_title)
    first = top_n(usable, [key, "link"], [F.col("_pos").asc()], 1)
    placed = first.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("_pos")))
    return (placed if per_page is None else placed.filter(F.col("pos") <= per_page)).select(key, "pos", "title", "link", "date_text")


def host_of(url) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def article_text(url, html) -> Column:
    """Text of the site's own block, else of ``<article>``, else of all paragraphs."""
    page = F.regexp_replace(col(html), r"(?s)<!--.*?-->", " ")
    article = F.nullif(F.regexp_extract(page, r"(?is)<article\b[^>]*>(.*?)</article>", 1), F.lit(""))
    blocks = F.lit(None).cast("string")
    for site, css in K.ARTICLE_SITES.items():
        block = F.nullif(F.regexp_extract(
            article, rf'(?is)<(?:div|section)\b[^>]*class\s*=\s*["\'][^"\']*\b{css}\b[^"\']*["\'][^>]*>(.*)</(?:div|section)>', 1),
            F.lit(""))
        blocks = F.coalesce(blocks, F.when(host_of(url).contains(site), block))
    paragraphs = F.regexp_extract_all(page, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    loose = F.array_join(F.transform(paragraphs, lambda p: T.squeeze(T.unescape(T.strip_markup(p)))), " ")
    return F.coalesce(*[T.squeeze(T.unescape(T.strip_markup(b))) for b in (blocks, article)], loose)


# fixed values: page metadata that carries a publication time, in order of trust
TIME_METAS = (("property", "article:published_time"), ("name", "article:published_time"), ("name", "pubdate"),
              ("name", "publish-date"), ("name", "date"), ("itemprop", "datePublished"))


def _meta(html, attribute: str, value: str) -> Column:
    tag = F.regexp_extract(col(html), rf'(?is)(<meta\b[^>]*\b{attribute}\s*=\s*["\']{value}["\'][^>]*>)', 1)
    return F.nullif(F.regexp_extract(tag, r'(?is)\bcontent\s*=\s*["\']([^"\']+)["\']', 1), F.lit(""))


def published_time(html) -> Column:
    """Metadata tags, then ``<time datetime>``, then the first date in the text."""
    marked = F.regexp_extract(col(html), r'(?is)<time\b[^>]*\bdatetime\s*=\s*["\']([^"\']+)["\']', 1)
    stated = F.array(*[_meta(html, a, v) for a, v in TIME_METAS], marked)
    # One parser over the candidates, in order; the first that parses wins.
    parsed = F.filter(F.transform(stated, lambda t: parse_published(t)), lambda t: t.isNotNull())
    shown = T.squeeze(T.unescape(T.strip_markup(html)))
    return F.coalesce(F.get(parsed, F.lit(0)), parse_month_day_year(T.date_text(shown)))
