"""Page and filing text jobs."""

from pyspark.sql import functions as F

from signaldesk.catalog import query, sqltext as S
from signaldesk.catalog.q_functions import _BASIC, tsfmt
from signaldesk.sources import pages as P, views as V


def _dated_pages(spark, sf):
    """Pages with a time stated in one of the known places, or nowhere."""
    k = F.col("page_id") % 4
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int"))
    extra = (
        F.when(k == 0, F.concat(F.lit('<meta name="pubdate" content="'), day.cast("string"), F.lit('T10:30:00Z">')))
        .when(k == 1, F.concat(F.lit('<time class="t" datetime="'), day.cast("string"), F.lit('">')))
        .when(k == 2, F.concat(F.lit("<div>Posted "), F.date_format(day, "MMMM d, yyyy"), F.lit(" by staff</div>")))
        .otherwise(""))
    return V.pages(spark, sf).select("page_id", "url", F.regexp_replace("html", "<body>", F.concat(F.lit("<body>"), extra)).alias("html"))


@query("str_21_published_time", """
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN strftime(DATE '2024-01-01' + CAST(page_id % 300 AS INT), '%Y-%m-%d') || ' 10:30:00'
      WHEN 3 THEN NULL ELSE strftime(DATE '2024-01-01' + CAST(page_id % 300 AS INT), '%Y-%m-%d') || ' 00:00:00' END AS published FROM pages""")
def _(spark, sf):
    return _dated_pages(spark, sf).select("page_id", tsfmt(P.published_time("html")).alias("published"))


_BARE = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
_BLOCK = f"regexp_extract({_BARE}, '(?is)<article\\b[^>]*>(.*?)</article>', 1)"
_TAGLESS = f"regexp_replace(regexp_replace({_BLOCK}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query("str_22_article_text", f"""
    SELECT page_id, trim(regexp_replace({_BASIC.format(_TAGLESS)}, '\\s+', ' ', 'g')) AS body FROM pages""")
def _(spark, sf):
    return V.pages(spark, sf).select("page_id", P.article_text("url", "html").alias("body"))
