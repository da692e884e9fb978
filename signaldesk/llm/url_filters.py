"""URL verdicts from host rules and from pattern rules found through their rarest literal token.

Host rules name a host (with its subdomains) and a path prefix; the longest that fits decides.  For other urls the
method decides: every pattern rule lists literal tokens it cannot match without, is filed under the one that the fewest
urls hold, and its regular expression runs only on urls that hold that token.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no host rule; pattern rules
still read what there is, and a null or empty url is allowed; repeated rows are judged alike; an empty table gives an empty table; other columns play no
part.  Token counts that reach the driver are those of rule tokens only, so the rule list bounds them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signaldesk.llm.common import ascii_lower, table


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``tokens``: runs of a-z and 0-9 that every url matching ``pattern`` (on the url in lower case) holds, whole.

    So the pattern must name what stands on both sides of a token, or a longer run could match that is filed elsewhere.
    """

    verdict: str
    tokens: tuple[str, ...]
    pattern: str

    def __post_init__(self):
        for token in self.tokens:
            if not re.search(rf"[^a-z0-9]{token}[^a-z0-9?*+{{]", self.pattern):
                raise ValueError(f"{self.pattern} does not bound its token {token} on both sides")


#: The host rules of the contract.
HOST_RULES = (HostRule("allow", "com", "/"), HostRule("block", "example.com", "/en/"), HostRule("allow", "www.example.com", "/en/"),
              HostRule("block", "net", "/es/"), HostRule("block", "net", "/fr/"))
#: Pattern rules for urls that no host rule fits; a url that none blocks is allowed.
PATTERN_RULES = (
    PatternRule("block", ("casino",), r"[/.-]casino[.-]"), PatternRule("block", ("free", "bets"), r"[/.-]free-bets[.-]"),
    PatternRule("block", ("cheap", "pills"), r"[/.-]cheap-pills[.-]"), PatternRule("block", ("ads", "track"), r"[/.-]ads-track[.-]"),
    PatternRule("block", ("adult",), r"[/.-]adult[/.-]"), PatternRule("block", ("login",), r"/login([/?#.]|$)"),
    PatternRule("block", ("cgi", "bin"), r"/cgi-bin/"), PatternRule("block", ("sessionid",), r"[?&;]sessionid=[0-9a-f]+"),
    PatternRule("block", ("utm", "source", "popunder"), r"[?&]utm_source=popunder([^a-z0-9]|$)"), PatternRule("block", ("wp", "admin"), r"/wp-admin/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(raw) + 1, F.char_length(rest)), "^[^?#]*", 0)
    return ascii_lower(raw), path


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.lower(url), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, rules: Iterable[PatternRule]) -> dict[str, list[PatternRule]]:
    """Rules filed under their rarest token over all urls."""
    rules = list(rules)
    wanted = sorted({t for r in rules for t in r.tokens})
    held = urls.select(F.explode(F.array_intersect(url_tokens(F.col("url")), F.array(*map(F.lit, wanted)))).alias("token"))
    counts = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}  # one row a rule token
    index: dict[str, list[PatternRule]] = defaultdict(list)
    for rule in rules:
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(rule)
    return dict(index)


def _judge(index: dict[str, list[PatternRule]], hosts: tuple[HostRule, ...]):
    by_host: dict[str, list[HostRule]] = defaultdict(list)
    for rule in hosts:
        by_host[rule.host].append(rule)
    compiled = {t: [(r.verdict, re.compile(r.pattern)) for r in rules] for t, rules in index.items()}
    token = re.compile("[a-z0-9]+")

    def one(url: str | None, host: str, path: str) -> tuple[str | None, str]:
        best, rest = None, host
        while rest:
            for rule in by_host.get(rest, ()):
                if path.startswith(rule.path) and (best is None or len(rule.text) > len(best.text)):
                    best = rule
            rest = rest.partition(".")[2]
        if best:
            return best.text, best.verdict
        low = (url or "").lower()
        for t in set(token.findall(low)) & compiled.keys():
            if any(verdict == "block" and pattern.search(low) for verdict, pattern in compiled[t]):
                return None, "block"
        return None, "allow"

    def batches(parts):
        for pdf in parts:
            got = [one(*x) for x in zip(pdf["url"], pdf["host"], pdf["path"])]
            yield pdf.assign(rule=pd.Series([x[0] for x in got], dtype=object, index=pdf.index), verdict=[x[1] for x in got])

    return batches


def judge_urls(pages: DataFrame, hosts: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every page."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    kind = dict(urls.dtypes)["page_id"]
    return urls.mapInPandas(_judge(rarest_tokens(pages, patterns), tuple(hosts)), f"page_id {kind}, url string, host string, path string, rule string, verdict string")


def url_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_BLOCKS = " OR ".join(f"regexp_matches(low, '{r.pattern}')" for r in PATTERN_RULES if r.verdict == "block")
_FITS = " UNION ALL ".join(f"SELECT '{r.verdict}' AS v, '{r.host}' AS h, '{r.path}' AS p" for r in HOST_RULES)
URL_SQL = f"""
WITH parts AS (
  SELECT row_number() OVER () AS i, page_id, lower(coalesce(url, '')) AS low,
         CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
split AS (SELECT i, page_id, low, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
rules AS ({_FITS}),
best AS (SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM split JOIN rules
         ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {_BLOCKS} THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN best USING (i)"""
