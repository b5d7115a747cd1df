"""URL filters: pattern rules indexed by their rarest literal token.

A rule's regular expression runs only on URLs that have the rule's index token. Verdicts are made
once for each different URL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hot import join_by_hot

#: Up to this many rules are broadcast; more are joined by shuffle.
BROADCAST_RULES = 100_000
TOKEN = r"[^/._-]+"

# Names of networks that serve advertisements or count visits, words of hosts that sell
# bets, pills or the like, and paths of pages that aren't for readers.
AD_NETWORKS = (
    "2mdn.net adform.net adnxs.com adsrvr.org amazon-adsystem.com casalemedia.com criteo.com doubleclick.net googleadservices.com "
    "googlesyndication.com hotjar.com moatads.com openx.net outbrain.com popads.net pubmatic.com quantserve.com rubiconproject.com "
    "scorecardresearch.com smartadserver.com taboola.com zedo.com"
)
HOST_WORDS = "ads adserver adult bets betting casino escorts payday pills poker porn spam telemetry tracker viagra xxx"
PATHS = "/cgi-bin/ /phpmyadmin/ /wp-admin/ /wp-login.php /xmlrpc.php"


def _escaped(s: str) -> str:
    return "".join(c if c.isalnum() or c in "/-_" else "\\" + c for c in s)


#: (name, pattern over host and path, verdict); a name's parts are literal tokens of all that its pattern matches.
DEFAULT_PATTERNS = (
    *((x, rf"^([^/]*\.)?{_escaped(x)}(/|$)", "block") for x in AD_NETWORKS.split()),
    *((x, rf"^([^/]*[.-])?{x}[.-]", "block") for x in HOST_WORDS.split()),
    *((x, _escaped(x) + ("" if x.endswith("/") else "$"), "block") for x in PATHS.split()),
)


def prefix_rule(host: str, path: str) -> str:
    """The pattern, over host and path, of a rule for a host, its subdomains and a path prefix."""
    return rf"^([^/]*\.)?{_escaped(host)}{_escaped(path)}"


def rule_table(spark: SparkSession, prefixes: list[tuple[str, str, str]], patterns=DEFAULT_PATTERNS) -> DataFrame:
    """Rules from (verdict, host, path) and from (tokens, pattern, verdict); columns rule, tokens, pattern, verdict, base."""
    split = lambda s: re.findall(TOKEN, s)
    rows = [(h + p, split(h + re.match(r"(.*[/._-])?", p)[0]), prefix_rule(h, p), v, True) for v, h, p in prefixes]
    rows += [(t, split(t), pattern, v, False) for t, pattern, v in patterns]
    return spark.createDataFrame(rows, "rule string, tokens array<string>, pattern string, verdict string, base boolean")


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge the ``url`` of every row by the longest base rule that fits it, else by the other rules.

    Adds ``host, path, rule, verdict`` (replacing columns of these names). ``rule`` is the base rule's name, else null;
    without one the verdict is that of the longest other pattern, else ``default``. A null URL or one
    without ``://`` has empty host and path and fits no rule. Of rules as long, the greatest name wins.
    A rule needs at least one whole literal token; one without is refused.
    """
    if rules.filter(F.size("tokens") == 0).limit(1).count():
        raise ValueError("every rule needs a literal token")
    pages = pages.drop("host", "path", "rule", "verdict")
    usable = F.coalesce(F.contains("url", F.lit("://")), F.lit(False))
    urls = pages.filter(usable).groupBy("url").agg(F.count("*").alias("__copies"))
    plain = urls.select("url", "__copies", F.concat(url_host(F.col("url")), url_path(F.col("url"))).alias("plain"))
    probes = plain.select("url", "__copies", "plain", F.explode(F.array_distinct(F.regexp_extract_all("plain", F.lit(TOKEN), F.lit(0)))).alias("token"))

    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    small = F.broadcast if few else (lambda df: df)
    tokens = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = probes.join(small(tokens), "token").groupBy("token").agg(F.sum("__copies").alias("urls"))
    ranked = rules.select("*", F.explode(F.array_distinct("tokens")).alias("token")).join(seen, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), -F.length("token"), "token"))
    index = ranked.groupBy("rule", "pattern", "verdict", "base").agg(rarest.alias("token"))

    fits = probes.join(small(index), "token").filter(F.regexp_like("plain", F.col("pattern")))
    first = F.max_by(F.struct("rule", "verdict", "base"), F.struct("base", F.length("rule"), "rule"))
    best = urls.join(fits.groupBy("url").agg(first.alias("__best")), "url", "left")
    judged = join_by_hot(pages.filter(usable), best, "url", "__copies", pages.count()).select(*pages.columns, "__best")
    out = judged.unionByName(pages.filter(~usable), allowMissingColumns=True)
    return out.select(
        *pages.columns,
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        F.when(F.col("__best.base"), F.col("__best.rule")).alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )
