"""URL filters with redirect equivalence."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm.common import stored, table
from tideloom.llm.components import components


class Rule(NamedTuple):
    """Fits `host` and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
#: Query parameters that do not change what a URL shows.
TRACKING = r"(?i)(?:utm_[a-z]+|ref|fbclid|gclid)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits, else null. The rules are a parameter, so the expression is bounded."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later ones wrap the earlier
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """The resource a URL names: no scheme, default port, fragment, tracking parameters or closing slash."""
    host = F.regexp_replace(host_of(url), r":(?:80|443)$", "")
    query = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^" + TRACKING + "(?:=|$)"))
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def targets_of(html: Column) -> Column:
    """Array of the raw URLs that the page's canonical link and meta refresh name."""
    attribute = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    value = lambda found: F.trim(F.regexp_replace(F.regexp_replace(found, r"(?is)^\w+\s*=\s*", ""), "^[\"']|[\"']$", ""))
    link = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?\s*canonical\b)[^>]*>""", 0)
    meta = F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b)[^>]*>""", 0)
    refresh = F.regexp_extract(value(attribute(meta, "content")), r"""(?is)\burl\s*=\s*["']?([^"']+)""", 1)
    plain = lambda url: F.trim(F.replace(url, F.lit("&amp;"), F.lit("&")))
    return F.filter(F.array(plain(value(attribute(link, "href"))), plain(refresh)), lambda x: x != "")


def absolute(target: Column, url: Column) -> Column:
    """A target resolved against the URL of its page."""
    root = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_extract(path_of(url), "^(?s:.*)/", 0)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("#"), url)
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Verdict of every page's URL: its own rule's, else its aliases'.

    pages: page_id, url, html (others are ignored); redirects: optional from_url, to_url.
    URLs of one resource (see node_of), canonical links, meta refreshes and redirects are
    edges; their connected components are the aliases. A page without a rule of its own is
    allowed if any alias is explicitly allowed, else blocked if any is blocked, else
    allowed. Null URLs and URLs without :// have empty host and path, no aliases and are
    allowed; null html has no links; repeated rows are judged alike; an empty table gives no rows.
    """
    page = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"), targets_of(F.col("html")).alias("targets"))
    page = stored(page.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
    links = page.filter("host <> ''").select("node", F.explode("targets").alias("target"), "url").select("node", absolute(F.col("target"), F.col("url")).alias("to"))
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("from_url")).alias("node"), F.col("to_url").alias("to")))
        extra = redirects.select(F.explode(F.array("from_url", "to_url")).alias("url"))
    links = links.withColumn("to_node", node_of(F.col("to"))).filter("node <> '' AND to_node <> ''")
    roots = components(links.select(F.col("node").alias("u"), F.col("to_node").alias("v")))
    named = page.select("node", "rule").unionByName(links.select(F.col("to_node").alias("node"), rule_of(host_of(F.col("to")), path_of(F.col("to")), rules).alias("rule")))
    if redirects is not None:
        named = named.unionByName(extra.select(node_of(F.col("url")).alias("node"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules).alias("rule")))
    verdict = F.lit(None).cast("string")
    for rule in rules:
        verdict = F.when(F.col("rule") == rule.name, F.lit(rule.verdict)).otherwise(verdict)
    home = F.coalesce("root", "node")
    ruled = named.filter("rule IS NOT NULL AND node <> ''").groupBy("node").agg(F.max(verdict == "allow").alias("allowed"), F.max(verdict == "block").alias("blocked"))
    ruled = ruled.join(roots.hint("merge"), "node", "left").groupBy(home.alias("alias")).agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    out = page.join(roots.hint("merge"), "node", "left").withColumn("alias", home).join(ruled.hint("merge"), "alias", "left")
    passed_on = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, passed_on).alias("verdict"), F.when(F.col("host") != "", F.col("alias")).alias("alias"))


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page."""
    return judge_urls(table(spark, sf_dir, "pages"))
