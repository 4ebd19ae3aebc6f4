"""URL filter by redirect equivalence: aliases share the block decision of any of them, unless one is allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import ascii_lower, small, stored
from paperloom.llm.components import components

#: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Link and meta elements; comments and scripts are matched too, so that nothing inside them counts.
_ELEMENT = r"(?is)(<!--.*?-->|<script\b.*?</script\s*>|<(?:link|meta)\b[^>]*>)"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, node) of a url. The node tells resources apart: host, path and query, without scheme and fragment.

    All three are empty where the url is null or has no "://".
    """
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.concat(host, F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


def _target(x: Column) -> Column:
    """What a link or meta element names as canonical or redirects to; else null."""
    attribute = lambda name: F.coalesce(*(F.nullif(F.regexp_extract(x, rf"(?is)\s{name}\s*=\s*{how}", 1), F.lit("")) for how in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")))
    canonical = x.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(attribute("rel")), r"\s+"), "canonical")
    at_once = x.rlike("(?i)^<meta") & (F.lower(F.trim(attribute("http-equiv"))) == "refresh")
    refresh = F.nullif(F.regexp_extract(attribute("content"), r"(?i)url\s*=\s*['\"]?([^'\"]+)", 1), F.lit(""))
    return F.replace(F.trim(F.when(canonical, attribute("href")).when(at_once, refresh)), F.lit("&amp;"), F.lit("&"))


def links(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of pages and of the pages they name as canonical or redirect to at once.

    Taken from link rel=canonical and meta http-equiv=refresh of the html; a null html has none.
    """
    _, _, node = url_parts(F.col("url"))
    found = F.filter(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_ELEMENT), F.lit(1)), lambda x: x.rlike(r"(?i)^<(link|meta)\b") & x.rlike(r"(?i)canonical|refresh"))
    each = pages.filter(F.col("html").rlike("(?i)canonical|refresh")).select("url", node.alias("a"), F.explode(F.transform(found, _target)).alias("to"))
    each = each.filter("to is not null and a <> ''")
    root = F.regexp_extract("url", r"^[^/?#]*//[^/?#]*", 0)
    folder = F.regexp_extract("url", r"^([^/?#]*//[^/?#]*(?:[^?#]*/)?)", 1)
    full = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to"))
        .when(F.col("to").startswith("/"), F.concat(root, "to"))
        .when(F.col("to").rlike("^[#?]"), F.concat(F.regexp_extract("url", r"^[^?#]*", 0), "to"))
        .otherwise(F.concat(F.when(folder.endswith("/") & (folder != F.concat(F.regexp_extract("url", r"^[^/?#]*//", 0))), folder).otherwise(F.concat(root, F.lit("/"))), "to"))
    )
    each = each.select("a", F.explode(F.array(full)).alias("full"))
    return each.select("a", url_parts(F.col("full"))[2].alias("b")).filter("b <> '' and a <> b").distinct()


def matched(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, rule, verdict) of the nodes that a rule of rules(verdict, host, path) fits: the longest, of equals the allowing one.

    A rule fits its host and all subdomains of it if the path starts with the rule's. Each node is joined by the
    suffixes of its host (few: one for each label).
    """
    host, path = F.regexp_extract("node", r"^[^/?#]*", 0), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = rules.filter("host is not null and path is not null").select(F.col("host").alias("suffix"), F.col("path").alias("start"), F.concat("host", "path").alias("rule"), "verdict").distinct()
    each = nodes.select("node", host.alias("host"), path.alias("path")).select("node", "path", F.explode(suffixes).alias("suffix"))
    fits = each.join(small(rules), "suffix").filter(F.expr("startswith(path, start)"))
    best = fits.groupBy("node").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("allowed"), "rule", "verdict")).alias("best"))
    return best.select("node", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, host, path, rule, verdict, component.

    A url keeps the verdict of its rule. Any other takes that of its equivalents, which canonical links and
    immediate redirects connect over any number of steps, also through urls that are no pages: allow if a rule
    allows one of them, else block if a rule blocks one, else allow. Urls that differ in scheme or fragment only are
    one resource. Null urls and those without "://" have empty host and path, no equivalents and the verdict allow.
    Repeated rows stay; nulls in page_id or html are kept as they are; an empty table gives no rows.
    """
    host, path, node = url_parts(F.col("url"))
    edges = stored(links(pages.select("url", "html")), "links")
    nodes = pages.select(node.alias("node")).union(edges.select("a")).union(edges.select("b")).filter("node <> ''").distinct()
    ruled = stored(matched(nodes, rules), "ruled")
    groups = components(edges)
    members = ruled.join(groups, "node", "left").select(F.coalesce("component", "node").alias("component"), "verdict")
    shared = members.groupBy("component").agg(F.when(F.max(F.col("verdict") == "allow"), "allow").otherwise("block").alias("shared"))
    decided = groups.join(shared, "component", "left").select("node", "component", "shared").join(ruled, "node", "full")
    each = pages.select("page_id", host.alias("host"), path.alias("path"), node.alias("node"))
    return each.join(decided, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "shared", F.lit("allow")).alias("verdict"), F.coalesce("component", "node").alias("component"))
