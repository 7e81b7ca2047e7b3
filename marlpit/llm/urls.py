"""URL filters that follow redirect equivalence.

Explicit rules judge what they fit, the longest rule winning. Canonical links, refresh
redirects and any given redirect table say which addresses stand for one resource;
distributed connected components over those edges bring all aliases together, whether
they were crawled or not. An alias without a rule is blocked with a blocked alias, unless
a rule explicitly allows one of the aliases: an allow goes before a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import LOWER, UPPER, cut
from marlpit.llm.graph import components

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, both null where none fits."""
    name = verdict = None
    for said, at, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name = F.when(fits, at + prefix) if name is None else name.when(fits, at + prefix)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def addressed(rows: DataFrame, url: str, name: str) -> DataFrame:
    """``rows`` with what identifies the resource in column ``url``: the URL without scheme, default
    port and fragment, host in lower case; null without a host."""
    rest = rows.withColumn("__rest", F.regexp_replace(_after_scheme(F.col(url)), r"#.*$", ""))
    parts = rest.withColumn("__site", F.regexp_replace(F.translate(F.regexp_extract("__rest", r"^[^/?]*", 0), UPPER, LOWER), r":(80|443)$", "")).withColumn("__tail", F.regexp_replace("__rest", r"^[^/?]*", ""))
    slash = F.when(F.col("__tail").startswith("/"), "").otherwise("/")
    return parts.withColumn(name, F.when(F.col("__site") != "", F.concat("__site", slash, "__tail"))).drop("__rest", "__site", "__tail")


_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_CONTENT = r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def _quoted(text: Column, pattern: str, groups: int) -> Column:
    """The group that matched, of several ways to quote a value."""
    return F.concat(*(F.regexp_extract(text, pattern, g) for g in range(1, groups + 1)))


def page_links(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Edges (a, b) between addresses that pages declare: all their canonical links and refresh targets, outside comments."""
    html = F.col("html")
    rows = pages.select(F.col(url_column).alias("base"), F.col(html_column).alias("html")).where(html.rlike("(?i)canonical|http-equiv"))
    tags = rows.select("base", F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)).alias("tags"))
    of = lambda holds: F.filter("tags", lambda t: t.rlike(holds))
    canonical = of(r"""(?i)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b""").alias("canonical")
    refresh = of(r"""(?i)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b""").alias("refresh")
    found = tags.select("base", canonical, refresh)
    target = lambda t: F.regexp_extract(_quoted(t, _CONTENT, 2), r"(?i)^\s*[\d.]*\s*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    every = F.concat(F.transform("canonical", lambda t: _quoted(t, _HREF, 3)), F.transform("refresh", target))
    links = found.select("base", F.explode(F.array_distinct(every)).alias("link")).where("trim(link) <> ''")
    parts = links.select(
        F.replace(F.trim("link"), F.lit("&amp;"), F.lit("&")).alias("link"), F.col("base"),
        F.regexp_extract("base", r"^[^:]*", 0).alias("scheme"), F.regexp_extract("base", r"^[^:]*://[^/?#]*", 0).alias("site"),
        F.regexp_extract("base", r"^[^:]*://[^/?#]*((?:/[^/?#]*)*/)", 1).alias("folder"),
    )
    link = F.col("link")
    whole = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat("scheme", F.lit(":"), "link"))
        .when(link.startswith("/"), F.concat("site", "link")).when(link.rlike("^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
        .otherwise(F.concat("site", F.when(F.col("folder") == "", "/").otherwise(F.col("folder")), "link"))
    )
    edges = addressed(addressed(parts.select("base", whole.alias("target")), "base", "a"), "target", "b")
    return cut(edges.select("a", "b"))  # short rows; filters pushed below them would repeat the long expressions


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Id, host, path, rule, verdict (``allow`` or ``block``) and reason (``rule``, ``alias`` or ``default``) of each row.

    ``redirects`` may hold more edges as URLs (source, target). A null or malformed URL
    has empty host and path, fits no rule, has no aliases and is allowed; null html has no
    links. Rows that repeat get equal verdicts. Rules are a short list that becomes one
    expression; edges and addresses stay distributed.
    """
    edges = page_links(pages, url_column, html_column)
    if redirects is not None:
        given = redirects.select(F.col("source").alias("s"), F.col("target").alias("t"))
        edges = edges.unionByName(addressed(addressed(given, "s", "a"), "t", "b").select("a", "b"))
    groups = components(edges)
    seen = F.concat(F.lit("x://"), F.col("node"))
    split = groups.select("node", "component", host(seen).alias("host"), path(seen).alias("path"))
    ruled = split.select("node", "component", rule_of(F.col("host"), F.col("path"), rules)[1].alias("said"))
    decided = ruled.groupBy("component").agg(F.max(F.col("said") == "allow").alias("allowed"), F.max(F.col("said") == "block").alias("blocked"))
    state = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    aliases = groups.join(decided, "component").select(F.col("node").alias("address"), state.alias("state")).where("state is not null")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    plain = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"))
    split = addressed(plain, "url", "address").select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "address")
    out = split.select("*", name.alias("rule"), verdict.alias("said")).join(aliases, "address", "left")
    return out.select(
        F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("said", "state", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("state").isNotNull(), "alias").otherwise("default").alias("reason"),
    )
