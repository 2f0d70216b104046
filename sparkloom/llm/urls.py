"""URL filter with redirect equivalence (operator 6, SQL only).

Pages whose URLs redirect to each other, or name each other as canonical, are one resource: block decisions of
explicit rules spread over such a component to its members without a rule of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import let


@dataclass(frozen=True)
class UrlRule:
    """`action` ("allow" or "block") for `host` with all subdomains, under `path`."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """Host, ASCII letters in lower case; empty for a null URL or one without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path up to ? or #; empty for a null URL or one without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def resource_of(url: Column) -> Column:
    """Key of the resource a URL names: host, path and query without scheme and fragment; null if it has no host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), F.coalesce(query, F.lit(""))))


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits; null if none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.action == "allow")):  # later ones win
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, action = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.action)).otherwise(action)
    return name, action


def _judge(url: Column, rules: tuple[UrlRule, ...]) -> Column:
    """Struct of host, path, resource, rule and action for a URL."""

    def rule(parts: Column) -> Column:
        name, action = matching_rule(parts["host"], parts["path"], rules)
        return F.struct(parts["host"].alias("host"), parts["path"].alias("path"), parts["resource"].alias("resource"), name.alias("rule"), action.alias("action"))

    return let(F.struct(host_of(url).alias("host"), path_of(url).alias("path"), resource_of(url).alias("resource")), rule)


def _absolute(link: Column, url: Column) -> Column:
    """The absolute form of a link found on the page at url; null for one that names no web page."""
    link = F.regexp_replace(F.trim(link), "&amp;", "&")
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(url), r"^[^/?#]*", 0))
    folder = F.regexp_extract(path_of(url), r"^(?:[\s\S]*/)?", 0)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when((link == "") | link.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None).cast("string"))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between resources: canonical links and refresh redirects of each page's HTML, where they lead elsewhere."""
    # Tags are cut out first, so that attributes may come in any order and quoting.
    html = F.coalesce("html", F.lit(""))
    tags = F.when(
        html.rlike(r"(?i)canonical|refresh"),
        F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), 0), lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b|\bhttp-equiv\s*=\s*[\"']?refresh\b")),
    )

    def target(tag: Column) -> Column:
        href = F.coalesce(*(F.nullif(F.regexp_extract(tag, rf"(?i)\bhref\s*=\s*{form}", 1), F.lit("")) for form in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")))
        refresh = F.regexp_extract(tag, r"(?i)\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"'>]*)", 1)
        return F.when(tag.rlike(r"(?i)^<link"), href).otherwise(refresh)

    ends = let(F.struct(F.col("url").alias("url"), target(F.col("tag")).alias("to")), lambda x: F.struct(resource_of(x["url"]).alias("a"), resource_of(_absolute(x["to"], x["url"])).alias("b")))
    edges = pages.select("url", F.explode(tags).alias("tag")).select(ends.alias("ends")).select("ends.*")
    return edges.where("a is not null and b is not null and a != b").distinct()


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Decide on every page: page_id, url, host, path, rule, verdict, via, component.

    pages: page_id, url and, where canonical links and refresh tags should count, html. redirects: further edges
    (source, target) of absolute URLs, such as a crawler's redirect log.

    The longest fitting rule decides, whatever a component says. A page without a rule is blocked if some page
    or link target in its component is blocked by a rule and none is explicitly allowed; else it is allowed.
    via is "rule", "alias" or "default"; component is the smallest resource of the component, null for a URL
    without host.

    Null or unusable URLs have empty host and path, no rule and no component, and are allowed. Repeated pages
    are judged alike, one row each. Extra columns are ignored. An empty table gives an empty result.
    """
    has_html = "html" in pages.columns
    pages = pages.select("page_id", "url", *(["html"] if has_html else []))
    edges = page_links(pages) if has_html else pages.sparkSession.createDataFrame([], "a string, b string")
    if redirects is not None:
        edges = edges.unionByName(redirects.select(resource_of(F.col("source")).alias("a"), resource_of(F.col("target")).alias("b")).where("a != b"))
    members = connected_components(edges)
    judged = pages.select("page_id", "url", let(F.col("url"), lambda u: _judge(u, rules)).alias("own")).select("page_id", "url", "own.*")
    if members is None:
        component, verdict = F.col("resource"), F.coalesce("action", F.lit("allow"))
        return judged.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNotNull(), "rule").otherwise("default").alias("via"), component.alias("component"))
    # A link target counts by the rule that fits it, whether or not its page was crawled.
    bare = members.select("node", "component", F.regexp_extract("node", r"^[^/?#]*", 0).alias("host"), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    votes = bare.select("component", matching_rule(F.col("host"), F.col("path"), rules)[1].alias("vote")).groupBy("component").agg(F.max(F.col("vote") == "block").alias("blocked"), F.max(F.col("vote") == "allow").alias("allowed"))
    decided = members.join(votes, "component").select(F.col("node").alias("resource"), "component", (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("spread"))
    out = judged.join(decided, "resource", "left")
    alias = F.coalesce("spread", F.lit(False))
    return out.select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("action", F.when(alias, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(alias, "alias").otherwise("default").alias("via"),
        F.coalesce("component", "resource").alias("component"),
    )


def op6_query(spark, sf_dir: str) -> DataFrame:
    """op6: page_id, host, path, rule, verdict of every page."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "via")


def _sql_rest(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) END"


def _sql_parts(url: str) -> str:
    """host, path and query of a URL as select items."""
    rest = _sql_rest(url)
    return f"""coalesce(translate(regexp_extract({rest}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
      coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract({rest}, '^[^?#]*(\\?[^#]*)?', 1) AS query"""


def _sql_rule(wanted: str, rules: tuple[UrlRule, ...] = RULES) -> str:
    """Name or action of the longest rule that fits columns host and path."""
    longest = sorted(rules, key=lambda r: (len(r.name), r.action == "allow"), reverse=True)
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, wanted)}'" for r in longest) + " END"


_S, _QUOTE = r"[\x09-\x0D\x20]", "[\"'']"
_RESOURCE = "CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || coalesce(query, '') END"

OP6_SQL = rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, {_sql_parts("url")} FROM pages
), judged AS (
  SELECT *, {_RESOURCE} AS resource, {_sql_rule("name")} AS rule, {_sql_rule("action")} AS action FROM parts
), tags AS (
  SELECT url, path, resource, unnest(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta){_S}[^>]*>'),
    lambda t: regexp_matches(t, '(?i)\brel{_S}*={_S}*{_QUOTE}?canonical\b|\bhttp-equiv{_S}*={_S}*{_QUOTE}?refresh\b'))) AS tag FROM judged
), targets AS (
  SELECT url, path, resource, replace(trim(CASE WHEN regexp_matches(tag, '(?i)^<link') THEN coalesce(
      nullif(regexp_extract(tag, '(?i)\bhref{_S}*={_S}*"([^"]*)"', 1), ''), nullif(regexp_extract(tag, '(?i)\bhref{_S}*={_S}*''([^'']*)''', 1), ''),
      nullif(regexp_extract(tag, '(?i)\bhref{_S}*={_S}*([^\x09-\x0D\x20"''>]+)', 1), ''))
    ELSE regexp_extract(tag, '(?i)\bcontent{_S}*={_S}*{_QUOTE}?{_S}*[0-9.]*{_S}*[;,]{_S}*(?:url{_S}*={_S}*)?{_QUOTE}?([^"''>]*)', 1) END), '&amp;', '&') AS link,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract({_sql_rest("url")}, '^[^/?#]*', 0) AS site,
    regexp_extract(path, '^(?:(?s:.*)/)?', 0) AS folder FROM tags
), absolute AS (
  SELECT resource AS a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link
    WHEN starts_with(link, '/') THEN scheme || '://' || site || link WHEN link = '' OR regexp_matches(link, '^(#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL
    ELSE scheme || '://' || site || CASE WHEN folder = '' THEN '/' ELSE folder END || link END AS target FROM targets
), ends AS (
  SELECT a, {_RESOURCE} AS b FROM (SELECT a, {_sql_parts("target")} FROM absolute)
), edges AS (
  SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b
), reach AS (
  SELECT a AS node, a AS other FROM edges UNION SELECT node, b FROM reach JOIN edges ON other = a
), votes AS (
  SELECT node, bool_or(coalesce(vote = 'block', false)) AND NOT bool_or(coalesce(vote = 'allow', false)) AS spread
  FROM (SELECT node, {_sql_rule("action")} AS vote FROM (SELECT node, regexp_extract(other, '^[^/?#]*', 0) AS host, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) AS path FROM reach)) GROUP BY node
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN spread THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN spread THEN 'alias' ELSE 'default' END AS via
FROM judged LEFT JOIN votes ON resource = node
"""
