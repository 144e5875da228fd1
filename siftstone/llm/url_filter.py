"""URL rules with redirect equivalence, in DataFrame operations only.

A rule (host, path, action) fits its host and all subdomains, if the url's path starts with the rule's;
the longest rule wins. Redirects and canonical links make urls aliases: decisions pass over connected
components of those edges. What a url's own rule says is never changed. Of urls without a rule, those in
a component with an allowed url are allowed (allow goes before block), those in a component with a
blocked url and no allowed one are blocked, and all others are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.columns import shared_checkpoint
from siftstone.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "rule_host string, rule_path string, action string"


def _rest(url: Column) -> Column:
    """What follows the first ://, or null."""
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """Name of a url among aliases: host, path and query, without scheme and fragment; null without ://."""
    return F.concat(url_host(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1))


def _without_dots(path: Column) -> Column:
    """A path from the root, its . and .. segments resolved."""
    parts = F.split(path, "/", -1)
    parts = F.slice(parts, 2, F.size(parts))
    empty = F.slice(parts, 1, 0)
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    kept = F.aggregate(parts, empty, lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    slash = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(slash, "/").otherwise(""))


def _target(url: Column, href: Column) -> Column:
    """The absolute url of a link on a page; null if it has another scheme without // or is relative on a url without ://.

    Relative links are resolved against the page's url: a query against its path, other ones against
    the directory of it; . and .. are resolved in the path of a relative link.
    """
    href = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    path, tail = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    own = F.regexp_extract(url_path(url), r"^/.*", 0)
    own = F.when(own == "", "/").otherwise(own)
    merged = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_extract(own, r"^.*/", 0), path))
    site = F.concat(F.lit("http://"), url_host(url))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (F.locate("://", url) == 0), F.lit(None))
        .when(href.startswith("#"), url)
        .when(path == "", F.concat(site, own, tail))
        .otherwise(F.concat(site, _without_dots(merged), tail))
    )


def _resolved(url: Column, href: Column) -> Column:
    """The target, both columns being looked at once however often the rules above name them."""
    return F.element_at(F.transform(F.array(F.named_struct(F.lit("url"), url, F.lit("href"), href)), lambda v: _target(v["url"], v["href"])), 1)


#: Comments, and elements whose content is no markup, each with all it holds; one without an end goes on to the end of the page.
_NO_MARKUP = r"""(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|xmp|iframe|noframes)(?=[\s/>])(?:[^>"']|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)"""
#: Tags that can name another url; a > in a quoted value is no end.
_TAGS = r"""(?is)<(?:link|meta|base)(?=[\s/>])(?:[^>"']|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)"""
_ATTRIBUTES = r"""(?s)[^\s"'>/=][^\s>/=]*+(?:\s*+=\s*+(?:"[^"]*+"?|'[^']*+'?|[^\s"'>][^\s>]*+))?"""


def _attributes(tag: Column) -> Column:
    """The attributes of a tag in order, as an array of name (in lower case) and value (without its quotes; empty if there is none)."""
    texts = F.regexp_extract_all(F.regexp_replace(tag, r"^<\w+", ""), F.lit(_ATTRIBUTES), F.lit(0))

    def one(text: Column) -> Column:
        raw = F.regexp_extract(text, r"(?s)^[^\s=]+\s*=\s*(.*)$", 1)
        value = F.regexp_replace(raw, r"""(?s)^(["'])(.*?)\1?$""", "$2")
        return F.struct(F.lower(F.regexp_extract(text, r"^[^\s=]+", 0)).alias("name"), value.alias("value"))

    return F.transform(texts, one)


def _value(attributes: Column, name: str) -> Column:
    """The first value of an attribute, or null."""
    return F.get(F.filter(attributes, lambda a: a["name"] == name), F.lit(0))["value"]


def _refresh_target(content: Column) -> Column:
    """What a refresh goes to: behind its seconds, with url= or without, in quotes or not; null if it stays."""
    rest = F.regexp_extract(content, r"(?is)^\s*[0-9.]+(?:\s*[;,]|\s)\s*(?:url\s*=\s*)?(.*)$", 1)
    quoted = F.regexp_extract(rest, r"""(?s)^(["'])(.*?)(?:\1.*)?$""", 2)
    return F.nullif(F.when(rest.rlike("""^["']"""), quoted).otherwise(rest), F.lit(""))


def html_edges(pages: DataFrame) -> DataFrame:
    """src and dst urls of canonical links and of refresh redirects in the html of pages (url, html).

    Tags count as a browser reads them: not in comments and scripts, attributes by their whole names (the
    first of a name), canonical as one of the words of rel, a refresh with url= or without. Relative links
    are resolved against the page's first base element with an href, if it has one, and its url.
    """
    known = pages.filter("html is not null and url is not null").filter(F.col("html").rlike(r"(?i)<(?:link|meta)[\s/]"))
    tags = F.regexp_extract_all(F.regexp_replace("html", _NO_MARKUP, ""), F.lit(_TAGS), F.lit(0))
    read = F.transform(tags, lambda t: F.struct(F.lower(F.regexp_extract(t, r"^<(\w+)", 1)).alias("kind"), _attributes(t).alias("a")))
    bases = F.filter("read", lambda t: (t["kind"] == "base") & _value(t["a"], "href").isNotNull())
    base = _value(F.get(bases, F.lit(0))["a"], "href")
    rows = known.select("url", read.alias("read")).select("url", F.coalesce(_resolved(F.col("url"), base), F.col("url")).alias("base"), F.explode("read").alias("tag"))
    a, kind = F.col("tag.a"), F.col("tag.kind")
    canonical = F.when((kind == "link") & F.array_contains(F.split(F.lower(F.coalesce(_value(a, "rel"), F.lit(""))), r"\s+"), "canonical"), _value(a, "href"))
    refresh = F.when((kind == "meta") & (F.lower(F.trim(_value(a, "http-equiv"))) == "refresh"), _refresh_target(_value(a, "content")))
    found = rows.select("url", "base", F.trim(F.regexp_replace(F.coalesce(canonical, refresh), r"[\t\r\n]", "")).alias("href")).filter("href <> ''")
    return found.select(F.col("url").alias("src"), F.when(F.col("href").startswith("#"), F.col("url")).otherwise(_resolved(F.col("base"), F.col("href"))).alias("dst")).filter("dst is not null")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """For each different (host, path) of places that a rule fits: host, path, rule and action of the longest rule; of equally long ones allow, then the last by name."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = places.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    fits = keys.join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(name).alias("n"), (F.col("action") == "allow").alias("allow"), name.alias("rule")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", F.when(F.col("best.allow"), "allow").otherwise("block").alias("action"))


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict and component (null without an alias), one row for each row of pages (page_id, url, html).

    redirects: further edges (src, dst urls). A null url and one without :// have an empty host and
    path, fit no rule and have no alias; they are allowed. Rows that repeat are judged each. Aliases
    that are no pages themselves pass decisions on too. An empty table gives an empty table.
    """
    edges = html_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst"))
    edges = shared_checkpoint(edges)  # pages are searched for links once
    named = edges.select(url_node(F.col("src")).alias("src"), url_node(F.col("dst")).alias("dst"), F.col("src").alias("u"), F.col("dst").alias("v"))
    components = connected_components(named)
    members = named.select(F.col("src").alias("node"), F.col("u").alias("url")).union(named.select(F.col("dst").alias("node"), F.col("v").alias("url")))
    members = members.select("node", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).distinct()
    said = members.join(match_rules(members, rules), ["host", "path"]).join(components, "node").groupBy("component").agg(F.bool_or(F.col("action") == "allow").alias("allowed"))
    aliases = components.join(said, "component", "left")

    url = F.col("url")
    parsed = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), url_node(url).alias("node"))
    judged = parsed.join(match_rules(parsed, rules), ["host", "path"], "left").join(aliases, "node", "left")
    passed_on = F.when(F.col("allowed"), "allow").when(~F.col("allowed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", passed_on).alias("verdict"), "component")
