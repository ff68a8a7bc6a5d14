"""URL filters with redirect equivalence.

Host and path rules decide urls; block decisions then spread to aliases: urls joined by redirects or canonical links
are one class (distributed connected components), and a class with a blocked member blocks its members that no rule
names. Explicit allows take precedence: a url's own rule always stands, and a class that holds an explicitly
allowed url blocks nobody.

Urls are told apart with their queries, by which rules don't look. Only a linked url with a query that is neither a
page nor a link's source counts as an alias of the url without its query, if that one is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

#: Fixed values: (action, host, path prefix).
DEFAULT_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_LINK = r"(?is)<(?:link|meta)\b[^>]*>"


def host_of(url: Column) -> Column:
    """Text between the first '://' and the next '/', '?' or '#', A-Z lower-cased; '' if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; '' if there is no '://'."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def query_of(url: Column) -> Column:
    """The query with its '?'; '' if there is none or no '://'."""
    return F.coalesce(F.regexp_extract(url, _QUERY, 1), F.lit(""))


def key_of(url: Column) -> Column:
    """The url as a node of the alias graph: host, path and query."""
    return F.concat(host_of(url), path_of(url), query_of(url))


def without_dots(path: Column) -> Column:
    """An absolute path with its '.' and '..' segments resolved."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def resolve(url: Column, to: Column) -> Column:
    """The target of a link on a page as a whole url; null if it is of another kind, such as mailto:."""
    own, path, query = path_of(url), F.regexp_extract(to, r"(?s)^[^?#]*", 0), F.regexp_extract(to, r"(?s)^[^?#]*(\?[^#]*)", 1)
    folder = F.when(own == "", "/").otherwise(F.regexp_replace(own, r"[^/]*\z", ""))
    there = (
        F.when(path.startswith("/"), F.concat(without_dots(path), query)).when(path != "", F.concat(without_dots(F.concat(folder, path)), query))
        .otherwise(F.concat(own, F.when(query != "", query).otherwise(query_of(url)))))
    return (
        F.when(to.rlike(_SCHEME + "//"), to).when(to.rlike(_SCHEME), F.lit(None)).when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .otherwise(F.concat(F.lit("http://"), host_of(url), there)))


def best_rule(host: Column, path: Column, rules) -> Column:
    """Longest matching rule as struct(size, allow, rule, action), null if none; equal lengths: allow wins."""
    hits = [
        F.when(
            ((host == F.lit(h)) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(int(a == "allow")).alias("allow"), F.lit(h + p).alias("rule"), F.lit(a).alias("action")),
        )
        for a, h, p in rules
    ]
    return F.greatest(*hits, hits[0]) if hits else F.lit(None).cast("struct<size:int,allow:int,rule:string,action:string>")


def _href(tag: Column, pattern: str) -> Column:
    return F.regexp_extract(tag, pattern, 1)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) keys of canonical links and meta refreshes in the pages' html; relative targets are taken from the page's url."""
    page = pages.select(F.col(url).alias("u"), F.col(html).alias("h")).where(F.col("u").isNotNull() & F.col("h").rlike(r"(?i)canonical|http-equiv"))
    tags = page.select("u", F.explode(F.expr(rf"regexp_extract_all(h, r'{_LINK}', 0)")).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"""(?is)\brel\s*=\s*["']?canonical\b"""), _href(F.col("tag"), r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""))
    refresh = F.when(F.col("tag").rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""), _href(F.col("tag"), r"""(?is)\burl\s*=\s*['"]?([^"'\s>]+)"""))
    found = tags.select("u", F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&")).alias("to")).where(F.length("to") > 0)
    return found.select(key_of(F.col("u")).alias("src"), resolve(F.col("u"), F.col("to")).alias("to")).where("to is not null").select("src", key_of(F.col("to")).alias("dst"))


def unseen_queries(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """(src, dst) from each linked url with a query that no page or source has to the one without it, if one has that."""
    asked = edges.where(F.col("dst").contains("?")).select(F.col("dst").alias("src"), F.substring_index("dst", "?", 1).alias("dst")).distinct()
    known = keys.unionByName(edges.select(F.col("src").alias("key")))
    return asked.join(known, asked["src"] == known["key"], "left_anti").join(known, F.col("dst") == F.col("key"), "left_semi")


def filter_urls(pages: DataFrame, rules=DEFAULT_RULES, redirects: DataFrame | None = None, *, id_col: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """(id, host, path, rule, verdict) for every row.

    redirects: optional (src, dst) urls of observed redirects, added to the links found in the html.
    Null or odd urls (no '://') have empty host and path and match no rule; they are allowed. Repeated rows are
    judged alike. Other columns are ignored. An empty table gives an empty result.
    """
    base = pages.select(F.col(id_col), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), key_of(F.col(url)).alias("key"))
    base = base.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    edges = link_edges(pages, url, html) if html else None
    if redirects is not None:
        seen = redirects.select(key_of(F.col("src")).alias("src"), key_of(F.col("dst")).alias("dst"))
        edges = seen if edges is None else edges.unionByName(seen)
    own = F.col("best")["action"]
    if edges is None:
        return base.select(id_col, "host", "path", F.col("best")["rule"].alias("rule"), F.coalesce(own, F.lit("allow")).alias("verdict"))
    edges = materialize(edges.where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).distinct(), "links")
    edges = edges.unionByName(materialize(unseen_queries(edges, base.select("key")), "queries"))
    classes = materialize(components(edges, "src", "dst"), "aliases")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    action = best_rule(host_of(as_url), path_of(as_url), rules)["action"]
    per_class = classes.withColumn("a", action).groupBy("component").agg(F.bool_or(F.col("a") == "block").alias("blocked"), F.bool_or(F.col("a") == "allow").alias("allowed"))
    spread = (
        classes.join(per_class.where(F.col("blocked") & ~F.coalesce("allowed", F.lit(False))), "component")
        .select(F.col("node").alias("key"), F.lit("block").alias("spread"))
    )
    return (
        base.join(spread, "key", "left")
        .select(id_col, "host", "path", F.col("best")["rule"].alias("rule"), F.coalesce(own, F.col("spread"), F.lit("allow")).alias("verdict"))
    )
