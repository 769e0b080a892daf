"""URL allow and block rules, carried over redirects and canonical links.

A rule names a host and the start of a path; it fits the host and all its
subdomains, and the longest rule that fits decides.  Pages that redirect, or
that name another URL as canonical, are the same resource: the connected
components over such links carry a block to every alias that no rule of its
own decides.  An explicit allow takes precedence: a page that an allow rule
fits stays allowed whatever its aliases are.  What neither a rule nor an alias
blocks is allowed.

DataFrame operations only.  Rules meet URLs by an equi-join on the host's
suffixes; components are found by aggregations and joins (see ``graph``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.llm.common import ascii_lower, let
from kohort.llm.graph import connected_components
from kohort.session import materialize

ALLOW, BLOCK = "allow", "block"
LINK = r"(?is)<link\b[^>]*>"
BASE = r"(?is)<base\b[^>]*>"
META = r"(?is)<meta\b[^>]*>"
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What links tell URLs apart by: host, path without dot segments, and query; null without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, without_dots(path_of(url)), query_of(url)))


def query_of(url: Column) -> Column:
    """The query with its question mark; empty without one."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path with its segments ``.`` and ``..`` worked out; ``/`` for an empty one."""
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    # a dot segment at the end names a folder
    whole = F.when(last.isin(".", ".."), F.concat(path, F.lit("/"))).otherwise(path)
    steps = F.slice(F.split(whole, "/"), F.lit(2), F.greatest(F.lit(0), F.size(F.split(whole, "/")) - 1))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(
        x == "..", F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(x))))
    return (F.when(path == "", "/").when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/")))
            .otherwise(path))


def attribute(tag: Column, name: str) -> Column:
    rx = rf"(?is)\s{name}{VALUE}"
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, rx, k), F.lit("")) for k in (1, 2, 3)])


def resolved(target: Column, base: Column) -> Column:
    """An absolute URL from a link's target and the URL it is relative to; null if there is none.

    A target may be absolute, begin with ``//``, ``/`` or ``?``, or be a path from
    the base's folder; ``.`` and ``..`` are worked out.  Empty targets, fragments
    alone and other schemes (``mailto:``) give null.
    """
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"^([^:/?#]*):\/\/", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(after_scheme(base), r"^[^/?#]*", 0))
    folder = F.regexp_extract(path_of(base), r"^(.*/)?", 0)
    full = (F.when(target == "", None).when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(root, target))
            .when(target.startswith("?"), F.concat(root, path_of(base), target))
            .when(target.rlike("^#|^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target)))
    return let(full, lambda u: F.concat(F.regexp_extract(u, r"^(.*?://[^/?#]*)", 1), without_dots(path_of(u)), query_of(u)))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of the pages' canonical links and immediate or timed refreshes; absolute URLs.

    They are relative to the page's first ``<base href>``, itself relative to its url, or else to its url.
    """
    may = F.col("html").rlike("(?i)canonical|http-equiv")
    tags = F.concat(
        F.transform(F.filter(F.regexp_extract_all("html", F.lit(LINK), F.lit(0)),
                             lambda t: F.lower(attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)")),
                    lambda t: attribute(t, "href")),
        F.transform(F.filter(F.regexp_extract_all("html", F.lit(META), F.lit(0)),
                             lambda t: F.lower(attribute(t, "http-equiv")) == "refresh"),
                    lambda t: F.regexp_extract(attribute(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1)))
    named = F.get(F.regexp_extract_all("html", F.lit(BASE), F.lit(0)), 0)
    base = F.coalesce(resolved(attribute(named, "href"), F.col("url")), F.col("url"))
    targets = F.filter(let(base, lambda b: F.transform(tags, lambda t: resolved(t, b))), lambda t: t.isNotNull())
    return pages.filter(F.col("url").isNotNull() & may).select("url", F.explode(targets).alias("target"))


def place(url: Column) -> Column:
    """struct(node, host, path) of a URL."""
    return let(url, lambda u: F.struct(node_of(u).alias("node"), host_of(u).alias("host"), path_of(u).alias("path")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    rows = [(verdict, host.lower(), path) for verdict, host, path in rules]
    if any(verdict not in (ALLOW, BLOCK) for verdict, _, _ in rows):
        raise ValueError(f"a rule's verdict is {ALLOW} or {BLOCK}")
    return spark.createDataFrame(rows, "verdict string, rule_host string, rule_path string")


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) of every distinct (host, path) that a rule fits.

    The longest rule (host and path together) wins; of two with the same
    text, allow.
    """
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))
    fits = (places.select("host", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
            .filter(F.startswith("path", "rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("size"), (F.col("verdict") == ALLOW).alias("allows"), rule.alias("rule"),
                          F.col("verdict")))
    return (fits.groupBy("host", "path").agg(best.alias("best"))
            .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict")))


def filtered(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html).

    ``links`` (url, target) are further redirects, such as a crawler's log.
    A null url, or one without ``://``, has empty host and path, is no alias
    of anything and is allowed; null html has no links.  A repeated row gets
    an equal result.  A blocked URL blocks its aliases even if it is itself
    no page of the table.  An empty table gives no rows.
    """
    found = page_links(pages)
    if links is not None:
        found = found.unionByName(links.select("url", "target"))
    ends = found.select(place(F.col("url")).alias("x"), place(F.col("target")).alias("y"))
    ends = materialize(ends.filter("x.node is not null and y.node is not null").distinct())
    parts = connected_components(ends.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    linked = ends.select("x.*").unionByName(ends.select("y.*")).distinct()

    rows = pages.select("page_id", place(F.col("url")).alias("place")).select("page_id", "place.*")
    known = judged(rows.select("host", "path").unionByName(linked.select("host", "path")), rules)
    blocked = (linked.join(known.filter(F.col("rule_verdict") == BLOCK), ["host", "path"]).select("node")
               .join(parts, "node").select("root").distinct())
    spread = parts.join(blocked, "root").select("node", F.lit(True).alias("alias_blocked"))
    out = rows.join(known, ["host", "path"], "left").join(spread, "node", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("alias_blocked"), BLOCK), F.lit(ALLOW))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
