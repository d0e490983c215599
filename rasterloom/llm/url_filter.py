"""URL filter: host and path rules, carried to aliases through redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.components import connected_components
from rasterloom.llm.shared import only

#: (host, path, verdict); fixed values of the query's contract.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Elements that name another address of the page, and their attributes (quoted with either mark, or bare).
_COMMENT, _LINK, _META, _BASE = r"(?s)<!--.*?-->", r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>", r"(?is)<base\b[^>]*>"
_IS_CANONICAL = r"""(?is)\srel\s*=\s*("[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
_IS_REFRESH = r"""(?is)\shttp-equiv\s*=\s*["']?\s*refresh\b"""
_VALUE = r"""(?is)\s{0}\s*=\s*(?:"([^"]*)|'([^']*)|([^"'\s>]+))"""
_REFRESH_TO = r"""(?is)\burl\s*=\s*["']?([^"']*)"""
#: An address with a scheme; one whose scheme is that of a host; a path with segments to resolve.
_SCHEME, _ABSOLUTE, _DOTS = r"^[A-Za-z][A-Za-z0-9+.-]*:", r"^[A-Za-z][A-Za-z0-9+.-]*://", r"(^|/)\.\.?(/|$)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule (as text) that fits and its verdict, null where none does. The longest wins, then the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def plain_path(path: Column) -> Column:
    """The path with its ``.`` and ``..`` segments resolved."""

    def step(acc: Column, segment: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(segment == "..", up).when(segment == ".", acc).otherwise(F.concat(acc, F.array(segment)))

    return F.when(path.rlike(_DOTS), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")).otherwise(path)


def alias_key(url: Column) -> Column:
    """What two spellings of one address share: host, path and query, without scheme, fragment or the path's closing slash."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]+)", 1)
    return F.concat(url_host(url), F.regexp_replace(plain_path(url_path(url)), "/+$", ""), query)


def resolve(base: Column, ref: Column) -> Column:
    """The absolute address that ``ref`` names on a page at ``base``; null for an empty one and for schemes without a host."""
    ref = F.trim(F.regexp_replace(F.regexp_replace(ref, r"(?s)#.*$", ""), r"&(amp|#38|#[xX]26);", "&"))
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url_path(base), r"(?s)^(.*/)", 1)
    return (
        F.when(ref == "", None)
        .when(ref.rlike(_SCHEME), F.when(ref.rlike(_ABSOLUTE), ref))
        .when(ref.startswith("//"), F.concat(F.lit("http:"), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("?"), F.concat(origin, url_path(base), ref))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), ref))
    )


def _attribute(tag: Column, name: str) -> Column:
    return F.concat(*(F.regexp_extract(tag, _VALUE.format(name), i) for i in (1, 2, 3)))


def page_edges(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """``(a, b)``: address keys of a page and of all that its canonical links and meta refreshes name.

    Targets are resolved against the page's address or its first ``base`` element; comments don't count.
    """
    at = F.col(f"`{url}`")
    rows = pages.where(at.contains("://") & F.col(f"`{html}`").rlike(r"(?i)\bcanonical\b|\bhttp-equiv\b"))
    rows = rows.select(at.alias("url"), F.regexp_replace(F.col(f"`{html}`"), _COMMENT, "").alias("html"))

    def tags(pattern: str) -> Column:
        return F.regexp_extract_all("html", F.lit(pattern), F.lit(0))

    links = F.transform(F.filter(tags(_LINK), lambda t: t.rlike(_IS_CANONICAL)), lambda t: _attribute(t, "href"))
    turns = F.transform(F.filter(tags(_META), lambda t: t.rlike(_IS_REFRESH)), lambda t: F.regexp_extract(_attribute(t, "content"), _REFRESH_TO, 1))
    first = F.coalesce(F.try_element_at(F.transform(tags(_BASE), lambda t: _attribute(t, "href")), F.lit(1)), F.lit(""))
    rows = rows.select("url", F.coalesce(resolve(F.col("url"), first), "url").alias("base"), F.explode(F.concat(links, turns)).alias("ref"))
    named = rows.select(alias_key(F.col("url")).alias("a"), resolve(F.col("base"), F.col("ref")).alias("to")).where("to IS NOT NULL")
    return named.select("a", alias_key(F.col("to")).alias("b"))


def filter_urls(
    spark: SparkSession,
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    default: str = "allow",
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Verdict of every page's URL: ``page_id, url, host, path, rule, verdict, decided_by``.

    A rule that fits the URL itself decides. Otherwise the page takes the decision of its aliases:
    the connected component of its address (with its query) over canonical links, meta refreshes and the rows of
    ``redirects(from_url, to_url)``. One alias that a rule allows makes the component allowed
    (explicit allow takes precedence), else one that a rule blocks makes it blocked; with neither,
    ``default`` holds. Null or relative URLs have empty host and path, no aliases, and the default.
    Repeated rows are judged each; an empty table gives an empty one.
    """
    edges = page_edges(pages, page_id, url, html)
    if redirects is not None:
        known = redirects.where(F.col("from_url").contains("://") & F.col("to_url").contains("://"))
        edges = edges.unionByName(known.select(alias_key(F.col("from_url")).alias("a"), alias_key(F.col("to_url")).alias("b")))
    at = F.col(f"`{url}`")
    rows = only(pages, page_id, url).select("*", url_host(at).alias("host"), url_path(at).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    if edges.where("a <> b").limit(1).count() == 0:
        aliased = rows.withColumn("by_alias", F.lit(None).cast("string"))
    else:
        members = connected_components(spark, edges)
        key = F.col("node")
        host, path = F.regexp_extract(key, "(?s)^([^/?]*)", 1), F.regexp_extract(key, "(?s)^[^/?]*([^?]*)", 1)
        # A key has lost its closing slash, which a rule's path may end with.
        _, bare = matching_rule(host, path, rules)
        _, slashed = matching_rule(host, F.concat(path, F.lit("/")), rules)
        judged = members.withColumn("v", F.coalesce(bare, slashed))
        decided = judged.groupBy("component").agg(
            F.max(F.when(F.col("v") == "allow", 2).when(F.col("v") == "block", 1).otherwise(0)).alias("best")
        )
        decided = decided.select("component", F.when(F.col("best") == 2, "allow").when(F.col("best") == 1, "block").alias("by_alias"))
        aliases = members.join(decided, "component").select(F.col("node").alias("key"), "by_alias")
        aliased = rows.withColumn("key", alias_key(at)).join(aliases, "key", "left")
    return aliased.select(
        page_id, url, "host", "path", "rule",
        F.coalesce("by_rule", "by_alias", F.lit(default)).alias("verdict"),
        F.when(F.col("by_rule").isNotNull(), "rule").when(F.col("by_alias").isNotNull(), "alias").otherwise("default").alias("decided_by"),
    )
