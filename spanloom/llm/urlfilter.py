"""URL filters: host and path rules, carried over to aliases by connected components of redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh
from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of a page in which tags are text.
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_IS_CANONICAL, _HREF = r"(?is)^<link\b.*[\s\"'/]rel\s*=\s*[\"']?canonical\b", r"(?is)[\s\"'/]href\s*=\s*[\"']?([^\"'\s>]+)"
_IS_REFRESH, _URL = r"(?is)^<meta\b.*[\s\"'/]http-equiv\s*=\s*[\"']?refresh\b", r"(?is)[\s\"'/]content\s*=\s*[\"']?[^\"'>]*?url\s*=\s*['\"]?([^\"'\s>]+)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: Parameters that do not change a page.
_TRACKING = r"^(?:utm_[a-z]+|ref)="

Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def page_of(url: Column) -> Column:
    """The node of a URL: the URL without its fragment, which no server sees, and with its host lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(F.translate(F.regexp_extract(url, r"(?s)^(.*?://)", 1), _UPPER, _LOWER), host_of(url), rest))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` that fits: (``allow`` or ``block``, ``host/path``).

    A rule fits its host and all its subdomains if the path starts with the rule's; of equally long ones the first.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def resolved(base: Column, target: Column) -> Column:
    """A link's target as a URL: with a scheme as it is, else relative to the page ``base`` (its scheme, host, path or
    directory), ``.`` and ``..`` resolved.  Null for schemes without a host (``mailto:``) and for a bare fragment."""
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(base)
    directory = F.regexp_replace(path, r"[^/]*$", "")
    place = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    rest = F.substr(target, F.length(place) + 1)
    whole = F.when(place == "", path).when(place.startswith("/"), place).otherwise(F.concat(F.when(directory == "", "/").otherwise(directory), place))
    steps = F.split(F.regexp_replace(whole, "^/", ""), "/")
    walked = F.aggregate(steps, F.lit(""), lambda done, x: F.when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x)))
    tidy = F.concat(walked, F.when(whole.rlike(r"(?:^|/)\.\.?$"), "/").otherwise(""))
    joined = F.concat(site, F.when(F.size(F.array_intersect(steps, F.array(F.lit("."), F.lit("..")))) > 0, tidy).otherwise(whole), rest)
    return (F.when(target.rlike(_SCHEME), F.when(target.rlike(_SCHEME + "//"), target))
            .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
            .when(~target.startswith("#"), joined))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes joined by a page's canonical links and refreshes, which comments and scripts cannot hold."""
    at = page_of(F.col("url").cast("string"))
    html = F.col("html").cast("string")
    head = F.lower(html)
    # few pages have either; the plain search goes first
    tags = F.when(head.contains("canonical") | head.contains("refresh"), F.regexp_extract_all(F.regexp_replace(html, _HIDDEN, " "), F.lit(_TAG), F.lit(0)))
    rows = pages.select(at.alias("a"), F.explode(tags).alias("tag")).where("a is not null")
    link = F.when(F.col("tag").rlike(_IS_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(F.col("tag").rlike(_IS_REFRESH), F.regexp_extract("tag", _URL, 1))
    rows = rows.select("a", F.replace(link, F.lit("&amp;"), F.lit("&")).alias("t")).where("t <> ''")
    return rows.select("a", page_of(resolved(F.col("a"), F.col("t"))).alias("b")).where("b is not null")


def usual_form(node: Column) -> Column:
    """Where sites commonly redirect a URL to: https, the host without ``www.`` or ``m.``, the path without ``.html``,
    ``/index.html`` or a slash at its end, no tracking parameters."""
    host = F.regexp_replace(host_of(node), r"^(?:www|m)\.|:(?:80|443)$", "")
    path = F.regexp_replace(path_of(node), r"(?:/index\.html|\.html|/)$", "")
    query = F.regexp_extract(node, r"(?s)^[^?]*\?(.*)$", 1)
    left = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(_TRACKING)), "&")
    scheme = F.regexp_replace(F.regexp_extract(node, r"(?s)^(.*?://)", 1), "^http://$", "https://")
    return F.concat(scheme, host, path, F.when(left != "", F.concat(F.lit("?"), left)).otherwise(""))


def usual_redirects(pages: DataFrame) -> DataFrame:
    """(a, b): each page's node and its :func:`usual_form`, where they differ."""
    rows = pages.select(page_of(F.col("url").cast("string")).alias("a")).where("a is not null").distinct()
    return rows.select("a", usual_form(F.col("a")).alias("b")).where("a <> b")


def judged(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, default: str = "allow", usual: bool = True) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url, html; others are ignored).

    A rule of the page's own decides.  Without one, the page's equivalence class does, which redirects (a table of
    ``source`` and ``target`` URLs), the pages' canonical links and refreshes and, unless ``usual`` is off, the usual
    redirects between variants of one URL make: an explicit allow anywhere in the class takes precedence, then an
    explicit block; a class with neither gets ``default``.  Targets that are no page of
    the table bring the rules that fit them.  Null URLs and those without ``://`` are alone and get ``default``.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), page_of(url).alias("node"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("own"))
    edges = alias_edges(pages)
    if usual:
        edges = edges.unionByName(usual_redirects(pages))
    if redirects is not None:
        s, t = page_of(F.col("source").cast("string")), page_of(F.col("target").cast("string"))
        edges = edges.unionByName(redirects.select(s.alias("a"), t.alias("b")))
    member = connected_components(edges)
    member = member.unionByName(member.select(F.col("root").alias("node"), "root").distinct())
    _, told = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    # "allow" sorts before "block": the least decision of a class is the one that takes precedence
    spread = member.groupBy("root").agg(F.min(told).alias("shared")).join(member, "root").select("node", "shared")
    rows = rows.join(spread, "node", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit(default)).alias("verdict"))


def kept_pages(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """The rows of ``pages``, with all their columns, whose page_id no verdict blocks (null page_ids stay)."""
    bad = judged(pages, rules, redirects).where("verdict = 'block'").select("page_id").distinct()
    key = fresh(pages.columns, "blocked")
    bad = bad.withColumnRenamed("page_id", key)
    return pages.join(bad, pages["page_id"] == bad[key], "left_anti")
