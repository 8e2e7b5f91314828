"""URL filtering with redirect equivalence, in built-in expressions only.

Explicit rules judge a url by host and path. Urls that redirect to one another or name one another as canonical are
one page under many names: their connected components carry a block from any name to the names that no rule judges,
unless some name of the component is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, connected_components, saved

#: Query parameters that mark where a visitor came from and never change the page.
TRACKING = ("utm_[^=&]*", "ref", "fbclid", "gclid")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"\A[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def written_key(url: Column) -> Column:
    """A url's name in the alias graph: as written, without its fragment. Null without ``://``."""
    return F.when(after_scheme(url).isNotNull(), F.substring_index(url, "#", 1))


def page_key(url: Column) -> Column:
    """A name that other spellings of a url share too: host without ``www.`` and default port, path without index page and trailing slash, query without tracking parameters; no fragment. Null without ``://``."""
    rest = after_scheme(url)
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)\z", ""), r"\Awww\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?\z", "/"), r"/+\z", "")
    query = F.regexp_extract(rest, r"\A[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"\A({'|'.join(TRACKING)})(=|\z)")))
    return F.when(rest.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def resolved(target: Column, base: Column) -> Column:
    """``target`` as an absolute url, seen from ``base``."""
    t = F.trim(F.regexp_replace(target, "&amp;", "&"))
    scheme = F.concat(F.regexp_extract(base, r"\A([^:/?#]*)://", 1), F.lit("://"))
    folder = F.regexp_extract(path_of(base), r"\A(.*/)", 1)
    return (
        F.when(t == "", None)
        .when(t.rlike(r"(?i)\A[a-z][a-z0-9+.-]*://"), t)
        .when(t.startswith("//"), F.concat(F.regexp_replace(scheme, r"//\z", ""), t))
        .when(t.startswith("/"), F.concat(scheme, host_of(base), t))
        .when(t.rlike(r"(?i)\A([a-z][a-z0-9+.-]*:|#)"), None)
        .otherwise(F.concat(scheme, host_of(base), F.when(folder == "", "/").otherwise(folder), t))
    )


def declared_targets(html: Column) -> Column:
    """Array of the urls a page names as its canonical address or refreshes to."""
    # Head tags are short; the page is cut to its link and meta tags first, each of which is then read for its attribute.
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"""(?is)\A<link\b.*\brel\s*=\s*["']?canonical\b"""))
    refresh = F.filter(tags, lambda t: t.rlike(r"""(?is)\A<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""))
    hrefs = F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    moves = F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'>]+)""", 1))
    return F.concat(hrefs, moves)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule among (verdict, host, path); null if none fits."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str | None = "html", fold_spellings: bool = False
) -> DataFrame:
    """key, host, path, rule, verdict, alias_blocked per row.

    Edges come from ``html`` (canonical links, refreshes) and from ``redirects`` (columns src, dst), a crawler's log. A
    url judged by a rule keeps that verdict; another is blocked if its component has a blocked and no allowed name, else
    allowed. Targets that were never crawled are judged by the rules too. Names are urls as written, but for fragments;
    ``fold_spellings`` takes urls that differ in ``www.``, default port, index page, trailing slash or tracking parameters
    for one name as well.

    A null url, one without ``://`` and null or empty html have no aliases and are allowed; very long html is read whole;
    repeated rows repeat; of fitting rules of one length the last by text wins; an empty
    table gives an empty result; extra columns are ignored, whatever their names.
    """
    name = page_key if fold_spellings else written_key
    u = F.col("_url")
    base = pages.select(F.col(key).alias("_id"), F.col(url).cast("string").alias("_url"), (F.col(html).cast("string") if html else F.lit(None).cast("string")).alias("_html"))
    links = base.filter(u.isNotNull() & F.col("_html").rlike(r"(?i)<(link|meta)\b[^>]*(canonical|refresh)")).select(u, F.explode(declared_targets(F.col("_html"))).alias("_to"))
    edges = links.select(u.alias("src"), resolved(F.col("_to"), u).alias("dst"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("src").cast("string"), resolved(F.col("dst").cast("string"), F.col("src").cast("string")).alias("dst")))
    with Tables(pages.sparkSession) as tables:
        edges = tables.save(edges.filter("src is not null and dst is not null").distinct(), "aliases")
        parts = connected_components(edges.select(name(F.col("src")).alias("a"), name(F.col("dst")).alias("b")), tables, most=0).toDF("_key", "_part")
        names = base.select(u).unionByName(edges.select(F.col("src").alias("_url"))).unionByName(edges.select(F.col("dst").alias("_url")))
        found = names.select(name(u).alias("_key"), rule_of(host_of(u), path_of(u), rules)["verdict"].alias("_said")).filter("_key is not null and _said is not null")
        said = found.groupBy("_key").agg(F.max(F.col("_said") == "block").alias("_block"), F.max(F.col("_said") == "allow").alias("_allow"))
        # a spelling without edges is a component of its own when spellings are folded; else no other url has its name
        of_part = said.join(parts, "_key", "left" if fold_spellings else "inner").groupBy(F.coalesce("_part", "_key").alias("_part"))
        by_part = of_part.agg(F.max("_block").alias("_block"), F.max("_allow").alias("_allow")).filter("_block and not _allow").select("_part")
        # few names are blocked through aliases: those are gathered once per name, and only rows no rule judges look them up
        blocked = saved(by_part.join(parts, "_part", "left").select(F.coalesce("_key", "_part").alias("_key"), F.lit(True).alias("alias_blocked")).distinct(), "blocked")
    judged = base.select("_id", host_of(u).alias("host"), path_of(u).alias("path"), rule_of(host_of(u), path_of(u), rules).alias("_rule"), name(u).alias("_key"))
    open_rows = judged.filter("_rule is null").join(blocked, "_key", "left")
    closed = judged.filter("_rule is not null").withColumn("alias_blocked", F.lit(False))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.coalesce("alias_blocked", F.lit(False)), "block").otherwise("allow")).alias("verdict")
    return closed.unionByName(open_rows.select(closed.columns)).select(F.col("_id").alias(key), "host", "path", F.col("_rule.rule").alias("rule"), verdict, F.coalesce("alias_blocked", F.lit(False)).alias("alias_blocked"))
