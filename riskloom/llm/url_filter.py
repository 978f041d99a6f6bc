"""URL rules whose decisions follow redirects and canonical links.

Addresses that lead to one resource form a component. A rule that fits an address
decides it; an address without a rule takes the decision of its component: an
explicit allow anywhere in it wins, then an explicit block, else it is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower
from riskloom.llm.components import connected_components
from riskloom.session import checkpointed

#: (verdict, host, path) of the production list.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#``; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(
        rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])
    ):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(
            rule_path
        )
        out = F.when(
            fits,
            F.struct(
                F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")
            ),
        ).otherwise(out)
    return out


def link_edges(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of canonical links and refresh redirects inside the pages.

    Only absolute targets (with ``://``, or ``//`` which takes the page's scheme)
    and targets that begin with ``/`` (the page's host) can name a page.
    """
    scheme = F.regexp_extract("url", r"^(.*?://)", 1)
    site = F.regexp_extract("url", r"^(.*?://[^/?#]*)", 1)

    def full(target: Column) -> Column:
        return (
            F.when(target.contains("://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.substr(target, F.lit(3))))
            .when(target.startswith("/"), F.concat(site, target))
        )

    found = F.array(
        full(F.regexp_extract("html", _LINK, 1)), full(F.regexp_extract("html", _REFRESH, 1))
    )
    return pages.select(
        F.col("url").alias("from_url"), F.explode(F.array_compact(found)).alias("to_url")
    ).where("from_url IS NOT NULL")


def url_key(url: Column) -> Column:
    """Host and path: scheme, query and fragment do not make another resource."""
    return F.concat(host_of(url), path_of(url))


def filter_urls(
    pages: DataFrame,
    redirects: DataFrame | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """Judge every page url; returns page_id, host, path, rule, verdict, key.

    ``pages`` has page_id, url, html; ``redirects`` (from_url, to_url) adds known
    redirects to the links found in the pages. Redirect targets need not be pages:
    a rule that fits a target counts for its component. A null url or one without
    ``://`` has an empty host and path, no rule and no aliases: it is allowed.
    Repeated pages are judged each on its own row; pages of an empty table give an
    empty result. Longest rule first; of equally long ones the larger text.
    """
    judged = checkpointed(
        pages.select(
            "page_id",
            "url",
            host_of(F.col("url")).alias("host"),
            path_of(F.col("url")).alias("path"),
        )
        .withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
        .withColumn("key", F.concat("host", "path"))
    )
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("from_url", "to_url"))
    edges = checkpointed(
        edges.select(url_key(F.col("from_url")).alias("a"), url_key(F.col("to_url")).alias("b"))
        .where("a != b AND a != '' AND b != ''")
        .distinct()
    )
    labels = connected_components(edges)
    # Pages count by key first: a hot address is one row from here on.
    seen = judged.where("fit IS NOT NULL AND key != ''").select("key", "fit.verdict").union(
        edges.select(F.explode(F.array("a", "b")).alias("key")).select(
            "key",
            rule_of(
                F.regexp_extract("key", r"(?s)^([^/]*)(.*)$", 1),
                F.regexp_extract("key", r"(?s)^([^/]*)(.*)$", 2),
                rules,
            )["verdict"].alias("verdict"),
        )
    ).where("verdict IS NOT NULL").distinct()
    ruled = (
        seen.join(labels, F.col("key") == F.col("node"), "left")
        .groupBy(F.coalesce("label", "key").alias("label"))
        .agg(F.min("verdict").alias("class_verdict"))  # "allow" sorts before "block"
    )
    blocked = ruled.where("class_verdict = 'block'").select("label")
    # Addresses of blocked components: labels' members, and lone addresses themselves.
    aliases = (
        labels.join(blocked, "label", "left_semi")
        .select(F.col("node").alias("key"))
        .union(blocked.select(F.col("label").alias("key")))
        .distinct()
        .withColumn("alias_blocked", F.lit(True))
    )
    return judged.join(aliases, "key", "left").select(
        "page_id",
        "host",
        "path",
        "fit.rule",
        F.coalesce(
            "fit.verdict", F.when(F.col("alias_blocked"), "block").otherwise("allow")
        ).alias("verdict"),
        "key",
    )
