"""URL filters: rules by host and path, spread over redirect and canonical-link aliases. DataFrame operations only.

A rule fits its host and all subdomains where the path starts with its own; the longest that fits decides, and of equally
long ones an allowing rule. Pages that no rule fits take the verdict of their aliases: edges lead from each url to the
form that usual redirects end in (https, no www. or m., no tracking parameters, no final slash or .html) and to the
targets of all canonical links and refreshes of its page, in that form; connected components of these edges are aliases.
Where an alias is allowed by a rule the page is allowed, else blocked where an alias is blocked, else allowed.

Targets are resolved against the page's url as browsers do: //host takes the scheme, /path the origin, ?query the path,
#fragment the page, all else the folder; then . and .. segments go. Targets of schemes without :// (mailto:) are no pages.
A <base> tag is not read, and entities in a target stay as they are. The SQL twin still knows only targets with :// or a
leading slash, and the first of each kind.

A null url, or one without ://, has an empty host and path, no rule and no alias, and is allowed. Repeated urls are
judged alike. A null html has no links. A component's verdict is an aggregate of two booleans, so its size is no matter.
Texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import ascii_lower, settle
from codesieve.llm.components import components

#: (verdict, host, path); the contract's rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""
TRACKING = r"(^|&)(utm_[a-z]+|gclid|fbclid|ref|mc_cid|mc_eid)=[^&]*"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def matching_rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(name, verdict) of the rule that decides; null without one."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def redirected(url: Column) -> Column:
    """Where the usual redirects lead: host, path and the query without tracking parameters."""
    bare = F.regexp_replace(host(url), r"^(www|m)\.", "")
    page = F.regexp_replace(path(url), r"(/index)?(\.html?)?/*$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), TRACKING, ""), "^&", "")
    return F.concat(F.lit("https://"), bare, page, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def without_dots(url: Column) -> Column:
    """The url without . and .. segments in its path."""
    parts = F.split(F.regexp_extract(url, "^[^/?#]*://[^/?#]*([^?#]*)", 1), "/")
    up = lambda stay: F.when(F.size(stay) > 1, F.slice(stay, 1, F.size(stay) - 1)).otherwise(stay)
    stay = F.aggregate(parts, F.array().cast("array<string>"), lambda stay, x: F.when(x == ".", stay).when(x == "..", up(stay)).otherwise(F.concat(stay, F.array(x))))
    # A last segment of dots names a folder.
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(stay, F.array(F.lit("")))).otherwise(stay)
    clean = F.concat(F.regexp_extract(url, "^[^/?#]*://[^/?#]*", 0), F.array_join(folder, "/"), F.regexp_extract(url, "(?s)^[^?#]*(.*)$", 1))
    return F.when(url.rlike(r"^[^/?#]*://[^?#]*/\.\.?(?:[/?#]|$)"), clean).otherwise(url)


def resolved(url: Column, target: Column) -> Column:
    """Where a page's target leads; null for what is no page."""
    origin, page = F.regexp_extract(url, "^([^/?#]*://[^/?#]*)", 1), F.regexp_extract(url, "^[^?#]*", 0)
    folder = F.regexp_extract(page, "^[^/?#]*://[^/?#]*(.*/)", 1)
    starts = lambda x: F.startswith(target, F.lit(x))
    whole = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (origin == ""), None)
    whole = whole.when(starts("//"), F.concat(F.regexp_extract(url, "^([^/?#]*:)//", 1), target)).when(starts("/"), F.concat(origin, target))
    whole = whole.when(starts("#"), url).when(starts("?"), F.concat(page, target))
    return without_dots(whole.otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target)))


def edges(pages: DataFrame) -> DataFrame:
    """(u, v) from each url to its redirected form, and on to those that its page names."""
    url, html = F.col("url"), F.col("html")
    all_of = lambda word, pattern: F.when(F.contains(F.lower(html), F.lit(word)), F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))
    none = F.array().cast("array<string>")
    named = F.concat(*[F.coalesce(all_of(*x), none) for x in (("canonical", LINK), ("refresh", REFRESH))])
    rows = pages.where(F.instr(url, "://") > 0).select("url", redirected(url).alias("form"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(named))).alias("target"))
    v = F.when(F.col("target").isNull(), F.col("form")).otherwise(redirected(resolved(url, F.col("target"))))
    return rows.select(F.when(F.col("target").isNull(), F.col("url")).otherwise(F.col("form")).alias("u"), v.alias("v")).where("v is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_group for every page."""
    rows = pages.select("page_id", "url", host(F.coalesce("url", F.lit(""))).alias("host"), path(F.coalesce("url", F.lit(""))).alias("path"))
    ruled = settle(rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)), "op6-ruled")
    groups = components(edges(pages)).select(F.col("node").alias("url"), F.col("component").alias("alias_group"))
    grouped = settle(ruled.join(groups, "url", "left"), "op6-grouped")
    known = grouped.where("found is not null and alias_group is not null").groupBy("alias_group").agg(
        F.max(F.col("found.verdict") == "allow").alias("allowed"), F.max(F.col("found.verdict") == "block").alias("blocked"))
    spread = F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")
    return grouped.join(settle(known, "op6-known"), "alias_group", "left").select(
        "page_id", "host", "path", F.col("found.name").alias("rule"), F.coalesce("found.verdict", spread).alias("verdict"), "alias_group")
