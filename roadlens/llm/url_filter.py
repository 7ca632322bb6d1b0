"""URL filter: host and path rules, carried to aliases along redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col
from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only track where a visit came from.
TRACKING = "ref|fbclid|gclid|utm_[a-z]+"
#: Entities in addresses, and what they stand for, in the order in which they are replaced.
ENTITIES = (("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _rest(url: Column) -> Column:
    """What follows the first ://, or null."""
    return F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A rule is host and path, such as ``example.com/en/``."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict of {rule}: {verdict}")
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def address(url: Column) -> Column:
    """Host, path and query as they are, without scheme and fragment; null without a host."""
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def alias_key(url: Column) -> Column:
    """The address that a site would name as canonical: no scheme, www. or m. before the host, fragment, tracking parameters, index page, .html or last slash."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(rf"^({TRACKING})="))
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.when(host_of(url) != "", F.concat(host, path, query))


def declared_links(html: Column, base: Column) -> Column:
    """Addresses that a page names as canonical or refreshes to, made absolute by the page's own.

    ``canonical`` may be any of rel's words. Those that start with / are on the page's own site, with ? on its path, all others
    in its path's folder; . and .. are resolved. Of entities, those of & and / are decoded.
    """
    tags = F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)rel\s*=\s*([\"'][^\"'>]*\bcanonical\b|canonical)|http-equiv\s*=\s*[\"']?refresh"))
    target = F.transform(tags, lambda t: F.regexp_extract(t, r"(?is)(?:href\s*=\s*|url\s*=\s*)[\"']?([^\"'\s>]+)", 1))
    site = F.concat(F.regexp_extract(base, r"(?s)^(.*?://)", 1), host_of(base))
    page = F.concat(site, path_of(base))
    folder = F.concat(site, F.regexp_replace(path_of(base), r"(?s)[^/]*$", ""), F.when(path_of(base) == "", "/").otherwise(""))
    full = lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).when(x.startswith("/"), F.concat(site, x)).when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), x).when(x.startswith("?"), F.concat(page, x)).otherwise(F.concat(folder, x))
    target = F.transform(target, _decoded)
    return F.transform(F.filter(F.transform(F.filter(target, lambda x: (x != "") & ~x.startswith("#")), full), lambda x: x.contains("://")), _without_dots)


def _decoded(x: Column) -> Column:
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def _without_dots(url: Column) -> Column:
    """``url`` with . and .. resolved in its path, the latter at most up to the host; paths without them stay as they are."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    parts = F.split(path_of(url), "/")
    steps = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    walked = F.aggregate(steps, F.lit(""), lambda done, x: F.when(x == ".", done).when(x == "..", F.regexp_replace(done, r"/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x)))
    slash = F.when(path_of(url).rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(path_of(url).rlike(r"(^|/)\.\.?(/|$)"), F.concat(head, walked, slash, tail)).otherwise(url)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    edges: DataFrame | None = None,
    default: str = "allow",
) -> DataFrame:
    """id, host, path, rule, verdict and alias: one row for each row of ``pages``.

    A url that a rule fits gets that rule's verdict. Any other gets the verdict of
    its aliases: the urls connected with it, over any number of steps, by canonical
    links and refreshes that pages declare, by ``edges`` (src, dst: urls of redirects),
    or by the edge from each address to its canonical one, which a site redirects it
    to. Rules are judged on every address of a link, also where no page has it. An allow rule on any alias comes first, then a block rule,
    then ``default``. ``alias`` names the component by its smallest address.

    Null urls and those without :// have empty host and path, no alias and the
    default verdict, or that of a rule for the empty host. A null html declares
    nothing. Repeated rows each get their row; no rows give none. Other columns are not read. Nothing
    is broadcast, no Python runs; all sides of an address meet in plain joins and
    are reduced before they are shuffled.
    """
    url = col(url_col).cast("string")
    base = pages.select(col(id_col).alias("id"), url.alias("url"), *([col(html_col).cast("string").alias("html")] if html_col else []))
    judged = base.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), alias_key(F.col("url")).alias("key"))
    judged = judged.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    told = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")) if edges is not None else None
    if html_col:
        own = base.select(F.col("url").alias("src"), F.explode(declared_links(F.col("html"), F.col("url"))).alias("dst"))
        told = own if told is None else told.union(own)
    urls = base.select(F.col("url"))
    if told is not None:
        urls = urls.union(told.select("src")).union(told.select("dst"))
    links = urls.select(address(F.col("url")).alias("u"), alias_key(F.col("url")).alias("v"))
    if told is not None:
        links = links.union(told.select(address(F.col("src")), address(F.col("dst"))))
    every = urls.select(alias_key(F.col("url")).alias("key"), rule_for(host_of(F.col("url")), path_of(F.col("url")), rules).alias("r"))
    ruled = every.where("r is not null and key is not null").groupBy("key").agg(F.max(F.col("r.verdict") == "allow").alias("allowed"))
    named = components(links).withColumnRenamed("label", "alias")
    ruled = ruled.join(named, ruled.key == named.node, "left").groupBy(F.coalesce("alias", "key").alias("alias")).agg(F.max("allowed").alias("allowed"))
    judged = judged.join(named, judged.key == named.node, "left").withColumn("alias", F.coalesce("alias", "key"))
    ruled = ruled.withColumnRenamed("alias", "a")
    out = judged.join(ruled, F.col("alias") == F.col("a"), "left")
    verdict = F.coalesce("r.verdict", F.when(F.col("allowed"), "allow").when(~F.col("allowed"), "block"), F.lit(default))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "alias")
