"""URL filter with redirect equivalence, in DataFrame operations only.

Explicit rules (action, host, path) fit a host and its subdomains and the paths that begin with the rule's; the longest
wins. Pages that no rule fits take the decision of their aliases: URLs are the nodes of a graph whose edges are
redirects (meta refresh) and canonical links, and URLs that differ only in scheme, fragment, tracking parameters, a
leading ``www.`` or ``m.`` or a trailing slash are one node. In each connected component a URL that a rule allows
outweighs those that rules block; a component with neither is allowed. Relative targets are taken from the page's URL or
its ``<base>``, as RFC 3986 says.

Defined cases: null URLs and those without ``://`` have an empty host and path, fit no rule, have no aliases (so their
links and redirects join nothing) and are allowed; targets of other schemes than with ``://`` (``mailto:``) are none;
null HTML has no links; of rules of equal length one that allows wins; repeated pages are judged each on its own; other
columns are left out and may have any names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import connected

# The rules of the contract, as (action, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: More rules than this are joined as a table; fewer are branches of an expression, which needs no shuffle. Both judge alike.
BRANCHES = 32
#: Parts that the URLs of one much-used suffix, and its rules, are dealt to.
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (size, allow, rule, action), of equally long ones one that allows; null if none does."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(a == "allow").alias("allow"), F.lit(h + p).alias("rule"), F.lit(a).alias("action")))
        for a, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,allow:boolean,rule:string,action:string>")


def _suffixes(host: Column) -> Column:
    """The host and what follows each of its dots, as they are written."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def _directories(path: Column) -> Column:
    """The beginnings of a path that end with a slash, and the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.concat(F.slice(parts, F.lit(1), k), F.when(k > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/"))


def fitted(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, fit): for each different host and path that a rule fits, the longest as in ``fitting_rule``, of a table (action, host, path).

    A URL meets the rules of its host's suffixes and its path's directories in an equi-join, so the plan has one size for any
    number of rules; what a rule's path has after its last slash is compared after the join. URLs are dealt to SALTS parts, to each
    of which the rules are told, since one suffix may be that of most hosts.
    """
    asked = urls.select("host", "path").filter("host <> ''").distinct().withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    probes = asked.withColumn("suffix", F.explode(_suffixes(F.col("host")))).withColumn("directory", F.explode(_directories(F.col("path"))))
    table = rules.select(F.col("action"), F.col("host").alias("suffix"), F.col("path").alias("begin")).dropna().distinct()
    size, name = F.char_length("suffix") + F.char_length("begin"), F.concat("suffix", "begin")
    table = table.select("suffix", F.regexp_extract("begin", r"^(.*/)?", 0).alias("directory"), "begin", F.struct(size.alias("size"), (F.col("action") == "allow").alias("allow"), name.alias("rule"), "action").alias("fit"))
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = probes.join(table, ["suffix", "directory", "salt"]).filter(F.col("path").startswith(F.col("begin")))
    return met.groupBy("host", "path").agg(F.max("fit").alias("fit"))


def _judged(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls with a column fit."""
    if isinstance(rules, list):
        return urls.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    urls = written(urls)  # else the filters on join keys would drag the URLs' expressions along
    found = fitted(urls, rules).select(F.col("host").alias("_host"), F.col("path").alias("_path"), "fit")
    return urls.join(found, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").drop("_host", "_path")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


#: Characters of URLs that markup spells as entities.
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decoded(markup: Column) -> Column:
    """The text of an attribute: entities by name (those of _ENTITIES) and by number, up to 127, as their characters."""
    parts = F.regexp_extract_all(markup, F.lit(r"(?i)(&(?:#x[0-9a-f]{1,4}|#[0-9]{1,5}|amp|lt|gt|quot|apos);|[^&]+|&)"), F.lit(1))

    def one(t: Column) -> Column:
        code = F.when(t.rlike(r"^&#[xX]"), F.conv(F.regexp_extract(t, r"^&#[xX]([0-9a-fA-F]+)", 1), 16, 10).try_cast("int")).when(t.startswith("&#"), F.regexp_extract(t, r"^&#([0-9]+)", 1).try_cast("int"))
        named = F.create_map(*(F.lit(x) for pair in _ENTITIES.items() for x in pair))[F.lower(F.regexp_extract(t, r"^&([A-Za-z]+);", 1))]
        return F.coalesce(F.when(code.between(1, 127), F.char(code)), named, t)

    return F.when(markup.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(markup)


def alias_key(url: Column) -> Column:
    """The number of a URL's node: equal for URLs that differ in scheme, fragment, tracking or trailing slash only."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(?:utm_\w+|ref|fbclid|gclid)(?:=|$)"))), "&")
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.|:(?:80|443)$", "")
    return F.xxhash64(host, F.regexp_replace(path_of(url), "/$", ""), kept)


def links_of(html: Column) -> Column:
    """The targets of canonical links and meta refreshes of a page, entities decoded."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical")), lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh")), lambda t: F.regexp_extract(t, r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)", 1))
    return F.transform(F.filter(F.concat(canonical, refresh), lambda u: u != ""), decoded)


def base_of(html: Column) -> Column:
    """What the first ``<base>`` of a page names, entities decoded; empty without one."""
    return F.coalesce(decoded(F.regexp_extract(html, r"(?i)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)), F.lit(""))


def _without_dots(path: Column) -> Column:
    """The path less its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1).isin(".", "..")
    # the first part is the nothing before the leading slash and stays
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(last, "/").otherwise(""))


def resolved(target: Column, url: Column) -> Column:
    """The absolute URL that a reference on a page means (the page's URL must have ``://``); null for other schemes."""
    origin, path = F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1), path_of(url)
    own, tail = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target))
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(origin, _without_dots(own), tail))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .when((target == "") | target.startswith("#"), F.concat(F.regexp_extract(url, r"^([^#]*)", 1), target))
        .otherwise(F.concat(origin, _without_dots(F.concat(F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1)), own)), tail))
    )


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, aliased) of each page.

    rules: a list, or a table (action, host, path) of any size; hosts in lower case. redirects: further edges (source, target) of absolute URLs.
    """
    if isinstance(rules, list) and len(rules) > BRANCHES:
        rules = rule_table(pages.sparkSession, rules)
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.when(F.col("url").contains("://"), alias_key(F.col("url"))).alias("node"))
    seen = written(_judged(seen, rules))
    # most pages have neither tag, and are told so by one look
    tagged = pages.filter(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    links = tagged.select("url", base_of(F.col("html")).alias("base"), F.explode(links_of(F.col("html"))).alias("target"))
    links = links.withColumn("base", F.coalesce(resolved(F.col("base"), F.col("url")), F.col("url")))
    jumps = links.select("url", resolved(F.col("target"), F.col("base")).alias("target"))
    if redirects is not None:
        jumps = jumps.union(redirects.select("source", "target"))
    jumps = jumps.filter(F.col("url").contains("://") & F.col("target").contains("://"))
    jumps = jumps.select(alias_key(F.col("url")).alias("a"), alias_key(F.col("target")).alias("b"), host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path")).distinct()
    jumps = written(_judged(jumps, rules).select("a", "b", F.col("fit.action").alias("action")).distinct())
    whole = connected(jumps)
    told = seen.select("node", F.col("fit.action").alias("action")).union(jumps.select(F.col("b").alias("node"), "action")).filter("node is not null and action is not null")
    # one row a node first, so that a much-repeated URL is gathered before it is moved
    by_node = told.groupBy("node").agg(F.max(F.expr("int(action = 'allow')")).alias("allow"), F.max(F.expr("int(action = 'block')")).alias("block"))
    by_class = by_node.join(whole, "node", "left").groupBy(F.coalesce("component", "node").alias("class")).agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    verdicts = by_class.select("class", F.when(F.col("allow") == 1, F.lit("allow")).otherwise(F.lit("block")).alias("inherited"))
    open_pages = seen.filter("fit is null").join(whole, "node", "left").withColumn("class", F.coalesce("component", "node")).join(verdicts, "class", "left")
    columns = ["page_id", "host", "path", F.col("fit.rule").alias("rule")]
    return seen.filter("fit is not null").select(*columns, F.col("fit.action").alias("verdict"), F.lit(False).alias("aliased")).union(
        open_pages.select(*columns, F.coalesce("inherited", F.lit("allow")).alias("verdict"), F.col("inherited").isNotNull().alias("aliased"))
    )
