"""URL filtering with redirect equivalence: decisions on a URL reach the other URLs of its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, saved, spread_join
from tickloom.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name where a visitor came from, not what page is shown.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The URL under which a page's variants meet: https, host in lower case, no www. or m., no fragment, tracking parameter, .html or final slash."""
    bare = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(bare, f"([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+", "$1")
    bare = F.regexp_replace(bare, "[?&]$", "")
    bare = F.regexp_replace(bare, "^(?i:https?)://(?i:www\\.|m\\.)?", "https://")
    bare = F.regexp_replace(bare, "(?:/index)?(?:\\.html?)?/?(\\?|$)", "$1")
    site = F.regexp_extract(bare, "(?s)^.*?://[^/?#]*", 0)
    return F.concat(F.translate(site, UPPER, LOWER), F.substring(bare, F.length(site) + 1, F.length(bare)))


def absolute(target: Column, base: Column) -> Column:
    """A link's target as a URL, resolved against its page's; empty for one of another kind, such as mailto:."""
    site, tail = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(target, "(?s)([?#].*)$", 1)
    own, given = path(base), F.regexp_extract(target, "(?s)^([^?#]*)", 1)
    full = F.when(given.startswith("/"), given).otherwise(F.concat(F.regexp_extract(own, "(?s)^(.*/)", 1), given))
    full = F.concat(full, F.when(full.rlike("(^|/)[.][.]?$"), "/").otherwise(""))  # a final dot is a folder

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x == ".", done).when(x == "..", up).otherwise(F.concat(done, F.array(x)))

    steps = F.aggregate(F.split(F.regexp_replace(full, "^/", ""), "/"), F.array().cast("array<string>"), step)
    query = F.regexp_extract(base, "(?s)^[^?#]*([?][^#]*)", 1)
    same = F.concat(site, own, F.when(target.startswith("?"), "").otherwise(query), tail)
    found = F.when(target.rlike("^(?i:[a-z]+)://"), target).when(target.startswith("//"), F.concat(F.regexp_extract(base, "(?s)^(.*?:)//", 1), target))
    found = found.when((target == "") | target.rlike("^(?i:[a-z][a-z0-9+.-]*):"), "").when(given == "", same)
    return found.otherwise(F.concat(site, F.lit("/"), F.array_join(steps, "/"), tail))


def with_canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b), with one more from each end that is a URL to its canonical form."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("a")).where(F.col("a").contains("://"))
    return edges.select("a", "b").unionByName(ends.select("a", canonical(F.col("a")).alias("b"))).where("b <> '' and a <> b").distinct()


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b) from pages (url, html): each URL with its canonical form, its canonical link and the target of its refresh, and these with theirs."""
    u, html = F.col("url"), F.col("html")
    link = F.regexp_extract(F.regexp_extract(html, "(?is)<link\\b[^>]*\\brel=[\"']?canonical\\b[^>]*>", 0), "(?is)\\bhref=[\"']?([^\"'\\s>]+)", 1)
    refresh = F.regexp_extract(F.regexp_extract(html, "(?is)<meta\\b[^>]*\\bhttp-equiv=[\"']?refresh\\b[^>]*>", 0), "(?is)\\burl=[\"']?([^\"'\\s>]+)", 1)
    return with_canonical(pages.where(u.contains("://")).select(u.alias("a"), F.explode(F.array(u, absolute(link, u), absolute(refresh, u))).alias("b")).where("b <> ''"))


def matched(urls: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds host, path, rule and action to distinct urls (url): the longest rule (host, path, action) that fits, allow first among equals.

    A rule fits its host and all subdomains where the path starts with the rule's. Each
    URL meets only the rules of its own host suffixes, and a suffix that many URLs have,
    such as com, is cut into pieces.
    """
    at = urls.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action", F.concat("host", "path").alias("rule"))
    own = at.where("host <> ''").select("url", "path", F.explode(suffixes).alias("rule_host"))
    held = own.join(r.select("rule_host").distinct(), "rule_host", "left_semi").groupBy("rule_host").agg(F.count("*").alias("n"))
    each = spread_join(own, scratch.saved(r.join(held, "rule_host"), "rules"), "rule_host", "n", urls.count()).where(F.expr("startswith(path, rule_path)"))
    best = each.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allows"), "rule", "action")).alias("best"))
    return at.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def url_verdicts(urls: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path, rule, verdict) for each distinct URL of urls (url) and of edges (a, b), which tell URLs of one page.

    A URL's own rule decides it. One without a rule is blocked if a rule blocks any URL of
    its component, else allowed: a block passes through redirects and canonical links,
    also across an alias that is allowed, but never overrides an explicit allow. Null
    URLs and ends are left out, repeated ones count once; empty tables give no rows.
    """
    with Scratch(urls.sparkSession) as scratch:
        nodes = urls.select("url").unionByName(edges.select(F.explode(F.array("a", "b")).alias("url"))).where("url is not null").distinct()
        nodes = scratch.saved(nodes, "nodes")
        known = scratch.saved(matched(nodes, rules, scratch), "urls")
        of = connected_components(edges, scratch).withColumnRenamed("node", "url")
        blocked = known.where("action = 'block'").join(of, "url").select("component").distinct()
        held = of.groupBy("component").agg(F.count("*").alias("n")).join(blocked, "component")
        hit = spread_join(of, held, "component", "n", of.count()).select("url", F.lit(True).alias("hit"))
        decided = known.join(hit, "url", "left")
        return saved(decided.select("url", "host", "path", "rule", F.when(F.col("action").isNotNull(), F.col("action")).when(F.col("hit"), "block").otherwise("allow").alias("verdict")), "verdicts")


def judge_pages(pages: DataFrame, rules: DataFrame, more_edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url, html); more_edges (a, b) adds known redirects to what they tell.

    A null URL, and one without ://, has empty host and path and is allowed; a null page
    tells no edges; repeated rows are judged alike, each in a row of its own; an empty
    table gives no rows; other columns are not read. A page of any length is searched
    whole by expressions. Rows of one URL, however many, are joined in pieces.
    """
    edges = page_edges(pages)
    if more_edges is not None:
        edges = edges.unionByName(with_canonical(more_edges)).distinct()
    with Scratch(pages.sparkSession) as scratch:
        found = url_verdicts(pages.select("url"), scratch.saved(edges, "edges"), rules)
    rows = pages.select("page_id", "url")
    held = rows.where("url is not null").groupBy("url").agg(F.count("*").alias("n"))
    out = spread_join(rows.where("url is not null"), found.join(held, "url"), "url", "n", rows.count())
    blank = rows.where("url is null").select("page_id", F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return out.select("page_id", "host", "path", "rule", "verdict").unionByName(blank)
