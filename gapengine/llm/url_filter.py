"""URL filters: longest-rule verdicts, and block decisions that redirects and canonical links carry to aliases.

DataFrame functions only. URLs that redirect or link canonically to each other form connected components. A URL that a rule fits keeps
the rule's verdict; one without is judged by its component: allow if any of its URLs is allowed by a rule, else block if any is blocked, else the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapengine.llm.graph import components

#: (host, path, verdict), for the host and all its subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?i)<(?:link|meta)\s[^>]*>"
#: The address in a refresh's content, bare or in quotes of its own.
REFRESH = r"""(?i)url\s*=\s*["']?\s*([^"'\s]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL without scheme and fragment. Null if there is no host."""
    rest = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def undotted(path: Column) -> Column:
    """A path, which begins with a slash, without its . and .. segments."""
    steps = F.split(F.regexp_replace(path, r"/\.\.?$", "$0/"), "/")
    kept = F.aggregate(F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(target: Column, base: Column) -> Column:
    """The node that a link on the page base leads to: absolute, with the host (//), from the root (/), by the query (?) or from the page's folder. Null for other schemes and without a host."""
    plain = F.regexp_extract(target, "^([^#]*)", 1)
    path, query = F.regexp_extract(plain, r"^([^?]*)", 1), F.regexp_extract(plain, r"(\?.*)$", 1)
    folder = F.regexp_extract(path_of(base), "^(.*/)", 1)
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    local = F.when(path == "", F.concat(path_of(base), query)).otherwise(F.concat(undotted(rooted), query))
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), node_of(target)).when(target.startswith("//"), node_of(F.concat(F.lit("x:"), target)))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (plain == "") | (host_of(base) == ""), F.lit(None)).otherwise(F.concat(host_of(base), local))
    )


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; empty if it has none."""
    pattern = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.regexp_replace(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]), r"^\s+|\s+$", "")


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """df, which has host and path, with rule and rule_verdict of the longest rule that fits (of equals, the one that comes first in code-point order); null where none does."""
    fits = []
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        where = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        fits.append((where, host + path, verdict))
    pick = lambda k: F.coalesce(*[F.when(f[0], F.lit(f[k])) for f in fits]) if fits else F.lit(None).cast("string")
    return df.withColumn("rule", pick(1)).withColumn("rule_verdict", pick(2))


def links(pages: DataFrame) -> DataFrame:
    """(a, b): a page's node and those of what its canonical links and refreshes name."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("url").cast("string")
    tags = pages.where(F.lower(html).rlike("canonical|http-equiv")).select(url.alias("url"), F.explode(F.regexp_extract_all(html, F.lit(TAG), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    canonical = F.lower(tag).startswith("<link") & F.lower(attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)")
    refresh = F.lower(tag).startswith("<meta") & (F.lower(attribute(tag, "http-equiv")) == "refresh")
    found = tags.where(F.lower(tag).rlike("canonical|refresh")).select("url", F.when(canonical, attribute(tag, "href")).when(refresh, F.regexp_extract(attribute(tag, "content"), REFRESH, 1)).alias("target")).where("target <> ''")
    return found.select(node_of(F.col("url")).alias("a"), resolved(F.col("target"), F.col("url")).alias("b")).where("a is not null and b is not null and a <> b")


def judged(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages(page_id, url, html).

    redirects(source, target), if given, adds edges between URLs. Null URLs and those without :// have an empty host and path and no rule;
    null html has no links; repeated rows all stay; an empty table gives no rows. Other columns are ignored. Only rows with a URL that no rule fits are looked up among the aliases.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"), node_of(F.col("url").cast("string")).alias("node"))
    own = ruled(own, rules)
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b"))
    roots = components(edges)
    nodes = ruled(roots.withColumn("url", F.concat(F.lit("x://"), F.col("v"))).select("v", "root", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    groups = nodes.groupBy("root").agg(F.bool_or(F.col("rule_verdict") == "allow").alias("allowed"), F.bool_or(F.col("rule_verdict") == "block").alias("blocked"))
    carried = nodes.where("rule is null").join(groups, "root").select(F.col("v").alias("node"), F.when(F.col("allowed"), F.lit("allow")).when(F.col("blocked"), F.lit("block")).alias("alias_verdict")).where("alias_verdict is not null")
    open_rows = F.col("rule").isNull() & F.col("node").isNotNull()  # rows without a node would all meet in one task
    looked_up = own.where(open_rows).join(carried, "node", "left")
    return looked_up.unionByName(own.where(~open_rows).withColumn("alias_verdict", F.lit(None).cast("string"))).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit(default)).alias("verdict"))
