"""Robots rules, crawl frontier and discovery accounting over tables of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import depth_below, host, normalized, resolved

SKIPPED = r"(?i)\.(?:jpe?g|png|gif|svg|webp|ico|css|js|woff2?|ttf|mp4|zip|gz|exe)(?:[?#]|$)"


def robots_rules(files: DataFrame) -> DataFrame:
    """host, kind, path of robots.txt texts (host, text): rules below a 'User-agent: *' line; empty ones are ignored."""
    line = F.posexplode(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))).alias("n", "line")
    rows = files.select("host", line).withColumn("agent", F.when(F.lower("line").startswith("user-agent:"), F.trim(F.regexp_replace("line", "^[^:]*:", ""))))
    so_far = Window.partitionBy("host").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("agent", F.last("agent", ignorenulls=True).over(so_far)).filter("agent = '*'")
    kind = F.lower(F.regexp_extract("line", r"(?i)^(allow|disallow)\s*:", 1))
    return rows.select("host", kind.alias("kind"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("path")).filter("kind <> '' and path <> ''").distinct()


def robots_allowed(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str = "url") -> DataFrame:
    """id_col, allowed: the longest rule that the path starts with decides; ties and no rule allow.

    Every beginning of the path that is as long as some rule of that length is looked up by (host, path), so a host's rules
    never meet all its addresses.
    """
    path = F.coalesce(F.try_parse_url(F.col(url_col), F.lit("PATH")), F.lit("/"))
    rows = urls.select(id_col, host(F.col(url_col)).alias("host"), F.when(path == "", "/").otherwise(path).alias("_path"))
    lengths = [r[0] for r in rules.filter("path <> ''").select(F.length("path")).distinct().collect()]
    begins = F.filter(F.transform(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: F.when(F.length("_path") >= n, F.substring("_path", F.lit(1), n))), lambda p: p.isNotNull())
    hit = rows.select(id_col, "host", F.explode(begins).alias("path")).join(rules.select("host", "kind", "path"), ["host", "path"])
    longest = lambda k: F.max(F.when(F.col("kind") == k, F.length("path")))
    best = hit.groupBy(id_col).agg(longest("allow").alias("_a"), longest("disallow").alias("_d"))
    ok = F.coalesce(F.col("_a"), F.lit(0)) >= F.coalesce(F.col("_d"), F.lit(0))
    return rows.select(id_col).join(best, id_col, "left").select(id_col, ok.alias("allowed"))


def in_scope(url: Column, root: Column, max_depth: int, include: str | None = None, exclude: str | None = None) -> Column:
    d = depth_below(url, root)
    ok = (d >= 0) & (d <= max_depth) & ~url.rlike(SKIPPED)
    ok = ok & url.rlike(include) if include else ok
    return ok & ~url.rlike(exclude) if exclude else ok


def frontier(seeds: DataFrame, edges: DataFrame, rounds: int | None, checkpoint: Callable[[DataFrame], DataFrame], admitted: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """url, depth: pages reached from the seeds (url) over edges (src, dst), at their least number of steps.

    It ends with the first round that adds no page, or after `rounds` steps if that isn't None. admitted(url, seed) says
    whether a crawl from the seed takes the page, and is asked of seeds too; a crawl goes on from its seed's links in any
    case. A round joins only the last round's new pages and drops those known by an anti-join; checkpoint(df) writes
    each round, so the plan doesn't grow with depth.
    """
    ok = admitted or (lambda url, seed: F.lit(True))
    # with no condition that depends on the seed, all seeds are one crawl
    starts = seeds.filter("url is not null").select("url", (F.col("url") if admitted else F.lit("")).alias("seed")).distinct()
    new = checkpoint(starts.withColumn("depth", F.lit(0)))
    known = checkpoint(new.filter(ok(F.col("url"), F.col("seed"))))
    depth = 0
    while rounds is None or depth < rounds:
        depth += 1
        step = new.join(edges, new["url"] == edges["src"]).select(F.col("dst").alias("url"), "seed").distinct()
        step = step.filter(ok(F.col("url"), F.col("seed"))).join(known, ["url", "seed"], "left_anti")
        new = checkpoint(step.withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        known = checkpoint(known.unionByName(new))
    return known.groupBy("url").agg(F.min("depth").alias("depth"))


def link_edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """src, dst: absolute normalised links between pages (page_id, url) of links (id, href)."""
    base = pages.select(F.col("page_id").alias("id"), F.col("url").alias("base"))
    rows = links.join(base, "id").select(normalized(F.col("base")).alias("src"), normalized(resolved(F.col("href"), F.col("base"))).alias("dst"))
    return rows.filter("dst is not null").distinct()


def accounted(rows: DataFrame, group: list[str], outcome: str) -> DataFrame:
    """seen and the number of each outcome per group; balanced says whether they add up."""
    kinds = ("new", "known", "rejected", "error")
    n = [F.count_if(F.col(outcome) == k).alias(f"n_{k}") for k in kinds]
    out = rows.groupBy(*group).agg(F.count("*").alias("seen"), *n)
    return out.withColumn("balanced", F.col("seen") == sum((F.col(f"n_{k}") for k in kinds), F.lit(0)))


def unknown(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet, one of each key."""
    return rows.dropDuplicates([key]).join(known.select(key), key, "left_anti")
