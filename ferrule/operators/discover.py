"""Discovery with a budget: sitemaps inside sitemaps, and category pages read on from a cursor.

Both spend their budget in order: the n-th useful address of a site is the same however the work is spread, since places are counted by
windows over a site's maps, which the limit of maps bounds, or over a category page, which its size bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host, in_domain, normalized, path_parts, resolved
from ..sources.versions import Versions
from .crawl import robots_allowed

#: How many maps of a site are read, and how many pages a category has before it begins again.
MOST_MAPS = 60
LAST_PAGE = 40
LOC = r"(?is)<loc[^>]*>\s*([^<]+?)\s*</loc>"
MAP = r"(?i)\.xml(?:\.gz)?(?:$|\?)"
PDF = r"(?i)\.pdf(?:$|\?)"
NO_PAGE = r"(?i)\.(?:jpg|jpeg|png|gif|webp|svg|ico|mp4|webm|mov|avi|zip|rar|7z|tar|gz|css|js|mjs|woff2?|ttf|otf|eot)$"


def map_entries(files: DataFrame) -> DataFrame:
    """map, n, kind (map or url), loc of sitemap files (url, status, text); files with another status than 200 have none.

    An entry that comes twice in a file counts where it comes first. Maps may be given by a path alone, pages by a whole address only.
    """
    locs = F.filter(F.regexp_extract_all(F.when(F.col("status") == 200, F.col("text")), F.lit(LOC), F.lit(1)), lambda x: x != "")
    rows = files.select(F.col("url").alias("map"), F.posexplode(F.array_distinct(locs)).alias("n", "_loc"))
    kind = F.when(F.col("_loc").rlike(MAP), "map").otherwise("url")
    loc = normalized(F.when(kind == "map", resolved(F.col("_loc"), F.col("map"))).otherwise(F.col("_loc")))
    return rows.select("map", "n", kind.alias("kind"), loc.alias("loc")).filter("loc is not null")


def maps_in_order(sites: DataFrame, entries: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], most: int = MOST_MAPS) -> DataFrame:
    """site, map, place: the maps of each site (site, start) in the order in which a queue would read them, up to `most`.

    A map is read once, where it comes first. A round reads the maps that the last round's list, each after its parent and in its order;
    it ends when no map is new. Maps that don't exist count as read.
    """
    children = entries.filter("kind = 'map'").select(F.col("map").alias("_parent"), "n", F.col("loc").alias("map"))
    new = checkpoint(sites.select("site", F.col("start").alias("map"), F.lit(0).cast("long").alias("place")).distinct())
    known = new
    while True:
        listed = new.select("site", "place", F.col("map").alias("_parent")).join(children, "_parent").groupBy("site", "map").agg(F.min(F.struct("place", "n")).alias("_from"))
        listed = listed.join(known, ["site", "map"], "left_anti")
        before = known.groupBy("site").agg(F.count("*").alias("_before"))
        order = Window.partitionBy("site").orderBy("_from", "map")
        placed = listed.withColumn("_n", F.row_number().over(order)).join(before, "site").select("site", "map", (F.col("_before") + F.col("_n") - 1).alias("place"))
        new = checkpoint(placed.filter(F.col("place") < most))
        if new.isEmpty():
            return known
        known = checkpoint(known.unionByName(new))


def site_urls(sites: DataFrame, files: DataFrame, rules: DataFrame, limit: int, max_depth: int, checkpoint: Callable[[DataFrame], DataFrame], most_maps: int = MOST_MAPS) -> tuple[DataFrame, DataFrame]:
    """What the sitemaps of sites (site, root, start) give: (site, place, url) and the maps read (site, place, map, found).

    An address is useful if it is in the site or below it, no skipped type, allowed by robots (rules: host, kind, path) and a PDF or at most
    max_depth path parts below the root. Only useful ones count against the limit, copies too; the maps are read in order until it is reached.
    """
    entries = checkpoint(map_entries(files))
    maps = maps_in_order(sites, entries, checkpoint, most_maps)
    pages = maps.join(entries.filter("kind = 'url'"), "map").join(sites.select("site", "root"), "site")
    url, root = F.col("loc"), F.col("root")
    parts, above = path_parts(url), path_parts(root)
    below = F.when(F.slice(parts, 1, F.size(above)) == above, F.size(parts) - F.size(above)).otherwise(-1)
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    useful = in_domain(host(url), host(root)) & ~path.rlike(NO_PAGE) & (path.rlike(PDF) | below.between(0, max_depth))
    allowed = robots_allowed(pages.select("loc").distinct(), rules, "loc", "loc").filter("allowed").select("loc")
    pages = checkpoint(pages.filter(useful).join(allowed, "loc", "left_semi"))
    counts = maps.join(pages.groupBy("site", "map").agg(F.count("*").alias("found")), ["site", "map"], "left").fillna(0, ["found"])
    before = F.sum("found").over(Window.partitionBy("site").orderBy("place")) - F.col("found")
    read = checkpoint(counts.withColumn("_before", before).filter(F.col("_before") < limit))
    in_map = Window.partitionBy("site", "map").orderBy("n")
    spent = pages.join(read.select("site", "map", "_before"), ["site", "map"]).withColumn("_at", F.col("_before") + F.row_number().over(in_map) - 1).filter(F.col("_at") < limit)
    urls = spent.groupBy("site", F.col("loc").alias("url")).agg(F.min("_at").alias("place"))
    return urls.select("site", "place", "url"), read.select("site", "place", "map", "found")


def page_outcomes(items: DataFrame, target: int, known: Column, failed: Column, valid: Column) -> DataFrame:
    """items (source, page, n, ...) with outcome: known, error, rejected or new, in order, until `target` are new; budget from there on.

    Looking an item up comes before reading its page: a known one is never an error. The window is one category page.
    """
    what = F.when(known, "known").when(failed, "error").when(~F.coalesce(valid, F.lit(False)), "rejected").otherwise("new")
    rows = items.withColumn("outcome", what)
    so_far = Window.partitionBy("source", "page").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.count_if(F.col("outcome") == "new").over(so_far), F.lit(0)) >= target
    return rows.withColumn("outcome", F.when(done, "budget").otherwise(F.col("outcome")))


def page_accounts(outcomes: DataFrame) -> DataFrame:
    """source, page, seen, a count of each outcome, and whether they add up."""
    kinds = ("new", "known", "rejected", "error", "budget")
    out = outcomes.groupBy("source", "page").agg(F.count("*").alias("seen"), *(F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in kinds))
    return out.withColumn("balanced", F.col("seen") == sum((F.col(f"n_{k}") for k in kinds), F.lit(0)))


class Cursors:
    """The page that each source is at and what is known of it, from run to run: a version in a shared folder for every run.

    A run reads the newest version and adds the next; a run that died before that is done again from the same page, and of two runs at a
    time one is refused. A source whose accounts don't balance keeps its page.
    """

    def __init__(self, versions: Versions, sources: DataFrame):
        self.versions, self.sources, self.spark = versions, sources, sources.sparkSession

    def state(self) -> tuple[DataFrame, DataFrame, int]:
        """(source, page), (source, key) of what is known, and the newest version's number."""
        versions = self.versions.all()
        if not versions:
            return self.sources.select("source", F.lit(1).alias("page")), self.sources.select("source", F.lit(None).cast("string").alias("key")).limit(0), 0
        return self.spark.read.parquet(versions[-1]["pages"]), self.spark.read.parquet(*(v["found"] for v in versions)), len(versions)

    def run(self, items: DataFrame, known: DataFrame, target: int, failed: Column, valid: Column) -> DataFrame:
        """The accounts of one page of every source. items: source, page, n, key, ...; known: (source, key) besides what was found before."""
        pages, found, number = self.state()
        both = known.select("source", "key").unionByName(found).distinct().withColumn("_known", F.lit(True))
        here = items.join(pages, ["source", "page"]).join(both, ["source", "key"], "left")
        outcomes = page_outcomes(here, target, F.col("_known").isNotNull(), failed, valid)
        folder = f"{self.versions.folder}/run-{number + 1}-{self.spark.sparkContext.applicationId}"
        outcomes.select("source", "page", "n", "key", "outcome").write.mode("overwrite").parquet(f"{folder}/outcomes")
        outcomes = self.spark.read.parquet(f"{folder}/outcomes")
        outcomes.filter("outcome = 'new'").select("source", "key").write.mode("overwrite").parquet(f"{folder}/found")
        accounts = pages.join(page_accounts(outcomes), ["source", "page"], "left").fillna(0).fillna(True, ["balanced"])
        following = F.when(~F.col("balanced"), F.col("page")).when(F.col("page") >= LAST_PAGE, 1).otherwise(F.col("page") + 1)
        accounts.withColumn("next_page", following).write.mode("overwrite").parquet(f"{folder}/accounts")
        accounts = self.spark.read.parquet(f"{folder}/accounts")
        accounts.select("source", F.col("next_page").alias("page")).write.mode("overwrite").parquet(f"{folder}/pages")
        if not self.versions.add(number + 1, {"pages": f"{folder}/pages", "found": f"{folder}/found", "accounts": f"{folder}/accounts"}):
            raise RuntimeError("another run was faster; its page is done, begin again")
        return accounts
