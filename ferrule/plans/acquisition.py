"""Queries over what acquisition does with documents: which of them hold which numbers, each beside its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.urls import host
from ..operators import classify, containment, crawl, discover, discovery, extract
from ..operators.cache import Cache
from ..operators.claims import Claims
from ..sources.shared import checkpointed, shared_folder
from ..sources.tables import parts, table
from ..sources.versions import Versions
from .oracle import HOST, PATH

PARTS = "p as (select p_partkey as part_id, p_brand || '-' || p_partkey as part_number, p_brand as manufacturer, p_type as category, p_name as description from part)"
KEY = "upper(regexp_replace({0}, '[\\s\\-/_.]', '', 'g'))"
#: How a line of an order writes its part's number.
WRITTEN = "case l_linenumber % 4 when 0 then p_brand || '-' || p_partkey when 1 then lower(p_brand) || ' ' || p_partkey when 2 then p_brand || '.' || p_partkey || '/' else 'x' || p_brand || '_' || p_partkey end"


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: documents, with the part numbers of the order of that number behind them."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    lines = table(spark, sf_dir, "lineitem").join(ids, F.col("l_orderkey") == F.col("doc_id"), "left_semi")
    lines = lines.join(table(spark, sf_dir, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.expr(WRITTEN).alias("written"))
    notes = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "written"))), lambda x: x["written"]), ", ").alias("note"))
    return table(spark, sf_dir, "documents").join(notes, "doc_id", "left").select("doc_id", F.concat_ws(" ", "text", "note").alias("text"))


NOTED = (
    f"note as (select l_orderkey as doc_id, string_agg({WRITTEN}, ', ' order by l_linenumber, {WRITTEN}) as note from lineitem join part on l_partkey = p_partkey group by 1), "
    "noted as (select doc_id, concat_ws(' ', text, note) as text from documents left join note using (doc_id))"
)


def numbers_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _noted(spark, sf_dir).select("doc_id", t.part_key(F.col("text")).alias("text"))
    return containment.held(docs, parts(spark, sf_dir), checkpointed, "doc_id", "text", "part_id", "part_key")


def makers_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers whose bare name stands in a document, with the least part of each."""
    docs = _noted(spark, sf_dir).select("doc_id", t.alnum_key(F.col("text")).alias("text"))
    makers = parts(spark, sf_dir).groupBy("manufacturer").agg(F.min("part_id").alias("first_part")).withColumn("bare", t.alnum_key(F.col("manufacturer")))
    found = containment.held(docs, makers, checkpointed, "doc_id", "text", "manufacturer", "bare")
    return found.join(makers.select("manufacturer", "first_part"), "manufacturer").select("doc_id", "manufacturer", "first_part")


NOUN_TERMS = [("fasteners", "bolt", "include", 40), ("seals", "ring", "include", 40), ("motion", "gear", "include", 40), ("motion", "wheel", "include", 30), ("seals", "red", "exclude", 0), ("goods", "widget", "include", 40), ("goods", "small widget", "include", 20)]
NOUN_AREAS = [("fasteners", 0, 35), ("seals", 1, 35), ("motion", 2, 35), ("goods", 3, 35)]


def _by_noun(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    terms = spark.createDataFrame(NOUN_TERMS, "area string, term string, kind string, weight int")
    areas = spark.createDataFrame(NOUN_AREAS, "area string, rule_index int, min_score int")

    def run(rows: DataFrame) -> DataFrame:
        scored = classify.scores(classify.occurrences(rows, terms, "part_id", "description"))
        return classify.decided(rows, scored, areas, "part_id").select(F.col("id").alias("part_id"), "area", "status")

    return run


def _cached_runs(spark: SparkSession, sf_dir: str, runs: int = 4) -> list[tuple[DataFrame, dict[str, int]]]:
    """The classes of all parts after three of four were classified before: by the same rules, again, and by a new version."""
    rows = parts(spark, sf_dir).select("part_id", "description", "manufacturer")
    fingerprint, folder, out = classify.fingerprint([F.col("description"), F.col("manufacturer")]), shared_folder(spark, "classes"), []
    for version, some in (("v1", rows.filter("part_id % 4 <> 0")), ("v1", rows), ("v1", rows), ("v2", rows))[:runs]:
        cache = Cache(spark, folder, version, "area string, status string")
        done = checkpointed(cache.classified(some, fingerprint, "part_id", _by_noun(spark), checkpointed))
        out.append((done, cache.metrics(done, "area", "status", 500)))
    return out


def cached_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached_runs(spark, sf_dir, 2)[1][0].select("part_id", "area", "status", "cache_hit")


def cache_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = [{"run": i, **m} for i, (_, m) in enumerate(_cached_runs(spark, sf_dir), 1)]
    return spark.createDataFrame(runs, ", ".join(f"{c} long" for c in runs[0]))


WORKERS = (("first", 8), ("second", 8), ("third", 1))


def queue_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three workers get of the queue, the first of them run twice."""
    queue = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "done").otherwise("queued").alias("status"), (F.col("user_id") % 5).alias("priority"), F.col("ts").alias("created"))
    claims, out = Claims(spark, shared_folder(spark, "queue")), None
    for worker, most in (*WORKERS, WORKERS[0]):
        got = claims.claim(queue, worker, most, [F.desc("priority"), F.asc("created")]).select(F.col("id").alias("event_id"), F.lit(worker).alias("worker"))
        out = got if out is None else out.unionByName(got)
    return out


SITE_ROBOTS = [("disallow", "/en/7"), ("allow", "/en/77"), ("disallow", "/files/de")]
BUDGETS = (1, 3, 1000)


def _site_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """sites, and their sitemap files: an index with a map that is gone, itself and one map a language; these list two maps each and a PDF; those list pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("site"), F.try_parse_url("url", F.lit("PATH")).alias("path")).filter("site <> ''")
    pages = pages.withColumn("lang", F.get(F.split("path", "/"), 1)).withColumn("base", F.concat(F.lit("https://"), "site")).withColumn("half", (F.col("page_id") % 2).cast("string"))
    loc = lambda c: F.concat(F.lit("<url><loc> "), c, F.lit(" </loc></url>"))
    listed = lambda key, what: F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(key.alias("k"), what.alias("x")))), lambda s: loc(s["x"])), "\n")
    ok = F.lit(200).alias("status")
    index = pages.groupBy("site", "base").agg(listed(F.col("lang"), F.concat(F.lit("/s-"), "lang", F.lit(".xml"))).alias("t"))
    index = index.select(F.concat("base", F.lit("/sitemap.xml")).alias("url"), ok, F.concat(F.lit("<sitemapindex>"), loc(F.lit("/gone.xml")), loc(F.concat("base", F.lit("/sitemap.xml"))), "t", F.lit("</sitemapindex>")).alias("text"))
    langs = pages.groupBy("base", "lang").agg(listed(F.col("half"), F.concat("base", F.lit("/s-"), "lang", F.lit("-"), "half", F.lit(".xml"))).alias("t"))
    langs = langs.select(F.concat("base", F.lit("/s-"), "lang", F.lit(".xml")).alias("url"), ok, F.concat("t", loc(F.concat("base", F.lit("/files/"), "lang", F.lit(".pdf")))).alias("text"))
    leaves = pages.groupBy("base", "lang", "half").agg(listed(F.col("page_id"), F.concat("base", "path")).alias("text"))
    leaves = leaves.select(F.concat("base", F.lit("/s-"), "lang", F.lit("-"), "half", F.lit(".xml")).alias("url"), F.when((F.col("lang") == "de") & (F.col("half") == "1"), 500).otherwise(200).alias("status"), "text")
    sites = pages.select("site", F.concat("base", F.lit("/en")).alias("root"), F.concat("base", F.lit("/sitemap.xml")).alias("start")).distinct()
    return sites, index.unionByName(langs).unionByName(leaves)


def _site_urls(spark: SparkSession, sf_dir: str) -> list[tuple[int, DataFrame, DataFrame]]:
    sites, files = _site_files(spark, sf_dir)
    rules = sites.select(F.col("site").alias("host")).crossJoin(F.broadcast(spark.createDataFrame(SITE_ROBOTS, "kind string, path string")))
    return [(n, *discover.site_urls(sites, files, rules, n, 1, checkpointed)) for n in BUDGETS]


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [urls.withColumn("budget", F.lit(n)) for n, urls, _ in _site_urls(spark, sf_dir)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def sitemap_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [maps.withColumn("budget", F.lit(n)) for n, _, maps in _site_urls(spark, sf_dir)]
    return out[0].unionByName(out[1]).unionByName(out[2])


#: Pages as five sites, each a tree in which page k links to 2k + 1 and 2k + 2, to itself, to another site and to a picture; every ninth page lies too deep.
SITE_PATH = "case when {0} % 9 = 8 then '/c/x/y/z/w/v/' else '/c/' end || {0}"
SITE_RULES = [("disallow", "/c/2"), ("allow", "/c/21"), ("disallow", "/c/x/y/z/w/v/1")]


def site_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of five sites that a crawl reaches from their first pages, with the least number of steps."""
    path = lambda k: F.expr(SITE_PATH.format(k))
    p = table(spark, sf_dir, "pages").select("page_id", "html", F.expr("page_id div 5").alias("k"), F.concat(F.lit("https://s"), (F.col("page_id") % 5).cast("string"), F.lit(".example")).alias("site"))
    anchors = [F.concat(F.lit('<a href="'), link, F.lit('">x</a>')) for link in (path("(2 * k + 1)"), F.concat("site", path("(2 * k + 2)")), path("k"), F.concat(F.lit("https://other.example"), path("(k + 1)")), F.lit("/c/a.png"))]
    pages = p.select("page_id", F.concat("site", path("k")).alias("url"), F.concat(*anchors).alias("html"), "site")
    edges = checkpointed(crawl.link_edges(pages, extract.links(pages, "page_id")).join(pages.select(F.col("url").alias("dst")), "dst", "left_semi"))
    seeds = pages.filter("page_id < 5").select("url")
    rules = pages.select(host(F.col("site")).alias("host")).distinct().crossJoin(F.broadcast(spark.createDataFrame(SITE_RULES, "kind string, path string")))
    allowed = crawl.robots_allowed(pages.select("url"), rules, "url").filter("allowed")
    edges = checkpointed(edges.join(allowed.select(F.col("url").alias("dst")), "dst", "left_semi"))
    root = lambda seed: F.concat(F.regexp_extract(seed, "^(https://[^/]+)", 1), F.lit("/c"))
    out = crawl.frontier(seeds, edges, None, checkpointed, lambda url, seed: crawl.in_scope(url, root(seed), 5))
    return out.select("url", F.col("depth").cast("long").alias("depth"))


GENERIC = ["sensor", "valve", "the", "drive"]
ASKED = "case p_partkey % 9 when 0 then 'Festo' when 1 then p_brand when 2 then ' AB-12' || p_size when 3 then 'Sensor' when 4 then 'Festo valve' when 5 then 'festo-SMC' when 6 then 'Wago' || p_size when 7 then '' else 'the_Wago' end || case p_size % 4 when 0 then ' ' when 1 then '-x' when 2 then '7/8' else '' end"
RESULT = {
    "title": "case p_partkey % 9 when 0 then 'About us' when 1 then 'DSNU series cylinder' when 2 then 'Careers' when 3 then p_name when 4 then 'Product  overview' when 5 then null when 6 then 'AB-1' || p_size when 7 then 'Serieses and families' else 'Website: home' end",
    "snippet": "case p_size % 7 when 0 then 'a range of valves' when 1 then 'employee count' when 2 then 'order number ' || p_partkey when 3 then '' when 4 then 'ranges' when 5 then 'products & components' else 'nothing' end",
    "url": "case (p_partkey + p_size) % 5 when 0 then 'https://x.example/investors' when 1 then 'https://x.example/catalogue' when 2 then 'https://x.example/p/ab-12' when 3 then '' else 'https://x.example/a' end",
}


def maker_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.expr(ASKED)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), discovery.is_maker_query(asked, GENERIC).alias("maker_only"), F.array_join(F.array_sort(discovery.brand_tokens(asked, GENERIC)), ",").alias("names"))


def result_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.expr(RESULT[c]) for c in ("title", "snippet", "url")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), discovery.is_product_result(*fields).alias("is_product"), discovery.is_catalogue(*fields).alias("is_catalogue"))


RUNS, TARGET = 4, 3


def category_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts of four runs over the category pages of every type of part; a page begins with the last five items of the page before."""
    p = table(spark, sf_dir, "part")
    # the n-th part of a type, counted by ranges of keys rather than in one window a type
    rows = p.withColumn("_block", F.floor(F.col("p_partkey") / 1000))
    counts = rows.groupBy("p_type", "_block").agg(F.count("*").alias("_c"))
    before = counts.select("p_type", "_block", (F.sum("_c").over(Window.partitionBy("p_type").orderBy("_block")) - F.col("_c")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("p_type", "_block").orderBy("p_partkey")) - 1
    rows = rows.withColumn("_at", at).join(before, ["p_type", "_block"]).withColumn("i", F.col("_at") + F.col("_before"))
    page = F.floor(F.col("i") / 20).cast("int") + 1
    both = F.array(F.struct(page.alias("page"), (F.col("i") % 20).alias("n")), F.struct((page - 1).alias("page"), (F.col("i") % 20 + 20).alias("n")))
    items = rows.select(F.col("p_type").alias("source"), F.col("p_partkey").cast("string").alias("key"), "p_size", "p_partkey", F.explode(both).alias("x")).select("source", "key", "p_size", "p_partkey", "x.page", "x.n").filter("page >= 1 and n < 25")
    known = p.filter("p_partkey % 7 = 0").select(F.col("p_type").alias("source"), F.col("p_partkey").cast("string").alias("key"))
    cursors = discover.Cursors(Versions(spark, shared_folder(spark, "cursors")), p.select(F.col("p_type").alias("source")).distinct())
    out = [cursors.run(items, known, TARGET, F.col("p_partkey") % 11 == 0, F.col("p_size") % 5 != 0).withColumn("run", F.lit(i)) for i in range(1, RUNS + 1)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (numbers_in_documents, makers_in_documents, cached_classes, cache_metrics, queue_claims, sitemap_urls, sitemap_maps, category_runs, site_crawl, maker_queries, result_gates)
    return {f.__name__: f for f in own}


def _values(rows: list[tuple]) -> str:
    shown = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "values " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


def _classes_sql() -> str:
    return f"""terms(area, term, kind, weight) as ({_values(NOUN_TERMS)}), areas(area, rule_index, min_score) as ({_values(NOUN_AREAS)}),
f as (select p_partkey as part_id, p_name || '|' || p_brand as key, ' ' || p_name || ' ' as name from part),
found as (select part_id, area, sum(weight) filter (kind = 'include') as score, count(*) filter (kind = 'exclude') as out from f join terms on contains(name, ' ' || term || ' ') group by 1, 2),
good as (select part_id, area, row_number() over (partition by part_id order by score desc, rule_index) as n, count(*) over (partition by part_id) as c from found join areas using (area) where score >= min_score and out = 0),
classes as (select f.part_id, f.key, g.area, case when g.c = 1 then 'auto_accept' else 'shadow_review' end as status from f left join good g on g.part_id = f.part_id and g.n = 1),
seen as (select distinct key from f where part_id % 4 <> 0),
firsts as (select key, min(part_id) as part_id from f group by 1), firsts_before as (select key, min(part_id) as part_id from f where part_id % 4 <> 0 group by 1)"""


def _sites_sql() -> str:
    robots = f"rules(kind, path) as ({_values(SITE_ROBOTS)})"
    return f"""recursive {robots},
g as (select page_id, site, pth, string_split(pth, '/')[2] as lang, 'https://' || site as base, page_id % 2 as half from (select page_id, {HOST} as site, {PATH} as pth from pages) where site <> ''),
langs as (select distinct site, base, lang from g), halves as (select distinct site, base, lang, half from g),
listed as (
  select base || '/sitemap.xml' as map, 0 as n, base || '/gone.xml' as loc from langs union select base || '/sitemap.xml', 1, base || '/sitemap.xml' from langs
  union select base || '/sitemap.xml', 1 + dense_rank() over (partition by base order by lang), base || '/s-' || lang || '.xml' from langs
  union select base || '/s-' || lang || '.xml', half, base || '/s-' || lang || '-' || half || '.xml' from halves
  union select base || '/s-' || lang || '.xml', 9, base || '/files/' || lang || '.pdf' from langs
  union select base || '/s-' || lang || '-' || half || '.xml', page_id, base || pth from g where not (lang = 'de' and half = 1)),
entries as (select map, loc, min(n) as n, ends_with(loc, '.xml') as is_map from listed group by map, loc),
walk(site, map, path, seen) as (
  select distinct site, base || '/sitemap.xml', []::bigint[], [base || '/sitemap.xml'] from g
  union all select w.site, e.loc, list_append(w.path, e.n::bigint), list_append(w.seen, e.loc) from walk w join entries e on e.map = w.map and e.is_map and not list_contains(w.seen, e.loc)),
once as (select site, map, min((len(path), path)) as reached from walk group by 1, 2),
maps as (select site, map, row_number() over (partition by site order by reached) - 1 as place from once qualify place < 60),
useful as (
  select m.site, m.map, m.place, e.n, e.loc, substr(e.loc, length('https://' || m.site) + 1) as pth from maps m join entries e on e.map = m.map and not e.is_map),
good as (
  select u.* from useful u where (regexp_matches(pth, '(?i)[.]pdf$') or (len(list_filter(string_split(pth, '/'), lambda x: x <> '')) in (1, 2) and list_filter(string_split(pth, '/'), lambda x: x <> '')[1] = 'en'))
  and coalesce((select max(length(path)) from rules r where kind = 'allow' and starts_with(u.pth, r.path)), 0) >= coalesce((select max(length(path)) from rules r where kind = 'disallow' and starts_with(u.pth, r.path)), 0)),
counts as (select m.site, m.map, m.place, count(o.loc) as found from maps m left join good o on o.site = m.site and o.map = m.map group by 1, 2, 3),
before as (select *, sum(found) over (partition by site order by place) - found as before from counts),
budgets(budget) as (values {', '.join(f'({n})' for n in BUDGETS)})"""


def oracle_sql() -> dict[str, str]:
    return {
        "numbers_in_documents": f"with {PARTS}, {NOTED}, d as (select doc_id, {KEY.format('text')} as text from noted), k as (select part_id, {KEY.format('part_number')} as part_key from p) "
        "select doc_id, part_id from d join k on contains(d.text, k.part_key)",
        "cached_classes": f"with {_classes_sql()} select c.part_id, c.area, c.status, c.key in (select key from seen) or c.part_id not in (select part_id from firsts) as cache_hit from classes c",
        "cache_metrics": f"with {_classes_sql()}, r(run, before) as (values (1, true), (2, false), (3, false), (4, false)), t as (select count(distinct key) as k from f), o as (select count(*) as k from seen) "
        "select run, count(*) as processed, count(*) - case run when 1 then any_value(o.k) when 2 then any_value(t.k - o.k) when 3 then 0 else any_value(t.k) end as cache_hits, count(area) as classified, "
        "count(*) filter (status = 'shadow_review') as shadow_review, ((count(*) + 499) // 500)::bigint as batches, case run when 1 then any_value(o.k) else any_value(t.k) end as cache_size "
        "from r join classes c on not r.before or c.part_id % 4 <> 0 cross join t cross join o group by run",
        "queue_claims": "with q as (select event_id, row_number() over (order by user_id % 5 desc, ts, event_id) as n from events where event_type <> 'error') "
        "select event_id, case when n <= 8 then 'first' when n <= 16 then 'second' else 'third' end as worker from q where n <= 17 union all select event_id, 'first' from q where n <= 8",
        "sitemap_urls": f"with {_sites_sql()}, spent as (select budget, o.site, o.loc, b.before + row_number() over (partition by budget, o.site, o.map order by o.n) - 1 as spent_at from good o join before b on b.site = o.site and b.map = o.map join budgets on before < budget) "
        "select budget, site, min(spent_at)::bigint as place, loc as url from spent where spent_at < budget group by budget, site, loc",
        "sitemap_maps": f"with {_sites_sql()} select budget, site, place, map, found from before join budgets on before < budget",
        "category_runs": f"""with recursive i as (select p_type as source, p_partkey::varchar as key, p_partkey, p_size, row_number() over (partition by p_type order by p_partkey) - 1 as i from part),
items as (select source, key, p_partkey, p_size, i // 20 + 1 as page, i % 20 as n from i union all select source, key, p_partkey, p_size, i // 20, i % 20 + 20 from i where i // 20 >= 1 and i % 20 < 5),
r(run, source, found, seen, n_new, n_known, n_rejected, n_error, n_budget) as (
  select 0, p_type, []::varchar[], 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint from (select distinct p_type from part)
  union all
  select run + 1, source, list_concat(any_value(found), coalesce(list(key) filter (done < {TARGET} and what = 'new'), []::varchar[])), count(key), count(*) filter (done < {TARGET} and what = 'new'), count(*) filter (done < {TARGET} and what = 'known'),
    count(*) filter (done < {TARGET} and what = 'rejected'), count(*) filter (done < {TARGET} and what = 'error'), count(*) filter (done >= {TARGET} and key is not null)
  from (select *, coalesce(count(*) filter (what = 'new') over (partition by source order by n rows between unbounded preceding and 1 preceding), 0) as done
    from (select r.run, r.source, r.found, t.key, t.n, case when t.key is null then null when list_contains(r.found, t.key) or t.p_partkey % 7 = 0 then 'known' when t.p_partkey % 11 = 0 then 'error' when t.p_size % 5 = 0 then 'rejected' else 'new' end as what
      from r left join items t on t.source = r.source and t.page = r.run + 1 where r.run < {RUNS}) x) y group by run, source)
select run, source, run as page, seen, n_new, n_known, n_rejected, n_error, n_budget, seen = n_new + n_known + n_rejected + n_error + n_budget as balanced, run + 1 as next_page from r where run >= 1""",
        "maker_queries": f"with q as (select p_partkey, {ASKED} as q, trim({ASKED}) as t from part), n as (select *, list_distinct(list_filter(string_split_regex(q, '[^A-Za-z]+'), lambda x: length(x) >= 3 and lower(x) not in ({', '.join(repr(g) for g in GENERIC)}))) as names, "
        "not regexp_matches(t, '[ ]') and not regexp_matches(t, '[0-9]+ */ *[0-9]+') and length(t) between 3 and 40 and regexp_matches(t, '^[A-Za-z0-9][A-Za-z0-9/_.-]*$') and regexp_matches(t, '[A-Za-z]') and regexp_matches(t, '[0-9]') "
        "and (regexp_matches(t, '^[A-Za-z]{1,8}[-_.]?[0-9][A-Za-z0-9/_.-]{1,30}$') or regexp_matches(t, '^[0-9][A-Za-z0-9/_.-]{2,39}$')) as number from q) "
        "select p_partkey as part_id, t <> '' and not contains(t, ' ') and len(names) = 1 and not number as maker_only, array_to_string(list_sort(names, 'asc', 'nulls first'), ',') as names from n",
        "result_gates": f"with r as (select p_partkey, concat_ws(' ', coalesce({RESULT['title']}, ''), {RESULT['snippet']}, {RESULT['url']}) as x from part) "
        f"select p_partkey as part_id, not regexp_matches(x, '{discovery.CORPORATE_PAGE}') and not regexp_matches(x, '{discovery.CORPORATE_HARD}') and (regexp_matches(x, '{discovery.PRODUCT_RESULT}') or regexp_matches(x, '{discovery.NUMBER_IN_RESULT}')) as is_product, regexp_matches(x, '{discovery.CATALOGUE}') as is_catalogue from r",
        "site_crawl": f"""with recursive rules(kind, path) as ({_values(SITE_RULES)}), p as (select page_id % 5 as h, page_id // 5 as k, {SITE_PATH.format('(page_id // 5)')} as pth from pages),
ok as (select h, k, pth, coalesce((select max(length(path)) from rules where kind = 'allow' and starts_with(pth, path)), 0) >= coalesce((select max(length(path)) from rules where kind = 'disallow' and starts_with(pth, path)), 0) as allowed, len(string_split(pth, '/')) - 2 <= 5 as near from p),
r(h, k, depth) as (select h, k, 0::bigint from ok where k = 0 union all select o.h, o.k, r.depth + 1 from r join ok o on o.h = r.h and o.k in (2 * r.k + 1, 2 * r.k + 2) and o.allowed and o.near)
select 'https://s' || h || '.example' || pth as url, depth from r join ok using (h, k)""",
        "makers_in_documents": f"with {PARTS}, {NOTED}, d as (select doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as text from noted), "
        "m as (select manufacturer, min(part_id) as first_part, regexp_replace(lower(manufacturer), '[^a-z0-9]', '', 'g') as bare from p group by 1) "
        "select doc_id, manufacturer, first_part from d join m on contains(d.text, bare)",
    }
