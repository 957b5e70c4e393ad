import pytest
from pyspark.sql import functions as F

from ferrule.operators import discover
from ferrule.sources.shared import checkpointed
from ferrule.sources.versions import Versions

FILES = "url string, status int, text string"


def xml(*locs, index=False):
    rows = "".join(f"<loc> {x} </loc>" for x in locs)
    return f"<sitemapindex>{rows}</sitemapindex>" if index else f"<urlset>{rows}</urlset>"


def walked(files, start, most):
    """The queue of maps, read one by one."""
    queue, seen = [start], []
    while queue and len(seen) < most:
        at = queue.pop(0)
        if at in seen:
            continue
        seen.append(at)
        queue += [x for x in files.get(at, []) if x not in seen]
    return seen


@pytest.mark.parametrize("most", [1, 4, 60])
def test_maps_are_read_in_the_order_of_a_queue(spark, most):
    at = lambda i: f"https://h.example/{i}.xml"
    links = {at(0): [at(3), at(1), at(0), at(2)], at(1): [at(2), at(5), at(4)], at(2): [at(6)], at(3): [at(4), at(6), at(9)], at(4): [at(0), at(7)], at(6): [at(8)], at(8): [at(1), at(10)]}
    files = spark.createDataFrame([(m, 200, xml(*ls, index=True)) for m, ls in links.items()], FILES)
    sites = spark.createDataFrame([("h.example", "https://h.example/", at(0)), ("none.example", "https://none.example/", "https://none.example/sitemap.xml")], "site string, root string, start string")
    got = discover.maps_in_order(sites, discover.map_entries(files), checkpointed, most).filter("site = 'h.example'").orderBy("place").collect()
    assert [r.map for r in got] == walked(links, at(0), most) and [r.place for r in got] == list(range(len(got)))


def test_the_budget_is_spent_on_useful_pages_in_order(spark):
    base = "https://www.h.example"
    files = [
        (f"{base}/sitemap.xml", 200, xml(f"{base}/news.xml", "/shop.xml", f"{base}/lost.xml", index=True)),
        (f"{base}/news.xml", 200, xml(*(f"{base}/news/{i}" for i in range(500)), f"{base}/up/a.pdf", f"{base}/up/a.pdf")),
        (f"{base}/shop.xml", 200, xml(f"{base}/shop", f"{base}/shop/a", f"{base}/shop/a.png", f"{base}/shop/x/y/z", f"{base}/shop/no/1", "ftp://h.example/shop/b", "https://other.example/shop/c", f"{base}/shop/a/b", "https://eu.h.example/shop/d", f"{base}/shop/e")),
        (f"{base}/lost.xml", 404, xml(f"{base}/shop/lost")),
    ]
    sites = spark.createDataFrame([("h", f"{base}/shop", f"{base}/sitemap.xml")], "site string, root string, start string")
    rules = spark.createDataFrame([("h.example", "disallow", "/shop/no")], "host string, kind string, path string")
    want = [f"{base}/up/a.pdf", f"{base}/shop", f"{base}/shop/a", f"{base}/shop/a/b", "https://eu.h.example/shop/d", f"{base}/shop/e"]
    for limit in (1, 3, 100):
        urls, maps = discover.site_urls(sites, spark.createDataFrame(files, FILES), rules, limit, 2, checkpointed)
        assert [r.url for r in urls.orderBy("place").collect()] == want[:limit]
        assert [r.found for r in maps.orderBy("place").collect()] == ([0, 1] if limit == 1 else [0, 1, 5] if limit == 3 else [0, 1, 5, 0])
    nothing = discover.site_urls(sites, spark.createDataFrame([], FILES), rules, 5, 2, checkpointed)[0]
    assert nothing.count() == 0


def items(spark):
    rows = [("s", page, n, f"k{(page * 4 + n) % 9}") for page in (1, 2, 3) for n in range(6)] + [("t", 1, 0, "k1")]
    return spark.createDataFrame(rows, "source string, page int, n int, key string")


def runs(spark, folder, count, fresh):
    sources, known = spark.createDataFrame([("s",), ("t",), ("empty",)], "source string"), spark.createDataFrame([("s", "k7")], "source string, key string")
    cursors, out = None, []
    for _ in range(count):
        cursors = discover.Cursors(Versions(spark, folder), sources) if fresh or cursors is None else cursors
        got = cursors.run(items(spark), known, 2, F.col("key") == "k5", F.col("key") != "k6")
        out.append(sorted(tuple(r) for r in got.collect()))
    return out, cursors


def test_stopping_and_going_on_equals_one_run(spark, tmp_path):
    whole, _ = runs(spark, str(tmp_path / "a"), 3, False)
    parts, cursors = runs(spark, str(tmp_path / "b"), 3, True)
    assert whole == parts and whole[0] != whole[1]
    known, found = {"k7"}, []
    for page in (1, 2, 3):
        n = dict.fromkeys(("new", "known", "rejected", "error", "budget"), 0)
        for i in range(6):
            key = f"k{(page * 4 + i) % 9}"
            kind = "budget" if n["new"] >= 2 else "known" if key in known else "error" if key == "k5" else "rejected" if key == "k6" else "new"
            n[kind] += 1
            if kind == "new":
                known.add(key)
        found.append(("s", page, 6, *n.values(), True, page + 1))
    assert [[r for r in x if r[0] == "s"][0] for x in whole] == found
    assert [r for r in whole[0] if r[0] == "empty"] == [("empty", 1, 0, 0, 0, 0, 0, 0, True, 2)]
    # a run that died before its version was there is done again from the same page
    pages, _, number = cursors.state()
    assert number == 3 and {r.page for r in pages.collect()} == {4}
    assert cursors.versions.add(4, {"pages": "x", "found": "y"}) and not cursors.versions.add(4, {})


def test_accounts_that_do_not_add_up_are_told(spark):
    rows = spark.createDataFrame([("s", 1, "new"), ("s", 1, None)], "source string, page int, outcome string")
    assert discover.page_accounts(rows).first()["balanced"] is False
