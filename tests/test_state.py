"""State that outlives a run: versions, claims, the cache of classifications."""

import threading

from pyspark.sql import functions as F

from ferrule.operators import classify
from ferrule.operators.cache import Cache
from ferrule.operators.claims import SUMMED, Claims
from ferrule.sources.shared import checkpointed
from ferrule.sources.versions import Versions

ORDER = lambda: [F.desc("priority"), F.asc("created")]
#: The parts of the reference's gate for classification at scale.
PARTS = ["Festo DSNU pneumatic cylinder", "Inductive proximity sensor M12", "24V DC power supply", "Digital pressure gauge", "Micropipette Nichipet", "Peristaltic pump 2 L/min", "Deep groove ball bearing"]
TERMS = [("pneumatics", "pneumatic cylinder", "include", 60), ("sensors", "proximity sensor", "include", 60), ("power", "power supply", "include", 60), ("gauges", "pressure gauge", "include", 60), ("laboratory", "micropipette", "include", 60), ("pumps", "peristaltic pump", "include", 60), ("bearings", "ball bearing", "include", 60)]


def queue(spark, n=400):
    return spark.range(n).select("id", F.when(F.col("id") % 10 == 9, "done").otherwise("queued").alias("status"), (F.col("id") % 3).alias("priority"), (F.col("id") * 7 % 101).alias("created"))


def expected(n=400):
    return [i for i in sorted(range(n), key=lambda i: (-(i % 3), i * 7 % 101, i)) if i % 10 != 9]


def test_a_version_is_added_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    made = []
    threads = [threading.Thread(target=lambda i=i: made.append((v.add(1, {"by": i}), i))) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sum(ok for ok, _ in made) == 1 and v.all() == [{"by": next(i for ok, i in made if ok)}]
    assert v.add(2, {}) and not v.add(2, {}) and len(v.all()) == 2


def test_two_workers_never_share_a_row(spark, tmp_path):
    got = {}

    def work(name):
        claims = Claims(spark, str(tmp_path / "q"))
        got[name] = {r.id for r in claims.claim(queue(spark), name, 40, ORDER()).collect()}

    threads = [threading.Thread(target=work, args=(n,)) for n in ("a", "b", "c")]
    [t.start() for t in threads], [t.join() for t in threads]
    assert all(len(x) == 40 for x in got.values()) and len(set.union(*got.values())) == 120
    assert set.union(*got.values()) == set(expected()[:120])


def test_a_worker_that_runs_again_has_the_same_rows(spark, tmp_path):
    claims = Claims(spark, str(tmp_path / "q"))
    ids = lambda df: {r.id for r in df.collect()}
    first = ids(claims.claim(queue(spark), "a", 8, ORDER()))
    second = ids(Claims(spark, str(tmp_path / "q")).claim(queue(spark), "b", 8, ORDER()))
    assert first == set(expected()[:8]) and second == set(expected()[8:16])
    assert ids(Claims(spark, str(tmp_path / "q")).claim(queue(spark), "a", 8, ORDER())) == first
    # a crash before the version was added leaves nothing behind: rows that no version names are claimed by nobody
    claims.spark.range(16, 400).select("id", F.lit("lost").alias("worker")).write.parquet(str(tmp_path / "q/rows/lost"))
    assert ids(claims.claim(queue(spark), "c", 400, ORDER())) == set(expected()[16:])
    assert ids(claims.claim(queue(spark), "d", 5, ORDER())) == set()


def test_many_claims_are_summed(spark, tmp_path):
    claims, small = Claims(spark, str(tmp_path / "q")), queue(spark, 60)
    for i in range(SUMMED + 2):
        claims.claim(small, f"w{i}", 1, ORDER())
    assert "sum" in claims.versions.all()[SUMMED - 1]
    assert {r.id for r in claims.taken().collect()} == set(expected(60)[: SUMMED + 2])


def rules(spark):
    terms = spark.createDataFrame(TERMS, "area string, term string, kind string, weight int")
    areas = spark.createDataFrame([(t[0], i, 35) for i, t in enumerate(TERMS)], "area string, rule_index int, min_score int")
    asked = []

    def run(rows):
        asked.append(rows.count())
        return classify.decided(rows, classify.scores(classify.occurrences(rows, terms, "row", "title")), areas, "row").select(F.col("id").alias("row"), "area", "status", "confidence")

    return run, asked


def test_classified_once_across_runs(spark, tmp_path):
    """The gate's numbers: 100,000 rows of seven parts, the second run all from the table; two changed of eight only two."""
    run, asked = rules(spark)
    columns = "area string, status string, confidence double"
    titles = F.get(F.array(*map(F.lit, PARTS)), (F.col("id") % 7).cast("int"))
    rows = spark.range(100_000).select(F.col("id").alias("row"), titles.alias("title"), F.lit("clash").alias("area"))
    print_ = classify.fingerprint([F.col("title")])
    results = []
    for _ in range(2):
        cache = Cache(spark, str(tmp_path / "c"), "shadow-evidence-v3", columns)
        out = cache.classified(rows, print_, "row", run, checkpointed)
        results.append(cache.metrics(out, "area", "status", 1000))
    assert results[0] == {"processed": 100_000, "cache_hits": 99_993, "classified": 100_000, "shadow_review": 0, "batches": 100, "cache_size": 7}
    assert results[1] == results[0] | {"cache_hits": 100_000}
    assert asked == [7, 0]
    plan = cache.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

    few = spark.createDataFrame([(i, t.replace("M12", "M18")) for i, t in enumerate([*PARTS, "K thermocouple probe"])], "row long, title string")
    out = {r.row: (r.area, r.cache_hit) for r in cache.classified(few, print_, "row", run, checkpointed).collect()}
    assert asked[-1] == 2 and [i for i in out if not out[i][1]] == [1, 7] and out[1][0] == "sensors" and out[7][0] is None

    other = Cache(spark, str(tmp_path / "c"), "shadow-evidence-v4", columns)
    out = other.classified(few, print_, "row", run, checkpointed)
    assert asked[-1] == 8 and out.filter("cache_hit").count() == 0
    other.forget_others()
    assert [p.name for p in (tmp_path / "c").iterdir()] == [other.path.rsplit("/", 1)[-1]]
    assert other.rows().count() == 8


def test_cache_of_nothing_and_of_nulls(spark, tmp_path):
    run, asked = rules(spark)
    cache = Cache(spark, str(tmp_path / "c"), "v1", "area string, status string, confidence double")
    rows = spark.createDataFrame([(1, None), (2, None), (3, "power supply")], "row long, title string")
    fingerprint = F.when(F.col("title").isNotNull(), classify.fingerprint([F.col("title")]))
    assert cache.classified(rows.limit(0), fingerprint, "row", run, checkpointed).count() == 0
    assert sorted((r.row, r.area, r.cache_hit) for r in cache.classified(rows, fingerprint, "row", run, checkpointed).collect()) == [(1, None, False), (2, None, True), (3, "power", False)]
