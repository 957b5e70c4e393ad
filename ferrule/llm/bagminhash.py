"""MinHash near-deduplication of texts as bags of five-word shingles.

A shingle that comes c times has weight c. Its weights 1..c lie in dyadic blocks (0,1], (1,2], (2,4], ...; each block has
a Poisson process of points in time, at its length as rate, and every point a place in the block and one of the
signature's registers. A register keeps the first time of a point whose place is at most c. Two bags agree in a
register with the probability of their weighted Jaccard similarity (BagMinHash). Points are generated in order of time
and only up to the time by which all registers of the text are filled.

Bands of registers give buckets, and the bags themselves decide: only pairs whose exact weighted Jaccard reaches the
threshold are linked. Equal bags are one class from the start. Inside a bucket all are first compared with its smallest
member. Of what this leaves in different classes, buckets of a few members are compared pair by pair. The others don't
compare members with each other: each member is compared with the bucket's hub and kept as its difference from it. With
M and A the weight that a bag lacks of the hub and has beyond it, H the hub's weight and c what two differences have in
common, two bags reach the threshold t just if

    M1 + t A1 + M2 + t A2 <= (1 - t) H + (1 + t) c

so two bags that aren't both near the hub must share much of their differences, and an index of each difference's rarest
parts (prefix filter) finds all such pairs: random edits of one text share next to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as w
from .common import components, keyed, saved

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 128
ROWS = 4
#: Candidates whose signatures agree less than this many standard deviations below the threshold are no candidates.
DEVIATIONS = 6
#: Buckets of up to so many members are compared pair by pair.
FEW = 16
#: Slack of comparisons in double precision.
SLACK = 1e-12
SEED = 0x5851F42D4C957F2D


def bags(hashes: np.ndarray, counts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block of texts: text index, shingle hash and weight, sorted by text and hash.

    A text of one to k - 1 words has one shingle, all its words.
    """
    gram = w.grams(hashes, k)
    text = np.repeat(np.arange(len(counts)), counts)
    fits = text[: len(gram)] == text[k - 1 :] if len(gram) else np.zeros(0, bool)
    before = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    whole = w.mix(counts[short].astype(np.uint64))
    for i in range(k - 1):
        has = counts[short] > i
        whole[has] = w.combined(whole[has], hashes[before[short][has] + i])
    text, gram = np.concatenate([text[: len(gram)][fits], short]), np.concatenate([gram[fits], whole])
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])])) if len(gram) else np.zeros(0, np.int64)
    return text[new], gram[new], np.diff(np.append(new, len(gram)))


def signatures(text: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers first times, as the bits of doubles; all ones for a text without shingles."""
    total = np.bincount(text, weight, minlength=n)
    least = np.full((n, registers), np.uint64(0xFFFFFFFFFFFFFFFF))
    # one row for each block that a shingle's weight reaches into
    parts = [(text, gram, np.zeros(len(text), np.int64), weight)]
    level = 1
    while (more := weight > 1 << (level - 1)).any():
        parts.append((text[more], gram[more], np.full(more.sum(), level), weight[more]))
        level += 1
    text, gram, block, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    start = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    length = np.maximum(start, 1)
    seed = w.mix(gram + block.astype(np.uint64) * np.uint64(w.BASES[2]))
    until = np.where(total > 0, registers * (np.log(registers) + 4) / np.maximum(total, 1), 0)
    todo = total > 0
    while todo.any():
        at = np.flatnonzero(todo[text])
        time, k = np.zeros(len(at)), 0
        while len(at):
            k += 1
            h = w.mix(seed[at] + np.uint64(k * SEED % (1 << 64)))
            time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / length[at]
            early = time <= until[text[at]]
            at, time, h = at[early], time[early], w.mix(h[early] ^ np.uint64(SEED))
            place = start[at] + 1 + ((h >> np.uint64(32)).astype(np.float64) / (1 << 32) * length[at]).astype(np.int64)
            inside = place <= weight[at]
            register = (h[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) % registers
            np.minimum.at(least.reshape(-1), text[at[inside]] * registers + register, time[inside].view(np.uint64))
        todo &= (least == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)
        until = np.where(todo, until * 2, 0)
        least[todo] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return least


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in w.blocks(batches, "text"):
        buf, bounds = w.buffer(block.column("text"))
        starts, ends, counts = w.spans(buf, bounds)
        text, gram, weight = bags(w.word_hashes(buf, starts, ends), counts)
        n = len(counts)
        some = np.bincount(text, minlength=n) > 0
        # order-free digests of the bag
        digest = []
        for base in w.BASES[:2]:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(w.mix(gram ^ np.uint64(base)) * weight.astype(np.uint64), out=(c := np.zeros(len(gram) + 1, np.uint64))[1:])
            edge = np.searchsorted(text, np.arange(n + 1))
            total = c[edge]
            digest.append((total[1:] - total[:-1])[some].view(np.int64))
        least = signatures(text, gram, weight, n)[some]
        factor = w.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
        bands = w.mix((w.mix(least) * factor).reshape(len(least), -1, ROWS).sum(2, dtype=np.uint64)).view(np.int64)
        width = bands.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(least) + 1, dtype=np.int32) * width), pa.array(bands.reshape(-1)))
        brief = (w.mix(least) >> np.uint64(48)).astype("<u2")
        yield pa.RecordBatch.from_arrays(
            [block.column("_key").filter(pa.array(some)), *(pa.array(x) for x in digest), lists, pa.array([x.tobytes() for x in brief], pa.binary())],
            names=["key", "digest1", "digest2", "bands", "brief"],
        )


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in w.blocks(batches, "text"):
        buf, bounds = w.buffer(block.column("text"))
        starts, ends, counts = w.spans(buf, bounds)
        text, gram, weight = bags(w.word_hashes(buf, starts, ends), counts)
        edge = np.searchsorted(text, np.arange(len(counts) + 1))
        pairs = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [block.column("_key"), pa.array([gram[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([weight[a:b].astype("<u4").tobytes() for a, b in pairs], pa.binary())],
            names=["key", "grams", "weights"],
        )


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted distinct hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def _column(batch: pa.RecordBatch, name: str, kind: str) -> list[np.ndarray]:
    """The binary column's values as arrays."""
    data, bounds = w.buffer(batch.column(name))
    return [data[a:b].view(kind) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """The bags of both ends of each row."""
    ga, wa, gb, wb = (_column(batch, c, k) for c, k in (("grams_a", "<u8"), ("weights_a", "<u4"), ("grams_b", "<u8"), ("weights_b", "<u4")))
    return zip(zip(ga, wa, strict=True), zip(gb, wb, strict=True), strict=True)


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([jaccard(a, b) >= threshold - SLACK for a, b in _pairs(batch)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return run


DIFFERENCE = "hub long, key long, near boolean, cost double, room double, size long, small long, large long, parts array<long>"


def difference(hub: tuple[np.ndarray, np.ndarray], bag: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[bool, float, float, int, int, int, np.ndarray]:
    """How a bag differs from a hub: whether it reaches the threshold with it, M + t A, (1 - t) H, M + A, for how many of its rarest parts it
    has to be found as the end of a pair that costs less, and as the other (0: it can't be that), and the parts, one for each unit of weight."""
    grams = np.union1d(hub[0], bag[0])
    change = np.zeros(len(grams), np.int64)
    change[np.searchsorted(grams, bag[0])] += bag[1]
    change[np.searchsorted(grams, hub[0])] -= hub[1]
    at = np.flatnonzero(change)
    amount = np.abs(change[at])
    beyond, size = int(change[change > 0].sum()), int(amount.sum())
    lacking, total, own = size - beyond, int(hub[1].sum()), int(bag[1].sum())
    common = total - lacking
    near = common / (total + own - common) >= threshold - SLACK
    cost, room = lacking + threshold * beyond, (1 - threshold) * total
    # what two differences must share at least: see the module's text, with the other end's cost as small as it can be
    small = (cost if near else max(cost, 2 * cost - room)) / (1 + threshold)
    prefix = lambda shared: min(size, max(0, size - int(np.ceil(max(shared, 0) - 1e-6)) + 1))
    nth = np.arange(size) - np.repeat(np.cumsum(amount) - amount, amount)
    side = np.where(change[at] > 0, np.uint64(w.BASES[1]), np.uint64(w.BASES[2]))
    parts = w.mix(np.repeat(w.mix(grams[at] ^ side), amount) + nth.astype(np.uint64))
    return near, cost, room, size, prefix(small), 0 if near else prefix(cost - room), parts


def _differing(threshold: float):
    """Of pairs a (the hub) and b: their differences. Keys of equal bags don't come, so no difference is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [difference(a, b, threshold) for a, b in _pairs(batch)]
            sizes = np.array([len(x[-1]) for x in found], np.int64)
            parts = np.concatenate([np.zeros(0, np.uint64), *(x[-1] for x in found)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(parts))
            plain = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.bool_(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *plain, lists], names=["hub", "key", "near", "cost", "room", "size", "small", "large", "parts"])

    return run


def _agreeing(least: int):
    """Of pairs with their brief signatures: those that agree in `least` registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("brief_a", "brief_b")]
            ok = pa.array((both[0] == both[1]).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return run


def _placed(members: DataFrame, component: DataFrame) -> DataFrame:
    """The members (bucket, key) of buckets that hold several classes, with their class."""
    placed = members.join(component.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    return placed.join(several, "bucket").select("bucket", "key", "component")


def _hubs(large: DataFrame) -> DataFrame:
    """(hub, key): every member of large buckets with the hub of each of its buckets, once.

    A bucket's hub is the leader of its largest class, and a class is led by the member that meets most others in
    such buckets: a text from which the others differ little shares most buckets.
    """
    sizes = large.groupBy("bucket", "component").count()
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("component"), F.sum("count").alias("n"))
    reach = large.join(main.select("bucket", "n"), "bucket").groupBy("component", "key").agg(F.sum("n").alias("reach"))
    leaders = reach.groupBy("component").agg(F.max_by("key", F.struct("reach", "key")).alias("hub"))
    return large.join(main.join(leaders, "component").select("bucket", "hub"), "bucket").filter("key <> hub").select("hub", "key").distinct()


def _sharing(differences: DataFrame, component: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes that have the same hub and a part in common among those for which each is indexed.

    Parts are ordered by how many of the hub's members have them; those seen in one class only come first, and no pair needs them.
    A pair must still be able to share enough from the common part on, as the first one of a similar pair is. The end that
    costs less can't share more than it has, which bounds its cost from below.
    """
    classed = differences.join(component.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    far = differences.filter("large > 0").select("hub").distinct()
    held = saved(classed.join(far, "hub", "left_semi").select("hub", "key", "component", "cost", "room", "size", "small", "large", F.explode("parts").alias("part")), "parts")
    shared = held.groupBy("hub", "part").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("hub", "part", "n")
    live = held.join(shared, ["hub", "part"])
    mine = Window.partitionBy("hub", "key")
    # a text's parts are no more than its words and the hub's
    place = F.row_number().over(mine.orderBy("n", "part")) + F.col("size") - F.count("*").over(mine)
    placed = live.withColumn("place", place).filter("place <= small or place <= large")
    placed = saved(placed.select("hub", "part", "key", "component", "cost", "room", (F.col("size") - F.col("place")).alias("rest"), (F.col("place") <= F.col("small")).alias("one"), (F.col("place") <= F.col("large")).alias("two")), "prefixes")
    side = lambda end, x: placed.filter(end).select("hub", "part", "room", F.col("key").alias(x), F.col("component").alias(f"c{x}"), F.col("cost").alias(f"e{x}"), F.col("rest").alias(f"r{x}"))
    one, two = side("one", "x"), side("two", "y").drop("room")
    enough = F.expr(f"1 + least(rx, ry) >= (ex + ey - room) / {1 + threshold} - 1e-6 and ex >= {threshold} * (ey - room) - 1e-6")
    met = one.join(two, (one["hub"] == two["hub"]) & (one["part"] == two["part"]) & F.expr("cx <> cy and (ex < ey or (ex = ey and x < y))") & enough)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """component (id, component) after more links (a, b)."""
    of = lambda x: component.select(F.col("id").alias(x), F.col("component").alias(f"component_{x}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))
    merged = components(joined).select(F.col("id").alias("component"), F.col("component").alias("root"))
    ids = component.select("id").unionByName(links.select(F.col("a").alias("id"))).unionByName(links.select(F.col("b").alias("id"))).distinct()
    known = ids.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return saved(known.join(merged, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "components")


def _least(registers: int, threshold: float, deviations: float) -> int:
    """Registers that a pair at the threshold agrees in, less so many standard deviations."""
    return int(np.floor(registers * threshold - deviations * np.sqrt(registers * threshold * (1 - threshold))))


def _with_bags(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys with the bags of both."""
    ends = pairs.select(F.col("a").alias("_key")).unionByName(pairs.select(F.col("b").alias("_key"))).distinct()
    held = saved(rows.select("_key", "text").join(ends, "_key", "left_semi").mapInArrow(_bagged, "key long, grams binary, weights binary"), "bags")
    side = lambda x: held.select(F.col("key").alias(x), F.col("grams").alias(f"grams_{x}"), F.col("weights").alias(f"weights_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _linked(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of keys whose bags are similar enough."""
    return saved(_with_bags(pairs, rows).mapInArrow(_verified(threshold), "a long, b long"), "linked")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: id_col, class_id and kept.

    Rows are linked if the weighted Jaccard similarity of their bags of five-word shingles reaches the threshold;
    class_id is the smallest id reachable by links, and kept marks that row. A text of one to four words is one shingle. Null
    texts and texts without words link with nothing. With null or repeated ids every row counts as its own, numbered in
    order of id (nulls first) and text, and class_id is such a number. Other columns of docs are ignored.

    A pair at the threshold is missed with a probability of about 5e-8 by the bands and less than 1e-8 by the comparison of
    brief signatures; inside buckets nothing is missed, and no pair below the threshold is linked.
    """
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    out = classified(rows, threshold)
    return rows.select("_key", F.col("doc_id").alias(id_col)).join(out, "_key").select(id_col, "class_id", (F.col("_key") == F.col("class_id")).alias("kept"))


def classified(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(_key, class_id) for every row of rows (_key unique, text)."""
    signed = saved(rows.select("_key", "text").mapInArrow(_signed, "key long, digest1 long, digest2 long, bands array<long>, brief binary"), "signatures")
    same = saved(signed.groupBy("digest1", "digest2").agg(F.min("key").alias("key")), "representatives")
    own = signed.join(same.select("key"), "key", "left_semi")
    banded = own.select("key", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("hub")).filter("n > 1")
    members = saved(banded.join(full, "bucket"), "buckets")
    brief = signed.select("key", "brief")
    side = lambda x: brief.select(F.col("key").alias(x), F.col("brief").alias(f"brief_{x}"))
    stars = members.filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    agreeing = _agreeing(_least(REGISTERS, threshold, DEVIATIONS))
    tried = saved(stars.join(side("a"), "a").join(side("b"), "b").mapInArrow(agreeing, "a long, b long"), "stars")
    component = saved(components(_linked(tried, rows, threshold)), "components")

    # what is left: buckets whose members are in different classes
    placed = saved(_placed(members.select("bucket", "key"), component), "several")
    size = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    few, large = (saved(placed.join(size.filter(which), "bucket").select("bucket", "key", "component"), "several") for which in (F.col("n") <= FEW, F.col("n") > FEW))
    one = few.select("bucket", F.col("key").alias("a"), F.col("component").alias("one"))
    two = few.select("bucket", F.col("key").alias("b"), F.col("component").alias("two"))
    close = one.join(two, "bucket").filter("a < b and one <> two").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    close = saved(close.join(side("a"), "a").join(side("b"), "b").mapInArrow(agreeing, "a long, b long"), "close")
    pairs = _hubs(large).select(F.col("hub").alias("a"), F.col("key").alias("b"))
    differences = saved(_with_bags(saved(pairs, "hubs"), rows).mapInArrow(_differing(threshold), DIFFERENCE), "differences")
    ends = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    component = _merged(component, _linked(close, rows, threshold).unionByName(ends(differences.filter("near"), "hub", "key")))
    met = saved(_sharing(differences, component, threshold).join(tried, ["a", "b"], "left_anti"), "met")
    met = met.join(side("a"), "a").join(side("b"), "b").mapInArrow(agreeing, "a long, b long")
    component = _merged(component, _linked(saved(met, "close"), rows, threshold))
    of_bag = same.join(component, same["key"] == component["id"], "left").select("digest1", "digest2", F.coalesce("component", "key").alias("class_id"))
    found = signed.select("key", "digest1", "digest2").join(of_bag, ["digest1", "digest2"]).select(F.col("key").alias("_key"), "class_id")
    return rows.select("_key").join(found, "_key", "left").select("_key", F.coalesce("class_id", "_key").alias("class_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, that with the smallest id; all columns stay."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text_col}
    rows = keyed(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(text_col).alias("text")), names[id_col])
    first = classified(rows, threshold).filter("_key = class_id").select("_key")
    left = rows.join(first, "_key", "left_semi")
    return left.select(*(F.col("text").alias(c) if c == text_col else F.col(names[c]).alias(c) for c in docs.columns))
