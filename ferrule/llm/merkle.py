"""Merkle manifest of a dataset, with proofs from the parents' preimages.

Rows are leaves; per language they stand in order of their id, and every eight consecutive nodes become their parent until
one is left. A parent is stored with its preimage, the 64-character hashes of its children end to end. A leaf gets the
preimages of all its ancestors: cutting its own slot out of each leaves the siblings, and putting another hash
into the slot gives what is hashed on the way up.

All of it is joins and built-in functions. Rows are numbered by ranges; level k has an eighth of the rows of the
level below, and the ancestors' preimages go down the tree level by level, so that no join has a key with more than eight rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, saved

FANOUT = 8
#: Characters of a hash in hexadecimal.
SLOT = 64
#: What a leaf states, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "array<struct<slot: int, preimage: string>>"


def stated(*values: Column) -> Column:
    """Values one after the other: `-` for null, else the length in bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, CAPITALS, SMALL)


def tree_of(lang: Column) -> Column:
    """A key that orders languages by their bytes, null first."""
    return F.coalesce(F.concat(F.lit("1"), lang.cast("string")), F.lit("0"))


def siblings(path: Column) -> Column:
    """The hashes beside the leaf and its ancestors, level by level from the leaf up, left to right."""
    beside = lambda p: F.concat(F.substring(p["preimage"], F.lit(1), p["slot"] * SLOT), F.substring(p["preimage"], p["slot"] * SLOT + SLOT + 1, F.length(p["preimage"])))
    return F.array_join(F.transform(path, beside), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from this leaf and the siblings in the path."""
    return F.aggregate(path, leaf, lambda h, p: digest(F.overlay(p["preimage"], h, p["slot"] * SLOT + 1, SLOT)))


def _levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The parents of nodes (tree, pos, size, hash), their parents and so on: tree, pos, size, hash, preimage. Size counts a tree's nodes of that level."""
    found = []
    while not (several := nodes.filter("size > 1")).isEmpty():
        run = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        parents = several.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("parent")).agg(F.max("size").alias("size"), F.array_join(F.transform(run, lambda x: x["hash"]), "").alias("preimage"))
        nodes = saved(parents.select("tree", F.col("parent").alias("pos"), F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size"), digest(F.col("preimage")).alias("hash"), "preimage"), f"{name}-{len(found) + 1}")
        found.append(nodes)
    return found


def _paths(base: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """base (tree, pos, size, hash, ...) with subroot, root and path, its ancestors upwards. tops: tree, root and path of what is left of each tree."""
    above, columns = None, [c for c in base.columns]
    for nodes in [*reversed(levels), base]:
        own = columns if nodes is base else nodes.columns
        out = nodes.filter("size = 1").join(tops, "tree").select(*own, F.col("hash").alias("subroot"), "root", "path")
        if above is not None:
            up = above.select("tree", F.col("pos").alias("parent"), F.col("preimage").alias("whole"), "subroot", "root", F.col("path").alias("rest"))
            step = F.array(F.struct(F.expr(f"int(pos % {FANOUT})").alias("slot"), F.col("whole").alias("preimage")))
            inner = nodes.filter("size > 1").withColumn("parent", F.expr(f"pos div {FANOUT}")).join(up, ["tree", "parent"])
            out = inner.select(*own, "subroot", "root", F.concat(step, "rest").alias("path")).unionByName(out)
        above = out
    return above


@dataclass
class Manifest:
    """leaves: id, tree, pos, size, hash, claim; levels: the trees of the languages; heads: their roots (tree, pos, size, hash, of) as
    leaves of the last tree; tops: its levels."""

    leaves: DataFrame
    levels: list[DataFrame]
    heads: DataFrame
    tops: list[DataFrame]

    def proofs(self) -> DataFrame:
        """Every leaf with subroot, root and path."""
        root = (self.tops[-1] if self.tops else self.heads).filter("size = 1").select("tree", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
        heads = _paths(self.heads, self.tops, root).select(F.col("of").alias("tree"), "root", "path")
        return _paths(self.leaves, self.levels, heads)

    def root(self) -> str | None:
        """The root's hash; null for an empty table."""
        found = (self.tops[-1] if self.tops else self.heads).filter("size = 1").first()
        return found["hash"] if found else None

    def write(self, folder: str) -> None:
        """Store the tables: leaves, heads, and the parents of both with their level."""
        self.leaves.write.parquet(f"{folder}/leaves")
        self.heads.write.parquet(f"{folder}/heads")
        for name, levels in (("levels", self.levels), ("tops", self.tops)):
            for n, nodes in enumerate(levels, 1):
                nodes.write.parquet(f"{folder}/{name}/level={n}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Manifest:
        """A stored manifest."""

        def levels(name: str, base: DataFrame) -> list[DataFrame]:
            size, n = base.agg(F.max("size")).first()[0] or 0, 0
            while size > 1:
                size, n = -(-size // FANOUT), n + 1
            return [spark.read.parquet(f"{folder}/{name}/level={i}") for i in range(1, n + 1)]

        leaves, heads = spark.read.parquet(f"{folder}/leaves"), spark.read.parquet(f"{folder}/heads")
        return cls(leaves, levels("levels", leaves), heads, levels("tops", heads))


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of rows: id (any type), lang (string, null allowed), hash (the leaf) and, if wanted, claim, a hash to be checked in its place.

    Leaves with null ids come first; leaves with one id stand in order of their hash, so that equal rows are told apart by nothing and
    need not be. An empty table has no root.
    """
    if "claim" not in rows.columns:
        rows = rows.withColumn("claim", F.lit(None).cast("string"))
    # the texts are read and hashed once; what is sorted is the hashes
    rows = saved(rows.select("id", tree_of(F.col("lang")).alias("tree"), "hash", "claim"), "leaves")
    leaves = numbered(rows, "tree", ["id", "hash", "claim"], "ordered-leaves")
    levels = _levels(leaves, "nodes")
    last = [nodes.filter("size = 1").select("tree", "hash") for nodes in [leaves, *levels]]
    ends = last[0]
    for more in last[1:]:
        ends = ends.unionByName(more)
    heads = saved(numbered(ends.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash"), "tree", ["of"], "heads"), "numbered-heads")
    return Manifest(leaves, levels, heads, _levels(heads, "tops"))


def audited(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 3 divides the CRC-32 of the decimal doc_id the row is tampered with: its text's A-Z become small. folded_root follows from
    that leaf (else from its own) and the original siblings; verified says whether it is the root. Null texts can't be
    tampered with, nor are rows with a null doc_id; a text without A-Z stays as it is and is verified. Nulls of the fields are
    stated as `-`, and a null lang is a tree of its own, the first. Repeated doc_ids are leaves of their own, in order of their hash. A
    lone leaf is its tree's subroot and, if there is no other tree, the root; its proof is the hash of nothing. Further columns are ignored.
    """
    fields = [F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    other = digest(stated(*fields[:-1], lowered(fields[-1])))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("lang"), digest(stated(*fields)).alias("hash"), F.when(tampered & F.col("text").isNotNull(), other).alias("claim"))
    path = F.col("path")
    out = manifest(rows).proofs().select(F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", digest(siblings(path)).alias("proof_sha256"), folded(path, F.coalesce("claim", "hash")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def audited_sql() -> str:
    """The same in DuckDB's SQL, which has no CRC-32: its table comes from the polynomial."""
    stated_as = lambda v: f"coalesce(octet_length(encode({v}::varchar)) || ':' || {v}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(stated_as(c) for c in FIELDS[:-1])} || {stated_as(text)})"
    small = f"translate(text, '{CAPITALS}', '{SMALL}')"
    rise = (
        "select level + 1, tree, pos // 8, (any_value(size) + 7) // 8, sha256(string_agg(hash, '' order by pos)), string_agg(hash, '' order by pos) "
        "from {0} where size > 1 group by level, tree, pos // 8"
    )
    slot = "(w.pos % 8)::int * 64"
    climb = (
        f"select w.n, w.start, w.level + 1, w.tree, w.pos // 8, p.size, sha256(left(p.preimage, {slot}) || w.claim || substr(p.preimage, {slot} + 65)), "
        f"w.beside || left(p.preimage, {slot}) || substr(p.preimage, {slot} + 65) "
        "from {0} w join {1} p on p.tree = w.tree and p.level = w.level + 1 and p.pos = w.pos // 8"
    )
    return f"""
with recursive codes as (
  select list_transform(range(256), lambda x: list_reduce([x::ubigint] || range(8)::ubigint[],
    lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end)) as t),
rows as (
  select row_number() over () as n, doc_id, coalesce('1' || lang, '0') as tree, {leaf('text')} as leaf, {leaf(small)} as other,
    xor(list_reduce([4294967295::ubigint] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::ubigint),
      lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::int])), 4294967295::ubigint) % 3 = 0 as tampered
  from documents, codes),
leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as size from rows),
low(level, tree, pos, size, hash, preimage) as (
  select 0, tree, pos, size, leaf, '' from leaves union all {rise.format('low')}),
heads as (
  select tree as lang_tree, hash, row_number() over (order by tree) - 1 as pos, count(*) over () as size from low where size = 1),
high(level, tree, pos, size, hash, preimage) as (
  select 0, '', pos, size, hash, '' from heads union all {rise.format('high')}),
walk(n, start, level, tree, pos, size, claim, beside) as (
  select n, tree, 0, tree, pos, size, case when tampered then other else leaf end, '' from leaves union all {climb.format('walk', 'low')}),
climb(n, start, level, tree, pos, size, claim, beside) as (
  select w.n, w.start, 0, '', h.pos, h.size, w.claim, w.beside from walk w join heads h on h.lang_tree = w.start where w.size = 1
  union all {climb.format('climb', 'high')})
select l.doc_id, l.leaf, h.hash as subroot, r.hash as root, sha256(c.beside) as proof_sha256, c.claim as folded_root, c.claim = r.hash as verified
from climb c join leaves l on l.n = c.n join heads h on h.lang_tree = c.start join high r on r.size = 1
where c.size = 1
"""
