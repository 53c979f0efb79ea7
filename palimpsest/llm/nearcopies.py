"""Near copies by SimHash and multi-index hashing at a stated similarity of word shingles.

A 64-bit fingerprint with a small radius holds little but equal texts: at a Jaccard similarity of 0.8 two fingerprints differ
in 15 of 100 bits. Here a fingerprint is as wide as the table of documents needs: ``tables`` segments of ``bits`` bits and
lanes of 64 bits beside them, the first four of which are the sketch. Two texts meet if one segment of theirs is within 2 bits,
for which both enumerate the ball of radius 1 about each of their segments, as two of three parts after the third has brought
them together. What meets is compared by sketch where it meets, then by its complete distance, then by its sets of shingles, so
that chance decides only what is missed, never what is linked.

``bits`` follows the logarithm of the number of rows, so that a bucket holds about as many fingerprints at any size, and
``tables`` follows from the recall wanted at the threshold; what is more alike is missed less often.
"""

from __future__ import annotations

import math
from functools import partial, reduce
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace, join_rows, row_key, texts
from .graph import connected_components
from .simhash import keep_first

#: In a bucket with more fingerprints than this all are first compared with the least alone, see ``_met``.
PAIRWISE = 256
#: Lanes of 64 bits beside the first that count for the complete distance; the first of them are the other words of the sketch.
CHECKED = 15
#: Words of the sketch.
SKETCH = 4
#: Of what a node is near to in its buckets, so many of the closest are compared before all that is left between components.
CLOSEST = 3
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_GOLDEN, _M1, _M2 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Plan(NamedTuple):
    bits: int
    tables: int
    apart: float

    @classmethod
    def of(cls, rows: int, similarity: float, recall: float) -> Plan:
        """Sets of Jaccard j have a cosine of at least 2j / (1 + j), by which their bits differ with a chance of arccos / pi. Half of what may be missed is left to the two radii."""
        bits = max(12, math.ceil(math.log2(max(rows, 2))) + 1)
        p = math.acos(2 * similarity / (1 + similarity)) / math.pi
        hit = sum(math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(3))
        return cls(bits, max(1, math.ceil(math.log((1 - recall) / 2) / math.log(1 - hit))), p)

    def parts(self) -> list[int]:
        """The three parts of a segment, as masks of its bits."""
        cuts = [self.bits * i // 3 for i in range(4)]
        return [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(cuts, cuts[1:])]

    def radius(self, n: int) -> int:
        """Bits of ``n`` that may differ: 2.6 standard deviations above the mean at the threshold, which 1 pair in 200 exceeds."""
        return math.ceil(n * self.apart + 2.6 * math.sqrt(n * self.apart * (1 - self.apart)))


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of fewer words the whole is one, and no words have none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)]
    return np.unique(np.fromiter(map(_hash, runs), dtype=np.uint64))


def _wide(h: np.ndarray, plan: Plan) -> tuple[int, np.ndarray]:
    """(sketch, segments and behind them the checked lanes) of a set of hashes; each bit is 1 if set in over half of them."""
    lanes = 1 + CHECKED + -(-plan.bits * plan.tables // 64)
    seeds, ones = np.arange(1, lanes + 1, dtype=np.uint64) * _GOLDEN, np.zeros(64 * lanes, dtype=np.int64)
    for i in range(0, len(h), 1 << 12):
        x = h[i : i + (1 << 12), None] + seeds
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    bit = 2 * ones > len(h)
    whole = np.packbits(bit[: 64 * (1 + CHECKED)]).view("<i8")
    rest = bit[64 * (1 + CHECKED) :][: plan.bits * plan.tables]
    segments = rest.reshape(plan.tables, plan.bits) @ (1 << np.arange(plan.bits, dtype=np.int64))
    return int(whole[0]), np.concatenate([segments, whole[1:]])


def _fingerprints(docs: DataFrame, words: int, plan: Plan) -> DataFrame:
    """(doc_id, t1, t2, node, sketch, segments) of every row; texts of the same words are one node, those without words 0."""
    rows = texts(docs).select("doc_id", *row_key(), F.col("text").cast("binary").alias("text"))
    keys = [f for f in rows.schema if f.name != "text"]
    names = [f.name for f in keys]

    def run(batches):
        for b in batches:
            node, sketch, segments = [], [], []
            for t in b.column("text"):
                w = (t.as_py() or b"").lower().split()
                s, seg = _wide(shingles(w, words), plan)
                node.append(_hash(b" ".join(w)) if w else 0)
                sketch.append(s)
                segments.append(seg)
            out = [pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(sketch, pa.int64()), pa.array(segments, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), *out], [*names, "node", "sketch", "segments"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    return rows.mapInArrow(run, f"{head}, node bigint, sketch bigint, segments array<bigint>")


def _sketched(a: Column, b: Column) -> Column:
    """The distance of two members' sketches."""
    return reduce(add, (F.bit_count(a[f"w{i}"].bitwiseXOR(b[f"w{i}"])) for i in range(SKETCH)))


def _near(a: Column, b: Column, plan: Plan) -> Column:
    """Of two members of a bucket, whether their sketches are near enough."""
    return _sketched(a, b) <= plan.radius(64 * SKETCH)


def _apart(a: Column, b: Column) -> Column:
    """The complete distance of two arrays of segments and checked lanes."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)


def _buckets(nodes: DataFrame, plan: Plan, *carried: str) -> DataFrame:
    """(route, rest, m) for every bucket a node is in; m is a struct of node, the words of its sketch and what is carried.

    Of two segments within 2 bits, one of three parts is equal. So a segment is dealt out by each of its parts, and the ball
    of radius 1 about the other two is enumerated where it has arrived: three rows of it are shuffled, not one for each bit.
    """
    parts, full = plan.parts(), (1 << plan.bits) - 1
    words = (F.get("segments", F.lit(plan.tables + i - 1)).alias(f"w{i}") for i in range(1, SKETCH))
    m = F.struct("node", F.col("sketch").alias("w0"), *words, *carried)
    dealt = nodes.select(m.alias("m"), F.posexplode(F.slice("segments", 1, plan.tables)).alias("t", "s"))
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("s").bitwiseAND(F.lit(k)).alias("own"), F.col("s").bitwiseAND(F.lit(full ^ k)).alias("s")) for i, k in enumerate(parts))))
    dealt = dealt.select("m", "t", sides.alias("e")).select("m", (F.col("t") * 3 + F.col("e.part")).alias("tp"), "e.own", "e.s", "e.part")
    dealt = dealt.select("m", F.shiftleft(F.col("tp").cast("long"), plan.bits).bitwiseOR(F.col("own")).alias("route"), "s", "part")
    # the few files of a small table would leave most cores without work
    dealt = dealt.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "route")
    bits = [F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(plan.bits) if not k >> i & 1)) for k in parts]
    ball = F.explode(F.when(F.col("part") == 0, bits[0]).when(F.col("part") == 1, bits[1]).otherwise(bits[2]))
    return dealt.select("route", "m", "s", ball.alias("one")).select("route", F.col("s").bitwiseXOR(F.col("one")).alias("rest"), "m")


def _met(nodes: DataFrame, plan: Plan, pairwise: int) -> DataFrame:
    """(v, u): the nodes that are near another by sketch in a bucket, or in a bucket of more than ``pairwise``, with the closest others.

    In a bucket every member's closest other is taken, in a larger one the least if it is near; of those the closest of all
    buckets are in the array u.
    """
    bucket = W.partitionBy("route", "rest")
    index = _buckets(nodes, plan)
    index = index.select("route", "rest", "m", F.count(F.lit(1)).over(bucket).alias("n"), F.min("m").over(bucket).alias("least")).where("n > 1")
    small = index.where(F.col("n") <= pairwise).groupBy("route", "rest").agg(F.collect_list("m").alias("all"))
    one = lambda m, v: F.struct(_sketched(v, m).alias("d"), v.node.alias("u"))
    of = lambda m: F.array_min(F.transform(F.filter("all", lambda v: _near(v, m, plan) & (v.node != m.node)), lambda v: one(m, v)))
    small = small.select(F.explode(F.transform("all", lambda m: F.struct(m.node.alias("v"), of(m).alias("u")))).alias("e")).select("e.*").where("u IS NOT NULL")
    m, least = F.col("m"), F.col("least")
    large = index.where(F.col("n") > pairwise).select(m.node.alias("v"), F.when(_near(least, m, plan) & (least.node != m.node), one(m, least)).alias("u"))
    met = small.unionByName(large).groupBy("v").agg(F.collect_set("u").alias("u"))
    return met.select("v", F.slice(F.array_sort("u"), 1, CLOSEST)["u"].alias("u"))


def _between(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(u, v, a, b, apart): each pair of nodes of two components (``root``) within the complete distance that any bucket holds, once.

    a and b are the two components, the smaller first, and apart is the distance.

    Buckets of one component are left out, and in the others what is in another component than the least meets every member.
    A pair is told in the first of its buckets alone: the first table, there the first equal part, there the least point of both balls.
    """
    bucket = W.partitionBy("route", "rest")
    index = _buckets(nodes, plan, "root", "segments")
    index = index.select("route", "rest", "m", F.min("m.root").over(bucket).alias("lo"), F.max("m.root").over(bucket).alias("hi")).where("lo <> hi").drop("hi")
    other = index.where("m.root <> lo").select("route", "rest", F.col("m").alias("a"))
    parts = plan.parts()
    a, b = F.col("a.segments"), F.col("m.segments")
    table = F.shiftright("route", plan.bits).cast("int")
    first = F.array_position(F.transform(F.arrays_zip(F.slice(a, 1, plan.tables).alias("x"), F.slice(b, 1, plan.tables).alias("y")), lambda z: F.bit_count(z.x.bitwiseXOR(z.y)) <= 2), F.lit(True))
    x, y = (F.get(c, F.floor(table / 3).cast("int")) for c in (a, b))
    differ = x.bitwiseXOR(y)
    part = F.when(differ.bitwiseAND(F.lit(parts[0])) == 0, 0).when(differ.bitwiseAND(F.lit(parts[1])) == 0, 1).otherwise(2)
    rest = F.lit((1 << plan.bits) - 1).bitwiseXOR(F.element_at(F.array(*(F.lit(k).cast("long") for k in parts)), table % 3 + 1))
    both = x.bitwiseAND(y)
    # of two bits that differ on one side alone, a point within 1 of both has one of them
    lone = F.when((F.bit_count(differ) == 2) & ((both == x) | (both == y)), differ.bitwiseAND(-differ)).otherwise(F.lit(0).cast("long"))
    told = (
        (F.col("a.root") != F.col("m.root"))
        & ((F.col("m.root") == F.col("lo")) | (F.col("a.node") < F.col("m.node")))
        & _near(F.col("a"), F.col("m"), plan)
        & (_apart(a, b) <= plan.radius(plan.bits * plan.tables + 64 * CHECKED))
        & (first == F.floor(table / 3) + 1)
        & (part == table % 3)
        & (both.bitwiseOR(lone).bitwiseAND(rest) == F.col("rest"))
    )
    met = other.join(index, ["route", "rest"]).where(told)
    of = lambda f, n, name: f(F.col(f"a.{n}"), F.col(f"m.{n}")).alias(name)
    return met.select(of(F.least, "node", "u"), of(F.greatest, "node", "v"), of(F.least, "root", "a"), of(F.greatest, "root", "b"), _apart(a, b).alias("apart"))


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of the pairs (u, v), each side made distinct before both are."""
    return pairs.select(F.col("u").alias("node")).distinct().union(pairs.select("v").distinct()).distinct()


def _sets(ws: Workspace, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, name: str) -> DataFrame:
    """(node, set): the shingles of every node of the pairs."""
    rows = ws.save(nodes.join(_ends(pairs), "node").select("node", "first.doc_id", "first.t1", "first.t2"), f"ends-{name}")

    def run(batches):
        for b in batches:
            sets, ids = [], []
            for t in b.column("text"):
                w = (t.as_py() or b"").lower().split()
                sets.append(shingles(w, words).view(np.int64))
                ids.append(_hash(b" ".join(w)) if w else 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    read = join_rows(texts(docs), rows.drop("node"), "left_semi").select(F.col("text").cast("binary").alias("text"))
    return ws.save(read.mapInArrow(run, "node bigint, set array<bigint>").dropDuplicates(["node"]), f"sets-{name}")


def _alike(ws: Workspace, pairs: DataFrame, sets: DataFrame, similarity: float, name: str) -> DataFrame:
    """Of distinct pairs (u, v) those whose sets of shingles are as similar as asked."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("set").alias(f"s{k}"))
    common = F.size(F.array_intersect("su", "sv"))
    like = common >= similarity * (F.size("su") + F.size("sv") - common)
    return ws.save(pairs.join(side("u"), "u").join(side("v"), "v").where(like).select("u", "v"), f"alike-{name}")


def _open(ws: Workspace, closest: DataFrame, alike: DataFrame) -> DataFrame:
    """(a, b, u, v): the rows of ``closest``, one for two components each, whose components the links (u, v) have not joined."""
    joined = closest.join(alike, ["u", "v"]).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = ws.save(connected_components(ws, joined, "joined"), "joined")
    root = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))
    return closest.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "u", "v")


def _links(ws: Workspace, docs: DataFrame, nodes: DataFrame, words: int, similarity: float, plan: Plan, pairwise: int) -> DataFrame:
    """Edges (u, v) between nodes, enough for the components that all links make.

    First each node is compared with the closest of those it is near to by sketch. The components of what links there need
    no pairs of their own any more. Of two components the closest pair is compared next, and all their others unless links
    have joined the two by then. Nothing is left out. A family whose members link costs work linear in them; one whose members
    are near in bits and do not link can cost more.
    """
    met = ws.save(_met(nodes, plan, pairwise), "met")
    near = met.select("v", F.explode("u").alias("u")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    near = ws.save(near.distinct(), "near")
    links = _alike(ws, near, _sets(ws, docs, nodes, near, words, "1"), similarity, "1")
    roots = ws.save(connected_components(ws, links, "stars"), "roots")
    # a node that is near no other in any bucket has no pair
    rooted = nodes.join(met.select(F.col("v").alias("node")), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = ws.save(rooted.select("node", "sketch", "segments", "root"), "rooted")
    # both sides of the join are dealt by route already, which is part of its key: with this they are not dealt anew by all of it
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = nodes.sparkSession.conf.get(setting, "true")
    nodes.sparkSession.conf.set(setting, "false")
    try:
        more = ws.save(_between(rooted, plan), "more")
    finally:
        nodes.sparkSession.conf.set(setting, before)
    sets = _sets(ws, docs, nodes, more, words, "2")
    closest = more.groupBy("a", "b").agg(F.min_by(F.struct("u", "v"), F.struct("apart", "u", "v")).alias("e"))
    closest = ws.save(closest.select("a", "b", "e.*"), "closest")
    alike = _alike(ws, closest.select("u", "v"), sets, similarity, "2")
    told = _open(ws, closest, alike).select("a", "b", F.col("u").alias("x"), F.col("v").alias("y"))
    rest = more.join(told, ["a", "b"]).where("u <> x OR v <> y").select("u", "v")
    stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return stars.unionByName(alike).unionByName(_alike(ws, rest, sets, similarity, "3"))


def _groups(docs: DataFrame, words: int, similarity: float, recall: float, pairwise: int) -> tuple[Workspace, DataFrame]:
    """(doc_id, t1, t2, least) of every row; least is the first row of the group, by doc_id, null last, and then by hash."""
    ws = Workspace(docs.sparkSession)
    plan = Plan.of(docs.count(), similarity, recall)
    rows = ws.save(_fingerprints(docs, words, plan), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    whole = F.any_value("sketch").alias("sketch"), F.any_value("segments").alias("segments")
    nodes = ws.save(rows.groupBy("node").agg(F.min(order).alias("first"), *whole), "nodes")
    roots = connected_components(ws, _links(ws, docs, nodes, words, similarity, plan, pairwise)).withColumnRenamed("node", "of")
    placed = nodes.join(roots, nodes.node == roots.of, "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    placed = ws.save(placed.join(least, "root").select("node", "least"), "placed")
    return ws, rows.select("doc_id", "t1", "t2", "node").join(placed, "node").drop("node")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.98, pairwise: int = PAIRWISE) -> DataFrame:
    """(doc_id, component_id) for every row: the smallest doc_id that links reach.

    Two texts link if the sets of their shingles of ``words`` words, A-Z lower-cased, have a Jaccard similarity of at least
    ``similarity``; a pair at that threshold is found with a chance of ``recall`` or more, an equal one always. A text of fewer
    words is one shingle. Texts without words, null ones included, are alike. A null doc_id counts as larger than any other.
    Repeated rows are rows of their own. Texts are read whole, other columns are passed over, an empty table gives none.
    """
    rows = _groups(docs, words, similarity, recall, pairwise)[1]
    return rows.select("doc_id", F.col("least.doc_id").alias("component_id"))


def one_of_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.98, pairwise: int = PAIRWISE) -> DataFrame:
    """The documents, with all their columns, of which one row of each group of ``near_copies`` stays: that of its smallest doc_id.

    Rows are told apart by doc_id and text. Of rows alike in both that are a group's first, one stays, whichever it is.
    """
    ws, rows = _groups(docs, words, similarity, recall, pairwise)
    return keep_first(docs, ws, rows)
