"""Near-duplicate classes by min-max hashing, confirmed on whole shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so a
signature of 2p values costs p hash evaluations. Bands of signature values are bucket keys.

Texts with equal sets collapse into one node first. In a bucket nobody meets everybody. First all members meet
one centre. The links found make components; a bucket whose members are in one component is done. Elsewhere a link needs
shared shingles: a member that shares too few with all nodes of other components to reach the threshold can't have one and
leaves. Of the rest, members outside the bucket's largest component are centres, some at a time: they meet the members of other
components with which their counts of shared shingles, in all and by parts of the hash range, allow a link, then leave. So every link inside a bucket is found or lies
within a known component, whatever the bucket's size.
"""
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loadtide.llm.common import cut_lineage, forget, fresh, map_batches, ship, whole_text
from loadtide.llm.shingles import Shingler, mixed

#: Signature values in a band, and bands. A pair at the threshold t is missed with probability (1 - t^4)^24:
#: 2e-8 at 0.85, 3e-6 at 0.8.
BAND_VALUES, BANDS = 4, 24
#: Centres of a bucket, by round after the first; the last value goes on.
CENTRES = (64, 1024)
#: Parts of the hash range in which the items of two sets are counted: the smaller counts bound what they share.
PARTS = 256


class MinMax:
    """Band keys of a set of hashes: minimum and maximum under BANDS * BAND_VALUES / 2 permutations."""

    def __init__(self, bands: int = BANDS, values: int = BAND_VALUES):
        rng = np.random.default_rng(4321)
        self.bands, self.values = bands, values
        self.count = (bands * values + 1) // 2
        self.salt = rng.integers(0, 1 << 63, self.count, dtype=np.uint64)
        self.factor = rng.integers(0, 1 << 63, self.count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.weight = rng.integers(0, 1 << 63, (1, values), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, hashes):
        low = np.full(self.count, np.iinfo(np.uint64).max, dtype=np.uint64)
        high = np.zeros(self.count, dtype=np.uint64)
        for at in range(0, len(hashes), 2048):
            v = (hashes[at:at + 2048, None] ^ self.salt) * self.factor
            np.minimum(low, v.min(axis=0), out=low)
            np.maximum(high, v.max(axis=0), out=high)
        return np.stack([low, high], axis=1).ravel()[:self.bands * self.values]

    def keys(self, hashes):
        s = mixed(self.signature(hashes)).reshape(self.bands, self.values)
        return mixed((s * self.weight).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, node and node2 (two hashes of the whole set), bands (null for an empty set)."""
    shingler, minmax = Shingler(words), MinMax()

    def run(batch):
        sets = shingler.sets([x.encode() for x in batch.column(1).to_pylist()])
        return {"doc_id": batch.column(0), "text_key": batch.column(2), "n_shingles": [len(s) for s in sets],
                "node": [int(mixed(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                "node2": [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets],
                "bands": [minmax.keys(s) if len(s) else None for s in sets]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("text_key")), run,
                       "doc_id long, text_key long, n_shingles long, node long, node2 long, bands array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, its whole set, and how many of its items fall into each of PARTS parts of the hash range."""
    shingler = Shingler(words)

    def run(batch):
        sets = shingler.sets([x.encode() for x in batch.column(0).to_pylist()])
        return {"node": [int(mixed(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                "items": [s.view(np.int64) for s in sets],
                "parts": [np.bincount((s % np.uint64(PARTS)).astype(np.int64), minlength=PARTS) for s in sets]}

    return map_batches(docs.select(whole_text().alias("text")), run, "node long, items array<long>, parts array<int>")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node -> root (smallest node of its component), for nodes other than roots, by alternating stars.

    ``edges`` has columns a, b. A large star hangs each node's larger neighbours on its smallest one, a small
    star does it with the smaller ones. Each pass is written to the shared folder; the loop ends when every node hangs on one root.
    """
    now, first = edges.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b"), True
    while True:
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").selectExpr("b AS a", "m AS b").repartition("a")  # dealt once for minimum and join
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
                                            .alias("e")).select("e.*").filter("a <> b").distinct()
        before, now = now, cut_lineage(small, label)
        if not first:                                                # the first one is the caller's
            forget(before)
        first = False
        ends = now.selectExpr("a AS node", "1 AS below", "0 AS above").unionByName(now.selectExpr("b AS node", "0 AS below", "1 AS above"))
        if not ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 OR below = 1 AND above = 1").count():
            out = now.selectExpr("a AS node", "b AS root")
            out.scratch = now.scratch
            return out


def _several(members: DataFrame, key: str) -> DataFrame:
    """Members of buckets that hold more than one value of ``key``."""
    more = members.groupBy("band").agg(F.min(key).alias("_a"), F.max(key).alias("_b")).filter("_a <> _b").select("band")
    return members.join(more, "band")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs c, nc, x, nx whose whole sets are alike enough."""
    asked = pairs.filter(f"100 * least(nc, nx) >= {percent} * greatest(nc, nx)")
    met = (asked.join(sets.select(F.col("node").alias("x"), F.col("items").alias("ix")), "x")
           .join(sets.select(F.col("node").alias("c"), F.col("items").alias("ic")), "c")
           .withColumn("common", F.size(F.array_intersect("ix", "ic"))))
    return met.filter(f"100 * common >= {percent} * (nc + nx - common)")


def node_roots(nodes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """node -> root (smallest node of its component), for nodes other than roots, by links with 100 * intersection >= percent * union."""
    members = nodes.select(F.explode("bands").alias("band"), "node", F.col("n_shingles").alias("n"), F.col("node").alias("root"))
    members = cut_lineage(_several(members, "node"), "members")
    wanted = nodes.join(members.select("node"), "node", "left_semi").select("doc_id")
    sets = cut_lineage(full_sets(docs.join(wanted, "doc_id", "left_semi"), words), "sets")
    centre = members.groupBy("band").agg(F.min_by(F.struct("node", "n"), "node").alias("c")).selectExpr("band", "c.node AS c", "c.n AS nc")
    pairs = members.join(centre, "band").filter("c <> node").selectExpr("c", "nc", "node AS x", "n AS nx")
    edges = cut_lineage(_links(pairs.repartition("x").distinct(), sets, percent).selectExpr("x AS a", "c AS b"), "edges")
    more = nodes.select("node", "bands").join(sets.select("node", "parts").dropDuplicates(["node"]), "node")
    known, stale = None, [members]                                   # tables that the next round's make useless
    for round_ in itertools.count():                                 # each round takes centres out of every open bucket
        moved = components(edges)                                    # after the first round, components of former roots
        known, before = moved if known is None else _followed(known, moved), known
        members = _open_members(members, moved, sets, percent)
        forget(edges, *stale, *([before, moved] if before is not None else []), shuffles=round_ % 4 == 3)
        if members.isEmpty():
            forget(members, sets)
            return known
        band = W.partitionBy("band")
        rank = F.row_number().over(band.orderBy("node"))
        centre = (members.filter("asks").withColumn("_r", rank).filter(F.col("_r") <= CENTRES[min(round_, len(CENTRES) - 1)])
                  .withColumn("last", F.max("node").over(band)).selectExpr("band", "last", "node AS c", "n AS nc", "root AS root_c", "reach AS reach_c")
                  .join(more.selectExpr("node AS c", "bands AS bands_c", "parts AS parts_c"), "c"))
        centre = cut_lineage(centre, "centres")
        # Two members of several buckets meet in the first of these only, and two centres once.
        first = "coalesce(" + ", ".join(f"IF(get(bands_c, {i}) = get(bands, {i}), get(bands, {i}), NULL)" for i in range(BANDS)) + ")"
        common = "aggregate(zip_with(parts_c, parts, (p, q) -> least(p, q)), 0, (a, x) -> a + x)"
        pairs = (members.join(more, "node").join(centre, "band")
                 .filter(f"root <> root_c AND NOT (asks AND node <= last AND node < c) AND {_may_link('least(reach, reach_c)', 'nc', 'n', percent)} "
                         f"AND {first} = band AND {_may_link(common, 'nc', 'n', percent)}")
                 .selectExpr("c", "nc", "node AS x", "n AS nx", "root AS a", "root_c AS b"))
        edges = cut_lineage(_links(pairs, sets, percent).select("a", "b").distinct(), "edges")
        stale = [members, centre]
        members = members.join(centre.select("band", F.col("c").alias("node")), ["band", "node"], "left_anti").select("band", "node", "n", "root")


def _followed(roots: DataFrame, moved: DataFrame) -> DataFrame:
    """node -> root after some roots got roots of their own."""
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return cut_lineage(roots.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root")).unionByName(moved), "roots")


def _may_link(reach: str, n: str, other: str, percent: int) -> str:
    """Can sets of n and ``other`` items be alike enough when they share ``reach`` items at most?"""
    return f"(100 + {percent}) * {reach} >= {percent} * ({n} + {other})"


def _open_members(members: DataFrame, moved: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """band, node, n, root, reach, asks, written, for buckets in which a link between two components may be left.

    ``members`` has the former roots, ``moved`` (node -> root) what became of them. reach is how many of a node's shingles occur in any
    other component. Members whose reach can't make a link in the bucket are left out. asks: the node is outside the bucket's largest
    component, so it is for it to meet the others.
    """
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    rooted = members.join(to, "root", "left").select("band", "node", "n", F.coalesce("_to", "root").alias("root"))
    rooted = cut_lineage(_several(rooted, "root"), "rooted")
    everyone = rooted.groupBy("node").agg(F.min("root").alias("root"))  # a node has one root
    items = cut_lineage(sets.join(everyone, "node").select("node", "root", "items"), "items")
    shared = (items.select("root", F.explode("items").alias("item")).groupBy("item")
              .agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("item"))
    reach = (items.select("node", F.explode("items").alias("item")).join(shared, "item", "left_semi").groupBy("node").agg(F.count("*").alias("reach")))
    sized = rooted.groupBy("band", "root").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    largest = sized.groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.min("least").alias("least"))
    state = rooted.join(reach, "node").join(largest, "band").filter(_may_link("reach", "n", "greatest(least, reach)", percent))
    state = state.withColumn("asks", F.col("root") != F.col("largest")).select("band", "node", "n", "root", "reach", "asks")
    out = cut_lineage(_several(state, "root"), "open")
    forget(rooted, items)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of its class), kept (doc_id = component_id), one row per row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored. A null text is empty. An empty text has no shingles
    and is its own class. Rows without a doc_id are linked to nothing: component_id and kept are null. Rows
    that repeat a doc_id get the class of their own text. Two texts count as equal sets when two 64-bit hashes of the sets agree.
    """
    return _classified(docs, percent, words).drop("text_key")


def _classified(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Like near_duplicates, with text_key."""
    signed = cut_lineage(signatures(docs, words), "signatures")
    nodes = (signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node", "node2", "n_shingles")
             .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    nodes = cut_lineage(nodes, "nodes")
    roots = node_roots(nodes, docs.withColumn("doc_id", F.col("doc_id").cast("long")), percent, words)
    rooted = (nodes.select("node", "node2", "n_shingles", "doc_id").join(roots, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    heads = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = cut_lineage(rooted.join(heads, "root").select("node", "node2", "n_shingles", "component_id"), "classes")
    forget(roots, nodes)
    return (signed.select("doc_id", "text_key", "node", "node2", "n_shingles").join(classes, ["node", "node2", "n_shingles"], "left")
            .select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, that with the smallest doc_id.

    Repeated rows (same doc_id and text) are copies: one stays. Of rows that repeat a doc_id with other texts each goes or stays by the class of its own text.
    Rows without a doc_id stay.
    """
    found = _classified(docs, percent, words)
    gone, gone_key, key = fresh(docs, "_gone"), fresh(docs, "_gone_key"), fresh(docs, "_key")
    dropped = cut_lineage(found.filter("NOT kept").select(F.col("doc_id").alias(gone), F.col("text_key").alias(gone_key)).distinct(), "gone")
    named = docs.filter("doc_id IS NOT NULL")
    kept = (named.join(dropped, (named["doc_id"].cast("long") == dropped[gone]) & (F.xxhash64(whole_text()) == dropped[gone_key]), "left_anti")
            .withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key))
    return kept.unionByName(docs.filter("doc_id IS NULL"))


ship(__name__)
