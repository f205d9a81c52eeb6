"""Document fingerprints by winnowing.

Every k-gram of characters gets a hash, every window of w hashes gives its smallest one, the rightmost among equals, and the chosen
hashes with their places are the fingerprint: a passage of k + w - 1 characters that two texts share puts at least one hash into both.
Likeness of two fingerprints is the Jaccard similarity of their sets of hashes.

The query pairs each document with the next one by doc_id. Documents are dealt by ranges of doc_id, cut at quantiles; the first document of a range also
goes to the range before, so one shuffle of the texts is all.
"""
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.llm.common import BATCH_ROWS, ship, to_arrow, whole_text

#: Characters of a k-gram and hashes of a window: shared passages of 47 characters are sure to be seen.
GRAM, WINDOW = 16, 32
#: Bytes of text in a range of documents, about: a task reads one, whatever the size of the input.
RANGE_BYTES = 16 << 20


def _mix(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(text, k=GRAM):
    """A 32-bit hash of each k-gram by doubling: a block of 2m characters from two of m. A shorter text is one gram."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    k = min(k, n)
    factor, size = np.uint64(0x9E3779B97F4A7C15), 1
    power = _mix(codes + np.uint64(0x51ED27))
    out, left = None, k
    # k in binary: blocks of 1, 2, 4, ... characters, joined where a bit is set.
    at = 0
    while left:
        if left & 1:
            part = power[at:]
            out = part[:n - k + 1] if out is None else _mix(out * factor + part[:n - k + 1])
            at += size
        left >>= 1
        if left:
            power = _mix(power[:-size] * factor + power[size:])
            size *= 2
    return _mix(out + np.uint64(k)) >> np.uint64(32)


def winnow(hashes, w=WINDOW):
    """Places of the chosen hashes, ascending."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    w = min(w, n)
    # Smallest hash, then largest place: one number of 64 bits orders both.
    key = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    size = 1
    while 2 * size <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    rest = w - size
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    chosen = np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))
    return chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])].astype(np.int64)


class Fingerprint:
    """Chosen hashes and places of a text."""

    def __init__(self, text):
        h = gram_hashes(text)
        self.places = winnow(h)
        self.hashes = h[self.places].astype(np.uint32)
        self.set = np.unique(self.hashes)

    def written(self):
        """Eight hex digits of the hash and eight of the place, for each."""
        pairs = np.empty((len(self.hashes), 2), dtype=">u4")
        pairs[:, 0], pairs[:, 1] = self.hashes, self.places
        return pairs.tobytes().hex()

    def likeness(self, other):
        if not len(self.set) or not len(other.set):
            return 1.0 if len(self.set) == len(other.set) else 0.0
        both = len(np.intersect1d(self.set, other.set, assume_unique=True))
        return both / (len(self.set) + len(other.set) - both)


def edited_text(text, after):
    """The last half of the text (rounded down) replaced by as many first characters of ``after``, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hashes, places (arrays): the fingerprint of each row's whole text; a null text is empty and has none."""
    from loadtide.llm.common import map_batches

    def run(batch):
        prints = [Fingerprint(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "hashes": [p.hashes.astype(np.int64) for p in prints], "places": [p.places for p in prints]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), run, "doc_id long, hashes array<long>, places array<long>")


def _ranges(docs: DataFrame):
    """part, doc_id, text, own (and the number of partitions): documents by ranges of doc_id, and the first of the range after each."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 4 * parts))).first()[0]
    # Null ids come first. A range holds the ids from its cut on; the cast to double keeps their order.
    edges = sorted({float(c) for c in cuts or []}) or [0.0]
    finder = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_id", outputCol="_part", handleInvalid="keep")
    placed = finder.transform(docs.withColumn("_id", F.col("doc_id").cast("double")))
    placed = placed.select(F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("_part").cast("int")).alias("part"), "doc_id", "text")
    firsts = (placed.groupBy("part").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("has_null")).orderBy("part").collect())
    # One row a range: no more than there are partitions.
    copies = [(r["part"], None if r["has_null"] else r["first"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    copies = F.broadcast(spark.createDataFrame(copies, "_p int, _first long, _to int"))
    both = placed.join(copies, (F.col("part") == F.col("_p")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(True).alias("own"))
    to = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_to").alias("part"), F.lit(False).alias("own"))))
    return both.select("doc_id", "text", F.explode(to).alias("to")).select("to.part", "doc_id", "text", "to.own"), parts


def next_pairs(docs: DataFrame, pair, schema: str) -> DataFrame:
    """``pair(doc_id, text, next_text) -> tuple`` for each document and the next by (doc_id, text), the first after the last; null ids first."""
    rows, parts = _ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")))
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kinds = spark.createDataFrame([], schema).schema
    arrow = to_arrow(kinds)

    def run(batches):
        held_, done = None, False                                    # the last own row, whose next one is still to come
        for batch in batches:
            out = []
            for part, doc, text, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held_ is not None and held_[0] == part:
                    if not done:
                        out.append(pair(held_[1], held_[2], text))
                        done = not own
                if own:
                    held_, done = (part, doc, text), False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    # Own rows of a range in order, then the first of the next range.
    dealt = rows.repartition(parts, "part").sortWithinPartitions("part", F.desc("own"), F.asc_nulls_first("doc_id"), "text")
    return dealt.mapInArrow(run, kinds)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored. A null text is empty; two empty fingerprints are alike, an empty one is unlike any other. Rows
    that share a doc_id follow each other in the order of their texts. A single row is its own next.
    """
    def pair(doc, text, after):
        edited = edited_text(text, after)
        own, changed, following = Fingerprint(text), Fingerprint(edited), Fingerprint(after)
        return (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.written(), changed.written(),
                own.likeness(changed), own.likeness(following))

    return next_pairs(docs, pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


ship(__name__)
