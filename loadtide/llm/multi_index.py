"""Nearest neighbours by inner product over an inverted multi-index.

The two halves of a vector are quantised on their own; a pair of centroids is a cell. A query visits cells in the order of the summed
products of its halves with the cells' centroids, by a heap over pairs, until the cells hold a share of all entries, and k + 1 at least. Entries of visited cells
are reranked by their exact product.

Identical vectors are one entry with the smallest ids that a result can need. Entries lie in blocks of neighbouring cells, a large
cell in several; queries lie in blocks too, and a block of queries meets the blocks of entries that hold a cell one of them visits.
"""
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loadtide.llm.common import cut_lineage, ship, to_arrow

#: Centroids a half, vectors that they are fitted on at most (those of smallest hash of the id), and rounds of fitting.
CENTROIDS, SAMPLE, ROUNDS = 64, 8_000, 12
#: Share of the entries that a query's cells hold together.
SHARE = 0.55
#: Entries and queries in a block.
ENTRY_BLOCK, QUERY_BLOCK = 4096, 512


def k_means(x, k, rounds=ROUNDS, seed=5):
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x, c):
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)


def visit(first, second, counts, least):
    """Cells in the order of ``first[i] + second[j]``, by a heap, until their ``counts`` reach ``least``."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y, table = first[a].tolist(), second[b].tolist(), counts[np.ix_(a, b)].tolist()
    heap, out, have = [(-(x[0] + y[0]), 0, 0)], [], 0
    while heap and have < least:
        _, i, j = heapq.heappop(heap)
        if table[i][j]:
            out.append((i, j))
            have += table[i][j]
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
    got = np.array(out, dtype=np.int64).reshape(-1, 2)
    return a[got[:, 0]] * len(y) + b[got[:, 1]]


def _usable(v):
    """Vectors that take part: none of their components null, NaN or infinite, and not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column):
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _mapped(df, fn, schema, rows=4096):
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    kinds = spark.createDataFrame([], schema).schema
    arrow = to_arrow(kinds)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cols = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kinds)


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product (double precision), ties to the smaller id, itself left out.

    ``is_query`` is a condition on ``vectors``. Vectors null, zero or holding null or non-finite components take no part, neither do rows without an id;
    of rows that repeat an id and vector one counts. All vectors have one length. No rows give no result. With fewer candidates all are returned.
    """
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
            .filter(F.col("id").isNotNull() & _usable(F.col("v"))).dropDuplicates(["id", "v"]))
    rows = cut_lineage(rows, "vectors")
    # One of identical vectors can stand in a result only by its k + 1 smallest ids.
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    entries = (rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array(sample)
    half = max(1, sample.shape[1] // 2)
    left = k_means(sample[:, :half], CENTROIDS)
    right = k_means(sample[:, half:], CENTROIDS) if sample.shape[1] > half else np.zeros((1, 0))
    wide = len(right)

    def cells(batch):
        x = _matrix(batch.column(0))
        return {"v": batch.column(0), "ids": batch.column(1), "cell": nearest(x[:, :half], left) * wide + (nearest(x[:, half:], right) if x.shape[1] > half else 0)}

    placed = cut_lineage(_mapped(entries, cells, "v array<double>, ids array<long>, cell int"), "entries")
    counts = np.zeros(len(left) * wide, dtype=np.int64)              # centroids squared: a fixed size
    for r in placed.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    # Neighbouring small cells share a block; a large cell gets as many as it fills.
    start, parts, block, fill = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64), 0, 0
    for c, n in enumerate(counts.tolist()):
        if n > ENTRY_BLOCK:
            block, fill = block + (fill > 0), 0
            start[c], parts[c] = block, -(-n // ENTRY_BLOCK)
            block += int(parts[c])
        else:
            if fill + n > ENTRY_BLOCK:
                block, fill = block + 1, 0
            start[c] = block
            fill += n
    table = spark.createDataFrame([(int(c), int(start[c]), int(parts[c])) for c in np.flatnonzero(counts)], "cell int, first long, parts long")
    blocks = (placed.join(F.broadcast(table), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("ids"), "parts"))
              .groupBy("block").agg(F.collect_list(F.struct("v", "ids", "cell")).alias("e")))
    total = int(counts.sum())
    # The query's own entry may be one of those visited.
    least, grid = max(share * total, min(total, k + 1)), counts.reshape(len(left), wide)

    def probes(batch):
        x, out = _matrix(batch.column(1)), []
        for v in x:
            seen = np.zeros(len(counts), dtype=bool)
            seen[visit(left @ v[:half], right @ v[half:], grid, least)] = True
            out.append(np.packbits(seen).tobytes())
        return {"id": batch.column(0), "v": batch.column(1), "cells": out}

    asked = _mapped(rows.filter("q").select("id", "v"), probes, "id long, v array<double>, cells binary", 256)
    groups = -(-rows.filter("q").count() // QUERY_BLOCK) or 1
    asked = (asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups))).groupBy("group")
             .agg(F.collect_list(F.struct("id", "v", "cells")).alias("asked")))
    asked = cut_lineage(asked, "queries")

    def met(batch):
        out = []
        for group, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            any_cell = np.unpackbits(np.bitwise_or.reduce([np.frombuffer(s, dtype=np.uint8) for s in sets]), count=len(counts)).astype(bool) & (counts > 0)
            out += [(group, b) for b in sorted({int(start[c] + i) for c in np.flatnonzero(any_cell) for i in range(int(parts[c]))})]
        return {"group": [g for g, _ in out], "block": [b for _, b in out]}

    pairs = _mapped(asked.select("group", "asked.cells"), met, "group long, block long", 16)

    def rerank(batch):
        out = []
        for at in range(batch.num_rows):                             # one pair of blocks at a time in memory
            entry, query = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            x, y = np.array([e["v"] for e in entry]), np.array([q["v"] for q in query])
            cell = np.array([e["cell"] for e in entry])
            scores = y @ x.T
            for row, q in zip(scores, query):
                seen = np.flatnonzero(np.unpackbits(np.frombuffer(q["cells"], dtype=np.uint8))[cell])
                if len(seen) > k + 1:
                    limit = np.partition(row[seen], len(seen) - k - 1)[len(seen) - k - 1]
                    seen = seen[row[seen] >= limit - 1e-9]            # ties and rounding stay in
                v = np.array(q["v"])
                near = sorted((-float(np.dot(v, x[i])), j) for i in seen.tolist() for j in entry[i]["ids"] if j != q["id"])
                out += [(q["id"], j, -s) for s, j in near[:k]]
        return {"query_id": [o[0] for o in out], "vec_id": [o[1] for o in out], "score": [o[2] for o in out]}

    joined = pairs.join(blocks, "block").join(asked.select("group", "asked"), "group").select("e", "asked")
    found = _mapped(joined, rerank, "query_id long, vec_id long, score double", 16)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ship(__name__)
