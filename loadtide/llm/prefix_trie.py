"""The prefix trie of all conversations, from double-array tries of shards.

A turn is a 20-byte code: 16 bytes of a SHA-256 of role and text, and its number of words. A conversation's turns in order are
one byte string, its path; texts stay where they are. Equal paths collapse into one. The distinct paths are sorted over
all partitions and cut into shards of neighbours, so that a shard holds the paths of a range of prefixes. Each shard numbers its turns
densely and packs BASE and CHECK arrays; walking them gives its nodes and their sums.

Only nodes on a shard's first or last path can also stand in another shard, and exactly those no deeper than what that path
shares with its neighbour there. Every sum of a node is additive over shards once a shard knows these two depths: a node is counted
with its number of members in all shards, its own subtraction in the first shard that holds it, and a shared node always has a child.
So the shared nodes' parts are added globally, once; all others are final where they are found.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loadtide.llm.common import cut_lineage, ship

#: Bytes of a turn's code: identity, then number of words.
IDENTITY, CODE = 16, 20
#: Turns of the distinct paths of a shard, beyond which the next path opens another one.
SHARD_TURNS = 50_000
#: Gaps that are tried for a run of siblings before it goes behind the arrays' end.
TRIES = 256
NO_END = hashlib.sha256(b"").hexdigest()
NODE = "shard long, shared boolean, parent_shared boolean, id binary, parent_id binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class DoubleArray:
    """A trie over rows of dense symbols. State 0 is the root; the child of s by symbol c is BASE[s] + c if CHECK there is s."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Row i is symbols[starts[i]:][:lengths[i]]. Symbols are numbered anew by first use, so that siblings lie close together."""
        self.code = np.full(int(symbols.max()) + 1 if len(symbols) else 0, -1, dtype=np.int64)
        self.codes = 0
        self.base, self.check = np.zeros(64, dtype=np.int64), np.full(64, -1, dtype=np.int64)
        self.check[0], self.end, self.gaps = 0, 1, np.zeros(0, dtype=np.int64)
        rows, state, depth = np.flatnonzero(lengths > 0), np.zeros(len(lengths), dtype=np.int64), 0
        while len(rows):
            symbol = symbols[starts[rows] + depth]
            self._grow(state[rows], symbol)
            state[rows] = self.base[state[rows]] + self.code[symbol]
            depth += 1
            rows = rows[lengths[rows] > depth]

    def _room(self, size: int):
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])

    def _grow(self, parents, symbols):
        """Give the states ``parents`` (new ones, in order) their children: all of one level."""
        fresh = np.flatnonzero(self.code[symbols] < 0)
        if len(fresh):
            _, first = np.unique(symbols[fresh], return_index=True)
            named = symbols[fresh[np.sort(first)]]
            self.code[named] = self.codes + np.arange(len(named))
            self.codes += len(named)
        width = self.codes + 1
        edges = np.unique(parents * width + self.code[symbols])
        parent, code = edges // width, edges % width
        starts = np.flatnonzero(np.diff(parent, prepend=-1))
        sizes = np.diff(starts, append=len(edges))
        self.gaps, self.tried = np.flatnonzero(self.check[:self.end] < 0), 0
        for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            self._place(int(parent[at]), code[at:at + size])
        # Only children take the gaps that runs of siblings left, then the end.
        alone = starts[sizes == 1]
        slots = np.flatnonzero(self.check[:self.end] < 0)[:len(alone)]
        slots = np.concatenate([slots, self.end + np.arange(len(alone) - len(slots))])
        self.end = max(self.end, int(slots[-1]) + 1 if len(slots) else 0)
        self._room(self.end)
        self.base[parent[alone]] = slots - code[alone]
        self.check[slots] = parent[alone]

    def _place(self, parent: int, codes):
        """First fit of a run of siblings among the next gaps, else behind the end."""
        offsets = codes - codes[0]
        if len(self.gaps) - self.tried < TRIES:
            self.gaps, self.tried = np.flatnonzero(self.check[:self.end] < 0), 0
        self._room(self.end + int(offsets[-1]) + 1)
        some = self.gaps[self.tried:self.tried + TRIES]
        fits = np.flatnonzero((self.check[some[:, None] + offsets] < 0).all(axis=1))
        at = int(some[fits[0]]) if len(fits) else self.end
        self.tried += 1 if len(fits) else TRIES // 4
        self.base[parent] = at - codes[0]
        self.check[at + offsets] = parent
        self.end = max(self.end, at + int(offsets[-1]) + 1)

    def step(self, states, symbols):
        """States behind ``states`` by known symbols; -1 where the trie has no such turn."""
        to = self.base[states] + self.code[symbols]
        inside = (to >= 0) & (to < self.end) & (states >= 0) & (self.code[symbols] >= 0)
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)

    def traverse(self, symbols, starts, lengths):
        """Walk all rows side by side: (depth, rows that go so far, their states) from the root on."""
        rows, state, depth = np.arange(len(lengths)), np.zeros(len(lengths), dtype=np.int64), 0
        while len(rows):
            yield depth, rows, state[rows]
            rows = rows[lengths[rows] > depth]
            state[rows] = self.step(state[rows], symbols[starts[rows] + depth])
            depth += 1


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common from the start on."""
    if a[:CODE] != b[:CODE]:
        return 0
    n = min(len(a), len(b)) // CODE
    x, y = (np.frombuffer(p, dtype=np.uint8, count=n * CODE).reshape(n, CODE) for p in (a, b))
    differ = (x != y).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def shard_nodes(paths: list, weights, smallest, ends: list, left: int, right: int) -> dict:
    """Columns of the nodes of a shard. ``paths`` are sorted; its first one has ``left`` turns in common with the path before the shard, its
    last one ``right`` with the path behind it (-1: there is none)."""
    codes = np.frombuffer(b"".join(paths), dtype=np.uint8).reshape(-1, CODE)
    lengths = np.array([len(p) // CODE for p in paths], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    words = codes[:, IDENTITY:].copy().view(">u4").ravel().astype(np.int64)
    _, symbols = np.unique(codes[:, :IDENTITY].copy().view("V16").ravel(), return_inverse=True) if len(codes) else (None, np.zeros(0, dtype=np.int64))
    trie = DoubleArray(symbols, starts, lengths)
    n, low = np.zeros(trie.end, dtype=np.int64), np.full(trie.end, np.iinfo(np.int64).max)
    last_words, depths = np.zeros(trie.end, dtype=np.int64), np.full(trie.end, -1, dtype=np.int64)
    end_of, levels, first_path, last_path = np.zeros(len(paths), dtype=np.int64), [], [], []
    for depth, rows, states in trie.traverse(symbols, starts, lengths):
        np.add.at(n, states, weights[rows])
        np.minimum.at(low, states, smallest[rows])
        if depth:
            last_words[states] = words[starts[rows] + depth - 1]
        depths[states] = depth
        end_of[rows] = states
        levels.append(np.unique(states))
        if rows[0] == 0:
            first_path.append(int(states[0]))
        if rows[-1] == len(paths) - 1:
            last_path.append(int(states[-1]))
    owned, shared, goes_on = np.ones(trie.end, dtype=bool), np.zeros(trie.end, dtype=bool), np.zeros(trie.end, dtype=bool)
    owned[first_path[:left + 1]] = False
    goes_on[last_path[:right + 1]] = True
    shared[first_path[:left + 1]] = shared[last_path[:right + 1]] = True
    nodes = np.concatenate(levels)
    inner = nodes[nodes != 0]
    children, offspring = np.zeros(trie.end, dtype=np.int64), np.zeros(trie.end, dtype=bool)
    offspring[trie.check[inner]] = True
    np.add.at(children, trie.check[inner[owned[inner]]], 1)
    leaves = (~offspring & ~goes_on).astype(np.int64)
    saved = n * last_words - np.where(owned, last_words, 0)
    for level in reversed(levels[1:]):
        np.add.at(leaves, trie.check[level], leaves[level])
        np.add.at(saved, trie.check[level], saved[level])
    ids = {}
    for path, states, upto in ((paths[0], first_path, left), (paths[-1], last_path, right)):
        digest = hashlib.sha256()
        for depth, state in enumerate(states[:upto + 1]):
            digest.update(path[(depth - 1) * CODE:depth * CODE] if depth else b"")
            ids[state] = digest.digest()[:IDENTITY]
    sha = dict(zip(end_of.tolist(), ends))
    up = np.where(nodes == 0, -1, trie.check[nodes])
    from_shared = (up >= 0) & shared[up]
    return {"shared": shared[nodes], "parent_shared": from_shared, "id": [ids.get(s) for s in nodes.tolist()],
            "parent_id": [ids[s] if y else None for s, y in zip(up.tolist(), from_shared.tolist())], "depth": depths[nodes], "conv_id": low[nodes],
            "parent_conv_id": pa.array(low[up], mask=(up < 0) | from_shared), "n_convs": n[nodes], "n_children": children[nodes],
            "n_leaves": leaves[nodes], "saved_tokens": saved[nodes], "ends_sha256": [sha.get(s) for s in nodes.tolist()]}


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path: the first h turns of the conversation's head (the multiple of 20 at or before it), then its own behind its first h."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).filter("conv_id IS NOT NULL")
             .withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))))
    identity = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * IDENTITY)
    words = F.lpad(F.hex(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), 2 * (CODE - IDENTITY), "0")
    coded = turns.select("conv_id", "place", F.concat(identity, words).alias("code"))
    own = coded.groupBy("conv_id").agg(F.expr("unhex(array_join(transform(array_sort(collect_list(struct(place, code))), x -> x.code), ''))").alias("path"))
    own = cut_lineage(own, "paths")
    heads = own.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("head"), F.expr(f"substring(path, 1, {3 * CODE})").alias("upper"))
    joined = own.join(heads, F.expr("conv_id - conv_id % 20 = head"), "left").withColumn("h", F.expr("cast(crc32(cast(conv_id AS string)) % 4 AS int)"))
    return joined.select("conv_id", F.expr(f"concat(substring(coalesce(upper, X''), 1, {CODE} * h), substring(path, {CODE} * h + 1))").alias("path"))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """path, n, smallest, ends: the paths, how many conversations have each, the smallest and a digest of all their ids.

    The ids of a path pass by in order and only the digest's state is held, so a path of any number of conversations needs no memory.
    """
    schema = pa.schema([("path", pa.binary()), ("n", pa.int64()), ("smallest", pa.int64()), ("ends", pa.string())])

    def run(batches):
        now, n, low, digest = None, 0, 0, None
        for batch in batches:
            done, keys, ids = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                text = ",".join(map(str, ids[at:end])).encode()
                if keys[at] == now:
                    digest.update(b"," + text)
                    n += end - at
                else:
                    if now is not None:
                        done.append((now, n, low, digest.hexdigest()))
                    now, n, low, digest = keys[at], end - at, ids[at], hashlib.sha256(text)
                at = end
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"path": now, "n": n, "smallest": low, "ends": digest.hexdigest()}], schema=schema)

    ordered = paths.select("path", "conv_id").repartition("path").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(run, "path binary, n long, smallest long, ends string")


def _sharded(distinct: DataFrame) -> DataFrame:
    """``distinct`` sorted over all partitions, with part, block (its shard) and lcp: turns in common with the path before it in its part."""
    schema = pa.schema([("path", pa.binary()), ("n", pa.int64()), ("smallest", pa.int64()), ("ends", pa.string()), ("part", pa.int64()), ("block", pa.int64()),
                        ("head", pa.bool_()), ("lcp", pa.int64())])

    def run(batches):
        before, block, size = None, 0, 0
        for batch in batches:
            blocks, heads, lcps = [], [], []
            for path in batch.column(0).to_pylist():
                turns = len(path) // CODE + 1
                opens = before is None or size + turns > SHARD_TURNS
                block, size = (block + (before is not None), turns) if opens else (block, size + turns)
                blocks.append(block)
                heads.append(opens)
                lcps.append(None if before is None else shared_turns(before, path))
                before = path
            cols = [pa.array(c, type=t) for c, t in ((blocks, pa.int64()), (heads, pa.bool_()), (lcps, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=schema)

    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id().cast("long"))
    return ordered.mapInArrow(run, "path binary, n long, smallest long, ends string, part long, block long, head boolean, lcp long")


def _edges(sharded: DataFrame) -> DataFrame:
    """part, block, left, right: turns that a shard's first and last path have in common with the paths before and behind it; -1 where there is none."""
    order = W.orderBy("part")                                        # a row a partition
    parts = (sharded.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"), F.max("block").alias("last_block"))
             .select("part", "first", "last_block", F.lag("last").over(order).alias("before"), F.lead("part").over(order).alias("next_part")))

    def common(batches):
        for batch in batches:
            found = [-1 if b is None else shared_turns(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4), pa.array(found, type=pa.int64())],
                                             names=["part", "last_block", "next_part", "first_left"])

    parts = cut_lineage(parts.mapInArrow(common, "part long, last_block long, next_part long, first_left long"), "parts")
    heads = sharded.filter("head").select("part", "block", "lcp").join(parts, "part")
    lefts = cut_lineage(heads.select("part", "block", F.coalesce("lcp", "first_left").alias("left"),
                                     F.when(F.col("block") < F.col("last_block"), F.col("part")).otherwise(F.col("next_part")).alias("to_part"),
                                     F.when(F.col("block") < F.col("last_block"), F.col("block") + 1).otherwise(0).alias("to_block")), "lefts")
    nexts = lefts.select(F.col("part").alias("to_part"), F.col("block").alias("to_block"), F.col("left").alias("right"))
    return lefts.join(nexts, ["to_part", "to_block"], "left").select("part", "block", "left", F.coalesce("right", F.lit(-1)).alias("right"))


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` needs conv_id, turn, role and text; other columns are ignored. Turns are ordered by turn (null first), ties by role, then text; a repeated row
    is one more turn. A null role or text is empty. Rows without a conv_id belong to no conversation. An empty table has no nodes, not even a root.
    A conversation's codes, 20 bytes a turn, are one value of a row (up to 2 GB); its texts, of any length, are only hashed and counted. Turns are told apart by 128 bits of SHA-256.
    """
    distinct = distinct_paths(rebuilt_paths(conversations))
    sharded = cut_lineage(_sharded(distinct), "sharded")
    kinds = [c.split() for c in NODE.split(", ")]
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(name, arrow[kind]) for name, kind in kinds])

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("path")
        one = rows.slice(0, 1).to_pylist()[0]
        cols = shard_nodes(rows["path"].to_pylist(), rows["n"].to_numpy(), rows["smallest"].to_numpy(), rows["ends"].to_pylist(), one["left"], one["right"])
        cols["shard"] = np.full(len(cols["depth"]), one["part"] << 32 | one["block"])
        return pa.Table.from_arrays([cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)

    found = sharded.drop("head", "lcp").join(_edges(sharded), ["part", "block"]).groupBy("part", "block").applyInArrow(build, NODE)
    return _merged(cut_lineage(found, "nodes"))


def _merged(nodes: DataFrame) -> DataFrame:
    """Add up the parts of shared nodes and name the parents."""
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = nodes.filter("shared")
    upper = parts.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_id").alias("parent_id"), *sums,
                                    F.max("ends_sha256").alias("ends_sha256"))
    upper = cut_lineage(upper, "upper")
    named = upper.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    tops = upper.join(named, "parent_id", "left").select(out)
    own = nodes.filter("NOT shared")
    # Each shard gets the names of its own shared nodes, so that a node with many children is no hot key.
    local = parts.select("shard", F.col("id").alias("parent_id")).join(named, "parent_id")
    below = own.filter("parent_shared").drop("parent_conv_id").join(local, ["shard", "parent_id"]).select(out)
    every = own.filter("NOT parent_shared").select(out).unionByName(below).unionByName(tops)
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_END)))


ship(__name__)
