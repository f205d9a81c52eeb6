import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loadtide.llm import prefix_trie
from loadtide.llm.prefix_trie import DoubleArray, trie_nodes

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_nodes(rows):
    """The contract, conversation by conversation."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids = {p: sum(len(q) == len(p) + 1 and q[:len(p)] == p for q in nodes) for p in nodes}
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0) for q in below)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(kids[q] == 0 for q in below), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows):
    got = trie_nodes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return sorted([(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got], key=str)


@pytest.mark.parametrize("turns", [1, 7, 50_000])
def test_nodes_in_shards_of_any_size(spark, monkeypatch, turns):
    """Long shared beginnings, copies, beginnings of others, a deep conversation: every shard border cuts through upper nodes."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    rng = random.Random(turns)
    rows = []
    for c in range(90):
        path = [rng.choice("ab") + " x" * rng.randrange(3) for _ in range(rng.randrange(1, 7))] if c % 3 else ["hot turn", "a", "b x"][:1 + c % 4]
        rows += [(c, i, rng.choice(["user", "assistant"]) if c % 5 == 0 else "user", t) for i, t in enumerate(path)]
    rows += [(101, i, "user", f"deep {i}") for i in range(60)] + [(c, 0, "user", "same") for c in range(120, 160)]
    assert nodes(spark, rows) == plain_nodes(rows)


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(1, None, None, "a b"), (1, 2, "user", None), (1, 2, "assistant", "z"), (1, 2, "assistant", "z"), (2, 0, "user", ""), (None, 0, "user", "x"), (3, 5, "", "a b"),
            (-7, 0, "user", "neg"), (40, 1, "r", "w " * 3000)]
    assert nodes(spark, rows) == plain_nodes(rows)
    df = spark.createDataFrame([(*r, 9, b"x") for r in rows], SCHEMA + ", depth int, path binary")
    assert trie_nodes(df).count() == len(plain_nodes(rows))


def test_empty_table(spark):
    assert trie_nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_arrays_hold_exactly_the_given_rows():
    """BASE and CHECK lead along every row, and nowhere else."""
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 300, rng.integers(0, 9)) for _ in range(3000)]
    flat, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
    starts = np.cumsum(lengths) - lengths
    trie = DoubleArray(flat, starts, lengths)
    seen = {}
    for depth, which, states in trie.traverse(flat, starts, lengths):
        assert (states >= 0).all()
        for i, s in zip(which.tolist(), states.tolist()):
            assert seen.setdefault(s, tuple(rows[i][:depth])) == tuple(rows[i][:depth])
    prefixes = {tuple(r[:d]) for r in rows for d in range(len(r) + 1)}
    assert len(seen) == len(prefixes) and trie.end < 2 * len(prefixes)
    state = {p: s for s, p in seen.items()}
    for p in list(prefixes)[:500]:
        to = trie.step(np.full(300, state[p]), np.arange(300))
        assert all((t >= 0) == (p + (c,) in prefixes) for c, t in enumerate(to.tolist()))
