import random
import re
from collections import Counter

import numpy as np
import pytest

from loadtide.llm import collocations as module
from loadtide.llm.collocations import CountAutomaton, collocations, ranges_of, summed, united


def plain(docs, least, covered=80, top=2000):
    """Every phrase of every piece, counted in a dictionary."""
    f, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(4, len(w) - i) + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(a, inside.get(p[i:i + m], 0))
        rows = []
        for p, a in cand.items():
            if p in inside and 100 * inside[p] >= covered * a:
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, n, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(30)] + ["É", "straße", "漢字", "a\x01b", "|", "a-b", "x\xa0y"]
    fixed = ["New  York\tcity hall", "of the", "one two three four five six", "straße É w1"]
    docs = []
    for d in range(300):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choices(vocab, [1 / (i + 1) for i in range(len(vocab))])[0] for _ in range(rng.randrange(60))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; "]) for p in parts)
        docs.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return docs + [("en", None), ("en", ""), ("fr", "..., !"), ("hot", "the the the the " * 400), ("hot", "the of " * 300)] + [("copy", "same text of the copies. again")] * 60


@pytest.mark.parametrize("shard, size", [(2_000_000, 1_000_000), (97, 50), (40, 7)])
def test_against_plain_counting(spark, monkeypatch, shard, size):
    """Shards that cut texts, ranges of a few windows and prefixes that are dealt over many ranges."""
    monkeypatch.setattr(module, "SHARD_WORDS", shard)
    monkeypatch.setattr(module, "BLOCK", shard * 3)
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "lang string, text string, rank int, score double").repartition(3)
    got = collocations(df, least=10, range_windows=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 10)


def test_limit_and_cover(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(tuple(r) for r in collocations(df, least=5, covered=50, top=7).collect()) == plain(docs, 5, 50, 7)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_automata_hold_counts_share_states_and_add_up():
    rng = np.random.default_rng(3)

    def some(n):
        rows = rng.integers(1, 12, (n, 4)).astype(np.int32)
        for k in (1, 2, 3):
            rows[rng.random(n) < 0.2, k:] = 0
        return summed(rows, np.ones(n, dtype=np.int64))

    words = [f"{i:02}".encode() for i in range(1, 12)]
    made = [some(n) for n in (0, 1, 50, 4000)]
    for rows, counts in made:
        a, w = CountAutomaton.from_bytes(CountAutomaton(rows, counts).to_bytes(words))
        assert w == words
        want = Counter({tuple(r): n for r, n in zip(rows.tolist(), counts.tolist())})
        if len(rows):
            assert Counter({tuple(r): int(n) for r, n in zip(*a.rows())}) == want
        asked = rng.integers(1, 13, (500, 4)).astype(np.int32)
        assert a.compose(asked).tolist() == [want[tuple(r)] for r in asked.tolist()]
        for k, (prefix, weight, _) in enumerate(a.prefixes(), 1):
            for p, n in zip(prefix.tolist(), weight.tolist()):
                assert n == sum(c for r, c in want.items() if list(r[:k]) == p[:k])
        assert a.root == 0 or len(np.unique(np.stack([a.symbol, a.weight, a.target]), axis=1).T) <= len(a.symbol)
    blobs = [CountAutomaton(*m).to_bytes(words) for m in made]
    total = Counter()
    for rows, counts in made:
        total.update({tuple(r): n for r, n in zip(rows.tolist(), counts.tolist())})
    w, a = united(blobs)
    assert w == words and Counter({tuple(r): int(n) for r, n in zip(*a.rows())}) == total
    tails = np.array([[i, 5, 6, 7] for i in range(1, 100)], dtype=np.int32)
    assert len(CountAutomaton(tails, np.ones(99, dtype=np.int64)).offset) - 1 == 5     # one state a length, and the one without arcs


def test_ranges_are_bounded():
    full = np.array([5, 3, 100, 0, 2, 9, 9, 1])
    ranges, shares = ranges_of(full, 10)
    assert shares.tolist() == [1, 1, 10, 1, 1, 1, 1, 1]
    assert all(full[ranges == r].sum() <= 19 for r in set(ranges.tolist()) if r != ranges[2]) and (ranges == ranges[2]).sum() == 1
