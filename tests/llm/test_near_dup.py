import random

import pytest
from helpers import near_classes, shingle_set

from loadtide.llm import near_dup
from loadtide.llm.near_dup import components, drop_near_duplicates, near_duplicates
from loadtide.llm.shingles import BLOCK, Shingler


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def edits(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10 ** 6)}"
    return " ".join(out)


def test_shingle_sets_are_those_of_the_plain_definition():
    rng = random.Random(1)
    texts = ["", " \n", "One", "a B\tc", "a b c d", "x" * 50, "é É z 漢字 q w e r", "a a a a a a"]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts.append("long " * (BLOCK // 4) + "tail end")
    for k in (1, 3, 5):
        sets = Shingler(k).sets([t.encode() for t in texts])
        assert [len(s) for s in sets] == [len(shingle_set(t, k)) for t in texts]
        seen = {}
        for s, t in zip(sets, texts):
            assert seen.setdefault(frozenset(shingle_set(t, k)), s.tolist()) == s.tolist()


@pytest.mark.parametrize("percent, words", [(85, 3), (80, 5)])
def test_classes_of_a_grey_cluster_and_copies(spark, percent, words):
    """Versions of one text whose similarities lie on both sides of the threshold, exact copies and unrelated texts."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    texts = [edits(rng, base, rng.choice([0, 1, 2, 3, 4, 6, 9, 14])) for _ in range(120)]
    texts += [" ".join(base)] * 30 + [edits(rng, [f"o{j}x{i}" for i in range(40)], 0) for j in range(30)]
    rows = list(enumerate(texts, 1))
    rng.shuffle(rows)
    assert result(near_duplicates(frame(spark, rows), percent, words)) == near_classes(rows, percent, words)


def test_nulls_empty_texts_ties_and_extra_columns(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, " \n"), (5, " \n"), (None, "a b"), (6, "word " * 5000)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, node int, component_id int, _gone int")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in near_duplicates(df, 85, 3).collect())
    assert got == [(0, 1, 0, None), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (5, 0, 5, True), (6, 1, 6, True)]
    kept = drop_near_duplicates(df, 85, 3)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 6]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0 and drop_near_duplicates(df).count() == 0


def test_a_doc_id_with_two_texts_loses_only_the_copy(spark):
    rows = [(5, "one two three four"), (5, "x y z w"), (2, "x y z w"), (7, "One two three four"), (8, None), (8, "X y z w")]
    kept = drop_near_duplicates(frame(spark, rows), 85, 3).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(2, "x y z w"), (5, "one two three four"), (8, None)]


def test_components_end_with_the_pass_that_leaves_stars(spark, monkeypatch):
    passes, write = [], near_dup.cut_lineage
    monkeypatch.setattr(near_dup, "cut_lineage", lambda df, label="cut", by=(): passes.append(label) or write(df, label, by))
    star = [(i, 1) for i in range(2, 40)] + [(1, 39), (50, 50)]
    got = components(spark.createDataFrame(star, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(i, 1) for i in range(2, 40)] and len(passes) == 1
    rng = random.Random(3)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    root = {}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root.get(a, a), root.get(b, b))
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((n, r) for n, r in root.items() if n != r)


def test_links_found_over_several_rounds(spark, monkeypatch):
    """Few centres a round: components of one round are joined in later ones."""
    monkeypatch.setattr(near_dup, "CENTRES", (1, 3))
    rng = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    rows = list(enumerate([edits(rng, base, rng.choice([1, 2, 3, 4, 5])) for _ in range(60)], 1))
    assert result(near_duplicates(frame(spark, rows + rows[:5]), 85, 3)) == near_classes(rows, 85, 3)
