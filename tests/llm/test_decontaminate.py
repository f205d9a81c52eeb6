import random
import re

import pytest

from loadtide.llm.decontaminate import CHUNK, contamination, drop_contaminated


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10, share=1.0):
    """Each window of each item against each place of each document."""
    cut = []
    for item, text in items:
        w = words(text)
        cut += [(item, w[i:i + window]) for i in range(max(1, len(w) - window + 1))] if w else []
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, x in cut:
            k = min(3, len(x))
            m = len(x) - k + 1
            need = max(1, -int(-share * m // 1))
            for i in range(len(w) - len(x) + 1):
                same = w[i:i + len(x)] == x if share >= 1 else sum(w[i + j:i + j + k] == x[j:j + k] for j in range(m)) >= need
                if same:
                    hit.update(range(i, i + len(x)))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(8, 40)))) for i in range(12)]
    items += [(20, "Rare"), (21, "two words"), (22, None), (23, " -- "), (5, "another text of five, with just enough words to be cut twice"), (None, "no id " * 6), (24, items[0][1]),
              (25, "hot the hot the hot the hot the hot the hot the")]
    docs = []
    for d in range(60):
        w = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(300))]
        if d % 2:
            at, text = rng.randrange(len(w) + 1), words(items[rng.randrange(len(items))][1])
            a = rng.randrange(len(text) + 1)
            w[at:at] = text[a:a + rng.choice([9, 10, 11, 40])]
        if d % 7 == 0:
            w[CHUNK - 5:CHUNK - 5] = words(items[1][1])
        if d % 9 == 0:
            w.insert(rng.randrange(len(w) + 1), rng.choice(["RARE", "two WORDS", "two, é words"]))
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(100, "hot the " * 700), (101, None), (102, ""), (103, "rare"), (103, "rare"), (103, "else"), (None, "rare"), (None, "rare x"), (104, items[0][1])]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, 2, "w") for d in docs], "doc_id long, text string, key int, w int, words string").repartition(3),
            spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n int"))


@pytest.mark.parametrize("shipped", [0, 100_000])
@pytest.mark.parametrize("share", [1.0, 0.6])
def test_against_every_place(spark, shipped, share):
    docs, items = corpus()
    got = contamination(*frames(spark, docs, items), share=share, max_shipped=shipped)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()], key=str) == plain(docs, items, share=share)


def test_dropping_keeps_the_columns_and_the_clean_rows(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    kept = drop_contaminated(d, i)
    assert kept.columns == d.columns
    clean = [r[0] for r in plain(docs, items) if r[2] == 0]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    assert contamination(d.limit(0), i).count() == 0
    assert {r["n_hit"] for r in contamination(d, i.limit(0)).collect()} == {0}
