import hashlib
import random
import re

import numpy as np
import pytest

from loadtide.llm.licenses import Scanner, choices, postfix, scan_licenses
from loadtide.llm.multi_index import search, visit
from loadtide.llm.toxicity import Channel, Words, drop_toxic, fit, held_out, restored, score, trigram_counts
from loadtide.llm.winnow import GRAM, WINDOW, Fingerprint, compare_with_next, edited_text, fingerprints, gram_hashes, winnow


# licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def base(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for label, p in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_places_equal_brute_force(spark):
    rng = random.Random(4)
    pool = ["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "é", "x_y", "漢字", "CC-BY-NC", "under the mit license under the MIT-License"]
    rows = [(i, rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(pool, k=rng.randrange(25)))) for i in range(800)] + [(900, None), (901, ""), (None, "cc by nc"), (901, "")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, score int")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in scan_licenses(df).collect())
    assert got == sorted((str(i), n, k, str(a), str(b), s) for i, t in rows for n, k, a, b, s in [base(t)])
    assert scan_licenses(df.limit(0)).count() == 0


def test_expressions():
    assert postfix("MIT OR Apache-2.0 AND BSD".split()) == ["MIT", "Apache-2.0", "BSD", "and", "or"]
    assert postfix(["(", "MIT", "or", "GPL-2.0", "with", "X", ")", "and", "ISC", "*/"]) == ["MIT", "GPL-2.0", "X", "with", "or", "ISC", "and"]
    assert postfix(["MIT", "or"]) == ["MIT"] and postfix(["or"]) is None and postfix(["(", "MIT"]) is None and postfix([]) is None
    ways = choices(postfix("( MIT or GPL with X ) and ISC".split()))
    assert ways == {frozenset({"mit", "isc"}), frozenset({"gpl with x", "isc"})}
    n, at, labels, tagged = Scanner().scan("// SPDX-License-Identifier: MIT OR Apache-2.0\nPermission is hereby granted, free of charge, to any person obtaining a copy")
    assert labels == {"mit": 1.0} and list(tagged.values()) == [{frozenset({"mit"}), frozenset({"apache-2.0"})}]


# winnowing

def plain_winnow(h, w):
    chosen = set()
    w = min(w, len(h))
    for i in range(len(h) - w + 1):
        m = min(h[i:i + w])
        chosen.add(max(j for j in range(i, i + w) if h[j] == m))
    return sorted(chosen)


def test_winnowing_equals_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 31, 32, 33, 200):
        for high in (2, 5, 2 ** 32):
            h = rng.integers(0, high, n, dtype=np.uint64)
            for w in (1, 3, 4, 7, 32):
                assert winnow(h, w).tolist() == (plain_winnow(h.tolist(), w) if n else [])
    text = "the quick brown fox jumps é漢😀 over the lazy dog " * 3
    for k in (1, 5, 16, 30):
        h = gram_hashes(text, k)
        grams = [text[i:i + k] for i in range(len(text) - k + 1)]
        assert len(h) == len(grams) and len(set(zip(grams, h.tolist()))) == len(set(grams))


def test_shared_passages_are_always_seen():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    for _ in range(50):
        shared = word(GRAM + WINDOW - 1)
        a, b = Fingerprint(word(rng.randrange(300)) + shared + word(99)), Fingerprint(word(rng.randrange(300)) + shared + word(99))
        assert np.intersect1d(a.set, b.set).size


def test_next_document_over_ranges(spark):
    rng = random.Random(3)
    rows = [(i * 7, "".join(rng.choices("abc déf", k=rng.randrange(90)))) for i in range(200)] + [(5000, None), (5001, ""), (None, "no id"), (7, "again")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, _to int").repartition(5)
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        e = edited_text(t, after)
        a, b, c = Fingerprint(t), Fingerprint(e), Fingerprint(after)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.written(), b.written(), a.likeness(b), a.likeness(c)))
    key = lambda r: (str(r[0]), r[1:3])
    assert sorted(map(tuple, compare_with_next(df).collect()), key=key) == sorted(want, key=key)
    one = compare_with_next(df.filter("doc_id = 14")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert compare_with_next(df.limit(0)).count() == 0 and fingerprints(df).count() == len(rows)


# nearest neighbours

def test_cells_come_in_order():
    rng = np.random.default_rng(0)
    a, b, n = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 3, (9, 7))
    got = visit(a, b, n, n.sum() * 0.6)
    sums = (a[:, None] + b[None]).ravel()
    want = [c for c in np.argsort(-sums, kind="stable") if n.ravel()[c]]
    assert got.tolist() == want[:len(got)] and n.ravel()[got].sum() >= n.sum() * 0.6 > n.ravel()[got[:-1]].sum()


def test_recall_and_edge_cases(spark):
    import pyspark.sql.functions as F
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = search(table, F.col("vec_id") % 20 == 0).collect()
    v = table.orderBy("vec_id").toPandas()
    x, ids, hit = np.stack(v.embedding).astype(float), v.vec_id.to_numpy(), 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[q]
        s[q] = -9
        want = set(ids[np.lexsort((ids, -s))[:20]])
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(abs(r["score"] - x[r["vec_id"]] @ x[q]) < 1e-12 for r in mine)
        hit += len(want & {r["vec_id"] for r in mine})
    assert hit / (20 * (ids % 20 == 0).sum()) >= 0.9
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.5, 1.0]), (0, [1.0, 0.0])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, rank int")
    got = search(df, F.col("vec_id") == 0, k=5, share=1.0).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1.0)] + [(0, 100 + i, 1.0) for i in range(4)]
    few = search(df.filter("vec_id IN (0, 1, 2, 7)"), F.col("vec_id") == 0, share=1.0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in few) == [(1, 1), (2, 7)]
    assert search(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("n", [2, 10, 30, 40])
def test_small_tables_give_all_asked_at_the_default_share(spark, n):
    import pyspark.sql.functions as F
    x = np.random.default_rng(n).normal(size=(n, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = search(df, F.col("vec_id") % 5 == 0).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {i: min(20, n - 1) for i in range(0, n, 5)}


# toxicity

@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs, fit(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_held_out_accuracy(spark, model):
    docs, m = model
    rows = score(docs, m).filter("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    caught = [r["predicted"] for r in rows if r["toxic"]]
    false = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(caught) / len(caught) > 0.85 and sum(false) / len(false) < 0.005


def test_hidden_words_are_restored(model):
    m = model[1]
    words = Words(Channel(m.counts))
    for hidden, word in (("1d10t", "idiot"), ("w0rthl3ss", "worthless"), ("tr@sh!", "trash"), ("sstuuupid", "stupid"), ("m.o.r.o.n", "moron"), ("l0ser", "loser"), ("d i s g u s t i n g", "disgusting")):
        got = restored(f"the {hidden} erand", words)[1]
        assert any(word in w or w in word and len(w) > 3 for w in got), (hidden, got)
    assert restored("The house, at 12 %%% (ok) 3rd.", words)[1] >= {"the", "house", "at", "ok"}


@pytest.mark.parametrize("hidden, word", [
    ("i d ! o t", "idiot"), ("a $ $ h o l e", "asshole"), ("i  d  i  o  t", "idiot"), ("i - d . i\to  t !", "idiot"), ("s c u m", "scum"), ("f a t", "fat"), ("1d1000t", "idiot"),
    ("iddiioott", "idiot"), ("1dd!!00tt", "idiot"), ("i d d i i o o t", "idiot"), ("you/idiot", "idiot"), ("really-idiot", "idiot"), ("really\u2014idiot", "idiot"), ("you|1d10t", "idiot"),
    ("id-iot", "idiot"), ("so/1d10t/" + "erand/" * 8, "idiot"), ("1d10t|" * 9, "idiot"), ("w0rthl3ss", "worthless")])
def test_combined_disguises_are_restored(model, hidden, word):
    got = restored(f"the {hidden} erand", Words(Channel(model[1].counts)))[1]
    assert word in got, got


def test_combined_disguises_raise_the_score(model):
    m, clean = model[1], "the and of thion erand that in onther " * 6
    assert m.score(clean + "i d ! o t and m  o  r  o  n you/loser") >= 0.7
    assert m.score(clean + "1d1000t moorroonn and/loser") >= 0.7


def test_hidden_words_raise_the_score(model):
    m, clean = model[1], "the and of thion erand that in onther " * 6
    assert m.score(clean) < 0.3 and m.score("") < 0.3
    assert m.score(clean + "idiot moron scum") >= 0.7
    assert m.score(clean + "1d10t m0r0n l0ser") >= 0.7


def test_counts_are_of_all_documents(spark):
    df = spark.createDataFrame([("abc",), ("ab",), (None,), ("É1",)], "text string")
    n = trigram_counts(df).reshape(27, 27, 27)
    assert n[0, 1, 2] == 1 and n[26, 0, 1] == 2 and n[26, 4, 26] == 1


def test_scores_without_labels_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x", 0.5), (2, "", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    m = fit(df, labels)
    got = score(df, m).collect()
    assert len(got) == 4 and all(0 <= r["score"] < 0.7 and r["predicted"] == 0 for r in got)
    kept = drop_toxic(df, m)
    assert kept.columns == df.columns and kept.count() == 4 and drop_toxic(df.limit(0), m).count() == 0
    import zlib
    assert {r["doc_id"]: r["h"] for r in df.filter("doc_id IS NOT NULL").select("doc_id", held_out().alias("h")).collect()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2)}


def test_decoding_is_the_best_path_of_the_lattice():
    """Viterbi against every way through small lattices."""
    import itertools
    import random
    import numpy as np
    from loadtide.llm.toxicity import EDGE, Channel, codes
    rng = random.Random(6)
    channel = Channel(np.random.default_rng(6).integers(0, 50, 27 ** 3))

    def score(path):
        x = y = EDGE
        total = 0.0
        for text, cost in path:
            total += cost
            for z in codes(text):
                total += channel.logp[x][y][z]
                x, y = y, z
        return total + channel.logp[x][y][EDGE]

    for _ in range(300):
        lattice = [[("".join(rng.choice("abcdez ") for _ in range(rng.randrange(3))), -rng.random()) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 6))]
        best = max(score(p) for p in itertools.product(*lattice))
        text = channel.decode(lattice)
        assert any(abs(score(p) - best) < 1e-9 and "".join(t for t, _ in p) == text for p in itertools.product(*lattice))


def test_the_memory_of_hits_leaves_none_out(model):
    """A reader's shortcut for words of letters finds the same terms as restoring every token."""
    import random
    from loadtide.llm.toxicity import Reader
    m, rng = model[1], random.Random(9)
    reader, some = Reader(m), sorted(k.strip("=") for k in m.terms) + ["house", "erand"]
    for _ in range(3000):
        w = "".join(c * rng.choice([1, 1, 1, 2, 3]) for c in rng.choice(some)) + rng.choice(["", "s", "ing", "!", ",", "-", "ss"]) + rng.choice(["", rng.choice(some)])
        w = w.replace("o", rng.choice(["o", "o", "0"])).lower()
        assert sorted(reader[w]) == sorted(reader.hits(reader.channel.restore(w))), w


def test_conjunctions_of_alternatives_stay_whole(spark):
    """Twelve factors of two names: all names are labels, and nothing is written out."""
    text = "SPDX-License-Identifier: " + " AND ".join(f"(a{i} OR b{i})" for i in range(12))
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"].split(",") == sorted(f"{x}{i}" for i in range(12) for x in "ab")
    assert all(f"(a{i} | b{i})" in row["expressions"] for i in range(12)) and len(row["expressions"]) < 600
    from loadtide.llm.licenses import way_text
    assert [way_text(w) for w in choices(postfix("( a or b ) and ( c or d ) and e".split()))] == ["(a | b) + (c | d) + e"]
