import random
import re

import pytest
from helpers import personal_spans

from loadtide.llm.sanitize import find_personal_data, sanitize


def written(spans):
    return ",".join(f"{k}:{a}:{e}" for k, a, e in spans)


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(2)
    pool = list("ab.Z@-_+%  ()0123456789...---@@é漢😀\n") + ["a@b.c", "1.2.3.4", "255.255.255.255", "4111 1111 1111 1111", "+1 (555) 555-1234", "x@y.zz.", ".."]
    rows = [(i, "".join(rng.choices(pool, k=rng.randrange(60)))) for i in range(1500)]
    rows += [(4000, None), (4001, ""), (None, "a@b.c"), (4002, "1" * 20000), (4003, "a." * 20000 + "@b.c" + ".d" * 9000), (4004, "1 " * 9000), (4001, "")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, kind string")
    got = sorted((str(r["doc_id"]), r["base"]) for r in find_personal_data(df).collect())
    assert got == sorted((str(i), written(personal_spans(t))) for i, t in rows)


@pytest.fixture(scope="module")
def corpus(spark):
    """Project Zephyr stands next to one address in five texts and nowhere else; 'near' stands there too, but everywhere."""
    rows = [(i, f"near number{'abcdefghij'[i]} Zephyr: boss@firm.example near said (alpha{'abcdefghij'[i]})") for i in range(5)]
    rows += [(10 + i, f"all is near and far {'abcdefghijklmnopqrstuvwxyz'[i % 26]}q{i}") for i in range(60)]
    return spark.createDataFrame([(i, t, "z") for i, t in rows] + [(99, None, "z")], "doc_id long, text string, start string")


def test_a_term_that_gives_an_entity_away_is_found(corpus):
    got = {r["doc_id"]: r for r in find_personal_data(corpus).collect()}
    text = corpus.filter("doc_id = 1").first()["text"]
    at = text.index("Zephyr")
    assert f"term:{at}:{at + 6}" in got[1]["spans"].split(",") and "email" in got[1]["base"]
    terms = {text[int(a):int(e)] for k, a, e in (s.split(":") for s in got[1]["spans"].split(",")) if k == "term"}
    assert terms == {"Zephyr", "said"} and got[1]["n_term"] == 2       # near is everywhere, numberb and alphab are in one text each
    assert got[20]["spans"] == "" and got[99]["spans"] == ""


def test_shares_equal_brute_force(corpus, spark):
    """The share of an entity's information from counts made by hand."""
    import math
    from loadtide.llm.sanitize import _contexts, disclosing_terms, mentions
    found = mentions(corpus)
    got = {r["term"]: r["share"] for r in disclosing_terms(corpus, found, _contexts(found), disclosed=-9.0).collect()}
    n = 66
    assert got.keys() == {"zephyr", "said", "near"}
    assert got["zephyr"] == pytest.approx(1.0) and got["near"] == pytest.approx(math.log2(5 * n / (5 * 65)) / math.log2(n / 5))


def test_masking(corpus, spark):
    got = {r["doc_id"]: r["text"] for r in sanitize(corpus).collect()}
    assert got[1] == "near numberb : [EMAIL] near  (alphab)" and got[99] is None and got[20] == corpus.filter("doc_id = 20").first()["text"]
    df = spark.createDataFrame([(1, "é +1 (555) 555-1234, 4111 1111 1111 1111, 1.2.3.4 x"), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted(r["text"] for r in sanitize(df).collect()) == ["", "", "é [PHONE], [CARD], [IP] x"]
    assert sanitize(df).columns == df.columns and sanitize(df.limit(0)).count() == 0 and find_personal_data(df.limit(0)).count() == 0


def test_entities_of_one_text_and_of_two_are_weighed(spark):
    """Every mention of the fixture's rare entities has a term that stands with it alone; copies of a text are no further evidence."""
    rows = [(1, "all said Quorvex mail rare@one.example far"), (2, "all Twinor two@two.example far"), (3, "far Twinor all two@two.example said"), (4, "all Twinor Bex at 10.1.2.3 and far")]
    rows += [(5 + i, "all Copyx copy@copy.example far") for i in range(3)] + [(20 + i, "all said far and near at mail two") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_personal_data(df).collect()}
    terms = {i: {rows[i - 1][1][int(a):int(e)] for k, a, e in (s.split(":") for s in got[i]["spans"].split(",")) if k == "term"} for i in range(1, 8)}
    assert terms == {1: {"Quorvex"}, 2: {"Twinor"}, 3: {"Twinor"}, 4: {"Bex"}, 5: {"Copyx"}, 6: {"Copyx"}, 7: {"Copyx"}}
    assert got[1]["n_term"] == 1 and got[20]["n_term"] == 0
    assert {r["doc_id"]: r["text"] for r in sanitize(df).collect()}[1] == "all said [TERM] mail [EMAIL] far"     # thin evidence never identifies


def test_terms_are_found_on_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert find_personal_data(docs).filter("n_term > 0").count() > 0


def test_a_term_far_from_its_entity_and_all_its_places_are_found(spark):
    """The name at the head of a letter and in its middle, the address at its end."""
    filler = "all said and far " * 40
    rows = [(i, f"Dear Zephyr,\n{filler}(zephyr) {filler}mail: boss@firm.example") for i in range(2)] + [(2, f"ZEPHYR! {filler}{filler} far boss@firm.example, İé😀 Zephyr")]
    rows += [(20 + i, "dear all said far and mail") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_personal_data(df).collect()}
    for i in (1, 2):
        cut = [(int(a), int(e)) for k, a, e in (s.split(":") for s in got[i]["spans"].split(",")) if k == "term"]
        assert cut == [(m.start(), m.end()) for m in re.finditer("zephyr", rows[i][1].lower().replace("i̇", "i"))] and len(cut) == 2
    assert "ephyr" not in "".join(r["text"] for r in sanitize(df).collect())
