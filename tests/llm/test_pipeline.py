from helpers import near_classes, personal_spans

import corpus_pipeline
from loadtide.llm.common import cut_lineage


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept: its decisions are those of the plain versions."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "personal_data", "packing"]
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == seen["documents"].columns and docs.schema == seen["documents"].schema
        seen[name] = docs
    rows = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, d in seen.items() if n != "packing"}
    first = rows["documents"]
    assert all(first[i] == t for i, t in rows["toxicity"].items()) and 0.7 * len(first) < len(rows["toxicity"]) <= len(first)
    assert rows["line_dedup"].keys() == rows["toxicity"].keys()
    assert all(set(t.split("\n")) <= set(rows["toxicity"][i].split("\n")) | {""} for i, t in rows["line_dedup"].items())
    classes = near_classes(rows["line_dedup"].items(), 80, 5)
    assert rows["near_dedup"].keys() == {i for i, c in classes.items() if c[2]}
    assert rows["personal_data"].keys() == rows["near_dedup"].keys()
    assert not any(personal_spans(t) for t in rows["personal_data"].values())
    assert all(t == rows["near_dedup"][i] for i, t in rows["personal_data"].items() if not personal_spans(rows["near_dedup"][i]) and "[TERM]" not in t)
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == rows["personal_data"].keys()


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0
