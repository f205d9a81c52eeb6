import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loadtide.llm.packing import LENGTH, ByteEncoder, Packer, pack, public_encoder
from loadtide.llm.word_bpe import WordBPE, digests, encode_decode

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a ", "a\n b", "I'VE don't 's", "ΑΣ Σ İ", "é é ñ", "a\x1cb\x00", " x​", "<|endoftext|>", "x<|startoftext|>y <|endoftext|>",
       "😀👍🏽 漢字 かな абв", "²½ 123 ١٢", "a" * 3000, "é" * 1500, "\n\n  \t z"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    pool = list("abcxyz ABC  \t\n.,'!-_12ßéÑ日😀#$%") + ["'s", " the ", "tion", "<|endoftext|>"]
    return ODD + ["".join(rng.choices(pool, k=rng.randrange(80))) for _ in range(1500)]


def test_word_ids_and_decoding_equal_the_library(texts):
    coder, library = WordBPE(WORD), Tokenizer.from_file(WORD)
    for packed, text in zip(coder.encode_batch(texts), texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text)
        assert coder.decode(packed) == library.decode(ids, skip_special_tokens=False)
    assert 0 < coder.merged < coder.proposed                         # both ways are taken


def test_speculation_is_verified_and_merging_exact():
    """Every word that passes the pair test is what exact merging gives, and the two ways of merging agree."""
    coder, rng = WordBPE(WORD), random.Random(5)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 14))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode_words(words)]
    base = [coder.base_ids(w) for w in words]
    assert got == coder.merge_ids(base) == [coder.merge_long(b) for b in base]


def test_word_digests(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "a "), (77, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, digests(df, WORD).collect()), key=key) == sorted(want, key=key)
    assert encode_decode(df.limit(0), WORD).count() == 0


def test_byte_ids_equal_the_library(texts):
    encode, library = ByteEncoder(BYTE, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), Tokenizer.from_file(BYTE)
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_and_fullest_out():
    p = Packer(windows=2, length=10)
    for size in (6, 5, 4, 7):                                        # 4 fills the window of 6; 7 fits none but may be opened
        p.put(f"p{size}", size)
    assert [x[1] for x in p.out] == [[("p6", 0), ("p4", 6)]]
    p.put("q6", 6)                                                   # none fits: the fullest (7) goes
    assert p.out[-1][1] == [("p7", 0)] and [w[0] for w in p.open] == [5, 6]


def test_packing_keeps_every_id_once(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "of", "x1", "été", "zq"], k=rng.choice([0, 3, 40, 200, 900, 5000])))) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "no id"), (302, "one word")]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, start int, part string").repartition(20)
    library = Tokenizer.from_file(BYTE)
    got = [r.asDict() for r in pack(df, public_encoder()).collect()]
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in rows:
        ids, at = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= LENGTH
    assert sum(r["length"] for r in got) > 0.93 * LENGTH * len(by_seq)
    assert pack(df.limit(0), public_encoder()).count() == 0
