"""Byte-pair encoding of a word-end vocabulary, speculate and verify, and decoding.

A greedy longest match proposes tokens for a word. A sequence of tokens is what merging gives exactly when
merging keeps each adjacent pair of them apart, so the distinct pairs of a batch's new words are looked up in a sorted
table in one vectorised step. A pair that the table lacks is decided once by merging its two tokens. Only words with
a pair that merges otherwise are merged exactly.
"""
import hashlib
import heapq
import json
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.llm.common import held, map_batches, ship, whole_text

#: Units (text between white space) kept in a worker's memory.
UNITS = 150_000
#: The vocabulary's pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that every Unicode version treats alike; texts with others are normalised and cut by the library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏΑ-Ρα-ωЀ-ҁҊ-ӿぁ-ゖァ-ヺ一-龥‐-‧]*")


NEVER = 1 << 40
#: Letters of a word above which it is merged on its own.
LONG_WORD = 100

#: A private character that stands for the end of a word in the matcher.
STOP = "\ue000"


def packed_ids(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters():
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(n)
            n += 1
    return letters


class WordBPE:
    """Encoder and decoder of a tokenizer file with an end-of-word suffix."""

    def __init__(self, path):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.ids = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        order = np.array(sorted((a << 20) | b for a, b in self.merges), dtype=np.int64)
        self.pair_codes, self.pair_ranks = order, np.array([self.merges[c >> 20, c & 0xFFFFF][0] for c in order.tolist()])
        self.result = np.array([m[1] for m in self.merges.values()])
        self.matcher, self.sizes = ahocorasick.Automaton(), np.zeros(max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            key = token[:-len(self.suffix)] + STOP if token.endswith(self.suffix) and token != self.suffix else token
            self.matcher.add_word(key, i)
            self.sizes[i] = len(key)
        self.matcher.make_automaton()
        self.letters = byte_letters()
        self.pre_token = regex.compile(PRE_TOKEN)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.known = np.zeros(0, dtype=np.int64)                     # sorted pair codes
        self.apart = np.zeros(0, dtype=bool)                         # whether merging keeps the pair apart
        self.units = {}
        self.proposed = self.merged = 0                              # words seen, words that needed exact merging

    # words: strings of byte letters

    def base_ids(self, word):
        return [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.suffix]]

    def propose(self, words):
        """Greedy longest match in all words at once: token ids, the word each belongs to, and whether a word is covered."""
        line = STOP.join(words) + STOP
        stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        found = np.fromiter((x for end_id in self.matcher.iter_long(line) for x in end_id), dtype=np.int64).reshape(-1, 2)
        ends, flat = found[:, 0] + 1, found[:, 1]
        owner = np.searchsorted(stops, ends)
        covered = np.bincount(owner, weights=self.sizes[flat], minlength=len(words)) == np.diff(stops, prepend=0)
        return flat, owner, covered

    def merge_ids(self, base):
        """Exact merging of many words side by side: in each step every word does its own next merge.

        A word's next merge is its pair of lowest rank, the leftmost among equals.
        """
        out = [self.merge_long(x) if len(x) > LONG_WORD else None for x in base]
        which = np.array([i for i, x in enumerate(out) if x is None], dtype=np.int64)
        base = [base[i] for i in which]
        sizes = np.fromiter(map(len, base), dtype=np.int64, count=len(base))
        flat = np.fromiter((i for x in base for i in x), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(base)), sizes)
        rank = np.full(len(flat), NEVER)
        self._rank(flat, owner, rank, np.arange(len(flat)))
        while len(flat):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            word = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(flat)))
            ended = best == NEVER
            if ended.any():
                edges = np.append(starts, len(flat))
                for k in np.flatnonzero(ended).tolist():
                    out[which[owner[starts[k]]]] = flat[edges[k]:edges[k + 1]].tolist()
                live = ~ended[word]
                flat, owner, rank, word = flat[live], owner[live], rank[live], word[live]
                if not len(flat):
                    break
            at = np.flatnonzero(rank == best[word])
            at = at[np.diff(word[at], prepend=-1) != 0]
            flat[at] = self.result[rank[at]]
            left = np.ones(len(flat), dtype=bool)
            left[at + 1] = False
            flat, owner, rank = flat[left], owner[left], rank[left]
            at = at - np.arange(len(at))
            self._rank(flat, owner, rank, np.concatenate([at, at[at > 0] - 1]))
        return out

    def _rank(self, flat, owner, rank, at):
        """Set the rank of the pair that starts at each place; NEVER at the end of a word or where nothing merges."""
        rank[at] = NEVER
        at = at[at < len(flat) - 1]
        at = at[owner[at] == owner[at + 1]]
        code = (flat[at] << 20) | flat[at + 1]
        k = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        rank[at] = np.where(self.pair_codes[k] == code, self.pair_ranks[k], NEVER)

    def merge_long(self, ids):
        """The same for one word by a heap over a linked list: no step costs more than the word's logarithm."""
        n = len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merges.get
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            p = before[i]
            if p >= 0 and (m := get((ids[p], new))):
                heapq.heappush(heap, (m[0], p, ids[p], new, m[1]))
        return [x for x in ids if x >= 0]

    def spelled_pair(self, a, b):
        """The letters' ids of two adjacent tokens."""
        left, right = self.strings[a], self.strings[b]
        ends = right.endswith(self.suffix) and len(right) > len(self.suffix)
        base = [self.ids[c] for c in left]
        base += self.base_ids(right.removesuffix(self.suffix)) if ends else [self.ids[c] for c in right]
        return base

    def compatible(self, codes):
        """For each pair code whether merging keeps its tokens apart; unknown pairs are decided and kept."""
        new = np.setdiff1d(codes, self.known, assume_unique=False)
        if len(new):
            pairs = [[c >> 20, c & 0xFFFFF] for c in new.tolist()]
            verdict = np.array([got == p for got, p in zip(self.merge_ids([self.spelled_pair(*p) for p in pairs]), pairs)], dtype=bool)
            known, apart = np.concatenate([self.known, new]), np.concatenate([self.apart, verdict])
            order = np.argsort(known)
            self.known, self.apart = known[order], apart[order]
        return self.apart[np.searchsorted(self.known, codes)]

    def encode_words(self, words):
        """Ids of each word as bytes."""
        if not words:
            return []
        flat, owner, good = self.propose(words)
        inside = owner[1:] == owner[:-1]
        codes = ((flat[:-1] << 20) | flat[1:])[inside]
        good[owner[1:][inside][~self.compatible(codes)]] = False
        edges = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        packed = flat.astype("<u4").tobytes()
        self.proposed += len(words)
        self.merged += int(len(words) - good.sum())
        out = [packed[a:b] for a, b in zip(edges, edges[1:])]
        failed = np.flatnonzero(~good).tolist()
        for i, ids in zip(failed, self.merge_ids([self.base_ids(words[i]) for i in failed])):
            out[i] = packed_ids(ids)
        return out

    # texts

    def spell(self, piece):
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)

    def learn(self, units):
        """Encode the units that aren't kept yet, all their words at once."""
        new = [u for u in units if u not in self.units]
        if len(self.units) + len(new) > UNITS:
            self.units.clear()
            new = list(units)
        cuts = [[self.spell(u)] if u.isalpha() else [self.spell(p) for p in self.pre_token.findall(u)] for u in new]
        words = list(dict.fromkeys(w for c in cuts for w in c))
        ids = dict(zip(words, self.encode_words(words)))
        self.units.update((u, ids[c[0]] if len(c) == 1 else b"".join([ids[w] for w in c])) for u, c in zip(new, cuts))

    def split(self, text):
        """The parts between special tokens and these tokens in turn; each part as units, or as words if the library cut it."""
        parts = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                parts.append(("id", self.special[part]))
            elif PLAIN.fullmatch(part):
                if not part.isascii() and not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                parts.append(("units", part.lower().split()))
            else:
                normal = self.library.normalizer.normalize_str(part)
                parts.append(("words", [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]))
        return parts

    def encode_batch(self, texts):
        """Ids of each text as little-endian 32-bit bytes."""
        cut = [self.split(t) for t in texts]
        self.learn({u for parts in cut for kind, x in parts if kind == "units" for u in x})
        out = []
        for parts in cut:
            got = []
            for kind, x in parts:
                if kind == "units":
                    got.append(b"".join(map(self.units.__getitem__, x)))
                else:
                    got.append(packed_ids([x]) if kind == "id" else b"".join(self.encode_words(x)))
            out.append(b"".join(got))
        return out

    def decode(self, packed):
        """Token strings joined by spaces, special tokens among them."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit bytes), decoded: one row per row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has no ids and decodes to an empty text. Repeated rows and rows without a doc_id are encoded like any other.
    """
    return _mapped(docs, path, lambda ids, text: {"ids": ids, "decoded": text}, "ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    def short(ids, text):
        return {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in text]}
    return _mapped(docs, path, short, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs, path, columns, schema):
    def run(batch):
        coder = held(path, lambda: WordBPE(path))
        ids = coder.encode_batch(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0)} | columns(ids, [coder.decode(x) for x in ids])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), run, f"doc_id long, {schema}")


ship(__name__)
