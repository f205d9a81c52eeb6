"""Phrases whose words stand together more often than apart, counted in weighted acyclic automata.

A shard (some millions of words of a language) becomes the sorted list of its windows: at each word the next four of its piece. Read in
order they build an automaton whose arcs carry counts: the count of a phrase is that of the last arc on its way, and
states with equal arcs are one. The parts of an automaton that begin with a range of prefixes travel to that range, where the parts of
all shards are united and their counts added. A prefix range that is too heavy for one task is dealt by whole windows instead; the counts of its
phrases are partial and meet in one more sum. Parts of phrases are looked up by walking the sorted phrases' automata and the sorted questions in step.

Before, pairs of words are counted in a table of fixed size, whose counts are never too small. Windows go only as far as their pairs may be frequent enough
for a candidate; this leaves out nothing that could become one, and where the table is too full to tell it leaves out nothing.
"""
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loadtide.llm.common import BATCH_ROWS, cut_lineage, ship, whole_text

#: Words of the longest phrase; occurrences of a candidate; share of a phrase's count in percent with which a longer one replaces it; phrases a language.
LONGEST, LEAST, COVERED, TOP = 4, 30, 80, 2000
#: Words of a shard, windows of a range, and prefix buckets, a fixed number whose counts the driver reads.
SHARD_WORDS, RANGE_WINDOWS, BUCKETS = 4_000_000, 2_000_000, 1 << 16
#: Pair buckets, as a power of two: about one for eight characters of all texts, this many at most (16 MB of bits); and those of a slice.
MOST_BITS, SLICE = 27, 1 << 16
#: Shares of a phrase's questions, and bytes of a text that are cut into words at once.
SALTS, BLOCK = 8, 1 << 20

#: Marks the end of a piece; stands in no word, as it parts pieces itself.
STOP = b"."
DELIMITERS = bytes.maketrans(b",;:!?\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b".........abcdefghijklmnopqrstuvwxyz")


class Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Shard:
    """Words of one language as numbers in the order of the text; 0 is the end of a piece."""

    def __init__(self):
        self.clear([])

    def clear(self, tokens: list):
        self.ids, self.parts, self.size = Ids({STOP: 0}), [], 0
        if tokens:
            self._take(tokens)

    def _take(self, tokens: list):
        self.parts.append(np.fromiter(map(self.ids.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
        self.size += len(tokens)

    def add(self, text: bytes):
        """The next part of a text, cut at a blank."""
        self._take(text.split())

    def cut(self, last: bool):
        """The numbers so far, how many of them start windows here, and the words by number. The others start the next shard."""
        flat = np.concatenate([np.zeros(0, dtype=np.int32), *self.parts])
        words = list(self.ids)
        kept = [] if last else [words[i] for i in flat[max(0, len(flat) - LONGEST + 1):].tolist()]
        self.clear(kept)
        return np.concatenate([flat, np.zeros(LONGEST, dtype=np.int32)]), len(flat) - len(kept), words


def windows(flat, owned: int, heavy):
    """At each word that starts a heavy pair the window of its next words, as far as pairs are heavy; 0 behind."""
    at = np.flatnonzero(heavy[:owned])
    third = heavy[at + 1]
    fourth = third & heavy[at + 2]
    return np.stack([flat[at], flat[at + 1], np.where(third, flat[at + 2], 0), np.where(fourth, flat[at + 3], 0)], axis=1)


def summed(rows, counts):
    """Sorted distinct rows and the sums of their counts."""
    if not len(rows):
        return rows, counts
    width = int(rows.max()) + 1
    high, low = (rows[:, k].astype(np.int64) * width + rows[:, k + 1] for k in (0, 2))
    order = np.lexsort((low, high))
    low, high = low[order], high[order]
    first = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
    return rows[order[first]], np.add.reduceat(counts[order], first)


def mixed(h):
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _runs(starts, sizes):
    """The places of runs, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class CountAutomaton:
    """A weighted acyclic automaton of sorted distinct rows of numbers (0: the row has ended). An arc's weight is the count of all rows that pass it.

    State 0 has no arcs. A prefix is complete when the next one begins, and its state is frozen: one whose arcs equal those of a
    frozen state is that state. The rows are sorted, so this happens for all prefixes of a length at once, longest first; the root is last.
    """

    def __init__(self, rows=(), counts=()):
        self.symbol, self.weight, self.target = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.offset = np.zeros(2, dtype=np.int64)                    # arcs of state s: offset[s] to offset[s + 1]
        if len(rows):
            self._build(rows, counts)
        self.root = len(self.offset) - 2

    def _build(self, rows, counts):
        new, firsts, ends = np.zeros(len(rows), dtype=bool), [], []  # of the prefixes of each length
        new[0] = True
        for k in range(LONGEST):
            new[1:] |= rows[1:, k] != rows[:-1, k]
            at, alive = np.flatnonzero(new), rows[new, k] > 0
            firsts.append(at[alive])
            ends.append(np.append(at[1:], len(rows))[alive])
        passed = np.concatenate(([0], np.cumsum(counts)))
        behind = np.zeros(len(rows), dtype=np.int64)                 # state behind the prefix that starts in a row
        for k in range(LONGEST - 1, -1, -1):
            at, before = firsts[k], firsts[k - 1] if k else np.zeros(1, dtype=np.int64)
            own = np.searchsorted(before, at, side="right") - 1
            states = self._freeze(own, rows[at, k].astype(np.int64), passed[ends[k]] - passed[at], behind[at])
            behind[:] = 0
            behind[before[np.unique(own)]] = states

    def _freeze(self, own, symbol, weight, target):
        """Make states of runs of arcs (``own``: the run of each arc, ascending) and return their numbers."""
        if not len(own):
            return own
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        sizes = np.diff(starts, append=len(own))
        place = np.arange(len(own)) - np.repeat(starts, sizes)
        factors = np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F], [0x165667B19E3779F9], [0x27D4EB2F165667C5]], dtype=np.uint64)
        arcs = mixed((np.stack([symbol, weight, target, place]).astype(np.uint64) * factors).sum(axis=0, dtype=np.uint64))
        key = np.add.reduceat(mixed(arcs), starts) + sizes.astype(np.uint64)
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        twin = first[same]                                           # states of equal keys are compared arc by arc
        there = np.minimum(np.repeat(starts[twin], sizes) + place, len(own) - 1)
        equal = np.logical_and.reduceat((symbol[there] == symbol) & (weight[there] == weight) & (target[there] == target), starts) & (sizes[twin] == sizes)
        kept, number = np.unique(np.where(equal, twin, np.arange(len(starts))), return_inverse=True)
        base, at = len(self.offset) - 1, _runs(starts[kept], sizes[kept])
        self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(sizes[kept])])
        self.symbol, self.weight, self.target = (np.concatenate([old, new[at]]) for old, new in ((self.symbol, symbol), (self.weight, weight), (self.target, target)))
        return base + number

    def onward(self):
        """Per state the weight of all its arcs."""
        total = np.concatenate(([0], np.cumsum(self.weight)))
        return total[self.offset[1:]] - total[self.offset[:-1]]

    def prefixes(self):
        """For each length: the prefixes (later numbers 0), the weight of each one's last arc, how many rows end there."""
        state, rows, onward = np.array([self.root]), np.zeros((1, LONGEST), dtype=np.int32), self.onward()
        for k in range(LONGEST):
            sizes = self.offset[state + 1] - self.offset[state]
            at = _runs(self.offset[state], sizes)
            rows, state = np.repeat(rows, sizes, axis=0), self.target[at]
            rows[:, k] = self.symbol[at]
            yield rows, self.weight[at], self.weight[at] - onward[state]

    def rows(self):
        """The rows and counts that the automaton was made of, by length."""
        found = [(r[n > 0], n[n > 0]) for r, _, n in self.prefixes()]
        return np.concatenate([r for r, _ in found]), np.concatenate([n for _, n in found])

    def compose(self, rows):
        """The count of each asked row; 0 for one that the automaton doesn't hold."""
        states = np.repeat(np.arange(len(self.offset) - 1), np.diff(self.offset))
        width = int(max(self.symbol.max(initial=0), rows.max(initial=0))) + 1
        keys, state, weight = states * width + self.symbol, np.full(len(rows), self.root), np.zeros(len(rows), dtype=np.int64)
        for k in range(LONGEST):
            go = np.flatnonzero((rows[:, k] > 0) & (state >= 0))
            asked = state[go] * width + rows[go, k]
            at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
            known = keys[at] == asked if len(keys) else np.zeros(len(go), dtype=bool)
            state[go], weight[go] = np.where(known, self.target[at], -1) if len(keys) else -1, np.where(known, self.weight[at], 0) if len(keys) else 0
        return np.where(state >= 0, weight - self.onward()[np.maximum(state, 0)], 0)

    def to_bytes(self, words: list) -> bytes:
        parts = [b" ".join(words), np.diff(self.offset).astype("<i4").tobytes(), self.symbol.astype("<i4").tobytes(), self.weight.astype("<i8").tobytes(),
                 self.target.astype("<i4").tobytes()]
        return zstandard.compress(struct.pack("<5q", *map(len, parts)) + b"".join(parts), 1)

    @classmethod
    def from_bytes(cls, blob: bytes):
        """The automaton and its words."""
        data = zstandard.decompress(blob)
        edges = np.cumsum([40, *struct.unpack("<5q", data[:40])]).tolist()
        words, *arrays = (data[a:b] for a, b in zip(edges, edges[1:]))
        out = cls()
        sizes, out.symbol, out.weight, out.target = (np.frombuffer(x, dtype=t).astype(np.int64) for x, t in zip(arrays, ("<i4", "<i4", "<i8", "<i4")))
        out.offset = np.concatenate(([0], np.cumsum(sizes)))
        out.root = len(out.offset) - 2
        return out, words.split(b" ")


def united(blobs: list):
    """The words, and the automaton of all rows of several automata with their counts added."""
    parts = [CountAutomaton.from_bytes(b) for b in blobs]
    words = sorted(set().union(*(w for _, w in parts)))
    number = dict(zip(words, range(1, len(words) + 1)))
    rows, counts = [], []
    for automaton, own in parts:
        to = np.array([0, *map(number.__getitem__, own)], dtype=np.int32)
        r, n = automaton.rows()
        rows.append(to[r])
        counts.append(n)
    return words, CountAutomaton(*summed(np.concatenate(rows), np.concatenate(counts)))


def _shards(batches):
    """(lang, numbers, how many start windows here, words by number) of shards of bounded size; a long text may go on in the next shard."""
    shards, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shard = shards.setdefault(lang, Shard())
            data, at = text.encode().translate(DELIMITERS).replace(b".", b" . ").replace(b"\t", b" ") + b" .", 0
            while at < len(data):
                end = data.find(b" ", at + BLOCK)
                end = len(data) if end < 0 else end
                before = shard.size
                shard.add(data[at:end])
                size, at = size + shard.size - before, end
                if size >= SHARD_WORDS:
                    yield from ((x, *s.cut(False)) for x, s in shards.items())
                    size = sum(s.size for s in shards.values())
    yield from ((x, *s.cut(True)) for x, s in shards.items())


def _pairs(lang: str, words: list, flat):
    """A hash of each place's language and next two words, whether both stand in one piece, and the words' hashes by number."""
    h = np.array([0, *map(xxhash.xxh64_intdigest, words[1:])], dtype=np.uint64)
    first = mixed(h + np.uint64(xxhash.xxh64_intdigest(lang))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(first[flat[:-1]] + h[flat[1:]]), (flat[:-1] > 0) & (flat[1:] > 0), h


def pair_table(texts: DataFrame, bits: int, least: int):
    """(heavy, full): a bit per pair bucket, whether its pairs occur ``least`` times or more in all, and the pairs of each prefix bucket.

    Both have a fixed size. A phrase occurs no more often than a pair in it, and a pair no more often than its bucket, so a phrase with a pair
    in a light bucket can't be a candidate. A task counts up to ``least`` only, which changes no verdict; tables travel in slices and are added up one by one.
    """
    kind = np.uint8 if least < 256 else np.int64
    schema = pa.schema([("slice", pa.int32()), ("blob", pa.binary())])

    def batch(slices, arrays):
        return pa.RecordBatch.from_arrays([pa.array(slices, type=pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in arrays], type=pa.binary())], schema=schema)

    def count(batches):
        table, full = np.zeros(1 << bits, dtype=kind), np.zeros(BUCKETS, dtype=np.int64)
        for lang, flat, owned, words in _shards(batches):
            pair, inside, _ = _pairs(lang, words, flat)
            pair = pair[:owned][inside[:owned]]
            full += np.bincount((pair >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
            at, n = np.unique((pair >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            table[at] = np.minimum(table[at].astype(np.int64) + n, least)
        yield batch([-1], [full])
        for k in range(0, 1 << bits, SLICE):
            if table[k:k + SLICE].any():
                yield batch([k // SLICE], [table[k:k + SLICE]])

    def add(batches):
        now, total = None, None
        for rows in batches:
            for k, blob in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                got = np.frombuffer(zstandard.decompress(blob), dtype=np.int64 if k < 0 else kind).astype(np.int64)
                if k == now:
                    total += got
                    continue
                if now is not None:
                    yield batch([now], [total if now < 0 else np.packbits(total >= least)])
                now, total = k, got
        if now is not None:
            yield batch([now], [total if now < 0 else np.packbits(total >= least)])

    tables = texts.mapInArrow(count, "slice int, blob binary").repartition("slice").sortWithinPartitions("slice")
    heavy, full = np.zeros(1 << bits - 3, dtype=np.uint8), np.zeros(BUCKETS, dtype=np.int64)
    for r in tables.mapInArrow(add, "slice int, blob binary").collect():               # 2 ** MOST_BITS bits at most
        data = zstandard.decompress(bytes(r["blob"]))
        if r["slice"] < 0:
            full += np.frombuffer(data, dtype=np.int64)
        else:
            part = np.frombuffer(data, dtype=np.uint8)
            heavy[r["slice"] * (SLICE >> 3):r["slice"] * (SLICE >> 3) + len(part)] = part
    return heavy, full


def ranges_of(full: np.ndarray, size: int):
    """Per bucket its range, and into how many shares the range is dealt. Neighbours join up to ``size`` windows; a heavier bucket is alone."""
    shares = np.maximum(1, -(-full // size))
    alone = shares > 1
    run = np.cumsum(np.where(alone, 0, full)) // size
    new = np.concatenate(([True], (run[1:] != run[:-1]) | alone[1:] | alone[:-1]))
    return np.cumsum(new) - 1, shares


def phrase_counts(texts: DataFrame, heavy: np.ndarray, full: np.ndarray, least: int, range_windows: int) -> DataFrame:
    """lang, phrase, k, f: the phrases of one word and more with ``least`` occurrences at least, and with k 0 the number of all words."""
    range_of, shares = ranges_of(full, range_windows)
    shift, ranges = np.uint64(64 - (len(heavy) * 8).bit_length() + 1), int(range_of[-1]) + 1
    schema = pa.schema([("lang", pa.string()), ("range", pa.int64()), ("share", pa.int64()), ("whole", pa.bool_()), ("blob", pa.binary())])

    def run(batches):
        for lang, flat, owned, words in _shards(batches):
            pair, inside, h = _pairs(lang, words, flat)
            bucket = (pair >> shift).astype(np.int64)
            inside &= (heavy[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 > 0
            places = windows(flat, owned, inside)
            n = np.bincount(flat[:owned], minlength=len(words))
            n[0] = 0
            used = np.flatnonzero(n)
            order = sorted(used.tolist(), key=words.__getitem__)
            named, rank = [words[i] for i in order], np.zeros(len(words), dtype=np.int32)
            rank[order] = np.arange(1, len(order) + 1)
            # Words behind the last owned place stand in windows only.
            extra = sorted({words[i] for i in np.unique(places).tolist() if i and not rank[i]})
            if extra:
                number = {w: i for i, w in enumerate(words)}
                named = sorted([*named, *extra])
                rank[[number[w] for w in named]] = np.arange(1, len(named) + 1)
            hashes = np.zeros(len(named) + 1, dtype=np.uint64)
            hashes[rank] = h
            hashes[0] = 0
            singles = np.zeros((len(order), LONGEST), dtype=np.int32)
            singles[:, 0] = rank[order]
            yield from pieces(lang, named, singles, n[order], ranges + (hashes[singles[:, 0]] % np.uint64(ranges)).astype(np.int64), np.zeros(len(order), dtype=np.int64), True)
            rows, counts = summed(rank[places], np.ones(len(places), dtype=np.int64))
            if len(rows):
                first = mixed(hashes + np.uint64(xxhash.xxh64_intdigest(lang))) * np.uint64(0x9E3779B97F4A7C15)
                pair = mixed(first[rows[:, 0]] + hashes[rows[:, 1]])
                prefix = (pair >> np.uint64(48)).astype(np.int64)
                whole = mixed(mixed(pair + hashes[rows[:, 2]]) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[rows[:, 3]])
                share = np.where(shares[prefix] > 1, (whole % shares[prefix].astype(np.uint64)).astype(np.int64), 0)
                yield from pieces(lang, named, rows, counts, range_of[prefix], share, shares[prefix] == 1)

    def pieces(lang, named, rows, counts, ranges, share, whole):
        order = np.lexsort((share, ranges))
        where = np.stack([ranges, share])[:, order]
        starts = np.flatnonzero((np.diff(where, axis=1, prepend=-1) != 0).any(axis=0))
        whole = np.broadcast_to(whole, len(rows))
        cols = {f.name: [] for f in schema}
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist()):
            part = rows[order[a:b]]
            used = np.unique(part)
            used = used[used > 0]
            local = np.where(part > 0, np.searchsorted(used, part) + 1, 0).astype(np.int32)
            blob = CountAutomaton(local, counts[order[a:b]]).to_bytes([named[i - 1] for i in used.tolist()])
            for name, value in zip(cols, (lang, int(where[0, a]), int(where[1, a]), bool(whole[order[a]]), blob)):
                cols[name].append(value)
        if len(order):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)

    def unite(table: pa.Table) -> pa.Table:
        words, automaton = united(table["blob"].to_pylist())
        whole, lang, single = table["whole"][0].as_py(), table["lang"][0].as_py(), table["range"][0].as_py() >= ranges
        words = [b"", *words]
        out = {"lang": [], "phrase": [], "k": [], "f": []}
        for k, (rows, weight, _) in enumerate(automaton.prefixes(), 1):
            if single and k == 1:
                out["phrase"], out["k"], out["f"] = [None], [0], [int(weight.sum())]
            if single != (k == 1):
                continue
            at = np.flatnonzero(weight >= (least if whole or k == LONGEST else 1))
            out["phrase"] += [b" ".join([words[i] for i in r]).decode() for r in rows[at, :k].tolist()]
            out["k"] += [k] * len(at)
            out["f"] += weight[at].tolist()
        out["lang"] = [lang] * len(out["f"])
        return pa.table(out, schema=pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())]))

    parts = texts.mapInArrow(run, "lang string, range long, share long, whole boolean, blob binary")
    found = parts.groupBy("lang", "range", "share").applyInArrow(unite, "lang string, phrase string, k int, f long")
    return found.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("k") == 0))


def part_counts(phrases: DataFrame, questions: DataFrame) -> DataFrame:
    """``questions`` (lang, part, phrase, cut, side) with f, the count of the part among ``phrases`` (lang, phrase, f).

    Both are sorted alike, so a partition's phrases make an automaton a batch, which is composed with the questions of the batch; only the last phrase goes on
    to the next batch. A part that many phrases ask for is dealt by salt.
    """
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    asked = questions.select("lang", "part", salt.alias("salt"), F.lit(1).alias("kind"), "phrase", "cut", "side", F.lit(None).cast("long").alias("f"))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"),
                           F.lit(None).cast("string").alias("phrase"), F.lit(None).cast("int").alias("cut"), F.lit(None).cast("int").alias("side"), "f")
    names = ["lang", "phrase", "cut", "side", "f"]

    def run(batches):
        last = None
        for batch in batches:
            langs, parts, kinds, f = (batch.column(i).to_pylist() for i in (0, 1, 3, 7))
            table = ([last] if last else []) + [((g, p), n) for g, p, kind, n in zip(langs, parts, kinds, f) if kind == 0]
            last = table[-1] if table else None
            table = dict(table)                                      # a phrase comes once for each salt
            at = np.flatnonzero(np.array(kinds) == 1)
            if not len(at):
                continue
            ids = Ids({"": 0})

            def rows(keys):
                # The language goes before the first word, which has no blank.
                out = np.zeros((len(keys), LONGEST), dtype=np.int32)
                for i, (g, p) in enumerate(keys):
                    for k, w in enumerate(p.split(" ")):
                        out[i, k] = ids[f"{g} {w}" if k == 0 else w]
                return out

            automaton = CountAutomaton(*summed(rows(list(table)), np.array(list(table.values()), dtype=np.int64)))
            found = automaton.compose(rows([(langs[i], parts[i]) for i in at.tolist()]))
            took = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([took.column(0), took.column(4), took.column(5), took.column(6), pa.array(found)], names=names)

    keys = ["lang", "part", "salt"]
    both = known.unionByName(asked).select("lang", "part", "salt", "kind", "phrase", "cut", "side", "f").repartition(*keys).sortWithinPartitions(*keys, "kind")
    return both.mapInArrow(run, "lang string, phrase string, cut int, side int, f long")


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to four words, by score, count, then phrase.

    ``docs`` needs text and lang; other columns are ignored. A null text is empty, a null lang is ``und``. Words are runs without blank and tab inside pieces that
    punctuation and line ends part. A phrase's score is that of its worst cut in two, of equal ones the first. A phrase inside a longer one of at least
    ``covered`` percent of its count is left out. Repeated rows count each. Without words there are no rows. Texts of any length are read in parts.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    length = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(max((length // 8).bit_length(), 16), MOST_BITS)
    heavy, full = pair_table(texts, bits, least)
    counted = cut_lineage(phrase_counts(texts, heavy, full, least, range_windows), "phrases")
    phrases, longer = counted.filter("k > 0"), counted.filter("k > 1")
    tokens = F.split("phrase", " ")
    cuts = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("part")),
                              F.struct(F.lit(1).alias("side"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k")), " ").alias("part")))).alias("s")
    questions = longer.select("lang", "phrase", "k", tokens.alias("w"), cuts).select("lang", "phrase", "cut", sides).select("lang", "phrase", "cut", "s.side", "s.part")
    answers = (part_counts(phrases, questions).groupBy("lang", "phrase", "cut")
               .agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")))
    scored = (answers.join(longer.select("lang", "phrase", F.col("f").alias("a")), ["lang", "phrase"])
              .withColumn("score", F.expr("(2000000 * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + r)").cast("long"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")))
    places = F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))"))
    inner = (longer.filter("k > 2").select("lang", "k", "f", tokens.alias("w")).select("lang", "f", places.alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("f").alias("covering")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .filter(F.col("covering").isNull() | F.expr(f"100 * cast(covering AS decimal(20,0)) < {int(covered)} * cast(a AS decimal(20,0))")))
    order = W.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counted.filter("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").alias("score")).withColumn(
        "rank", F.col("rank").cast("long"))


ship(__name__)
