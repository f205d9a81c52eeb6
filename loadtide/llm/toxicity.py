"""Toxicity scores of texts restored by a noisy channel.

Writers hide words by look-alike symbols (``1d10t``), by spacing letters out and by repeating them. A token that shows
such signs becomes a lattice of the characters that may be meant; Viterbi decoding under a character trigram model,
counted over all documents, picks the likeliest reading. Where neighbours may mean the same letter a second reading merges them, and the parts of a token between punctuation are
read on their own and together. Restored words are matched with terms (words and beginnings of
words) whose share among labelled toxic texts is significantly above that among the others; a logistic curve
turns the evidence of a text into a score.
"""
import math
import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.llm.common import BATCH_ROWS, cut_lineage, held, map_batches, ship, whole_text

#: Labelled rows that the classifier is fitted on at most, those of smallest hash of doc_id. They bound its terms.
MAX_TRAIN = 20_000
#: Toxic texts that a term must occur in, and the least lower bound of its log-odds.
LEAST_TEXTS, LEAST_ODDS = 3, 1.0
#: Shortest beginning of a word that is a term, and the longest.
SHORTEST, LONGEST = 5, 10
#: Tokens kept in a worker's memory.
TOKENS = 150_000

LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE = 26
#: What a symbol may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e"}
#: Log-probabilities of the channel: a letter as it is, a symbol for a letter, one of two readings of a repeated letter, a gap that parts words.
PLAIN_COST, SYMBOL_COST, REPEAT_COST, GAP_COST = 0.0, -1.5, -0.7, -2.0
OUTER = ".,;:?\"'()[]{}<>%#&*~`^=/\\_-…»«“”„’‘"
LETTER = rf"(?:[^\W_]|[{re.escape(''.join(c for c in LOOKS if not c.isalnum()))}])"
SPACED = re.compile(rf"(?<![^\W_]){LETTER}(?:[\s.\-_*]++{LETTER}){{2,}}(?![^\W_])")
PIECE = re.compile(f"{LETTER}+")
DOUBLE, TRIPLE, RUN = re.compile(r"([^\W\d_])\1"), re.compile(r"([^\W\d_])\1\1"), re.compile(r"([^\W\d_])\1+")
#: Symbols that also end a sentence or part words.
PARTING = "!|+"


def fold(c: str) -> int:
    """Place of a character in the model's alphabet: its base letter, or the edge of a word."""
    return LETTERS.find(unicodedata.normalize("NFD", c)[0].lower()) if c.isalpha() else -1


#: Readings' places, kept: pairs of single characters at most.
CODES: dict = {}
FOLDED = np.array([i if (i := fold(chr(c))) >= 0 else EDGE for c in range(0x250)], dtype=np.int64)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Character trigram counts over all documents; 27 symbols, so the result has a fixed size."""
    def run(batch):
        line = " ".join(batch.column(0).to_pylist())
        codes = np.frombuffer(f" {line} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        s = FOLDED[np.minimum(codes, len(FOLDED) - 1)]
        n = np.bincount(s[:-2] * 729 + s[1:-1] * 27 + s[2:], minlength=27 ** 3)
        at = np.flatnonzero(n)
        return {"gram": at, "n": n[at]}

    rows = map_batches(docs.select(whole_text().alias("text")), run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(27 ** 3)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out


class Channel:
    """Restores tokens under the character model ``counts``."""

    def __init__(self, counts: np.ndarray):
        n = np.asarray(counts, dtype=float).reshape(27, 27, 27) + 0.1
        self.logp = np.log(n / n.sum(axis=2, keepdims=True)).tolist()

    def lattice(self, token: str):
        """For each position the readings (text, cost)."""
        out, i = [], 0
        while i < len(token):
            c, k = token[i], 1
            while i + k < len(token) and token[i + k] == c:
                k += 1
            if c.isalpha():
                out.append([(c, PLAIN_COST)] if k == 1 else [(c * 2, PLAIN_COST)] if k == 2 and not TRIPLE.search(token)
                           else [(c, REPEAT_COST), (c * 2, REPEAT_COST)])
                i += k
            elif k > 2 and c in LOOKS:
                out.append([(x * n, SYMBOL_COST + REPEAT_COST) for x in LOOKS[c] for n in (1, 2)] + parting(c))
                i += k
            else:
                out.append([(x, SYMBOL_COST) for x in LOOKS.get(c, "")] + parting(c) or [("", SYMBOL_COST)])
                i += 1
        return out

    def merged(self, token: str):
        """A lattice of single characters, and for each the letters that it may repeat."""
        return [[(x, SYMBOL_COST if c in LOOKS else PLAIN_COST) for x in readings(c)] + parting(c) or [("", SYMBOL_COST)] for c in token], [readings(c) for c in token]

    def decode(self, lattice, repeats=None):
        """Viterbi over states of the last two characters. With ``repeats`` a position may be one more of the letter before it, if that is among its own."""
        beam = {(EDGE, EDGE): (0.0, None, "")}                       # score, reading and what was before it, last character
        for at, items in enumerate(lattice):
            after = {}
            coded = [(text, cost, codes(text)) for text, cost in items]
            for (a, b), (score, path, last) in beam.items():
                if repeats and last and last in repeats[at] and ((a, b) not in after or after[a, b][0] < score + REPEAT_COST):
                    after[a, b] = (score + REPEAT_COST, path, last)
                for text, cost, zs in coded:
                    x, y, s = a, b, score + cost
                    for z in zs:
                        s += self.logp[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or after[x, y][0] < s:
                        after[x, y] = (s, (path, text), text[-1:] or last)
            beam = after
        _, path = max(((s + self.logp[x][y][EDGE], path) for (x, y), (s, path, _) in beam.items()), key=lambda r: r[0])
        out = []
        while path:
            path, text = path
            out.append(text)
        return "".join(reversed(out))

    def restore(self, token: str) -> set:
        """The words that a lower-cased token may be."""
        pieces = PIECE.findall(token)
        out = {w for p in pieces for w in self.read(p)}
        return out | self.read("".join(pieces)) if len(pieces) > 1 else out

    def read(self, word: str) -> set:
        """Readings of letters and look-alikes: as written, and with neighbours that may be one letter merged."""
        bare = word.rstrip("!$|+") or word
        if bare.isalpha():
            out = {self.decode(self.lattice(bare)) if TRIPLE.search(bare) else bare}
            if DOUBLE.search(bare):
                out.update(self.decode(*self.merged(bare)).split())
            return out
        if not any(c.isalpha() for c in word) or not any(c in LOOKS for c in word):
            return {"".join(c for c in word if c.isalpha())}
        word = word.rstrip("!") if bare != word and not any(c in LOOKS for c in bare) else word
        lattice, repeats = self.merged(word)
        plain = self.lattice(word)
        ways = [self.decode(plain), self.decode(gaps(plain))]
        if any(set(a) & set(b) for a, b in zip(repeats, repeats[1:])):
            ways += [self.decode(lattice, repeats), self.decode(gaps(lattice), repeats)]
        return {w for text in ways for w in text.split()}

    def joined(self, text: str) -> list:
        """Words of the runs of spaced-out letters in a lower-cased text."""
        words = []
        for run in SPACED.findall(text):
            letters = "".join(PIECE.findall(run))
            for form in {letters, letters.rstrip("!|+$") or letters}:
                lattice = [[(x, PLAIN_COST) for x in readings(c)] or [("", SYMBOL_COST)] for c in form]
                repeats = [readings(c) for c in form]
                alike = any(set(a) & set(b) for a, b in zip(repeats, repeats[1:]))
                for way in (lattice, gaps(lattice)):
                    words += self.decode(way).split()
                    words += self.decode(way, repeats).split() if alike else []
        return words


def readings(c: str) -> str:
    """The letters that a character may be."""
    return c if c.isalpha() and c not in LOOKS else LOOKS.get(c, "")


def parting(c: str) -> list:
    return [(" ", GAP_COST)] if c in PARTING else []


def gaps(lattice: list) -> list:
    """The lattice with a gap possible before each reading but the first."""
    return lattice[:1] + [r + [(" " + t, c + GAP_COST) for t, c in r] for r in lattice[1:]]


def codes(text: str) -> tuple:
    """Places of a reading's characters in the model's alphabet."""
    if text not in CODES:
        CODES[text] = tuple(EDGE if (z := fold(c)) < 0 else z for c in text)
    return CODES[text]


def term_keys(word: str) -> list:
    """Terms of a word: itself and its beginnings."""
    if len(word) < 3:
        return []
    return ["=" + word] + [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)]


class Words(dict):
    """token -> restored words, kept."""

    def __init__(self, channel):
        self.channel = channel

    def __missing__(self, token):
        found = self.channel.restore(token)
        if len(token) < 40:
            if len(self) >= TOKENS:
                self.clear()
            self[token] = found
        return found


def restored(text: str, words: Words):
    """Number of tokens and set of restored words of a text."""
    low = text.lower()
    tokens = low.split()
    out = set().union(*map(words.__getitem__, set(tokens)))
    if SPACED.search(low):
        out.update(words.channel.joined(low))
    out.discard("")
    return len(tokens), out


def single(word: str) -> str:
    """Each run of a letter once: the same for all readings of a word that merge or keep repeated letters."""
    return RUN.sub(r"\1", word)


class Model:
    """Term counts and the logistic curve."""

    def __init__(self, counts, terms, n_toxic, n_clean, curve=None):
        self.counts, self.terms, self.n_toxic, self.n_clean, self.curve = counts, terms, n_toxic, n_clean, curve
        self.name = uuid.uuid4().hex                                 # under which workers keep its memory

    def odds(self, toxic, clean):
        return math.log((toxic + 0.5) / (self.n_toxic + 1)) - math.log((clean + 0.5) / (self.n_clean + 1))

    def strength(self, word, label=None):
        """The strongest term of a word. With a text's label its own share in the counts is taken out."""
        best = 0.0
        for key in term_keys(word):
            if key in self.terms:
                t, c = self.terms[key]
                if label is not None:
                    t, c = (t - 1, c) if label else (t, c - 1)
                if t >= LEAST_TEXTS - 1:
                    best = max(best, self.odds(t, max(c, 0)))
        return best

    def features(self, n, strengths):
        """Evidence and length of a text of n tokens."""
        total, strong = sum(strengths), max(strengths, default=0.0)
        return [total, strong, total / (1 + n / 100), math.log1p(n)]

    def score(self, text):
        reader = held(self.name, lambda: Reader(self))
        mean, scale, weights = self.curve
        z = weights[0] + sum(w * (x - m) / s for w, x, m, s in zip(weights[1:], self.features(*reader.evidence(text)), mean, scale))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Reader(dict):
    """token -> the terms that its readings hit, as (word, strength) pairs; mostly none. A worker keeps one for all its tasks.

    A word of letters can only hit a term that begins it when each run of a letter is written once, whatever readings merge; others need no decoding.
    """

    def __init__(self, model: Model):
        self.model, self.channel = model, Channel(model.counts)
        self.whole = {single(k[1:]) for k in model.terms if k[0] == "="}
        self.heads = {single(k) for k in model.terms if k[0] != "="}
        self.sizes = sorted({len(h) for h in self.heads})

    def possible(self, word):
        word = single(word) if DOUBLE.search(word) else word
        return word in self.whole or any(word[:k] in self.heads for k in self.sizes)

    def hits(self, words):
        return tuple((w, s) for w in words if (s := self.model.strength(w)) > 0)

    def __missing__(self, token):
        pieces = PIECE.findall(token)
        parts = pieces + ["".join(pieces)] if len(pieces) > 1 else pieces
        if any(not p.isalpha() or self.possible(p) for p in parts):
            found = self.hits(self.channel.restore(token))
        else:
            found = ()
        if len(token) < 40:
            if len(self) >= TOKENS:
                self.clear()
            self[token] = found
        return found

    def evidence(self, text):
        """Number of tokens, and the strength of each distinct word that hits a term."""
        low = text.lower()
        tokens = low.split()
        found = {}
        for hits in map(self.__getitem__, set(tokens)):
            if hits:
                found.update(hits)
        if SPACED.search(low):
            found.update(self.hits(self.channel.joined(low)))
        return len(tokens), list(found.values())


def logistic(x, y, penalty=1.0, steps=50):
    """Weights of a ridge-penalised logistic regression by Newton's method; few columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w)), a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean.tolist(), scale.tolist(), w.tolist()


def held_out():
    """Rows whose labels no model may see."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit the channel on all documents, terms and curve on at most ``max_train`` labelled rows that aren't held out."""
    counts = trigram_counts(docs)
    known = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    texts = docs.select("doc_id", whole_text().alias("text")).join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    channel = Channel(counts)

    def restore(batch):
        words = Words(channel)
        found = [restored(text, words) for text in batch.column(0).to_pylist()]
        return {"toxic": batch.column(1), "n": [n for n, _ in found], "words": [sorted(w) for _, w in found]}

    sample = cut_lineage(map_batches(texts.select("text", F.col("toxic").cast("int").alias("toxic")), restore, "toxic int, n long, words array<string>"), "train")
    totals = {r["toxic"] > 0: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)

    def count_terms(batch):
        found = {}
        for words, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for key in {k for w in words for k in term_keys(w)}:
                pair = found.setdefault(key, [0, 0])
                pair[0 if toxic > 0 else 1] += 1
        return {"term": list(found), "t": [v[0] for v in found.values()], "c": [v[1] for v in found.values()]}

    terms = map_batches(sample.select("words", "toxic"), count_terms, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # A term's log-odds less two standard errors.
    odds = F.expr(f"ln((t + 0.5) / {n_toxic + 1}) - ln((c + 0.5) / {n_clean + 1}) - 2 * sqrt(1 / (t + 0.5) + 1 / (c + 0.5))")
    kept = terms.withColumn("odds", odds).filter((F.col("t") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS)).collect()
    model = Model(counts, {r["term"]: (r["t"], r["c"]) for r in kept}, n_toxic, n_clean)

    def evidence(batch):
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        return {"toxic": batch.column(0), "x": [model.features(n, [s for w in words if (s := model.strength(w, y > 0)) > 0]) for y, n, words in rows]}

    rows = map_batches(sample, evidence, "toxic int, x array<double>").collect()
    if n_toxic and n_clean:
        model.curve = logistic(np.array([r["x"] for r in rows]), np.array([float(r["toxic"] > 0) for r in rows]))
    else:                                                            # nothing to tell apart: the base rate
        base = math.log((n_toxic + 0.5) / (n_clean + 0.5)) if n_toxic + n_clean else -30.0
        model.curve = ([0.0] * 4, [1.0] * 4, [base, 0.0, 0.0, 0.0, 0.0])
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` doc_id with held_out, score (0 to 1) and predicted (1 from ``threshold`` on); one row per row of ``docs``.

    A null text is an empty one and gets the score of no evidence. Repeated rows get equal scores. Rows without a doc_id are scored like any other.
    """
    def run(batch):
        s = [model.score(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": s, "predicted": [int(x >= threshold) for x in s]}

    cols = docs.select("doc_id", whole_text().alias("text"), held_out().alias("held_out"))
    return map_batches(cols, run, f"doc_id {dict(cols.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that the model scores at ``threshold`` or more; one pass, nothing is joined or shuffled."""
    kinds, at = docs.schema, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [model.score(t or "") < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.mapInArrow(run, kinds)


ship(__name__)
