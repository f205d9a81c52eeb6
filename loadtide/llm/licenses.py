"""License scans: identifier tags and notice phrases by one automaton, license expressions by a shunting yard.

A text's words are joined by single spaces; the automaton finds all phrases at once in that line, and the number of spaces
before a match is its first word. Identifier tags are followed by an expression of license names, AND, OR, WITH and
parentheses, which is brought to postfix order and evaluated to its names and its choices.
"""
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.llm.common import held, map_batches, ship, whole_text

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notice phrases of the method: label, and how sure the phrase makes it.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 1.0),
    "mit license": ("mit", 0.8),
    "licensed under the apache license": ("apache-2", 1.0),
    "redistribution and use in source and binary forms": ("bsd", 1.0),
    "bsd 2 clause": ("bsd-2-clause", 0.9),
    "bsd 3 clause": ("bsd-3-clause", 0.9),
    "gnu general public license version 2": ("gpl-2", 1.0),
    "gnu general public license version 3": ("gpl-3", 1.0),
    "gnu general public license": ("gpl", 0.8),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "mozilla public license version 2 0": ("mpl-2.0", 1.0),
    "eclipse public license": ("epl", 0.9),
    "boost software license": ("bsl", 0.9),
    "isc license": ("isc", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by 4 0": ("cc-by", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "cc0 1 0": ("cc0", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 1.0),
    "released into the public domain": ("public-domain", 0.8),
    "all rights reserved": ("proprietary", 0.5),
}
#: How sure a base phrase and an identifier tag are.
BASE_SURE, TAG_SURE = 0.9, 1.0
#: Tags as words; the expression is read from the text behind them.
TAGS = ("spdx license identifier", "license expression")
TAG = re.compile(r"(?:spdx[-_ ]license[-_ ]identifier|license[-_ ]expression)[ \t]*[:=][ \t]*([^\r\n]*)", re.I)
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: Everything up to 7F other than 0-9 and a-z parts words; A-Z are lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(tokens):
    """Shunting yard. Stops before the first token that can't continue the expression; None if nothing is complete."""
    out, ops, operand, done, depth = [], [], True, None, 0

    def unwound():
        return None if "(" in ops else out + ops[::-1]

    for t in tokens:
        low = t.lower()
        if operand:
            if t == "(":
                ops.append(t)
                depth += 1
            elif t == ")" or low in BINDS:
                break
            else:
                out.append(t)
                operand = False
        elif low in BINDS:
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif t == ")" and depth:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        else:
            break
        if not operand and depth == 0:
            done = unwound()
    return done


class Either(frozenset):
    """Alternatives as one part of a way to comply; the way takes any of them."""


def choices(rpn):
    """Ways to comply: a set of frozensets of license names, by OR (either), AND (both) and WITH (an exception to a license).

    AND of several ways with several ways stays factored, as two Either parts of one way: written out, n such factors would be 2 ** n ways.
    """
    stack = []
    for t in rpn:
        if t not in BINDS:
            stack.append({frozenset([t.lower()])})
            continue
        b, a = stack.pop(), stack.pop()
        if t == "or":
            stack.append(a | b)
        elif t == "and":
            whole = min(len(a), len(b)) > 1 or any(isinstance(part, Either) for way in a | b for part in way)
            stack.append({factored(a) | factored(b)} if whole else {x | y for x in a for y in b})
        else:
            stack.append({frozenset(f"{written(n)} with {written(m)}" for n in x for m in y) for x in a for y in b})
    return stack.pop()


def factored(ways):
    """Several ways as one."""
    return next(iter(ways)) if len(ways) == 1 else frozenset([Either(ways)])


def written(part):
    """A name as it is, alternatives as ``(a + b | c)``."""
    return "(" + " | ".join(sorted(way_text(w) for w in part)) + ")" if isinstance(part, Either) else part


def way_text(way):
    return " + ".join(sorted(map(written, way)))


def names_of(ways):
    """All license names in ways to comply."""
    return {n for way in ways for part in way for n in (names_of(part) if isinstance(part, Either) else [part])}


class Scanner:
    """``scan(text)`` gives n_words, base starts, {label: how sure}, {expression as written: choices}."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        sure = {p: (label, BASE_SURE) for p, label in BASE.items()} | {t: (None, TAG_SURE) for t in TAGS}
        for phrase, (label, s) in (NOTICES | sure).items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 1, label, s, phrase in BASE))
        self.automaton.make_automaton()

    def scan(self, text):
        words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
        hits = list(self.automaton.iter(line))
        labels, base, tagged = {}, [], False
        if hits:
            spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32) == 32)
            for end, (size, label, sure, is_base) in hits:
                if label is None:
                    tagged = True
                    continue
                labels[label] = max(sure, labels.get(label, 0.0))
                if is_base:
                    base.append((int(np.searchsorted(spaces, end - size)), label))
        return len(words), base, labels, self.expressions(text) if tagged else {}

    @staticmethod
    def expressions(text):
        found = {}
        for m in TAG.finditer(text):
            rpn = postfix(TOKEN.findall(m[1]))
            if rpn:
                found[" ".join(rpn)] = choices(rpn)
        return found


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions; one row per row of ``docs``.

    n_base counts the places of base phrases, first_word and last_word are the smallest and largest start (words from 0; null without
    any). labels are those of phrases and of the names in tagged expressions, sorted, joined by commas; expressions has the ways to comply, each
    ``a + b``, joined by `` | ``. score is the surest evidence, 0 without any. A null or empty text has no words. Other columns are ignored.
    """
    def run(batch):
        scanner = held("license-scanner", Scanner)
        out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions")}
        for text in batch.column(1).to_pylist():
            n, base, labels, tagged = scanner.scan(text)
            names = {name.replace(",", " ") for ways in tagged.values() for name in names_of(ways)}
            ways = sorted({way_text(way) for some in tagged.values() for way in some})
            starts = [s for s, _ in base]
            for k, v in (("n_words", n), ("n_base", len(base)), ("first_word", min(starts, default=None)), ("last_word", max(starts, default=None)),
                         ("base_labels", ",".join(sorted({x for _, x in base}))), ("labels", ",".join(sorted(names | set(labels)))),
                         ("score", max([TAG_SURE * bool(tagged), *labels.values()])), ("expressions", " | ".join(ways))):
                out[k].append(v)
        return {"doc_id": batch.column(0)} | out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), run,
                       "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string")


ship(__name__)
