"""License scan: Aho-Corasick over normalised words, and identifier tags whose expressions a shunting-yard parser evaluates.

Edge cases: a null text is an empty one with score 1 (nothing restricts it); repeated rows give one result each; empty tables give
empty results; other columns are ignored. Texts are scanned whole, one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_of

#: The contract's phrases.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method, as normalised words.
NOTICES = {
    "apache license": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "isc license": "isc",
    "spdx license identifier": "spdx",
}
#: How freely text under an identifier may be used, by its beginning; the first that fits holds.
FREEDOM = (
    ("cc0", 1.0), ("unlicense", 1.0), ("public-domain", 1.0), ("0bsd", 1.0), ("mit", 0.95), ("isc", 0.95), ("bsd", 0.9), ("apache", 0.9), ("zlib", 0.9), ("cc-by-nc", 0.2), ("cc-by-nd", 0.2),
    ("cc-by-sa", 0.5), ("cc-by", 0.8), ("mpl", 0.6), ("epl", 0.6), ("lgpl", 0.5), ("agpl", 0.2), ("gpl", 0.3), ("reserved", 0.0),
)
UNKNOWN = 0.4

#: Bytes that are in no word become spaces and A-Z small letters; bytes from 128 on are parts of words.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
TAG = re.compile(r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+\-() \t]+)")
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+\-]+")
RANK = {"or": 1, "and": 2, "with": 3}


def normal(text: str) -> str:
    """The words in small letters, with one space around each."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "replace") if words else " "


def postfix(expression: str) -> list[str]:
    """Shunting-yard: WITH binds tighter than AND, AND tighter than OR. Reads as far as the expression is well formed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for tok in TOKEN.findall(expression):
        low = tok.lower()
        if low in RANK:
            if not operand:
                break
            while stack and stack[-1] in RANK and RANK[stack[-1]] >= RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif tok == "(":
            if operand:
                break
            stack.append(tok)
        elif tok == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            out.append(low)
            operand = True
    if not operand and stack and stack[-1] in RANK:
        stack.pop()
    out.extend(x for x in reversed(stack) if x != "(")
    return out


def freedom(identifier: str) -> float:
    return next((v for k, v in FREEDOM if identifier.startswith(k)), UNKNOWN)


def evaluate(rpn: list[str]) -> tuple[float, list[str]]:
    """(freedom, identifiers): the licensee picks the freer side of OR, must keep both sides of AND; an exception loosens a little."""
    stack: list[float] = []
    names: list[str] = []
    for tok in rpn:
        if tok in RANK and len(stack) >= 2:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if tok == "or" else min(a, b) if tok == "and" else min(1.0, a + 0.1))
            if tok == "with" and names:
                names.pop()
        elif tok not in RANK:
            stack.append(freedom(tok))
            names.append(tok)
    return (stack[-1] if stack else UNKNOWN), names


def automaton(phrases: dict[str, tuple[str, bool, int]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        a.add_word(f" {phrase} ", value)
    a.make_automaton()
    return a


def patterns(base=BASE, notices=NOTICES) -> dict[str, tuple[str, bool, int]]:
    return {p: (label, False, len(p) + 1) for p, label in notices.items()} | {p: (label, True, len(p) + 1) for p, label in base.items()}


def examine(text: str, auto) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    s = normal(text)
    n_words = s.count(" ") - 1
    n_base, first, last, base, labels = 0, None, None, set(), set()
    at, word = 0, 0
    hits = sorted((end - size, label, is_base) for end, (label, is_base, size) in auto.iter(s))
    for start, label, is_base in hits:
        labels.add(label)
        if is_base:
            word += s.count(" ", at, start)
            at = start
            n_base += 1
            first = word if first is None else first
            last = word
            base.add(label)
    scores = [freedom(x) for x in labels if x != "spdx"]
    if "spdx" in labels:
        for m in TAG.finditer(text):
            score, names = evaluate(postfix(m[1].split("\n")[0]))
            if names:
                scores.append(score)
                labels.update(names)
    labels.discard("spdx")
    return n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=1.0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """One row for each document, where it lies: nothing is shuffled. score: the freedom that the notices leave, 1 without any."""
    found = patterns(base, notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(found)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            rows = [examine(t.as_py(), auto) for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs[text]).alias("text")).mapInArrow(run, SCHEMA)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
