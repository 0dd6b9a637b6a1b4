"""Benchmark decontamination: every passage of the corpus is a query against a BM25 inverted index of test items, with block-max WAND.

Scores are each item's BM25 mass that a passage holds, over the least mass that a passage can hold which passes verification; so
retrieving at 1 loses nothing, and verification by five-word shingles decides. Items are indexed in parts of bounded size; each
part goes to the executors whole, and documents are read where they lie, once for a part, without a shuffle.
Edge cases: null texts are empty; items or documents without words match nothing; null ids of items are ignored, repeated items and
documents give one row each pair; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .words import WORD, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Items of a block that share one bound, and the most characters of items in one part of the index.
BLOCK, PART_CHARS = 8, 8_000_000
#: Share of an item's least passing mass that its commonest words may leave to the bound.
REST = 0.4
K1, B = 1.2, 0.75


def halves(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the last line, or else the last sentence, or else the last third of the words, is the answer."""
    for cut in (text.rstrip().rfind("\n"), max((m.end() for m in re.finditer(r"[.?!:]\s+(?=\S)", text.rstrip())), default=-1)):
        if cut > 0:
            q, a = WORD.findall(text[:cut].lower()), WORD.findall(text[cut:].lower())
            if q and a:
                return q, a
    w = WORD.findall(text.lower())
    k = max(1, len(w) - len(w) // 3)
    return w[:k], w[k:]


class Index:
    """Postings of the items' words, sorted by item, with the largest impact of each block of items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.ids, self.question, self.answer = [], [], []
        for i, text in items:
            q, a = halves(text)
            if q:
                self.ids.append(i)
                self.question.append(q)
                self.answer.append(a)
        words = [q + a for q, a in zip(self.question, self.answer, strict=True)]
        self.lengths = [len(w) for w in words]
        self.stride = max(self.lengths, default=1)
        df = Counter(t for w in words for t in set(w))
        n, mean = len(words), sum(self.lengths) / max(len(words), 1)
        self.term = {t: k for k, t in enumerate(sorted(df))}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        chosen: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.rest = np.zeros(n)
        for i, w in enumerate(words):
            tf = Counter(w)
            norm = K1 * (1 - B + B * len(w) / mean)
            weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in tf.items()}
            # a passage that holds `similarity` of the shingles lacks at most this many distinct words
            size = min(SHINGLE, len(w))
            lacking = math.floor((1 - similarity) * (len(w) - size + 1) + 1e-9)
            least = sum(weight.values()) - sum(sorted(weight.values(), reverse=True)[:lacking])
            least = max(least, 1e-9) * (1 - 1e-9)
            left = 0.0
            for t in sorted(weight, key=lambda t: (-df[t], t)):
                impact = weight[t] / least
                postings[self.term[t]].append((i, impact))
                if left + impact <= REST:
                    left += impact
                else:
                    chosen[self.term[t]].append((i, impact))
            self.rest[i] = left
        self.postings = {t: sorted(p) for t, p in postings.items()}
        self.blocks = (n + BLOCK - 1) // BLOCK
        #: Most that a block's items can get from words outside `chosen`.
        self.block_rest = np.array([self.rest[b * BLOCK : (b + 1) * BLOCK].max() for b in range(self.blocks)])
        # block maxima of the chosen postings, as one array with a start for each term
        self.start = np.zeros(len(self.term) + 1, np.int64)
        block, most = [], []
        for t in range(len(self.term)):
            by: dict[int, float] = {}
            for i, x in chosen.get(t, ()):
                by[i // BLOCK] = max(by.get(i // BLOCK, 0.0), x)
            block += by.keys()
            most += by.values()
            self.start[t + 1] = len(block)
        self.block, self.most = np.array(block, np.int64), np.array(most, float)
        self.block_max = {t: {b: max(x for i, x in p if i // BLOCK == b) for b in {i // BLOCK for i, _ in p}} for t, p in self.postings.items()}

    def open(self, terms: np.ndarray, stride: int) -> list[tuple[int, int]]:
        """(passage, block) pairs whose bound reaches 1, for a document's term numbers (-1: in no item).

        Passage k has the words from k x stride on, 2 x stride of them; so each run of `stride` words is whole in one.
        """
        n = len(terms)
        pos = np.flatnonzero(terms >= 0)
        if not len(pos):
            return []
        t = terms[pos]
        count = self.start[t + 1] - self.start[t]
        pos, t, count = pos[count > 0], t[count > 0], count[count > 0]
        if not len(pos):
            return []
        last = max(0, (n - 1) // stride - 1) if n > stride else 0
        first = np.minimum(pos // stride, last)
        # each word lies in the passage that begins in its stride and in the one before
        passage = np.concatenate([first, first - 1])
        t, count = np.concatenate([t, t]), np.concatenate([count, count])
        inside = (passage >= 0) & (np.concatenate([pos, pos]) < (passage + 2) * stride)
        key = np.unique(passage[inside] * np.int64(len(self.term)) + t[inside])
        passage, t = key // len(self.term), key % len(self.term)
        count = self.start[t + 1] - self.start[t]
        at = np.repeat(self.start[t] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        pair = np.repeat(passage, count) * self.blocks + self.block[at]
        order = np.argsort(pair, kind="stable")
        pair, most = pair[order], self.most[at][order]
        edges = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        total = np.add.reduceat(most, edges)
        pair = pair[edges]
        good = total + self.block_rest[pair % self.blocks] >= 1.0
        return [(int(p) // self.blocks, int(p) % self.blocks) for p in pair[good]]

    def search(self, terms: set[int], block: int) -> list[tuple[int, float]]:
        """WAND over the postings of one block: items of it whose score for the passage's distinct terms reaches 1."""
        low, high = block * BLOCK, (block + 1) * BLOCK
        cursors = []
        for t in terms:
            bound = self.block_max.get(t, {}).get(block)
            if bound:
                cursors.append([[x for x in self.postings[t] if low <= x[0] < high], 0, bound])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= 1.0:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][cursors[pivot][1]][0]
            if cursors[0][0][cursors[0][1]][0] == item:
                score = 0.0
                for c in cursors:
                    if c[0][c[1]][0] == item:
                        score += c[0][c[1]][1]
                        c[1] += 1
                if score >= 1.0:
                    found.append((item, score))
            else:
                for c in cursors[:pivot]:
                    while c[1] < len(c[0]) and c[0][c[1]][0] < item:
                        c[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]
        return found

    def verify(self, item: int, passage: list[str]) -> tuple[float, float, float]:
        """Shares of the item's shingles, of its question's words and of its answer's words that the passage holds."""
        q, a = self.question[item], self.answer[item]
        w = q + a
        size = min(SHINGLE, len(w))
        have = {tuple(passage[k : k + size]) for k in range(len(passage) - size + 1)}
        own = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        bag = Counter(passage)
        share = lambda x: sum((Counter(x) & bag).values()) / len(x) if x else 1.0
        return len(own & have) / len(own), share(q), share(a)

    def leaks(self, text: str, similarity: float = SIMILARITY, part: float = 0.5) -> list[tuple]:
        """(item id, best score, shingle share, question share, answer share) of each item that the text holds."""
        get = self.term.get
        pieces = [np.fromiter((get(w, -1) for w in ws), np.int64, len(ws)) for ws in words_of(text)]
        terms = pieces[0] if len(pieces) == 1 else np.concatenate(pieces) if pieces else np.empty(0, np.int64)
        opened = self.open(terms, self.stride) if len(self.term) else []
        if not opened:
            return []
        names = self.names()  # a word of no item can stay unnamed: it is in no shingle of one
        best: dict[int, tuple] = {}
        by: dict[int, list[int]] = defaultdict(list)
        for p, b in opened:
            by[p].append(b)
        for p, bs in by.items():
            part_terms = terms[p * self.stride : (p + 2) * self.stride].tolist()
            distinct = {t for t in part_terms if t >= 0}
            passage = None
            for b in bs:
                for item, score in self.search(distinct, b):
                    passage = passage or [names[t] if t >= 0 else "" for t in part_terms]
                    whole, q, a = self.verify(item, passage)
                    if whole >= similarity and min(q, a) >= part and (item not in best or best[item][0] < whole):
                        best[item] = (whole, score, q, a)
        return [(self.ids[i], score, whole, q, a) for i, (whole, score, q, a) in sorted(best.items())]

    def names(self) -> list[str]:
        if not hasattr(self, "_names"):
            self._names = sorted(self.term)
        return self._names


SCHEMA = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def parts(items: DataFrame, part_chars: int = PART_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most about `part_chars` characters, each fetched by itself."""
    src = items.select(items["item_id"].cast("long").alias("item_id"), text_of(items["text"]).alias("text")).where("item_id is not null").distinct()
    total = src.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(1.5 * total / part_chars))
    for k in range(n):
        rows = src if n == 1 else src.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted((r["item_id"], r["text"]) for r in rows.collect())


def find(docs: DataFrame, items: DataFrame, *, similarity: float = SIMILARITY, part: float = 0.5, part_chars: int = PART_CHARS) -> DataFrame:
    """A row for each document and test item that the document holds."""
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"]).alias("text")).where("doc_id is not null")
    spark = docs.sparkSession
    out = None
    for held in parts(items, part_chars):
        index = spark.sparkContext.broadcast(Index(held, similarity))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.int64()] * 2 + [pa.float64()] * 4
            for b in batches:
                rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for x in ix.leaks(t.as_py(), similarity, part)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        got = src.mapInArrow(run, SCHEMA)
        out = got if out is None else out.unionByName(got)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "overlap", "question_overlap", "answer_overlap")))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
