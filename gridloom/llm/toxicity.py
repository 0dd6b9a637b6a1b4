"""Toxicity: a noisy-channel decoder restores disguised words, and a lexicon learned from labels scores the restored text.

A character language model (trigrams, counted over all documents) and a channel that writes letters as look-alikes, puts
separators between them or repeats them; Viterbi decoding over the lattice of what each character can stand for gives the likeliest
words: the lattice of a whole token or spaced run, of any length, without a beam. Before that, letters of other scripts that look like
Latin ones, full-width forms and invisible characters are folded. Words, and beginnings of words, that labelled toxic documents hold significantly more often make the lexicon; a logistic model
of a document's strongest and number of lexicon words gives the score.
Edge cases: null texts are empty and get the score of a text without lexicon words; null labels and ids teach nothing; a null id is not
held out; repeated labels count once, toxic if any says so; without labels of both classes every score is the smoothed share of toxic ones;
very long texts and tokens are read whole; of equally likely words the first in the lattice goes first; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table, text_of

#: Labelled rows that the classifier learns from, at most: those of least hash.
SAMPLE = 10_000
#: Letters of the language model; 0 is a word's border, 1 any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
SIDE = 64
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "×": "x", "§": "s", "µ": "u"}
DROPPABLE = ".-_*~'`’·,:/\\ \t\n\r"
#: Costs, in nats, of a look-alike, of a dropped separator, of a hidden letter, of an absorbed repetition.
COSTS = (1.0, 0.5, 3.0, 0.7)
PUNCTUATION = "\"'`’‘“”.,;:!?()[]{}<>«»…—–-_*#%&$/\\|~=+^"
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[\s.\-_*·~/]{1,2}[^\W_]){3,}(?![^\W_])")
PART = re.compile(r"[^\W\d_]+")
ROW = re.compile(r"([^\w\s])\1\1")
DOUBLE = re.compile(r"(.)\1")
#: Letters of other scripts that look like Latin ones: Cyrillic, then Greek.
CONFUSABLE = str.maketrans("авсенікмортухѕјαβεηικνορτυχμ", "abcehikmoptyxsjabenikvoptuxu")
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")


def fold(text: str) -> str:
    """Lower case; compatibility forms as plain ones, without invisible characters."""
    low = text.lower()
    return low if low.isascii() else INVISIBLE.sub("", unicodedata.normalize("NFKC", low))


def _codes() -> np.ndarray:
    code = np.zeros(0x250, np.int64)
    for p in range(0x250):
        c = chr(p)
        if c.isalpha():
            code[p] = LETTERS.index(c) + 2 if c in LETTERS else 1
    return code


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of the letters of all documents' words, SIDE x SIDE x SIDE; what comes to the driver has that size at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, total = _codes(), np.zeros(SIDE**3, np.int64)
        for b in batches:
            for t in b.column(0):
                p = np.frombuffer((" " + t.as_py().lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
                c = np.where(p < 0x250, code[np.minimum(p, 0x24F)], 0)
                border = (c[1:] == 0) & (c[:-1] == 0)
                c = c[np.concatenate([[True], ~border])]
                # ..x00y.. : each word begins after two borders
                at = np.flatnonzero(c == 0)
                c = np.insert(c, at, 0)
                if len(c) > 2:
                    np.add(total, np.bincount((c[:-2] * SIDE + c[1:-1]) * SIDE + c[2:], minlength=SIDE**3), out=total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])

    got = docs.select(text_of(docs["text"]).alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIDE**3)
    out[got["cell"].to_numpy(int)] = got["n"].to_numpy(float)
    return out.reshape(SIDE, SIDE, SIDE)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a b), interpolated with P(c | b) and P(c)."""
    n = len(LETTERS) + 2
    uni = counts.sum((0, 1)) + 0.1
    uni[n:] = 0.1
    uni /= uni.sum()
    two = counts.sum(0)
    two = (two + 20 * uni) / (two.sum(1, keepdims=True) + 20)
    three = (counts + 5 * two[None]) / (counts.sum(2, keepdims=True) + 5)
    return np.log(three).astype(np.float32)


class Decoder:
    """List-Viterbi over the lattice of a token's readings.

    A state is the last two letters and the letter that was last written; of each the `keep` likeliest words are kept, with the
    likeliest way to write each. The first `keep` words of the result are the likeliest of all words of the lattice.
    """

    def __init__(self, model: np.ndarray, keep: int = 3):
        self.array, self.model, self.keep = model, model.tolist(), keep
        self.code = {c: k + 2 for k, c in enumerate(LETTERS)}

    def _put(self, new: dict, key: tuple, paths: list) -> None:
        """A path is (score, hash of the word, (path before, letter))."""
        old = new.get(key)
        if old is None:
            new[key] = paths
            return
        best: dict[int, tuple] = {}
        for p in old + paths:
            if (q := best.get(p[1])) is None or p[0] > q[0]:
                best[p[1]] = p
        new[key] = sorted(best.values(), key=lambda p: -p[0])[: self.keep]

    def _hidden(self, states: dict, new: dict, cost: float) -> None:
        """Any letter may stand here. All states with the same last letter go on together; their words differ."""
        by: dict[int, list] = {}
        for (a, b, _), paths in states.items():
            by.setdefault(b, []).extend((p, a) for p in paths)
        letters = list(self.code.items())
        for b, rows in by.items():
            total = np.array([p[0] for p, _ in rows])[:, None] + self.array[[a for _, a in rows], b][:, 2 : len(letters) + 2].astype(float) - cost
            n = min(self.keep, len(rows))
            best = np.argsort(-total, axis=0, kind="stable")[:n]
            for j, (x, k) in enumerate(letters):
                self._put(new, (b, k, x), [(float(total[i, j]), hash((rows[i][0][1], x)), (rows[i][0][2], x)) for i in best[:, j]])

    def decode(self, token: str, borders: bool = False) -> list[str]:
        """The likeliest words that the token can stand for, best first.

        borders: separators can also end a word, and a reading is several words with spaces.
        """
        look, drop, hide, absorb = COSTS
        states: dict[tuple[int, int, str], list[tuple]] = {(0, 0, ""): [(0.0, 0, None)]}
        for c in token:
            new: dict[tuple[int, int, str], list[tuple]] = {}
            readings = [(x, look) for x in LOOKALIKE.get(c, "")]
            if c in self.code or c.isalpha():
                readings.append((c, 0.0))
            for (a, b, last), paths in states.items():
                for x, cost in readings:
                    k = self.code.get(x, 1)
                    gain = self.model[a][b][k] - cost
                    self._put(new, (b, k, x), [(s + gain, hash((h, x)), (w, x)) for s, h, w in paths])
                    if x == last:
                        self._put(new, (a, b, last), [(s - absorb - cost, h, w) for s, h, w in paths])
                if c in DROPPABLE:
                    self._put(new, (a, b, last), [(s - drop, h, w) for s, h, w in paths])
                    if borders and b:
                        gain = self.model[a][b][0]
                        self._put(new, (0, 0, ""), [(s + gain, hash((h, " ")), (w, " ")) for s, h, w in paths])
            if c in "*#":
                self._hidden(states, new, hide)
            states = new
            if not states:
                return []
        done = [(s + self.model[a][b][0], h, w) for (a, b, _), paths in states.items() for s, h, w in paths]
        return list(dict.fromkeys(self._word(w) for _, _, w in heapq.nlargest(2 * self.keep, done, key=lambda p: p[0])))

    def absorbed(self, word: str) -> str:
        """`decode(word)[0]` of a word of letters without look-alikes: only repetitions can be absorbed, so all readings are scored."""
        runs = [(c, len(list(same))) for c, same in itertools.groupby(word)]
        if math.prod(n for _, n in runs) > 64:
            return (self.decode(word) or [word])[0]
        model, absorb = self.model, COSTS[3]
        states = [(0.0, 0, 0, "")]
        for c, n in runs:
            k, new = self.code.get(c, 1), []
            for s, a, b, w in states:
                for m in range(1, n + 1):
                    s, a, b, w = s + model[a][b][k], b, k, w + c
                    new.append((s - absorb * (n - m), a, b, w))
            states = new
        return max((s + model[a][b][0], w) for s, a, b, w in states)[1]

    @staticmethod
    def _word(w: tuple | None) -> str:
        out = []
        while w is not None:
            w, x = w
            out.append(x)
        return "".join(reversed(out))


def suspicious(core: str) -> bool:
    """Letters mixed with what can stand for letters."""
    letters = sum(c.isalpha() for c in core)
    signs = sum(c in LOOKALIKE or c in DROPPABLE or c in "*#" for c in core)
    return letters > 0 and letters + signs == len(core) and letters * 3 >= signs


def _feature(kind: str, part: str) -> int:
    return xxhash.xxh64_intdigest((kind + part).encode("utf-8", "surrogatepass")) >> 1


def features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings of 3 to 7 letters."""
    n = len(word)
    if n < 3:
        return []
    return [_feature("=", word)] + [_feature(str(k), word[:k]) for k in range(3, min(n, 7) + 1)]


class Reader:
    """What a document's words, as written and restored, are; `of` maps a word to anything and is remembered."""

    most = 300_000

    def __init__(self, decoder: Decoder, of):
        self.decoder, self.of, self.known = decoder, of, {}

    def both(self, run: str) -> set[str]:
        """Its words, with separators dropped and with separators as borders."""
        return {*self.decoder.decode(run), *(w for r in self.decoder.decode(run, borders=True) for w in r.split())}

    def words(self, token: str) -> set[str]:
        if not token.isascii() and any("a" <= c <= "z" for c in token):
            token = token.translate(CONFUSABLE)
        core = token.strip(PUNCTUATION)
        if core.isalpha():
            # only repetitions can be absorbed: the likeliest reading, where that isn't the token itself
            return {core, self.decoder.absorbed(core)} if DOUBLE.search(core) else {core}
        out = set(PART.findall(token))
        # signs at the ends can stand for letters too ("a$$"), but not rows of three ("word$$$")
        edge = token.strip(".,;:?%&#*\"")
        for c in {core, edge} if not ROW.search(edge) else {core}:
            if len(c) >= 3 and suspicious(c):
                out.update(self.both(c) if any(x in DROPPABLE for x in c) else self.decoder.decode(c))
        return out

    def token(self, token: str):
        got = self.known.get(token)
        if got is None:
            core = token.strip(PUNCTUATION)
            # a word of letters reads alike whatever signs surround it
            got = self.token(core) if core != token and core.isalpha() else [v for w in self.words(token) if (v := self.of(w)) is not None] or ()
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[token] = got
        return got

    def read(self, text: str) -> list:
        low = fold(text)
        out: list = []
        for t in set(low.split()):
            if (v := self.known.get(t)) is None:
                v = self.token(t)
            if v:
                out += v
        if len(low) > 6 and (spaced := SPACED.findall(low)):
            for s in set(spaced):
                out += [v for w in sorted(self.both(s)) if (v := self.of(w)) is not None]
        return out


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, y): at most `rows` labelled documents that are not held out, those of least hash."""
    one = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    one = one.where(~held_out()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def lexicon(labelled: DataFrame, model: np.ndarray, totals: tuple[int, int]) -> dict[int, float]:
    """feature -> log-odds weight, of the features that (doc_id, text, y) rows hold significantly more often where y = 1.

    Significant: the likelihood ratio against the base rate exceeds the logarithm of ten times the number of features. The
    features come from a bounded sample of documents, and those that are significant are fewer than a seventh of its toxic words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Decoder(model), features)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found, toxic = [], []
                for t, y in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    own = np.array(list({f for fs in reader.read(t.as_py()) for f in fs}), np.int64)
                    found.append(own)
                    toxic.append(np.full(len(own), y, np.int64))
                if not found:
                    continue
                f, inverse = np.unique(np.concatenate(found), return_inverse=True)
                n, k = np.bincount(inverse, minlength=len(f)), np.bincount(inverse, weights=np.concatenate(toxic), minlength=len(f)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n, pa.int64()), pa.array(k, pa.int64())], ["f", "n", "k"])

    rows, toxic = totals
    if not 0 < toxic < rows:
        return {}
    base = toxic / rows
    counted = checkpoint(labelled.select("text", "y").mapInArrow(run, "f long, n long, k long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("k >= 3"))
    need = math.log(10 * max(counted.count(), 1))
    share = F.col("k") / F.col("n")
    clean = F.col("n") - F.col("k")
    ratio = F.col("k") * F.log(share / base) + F.when(clean > 0, clean * F.log((1 - share) / (1 - base))).otherwise(0.0)
    good = counted.where((share > max(0.5, 2 * base) if base < 0.5 else share > base) & (ratio > need))
    odds = F.log((F.col("k") + 0.5) / (clean + 0.5)) - math.log(base / (1 - base))
    return {r["f"]: r["w"] for r in good.select("f", odds.alias("w")).collect()}


def weigher(weights: dict[int, float]):
    """word -> (weight of its strongest feature), None without one. Weights of beginnings are remembered."""
    known: dict[str, float | None] = {}

    def of(word: str) -> float | None:
        if len(word) < 3:
            return None
        best = weights.get(_feature("=", word))
        for k in range(3, min(len(word), 7) + 1):
            start = word[:k]
            if start in known:
                w = known[start]
            else:
                if len(known) >= Reader.most:
                    known.clear()
                w = known[start] = weights.get(_feature(str(k), start))
            if w is not None and (best is None or w > best):
                best = w
        return best

    return of


def measures(values: list[float]) -> tuple[float, float]:
    return (max(values), math.log1p(len(values))) if values else (0.0, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Coefficients, the first the intercept, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Language model, lexicon and coefficients."""

    def __init__(self, letters: np.ndarray, weights: dict[int, float], coefficients: np.ndarray):
        self.letters, self.weights, self.coefficients = letters, weights, coefficients

    def reader(self) -> Reader:
        return Reader(Decoder(self.letters), weigher(self.weights))

    def score(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + m @ self.coefficients[1:], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """The language model counts all documents; the classifier learns from at most `rows` labelled ones."""
    letters = language_model(letter_counts(docs))
    chosen = checkpoint(sample(labels, rows))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"]).alias("text"))
    labelled = checkpoint(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")))  # chosen has `rows` rows at most
    n, k = labelled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    weights = lexicon(labelled, letters, (n, k))
    if not weights:
        share = (k + 0.5) / (n + 1)
        return Model(letters, {}, np.array([math.log(share / (1 - share)), 0.0, 0.0]))
    plain = Model(letters, weights, np.zeros(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = plain.reader()
        for b in batches:
            m = [measures(reader.read(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in m], pa.float64()), pa.array([x[1] for x in m], pa.float64()), b.column(1)], ["a", "b", "y"])

    got: pd.DataFrame = labelled.select("text", F.col("y").cast("long").alias("y")).mapInArrow(run, "a double, b double, y long").toPandas()
    return Model(letters, weights, logistic(got[["a", "b"]].to_numpy(float), got["y"].to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row, where it lies."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = m.reader()
        for b in batches:
            x = np.array([measures(reader.read(t.as_py())) for t in b.column(1)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(x), pa.float64())], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"]).alias("text")).mapInArrow(run, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
