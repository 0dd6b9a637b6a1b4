"""MinHash near-dedup: DartMinHash signatures of weighted five-word shingles, banded joins, exact verification, components.

A shingle that occurs w times is a region of weight w. Each unit of weight throws darts whose ranks are a Poisson process driven by
hashes, so equal regions throw equal darts in every document; the earliest dart on each coordinate is the signature, and two
documents agree on a coordinate with a chance equal to their weighted Jaccard similarity.

Large buckets are not compared pair by pair. With a common set P, the shingles of x that P lacks and those of P that x lacks are x's
difference d(x); |x ^ y| = |d(x) ^ d(y)| for any P, so x and y reach the threshold if and only if 2 |d(x) & d(y)| >= e(x) + e(y), where
e(x) = |d(x)| - r |x| and r = (1 - t) / (1 + t). Copies of one text have short differences, mostly of their own, from the shingles that
most of them hold: those for which e is low enough link with the member of least e, and the rest can only link with what shares a
shingle of the rarest first part of their differences (a prefix filter, which loses nothing). Long lists of that index are dealt with in
the same way with a P of their own.
Edge cases: null texts are empty; a document without words is in a class of its own; fewer than five words are one shingle; rows with
a null id are ignored; repeated rows count once; of different texts of one id, all count for exact copies and the least for near
ones; very long texts are read in pieces and have as many shingles as words; ties go to the least id; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, forget, runs_of, table, text_of
from .words import Hashes, mix, shingles

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 6: a pair at 0.8 shares none with a chance of 6e-5.
BANDS, ROWS = 32, 6
#: Buckets up to this size are compared pair by pair.
SMALL = 12
#: Members, and shingles of their differences, up to which a list is compared in one piece.
LIST, LIST_UNITS = 256, 4_000_000
#: About so many members, of least hash, make the common set of a group. Results don't depend on it, only the length of lists does.
PIVOT = 32
#: Members of a group that meet one copy of its common set.
PIECE = 512
#: Units of weight, and some for each document's darts, that are worked on at once.
TOGETHER = 200_000
#: Rounding of e.
EPS = 1e-6


def weighted(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and how often each occurs."""
    return np.unique(units, return_counts=True)


def dart_signatures(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """For each (elements, weights): the identifiers of the earliest darts on k coordinates for regions [0, weight) of the elements.

    All parts throw together. A part whose darts leave a coordinate empty throws on, to twice the rank.
    """
    out = np.zeros((len(parts), k), np.uint64)
    todo, scale = np.arange(len(parts)), 1.0
    while len(todo):
        elements = np.concatenate([parts[i][0] for i in todo])
        weights = np.concatenate([parts[i][1] for i in todo]).astype(float)
        part = np.repeat(np.arange(len(todo)), [len(parts[i][0]) for i in todo])
        limits = scale * (k * math.log(k) + 2 * k) / np.bincount(part, weights, len(todo))
        whole = np.ceil(weights).astype(np.int64)
        owner = np.repeat(np.arange(len(elements)), whole)
        unit = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
        live = mix(elements[owner] + mix(unit.astype(np.uint64) + np.uint64(1)))
        height, limit, base = (weights[owner] - unit).clip(max=1.0), limits[part[owner]], part[owner] * k
        rank, n = np.zeros(len(live)), 0
        slots, ranks, darts = [], [], []
        while len(live):
            # a unit's n-th rank is a sum of n exponential gaps
            n += 1
            x = mix(live + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
            rank = rank - np.log(((x >> np.uint64(11)).astype(float) + 1) * 2.0**-53)
            go = np.flatnonzero(rank < limit)
            live, rank, height, limit, base = live[go], rank[go], height[go], limit[go], base[go]
            y = mix(x[go] ^ np.uint64(0xD6E8FEB86659FD93))
            slot = base + (y % np.uint64(k)).astype(np.int64)
            if (height < 1).any():
                hit = (mix(y) >> np.uint64(11)).astype(float) * 2.0**-53 < height
                slots.append(slot[hit]), ranks.append(rank[hit]), darts.append(y[hit])
            else:
                slots.append(slot), ranks.append(rank), darts.append(y)
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
        best = np.full(len(todo) * k, np.inf)
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        sign = np.zeros(len(todo) * k, np.uint64)
        np.maximum.at(sign, slot[first], dart[first])
        done = ~np.isinf(best).reshape(-1, k).any(axis=1)
        out[todo[done]] = sign.reshape(-1, k)[done]
        todo, scale = todo[~done], scale * 2
    return out


def bands(sign: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """The band hashes of each row of signatures."""
    out = np.tile(np.arange(1, n_bands + 1, dtype=np.uint64), (len(sign), 1))
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sign[:, r : n_bands * rows : rows])
    return out.view(np.int64)


def numbered(units: np.ndarray) -> np.ndarray:
    """The sorted shingles with repetition, the k-th of equal ones made another: the similarity of two such sets is weighted."""
    x = np.sort(units)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    nth = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    return np.sort(mix(x + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two arrays of `numbered`."""
    if not len(a) or not len(b):
        return 0.0
    both = int((a[np.minimum(a.searchsorted(b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def signatures(docs: DataFrame, shingle: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, f1, f2, bands): number of shingles, fingerprint of the word sequence and band hashes, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            n, f1, f2, keys = [], [], [], [None] * b.num_rows
            held: list[tuple[int, tuple]] = []

            def throw(held=held, keys=keys):
                for (i, _), x in zip(held, bands(dart_signatures([p for _, p in held], n_bands * rows), n_bands, rows), strict=True):
                    keys[i] = x
                held.clear()

            units = 0
            for i, t in enumerate(b.column(1)):
                h = hashes.of(t.as_py())
                s = shingles(h, shingle)
                n.append(len(s))
                place = mix(np.arange(1, len(h) + 1, dtype=np.uint64))
                f1.append(int(mix(h + place).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(np.bitwise_xor.reduce(mix(mix(h) + place), initial=np.uint64(len(h))).view(np.int64)))
                if len(s):
                    held.append((i, weighted(s)))
                    units += len(s) + 8 * n_bands * rows
                if units > TOGETHER:
                    throw()
                    units = 0
            if held:
                throw()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "f1", "f2", "bands"])

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"]).alias("text")).where("doc_id is not null")
    return src.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def bucketed(reps: DataFrame) -> DataFrame:
    """(key, id, n, size, pop) of the buckets with several members; pop: how many members all its buckets have."""
    keyed = checkpoint(reps.select("id", "n", F.explode("bands").alias("key")).distinct())
    size = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    hit = checkpoint(keyed.join(size, "key"))
    pop = checkpoint(hit.groupBy("id").agg(F.sum("size").alias("pop")))
    out = checkpoint(hit.join(pop, "id").select("key", "id", "n", "size", "pop"))
    forget(keyed, size, hit, pop)
    return out


def pairs_of(pairs: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b, ca, cb), a < b, of rows (x, y) of structs (id, n, component); not those that sizes rule out or one component holds."""
    ok = F.least("x.n", "y.n") >= F.lit(threshold) * F.greatest("x.n", "y.n")
    pairs = pairs.where(ok & (F.col("x.component") != F.col("y.component"))).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb")).distinct()


def first_pairs(hit: DataFrame, small: int, threshold: float) -> DataFrame:
    """All pairs of small buckets; in large ones those with the member that has the most company, the likeliest original of copies."""
    m = F.struct("id", "n", F.col("id").alias("component"))
    few = hit.where(F.col("size") <= small).groupBy("key").agg(F.array_sort(F.collect_list(m)).alias("m"))
    few = few.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as x, y as y))))")).alias("p")).select("p.x", "p.y")
    large = hit.where(F.col("size") > small)
    lead = large.groupBy("key").agg(F.max(F.struct("pop", (-F.col("id")).alias("less"), m.alias("m"))).alias("best")).select("key", F.col("best.m").alias("x"))
    return pairs_of(few.unionByName(large.select("key", m.alias("y")).join(lead, "key").select("x", "y")), threshold)


def groups_of(hit: DataFrame, small: int) -> DataFrame:
    """(g, id, component): the members of the large buckets that hold several components, under the biggest component there.

    Buckets of one family of copies have the same biggest component, so a member stands here once or a few times, not once a band.
    """
    large = hit.where(F.col("size") > small)
    whole = large.groupBy("key", "component").count().groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("count", "component"))["component"].alias("g")).where("parts > 1")
    return large.join(whole.select("key", "g"), "key").select("g", "id", "component").distinct()


def common_sets(rows: DataFrame) -> DataFrame:
    """(g, s, p, t, c): for each group and piece the shingles that most of about `PIVOT` members hold, and those that several hold with
    their counts, which order the differences. A group whose sample is empty has no row and an empty P."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for us in b.column(2).to_pylist():
                t, c = np.unique(np.concatenate([np.frombuffer(u, np.uint64) for u in us]), return_counts=True)
                most = 2 * c > len(us)
                # how many of the sample have the shingle in their differences
                c, keep = np.where(most, len(us) - c, c), most | (c > 1)
                out.append((t[most].tobytes(), t[keep].tobytes(), c[keep].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.binary()) for x in (zip(*out, strict=True) if out else ([], [], [])))], ["g", "pieces", "p", "t", "c"])

    some = rows.where(F.pmod(F.xxhash64("id", "g"), F.greatest(F.lit(1), F.floor(F.col("size") / PIVOT))) == 0)
    some = some.groupBy("g").agg(F.first("pieces").alias("pieces"), F.collect_list("u").alias("us"))
    sets = some.select("g", "pieces", "us").mapInArrow(run, "g long, pieces long, p binary, t binary, c binary")
    return sets.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("s"), "p", "t", "c")


def differences(rows: DataFrame, sets: DataFrame, ratio: float) -> DataFrame:
    """(g, id, component, n, e, d): each member's difference from its group's common set, rarest in the sample first, and its e."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, e, d = [], [], []
            for u, p, t, c in zip(*(b.column(i) for i in range(3, 7)), strict=True):
                u, p, t = (np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid else np.empty(0, np.uint64) for x in (u, p, t))
                x = np.setxor1d(u, p, assume_unique=True)
                count = np.zeros(len(x), np.uint32)
                if len(t):
                    at = np.minimum(t.searchsorted(x), len(t) - 1)
                    count = np.where(t[at] == x, np.frombuffer(c.as_buffer(), np.uint32)[at], count)
                n.append(len(u)), e.append(len(x) - ratio * len(u)), d.append(x[np.lexsort((mix(x), np.maximum(count, 1)))].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(e, pa.float64()), pa.array(d, pa.binary())], ["g", "id", "component", "n", "e", "d"])

    both = rows.withColumn("s", F.pmod(F.xxhash64("id", F.lit(5)), "pieces")).drop("pieces").join(sets, ["g", "s"], "left").select("g", "id", "component", "u", "p", "t", "c")
    return both.mapInArrow(run, "g long, id long, component long, n long, e double, d binary")


def postings(diffs: DataFrame, best: DataFrame, ratio: float) -> DataFrame:
    """(key, g, id, component, size, out): the first part of each difference that a link of an outlier can't avoid, by group and shingle.

    `out`: e is so high that no member of the group links for sure; links of two others are known already. Members meet by strata of
    e: the higher the e of the partners, the more they must have in common and the shorter is the part that meets them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, e, low, worst, most = (b.column(i).to_numpy() for i in (0, 3, 5, 6, 7))
            keys, take, sizes, room = [], [], [], 0
            for k in range(b.num_rows):
                d, seed, before = np.frombuffer(b.column(4)[k].as_buffer(), np.uint64), mix(np.full(1, g[k]).view(np.uint64)), len(keys)
                width = max(1.0, 2 * ratio * most[k])
                # strata from 0 on are outliers
                own, first, last = (math.ceil((x + low[k] - EPS) / width) - 1 for x in (e[k], low[k], worst[k]))
                for c in range(first if own >= 0 else 0, last + 1):
                    if (c + 1) * width - low[k] < e[k] - 2 * ratio * most[k] - EPS:
                        continue  # what so few could differ in is less than the difference of both
                    need = max(1, math.ceil((e[k] + max(c * width - low[k], low[k])) / 2 - EPS))
                    if need > len(d):
                        break
                    meet = np.array([min(own, c) * 1000 + max(own, c)]).view(np.uint64)
                    keys.append(mix(d[: len(d) - need + 1] + mix(seed + mix(meet))).view(np.int64))
                sizes.append(len(d))
                take.append(sum(map(len, keys[before:])))
                room += take[-1]
                if room and (room > TOGETHER or k == b.num_rows - 1):
                    at = np.repeat(np.arange(k + 1 - len(take), k + 1), take)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), *(b.column(i).take(pa.array(at)) for i in (0, 1, 2)), pa.array(np.repeat(np.array(sizes, np.int64), take)), pa.array((e + low > EPS)[at])],
                        ["key", "g", "id", "component", "size", "out"],
                    )
                    keys, take, sizes, room = [], [], [], 0

    both = diffs.join(best.where("worst + low > 0").select("g", "low", "worst", "most"), "g")
    return both.select("g", "id", "component", "e", "d", "low", "worst", "most").mapInArrow(run, "key long, g long, id long, component long, size long, out boolean")


def list_links(rows: DataFrame) -> DataFrame:
    """(ca, cb): the links between components in each list of rows (key, component, out, e, d), exactly, by what differences have in common.

    A list has `LIST` members and `LIST_UNITS` shingles at most.
    """

    def of_list(component: np.ndarray, out: np.ndarray, e: np.ndarray, d: list[np.ndarray]) -> set[tuple[int, int]]:
        n = len(e)
        who = np.repeat(np.arange(n), [len(x) for x in d])
        _, at, count = np.unique(np.concatenate(d), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        shared = count[at] > 1
        who, at = who[shared], number[at[shared]]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        both = np.zeros((n, n), np.float32)
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            i, j = at.searchsorted([lo, lo + 4096])
            m = np.zeros((n, 4096), np.float32)
            m[who[i:j], at[i:j] - lo] = 1
            both += m @ m.T
        linked = (2 * both >= e[:, None] + e - EPS) & (out[:, None] | out) & (component[:, None] < component)
        i, j = np.nonzero(linked)
        return set(zip(component[i].tolist(), component[j].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "key"):
            k, component, out, e = (t.column(c).to_numpy() for c in ("key", "component", "out", "e"))
            d = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("d")]
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            found: set[tuple[int, int]] = set()
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                found |= of_list(component[lo:hi], out[lo:hi], e[lo:hi], d[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["ca", "cb"])

    return rows.select("key", "component", "out", "e", "d").repartition("key").sortWithinPartitions("key").mapInArrow(run, "ca long, cb long").distinct()


def units_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, u): the numbered shingles, as bytes, of the documents that have company."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            u = [numbered(shingles(hashes.of(t.as_py()), shingle)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(u, pa.binary())], ["id", "u"])

    texts = docs.select(docs["doc_id"].cast("long").alias("id"), text_of(docs["text"]).alias("t"))
    texts = texts.join(checkpoint(ids.select("id").distinct()).hint("merge"), "id").groupBy("id").agg(F.min("t").alias("t"))
    return checkpoint(texts.mapInArrow(run, "id long, u binary"))


def verify(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ca, cb, similarity) of the pairs that reach the threshold, by all their shingles. Each join has a key that is unique on one side."""
    both = pairs.join(units.select(F.col("id").alias("b"), F.col("u").alias("ub")), "b").join(units.select(F.col("id").alias("a"), F.col("u").alias("ua")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in batches:
            value = []
            for i, ua, ub in zip(b.column(0).to_pylist(), b.column(4), b.column(5), strict=True):
                if i != last:
                    last, own = i, np.frombuffer(ua.as_buffer(), np.uint64)
                value.append(similarity(own, np.frombuffer(ub.as_buffer(), np.uint64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(value, pa.float64())], ["a", "b", "ca", "cb", "similarity"])

    return both.select("a", "b", "ca", "cb", "ua", "ub").mapInArrow(run, "a long, b long, ca long, cb long, similarity double").where(F.col("similarity") >= threshold)


def renamed(rows: DataFrame, step: DataFrame) -> DataFrame:
    """The rows with the present name of each component."""
    return rows.join(step, F.col("component") == F.col("was"), "left").withColumn("component", F.coalesce("now", "component")).drop("was", "now")


def classes(docs: DataFrame, *, threshold: float = SIMILARITY, shingle: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS, small: int = SMALL, most: int = LIST) -> DataFrame:
    """doc_id, class_id (least id of the documents that chains of links reach), kept, for each distinct id.

    Documents with equal words are one node. All pairs of a bucket with up to `small` nodes are compared; in larger ones, those that
    share the first part of a difference. Lists of up to `most` members are compared exactly, longer ones are groups of the next level:
    their members agree on the shingle that they share, and a list holds about half of its group at most, as the common set has what
    most members hold.
    """
    s = checkpoint(signatures(docs, shingle, n_bands, rows))
    reps = checkpoint(s.where("bands is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    hit = bucketed(reps)
    names, member = checkpoint(reps.select("f1", "f2", "n", F.col("id").alias("component"))), checkpoint(s.drop("bands"))
    forget(reps, s)
    units = units_of(docs, hit, shingle)
    steps: list[DataFrame] = []

    def joined(found: DataFrame) -> DataFrame | None:
        """The new names of the components that links (ca, cb) join."""
        found = checkpoint(found)
        if found.isEmpty():
            return None
        steps.append(checkpoint(components(found, "ca", "cb").select(F.col("id").alias("was"), F.col("component").alias("now"))))
        forget(found)
        return steps[-1]

    pairs = checkpoint(first_pairs(hit, small, threshold))
    step = joined(verify(pairs, units, threshold).select("ca", "cb").distinct())
    forget(pairs)
    named = hit.withColumn("component", F.col("id"))
    group = checkpoint(groups_of(named if step is None else renamed(named, step), small))
    forget(hit)
    ratio = (1 - threshold) / (1 + threshold)
    while not group.isEmpty():
        sizes = checkpoint(group.groupBy("g").agg(F.count("*").alias("size")).withColumn("pieces", F.ceil(F.col("size") / PIECE)))
        full = checkpoint(group.join(sizes, "g").join(units, "id").select("g", "id", "component", "u", "size", "pieces"))
        diffs = checkpoint(differences(full, common_sets(full), ratio))
        best = checkpoint(diffs.groupBy("g").agg(F.min("e").alias("low"), F.max("e").alias("worst"), F.max("n").alias("most"), F.min_by("component", F.struct("e", "id")).alias("first")))
        forget(full, group, sizes)
        sure = diffs.join(best.select("g", "low", "first"), "g").where((F.col("e") + F.col("low") <= EPS) & (F.col("component") != F.col("first")))
        index = checkpoint(postings(diffs, best, ratio))
        same = (F.bit_xor(F.xxhash64("id", "out")).alias("m1"), F.bit_xor(F.xxhash64("out", "id")).alias("m2"))
        lists = index.groupBy("key").agg(F.count("*").alias("members"), F.sum("size").alias("units"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.max("out").alias("outs"), *same)
        # of lists with the same members one is enough
        lists = lists.where("outs and c1 <> c2").groupBy("members", "units", "m1", "m2").agg(F.min("key").alias("key"))
        lists = checkpoint(lists.select("key", ((F.col("members") <= most) & (F.col("units") <= LIST_UNITS)).alias("few")))
        live = checkpoint(index.join(lists, "key").select("key", "g", "id", "component", "out", "few"))
        within = list_links(live.where("few").join(diffs.select("g", "id", "e", "d"), ["g", "id"]))
        step = joined(sure.select(F.col("component").alias("ca"), F.col("first").alias("cb")).unionByName(within).distinct())
        left = live.where("not few").select(F.col("key").alias("g"), "id", "component").distinct()
        left = left if step is None else renamed(left, step)
        several = left.groupBy("g").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("g")
        group = checkpoint(left.join(several, "g").select("g", "id", "component"))
        forget(diffs, best, index, lists, live)
    forget(units, group)
    out = member.join(names, ["f1", "f2", "n"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    for step in steps:
        out = renamed(out, step)
    out = out.withColumnRenamed("component", "class_id")
    return out.groupBy("doc_id").agg(F.min("class_id").alias("class_id")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
