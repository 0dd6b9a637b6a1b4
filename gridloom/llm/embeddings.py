"""Embedding near-dedup: NN-descent on a neighbour graph, links at a cosine threshold, components, exact link counts.

Equal vectors are one node. The graph starts from random hyperplanes' leaves and is refined by joins of neighbours of neighbours;
nodes whose whole list is within the threshold get longer lists. What these lists find is a first answer only, as lists are finite:
nodes of different components then meet in the leaves of as many further trees as leave a pair at the threshold apart with a chance of
at most MISS, and components with a link are merged. An audit follows: a bounded sample of nodes is compared exactly with all nodes;
until one finds no link between components, the next round takes other trees. Links inside a component are counted exactly: a
component is covered by balls of half the threshold's angle, in which all are linked, and only pairs of balls that angles leave open
are compared.
Edge cases: null, zero and non-finite vectors, and those with null components, are nodes without links; vectors of different
lengths have no links; rows with a null id are ignored; of rows with the same id the least vector counts; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, forget, runs_of, table

THRESHOLD = 0.95
K, K_MOST, LEAF, TREES, ROUNDS = 8, 32, 48, 6, 2
#: Vectors in a block that is compared with another.
CHUNK = 256
#: Bytes of vectors that the driver holds and shares at a time when the audit compares nodes with all others.
SLICE = 1 << 24
#: Nodes in a leaf in which components meet, the chance that a pair at the threshold meets in none, nodes in an audit.
MEET, MISS, AUDIT = 512, 1e-4, 2048
#: Projections of a tree at most, and the error of a cosine of vectors rounded to half floats, at most.
DEPTH, BAND = 62, 1.1e-3


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of numbers of a binary column whose values have equal lengths."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def halved(nodes: DataFrame) -> DataFrame:
    """(id, dim, h): the vectors as bytes of half floats, which move a quarter of the bytes and keep cosines to BAND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            small = [np.frombuffer(v, np.float64).astype(np.float16).tobytes() for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(small, pa.binary())], ["id", "dim", "h"])

    return nodes.select("id", "dim", "x").mapInArrow(run, "id long, dim int, h binary")


def verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs (a, b, u, v) whose nodes u and v have a cosine of doubles of at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [float(np.frombuffer(x) @ np.frombuffer(y)) >= threshold for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = nodes.select("id", "x")
    both = pairs.join(x.withColumnRenamed("id", "u").withColumnRenamed("x", "xu"), "u").join(x.withColumnRenamed("id", "v").withColumnRenamed("x", "xv"), "v")
    return both.select("a", "b", "xu", "xv").mapInArrow(run, "a long, b long")


def unit(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, dim, x): unit vectors as bytes of doubles; null where there is no direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, dims = [], []
            for v in b.column(1).to_pylist():
                x = np.array([math.nan if y is None else y for y in v], float) if v else np.empty(0)
                with np.errstate(all="ignore"):
                    big = np.abs(x).max(initial=0.0)
                    ok = len(x) and math.isfinite(big) and not np.isnan(x).any() and big > 0
                    x = x / big if ok else x
                    out.append((x / np.sqrt((x * x).sum()) + 0.0).tobytes() if ok else None)
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "x"])

    src = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).where("vec_id is not null")
    return src.mapInArrow(run, "vec_id long, dim int, x binary")


def _local_join(key: str, k_out: int, floor: float):
    """For each run of a key: the cosines of its members with each other; each member's best `k_out`, as (id, nbr, sim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, key):
            k = t.column(key).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            ids, dim, most = t.column("id").to_numpy(), t.column("dim").to_numpy(), t.column("most").to_numpy()
            h = t.column("h").combine_chunks()
            a, b, s = [], [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if hi - lo < 2:
                    continue
                for d in np.unique(dim[lo:hi]):
                    at = lo + np.flatnonzero(dim[lo:hi] == d)
                    m = _matrix(h.take(pa.array(at)), np.float16).astype(np.float32)
                    own, n = ids[at], len(at)
                    if n < 2:
                        continue
                    c = m @ m.T
                    c[own[:, None] == own[None, :]] = -2.0
                    width = min(max(k_out, int(most[at].max())), n - 1)
                    best = np.argpartition(-c, width - 1, axis=1)[:, :width]
                    rows = np.repeat(np.arange(n), width)
                    sim = c[rows, best.ravel()]
                    good = sim > floor
                    a.append(own[rows[good]])
                    b.append(own[best.ravel()[good]])
                    s.append(sim[good].astype(float))
            cat = lambda z, kind: pa.array(np.concatenate(z) if z else [], kind)
            yield pa.RecordBatch.from_arrays([cat(a, pa.int64()), cat(b, pa.int64()), cat(s, pa.float64())], ["id", "nbr", "sim"])

    return run


def _best(edges: DataFrame, k: int, most: int, threshold: float) -> DataFrame:
    """(id, nbr, sim): each node's best neighbours, `k` of them, and up to `most` while they are within the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (v, s) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                rank = rank + 1 if v == last else 0
                last = v
                keep[i] = rank < k or rank < most and s >= threshold
            yield b.filter(pa.array(keep))

    one = edges.groupBy("id", "nbr").agg(F.max("sim").alias("sim"))
    return one.repartition("id").sortWithinPartitions("id", F.desc("sim"), "nbr").mapInArrow(run, "id long, nbr long, sim double")


def start(nodes: DataFrame, bits: int, trees: int) -> DataFrame:
    """(leaf, id, dim, h): a leaf for each tree, by the signs of random projections. Large leaves are dealt out by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        power = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            dim = b.column(1).to_numpy()
            out = []
            for d in np.unique(dim):
                at = pa.array(np.flatnonzero(dim == d))
                part = b.take(at)
                if int(d) not in planes:
                    if len(planes) >= 64:
                        planes.clear()
                    planes[int(d)] = np.random.default_rng([17, 0, int(d)]).standard_normal((int(d), trees * bits))
                side = (_matrix(part.column(2), np.float16).astype(float) @ planes[int(d)] > 0).reshape(-1, trees, bits)
                code = (side * power).sum(2) + (np.arange(trees, dtype=np.int64) + 1 << 40)
                rows = pa.array(np.repeat(np.arange(part.num_rows), trees))
                out.append(pa.RecordBatch.from_arrays([pa.array(code.ravel()), *(c.take(rows) for c in part.columns)], ["leaf", "id", "dim", "h"]))
            yield from out

    leaves = nodes.select("id", "dim", "h").mapInArrow(run, "leaf long, id long, dim int, h binary")
    size = leaves.groupBy("leaf").count()
    size = size.select("leaf", F.ceil(F.col("count") / (2 * LEAF)).alias("parts"))
    salted = leaves.join(checkpoint(size), "leaf").withColumn("leaf", F.xxhash64("leaf", F.pmod(F.xxhash64("id", "leaf"), F.col("parts"))))
    return salted.select("leaf", "id", "dim", "h", F.lit(0).alias("most"))


def refine(graph: DataFrame, nodes: DataFrame, k: int, most: int, threshold: float) -> DataFrame:
    """One round of NN-descent: at each node, its neighbours and a bounded choice of those it is a neighbour of meet."""
    into = graph.groupBy(F.col("nbr").alias("at"), F.pmod(F.xxhash64("id"), F.lit(k)).alias("slot")).agg(F.max(F.struct("sim", "id")).alias("m")).select("at", F.col("m.id").alias("id"))
    full = graph.groupBy("id").agg(F.min(F.when(F.col("sim") >= threshold, F.lit(1)).otherwise(0)).alias("saturated"))
    meet = graph.select(F.col("id").alias("at"), F.col("nbr").alias("id")).unionByName(into).unionByName(graph.select(F.col("id").alias("at"), "id")).distinct()
    meet = meet.join(full.select("id", F.when(F.col("saturated") == 1, F.lit(most)).otherwise(F.lit(k)).alias("most")), "id", "left").join(nodes.select("id", "dim", "h"), "id")
    meet = meet.select("at", "id", "dim", "h", F.coalesce("most", F.lit(k)).alias("most")).repartition("at").sortWithinPartitions("at")
    found = meet.mapInArrow(_local_join("at", k, 0.3 * threshold), "id long, nbr long, sim double")
    return checkpoint(_best(graph.unionByName(found), k, most, threshold))


def arranged(ids: np.ndarray, component: np.ndarray, m: np.ndarray) -> tuple:
    """(component, vectors, centres, radii, bounds, pure) of vectors in groups around some of them; pure: a group has one component."""
    pivots = m[np.argsort(ids, kind="stable")[::CHUNK]]
    near = np.concatenate([(m[k : k + 4096] @ pivots.T).argmax(1) for k in range(0, len(m), 4096)])
    order = np.lexsort((component, near))
    near, component, m = near[order], component[order], m[order]
    # a group ends where the next pivot's begins; large ones are cut, each part with its own radius
    starts = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
    bounds = np.array([k for lo, hi in zip(starts, [*starts[1:], len(m)], strict=True) for k in range(lo, hi, 4 * CHUNK)] + [len(m)])
    centres = pivots[near[bounds[:-1]]]
    angle = np.arccos(np.clip((m * pivots[near]).sum(1), -1, 1))
    radii = np.maximum.reduceat(angle, bounds[:-1])
    pure = np.minimum.reduceat(component, bounds[:-1]) == np.maximum.reduceat(component, bounds[:-1])
    return component, m, centres, radii, bounds, pure


def across(asked: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): distinct pairs of components between which a node of `asked` has a link to one of `nodes`, by exact comparison.

    Both have (id, dim, x, component). Slices of `asked` of bounded size meet all nodes where those lie; a group of a slice is compared
    with the nodes that angles to its centre leave open and that are not all of its own component.
    """
    spark = nodes.sparkSession
    total = asked.agg(F.coalesce(F.sum(F.length("x")), F.lit(0))).first()[0]
    slices = max(1, math.ceil(total / SLICE))
    limit = math.acos(threshold)
    out = None
    for k in range(slices if total else 0):
        t = asked.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == k).select("id", "dim", "x", "component").toArrow().combine_chunks()
        dim = t.column("dim").to_numpy()
        by = {}
        for d in np.unique(dim):
            own = t.filter(pa.array(dim == d))
            by[int(d)] = arranged(own.column("id").to_numpy(), own.column("component").to_numpy(), _matrix(own.column("x")))
        shared = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, int]] = set()
            for b in batches:
                new: set[tuple[int, int]] = set()
                dim, named = b.column(0).to_numpy(), b.column(2).to_numpy()
                for d, (component, m, centres, radii, bounds, pure) in shared.value.items():
                    at = np.flatnonzero(dim == d)
                    x, own = _matrix(b.column(1).take(pa.array(at))), named[at]
                    if not len(at):
                        continue
                    open_ = np.arccos(np.clip(x @ centres.T, -1, 1)) <= radii + limit + 1e-6
                    for g, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        rows = np.flatnonzero(open_[:, g] & (own != component[lo]) if pure[g] else open_[:, g])
                        if not len(rows):
                            continue
                        linked = (x[rows] @ m[lo:hi].T) >= threshold
                        if linked.any():
                            i, j = np.nonzero(linked & (own[rows][:, None] != component[lo:hi]))
                            u, v = own[rows][i], component[lo:hi][j]
                            pairs = np.unique(np.column_stack([np.minimum(u, v), np.maximum(u, v)]), axis=0)
                            new.update(map(tuple, pairs.tolist()))
                new -= seen
                if len(seen) < 100_000:
                    seen |= new
                rows = sorted(new)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in (0, 1)], ["a", "b"])

        found = checkpoint(nodes.select("dim", "x", "component").mapInArrow(run, "a long, b long").distinct())
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "a long, b long")


def leaves_apart(named: DataFrame, bits: int, trees: int, seed: int, size: int) -> tuple[DataFrame, list[DataFrame]]:
    """(leaf, id, component), and the written tables it reads: for each tree, nodes with equal signs of `bits` random projections, in leaves with several components.

    Leaves of over 4 * size nodes are split by further projections; those that no projection splits are dealt out by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(DEPTH, dtype=np.int64)[::-1]
        for b in batches:
            dim = b.column(1).to_numpy()
            for d in np.unique(dim):
                part = b.take(pa.array(np.flatnonzero(dim == d)))
                m = _matrix(part.column(2))
                rng = np.random.default_rng([17, seed, int(d)])
                for tree in range(trees):
                    code = (m @ rng.standard_normal((int(d), DEPTH)) > 0) @ power
                    same = [pa.array(np.full(len(m), v), pa.int32()) for v in (tree, d)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(code, pa.int64()), part.column(0), part.column(3)], ["tree", "dim", "code", "id", "component"])

    left = named.select("id", "dim", "x", "component").mapInArrow(run, "tree int, dim int, code long, id long, component long")
    out, written = None, []
    for depth in [*range(bits, DEPTH, 4), DEPTH]:
        keyed = checkpoint(left.withColumn("leaf", F.xxhash64("tree", "dim", F.shiftright("code", DEPTH - depth), F.lit(depth))))
        stat = keyed.groupBy("leaf").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        stat = checkpoint(stat.where("lo <> hi").select("leaf", "n"))
        written += [keyed, stat]
        keyed = keyed.join(stat, "leaf")
        done = keyed.where(F.col("n") <= 4 * size).select("leaf", "id", "component")
        out = done if out is None else out.unionByName(done)
        left = keyed.where(F.col("n") > 4 * size).select("tree", "dim", "code", "id", "component", "n")
        if left.isEmpty():
            return out, written
        if depth < DEPTH:
            left = left.drop("n")
    part = F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("n") / size))
    return out.unionByName(left.select(F.xxhash64("tree", "dim", "code", part).alias("leaf"), "id", "component")), written


def bridges(named: DataFrame, threshold: float, bits: int, trees: int, seed: int, size: int) -> DataFrame:
    """(a, b): pairs of components with a link between nodes that share a leaf.

    Vectors travel as half floats, whose error in a cosine has a bound (BAND); what lies within it of the threshold is compared again in
    doubles. A leaf gives a spanning forest of its components' sure links, and all pairs in doubt between those still apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "leaf"):
            k = t.column("leaf").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            ids, component, h = t.column("id").to_numpy(), t.column("component").to_numpy(), t.column("h").combine_chunks()
            got = []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                m = _matrix(h.slice(lo, hi - lo), np.float16).astype(np.float32)
                own = component[lo:hi]
                sim = m @ m.T
                i, j = np.nonzero(np.triu(sim >= threshold - BAND, 1) & (own[:, None] != own))
                if not len(i):
                    continue
                # of the sure links of two components one is enough
                sure = sim[i, j] >= threshold + BAND
                names, at = np.unique(own, return_inverse=True)
                pair = np.minimum(at[i], at[j]) * len(names) + np.maximum(at[i], at[j])
                first = np.flatnonzero(sure)[np.unique(pair[sure], return_index=True)[1]]
                order = np.concatenate([first, np.flatnonzero(~sure)])
                up = {c: c for c in names.tolist()}

                def root(c: int, up: dict[int, int] = up) -> int:
                    while up[c] != c:
                        up[c] = up[up[c]]
                        c = up[c]
                    return c

                i, j = i + lo, j + lo
                for u, v, s in zip(i[order].tolist(), j[order].tolist(), sure[order].tolist(), strict=True):
                    a, b = root(int(component[u])), root(int(component[v]))
                    if a != b:
                        got.append((int(component[u]), int(component[v]), int(ids[u]), int(ids[v]), s))
                        if s:
                            up[a] = b
            kinds = (pa.int64(),) * 4 + (pa.bool_(),)
            names = ["a", "b", "u", "v", "sure"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in got], kind) for c, kind in enumerate(kinds)], names)

    leaves, written = leaves_apart(named, bits, trees, seed, size)
    met = leaves.join(halved(named).select("id", "h"), "id")
    found = checkpoint(met.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, "a long, b long, u long, v long, sure boolean").distinct())
    again = verified(found.where("not sure"), named, threshold)
    out = checkpoint(found.where("sure").select("a", "b").unionByName(again).distinct())
    forget(*written, found)
    return out


def trees_for(threshold: float, bits: int, miss: float) -> int:
    """Trees of `bits` projections of which a pair at the threshold shares no leaf with a chance of at most `miss`."""
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-together))) if together < 1 else 1


def merged(label: DataFrame, nodes: DataFrame, threshold: float, size: int, miss: float, audit: int) -> DataFrame:
    """label (id, component) of nodes with links, after components and single nodes are merged with those that they link to.

    Rounds of `bridges` until an audit is clean: `audit` nodes of least hash, others in each round, are compared exactly with all nodes.
    What an audit finds is merged too.
    """
    label = checkpoint(nodes.select("id").join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    bits = min(DEPTH, max(0, math.ceil(math.log2(max(1, nodes.count() / size)))))
    turn = 0
    while True:
        turn += 1
        named = checkpoint(nodes.select("id", "dim", "x").join(label, "id"))
        label = renamed(label, bridges(named, threshold, bits, trees_for(threshold, bits, miss), turn, size))
        forget(named)
        named = nodes.select("id", "dim", "x").join(label, "id")
        pairs = across(checkpoint(named.orderBy(F.xxhash64("id", F.lit(turn)), "id").limit(audit)), named, threshold)
        if pairs.isEmpty():
            break
        label = renamed(label, pairs)
    several = checkpoint(label.groupBy("component").count().where("count > 1").select("component"))
    return checkpoint(label.join(several, "component", "left_semi").select("id", "component"))


def renamed(label: DataFrame, pairs: DataFrame) -> DataFrame:
    """label after the components of `pairs` (a, b) are one."""
    if pairs.isEmpty():
        return label
    joined = components(pairs).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return checkpoint(label.join(joined, "component", "left").select("id", F.coalesce("to", "component").alias("component")))


def cover(members: DataFrame, threshold: float, rounds: int = 12) -> DataFrame:
    """(component, id, dim, x, weight, ball, angle): balls around the members of least id, inside half the threshold's angle.

    A round makes one ball in each component; members that `rounds` balls leave are balls of their own.
    """
    half = math.acos(threshold) / 2 - 1e-6
    left, out = members, None
    for _ in range(rounds):
        pivot = checkpoint(left.groupBy("component").agg(F.min(F.struct("id", "x")).alias("p")).select("component", F.col("p.id").alias("ball"), F.col("p.x").alias("px")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, p = _matrix(b.column("x")), _matrix(b.column("px"))
                angle = np.arccos(np.clip((x * p).sum(1), -1, 1)) if len(x) else np.empty(0)
                cols = [b.column(c) for c in ("component", "id", "dim", "x", "weight", "ball")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(angle, pa.float64())], ["component", "id", "dim", "x", "weight", "ball", "angle"])

        near = checkpoint(left.join(pivot, "component").select("component", "id", "dim", "x", "weight", "ball", "px").mapInArrow(run, "component long, id long, dim int, x binary, weight long, ball long, angle double"))
        got = near.where((F.col("angle") <= half) | (F.col("id") == F.col("ball")))
        out = got if out is None else out.unionByName(got)
        left = near.where((F.col("angle") > half) & (F.col("id") != F.col("ball"))).select("component", "id", "dim", "x", "weight")
        if left.isEmpty():
            return out
    return out.unionByName(left.select("component", "id", "dim", "x", "weight", F.col("id").alias("ball"), F.lit(0.0).alias("angle")))


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, n): weight of the other nodes of the same component within the threshold, without listing pairs."""
    balls = checkpoint(cover(members, threshold))
    stat = checkpoint(balls.groupBy("component", "ball").agg(F.sum("weight").alias("total"), F.max("angle").alias("radius"), F.count("*").alias("size")))
    inside = balls.join(stat, ["component", "ball"]).select("id", (F.col("total") - F.col("weight")).alias("n"))
    centre = checkpoint(balls.where("id = ball").select("component", "ball", "x"))
    one = stat.join(centre, ["component", "ball"])
    two = one.select("component", *(F.col(c).alias(c + "2") for c in ("ball", "total", "radius", "size", "x")))
    pairs = one.join(two, "component").where("ball <> ball2")

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = math.acos(threshold)
        for b in batches:
            x, y = _matrix(b.column("x")), _matrix(b.column("x2"))
            angle = np.arccos(np.clip((x * y).sum(1), -1, 1)) if len(x) else np.empty(0)
            reach = b.column("radius").to_numpy() + b.column("radius2").to_numpy()
            kind = np.where(angle - reach > limit + 1e-6, 0, np.where(angle + reach < limit - 1e-6, 2, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("component", "ball", "ball2", "total2", "size2")), pa.array(kind, pa.int32())], ["component", "ball", "ball2", "total2", "size2", "kind"])

    judged = checkpoint(pairs.select("component", "ball", "x", "radius", "ball2", "x2", "radius2", "total2", "size2").mapInArrow(open_pairs, "component long, ball long, ball2 long, total2 long, size2 long, kind int").where("kind > 0"))
    whole = balls.select("component", "ball", "id").join(checkpoint(judged.where("kind = 2").groupBy("component", "ball").agg(F.sum("total2").alias("n"))), ["component", "ball"]).select("id", "n")
    # blocks of one ball meet the blocks of the other that angles leave open
    part = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("size") / CHUNK)))
    asked = judged.where("kind = 1").select("component", "ball", "ball2")
    chunks = balls.join(stat.select("component", "ball", "size"), ["component", "ball"]).join(checkpoint(asked.select("component", "ball").distinct()), ["component", "ball"])
    # written first, or the blocks of a ball would be made where the join has put the whole ball
    chunks = checkpoint(chunks.select("component", "ball", part.alias("part"), "id", "weight", "x"))
    block = checkpoint(chunks.groupBy("component", "ball", "part").agg(F.collect_list(F.struct("id", "weight", "x")).alias("m")))
    face = asked.join(block.select("component", "ball", "m"), ["component", "ball"]).join(block.select("component", F.col("ball").alias("ball2"), F.col("m").alias("m2")), ["component", "ball2"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = [], []
            for m, m2 in zip(b.column(0), b.column(1), strict=True):
                m, m2 = m.values, m2.values
                linked = _matrix(m.field("x")) @ _matrix(m2.field("x")).T >= threshold
                ids.append(m.field("id").to_numpy())
                n.append(linked @ m2.field("weight").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z) if z else [], pa.int64()) for z in (ids, n)], ["id", "n"])

    across = face.select("m", "m2").mapInArrow(compare, "id long, n long")
    return inside.unionByName(whole).unionByName(across).groupBy("id").agg(F.sum("n").alias("n"))


def near_dups(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, k: int = K, most: int = K_MOST, trees: int = TREES, rounds: int = ROUNDS, meet: int = MEET, miss: float = MISS, audit: int = AUDIT) -> DataFrame:
    """vec_id, n_links, component_id, kept for each distinct id."""
    given = checkpoint(unit(vectors, vec_id, embedding).groupBy("vec_id").agg(F.min(F.struct("dim", "x")).alias("v")).select("vec_id", "v.dim", "v.x"))
    nodes = checkpoint(given.where("x is not null").groupBy("dim", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    n = nodes.count()
    bits = max(1, min(38, round(math.log2(max(2, n / LEAF)))))
    small = checkpoint(halved(nodes))
    leaves = start(small, bits, trees).repartition("leaf").sortWithinPartitions("leaf")
    graph = checkpoint(_best(leaves.mapInArrow(_local_join("leaf", k, -1.5), "id long, nbr long, sim double"), k, most, threshold))
    for _ in range(rounds):
        before, graph = graph, refine(graph, small, k, most, threshold)
        forget(before)
    doubt = graph.where(F.abs(F.col("sim") - threshold) <= BAND).select(F.col("id").alias("a"), F.col("nbr").alias("b"), F.col("id").alias("u"), F.col("nbr").alias("v"))
    edges = checkpoint(graph.where(F.col("sim") > threshold + BAND).select(F.col("id").alias("a"), F.col("nbr").alias("b")).unionByName(verified(doubt, nodes, threshold)))
    forget(graph, small)
    label = merged(checkpoint(components(edges)), nodes, threshold, meet, miss, audit)
    forget(edges)
    members = checkpoint(label.join(nodes, "id").select("component", "id", "dim", "x", "weight"))
    counts = count_links(members, threshold)
    named = nodes.select("dim", "x", "id", "weight").join(label, "id", "left").join(counts, "id", "left")
    named = checkpoint(named.select("dim", "x", F.coalesce("component", "id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    out = given.join(named, ["dim", "x"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "embeddings"))
