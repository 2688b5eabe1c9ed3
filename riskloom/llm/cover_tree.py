"""Exact cosine links between vectors by dual traversal of cover trees.

On unit vectors a cosine bound is a distance bound, so the triangle inequality prunes.
Equal vectors form a class first. A coarse cover, fitted on a bounded sample, deals all
classes to cells; cells are cut into blocks of bounded size. Every block holds a cover
tree: nested levels of halving radii with exact covering radii, points in tree order.
Pairs of cells out of reach of each other are dropped; each other pair of blocks is
traversed from the top level down: node pairs out of reach are pruned, node pairs
wholly within reach are counted without looking inside, the rest is split, and points
are compared in double precision. The first level's pairs are pruned by an upper bound of
their cosine: leading coordinates in single precision, and the lengths of what they leave.
A level that prunes too little is left for the next one.

A task returns one row for each vector that linked: its count and the smallest id of
its group inside the task, never the pairs. Blocks are written once and read by a product
that shuffles none. With vectors that have no structure at all no tree can prune above
the points; the work is then a blocked product of all pairs.
"""

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import row_map, ship_package
from riskloom.llm.graph import components
from riskloom.session import staged

SAMPLE = 4096     # classes, by hash order, that the coarse cover is fitted on
CELLS = 256       # of the coarse cover at most
BLOCK = 4096      # classes in a block on average at most
BUNDLE = 8        # blocks that travel together where there are many
LEVELS = 7        # radii 1, 1/2, ... of a block's tree
EPS = 1e-9        # margin of pruning and counting; points within it are compared
SKETCH = 3        # one coordinate in so many is looked at first
WIDTHS = [1e-6, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8]  # nodes of like radius are pruned by one bound


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of the usable entries, and which they are."""
    size = max((len(v) for v in vectors if v is not None), default=0)
    out, good = np.zeros((len(vectors), size)), np.zeros(len(vectors), bool)
    for k, v in enumerate(vectors):
        if v is not None and len(v) == size and size and not any(x is None for x in v):
            row = np.asarray(v, float)
            peak = np.abs(row).max()
            if np.isfinite(peak) and peak > 0:
                row = row / peak
                out[k], good[k] = row / np.sqrt(row @ row), True
    return out, good


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def coarse_cover(x: np.ndarray, most: int) -> np.ndarray:
    """Centres by farthest-first choice, at most ``most``."""
    if not len(x):
        return x
    chosen, far = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < min(most, len(x)) and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def leading(x: np.ndarray) -> np.ndarray:
    """Orthonormal axes along which the given vectors are longest, one in ``SKETCH`` of all."""
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return axes[:, :max(1, x.shape[1] // SKETCH)]


def sketch(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors on the axes, and the length of the rest: no product is less than the vectors' own."""
    on = x @ axes
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", on, on), 0))
    return np.hstack([on, rest[:, None]]).astype(np.float32)


class Tree:
    """Points in tree order; per level the first point of every node, which is its centre, and its radius.

    ``quick`` has the points' sketches; without them they are compared in all coordinates.
    """

    def __init__(self, ids, weights, x, starts, radii, quick=None):
        self.ids, self.weights, self.x, self.starts, self.radii = ids, weights, x, starts, radii
        self.quick = quick
        self.ends = [np.append(s[1:], len(ids)) for s in starts]
        self.sums = np.concatenate([[0], np.cumsum(weights)])

    @classmethod
    def built(cls, ids: np.ndarray, weights: np.ndarray, x: np.ndarray) -> "Tree":
        near = x.astype(np.float32) @ x.astype(np.float32).T  # for placing points only
        groups, orders = [np.arange(len(ids))], []
        for level in range(LEVELS):
            bound, split = 1 - (0.5 ** level) ** 2 / 2, []
            for rest in groups:
                while len(rest) > 1:
                    inside = near[rest[0], rest] >= bound
                    inside[0] = True
                    split.append(rest[inside])
                    rest = rest[~inside]
                if len(rest):
                    split.append(rest)
            groups = split
            orders.append(np.array([len(g) for g in groups]))
        order = np.concatenate(groups) if groups else np.empty(0, int)
        x = x[order]
        starts, radii = [], []
        for sizes in orders:
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            centre = np.repeat(start, sizes)
            gap = x - x[centre]
            far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            starts.append(start)
            radii.append(np.maximum.reduceat(far, start))
        return cls(ids[order], weights[order], x, starts, radii)

    def nodes(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Centres and radii of a level; below the last one points are nodes of their own."""
        if level == LEVELS:
            return np.arange(len(self.ids)), np.zeros(len(self.ids))
        return self.starts[level], self.radii[level]

    def packed(self) -> dict:
        return {"ids": self.ids.astype("<i8").tobytes(), "weights": self.weights.astype("<i8").tobytes(),
                "x": self.x.astype("<f8").tobytes(),
                "starts": np.concatenate(self.starts).astype("<i4").tobytes(),
                "radii": np.concatenate(self.radii).astype("<f8").tobytes(),
                "nodes": np.array([len(s) for s in self.starts], "<i8").tobytes()}

    @classmethod
    def unpacked(cls, row: dict, axes: np.ndarray | None = None) -> "Tree":
        ids, weights = (np.frombuffer(row[k], "<i8") for k in ("ids", "weights"))
        cuts = np.cumsum(np.frombuffer(row["nodes"], "<i8"))[:-1]
        x = np.frombuffer(row["x"], "<f8").reshape(len(ids), -1)
        return cls(ids, weights, x, np.split(np.frombuffer(row["starts"], "<i4").astype(np.int64), cuts),
                   np.split(np.frombuffer(row["radii"], "<f8"), cuts), None if axes is None else sketch(x, axes))


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    before = np.cumsum(count) - count
    return np.repeat(begin - before, count) + np.arange(count.sum())


def _products(p_begin, p_end, q_begin, q_end) -> tuple[np.ndarray, np.ndarray]:
    """All (left, right) number pairs of pairs of ranges."""
    wide, long = q_end - q_begin, p_end - p_begin
    left = np.repeat(_ranges(p_begin, long), np.repeat(wide, long))
    right = _ranges(np.repeat(q_begin, long), np.repeat(wide, long))
    return left, right


def _near(left: tuple, right: tuple, reach: float, most: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of nodes (coordinates, radii) that may be within reach, or None for more than ``most``."""
    (x, ra), (y, rb) = left, right
    slack = (x.shape[1] + 4) * 2.0 ** -22 + 1e-6  # of products in single precision
    alike = lambda r: [k for k in np.split(np.argsort(r, kind="stable"), np.searchsorted(np.sort(r), WIDTHS)) if len(k)]
    found, n = [], 0
    for j in alike(rb):
        columns = np.ascontiguousarray(y[j].T)
        step = max(1, 250_000 // len(j))  # products stay in the cache
        for i in alike(ra):
            bound = ra[i].max() + rb[j].max() + reach + EPS
            least = np.float32(1 - bound * bound / 2 - slack if bound < 2 else -np.inf)
            for s in range(0, len(i), step):
                at = np.flatnonzero(x[i[s: s + step]] @ columns >= least)
                n += len(at)
                if n > most:
                    return None
                if len(at):
                    found.append((i[s + at // len(j)], j[at % len(j)]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, int),) * 2


def heads(a: Tree, b: Tree, reach: float, least: float) -> tuple[int, np.ndarray, np.ndarray]:
    """The first level that leaves few enough node pairs, or the points, and all of its pairs that may be within reach."""
    for level in range(LEVELS + 1):
        (at_a, ra), (at_b, rb) = a.nodes(level), b.nodes(level)
        most = len(at_a) * len(at_b) / 64 + 1000
        if level < LEVELS and 4 * len(at_a) * len(at_b) > len(a.ids) * len(b.ids):
            continue  # hardly fewer nodes than points, but wider
        if a.quick is not None and b.quick is not None:
            pairs = _near((a.quick[at_a], ra), (b.quick[at_b], rb), reach, most)
            if pairs is not None:
                return level, *pairs
        pairs = _near((a.x[at_a].astype(np.float32), ra), (b.x[at_b].astype(np.float32), rb), reach,
                      most if level < LEVELS else np.inf)
        if pairs is not None:
            return level, *pairs


def traverse(a: Tree, b: Tree, reach: float, least: float) -> tuple[np.ndarray, np.ndarray, list]:
    """Linked weights of a's and b's points, and links (a's place, b's place) that connect them.

    Both trees may be the same: every point then also meets itself, which the caller takes off.
    """
    gain_a, gain_b = np.zeros(len(a.ids) + 1, np.int64), np.zeros(len(b.ids) + 1, np.int64)
    links: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(level, p, q, gap):
        """Counts node pairs within reach, drops those out of reach; gives the others."""
        ra, rb = a.radii[level][p], b.radii[level][q]
        inside = gap + ra + rb <= reach - EPS
        if inside.any():
            i, j = p[inside], q[inside]
            for gain, starts, ends, k, other, o in ((gain_a, a.starts, a.ends, i, b, j), (gain_b, b.starts, b.ends, j, a, i)):
                amount = other.sums[other.ends[level][o]] - other.sums[other.starts[level][o]]
                np.add.at(gain, starts[level][k], amount)
                np.add.at(gain, ends[level][k], -amount)
            for tree, k, other, o, turn in ((a, i, b, j, False), (b, j, a, i, True)):
                sizes = tree.ends[level][k] - tree.starts[level][k]
                own, met = _ranges(tree.starts[level][k], sizes), np.repeat(other.starts[level][o], sizes)
                links.append((met, own) if turn else (own, met))
        open_ = ~inside & (gap <= ra + rb + reach + EPS)
        return p[open_], q[open_]

    def compare(left, right):
        """Counts point pairs that link."""
        linked = np.einsum("ij,ij->i", a.x[left], b.x[right]) >= least
        i, j = left[linked], right[linked]
        for gain, own, weight in ((gain_a, i, b.weights[j]), (gain_b, j, a.weights[i])):
            np.add.at(gain, own, weight)
            np.add.at(gain, own + 1, -weight)
        links.append((i, j))

    first, p, q = heads(a, b, reach, least)
    if first < LEVELS:
        (centres_a, _), (centres_b, _) = a.nodes(first), b.nodes(first)
        kept = []
        for k in range(0, len(p), 200_000):
            x, y = a.x[centres_a[p[k: k + 200_000]]], b.x[centres_b[q[k: k + 200_000]]]
            gap = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, y), 0))
            kept.append(settle(first, p[k: k + 200_000], q[k: k + 200_000], gap))
        p, q = (np.concatenate(z) for z in zip(*kept, strict=True)) if kept else (np.empty(0, int),) * 2
    else:
        for k in range(0, len(p), 200_000):
            compare(p[k: k + 200_000], q[k: k + 200_000])
        p = q = np.empty(0, int)
    for level in range(first, LEVELS):
        if not len(p):
            break
        last = level == LEVELS - 1
        bounds = []
        for tree, node in ((a, p), (b, q)):
            begin, end = tree.starts[level][node], tree.ends[level][node]
            if not last:
                begin, end = (np.searchsorted(tree.starts[level + 1], z) for z in (begin, end))
            bounds += [begin, end]
        amount = (bounds[1] - bounds[0]) * (bounds[3] - bounds[2])
        piece = np.searchsorted(np.cumsum(amount), np.arange(0, amount.sum(), 200_000), "right")
        cuts = np.unique(np.append(piece, len(p)))
        kept = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            left, right = _products(*(z[s:e] for z in bounds))
            if last:
                compare(left, right)
            else:
                x, y = a.x[a.starts[level + 1][left]], b.x[b.starts[level + 1][right]]
                gap = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, y), 0))
                kept.append(settle(level + 1, left, right, gap))
        p, q = (np.concatenate(z) for z in zip(*kept, strict=True)) if kept else (np.empty(0, int),) * 2
    return np.cumsum(gain_a)[:-1], np.cumsum(gain_b)[:-1], links


def groups(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest id of each place's group under links between places."""
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    label, by_rank = rank.copy(), ids[np.argsort(ids, kind="stable")]
    while len(left):
        low = np.minimum(label[left], label[right])
        grown = label.copy()
        np.minimum.at(grown, left, low)
        np.minimum.at(grown, right, low)
        np.minimum.at(grown, np.argsort(rank)[label], grown)  # a place's label follows too
        grown = grown[np.argsort(rank)[grown]]
        if (grown == label).all():
            break
        label = grown
    return by_rank[label]


def linked_within(a: Tree, b: Tree, same: bool, least: float) -> pd.DataFrame:
    """node, links, root of all points of two blocks that link with each other."""
    reach = float(np.sqrt(2 - 2 * least))
    gain_a, gain_b, links = traverse(a, b, reach, least)
    left = np.concatenate([z[0] for z in links]) if links else np.empty(0, int)
    right = np.concatenate([z[1] for z in links]) if links else np.empty(0, int)
    if same:
        gain, ids = gain_a - a.weights, a.ids
    else:
        gain, ids, right = np.concatenate([gain_a, gain_b]), np.concatenate([a.ids, b.ids]), right + len(a.ids)
    root = groups(ids, left, right)
    some = gain > 0
    return pd.DataFrame({"node": ids[some], "links": gain[some], "root": root[some]})


def link_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and are their own component; vectors link with others of their length only. Rows with equal vectors link with each other, repeated rows included; rows
    of one id are one node of the components. A null id has no component and is kept.
    Only vec_id and embedding are read. An empty table gives an empty result.
    """
    if not 0.5 < least < 1:
        raise ValueError("the trees' radii suit bounds between 0.5 and 1")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("v"))
    peak = F.array_max(F.transform("v", lambda c: F.when(c.isNull() | F.isnan(c), float("inf")).otherwise(F.abs(c))))
    usable = (F.size("v") > 0) & (peak > 0) & (peak < float("inf"))
    good = rows.filter(F.col("vec_id").isNotNull() & usable) \
        .select("vec_id", F.transform("v", lambda c: c + F.lit(0.0)).alias("v"), F.size("v").alias("dims"))
    keyed = staged(good.withColumn("key", F.xxhash64("v")), "vectors")
    classes = staged(keyed.groupBy("key", "v", "dims").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    parts = [_linked(classes.filter(F.col("dims") == dims), dims, least)
             for (dims,) in classes.select("dims").distinct().collect()]  # one row for each length
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "node bigint, links bigint, root bigint")
    for part in parts:
        found = found.union(part)
    found = staged(found, "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = keyed.join(classes.select("key", "v", "rep", "weight"), ["key", "v"]).select("vec_id", "rep", "weight")
    linked = known.alias("k").join(counts.alias("c"), F.expr("k.rep = c.node"), "left") \
        .join(nodes.alias("n"), F.expr("k.rep = n.node"), "left") \
        .select("k.vec_id", (F.coalesce("c.links", F.lit(0)) + F.col("k.weight") - 1).alias("n_links"),
                F.expr("coalesce(n.component, k.rep)").alias("component_id"))
    rest = rows.filter(~F.coalesce(usable, F.lit(False)) | F.col("vec_id").isNull()) \
        .select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(classes: DataFrame, dims: int, least: float) -> DataFrame:
    """node, links, root rows of the classes of one length of vector."""
    spark = classes.sparkSession
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toPandas()
    centres, _ = unit(list(sample["v"]))
    axes = leading(centres)
    centres = coarse_cover(centres, min(CELLS, max(1, -(-n // BLOCK))))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = np.frombuffer(batch.column("v").flatten().buffers()[1], np.float64)
        begin = batch.column("v").flatten().offset
        x = flat[begin: begin + batch.num_rows * dims].reshape(-1, dims)
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        cell, far = np.empty(len(x), np.int32), np.empty(len(x))
        for s in range(0, len(x), 4096):
            gap = distances(x[s: s + 4096], shared.value)
            cell[s: s + 4096], far[s: s + 4096] = gap.argmin(1), gap.min(1)
        return pa.RecordBatch.from_arrays(
            [batch.column("rep"), batch.column("weight"), pa.array([r.tobytes() for r in x], pa.binary()),
             pa.array(cell, pa.int32()), pa.array(far)], ["rep", "weight", "x", "cell", "far"])

    placed = staged(row_map(classes.select("rep", "weight", "v"), assign,
                            "rep bigint, weight bigint, x binary, cell int, far double"), "placed")
    # at most CELLS rows: size and covering radius of every cell
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    cuts = {c: -(-r["n"] // BLOCK) for c, r in cells.items()}
    before = dict(zip(cuts, np.cumsum([0, *cuts.values()]).tolist()))
    of_cell = lambda numbers: F.element_at(F.create_map(*[F.lit(z) for pair in numbers.items() for z in pair]), F.col("cell"))
    block = of_cell(before) + F.pmod(F.xxhash64("rep"), of_cell(cuts).cast("bigint")).cast("int")
    size = max(1, min(BUNDLE, sum(cuts.values()) // 16))
    reach = float(np.sqrt(2 - 2 * least))
    gaps = distances(centres, centres)
    near = {c: [d for d in cells if gaps[c, d] <= cells[c]["radius"] + cells[d]["radius"] + reach + 1e-6] for c in cells}

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        trees = []
        for number, rows in part.sort_values("rep").groupby("block"):
            x = np.frombuffer(b"".join(rows["x"]), np.float64).reshape(-1, dims)
            tree = Tree.built(rows["rep"].to_numpy(), rows["weight"].to_numpy(), x)
            trees.append({"block": int(number), "cell": int(rows["cell"].iloc[0])} | tree.packed())
        held = sorted({t["cell"] for t in trees})
        return pd.DataFrame([{"bundle": int(part["bundle"].iloc[0]), "cells": held, "near": sorted({d for c in held for d in near[c]}),
                              "trees": pickle.dumps(trees)}])

    ship_package(spark)
    bundles = staged(placed.withColumn("block", block).withColumn("bundle", F.floor(F.col("block") / size).cast("int"))
                     .groupBy("bundle").applyInPandas(pack, "bundle int, cells array<int>, near array<int>, trees binary"), "blocks")
    named = lambda prefix: bundles.select(*[F.col(c).alias(f"{prefix}_{c}") for c in bundles.columns])
    # Every pair of bundles once, in either order by turns, so that the parts of the product share them evenly.
    turn = (F.col("a_bundle") < F.col("b_bundle")) == ((F.col("a_bundle") + F.col("b_bundle")) % 2 == 0)
    once = (F.col("a_bundle") == F.col("b_bundle")) | turn
    pairs = named("a").hint("shuffle_replicate_nl").join(named("b"), once & F.expr("arrays_overlap(a_near, b_cells)"))
    tasks = max(bundles.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism)

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpacked = lambda data: [(t["block"], t["cell"], Tree.unpacked(t, axes)) for t in pickle.loads(data)]
        out = [pd.DataFrame({c: np.empty(0, np.int64) for c in ("node", "links", "root")})]
        number, left = None, []
        for k in range(batch.num_rows):
            a, b = batch.column("a_bundle")[k].as_py(), batch.column("b_bundle")[k].as_py()
            if a != number:
                number, left = a, unpacked(batch.column("a_trees")[k].as_py())
            right = left if a == b else unpacked(batch.column("b_trees")[k].as_py())
            out += [linked_within(one, two, i == j, least) for i, c, one in left for j, d, two in right
                    if d in near[c] and (a != b or i <= j)]
        return pa.RecordBatch.from_pandas(pd.concat(out), preserve_index=False)

    columns = [f"{side}_{c}" for c in ("bundle", "trees") for side in "ab"]
    return staged(row_map(pairs.select(*columns).coalesce(tasks), compare, "node bigint, links bigint, root bigint"), "compared")
