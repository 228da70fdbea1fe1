"""Forests and boosted trees grown from histograms of gradients, many fits at a time.

Features become bins once. A tree grows a level at a time: per node, feature and bin, the gradients, Hessians and rows
are added up, running sums over the bins give every cut's gain, the best cut of each node is taken. Fits that share
rows (candidates, folds) share these passes: the fit is part of the key of the sums.

Rows lie in partitions of at most ``ROWS`` rows. With several, Spark adds the sums of a level up over all of them, one
job per level for all fits: sums are shuffled by groups of nodes, the task that adds up a group picks the cuts of its
nodes, and only those reach the driver. Gradients are worked out once per tree and kept with the rows between the jobs;
margins are written every ``BLOCK`` trees. With one partition, the task that holds the rows has the whole sums already
and goes on to the next level and tree by itself, one task per fit. Gradients are multiples of 2**-24, so sums of
doubles are exact and both ways grow the same trees.

Kinds: ``forest`` (weighted Gini, bootstrap counts, features drawn per node), ``first`` (boosting by least squares on
residuals, one Newton step per leaf), ``second`` (gradients and Hessians, a ridge on leaf values, features drawn per tree).
"""

from __future__ import annotations

import json
import pickle
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.rdd import RDD
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.session import delete_path, fresh_path, stage

# The functions below travel to the executors by value, so those need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 1 << 18  # rows of a partition
LEAST = 1 << 13  # rows of a partition that is not split any further to keep all cores busy
NODES = 8  # nodes of a level whose sums travel together
BINS = 128
BLOCK = 10  # trees between two writes of the margins
SHARED = 16  # trees of a forest that grow together
UNIT = 2.0**24
# probability of 0, 0..1, 0..2, ... draws of a row in a bootstrap sample
DRAWS = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


@dataclass(frozen=True)
class Spec:
    """Settings of a fit. ``held`` is the part of the rows that is left out, -1 for none."""

    kind: str
    trees: int
    depth: int
    rate: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    per_node: int = 0
    min_leaf: int = 1
    ridge: float = 0.0
    min_weight: float = 0.0
    seed: int = 42
    held: int = -1


class Tree:
    """A binary tree as arrays in heap order; ``feature`` is -1 for leaves. ``cover`` is what weighs the branches."""

    ARRAYS = ("feature", "cut", "value", "cover", "gain", "sums")

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.feature, self.cut = np.full(n, -1, dtype=np.int16), np.zeros(n, dtype=np.int16)
        self.value, self.cover, self.gain = np.zeros(n), np.zeros(n), np.zeros(n)
        self.sums = np.zeros((3, n))

    def descend(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels, or the leaf above."""
        return descend(self.feature, self.cut, bins, levels)


def descend(features: np.ndarray, cuts: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
    """As of a tree, of whose arrays only the nodes above the last level are read."""
    node = np.zeros(len(bins), dtype=np.int32)
    every = np.arange(len(bins))
    for _ in range(levels):
        feature = features[node]
        right = bins[every, feature] > cuts[node]
        node = np.where(feature < 0, node, 2 * node + 1 + right)
    return node


# --- one level ------------------------------------------------------------------------------------

def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) per row key, a function of key and salt alone."""
    x = key.astype(np.uint64)
    for s in salt:
        x = x + np.uint64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)) / 2.0**53


def gradients(spec: Spec, tree: int, key: np.ndarray, y: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, Hessian and whether the row takes part in this tree."""
    u = uniform(key, spec.seed, tree)
    if spec.kind == "forest":
        times = np.searchsorted(DRAWS, u, side="right")
        return np.round(times * weight * y * UNIT) / UNIT, np.round(times * weight * UNIT) / UNIT, times > 0
    p = 1 / (1 + np.exp(-margin))
    return np.round((y - p) * UNIT) / UNIT, np.round(p * (1 - p) * UNIT) / UNIT, u < spec.rows


def candidates(spec: Spec, tree: int, level: int, n_features: int) -> np.ndarray:
    """The features that each node of a level may split on, ascending: (nodes, number)."""
    nodes = 2**level
    if spec.per_node:
        rng = np.random.default_rng([spec.seed, tree, level])
        return np.sort(np.argsort(rng.random((nodes, n_features)), axis=1)[:, : spec.per_node], axis=1)
    chosen = np.arange(n_features)
    if spec.columns < 1:
        rng = np.random.default_rng([spec.seed, tree])
        chosen = np.sort(rng.permutation(n_features)[: max(1, int(spec.columns * n_features))])
    return np.broadcast_to(chosen, (nodes, len(chosen)))


def level_sums(bins: np.ndarray, place: np.ndarray, features: np.ndarray, g: np.ndarray, h: np.ndarray, n_bins: int) -> np.ndarray:
    """(3, nodes, features, bins): sums of gradients, Hessians and rows; ``place`` is the node within the level."""
    nodes, k = features.shape
    out = np.empty((3, nodes, k, n_bins))
    every, base = np.arange(len(place)), place * n_bins
    for j, own in enumerate(features.T):
        cell = base + (bins[:, own[0]] if (own == own[0]).all() else bins[every, own[place]])
        for sums, x in zip(out, (g, h, None)):
            sums[:, j] = np.bincount(cell, x, nodes * n_bins).reshape(nodes, n_bins)
    return out


def weigh(spec: Spec, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    return n if spec.kind == "first" else h + spec.ridge


def best_cuts(spec: Spec, features: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of nodes with these sums those worth a split: place, feature, cut, gain, sums of the left and of the right rows."""
    upto = sums.cumsum(axis=-1)
    whole = upto[..., -1:]
    left = upto[..., :-1]
    right = whole - left
    (gl, hl, nl), (gr, hr, nr), (g, h, n) = left, right, whole
    wl, wr, w = weigh(spec, hl, nl), weigh(spec, hr, nr), weigh(spec, h, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl**2 / wl + gr**2 / wr - g**2 / w
    gain[~((nl >= spec.min_leaf) & (nr >= spec.min_leaf) & (hl >= spec.min_weight) & (hr >= spec.min_weight) & (wl > 0) & (wr > 0))] = -np.inf
    flat = gain.reshape(len(features), -1)
    best = flat.argmax(axis=1)
    split = np.flatnonzero(flat[np.arange(len(best)), best] > 1e-9)
    slot, cut = np.divmod(best[split], gain.shape[-1])
    return split, features[split, slot], cut, flat[split, best[split]], left[:, split, slot, cut], right[:, split, slot, cut]


def split_nodes(tree: Tree, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Write what ``best_cuts`` found for nodes of the tree, and give their children their sums."""
    tree.feature[nodes], tree.cut[nodes], tree.gain[nodes] = feature, cut, gain
    tree.sums[:, 2 * nodes + 1] = left
    tree.sums[:, 2 * nodes + 2] = right


def grow_level(tree: Tree, spec: Spec, level: int, features: np.ndarray, sums: np.ndarray) -> bool:
    """Split the nodes of a level where that gains, and give their children their sums; whether any was split."""
    if level == 0:
        tree.sums[:, 0] = sums[:, 0, 0].sum(axis=-1)
    split, *found = best_cuts(spec, features, sums)
    split_nodes(tree, 2**level - 1 + split, *found)
    return len(split) > 0


def close(tree: Tree, spec: Spec) -> Tree:
    """Values, covers and gains per unit of cover, once all levels are grown."""
    g, h, n = tree.sums
    tree.cover = weigh(spec, h, n) - spec.ridge * (n > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        tree.value = np.nan_to_num(spec.rate * g / (h + spec.ridge), posinf=0.0, neginf=0.0)
        tree.gain = np.nan_to_num(tree.gain / tree.cover, posinf=0.0, neginf=0.0)
    return tree


def grow(spec: Spec, trees: Sequence[int], bins: np.ndarray, n_bins: int, key: np.ndarray, y: np.ndarray, weight: np.ndarray, start: float) -> list[Tree]:
    """Trees of one fit from all of its rows."""
    out = []
    margin = np.full(len(y), start)
    for t in trees:
        tree = Tree(spec.depth)
        g, h, taken = gradients(spec, t, key, y, weight, margin)
        rows = np.flatnonzero(taken)
        sub, g, h = bins[rows], g[rows], h[rows]
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(spec.depth):
            features = candidates(spec, t, level, bins.shape[1])
            if not grow_level(tree, spec, level, features, level_sums(sub, node - (2**level - 1), features, g, h, n_bins)):
                break
            # rows of leaves drop out
            feature = tree.feature[node]
            inner = feature >= 0
            sub, g, h, node, feature = sub[inner], g[inner], h[inner], node[inner], feature[inner]
            node = 2 * node + 1 + (sub[np.arange(len(sub)), feature] > tree.cut[node])
        out.append(close(tree, spec))
        if spec.kind != "forest":
            margin += tree.value[tree.descend(bins, spec.depth)]
    return out


# --- rows -----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Binned:
    """Rows as bins: ``rows`` holds key, label, part (of which a fit may leave one out), bins; ``cuts`` per feature."""

    rows: DataFrame
    cuts: list[np.ndarray]
    counts: dict[tuple[int, int], int]
    partitions: int

    @property
    def n_bins(self) -> int:
        return max(2, 1 + max(len(c) for c in self.cuts))

    def start(self, spec: Spec) -> tuple[float, dict[int, float]]:
        """Log-odds of the label and balanced class weights over the rows of a fit."""
        n = [sum(k for (part, label), k in self.counts.items() if label == y and part != spec.held) for y in (0, 1)]
        total = sum(n)
        odds = float(np.log(n[1] / n[0])) if all(n) else (0.0 if not total else 20.0 if n[1] else -20.0)
        return odds, {y: total / (2 * n[y]) if n[y] else 1.0 for y in (0, 1)}


def bin_rows(vectors: DataFrame, n_features: int, label: str = "converted", key: str = "lead_id", part: str | None = None, rows: int | None = None) -> Binned:
    """Cut each feature of the ``features`` vector at up to ``BINS`` - 1 quantiles and write the bins of every row.

    A row goes left of a cut if its value is at most the cut. The quantiles are read by the driver: a bounded number.
    """
    cells = vector_to_array("features")
    wide = vectors.select(*[cells[k].alias(f"x{k}") for k in range(n_features)])
    quantiles = wide.approxQuantile(wide.columns, [(k + 1) / BINS for k in range(BINS - 1)], 0.25 / BINS)
    cuts = [np.unique(np.array(q, dtype=float)) for q in quantiles]
    source = vectors.select(F.xxhash64(key).alias("key"), F.col(label).cast("int").alias("label"), (F.lit(0) if part is None else F.col(part).cast("int")).alias("part"), cells.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in bins], type=pa.binary())], names=["key", "label", "part", "bins"])

    binned = stage(source.mapInArrow(run, "key long, label int, part int, bins binary"), "bins")
    counts = {(r["part"], r["label"]): r["n"] for r in binned.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    return Binned(binned, cuts, counts, max(1, -(-sum(counts.values()) // (rows or ROWS))))


def arrays(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, label, part and bins of a batch whose columns start so."""
    key, y, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    bins = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, n_features)
    return key.view(np.uint64), y.astype(float), part, bins


# --- many fits --------------------------------------------------------------------------------------

def _in_tasks(data: Binned, specs: Sequence[Spec]) -> list[list[Tree]]:
    """All rows in one partition: a task for each fit, several for a forest, each with a copy of the rows."""
    units = []
    for k, spec in enumerate(specs):
        step = SHARED if spec.kind == "forest" else spec.trees
        units += [(k, range(t, min(t + step, spec.trees))) for t in range(0, spec.trees, step)]
    starts = [data.start(s) for s in specs]
    n_features, n_bins = len(data.cuts), data.n_bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, unit = [], None
        for batch in batches:
            parts.append(arrays(batch, n_features))
            unit = batch.column(4)[0].as_py()
        if unit is None:
            return
        key, y, part, bins = (np.concatenate(c) for c in zip(*parts))
        fit, trees = units[unit]
        spec, (odds, weights) = specs[fit], starts[fit]
        use = part != spec.held
        key, y, bins = key[use], y[use], bins[use]
        grown = grow(spec, trees, bins, n_bins, key, y, np.where(y > 0, weights[1], weights[0]), odds)
        packed = [pickle.dumps([getattr(t, name) for name in Tree.ARRAYS]) for t in grown]
        yield pa.RecordBatch.from_arrays([pa.array([fit] * len(grown)), pa.array(list(trees)), pa.array(packed)], names=["fit", "tree", "grown"])

    copies = data.rows.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(len(units) - 1))))
    found = copies.repartitionById(len(units), F.col("unit")).mapInArrow(run, "fit long, tree long, grown binary").collect()
    out = [[Tree(s.depth) for _ in range(s.trees)] for s in specs]
    for r in found:  # trees, a number that the settings fix
        for name, values in zip(Tree.ARRAYS, pickle.loads(r["grown"])):
            setattr(out[r["fit"]][r["tree"]], name, values)
    return out


def _blocks(data: Binned, margins: Sequence[float]) -> RDD:
    """The rows as arrays, a partition in blocks of at most ``ROWS`` rows: key, label, part, bins, margins per boosted fit
    and, for the trees that grow, which rows take part with their gradients and Hessians."""
    n_features, n_rows = len(data.cuts), sum(data.counts.values())
    cores = data.rows.sparkSession.sparkContext.defaultParallelism
    # whole rounds of tasks, if the rows are worth it
    tasks = max(data.partitions, min(-(-data.partitions // cores) * cores, n_rows // LEAST))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list) -> pa.RecordBatch:
            key, y, part, bins = (np.concatenate(c) for c in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((key, y, part, bins))], type=pa.binary())], names=["block"])

        parts, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                if n + rows.num_rows > ROWS:
                    yield block(parts)
                    parts, n = [], 0
                parts.append(arrays(rows, n_features))
                n += rows.num_rows
        if parts:
            yield block(parts)

    def unpack(row) -> tuple:
        key, y, part, bins = pickle.loads(row["block"])
        return key, y, part, bins, np.repeat(np.array(margins, dtype=float)[:, None], len(y), axis=1), []

    return data.rows.repartition(tasks, "key").mapInArrow(pack, "block binary").rdd.map(unpack)


def _by_levels(data: Binned, specs: Sequence[Spec]) -> list[list[Tree]]:
    """Rows in many partitions: a job per level adds up the sums of all fits and picks the cuts."""
    spark = data.rows.sparkSession
    starts = [data.start(s) for s in specs]
    n_features, n_bins = len(data.cuts), data.n_bins
    cores = spark.sparkContext.defaultParallelism
    grown: list[list[Tree]] = [[] for _ in specs]
    boosted = [k for k, s in enumerate(specs) if s.kind != "forest"]
    rows = _blocks(data, [starts[k][0] for k in boosted]).persist(StorageLevel.MEMORY_AND_DISK)

    def begin(rows: RDD, batch: list[tuple[int, int]], last: dict[int, tuple]) -> RDD:
        """The rows with the gradients of the next trees, after ``last`` of a fit is added to its margins."""
        def run(block: tuple) -> tuple:
            key, y, part, bins, margins, _ = block
            for at, (feature, cut, value, depth) in last.items():
                margins[at] += value[descend(feature, cut, bins, depth)]
            work = []
            for k, t in batch:
                spec, (_, weights) = specs[k], starts[k]
                margin = margins[boosted.index(k)] if spec.kind != "forest" else np.zeros(len(y))
                g, h, taken = gradients(spec, t, key, y, np.where(y > 0, weights[1], weights[0]), margin)
                use = np.flatnonzero(taken & (part != spec.held))
                work.append((use.astype(np.int32), g[use], h[use]))
            return key, y, part, bins, margins, work

        return rows.map(run)

    def cuts_of(rows: RDD, level: int, active: list[tuple[int, int, int, Tree]]) -> list[tuple]:
        """Per group of nodes of the active (place in the batch, fit, number, tree) its best cuts and the sums of its first node."""
        inner = 2**level - 1
        groups = -(-(2**level) // NODES)
        units = [(u, specs[k], t, tree.feature[:inner], tree.cut[:inner]) for u, k, t, tree in active]

        def add(blocks: Iterator[tuple]) -> Iterator[tuple]:
            for *_, bins, _, work in blocks:
                for at, (u, spec, t, feature, cut) in enumerate(units):
                    use, g, h = work[u]
                    own = bins[use]
                    place = descend(feature, cut, own, level).astype(np.int64) - inner
                    inside = place >= 0
                    if not inside.all():
                        own, place, g, h = own[inside], place[inside], g[inside], h[inside]
                    sums = level_sums(own, place, candidates(spec, t, level, n_features), g, h, n_bins)
                    for group in range(groups):
                        flat = sums[:, group * NODES : (group + 1) * NODES].reshape(3, -1)
                        cell = np.flatnonzero(flat[2])
                        if len(cell):
                            yield at * groups + group, (cell.astype(np.int32), flat[:, cell])

        def pick(parts: Iterator[tuple]) -> Iterator[tuple]:
            total: dict[int, np.ndarray] = {}
            for number, (cell, values) in parts:
                at, group = divmod(number, groups)
                if number not in total:
                    features = candidates(units[at][1], units[at][2], level, n_features)[group * NODES : (group + 1) * NODES]
                    total[number] = np.zeros((3, *features.shape, n_bins))
                total[number].reshape(3, -1)[:, cell] += values
            for number, sums in total.items():
                at, group = divmod(number, groups)
                spec, t = units[at][1:3]
                features = candidates(spec, t, level, n_features)[group * NODES : (group + 1) * NODES]
                split, *found = best_cuts(spec, features, sums)
                yield at, (inner + group * NODES + split, *found), sums[:, 0, 0].sum(axis=-1)

        numbered = rows.mapPartitions(add).partitionBy(min(cores, len(units) * groups), lambda number: number)
        return numbered.mapPartitions(pick).collect()  # bounded by fits and nodes

    def grow_together(rows: RDD, batch: list[tuple[int, int]]) -> None:
        growing = [(u, k, t, Tree(specs[k].depth)) for u, (k, t) in enumerate(batch)]
        active = growing
        for level in range(max(specs[k].depth for k, _ in batch)):
            active = [a for a in active if level < specs[a[1]].depth]
            if not active:
                break
            split = set()
            for at, (nodes, *found), root in cuts_of(rows, level, active):
                tree = active[at][3]
                if level == 0:
                    tree.sums[:, 0] = root
                split_nodes(tree, nodes, *found)
                if len(nodes):
                    split.add(at)
            active = [a for at, a in enumerate(active) if at in split]
        for _, k, _, tree in growing:
            grown[k].append(close(tree, specs[k]))

    for k, spec in enumerate(specs):
        if spec.kind == "forest":
            for t in range(0, spec.trees, SHARED):
                batch = [(k, x) for x in range(t, min(t + SHARED, spec.trees))]
                begun = begin(rows, batch, {}).persist(StorageLevel.MEMORY_AND_DISK)
                grow_together(begun, batch)
                begun.unpersist()
    last: dict[int, tuple] = {}
    written = None
    for t in range(max((specs[k].trees for k in boosted), default=0)):
        batch = [(k, t) for k in boosted if t < specs[k].trees]
        begun = begin(rows, batch, last).persist(StorageLevel.MEMORY_AND_DISK)
        if t and t % BLOCK == 0:  # what was done since is not to be done again if an executor is lost
            path = fresh_path(spark, "margins")
            begun.saveAsPickleFile(path, 1)
            kept = spark.sparkContext.pickleFile(path).persist(StorageLevel.MEMORY_AND_DISK)
        else:
            path, kept = None, begun
        grow_together(kept, batch)
        rows.unpersist()
        if path:
            begun.unpersist()
            if written:
                delete_path(spark, written)
            written = path
        rows = kept
        last = {at: (tree.feature, tree.cut, tree.value, specs[k].depth) for at, k in enumerate(boosted) if t < specs[k].trees for tree in (grown[k][-1],)}
    rows.unpersist()
    if written:
        delete_path(spark, written)
    return grown


def fit_trees(data: Binned, specs: Sequence[Spec]) -> list[list[Tree]]:
    """The trees of every fit; a constant label or no rows give trees of one leaf."""
    return (_in_tasks if data.partitions == 1 else _by_levels)(data, specs)


def predict_held(data: Binned, specs: Sequence[Spec], fitted: list[list[Tree]]) -> DataFrame:
    """(fold, converted, prediction): each row by the fit that left its part out."""
    n_features = len(data.cuts)
    by_part = {s.held: (s, [(t.feature, t.cut, t.value) for t in trees], data.start(s)[0]) for s, trees in zip(specs, fitted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, y, part, bins = arrays(batch, n_features)
            says = np.zeros(len(y), dtype=np.int32)
            for held, (spec, trees, odds) in by_part.items():
                at = np.flatnonzero(part == held)
                own = bins[at]
                total = sum((value[descend(feature, cut, own, spec.depth)] for feature, cut, value in trees), np.zeros(len(at)))
                says[at] = total / len(trees) > 0.5 if spec.kind == "forest" else odds + total > 0
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(says)], names=["fold", "converted", "prediction"])

    return data.rows.mapInArrow(run, "fold int, converted int, prediction int")


# --- as Spark ML models -----------------------------------------------------------------------------

def _nodes(tree: Tree, number: int, spec: Spec, cuts: list[np.ndarray], scale: float, shift: float) -> list[tuple]:
    """The rows of a saved tree: nodes numbered from 0 with every child after its parent."""
    order, place = [], {}
    todo = [0]
    while todo:
        i = todo.pop()
        place[i] = len(order)
        order.append(i)
        if tree.feature[i] >= 0:
            todo += [2 * i + 2, 2 * i + 1]
    out = []
    for i in order:
        g, h, n = (float(x) for x in tree.sums[:, i])
        inner = tree.feature[i] >= 0
        cover = float(tree.cover[i])
        value = float(tree.value[i]) * scale + shift
        if spec.kind == "forest":
            stats, value = [h - g, g], float(g > h - g)
            impurity = 2 * g * (h - g) / h**2 if h else 0.0
        else:
            stats, impurity = [cover, g, 0.0], 0.0
        split = (int(tree.feature[i]), [float(cuts[tree.feature[i]][tree.cut[i]])], -1) if inner else (-1, [], -1)
        children = (place[2 * i + 1], place[2 * i + 2]) if inner else (-1, -1)
        out.append((number, (place[i], value, impurity, stats, int(n), float(tree.gain[i]) * (2 if spec.kind == "forest" else 1) if inner else -1.0, *children, split)))
    return out


def as_model(spark: SparkSession, data: Binned, spec: Spec, trees: list[Tree], label: str = "converted"):
    """The fitted trees in Spark ML's saved form, loaded as its forest or boosted classifier.

    So scoring runs in the JVM, and saving, loading and importance are Spark's. Its boosted margin is half the log-odds.
    """
    forest = spec.kind == "forest"
    odds = data.start(spec)[0]
    version, params = spark.version, {"featuresCol": "features", "labelCol": label, "predictionCol": "prediction", "probabilityCol": "probability", "rawPredictionCol": "rawPrediction"}

    def info(kind: str, uid: str, more: dict, params: dict) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": 0, "sparkVersion": version, "uid": uid, "paramMap": params, "defaultParamMap": {}, **more})

    path = fresh_path(spark, "ensemble")
    name = "RandomForestClassificationModel" if forest else "GBTClassificationModel"
    tree_name = "classification.DecisionTreeClassificationModel" if forest else "regression.DecisionTreeRegressionModel"
    sizes = {"numFeatures": len(data.cuts), "numTrees": len(trees)} | ({"numClasses": 2} if forest else {})
    impurity = {"impurity": "gini" if forest else "variance"}
    own = {**params, **impurity, "maxDepth": spec.depth, "seed": spec.seed} | ({"numTrees": len(trees)} if forest else {"maxIter": len(trees), "stepSize": spec.rate, "lossType": "logistic"})
    inner = {"numFeatures": len(data.cuts)} | ({"numClasses": 2} if forest else {})
    plain = {"featuresCol": "features", "predictionCol": "prediction", **impurity}
    nodes = [r for k, t in enumerate(trees) for r in _nodes(t, k, spec, data.cuts, 1.0 if forest else 0.5, 0.0 if forest or k else odds / 2)]
    split = "struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>"
    node = f"struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:{split}>"
    spark.createDataFrame(nodes, f"treeID int, nodeData {node}").coalesce(1).write.parquet(f"{path}/data")
    about = [(k, info(tree_name, f"tree_{k}", inner, plain), 1.0) for k in range(len(trees))]
    spark.createDataFrame(about, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    text = info(f"classification.{name}", f"{name}_{spec.kind}", sizes, own)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return (RandomForestClassificationModel if forest else GBTClassificationModel).load(path)
