"""Decision trees and forests with exact thresholds.

A split is judged by ``|L|²/n + |R|²/m``: the squared length of each side's label sum
over its weight, with one-hot labels for classes (the Gini criterion) and plain ones for
regression (the variance).  All trees grow level by level together.  Nodes of more than
``SMALL_ROWS`` rows are split by partial aggregates: one pass counts, per node and
feature, the rows of a few hundred bins with their least and largest value.  The measure
is convex in a side's sums and sublinear, so a split inside a bin reaches at most what
its neighbours give plus the squares of the bin's own labels.  Only bins that could
still win are looked into: a second pass sends their values to one task each, which tries
every one, so a level takes two passes whatever the labels.  The threshold is then the
exact one.  The rows of smaller nodes go to one task each, where the rest of the tree is grown.

Where a table has few different rows of features, equal ones become one before the trees
grow, with their weight, label sum and squares in each tree: all that a split asks for.

Equal splits go to the lower feature and then to the lower value.  Forests draw a row
for a tree with a Poisson weight that a hash of the row's key gives, and the features of
a node by a hash of tree and node, so that the same rows give the same forest anywhere.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.storagelevel import StorageLevel

from .split import SEED

# Rows, and numbers of all their features, up to which one task grows a node's subtree.
SMALL_ROWS = 100_000
SMALL_NUMBERS = 6_400_000
# Rows a task should have, and the rows up to which one shuffle for it is cheap.
ROWS_PER_TASK = 25_000
SPREAD_ROWS = 10_000_000
# Tasks for each core: every task of a pass sends its own bins.
TASKS_PER_CORE = 4
# Bins of a feature.
BINS = 256
# Deepest level; "no limit" means that here, as node numbers double with each level.
DEEPEST = 30
# Cells (intervals times bins) that one pass may give.
CELLS = 1_000_000
# The same with a number for each class (128 MB), all of which a task holds.
CLASS_CELLS = 16_000_000
# Bins that one pass looks into; every task holds a table of them and their like (64 MB).
SCANNED = 60_000
# Values that a task gathers before it adds up equal ones and sends them.
GATHERED = 200_000
# Numbers of one sorted block while a small node is searched, and of rows added up at once.
BLOCK = 4_000_000

# Fixed values of the draws: a prime below 2^31 and the factors of the hashes.
PRIME = 2_147_483_647
TREE_FACTOR, NODE_FACTOR, FEATURE_FACTOR, MIX_FACTOR = 1_299_709, 7_919, 104_729, 48_271
# Poisson weights of mean one by their distribution function.
POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


# The least hashes of the weights from one up.
LEAST = [
    next(m for m in range(int(p * PRIME) - 2, PRIME + 3) if m / PRIME >= p) for p in POISSON.tolist()
]


def _modulo(v: np.ndarray) -> np.ndarray:
    """``v % PRIME`` for numbers below 2^62, the prime being 2^31 - 1."""
    for _ in range(2):
        v = (v & PRIME) + (v >> 31)
    v[v == PRIME] = 0
    return v


def _mixed(keys: np.ndarray) -> np.ndarray:
    return keys % PRIME * MIX_FACTOR


def _weights(mixed: np.ndarray, tree: int) -> np.ndarray:
    mix = _modulo(mixed + (tree + 1) * TREE_FACTOR)
    for _ in range(2):
        mix = _modulo(_modulo(mix * mix) * MIX_FACTOR)
    out = np.zeros(len(mix), np.uint8)
    for least in LEAST:
        out += mix >= least
    return out


def draws(keys: np.ndarray, tree: int) -> np.ndarray:
    """The weight of each row, given by the hash of its key, in a forest's tree."""
    return _weights(_mixed(keys), tree).astype(np.float64)


def node_features(tree: int, node: int, features: int, wanted: int) -> np.ndarray:
    """The features that a node may split on, in ascending order."""
    if wanted >= features:
        return np.arange(features)
    mix = (node * NODE_FACTOR + np.arange(features) * FEATURE_FACTOR + tree * TREE_FACTOR) % PRIME
    mix = mix * mix % PRIME * MIX_FACTOR % PRIME
    return np.sort(np.lexsort((np.arange(features), mix))[:wanted])


@dataclass(frozen=True)
class Growth:
    """What a fit follows; ``classes`` is 0 for regression."""

    classes: int
    features: int
    trees: int
    wanted: int
    drawn: bool
    max_depth: int
    min_split: float
    min_leaf: float

    @property
    def width(self) -> int:
        return self.classes or 1

    def ends(self, node: int, n: float, sums: np.ndarray, squares: float) -> bool:
        """Whether a node stays a leaf, from its weight, label sums and squared labels."""
        depth = node.bit_length() - 1
        pure = squares - sums @ sums / n <= 1e-12 * squares if n else True
        return depth >= self.max_depth or n < self.min_split or n < 2 * self.min_leaf or pure


def one_hot(labels: np.ndarray, growth: Growth) -> np.ndarray:
    if not growth.classes:
        return labels[:, None]
    return (labels[:, None] == np.arange(growth.classes)).astype(np.float64)


def halfway(low: float, high: float) -> float:
    """A threshold with ``low`` on its left and ``high`` on its right."""
    middle = low + (high - low) / 2
    return middle if low <= middle < high else low


def split_gain(left: np.ndarray, n_left: np.ndarray, whole: np.ndarray, n: float) -> np.ndarray:
    """The measure of splits with the given left sides (sums along the last axis)."""
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        return (left * left).sum(axis=-1) / n_left + (right * right).sum(axis=-1) / (n - n_left)


# --- small nodes --------------------------------------------------------------------


def _search(x: np.ndarray, y: np.ndarray, w: np.ndarray, chosen: np.ndarray, min_leaf: float):
    """``(feature, threshold)`` of the best split of rows with label sums ``y``, or None."""
    best = (-np.inf, -1, 0.0)
    whole, n = y.sum(axis=0), w.sum()
    step = max(1, BLOCK // (x.shape[0] * y.shape[1]))
    for at in range(0, len(chosen), step):
        part = chosen[at : at + step]
        order = np.argsort(x[:, part], axis=0, kind="stable")
        values = np.take_along_axis(x[:, part], order, axis=0)
        n_left = np.cumsum(w[order], axis=0)[:-1]
        left = np.cumsum(y[order], axis=0)[:-1]
        fits = (values[1:] > values[:-1]) & (n_left >= min_leaf) & (n - n_left >= min_leaf)
        if not fits.any():
            continue
        score = np.where(fits, split_gain(left, n_left, whole, n), -np.inf).T
        f, place = np.unravel_index(np.argmax(score), score.shape)
        if score[f, place] > best[0]:
            best = (score[f, place], int(part[f]), halfway(values[place, f], values[place + 1, f]))
    return None if best[1] < 0 else best[1:]


def grow_small(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, q: np.ndarray, tree: int, root: int, growth: Growth
) -> list[tuple]:
    """``(node, feature, threshold, n, sums)`` of the subtree below ``root``.

    Rows have label sums ``y``, weights ``w`` and squared labels ``q``.
    """
    out, waiting = [], [(root, np.arange(len(x)))]
    while waiting:
        node, rows = waiting.pop()
        part_y, part_w = y[rows], w[rows]
        sums, n, squares = part_y.sum(axis=0), float(part_w.sum()), float(q[rows].sum())
        found = None
        if not growth.ends(node, n, sums, squares):
            chosen = node_features(tree, node, growth.features, growth.wanted)
            found = _search(x[rows], part_y, part_w, chosen, growth.min_leaf)
        feature, threshold = found or (-1, 0.0)
        out.append((node, feature, threshold, n, sums.tolist()))
        if found:
            low = x[rows, feature] <= threshold
            waiting += [(2 * node, rows[low]), (2 * node + 1, rows[~low])]
    return out


# --- fitted models ------------------------------------------------------------------


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; a leaf has feature -1."""

    tree: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    n: np.ndarray
    sums: np.ndarray

    def __post_init__(self) -> None:
        order = np.lexsort((self.node, self.tree))
        for name in ("tree", "node", "feature", "threshold", "n", "sums"):
            setattr(self, name, getattr(self, name)[order])
        place = self.tree * (1 << (DEEPEST + 2)) + self.node
        self.left = np.where(self.feature >= 0, np.searchsorted(place, place + self.node), -1)
        self.right = np.where(self.feature >= 0, self.left + 1, -1)
        self.roots = np.flatnonzero(self.node == 1)

    def leaves(self, x: np.ndarray, root: int, rows: np.ndarray | None = None) -> np.ndarray:
        """The place of each row's leaf, or of each of the rows with the given numbers."""
        rows = np.arange(len(x)) if rows is None else rows
        flat, first = x.ravel(), rows * x.shape[1]
        at = np.full(len(rows), root)
        moving = None
        while True:
            here = at if moving is None else at[moving]
            feature = self.feature[here]
            inner = feature >= 0
            going = np.count_nonzero(inner)
            if not going:
                return at
            if 2 * going < len(here):
                moving = np.flatnonzero(inner) if moving is None else moving[inner]
                here, feature, inner = here[inner], feature[inner], inner[inner]
            value = flat[(first if moving is None else first[moving]) + np.maximum(feature, 0)]
            # The right side follows the left one.
            here = np.where(inner, self.left[here] + ~(value <= self.threshold[here]), here)
            if moving is None:
                at = here
            else:
                at[moving] = here

    def root_of(self, tree: int) -> int:
        return self.roots[np.searchsorted(self.tree[self.roots], tree)]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class TreeModel:
    """A fitted tree or forest; predictions average the trees' leaves."""

    name: str
    trees: Trees
    classes: int
    features: int

    def predict(self, df: DataFrame) -> DataFrame:
        trees, classes, width = self.trees, self.classes, self.features
        means = trees.sums / trees.n[:, None]

        @arrow_udf("array<double>")
        def outputs(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                x = matrix(column, width)
                total = np.zeros((len(x), means.shape[1]))
                for root in trees.roots:
                    total += means[trees.leaves(x, root)]
                ends = pa.array(np.arange(len(x) + 1) * means.shape[1], pa.int32())
                yield pa.ListArray.from_arrays(ends, (total / len(trees.roots)).ravel())

        out = df.withColumn("__out", outputs(vector_to_array("features")))
        if not classes:
            return out.withColumn("prediction", F.col("__out")[0]).drop("__out")
        best = F.array_position("__out", F.array_max("__out")) - 1
        return out.withColumn("prediction", best.cast("double")).withColumnRenamed("__out", "probability")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """``tree, node, feature, threshold, n`` of all nodes; leaves have no feature.

        The root is node 1, the sides of node ``k`` are ``2k`` (up to the threshold) and ``2k + 1``.
        """
        t = self.trees
        columns = zip(*(c.tolist() for c in (t.tree, t.node, t.feature, t.threshold, t.n)))
        rows = [(a, b, f if f >= 0 else None, v if f >= 0 else None, n) for a, b, f, v, n in columns]
        return spark.createDataFrame(rows, "tree int, node long, feature int, threshold double, n double")

    def importance(self) -> list[float]:
        """Gain of the splits on each feature, summed to one per tree and averaged."""
        t = self.trees
        own = (t.sums * t.sums).sum(axis=1) / t.n
        inner = np.flatnonzero(t.feature >= 0)
        total = np.zeros(self.features)
        for root in t.roots:
            mine = inner[t.tree[inner] == t.tree[root]]
            gain = np.zeros(self.features)
            np.add.at(gain, t.feature[mine], own[t.left[mine]] + own[t.right[mine]] - own[mine])
            total += gain / gain.sum() if gain.sum() > 0 else 0
        return (total / total.sum() if total.sum() > 0 else total).tolist()

    def save(self, path: str) -> None:
        spark, t = SparkSession.active(), self.trees
        spark.createDataFrame(
            pa.table(
                {
                    "tree": t.tree,
                    "node": t.node,
                    "feature": t.feature,
                    "threshold": t.threshold,
                    "n": t.n,
                    "sums": pa.array(list(t.sums), pa.list_(pa.float64())),
                    "shape": pa.array([json.dumps([self.classes, self.features])] * len(t.tree)),
                }
            )
        ).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, name: str, path: str) -> TreeModel:
        table = spark.read.parquet(path).toArrow()
        classes, features = json.loads(table["shape"][0].as_py())
        columns = [table[c].to_numpy() for c in ("tree", "node", "feature", "threshold", "n")]
        return TreeModel(name, Trees(*columns, np.array(table["sums"].to_pylist())), classes, features)


# --- large nodes --------------------------------------------------------------------


@dataclass
class Interval:
    """One bin of a feature in a node, or all of them (-1), and what lies below."""

    slot: int
    feature: int
    bin: int
    n_before: float
    q_before: float
    before: np.ndarray


@dataclass
class _Large:
    """A large node while its split is sought.

    ``best`` has score, feature, the values at both sides, and the left side's weight,
    squares and sums.
    """

    tree: int
    node: int
    n: float
    sums: np.ndarray
    squares: float
    best: tuple | None = None

    def children(self) -> list[tuple]:
        """``(tree, node, n, sums, squares)`` of both sides of the split."""
        n, squares, sums = self.best[4], self.best[5], np.array(self.best[6])
        left = (self.tree, 2 * self.node, n, sums, squares)
        return [left, (self.tree, 2 * self.node + 1, self.n - n, self.sums - sums, self.squares - squares)]


def _units(batches: Iterator[pa.RecordBatch], growth: Growth):
    """``(x, units)`` of each batch of rows, or of equal rows in one.

    ``units(tree)`` has row, class, weight, label sum and squares of what is drawn for a
    tree, with all rows once for -1.  A class counts its weight as label.
    """
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch["x"], growth.features)
            yield x, (_of_equal if "n" in batch.schema.names else _of_rows)(batch, growth)


def _of_rows(held: pa.RecordBatch | pa.Table, growth: Growth) -> Callable:
    y, keys = (np.asarray(held[c]) for c in ("y", "key"))
    cls, mixed = y.astype(np.int64) if growth.classes else np.zeros(len(y), np.int64), _mixed(keys)

    def units(tree: int) -> tuple[np.ndarray, ...]:
        if tree < 0 or not growth.drawn:
            row, n = np.arange(len(y)), np.ones(len(y))
        else:
            w = _weights(mixed, tree)
            row = np.flatnonzero(w)
            n = w[row].astype(np.float64)
        if growth.classes:
            return row, cls[row], n, n, n
        s = n * y[row]
        return row, cls[row], n, s, s * y[row]

    return units


def _of_equal(batch: pa.RecordBatch, growth: Growth) -> Callable:
    n, s, q = (_lists(batch[c]) for c in ("n", "s", "q"))

    def units(tree: int) -> tuple[np.ndarray, ...]:
        at = tree % (growth.trees + 1)
        if growth.classes:
            part = n[:, at * growth.classes : (at + 1) * growth.classes]
            row, cls = np.nonzero(part)
            held = part[row, cls]
            return row, cls, held, held, held
        row = np.flatnonzero(n[:, at])
        return row, np.zeros(len(row), np.int64), n[row, at], s[row, at], q[row, at]

    return units


def _merged(x: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of ``x`` once, with the sums of their ``sums``."""
    order, first = _equal(x)
    return x[order[first]], np.add.reduceat(sums[order], first, axis=0)


def _equal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order with equal rows side by side, and where each kind begins."""
    order = np.lexsort(x.T)
    new = np.zeros(len(x), bool)
    new[0] = True
    for column in x.T:
        column = column[order]
        new[1:] |= column[1:] != column[:-1]
    return order, np.flatnonzero(new)


_EQUAL = "x array<double>, n array<double>, s array<double>, q array<double>"


def _equal_rows(rows: DataFrame, growth: Growth) -> DataFrame:
    """Rows of equal features in one: weight, label sum and squares in each tree, and of all rows.

    Lists run over the trees, for classes over each tree's classes.  Features may still
    come in several rows; everything that reads them adds up.
    """
    regress, columns = not growth.classes, (growth.trees + 1) * growth.width
    parts = [0, columns, columns * (1 + regress), columns * (1 + 2 * regress)]

    def out(x: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // (x.shape[1] + sums.shape[1]))
        for at in range(0, len(x), step):
            held = [x[at : at + step], *(sums[at : at + step, a:b] for a, b in zip(parts, parts[1:]))]
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * c.shape[1], pa.int32()), np.ascontiguousarray(c).ravel())
                for c in held
            ]
            yield pa.record_batch(lists, ["x", "n", "s", "q"])

    def added(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held = None
        for x, sums in found:
            if held:
                x, sums = _merged(np.vstack([held[0], x]), np.vstack([held[1], sums]))
            held = x, sums
            if x.size + sums.size > 2 * BLOCK:
                yield from out(*held)
                held = None
        if held:
            yield from out(*held)

    def of_rows(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        x = matrix(table["x"].combine_chunks(), growth.features)
        order, first = _equal(x)
        code = np.empty(len(x), np.int64)
        code[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(x)))
        units, size = _of_rows(table, growth), len(first) * growth.width
        sums = np.empty((len(first), parts[-1]))
        for tree in [*range(growth.trees), -1]:
            row, cls, n, s, q = units(tree)
            spot, at = code[row] * growth.width + cls, tree % (growth.trees + 1) * growth.width
            for start, numbers in zip(parts, (n, s, q)[: 1 + 2 * regress]):
                sums[:, start + at : start + at + growth.width] = np.bincount(spot, numbers, size).reshape(len(first), -1)
        return x[order[first]], sums

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows * (growth.features + 2)
            if size >= BLOCK:
                yield of_rows(held)
                held, size = [], 0
        if held:
            yield of_rows(held)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                yield _merged(matrix(batch["x"], growth.features), np.hstack([_lists(batch[c]) for c in ("n", "s", "q")]))

    first = rows.mapInArrow(lambda batches: added(chunks(batches)), _EQUAL)
    return first.repartition("x").mapInArrow(lambda batches: added(again(batches)), _EQUAL)


_CELL = (
    "slot int, interval int, n array<double>, s array<double>, q array<double>, low array<double>, high array<double>"
)


def _lists(column: pa.Array) -> np.ndarray:
    """Lists of one length, none of it too, as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cell_rows(slots: np.ndarray, intervals: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Batches of :data:`_CELL` rows from matrices with a row per interval."""
    step = max(1, BLOCK // max(1, sum(c.shape[1] for c in columns)))
    for at in range(0, len(intervals), step):
        held = {"slot": pa.array(slots[at : at + step], pa.int32()), "interval": pa.array(intervals[at : at + step], pa.int32())}
        for name, c in zip(("n", "s", "q", "low", "high"), columns):
            part = np.ascontiguousarray(c[at : at + step])
            ends = pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32())
            held[name] = pa.ListArray.from_arrays(ends, part.ravel())
        yield pa.record_batch(held)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal intervals of several tasks in one row."""
    held: dict[int, list] = {}
    for batch in batches:
        intervals, slots = batch["interval"].to_pylist(), batch["slot"].to_pylist()
        columns = [_lists(batch[c]) for c in ("n", "s", "q", "low", "high")] if intervals else []
        for i, (interval, slot) in enumerate(zip(intervals, slots)):
            new = [c[i] for c in columns]
            old = held.get(interval)
            if old is None:
                held[interval] = [slot, *(c.copy() for c in new)]
                continue
            for k in (1, 2, 3):
                old[k] += new[k - 1]
            np.minimum(old[4], new[3], out=old[4])
            np.maximum(old[5], new[4], out=old[5])
    if held:
        slots = np.array([v[0] for v in held.values()])
        columns = [np.array([v[k] for v in held.values()]) for k in range(1, 6)]
        yield from _cell_rows(slots, np.array(list(held)), columns)


def _places(done: Trees, large: list[_Large], intervals: list[Interval], edges, growth: Growth):
    """``found(batches)``: per batch and tree, what is drawn of large nodes and the intervals it is in."""
    place = {(int(t), int(n)): k for k, (t, n) in enumerate(zip(done.tree, done.node))}
    used = sorted({i.slot for i in intervals})
    slots = np.full(len(done.tree), -1)
    slots[[place[large[k].tree, large[k].node] for k in used]] = np.arange(len(used))
    chosen = np.array([node_features(large[k].tree, large[k].node, growth.features, growth.wanted) for k in used])
    tried, needed = chosen.shape[1], np.unique(chosen)
    trees = sorted({large[k].tree for k in used})
    # The row in the table of bins for each node and feature; the table has the interval.
    place_of = {slot: k for k, slot in enumerate(used)}
    at = np.array([place_of[i.slot] for i in intervals])
    feature = np.array([i.feature for i in intervals])
    where = at * tried + (chosen[at] < feature[:, None]).sum(axis=1)
    lines, line_of = np.unique(where, return_inverse=True)
    row_of = np.full(chosen.size, -1)
    row_of[lines] = np.arange(len(lines))
    row_of = row_of.reshape(chosen.shape)
    single = all(i.bin < 0 for i in intervals)
    some = bool((row_of < 0).any())
    bin_of = np.array([max(i.bin, 0) for i in intervals])

    def found(batches: Iterator[pa.RecordBatch]):
        """``(interval, bin, value, class, weight, label sum, squares)`` of each such row and feature."""
        table = None
        for x, units in _units(batches, growth):
            if table is None:
                table = np.full((len(lines), 1 if single else BINS), -1, np.int32)
                table[line_of, bin_of] = np.arange(len(intervals))
            bins = np.zeros(x.shape, np.uint8)
            for f in needed:
                bins[:, f] = np.searchsorted(edges[f], np.ascontiguousarray(x[:, f]), side="left")
            flat, flat_bins = x.ravel(), bins.ravel()
            for tree in trees:
                row, *numbers = units(tree)
                slot = slots[done.leaves(x, done.root_of(tree), row)]
                held = slot >= 0
                if not held.all():
                    row, slot, *numbers = (c[held] for c in (row, slot, *numbers))
                if not len(row):
                    continue
                spot = (row[:, None] * growth.features + chosen[slot]).ravel()
                line = row_of[slot].ravel()
                unit = np.repeat(np.arange(len(row)), tried)
                if some:
                    inside = np.flatnonzero(line >= 0)
                    spot, line, unit = spot[inside], line[inside], unit[inside]
                at = flat_bins[spot]
                interval = table[line, 0 if single else at]
                if not single:
                    inside = np.flatnonzero(interval >= 0)
                    spot, at, unit, interval = spot[inside], at[inside], unit[inside], interval[inside]
                if len(interval):
                    yield interval, at, flat[spot], *(c[unit] for c in numbers)

    return found


def _cells(rows: DataFrame, done: Trees, large: list[_Large], intervals: list[Interval], edges, growth: Growth) -> DataFrame:
    """Weights and labels of each bin of each interval, the bins being those of ``edges``.

    A task adds its rows up in one matrix of bins, whose rows tasks then share out.
    """
    found = _places(done, large, intervals, edges, growth)
    of_slot = np.array([i.slot for i in intervals])
    width, regress = growth.width, not growth.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(intervals) * BINS
        total = [np.zeros(size * width), *(np.zeros(size * regress) for _ in range(2)), np.full(size, np.inf), np.full(size, -np.inf)]
        for k, bins, v, cls, n, s, q in found(batches):
            spot = k.astype(np.int64) * BINS + bins
            np.minimum.at(total[3], spot, v)
            np.maximum.at(total[4], spot, v)
            if regress:
                for t, numbers in zip(total, (n, s, q)):
                    np.add.at(t, spot, numbers)
            else:
                np.add.at(total[0], spot * width + cls, n)
        total = [t.reshape(len(intervals), -1) for t in total]
        seen = np.flatnonzero(total[0].any(axis=1))
        yield from _cell_rows(of_slot[seen], seen, [t[seen] for t in total])

    return rows.mapInArrow(run, _CELL).repartition("interval").mapInArrow(_together, _CELL)


_VALUE = "interval int, v double, cls int, n double, s double, q double"


def _scanned(rows: DataFrame, done: Trees, large: list[_Large], intervals: list[Interval], edges, growth: Growth) -> DataFrame:
    """The best split of each node between two values inside one of the intervals.

    An interval is a bin of the whole table, so one task has a small share of the rows.
    """
    found = _places(done, large, intervals, edges, growth)

    def sent(parts: list[tuple]) -> pa.RecordBatch:
        k, v, cls, *numbers = (np.concatenate(c) for c in zip(*parts))
        # Equal values travel once.
        order = np.lexsort((cls, v, k))
        k, v, cls = k[order], v[order], cls[order]
        new = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1]) | (cls[1:] != cls[:-1]))
        at = np.flatnonzero(new)
        n, s, q = (np.add.reduceat(c[order], at) for c in numbers)
        return pa.record_batch(
            {"interval": pa.array(k[at], pa.int32()), "v": v[at], "cls": pa.array(cls[at], pa.int32()), "n": n, "s": s, "q": q}
        )

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for k, _, *rest in found(batches):
            parts.append((k, *rest))
            size += len(k)
            if size >= GATHERED:
                yield sent(parts)
                parts, size = [], 0
        if parts:
            yield sent(parts)

    def scan(group: pa.Table) -> pa.Table:
        at = intervals[group["interval"][0].as_py()]
        node = large[at.slot]
        names, spot = np.unique(group["v"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(names), growth.width))
        np.add.at(sums, (spot, group["cls"].to_numpy()), group["s"].to_numpy())
        n = np.bincount(spot, group["n"].to_numpy())
        left, n_left = at.before + np.cumsum(sums, axis=0)[:-1], at.n_before + np.cumsum(n)[:-1]
        fits = (n_left >= growth.min_leaf) & (node.n - n_left >= growth.min_leaf)
        out = []
        if fits.any():
            score = np.where(fits, split_gain(left, n_left, node.sums, node.n), -np.inf)
            k = int(np.argmax(score))
            q_left = at.q_before + float(np.bincount(spot, group["q"].to_numpy())[: k + 1].sum())
            out = [(at.slot, at.feature, float(names[k]), float(names[k + 1]), float(score[k]), -1, float(n_left[k]), q_left, left[k].tolist())]
        return _found_table(out)

    inside = rows.mapInArrow(values, _VALUE).groupBy("interval").applyInArrow(scan, _FOUND)
    order = [F.col("score"), (-F.col("feature")).alias("f"), (-F.col("low")).alias("l")]
    best = F.max(F.struct(*order, "high", "n", "q", "sums")).alias("b")
    return inside.groupBy("slot").agg(best)


_FOUND = (
    "slot int, feature int, low double, high double, score double, bin int, n double, q double, sums array<double>"
)


def _found_table(out: list[tuple]) -> pa.Table:
    wide = pa.float64()
    kinds = [pa.int32(), pa.int32(), wide, wide, wide, pa.int32(), wide, wide, pa.list_(wide)]
    names = [c.split()[0] for c in _FOUND.split(", ")]
    return pa.table({c: pa.array([o[k] for o in out], t) for k, (c, t) in enumerate(zip(names, kinds))})


def _judged(cells: DataFrame, large: list[_Large], intervals: list[Interval], growth: Growth) -> DataFrame:
    """The best split between bins of each node, and the bins that may hold a better one."""

    def judge(group: pa.Table) -> pa.Table:
        slot = group["slot"][0].as_py()
        node = large[slot]
        best = node.best or (-np.inf, growth.features, np.inf, np.inf, 0.0, 0.0, [])
        names = group["interval"].to_numpy()
        width, regress = growth.width, not growth.classes
        cells = [_lists(group[c].combine_chunks()) for c in ("n", "s", "q", "low", "high")]
        bounds = []
        for spot in np.argsort(names):
            at = intervals[names[spot]]
            weights = cells[0][spot].reshape(-1, width)
            bins = np.flatnonzero(weights.any(axis=1))
            sums = (cells[1][spot].reshape(-1, 1) if regress else weights)[bins]
            n = weights[bins].sum(axis=1)
            squares = cells[2][spot][bins] if regress else n
            low, high = cells[3][spot][bins], cells[4][spot][bins]
            left, n_left = at.before + np.cumsum(sums, axis=0), at.n_before + np.cumsum(n)
            fits = (n_left[:-1] >= growth.min_leaf) & (node.n - n_left[:-1] >= growth.min_leaf)
            if fits.any():
                score = np.where(fits, split_gain(left[:-1], n_left[:-1], node.sums, node.n), -np.inf)
                k = int(np.argmax(score))
                q_left = at.q_before + float(squares[: k + 1].sum())
                new = (float(score[k]), at.feature, float(high[k]), float(low[k + 1]), float(n_left[k]), q_left, left[k].tolist())
                if (-new[0], new[1], new[2]) < (-best[0], best[1], best[2]):
                    best = new
            reach = _reach(node, sums, n, squares, left, n_left)
            n_before, before = n_left - n, left - sums
            may = (low < high) & (n_left > growth.min_leaf) & (node.n - n_before > growth.min_leaf)
            q_before = at.q_before + np.cumsum(squares) - squares
            bounds += [
                (reach[k], at.feature, low[k], high[k], bins[k], n_before[k], q_before[k], before[k].tolist())
                for k in np.flatnonzero(may)
            ]
        out = [(slot, *best[1:4], best[0], -1, *best[4:])] if best[0] > -np.inf else []
        # Sums of doubles differ in the last digits between ways of adding them up.
        again = [b for b in bounds if b[0] >= best[0] - 1e-12 * abs(best[0])]
        out += [(slot, f, lo, hi, r, *rest) for r, f, lo, hi, *rest in again]
        return _found_table(out)

    return cells.groupBy("slot").applyInArrow(judge, _FOUND)


def _reach(
    node: _Large, sums: np.ndarray, n: np.ndarray, squares: np.ndarray, left: np.ndarray, n_left: np.ndarray
) -> np.ndarray:
    """What a split inside each bin can reach at most, ``left`` being all up to its end.

    The measure grows by no more than the squares of the bin's own labels.  It is convex,
    so it also lies below its value at a bin's end plus the steepest way into the bin: for
    classes by the greatest slope of each on the way; for numbers at the corners of what
    the bin's weight and the spread of its labels leave possible.
    """
    before, n_before = left - sums, n_left - n
    after, n_after = node.sums - left, node.n - n_left
    most = squares + _share(before, n_before) + _share(after, n_after)
    whole, n_rest = node.sums - before, node.n - n_before
    with np.errstate(divide="ignore", invalid="ignore"):
        if sums.shape[1] > 1:
            n, n_before, n_left, n_after, n_rest = (c[:, None] for c in (n, n_before, n_left, n_after, n_rest))
            square = lambda c: (c * c).sum(axis=1, keepdims=True)
            rise = 2 * left / (n_before + sums) - square(before) / n_left**2
            rise += square(whole) / n_after**2 - 2 * after / (n_rest - sums)
            fall = square(left) / n_before**2 - 2 * before / (n_left - sums)
            fall += 2 * whole / (n_after + sums) - square(after) / n_rest**2
            low, high = (split_gain(c, m[:, 0], node.sums, node.n) for c, m in ((before, n_before), (left, n_left)))
            others = [
                low + (sums * np.maximum(rise, 0.0)).sum(axis=1),
                high + (sums * np.maximum(fall, 0.0)).sum(axis=1),
            ]
        else:
            spread = np.maximum(squares - sums[:, 0] ** 2 / n, 0.0) + 1e-12 * squares
            aside = np.sqrt(spread * n)[:, None] / 2
            corners = [
                split_gain(c + side * aside, m, node.sums, node.n)
                for c, m in ((before, n_before), (left, n_left))
                for side in (-1, 1)
            ]
            others = [np.maximum.reduce(corners)]
    for other in others:
        most = np.where(np.isfinite(other), np.minimum(most, other), most)
    return most


def _share(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide((sums * sums).sum(axis=1), n, out=np.zeros(len(n)), where=n > 0)


def _split_large(rows: DataFrame, done: Trees, large: list[_Large], edges: np.ndarray, growth: Growth) -> None:
    """Find the best split of each large node, ``best`` of (score, feature, low, high)."""
    nothing = np.zeros(growth.width)
    waiting = [
        Interval(slot, int(f), -1, 0.0, 0.0, nothing)
        for slot, g in enumerate(large)
        for f in node_features(g.tree, g.node, growth.features, growth.wanted)
    ]
    at_once = max(1, min(CELLS // BINS, CLASS_CELLS // (BINS * growth.width)))
    later = []
    for at in range(0, len(waiting), at_once):
        part = waiting[at : at + at_once]
        for r in _judged(_cells(rows, done, large, part, edges, growth), large, part, growth).collect():
            if r["bin"] >= 0:
                inner = Interval(r["slot"], r["feature"], r["bin"], r["n"], r["q"], np.array(r["sums"]))
                later.append((r["score"], inner))
            else:
                large[r["slot"]].best = (r["score"], r["feature"], r["low"], r["high"], r["n"], r["q"], r["sums"])
    # Another part may have found what these cannot reach.
    tops = [g.best[0] if g.best else -np.inf for g in large]
    within = [i for reach, i in later if reach >= tops[i.slot] - 1e-12 * abs(tops[i.slot])]
    for at in range(0, len(within), SCANNED):
        for slot, b in _scanned(rows, done, large, within[at : at + SCANNED], edges, growth).collect():
            new = (b["score"], -b["f"], -b["l"], b["high"], b["n"], b["q"], b["sums"])
            best = large[slot].best
            if best is None or (-new[0], *new[1:3]) < (-best[0], *best[1:3]):
                large[slot].best = new


# --- the fit ------------------------------------------------------------------------


def _sums(rows: DataFrame, growth: Growth) -> dict[int, tuple[float, np.ndarray, float]]:
    """``(n, sums, squares)`` of the rows of every tree, and of all rows once (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, growth.trees + 1, growth.width))
        for _, units in _units(batches, growth):
            for tree in range(-1, growth.trees):
                _, cls, *numbers = units(tree)
                for k, c in enumerate(numbers):
                    total[k, tree] += np.bincount(cls, c, growth.width)
        tree, cls = np.nonzero(total[0])
        n, s, q = total[:, tree, cls]
        # The last row is that of all rows.
        yield pa.record_batch({"tree": np.where(tree == growth.trees, -1, tree), "cls": cls, "n": n, "s": s, "q": q})

    found = (
        rows.mapInArrow(run, "tree long, cls long, n double, s double, q double")
        .groupBy("tree", "cls")
        .agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    )
    out: dict = {}
    for r in found.collect():
        n, sums, squares = out.get(r["tree"], (0.0, np.zeros(growth.width), 0.0))
        sums[r["cls"]] += r["s"]
        out[r["tree"]] = (n + r["n"], sums, squares + r["q"])
    return out


def _grow_small(rows: DataFrame, done: Trees, small: set[tuple[int, int]], growth: Growth) -> list[tuple]:
    """``(tree, node, feature, threshold, n, sums)`` below all small nodes."""

    trees = sorted({t for t, _ in small})
    wanted = np.array([(int(t), int(n)) in small for t, n in zip(done.tree, done.node)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, units in _units(batches, growth):
            for tree in trees:
                row, *numbers = units(tree)
                leaf = done.leaves(x, done.root_of(tree), row)
                held = wanted[leaf]
                if held.any():
                    row, leaf, cls, n, s, q = (c[held] for c in (row, leaf, *numbers))
                    ends = np.arange(len(row) + 1, dtype=np.int32) * growth.features
                    yield pa.record_batch(
                        {
                            "tree": pa.array(np.full(len(row), tree)),
                            "node": done.node[leaf],
                            "x": pa.ListArray.from_arrays(ends, x[row].ravel()),
                            "cls": cls,
                            "n": n,
                            "s": s,
                            "q": q,
                        }
                    )

    kind = "tree long, node long, feature long, threshold double, n double, sums array<double>"

    def grow(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        tree, root = group["tree"][0].as_py(), group["node"][0].as_py()
        x = matrix(group["x"].combine_chunks(), growth.features)
        cls, n, s, q = (group[c].to_numpy() for c in ("cls", "n", "s", "q"))
        found = grow_small(x, (one_hot(cls, growth) if growth.classes else 1.0) * s[:, None], n, q, tree, root, growth)
        columns = list(zip(*found))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        names = ["node", "feature", "threshold", "n", "sums"]
        held = {c: pa.array(list(v), t) for c, v, t in zip(names, columns, kinds)}
        return pa.table({"tree": pa.array([tree] * len(found), pa.int64()), **held})

    dealt = rows.mapInArrow(deal, "tree long, node long, x array<double>, cls long, n double, s double, q double")
    grown = dealt.groupBy("tree", "node").applyInArrow(grow, kind)
    return [(r["tree"], r["node"], r["feature"], r["threshold"], r["n"], r["sums"]) for r in grown.collect()]


def row_hash(key: str, seed: int = SEED) -> F.Column:
    """The first 32 bits of the hash of a row's key."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _flat(records: Sequence[tuple]) -> Trees:
    columns = list(zip(*records))
    kinds = (np.int64, np.int64, np.int64, np.float64, np.float64, np.float64)
    return Trees(*(np.array(c, dtype=t) for c, t in zip(columns, kinds)))


def fit_trees(
    df: DataFrame,
    name: str,
    classes: int = 0,
    n_trees: int = 1,
    wanted: str = "all",
    drawn: bool = False,
    max_depth: int | None = None,
    min_samples_split: float = 2,
    min_samples_leaf: float = 1,
) -> TreeModel:
    """Fit on ``features``/``label``; ``__id`` is the key of the draws where it exists.

    Rows without a key are drawn by their content.  The limits on samples count drawn
    rows as often as they are drawn.  The driver and every task hold the trees.
    """
    if "__id" in df.columns:
        key = row_hash("__id")
    else:
        key = F.xxhash64("features", "label").bitwiseAND(F.lit(0xFFFFFFFF))
    rows = df.select(
        vector_to_array("features").alias("x"),
        F.col("label").cast("double").alias("y"),
        (key if drawn else F.lit(0).cast("long")).alias("key"),
    )
    placed = rows.select("x", F.spark_partition_id().alias("part"))
    facts = placed.agg(
        F.max(F.size("x")).alias("features"),
        F.count("*").alias("n"),
        F.count_distinct("part").alias("parts"),
        F.approx_count_distinct(F.xxhash64("x")).alias("kinds"),
    ).first()
    features, n = facts["features"], facts["n"]
    if not features:
        raise ValueError("no rows or no features to grow trees on")
    # Equal rows in one have a few numbers for each tree, others those of the row.
    numbers = features + (n_trees + 1) * (classes or 3)
    together = n > SMALL_ROWS and facts["kinds"] * numbers <= n * (features + 2)
    tasks, cores = -(-n // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism
    tasks = min(tasks, TASKS_PER_CORE * cores)
    if n <= SPREAD_ROWS and facts["parts"] < tasks:
        rows = rows.repartition(tasks)
    elif facts["parts"] > tasks:
        rows = rows.coalesce(tasks)
    part = math.isqrt(features - 1) + 1 if wanted == "sqrt" else features
    depth = DEEPEST if max_depth is None else min(int(max_depth), DEEPEST)
    growth = Growth(classes, features, n_trees, part, drawn, depth, min_samples_split, min_samples_leaf)
    rows = (_equal_rows(rows, growth) if together else rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return TreeModel(name, _grown(rows, growth), classes, features)
    finally:
        rows.unpersist()


def _grown(rows: DataFrame, growth: Growth) -> Trees:
    known = _sums(rows, growth)
    records: dict[tuple[int, int], tuple] = {}
    small: set[tuple[int, int]] = set()
    small_rows = min(SMALL_ROWS, SMALL_NUMBERS // growth.features)
    edges = None
    # A tree that no row was drawn for is one leaf of all rows.
    empty = [t for t in range(growth.trees) if t not in known]
    records |= {(t, 1): (t, 1, -1, 0.0, *known[-1][:2]) for t in empty}
    frontier = [(t, 1, *known[t]) for t in range(growth.trees) if t in known]
    while frontier:
        large = []
        for tree, node, n, sums, squares in frontier:
            records[tree, node] = (tree, node, -1, 0.0, n, sums)
            if growth.ends(node, n, sums, squares):
                continue
            if n <= small_rows:
                small.add((tree, node))
            else:
                large.append(_Large(tree, node, n, sums, squares))
        if not large:
            break
        if edges is None:
            shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
            cuts = [F.percentile_approx(F.col("x")[f], shares, 10_000).alias(f"f{f}") for f in range(growth.features)]
            edges = [np.unique(held) for held in rows.agg(*cuts).first()]
        _split_large(rows, _flat(list(records.values())), large, edges, growth)
        frontier = []
        for g in large:
            if g.best:
                threshold = halfway(g.best[2], g.best[3])
                records[g.tree, g.node] = (g.tree, g.node, g.best[1], threshold, g.n, g.sums)
                frontier += g.children()
    if small:
        for record in _grow_small(rows, _flat(list(records.values())), small, growth):
            records[record[0], record[1]] = record
    return _flat(list(records.values()))
