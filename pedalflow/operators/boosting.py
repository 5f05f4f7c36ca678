"""Boosted regression trees over binned rows: one pass of sums a level, whatever the number of features.

The method and its parameters are those of Spark ML's ``GBTRegressor`` (squared error, variance gain, at most 32 bins a
feature, rows drawn anew each round, features drawn anew for each node), and so is the model that comes out. What differs
is how rows are held: blocks of binned rows, a few features to a word of 16 bits, beside what the trees have not explained
yet. A level adds up counts and gradients by (node, feature, bin) inside the tasks and brings these sums to the driver;
of two children only the one with fewer rows is added up, the other is the rest of its parent. Gradients are whole
multiples of a small unit, so that sums are exact and do not depend on the order of tasks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel, TaskContext
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalflow.session import prepare_checkpoints

BINS = 32
# bits of a word that are used: the cells of a word and eight nodes stay in a core's cache, as do the rows of a block
_BITS = 10
_BLOCK = 20_000
# points by which a block, and then a task, describes the distribution of a feature
_POINTS = 512
_MANY_TASKS = 64
_NOWHERE = 255
# blocks are read in every pass: held as the bytes that go to a task, on disk where memory ends
_KEPT = StorageLevel.MEMORY_AND_DISK_DESER

#: key (task, number), words of binned features, what is left to explain, squared gradients by leaf of the last tree
Block = tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]
#: word, shift and bits of each feature
Layout = list[tuple[int, int, int]]


@dataclass(frozen=True)
class Split:
    """Rows with a bin of the feature above ``bin`` go right; ``gain`` as Spark ML counts it."""

    feature: int
    bin: int
    gain: float

    def above(self, words: np.ndarray, layout: Layout) -> np.ndarray:
        word, shift, bits = layout[self.feature]
        return (words[word] & (((1 << bits) - 1) << shift)) > self.bin << shift


@dataclass(frozen=True)
class Tree:
    """Splits, and rows and gradients, by level and node."""

    levels: list[dict[int, Split]]
    nodes: list[dict[int, tuple[float, float]]]

    def leaves(self) -> Iterator[tuple[int, float]]:
        """Place among the lowest nodes and mean of each leaf: a row of a leaf goes left until it is there."""
        for level, nodes in enumerate(self.nodes):
            for node, (rows, total) in nodes.items():
                if level == len(self.levels) or node not in self.levels[level]:
                    yield node << (len(self.levels) - level), total / rows


# --- bins --------------------------------------------------------------------------------------


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Columns × rows, a block at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], dtype=np.float64))
        if sum(m.shape[1] for m in held) >= _BLOCK:
            yield np.concatenate(held, axis=1)
            held = []
    if sum(m.shape[1] for m in held):
        yield np.concatenate(held, axis=1)


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(values, return_inverse=True)
    return distinct, np.bincount(place, weights=counts, minlength=len(distinct))


def _described(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``_POINTS`` values; the rows up to each of them are counted exactly."""
    if len(values) <= _POINTS:
        return values, counts
    upto = counts.cumsum()
    group = ((upto - counts / 2) * (_POINTS / upto[-1])).astype(np.int64)
    last = np.flatnonzero(np.diff(group, append=-1))
    return values[last], np.diff(upto[last], prepend=0.0)


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct values, or points of the distribution, of every column of a task's rows."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for matrix in _matrices(batches):
        found.append([_described(*(a.astype(np.float64) for a in np.unique(x, return_counts=True))) for x in matrix])
    if not found:
        return
    points = [_described(*_merged(*(np.concatenate(a) for a in zip(*column, strict=True)))) for column in zip(*found, strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(points)), pa.int32()), *(pa.array([p[i].tobytes() for p in points], pa.binary()) for i in (0, 1))],
        ["feature", "points", "counts"],
    )


def thresholds(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Cuts between distinct values where these fill no more than the bins, else between about equal shares of the rows."""
    if len(values) <= BINS:
        return (values[1:] + values[:-1]) / 2
    share = counts.sum() / BINS
    upto = counts.cumsum()
    cuts, target = [], share
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            cuts.append((values[i - 1] + values[i]) / 2)
            target += share
    return np.array(cuts[: BINS - 1])


def feature_cuts(rows: DataFrame) -> list[np.ndarray]:
    """Thresholds of every column, from all rows."""
    points = rows.mapInArrow(_describe, "feature int, points binary, counts binary").collect()
    cuts = []
    for i in range(len(rows.columns)):
        own = [(np.frombuffer(p.points), np.frombuffer(p.counts)) for p in points if p.feature == i]
        cuts.append(thresholds(*_merged(*(np.concatenate(a) for a in zip(*own, strict=True)))))
    return cuts


def layout_of(cuts: Sequence[np.ndarray]) -> Layout:
    """Features with few bins share a word."""
    bits = [len(c).bit_length() for c in cuts]
    used: list[int] = []
    layout: Layout = [(0, 0, 0)] * len(cuts)
    for i in sorted(range(len(cuts)), key=lambda i: -bits[i]):
        word = next((w for w, n in enumerate(used) if n + bits[i] <= _BITS), len(used))
        if word == len(used):
            used.append(0)
        layout[i] = (word, used[word], bits[i])
        used[word] += bits[i]
    return layout


def _bin(cuts: Sequence[np.ndarray], layout: Layout, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for number, (*columns, label) in enumerate(_matrices(batches)):
        words = np.zeros((1 + max(word for word, _, _ in layout), len(label)), np.uint16)
        for cut, column, (word, shift, _) in zip(cuts, columns, layout, strict=True):
            words[word] |= np.searchsorted(cut, column).astype(np.uint16) << shift
        yield pa.RecordBatch.from_pydict(
            {"task": pa.array([task], pa.int32()), "number": pa.array([number], pa.int32()), "words": [words.tobytes()], "rest": [label.tobytes()]}
        )


def _block(row) -> Block:
    rest = np.frombuffer(bytes(row.rest))
    return (row.task, row.number), np.frombuffer(bytes(row.words), np.uint16).reshape(-1, len(rest)), rest, np.zeros(1)


# --- passes over the blocks --------------------------------------------------------------------


def _descend(words: np.ndarray, layout: Layout, levels: Sequence[dict[int, Split]]) -> np.ndarray:
    """The node of each row below the given levels."""
    node = np.zeros(words.shape[1], np.uint8)
    for splits in levels:
        right = np.zeros(len(node), bool)
        for at, split in splits.items():
            right |= split.above(words, layout) & (node == at)
        node = (node << 1) + right
    return node


def _drawn(draw: tuple[int, int, float], key: tuple[int, int], rows: int) -> np.ndarray:
    """The rows of a block that take part in a round: the same in every pass of it."""
    seed, number, rate = draw
    return np.random.default_rng([seed, number, *key]).random(rows, np.float32) < rate


def _add_up(layout, levels, slots, scale, draw, blocks: Iterable[Block]) -> Iterator[np.ndarray]:
    """Rows and gradients by slot of the row's node, feature and bin; then the squares that the blocks carry."""
    slots = np.array(slots, np.uint8)
    wanted = int((slots != _NOWHERE).sum())
    cells = wanted << _BITS
    sums, squares = None, np.zeros(1)
    for key, words, rest, carried in blocks:
        if sums is None:
            sums = np.zeros((2, len(words), cells))
        squares = squares + carried
        slot = slots.take(_descend(words, layout, levels))
        used = np.flatnonzero((slot != _NOWHERE) & _drawn(draw, key, len(rest)))
        base = slot.take(used).astype(np.intp) << _BITS
        gradient = np.rint(rest.take(used) * scale)
        for i, word in enumerate(words):
            cell = base + word.take(used)
            sums[0, i] += np.bincount(cell, minlength=cells)
            sums[1, i] += np.bincount(cell, weights=gradient, minlength=cells)
    if sums is not None:
        by_feature = np.zeros((wanted, 2, len(layout), BINS))
        for i, (word, shift, bits) in enumerate(layout):
            joint = sums[:, word].reshape(2, wanted, -1, 1 << bits, 1 << shift)
            by_feature[:, :, i, : 1 << bits] = joint.sum(axis=(2, 4)).swapaxes(0, 1)
        yield np.concatenate([by_feature.ravel(), squares])


def _explain(layout, levels, values, scale, draw, blocks: Iterable[Block]) -> Iterator[Block]:
    """Blocks without what a tree explains, with the squared gradients of its leaves."""
    for key, words, rest, _ in blocks:
        leaf = _descend(words, layout, levels)
        gradient = np.rint(rest * scale) * _drawn(draw, key, len(rest))
        yield key, words, rest - values.take(leaf), np.bincount(leaf, weights=gradient * gradient, minlength=len(values))


def _total(parts: RDD) -> np.ndarray:
    if parts.getNumPartitions() > _MANY_TASKS:
        return parts.treeReduce(np.add)
    return functools.reduce(np.add, parts.collect())


# --- rounds ------------------------------------------------------------------------------------


def best_split(sums: np.ndarray, allowed: np.ndarray) -> tuple[Split, np.ndarray] | None:
    """The split of a node with the greatest gain, with rows and gradients of its left side; None where none gains."""
    rows, total = sums[:, 0].sum(axis=-1)
    left = sums.cumsum(axis=-1)[:, :, :-1]
    right = np.array([rows, total])[:, None, None] - left
    possible = (left[0] > 0) & (right[0] > 0) & allowed[:, None]
    if not possible.any():
        return None
    score = np.full(possible.shape, -np.inf)
    score[possible] = left[1][possible] ** 2 / left[0][possible] + right[1][possible] ** 2 / right[0][possible]
    feature, cut = np.unravel_index(score.argmax(), score.shape)
    gain = score[feature, cut] - total**2 / rows
    # equal means differ in the last digits of the two sums
    if gain <= 1e-12 * score[feature, cut]:
        return None
    return Split(int(feature), int(cut), float(gain / rows)), left[:, feature, cut]


def _grow(first: np.ndarray, depth: int, chosen: int, rng: np.random.Generator, add_up) -> Tree:
    """A tree, level by level; ``add_up`` sums over the children that it is asked for."""
    known = {0: first}
    tree = Tree([], [{0: tuple(first[:, 0].sum(axis=-1))}])
    for level in range(depth):
        splits, below, fewer = {}, {}, {}
        for node, sums in known.items():
            allowed = np.zeros(sums.shape[1], bool)
            allowed[rng.permutation(len(allowed))[:chosen]] = True
            found = best_split(sums, allowed)
            if found is None:
                continue
            splits[node], left = found
            right = tree.nodes[level][node] - left
            below[2 * node], below[2 * node + 1] = tuple(left), tuple(right)
            fewer[node] = 2 * node + int(right[0] < left[0])
        if not splits:
            break
        tree.levels.append(splits)
        tree.nodes.append(below)
        if level + 1 == depth:
            break
        slots = [_NOWHERE] * (2 << level)
        for slot, child in enumerate(fewer.values()):
            slots[child] = slot
        parents, known = known, {}
        for sums, (node, child) in zip(add_up(tree.levels, slots), fewer.items(), strict=True):
            known[child], known[child ^ 1] = sums, parents[node] - sums
        known = dict(sorted(known.items()))
    return tree


def fit(estimator: GBTRegressor, rows: DataFrame, label: str) -> GBTRegressionModel:
    """Fit the estimator's trees on the columns beside ``label``, in their order.

    ``rows`` are read three times and should be persisted; the number of their partitions is that of every pass.
    """
    context = rows.sparkSession.sparkContext
    prepare_checkpoints(rows.sparkSession)
    get = estimator.getOrDefault
    depth, seed, step, every = (get(p) for p in ("maxDepth", "seed", "stepSize", "checkpointInterval"))
    if depth > 7 or get("maxBins") != BINS:
        raise ValueError(f"trees of at most 7 levels and {BINS} bins")
    y = F.col(label)
    known, count, top = rows.agg(F.count_if(~F.isnan(y) & y.isNotNull()), F.count(F.lit(1)), F.max(F.abs(y))).first()
    if not count or known < count:
        raise ValueError("training needs rows, and a label in each of them")
    inputs = [c for c in rows.columns if c != label]
    chosen = math.ceil(float(get("featureSubsetStrategy")) * len(inputs))
    cuts = feature_cuts(rows.select(*inputs))
    layout = layout_of(cuts)
    binned = rows.select(*inputs, label).mapInArrow(functools.partial(_bin, cuts, layout), "task int, number int, words binary, rest binary")
    blocks = binned.rdd.map(_block).persist(_KEPT)
    # every task of every pass carries the lineage behind it
    blocks.checkpoint()
    # sums of all rows stay below 2**53, up to which whole numbers are exact
    unit = 2.0 ** (math.ceil(math.log2(top or 1.0)) - min(30, 50 - math.ceil(math.log2(count))))

    def add_up(blocks, draw, scale, levels, slots):
        sums = _total(blocks.mapPartitions(functools.partial(_add_up, layout, levels, slots, scale, draw)))
        cells = 2 * sum(s != _NOWHERE for s in slots) * len(inputs) * BINS
        return sums[:cells].reshape(-1, 2, len(inputs), BINS), sums[cells:]

    trees: list[Tree] = []
    squares: list[np.ndarray] = []
    before = stored = None
    # the pass after the last round adds up what the last tree's leaves hold
    for number in range(get("maxIter") + 1):
        draw = (seed, number, get("subsamplingRate"))
        # the first tree follows the label, the others twice what is left: the gradient of the squared error
        scale = (2.0 if number else 1.0) / unit
        sums, carried = add_up(blocks, draw, scale, [], [0])
        if before is not None:
            squares.append(carried)
            before.unpersist()
        if blocks.isCheckpointed():
            _delete(context, stored)
            stored = blocks.getCheckpointFile()
        if number == get("maxIter"):
            break
        rng = np.random.default_rng([seed, number])
        tree = _grow(sums[0], depth, chosen, rng, lambda levels, slots: add_up(blocks, draw, scale, levels, slots)[0])
        trees.append(tree)
        values = np.zeros(1 << len(tree.levels))
        for place, mean in tree.leaves():
            values[place] = mean * unit * (step if number else 1.0)
        before, blocks = blocks, blocks.mapPartitions(functools.partial(_explain, layout, tree.levels, values, scale, draw))
        blocks.persist(_KEPT)
        if every > 0 and (number + 1) % every == 0:
            blocks.checkpoint()
    blocks.unpersist()
    _delete(context, stored)
    weights = [step if i else 1.0 for i in range(len(trees))]
    return estimator._copyValues(GBTRegressionModel(_java_model(context, trees, squares, weights, cuts, unit)))


def _delete(context: SparkContext, path: str | None) -> None:
    if path:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


# --- the model ---------------------------------------------------------------------------------


def _java_model(context: SparkContext, trees, squares, weights, cuts, unit: float):
    """The trees as Spark ML's own model, which scores in the JVM and is saved and loaded with a pipeline."""
    jvm, new_array = context._jvm, context._gateway.new_array
    ml, copy = jvm.org.apache.spark.ml, jvm.java.util.Arrays.copyOfRange
    leaf, inner, cut = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit
    variance = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
    regression = ml.regression

    def doubles(values):
        array = new_array(jvm.double, len(values))
        jvm.java.nio.ByteBuffer.wrap(np.asarray(values, ">f8").tobytes()).asDoubleBuffer().get(array)
        return array

    def tree_model(tree: Tree, by_leaf: np.ndarray):
        depth = len(tree.levels)
        places = [(level, node) for level, nodes in enumerate(tree.nodes) for node in nodes]
        stats = []
        for level, node in places:
            rows, total = tree.nodes[level][node]
            under = by_leaf[node << (depth - level) : (node + 1) << (depth - level)].sum()
            stats.append((rows, total * unit, under * unit * unit))
        stored = doubles(np.ravel(stats))
        made = {}
        for i, (level, node) in reversed(list(enumerate(places))):
            rows, total, square = (float(v) for v in stats[i])
            mean = total / rows
            impurity = max(square / rows - mean * mean, 0.0)
            known = variance(copy(stored, 3 * i, 3 * i + 3), int(rows))
            split = tree.levels[level].get(node) if level < depth else None
            if split is None:
                made[level, node] = leaf(mean, impurity, known)
            else:
                left, right = made.pop((level + 1, 2 * node)), made.pop((level + 1, 2 * node + 1))
                at = cut(split.feature, float(cuts[split.feature][split.bin]))
                made[level, node] = inner(mean, impurity, split.gain * unit * unit, left, right, at, known)
        return regression.DecisionTreeRegressionModel("dtr", made[0, 0], len(cuts))

    models = new_array(regression.DecisionTreeRegressionModel, len(trees))
    for i, (tree, by_leaf) in enumerate(zip(trees, squares, strict=True)):
        models[i] = tree_model(tree, by_leaf)
    return regression.GBTRegressionModel("boosted_trees", models, doubles(weights), len(cuts))
