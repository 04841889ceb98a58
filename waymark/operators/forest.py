"""Random forests of all cars at once, grown level by level.

Trees of all cars grow together: each level is one counting job. A training row has a weight per tree (a hashed Poisson draw, or what else
the caller asks for) and carries its node in each, two short arrays; it adds its weight to ``(car, tree, node, feature, value, zone)``
counts, which Spark combines before the shuffle, and then moves by the splits of that level alone. Split search then works on these counts only. The splits of a car are four short
arrays (at most ``trees * 2**level`` entries each), so rows meet them in one join per level. Cuts lie between any two values
that occur, however many there are. The features of a node are drawn once for all cars with as many features, not row by row.

Cars of up to ``SMALL_CELLS`` cells (rows times trees) whose leaves are all that is asked for are grown whole inside tasks, after one shuffle of the
rows: the same steps over arrays of many cars. The jobs by level are for larger cars. Both give the same trees.

Draws come from MD5, so other engines can repeat them. Features are whole numbers in an array ``x`` or, when most are zero, a map ``x`` from
feature to value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import md5, whole
from waymark.session import discard, materialise

CAR = ("out_id",)
#: Rows times trees (or features, where these are more) of a car that is grown inside one task.
SMALL_CELLS = 400_000
#: Cells of small cars that are worked on at once: their arrays stay in a processor's cache.
AT_ONCE = 60_000
#: The weight of a row in the tree of a number.
Weight = Callable[[Column], Column]

# Cumulative Poisson(1) probabilities of 0, 1, 2, ... copies of a row in a bootstrap sample.
POISSON_1 = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941, 0.99992)


def feature_rows(train: DataFrame, queries: DataFrame, columns: Sequence[str], keys: Sequence[str] = CAR) -> tuple[DataFrame, DataFrame]:
    """Rows ``keys, r_key, [label,] x, n_features``; queries only of cars with training rows."""
    keys = list(keys)
    x = F.array(*[F.col(c).cast("bigint") for c in columns]).alias("x")
    size = F.lit(len(columns)).alias("n_features")
    known = train.select(*keys).distinct()
    return (
        train.select(*keys, "r_key", F.col("end_zoneid").alias("label"), x, size),
        queries.select(*keys, "r_key", x, size).join(known, keys, "left_semi"),
    )


def _drawn(*parts: Column | str | int) -> Column:
    """A whole number below 2**32 from the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Bootstrap:
    """How often a row is in the sample of a tree: as an expression, or for many rows and trees as arrays."""

    seed: int

    def __call__(self, tree: Column) -> Column:
        steps = F.array(*[F.lit(p) for p in POISSON_1])
        draw = _drawn(self.seed, tree, "r_key") / F.lit(float(1 << 32))
        return F.get(F.transform(F.array(draw), lambda d: F.size(F.filter(steps, lambda p: p <= d))), 0)  # one draw for all steps

    def matrix(self, keys: Sequence[str | None], trees: int) -> np.ndarray:
        """Rows by trees, of rows with these ``r_key`` as text."""
        copies = np.empty((len(keys), trees), np.uint8)
        for tree, drawn in enumerate(md5.first_words([f"{self.seed}:{t}" for t in range(trees)], keys)):
            copies[:, tree] = np.searchsorted(POISSON_1, drawn / float(1 << 32), side="right")
        return copies


def bootstrap(seed: int = 0) -> Weight:
    """How often a row is in the sample of a tree."""
    return Bootstrap(seed)


def fold_of(folds: int, r_key: str = "r_key") -> Column:
    """The fold of a trip, from 0."""
    return (_drawn(F.lit("fold"), r_key) % folds).cast("int")


def other_folds(folds: int) -> Weight:
    """Tree number f learns from all rows but those of fold f."""
    return lambda tree: (fold_of(folds) != tree).cast("int")


def _value(x: Column, feature: Column, sparse: bool) -> Column:
    return F.coalesce(x[feature], F.lit(0)).cast("bigint") if sparse else F.get(x, feature)


def _moved(nodes: Column, split: str, level: int, sparse: bool) -> Column:
    """Where rows are after ``level`` has been split. Nodes count from 1, the children of n are 2n and 2n + 1; a row that has stopped keeps
    the number of a higher level. A level names ``nodes`` once, so that the levels of a tree can be nested without growing."""
    first = 2**level

    def step(node: Column, tree: Column) -> Column:
        cut = F.get(F.col(split), tree * first + node - first)
        right = 2 * _value(F.col("x"), cut.feature, sparse) > cut.twice_cut
        return F.when((node < first) | cut.isNull(), node).otherwise(2 * node + right.cast("int"))

    return F.transform(nodes, step)


def _start(trees: int) -> Column:
    return F.array_repeat(F.lit(1), trees)


def _planted(train: DataFrame, trees: int, weight: Weight | None) -> DataFrame:
    """Training rows with their weight in every tree, drawn once, and with their node in every tree: the first.

    A row stands for as many rows as there are trees, so rows are spread by count, not by their bytes.
    """
    train = train.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), "r_key")
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    weights = F.transform(numbers, (lambda tree: weight(tree).cast("int")) if weight else (lambda _: F.lit(1)))
    return materialise(train.withColumn("weights", weights).withColumn("nodes", _start(trees)), "forest-rows")


def _each_tree(planted: DataFrame) -> DataFrame:
    """Training rows once for each tree in which they have a weight ``w``, at their ``node``."""
    own = [c for c in planted.columns if c not in ("weights", "nodes")]
    spread = planted.select(*own, F.posexplode(F.arrays_zip("weights", "nodes")).alias("tree", "t"))
    return spread.select(*own, "tree", F.col("t.weights").alias("w"), F.col("t.nodes").alias("node")).where("w > 0")


def _reached(queries: DataFrame, model: DataFrame, keys: list[str], trees: int, depth: int, sparse: bool) -> DataFrame:
    """Queries once per tree, at the ``node`` where they end."""
    nodes = _start(trees)
    for level in range(depth):
        nodes = _moved(nodes, f"split{level}", level, sparse)
    return queries.join(model, keys, "left").select(*keys, "r_key", F.posexplode(nodes).alias("tree", "node"))


def _features(nodes: DataFrame, level: int, per_node: int, seed: int) -> DataFrame:
    """(n_features, tree, node, feature) of the features that each of ``nodes`` (n_features, tree, node) looks at."""
    count = F.col("n_features")
    wanted = F.ceil(F.sqrt(count.cast("double"))) if per_node == 0 else F.lit(per_node)
    drawn = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda j: F.struct(_drawn(seed, "tree", level, "node", j).alias("h"), j.cast("int").alias("j")),
    )
    chosen = F.transform(F.slice(F.array_sort(drawn), 1, wanted.cast("int")), lambda s: s.j)
    return materialise(nodes.select("n_features", "tree", "node", F.explode(chosen).alias("feature")), "forest-features")


def split_counts(rows: DataFrame, features: DataFrame | None, keys: list[str], sparse: bool) -> DataFrame:
    """Weights per ``(keys, tree, node, feature, value, label)``, of all features or those in ``features``."""
    if features is None:
        rows = rows.withColumn("feature", F.explode(F.sequence(F.lit(0), F.col("n_features") - 1)))
    else:
        rows = rows.join(features, ["n_features", "tree", "node"])
    value = _value(F.col("x"), F.col("feature"), sparse).alias("value")
    return rows.groupBy(*keys, "tree", "node", "feature", value, "label").agg(F.sum("w").alias("w"))


def best_splits(counts: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """The cut with the least weighted Gini impurity of each node: ``feature, twice_cut, gain, weight``.

    With L and R the weights per zone left and right of a cut, the impurity falls as ``sum L**2 / sum L + sum R**2 / sum R``
    grows. Running sums over the counts give both squares without a zone by cut table: adding weight w to a zone with
    weight l before adds ``2*l*w + w*w``, and ``sum R**2 = sum T**2 - 2 * sum T*L + sum L**2`` with totals T.
    Pure nodes have no cut. Equal cuts: lower feature, then lower value.
    """
    node = [*keys, "tree", "node", "feature"]
    counts = counts.repartition(*node)  # all that follows but the last step is divided like this
    counts = counts.withColumn("_k", F.xxhash64(*node))  # sorts compare this number first, not the keys one by one
    node = ["_k", *node]
    zone = Window.partitionBy(*node, "label")
    before = F.coalesce(F.sum("w").over(zone.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grown = counts.withColumn("_l", before).withColumn("_t", F.sum("w").over(zone))
    values = grown.groupBy(*node, "value").agg(
        F.sum("w").alias("w"),
        F.sum(2 * F.col("_l") * F.col("w") + F.col("w") * F.col("w")).alias("_ll"),
        F.sum(F.col("_t") * F.col("w")).alias("_tl"),
    )
    ordered = Window.partitionBy(*node).orderBy("value")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*node)
    cuts = values.select(
        *node,
        "value",
        F.lead("value").over(ordered).alias("_next"),
        F.sum("w").over(upto).alias("_wl"),
        F.sum("_ll").over(upto).alias("_sl"),
        F.sum("_tl").over(upto).alias("_x"),
        F.sum("w").over(whole).alias("_w"),
        F.sum("_ll").over(whole).alias("_s"),
    )
    right = F.col("_s") - 2 * F.col("_x") + F.col("_sl")
    score = F.col("_sl") / F.col("_wl") + right / (F.col("_w") - F.col("_wl"))
    scored = cuts.where(F.col("_next").isNotNull() & (F.col("_s") < F.col("_w") * F.col("_w"))).withColumn("_score", score)
    cut = F.struct(
        "feature",
        (F.col("value") + F.col("_next")).alias("twice_cut"),
        (F.col("_score") - F.col("_s") / F.col("_w")).alias("gain"),
        F.col("_w").alias("weight"),
    )
    rank = F.struct("_score", -F.col("feature"), -F.col("value"))
    # First by feature, where the rows already lie in order, so that only a node's best cuts are shuffled and sorted again.
    each = scored.groupBy(*node).agg(F.max_by(cut, rank).alias("b"), F.max(rank).alias("_rank"))
    best = each.groupBy(*keys, "tree", each["node"]).agg(F.max_by("b", "_rank").alias("b"))
    return best.select(*keys, "tree", "node", "b.*")


def _as_arrays(splits: DataFrame, level: int, trees: int, keys: list[str]) -> DataFrame:
    """One array of splits per car, indexed by ``tree * 2**level + node``, null where a node does not split.

    Filled tree by tree, then car by car, as looking up every place of a car in one map would grow with the square of its places.
    """
    width = 2**level
    of_node = F.map_from_entries(F.collect_list(F.struct(F.col("node").cast("int"), F.struct("feature", "twice_cut").alias("split"))))
    nodes = splits.groupBy(*keys, "tree").agg(of_node.alias("_n")).select(
        *keys, "tree", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.col("_n")[i]).alias("_nodes")
    )
    of_tree = F.map_from_entries(F.collect_list(F.struct(F.col("tree").cast("int"), "_nodes")))
    none = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda _: F.lit(None))
    return nodes.groupBy(*keys).agg(of_tree.alias("_m")).select(
        *keys,
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.col("_m")[t], none))).alias(f"split{level}"),
    )


def _grown(planted: DataFrame, trees: int, depth: int, seed: int, per_node: int | None, keys: list[str], sparse: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The model, all splits, and the training rows at the nodes where they end. Each level moves the rows by its own splits only."""
    model = materialise(planted.groupBy(*keys).agg(F.max("n_features").alias("n_features")), "forest-cars")
    sizes, every, splits = model, None, None
    for level in range(depth):
        features = None
        if per_node is not None:
            tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
            if splits is None:
                nodes = sizes.select("n_features").distinct().select("n_features", tree, F.lit(0).alias("node"))
            else:
                below = F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node")
                nodes = splits.join(sizes, keys).select("n_features", "tree", below).distinct()
            features = _features(nodes, level, per_node, seed)
        open_ = _each_tree(planted).withColumn("node", F.col("node") - 2**level).where("node >= 0")
        found = best_splits(split_counts(open_, features, keys, sparse), keys)
        splits = materialise(found.withColumn("level", F.lit(level)), "forest-splits")
        every = splits if every is None else every.unionByName(splits)
        arrays = materialise(_as_arrays(splits, level, trees, keys), "forest-arrays")
        model = model.join(arrays, keys, "left")
        moved = planted.join(arrays, keys, "left").withColumn("nodes", _moved(F.col("nodes"), f"split{level}", level, sparse))
        before, planted = planted, materialise(moved.drop(f"split{level}"), "forest-rows")
        discard(before, *([features] if features else []))
    return materialise(model, "forest-model"), every, planted


def grow(
    train: DataFrame,
    trees: int,
    depth: int,
    seed: int = 0,
    weight: Weight | None = None,
    per_node: int | None = None,
    keys: Sequence[str] = CAR,
    sparse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Grow the forests. Returns the model (one row per car) and all splits with their gain.

    ``weight`` is a row's weight in ``tree`` (None: 1 in all). ``per_node`` features are tried at each node: 0 means the square root of
    their number, ``None`` all of them.
    """
    model, splits, planted = _grown(_planted(train, trees, weight), trees, depth, seed, per_node, list(keys), sparse)
    discard(planted)
    return model, splits


class _Draws:
    """The features that each node looks at, as ``_features`` draws them, for any number of features."""

    def __init__(self, seed: int, trees: int, per_node: int | None):
        self.seed, self.trees, self.per_node = seed, trees, per_node
        self.drawn: dict[int, np.ndarray] = {}
        self.found: dict[tuple[int, int], np.ndarray] = {}

    def _numbers(self, level: int, n: int) -> np.ndarray:
        have = self.drawn.get(level, np.zeros((self.trees << level, 0), np.int64))
        if have.shape[1] < n:
            places = range(self.trees << level)
            more = [
                [int.from_bytes(hashlib.md5(f"{self.seed}:{p >> level}:{level}:{p % (1 << level)}:{j}".encode()).digest()[:4]) for j in range(have.shape[1], n)]
                for p in places
            ]
            have = self.drawn[level] = np.hstack([have, np.array(more, np.int64)])
        return have

    def at(self, level: int, n: int) -> np.ndarray:
        """Features in rising order by ``tree * 2**level + node``, for cars with ``n`` features."""
        if self.per_node is None:
            return np.tile(np.arange(n), (self.trees << level, 1))
        if (level, n) not in self.found:
            wanted = min(n, int(np.ceil(np.sqrt(float(n)))) if self.per_node == 0 else self.per_node)
            order = np.argsort(self._numbers(level, n)[:, :n], axis=1, kind="stable")
            self.found[level, n] = np.sort(order[:, :wanted], axis=1)
        return self.found[level, n]


def _group_sums(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place what the groups before its own sum up to, and the sum of its own."""
    total = np.cumsum(values)
    before = total[first] - values[first]
    return np.repeat(before, length), np.repeat(total[first + length - 1] - before, length)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of equal keys begin, which lie together, and their lengths."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return first, np.diff(np.r_[first, len(key)])


def _node_cuts(seg: np.ndarray, ids: int, label: np.ndarray, w: np.ndarray, looks: np.ndarray, x: np.ndarray, row: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Score, feature and twice the cut of the best cut of each of ``ids`` nodes, as ``best_splits``; -1 as feature where there is none.
    Cells of node ``seg`` have weight ``w`` and look at the features in their row of ``looks``.

    A place adds ``2*l*w + w*w`` to the left sum of squares, with ``l`` what its zone has before it; so sums are right wherever a value ends. Sums over
    a node or a zone in it are the same by every feature. Sorted numbers end in the place they had, so that no place has to be looked up.
    """
    best = [np.full(ids, -np.inf), np.full(ids, -1), np.zeros(ids, np.int64)]
    some = np.empty(ids, label.dtype)
    some[seg] = label
    mixed = np.zeros(ids, bool)
    mixed[seg[label != some[seg]]] = True  # pure nodes have no cut
    cells = np.flatnonzero(mixed[seg])
    if not len(cells):
        return best
    place = np.arange(len(cells))
    bits = len(cells).bit_length()
    mask = (1 << bits) - 1
    cells = cells[np.sort((seg[cells] << bits) | place) & mask]
    seg, label, w, looks, row = seg[cells], label[cells].astype(np.int64), w[cells], looks[cells], row[cells]
    zones = int(label.max()) + 1
    by_zone = np.sort(((seg * zones + label) << bits) | place)
    zone = by_zone & mask
    before_zone, in_zone = _group_sums(w[zone], *_groups(by_zone >> bits))
    t = np.empty_like(w)
    t[zone] = in_zone
    nodes = _groups(seg)
    before_w, all_w = _group_sums(w, *nodes)
    before_s, all_s = _group_sums(t * w, *nodes)
    inside = seg[1:] == seg[:-1]
    for i in range(looks.shape[1]):
        value = rank[row, looks[:, i]]
        start = seg * (int(value.max()) + 1)
        order = np.sort(((start + value) << bits) | place)
        value, order = (order >> bits) - start, order & mask
        at = np.flatnonzero(inside & (value[1:] != value[:-1]))
        if not len(at):
            continue
        here_w, here_t = w[order], t[order]
        zone = np.sort(((seg * zones + label[order]) << bits) | place) & mask
        zone_w = here_w[zone]
        l = np.empty_like(w)
        l[zone] = np.cumsum(zone_w) - before_zone - zone_w
        wl = np.cumsum(here_w)[at] - before_w[at]
        sl = np.cumsum(2 * l * here_w + here_w * here_w)[at] - before_s[at]
        tl = np.cumsum(here_t * here_w)[at] - before_s[at]
        score = sl / wl + (all_s[at] - 2 * tl + sl) / (all_w[at] - wl)
        found, first = whole.best_of(ids, seg[at], score)
        better = score[first] > best[0][found]  # features come in rising order: equal scores stay with the lower
        found, first = found[better], first[better]
        here, next_ = order[at[first]], order[at[first] + 1]
        feature = looks[here, i]
        best[0][found], best[1][found] = score[first], feature
        best[2][found] = x[row[here], feature] + x[row[next_], feature]
    return best


def _moved_cells(node: np.ndarray, tree: np.ndarray, row: np.ndarray, x: np.ndarray, first: int, feature: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Cells after a level has been split; ``tree`` numbers the trees of all cars. As ``_moved``."""
    goes = np.flatnonzero(node >= first)
    at = tree[goes] * first + node[goes] - first
    goes, at = goes[feature[at] >= 0], at[feature[at] >= 0]
    node = node.copy()
    node[goes] = 2 * node[goes] + (2 * x[row[goes], feature[at]] > twice[at])
    return node


def _grow_cars(car: np.ndarray, learns: np.ndarray, label: np.ndarray, weights: np.ndarray, x: np.ndarray, sizes: np.ndarray, depth: int, draws: _Draws) -> Iterator[tuple[np.ndarray, ...]]:
    """Of cars that count from 0 with ``sizes`` features, the shares (row, tree, label's place, p) of rows that don't learn, piece by piece."""
    trees = weights.shape[1]
    rank = np.stack([np.unique(x[:, f], return_inverse=True)[1].ravel() for f in range(x.shape[1])], axis=1)
    row, number = np.nonzero((weights > 0) & learns[:, None])
    w, tree = weights[row, number].astype(np.int64), car[row] * trees + number
    node = np.ones(len(row), np.int64)
    ask = np.flatnonzero(~learns)
    a_row, a_number = np.repeat(ask, trees), np.tile(np.arange(trees), len(ask))
    a_tree, a_node = car[a_row] * trees + a_number, np.ones(len(ask) * trees, np.int64)
    all_trees = len(sizes) * trees
    for level in range(depth):
        first = 1 << level
        cut, twice = np.full(all_trees * first, -1), np.zeros(all_trees * first, np.int64)
        open_ = np.flatnonzero(node >= first)
        place = tree[open_] * first + node[open_] - first
        for n in np.unique(sizes):
            own = sizes[car[row[open_]]] == n
            cells, ids, features = open_[own], place[own], draws.at(level, int(n))
            if not len(cells):
                continue
            ids, seg = np.unique(ids, return_inverse=True)
            looks = features[number[cells] * first + node[cells] - first]
            _, cut[ids], twice[ids] = _node_cuts(seg, len(ids), label[row[cells]], w[cells], looks, x, row[cells], rank)
        node = _moved_cells(node, tree, row, x, first, cut, twice)
        a_node = _moved_cells(a_node, a_tree, a_row, x, first, cut, twice)
    # leaves: weight of each label, in the order of leaves
    ends, zones = 1 << depth, int(label.max()) + 1
    leaf, a_leaf = tree * 2 * ends + node, a_tree * 2 * ends + a_node
    pairs, at = np.unique(leaf * zones + label[row], return_inverse=True)
    held = np.bincount(at, w).astype(np.int64)
    leaves, first, count = np.unique(pairs // zones, return_index=True, return_counts=True)
    share = held / np.repeat(np.add.reduceat(held, first), count) if len(first) else np.zeros(0)
    found = np.searchsorted(leaves, a_leaf)
    has = np.flatnonzero((leaves[np.minimum(found, len(leaves) - 1)] == a_leaf) if len(leaves) else np.zeros(len(a_leaf), bool))
    found = found[has]
    for a, b in whole.pieces(has, count[found], 4 * SMALL_CELLS):
        which, k, _ = whole.spread(count[found[a:b]])
        here = first[found[a:b]][which] + k
        cells = has[a:b][which]
        yield a_row[cells], a_number[cells], pairs[here] % zones, share[here]


def _whole_cars(rows: DataFrame, weights: Column | Bootstrap, trees: int, depth: int, seed: int, per_node: int | None, keys: list[str], summed: bool) -> DataFrame:
    """``keys, tree, r_key, zoneid, p``, or with ``summed`` without ``tree`` and the sums of ``p`` over trees.

    ``rows`` have ``role`` (0: learns, 1: asks), ``label``, ``x`` and ``n_features``. ``weights`` are an array by tree, or drawn in the task.
    """
    bound = min(SMALL_CELLS, AT_ONCE)

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.r_[starts[1:], table.num_rows]
        sizes = table.column("n_features").to_numpy()[starts]
        if sample:
            learn = np.flatnonzero(table.column("role").to_numpy() == 0)
            drawn = np.zeros((table.num_rows, trees), np.uint8)
            drawn[learn] = sample.matrix(table.column("weights").take(pa.array(learn)).to_pylist(), trees)
        for a, b in whole.pieces(starts, (ends - starts) * np.maximum(trees, sizes), bound):
            part = table.slice(int(starts[a]), int(ends[b - 1] - starts[a])).combine_chunks()
            learns = part.column("role").to_numpy() == 0
            names = part.column("label").combine_chunks()
            names = (names.chunk(0) if isinstance(names, pa.ChunkedArray) else names).dictionary_encode(null_encoding="encode")
            x = whole.matrix(part.column("x"), int(sizes[a:b].max()))
            car = np.repeat(np.arange(b - a), (ends - starts)[a:b])
            weights = drawn[int(starts[a]) : int(ends[b - 1])] if sample else whole.matrix(part.column("weights"), trees)
            for row, tree, zone, p in _grow_cars(car, learns, names.indices.to_numpy(), weights, x, sizes[a:b], depth, draws):
                if summed:
                    key, at = np.unique(row * len(names.dictionary) + zone, return_inverse=True)
                    row, zone, p = key // len(names.dictionary), key % len(names.dictionary), np.bincount(at, p)
                out = part.select([*keys, "r_key"]).take(pa.array(row))
                if not summed:
                    out = out.add_column(len(keys), "tree", pa.array(tree.astype(np.int32)))
                out = out.append_column("zoneid", names.dictionary.take(pa.array(zone))).append_column("p", pa.array(p))
                yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    draws, sample = _Draws(seed, trees, per_node), weights if isinstance(weights, Bootstrap) else None
    tree = [] if summed else [F.lit(0).alias("tree")]
    schema = rows.select(*keys, *tree, "r_key", F.col("label").alias("zoneid"), F.lit(0.0).alias("p")).schema
    return whole.by_car(rows, keys, work, schema, {"weights": F.col("r_key").cast("string") if sample else weights})


def _shares(train: DataFrame, queries: DataFrame, trees: int, depth: int, seed: int, weight: Weight | None, per_node: int | None, keys: list[str], sparse: bool, summed: bool) -> DataFrame:
    """Shares by tree of all queries, or with ``summed`` their sums over trees (those of a zone may come in several rows)."""
    cells = F.count("*") * F.greatest(F.lit(trees), F.max("n_features"))
    sizes = train.select(*keys, "n_features", F.lit(1).alias("learns")).unionByName(queries.select(*keys, "n_features", F.lit(0).alias("learns")))
    sizes = sizes.groupBy(*keys).agg(cells.cast("long").alias("cells"), F.max("learns").alias("learns")).where("learns = 1")
    sizes = materialise(sizes.select(*keys, "cells"), "forest-sizes")
    small, large = (sizes.where(c).select(*keys) for c in (F.col("cells") <= SMALL_CELLS, F.col("cells") > SMALL_CELLS))
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    weights = F.transform(numbers, (lambda tree: weight(tree).cast("int")) if weight else (lambda _: F.lit(1)))
    known = train.select(*keys, "r_key", "label", "x", "n_features", F.lit(0).alias("role"))
    asked = queries.select(*keys, "r_key", F.lit(None).cast(train.schema["label"].dataType).alias("label"), "x", "n_features", F.lit(1).alias("role"))
    weights = weight if isinstance(weight, Bootstrap) else F.when(F.col("role") == 0, weights).otherwise(F.array_repeat(F.lit(0), trees))
    found = _whole_cars(known.unionByName(asked).join(small, keys, "left_semi"), weights, trees, depth, seed, per_node, keys, summed)
    if large.isEmpty():
        return found
    train, queries = (df.join(large, keys, "left_semi") for df in (train, queries))
    each = _by_levels(train, queries, trees, depth, seed, weight, per_node, keys, sparse)
    return found.unionByName(each.drop("tree") if summed else each)


def tree_shares(
    train: DataFrame,
    queries: DataFrame,
    trees: int = 50,
    depth: int = 4,
    seed: int = 0,
    weight: Weight | None = None,
    per_node: int | None = None,
    keys: Sequence[str] = CAR,
    sparse: bool = False,
) -> DataFrame:
    """``keys, tree, r_key, zoneid, p``: the zone shares in the leaf that a query falls into, tree by tree."""
    return _shares(train, queries, trees, depth, seed, weight, per_node, list(keys), sparse, False)


def _by_levels(train: DataFrame, queries: DataFrame, trees: int, depth: int, seed: int, weight: Weight | None, per_node: int | None, keys: list[str], sparse: bool) -> DataFrame:
    """``tree_shares`` of cars of any size, by jobs over all rows."""
    model, _, planted = _grown(_planted(train, trees, weight), trees, depth, seed, per_node, keys, sparse)
    leaf = [*keys, "tree", "node"]
    weights = _each_tree(planted).groupBy(*leaf, "label").agg(F.sum("w").alias("w"))
    totals = weights.groupBy(*leaf).agg(F.sum("w").alias("_all"))
    shares = weights.join(totals, leaf).select(*leaf, F.col("label").alias("zoneid"), (F.col("w") / F.col("_all")).alias("p"))
    shares = materialise(shares, "forest-leaves")
    discard(planted)
    reached = _reached(queries, model.drop("n_features"), keys, trees, depth, sparse)
    return reached.join(shares, leaf).select(*keys, "tree", "r_key", "zoneid", "p")


def forest_probabilities(train: DataFrame, queries: DataFrame, trees: int = 100, depth: int = 4, seed: int = 0, keys: Sequence[str] = CAR, sparse: bool = False) -> DataFrame:
    """Mean over trees of the zone shares in the leaf a query falls into.

    Trees whose sample of a car is empty have no leaves; the rest share the weight.
    """
    keys = list(keys)
    each = _shares(train, queries, trees, depth, seed, bootstrap(seed), 0, keys, sparse, True)
    sums = each.groupBy(*keys, "r_key", "zoneid").agg(F.sum("p").alias("p"))
    over = sums.groupBy(*keys, "r_key").agg(F.sum("p").alias("_sum"))
    return sums.join(over, [*keys, "r_key"]).select(*keys, "r_key", "zoneid", (F.col("p") / F.col("_sum")).alias("p"))


def cross_fitted(train: DataFrame, folds: int = 5, depth: int = 4, keys: Sequence[str] = CAR) -> DataFrame:
    """``keys, part, r_key, zoneid, p`` of every training row, from the tree that hasn't learned from its fold ``part``.

    The trees of all folds grow side by side in the same jobs: a row has weight 0 in that of its own fold.
    """
    each = tree_shares(train, train.drop("label"), folds, depth, weight=other_folds(folds), keys=keys)
    return each.where(F.col("tree") == fold_of(folds)).withColumnRenamed("tree", "part")


def fold_shares(train: DataFrame, queries: DataFrame, folds: int = 5, depth: int = 4, keys: Sequence[str] = CAR) -> DataFrame:
    """``keys, part, r_key, zoneid, p`` of every query from each of the trees that leave out one fold."""
    return tree_shares(train, queries, folds, depth, weight=other_folds(folds), keys=keys).withColumnRenamed("tree", "part")


def feature_importance(splits: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of the impurity removed by each feature over all cars, greatest first; features never used have 0."""
    found = splits.groupBy("feature").agg(F.sum("gain").alias("gain"))
    total = splits.agg(F.sum("gain")).scalar()
    labels = F.array(*[F.struct(F.lit(i).alias("feature"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    every = splits.sparkSession.range(1).select(F.explode(labels).alias("n")).select("n.*")
    return (
        every.join(found, "feature", "left")
        .select("name", F.coalesce(F.try_divide(F.col("gain"), total), F.lit(0.0)).alias("importance"))
        .orderBy(F.desc("importance"), "name")
    )
