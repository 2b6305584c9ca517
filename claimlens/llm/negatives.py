"""Hard negatives by exact search in a multiway hyperplane tree.

Every node has up to FANOUT split points; a vector belongs to the subtree of the nearest one. The node stores,
for each split point and each sibling subtree, the least and the greatest distance from the point to the subtree's vectors.
For an anchor at distance d from the point, a subtree whose range is [low, high] holds only vectors at distance
max(low - d, d - high) to d + high from the anchor. With the range of the subtree's norms that bounds the scores
in it, and a subtree is left out if they miss the anchor's window: above the worst positive found so far, or between half and
95 % of a positive's score and above the worst negative found so far. What is left is scored in full at the leaves.

The tree's shape comes from a bounded sample; ranges are taken over all vectors. Leaves are stored as blocks of bounded size.
Anchors and blocks meet by (group of leaves, batch of anchors): a task holds one batch and reads the blocks as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimlens.session import small_side, written

# The tree: split points per node, vectors per leaf, leaves at most (beyond, leaves hold more blocks), sample of the fit.
FANOUT = 8
LEAF_ROWS = 2_048
MAX_LEAVES = 4_096
SAMPLE_ROWS = 8_192
# Vectors of leaves that are visited together, anchors that a task holds at once.
GROUP_ROWS = 131_072
BATCH_ANCHORS = 8_192
SCORES_AT_ONCE = 2_000_000
ROUTED_AT_ONCE = 1_024
SLACK = 1e-6
EXACT = 2.0**53
# Stands for a missing score; its negative is a score too.
NONE = -(2**63 - 1)


# --- vectors inside tasks ---------------------------------------------------------------


def matrix(vectors: list | np.ndarray, width: int = 0) -> np.ndarray:
    """Whole-number vectors as rows, the shorter ones filled up with zeros."""
    rows = [np.asarray(v, np.int64) for v in vectors]
    width = max([1, width, *map(len, rows)])
    out = np.zeros((len(rows), width), np.int64)
    for n, row in enumerate(rows):
        out[n, : len(row)] = row
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows (modulo 2^64). Doubles are exact while no sum passes 2^53."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] - 2 * (x @ points.T) + (points * points).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Node:
    points: np.ndarray
    children: list
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)


@dataclass
class Tree:
    """Inner nodes hold points and children (nodes or leaf numbers). ``norms`` has the range of every child's norms, by node."""

    root: Node | int
    width: int
    leaves: int

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, fanout: int = FANOUT) -> Tree:
        """A tree of about ``leaves`` leaves; split points are sample vectors far from each other."""
        count = 0
        distinct = np.unique(sample.astype(np.float64), axis=0) if len(sample) else np.zeros((0, 1))

        def grow(x: np.ndarray, wanted: float):
            nonlocal count
            if wanted < 2 or len(x) < 2 * fanout or count >= MAX_LEAVES - fanout:
                count += 1
                return count - 1
            points = x[cls._spread(x, fanout)]
            nearest = _distances(x, points).argmin(1)
            return Node(points, [grow(x[nearest == j], wanted * (nearest == j).mean()) for j in range(len(points))])

        root = grow(distinct, float(leaves))
        return cls(root, distinct.shape[1], count)

    @staticmethod
    def _spread(x: np.ndarray, count: int) -> np.ndarray:
        """Farthest-first choice among a few vectors, so that no two split points are alike."""
        few = x[:: max(1, len(x) // (3 * count))]
        chosen = [0]
        away = _distances(few, few[:1])[:, 0]
        while len(chosen) < count and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, _distances(few, few[chosen[-1:]])[:, 0])
        return np.arange(len(x))[:: max(1, len(x) // (3 * count))][chosen]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)

        def down(node, rows):
            if isinstance(node, Node):
                nearest = _distances(x[rows], node.points).argmin(1)
                for j, child in enumerate(node.children):
                    if (mine := rows[nearest == j]).size:
                        down(child, mine)
            else:
                out[rows] = node

        down(self.root, np.arange(len(x)))
        return out

    def path(self, leaf: int) -> list[tuple[Node, int]]:
        """(node, child on the way) from the root to a leaf."""

        def find(node) -> list | None:
            if not isinstance(node, Node):
                return [] if node == leaf else None
            for j, child in enumerate(node.children):
                if (rest := find(child)) is not None:
                    return [(node, j), *rest]
            return None

        return find(self.root)

    def measured(self, leaf: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest norm of a leaf's vectors, and of their distances to all split points on its path."""
        away = [np.sqrt((x * x).sum(1))[:, None]] + [_distances(x, node.points) for node, _ in self.path(leaf)]
        every = np.concatenate(away, axis=1)
        return every.min(0), every.max(0)

    def bounded(self, ranges: dict[int, tuple[np.ndarray, np.ndarray]]) -> Tree:
        """Put the leaves' ranges together to those of every subtree: ``low[i, j]`` and ``high[i, j]`` are the distances
        from split point i to subtree j; the last row has the norms."""

        def fill(node, above: int) -> tuple[np.ndarray, np.ndarray]:
            """Ranges of a subtree's norms and of its distances to the points above it, ``above`` columns in all."""
            if not isinstance(node, Node):
                low, high = ranges.get(node, (np.full(above, np.inf), np.full(above, -np.inf)))
                return low[:above], high[:above]
            n = len(node.points)
            sides = [fill(child, above + n) for child in node.children]
            node.low, node.high = (np.array([np.r_[s[k][above:], s[k][:1]] for s in sides]).T for k in (0, 1))
            return np.min([low[:above] for low, _ in sides], axis=0), np.max([high[:above] for _, high in sides], axis=0)

        fill(self.root, 1)
        return self

    @staticmethod
    def _held(node: Node, j: int, rows: np.ndarray, d: np.ndarray, norms, least, most) -> np.ndarray:
        """Of the anchors ``rows``, at distances ``d`` from the node's points, those for which subtree j may hold a score in a window."""
        n = len(node.points)
        if node.low[n, j] > node.high[n, j]:
            return rows[:0]  # an empty subtree
        near = np.maximum(0, np.maximum(node.low[:n, j] - d, d - node.high[:n, j]).max(1))
        far = (d + node.high[:n, j]).min(1)
        square, low, high = norms[rows] ** 2, node.low[n, j] ** 2, node.high[n, j] ** 2
        slack = SLACK * (1 + square + far**2 + high)
        top, bottom = (square + high - near**2) / 2 + slack, (square + low - far**2) / 2 - slack
        low, high = least[rows], most[rows]
        return rows[((top[:, None] >= low) & (bottom[:, None] <= high) & (low <= high)).any(1)]

    def reached(self, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> dict[int, np.ndarray]:
        """For each leaf the anchors for which it may hold a score in one of their windows [least, most] (rows: anchors)."""
        norms, found = np.sqrt((anchors * anchors).sum(1)), {}

        def down(node, rows):
            if not isinstance(node, Node):
                found[node] = rows
            elif len(rows):
                d = _distances(anchors[rows], node.points)
                for j, child in enumerate(node.children):
                    if len(held := self._held(node, j, rows, d, norms, least, most)):
                        down(child, held)

        down(self.root, np.arange(len(anchors)))
        return found

    def reach(self, leaf: int, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The anchors for which one leaf may hold a score in one of their windows."""
        norms, rows = np.sqrt((anchors * anchors).sum(1)), np.arange(len(anchors))
        for node, j in self.path(leaf):
            rows = self._held(node, j, rows, _distances(anchors[rows], node.points), norms, least, most)
        return rows


# --- running best of a batch of anchors -------------------------------------------------


class Best:
    """The first ``k`` (score, then lower id) of each (anchor, window) so far, and the score that a newcomer must reach."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.row, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(count, NONE)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        row, ids, score = (np.concatenate(p) for p in zip((self.row, self.id, self.score), (row, ids, score)))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.id, self.score = row[kept], ids[kept], score[kept]
        last = place == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])


def _windows(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score for positive scores: 50 p <= 100 s <= 95 p."""
    return -((-50 * scores) // 100), (95 * scores) // 100


@dataclass
class Batch:
    """Anchors of one batch: ids, labels, vectors; for the second search their positives' scores (rows of equal length, padded)."""

    key: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    positives: np.ndarray | None = None


class Search:
    """Runs one of the two searches for a batch of anchors over blocks of vectors."""

    def __init__(self, batch: Batch, k: int):
        self.batch, self.k = batch, k
        n = len(batch.key)
        self.real = batch.vector.astype(np.float64)
        if batch.positives is None:
            self.least, self.most = np.full((n, 1), NONE), np.full((n, 1), -NONE)
        else:
            self.least, self.most = _windows(batch.positives)
            none = batch.positives == NONE
            self.least[none], self.most[none] = 1, 0
        self.best = Best(self.least.size, k)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Each window from the score that a newcomer must reach."""
        return np.maximum(self.least, self.best.floor.reshape(self.least.shape)), self.most

    def visit(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Score the anchors ``rows`` against a block and keep what falls into their windows."""
        step = max(1, SCORES_AT_ONCE // max(1, len(ids)))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            scores = products(self.batch.vector[part], vectors)
            same = self.batch.label[part][:, None] == labels[None]
            if self.batch.positives is None:
                fits = same
                for a, v in zip(*np.nonzero(same & (self.batch.id[part][:, None] == ids[None]))):
                    width = max(vectors.shape[1], self.batch.vector.shape[1])
                    fits[a, v] = not np.array_equal(matrix([self.batch.vector[part[a]]], width), matrix([vectors[v]], width))
            else:
                fits = ~same
            least, most = self.bounds()
            for w in range(self.least.shape[1]):
                inside = fits & (scores >= least[part, w][:, None]) & (scores <= most[part, w][:, None])
                if scores.shape[1] > 4 * self.k:  # most rows have far more than k: find the k-th best first
                    shown, at = np.where(inside, scores, NONE), scores.shape[1] - self.k
                    inside &= scores >= np.partition(shown, at, axis=1)[:, at, None]
                a, v = np.nonzero(inside)
                if len(a):
                    self.best.add(part[a] * self.least.shape[1] + w, ids[v], scores[a, v])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor row, window, id, score)."""
        width = self.least.shape[1]
        return self.best.row // width, self.best.row % width, self.best.id, self.best.score


# --- index ------------------------------------------------------------------------------


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    """Without exact repeats (same id, label and vector)."""
    vectors = [np.asarray(v, np.int64).tobytes() for v in rows["vector"]]
    keys = pd.DataFrame({"id": rows["id"].to_numpy(), "label": rows["label"].to_numpy(), "vector": vectors})
    return rows[~keys.duplicated().to_numpy()]


@dataclass
class Index:
    """Blocks of vectors by group and leaf, the tree with its ranges, and sample vectors that give searches a first floor."""

    blocks: DataFrame
    tree: Tree
    groups: dict[int, tuple[int, int]]
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]


def build_index(rows: DataFrame, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, group_rows: int = GROUP_ROWS) -> Index:
    """Index all (id long, label, vector array<long>) rows.

    The tree is fit on about ``sample_rows`` rows chosen by id hash (twice as many at most); every row then goes to its leaf. A leaf with many rows
    (many copies of a vector) is dealt over several groups by id hash, so a group holds ``group_rows`` rows or little more, fewer in a small table."""
    spark = rows.sparkSession
    rows = written(rows.select("id", "label", "vector"), "vectors")
    total = rows.count()
    share = ceil(2**30 * min(1.0, sample_rows / max(1, total)))
    sample = _folded(rows.where(F.pmod(F.xxhash64("id"), F.lit(2**30)) < share).limit(2 * sample_rows).toPandas())
    vectors = matrix(list(sample["vector"]))
    tree = Tree.fit(vectors, ceil(total / leaf_rows), fanout)
    shared = spark.sparkContext.broadcast(tree)

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shared.value
        for batch in batches:
            x = _fitted(matrix(list(batch["vector"])), tree.width).astype(np.float64)
            yield batch.assign(leaf=tree.leaf_of(x))

    dealt = written(rows.mapInPandas(to_leaf, "id long, label long, vector array<long>, leaf int"), "leaves")
    # No core is idle while there are leaves to visit.
    group_rows = min(group_rows, max(leaf_rows, ceil(total / spark.sparkContext.defaultParallelism)))
    # One row per leaf, MAX_LEAVES at most.
    counts = {r["leaf"]: r["n"] for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups, group, held = {}, 0, 0
    for leaf in range(tree.leaves):
        n = counts.get(leaf, 0)
        if n > group_rows or held + n > group_rows:
            group, held = group + bool(held), 0
        salts = max(1, ceil(n / group_rows))
        groups[leaf] = (group, salts)
        group, held = (group + salts, 0) if salts > 1 else (group, held + n)
    table = spark.createDataFrame([(k, g, s) for k, (g, s) in groups.items()], "leaf int, base int, salts int")
    salted = dealt.join(F.broadcast(table), "leaf").withColumn("group", F.col("base") + F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    ordered = salted.select("group", "leaf", "id", "label", "vector").repartition("group", "leaf", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)))
    ordered = ordered.sortWithinPartitions("group", "leaf", "id", "label", "vector")
    kind = "group int, leaf int, n int, width int, ids binary, labels binary, vectors binary, low array<double>, high array<double>"
    blocks = written(ordered.mapInPandas(_blocks(shared, leaf_rows), kind), "blocks")
    sides = blocks.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("at", "side"))
    ranges: dict[int, tuple] = {}
    # A row per leaf and split point on its path: bounded by MAX_LEAVES, the fan-out and the depth.
    ends = sides.groupBy("leaf", "at").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
    for leaf, part in ends.toPandas().sort_values(["leaf", "at"]).groupby("leaf"):
        ranges[int(leaf)] = (part["low"].to_numpy(), part["high"].to_numpy())
    labels = sample["label"].to_numpy(np.int64)
    return Index(blocks, tree.bounded(ranges), groups, (sample["id"].to_numpy(np.int64), labels, vectors))


def _fitted(x: np.ndarray, width: int) -> np.ndarray:
    """As many columns as the tree's points have; further ones are left out of distances to them, which stay metric."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _blocks(shared, leaf_rows: int):
    """Task function: rows in order of (group, leaf, id) to packed blocks of at most ``leaf_rows`` rows, without exact repeats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, before = shared.value, None

        def packed(part: pd.DataFrame) -> dict:
            x = matrix(list(part["vector"]))
            leaf = int(part["leaf"].iloc[0])
            low, high = tree.measured(leaf, _fitted(x, tree.width).astype(np.float64))
            kind = next(k for k in (np.int16, np.int32, np.int64) if np.abs(x).max(initial=0) <= np.iinfo(k).max)
            return {
                "group": int(part["group"].iloc[0]), "leaf": leaf, "n": len(part), "width": x.shape[1],
                "ids": part["id"].to_numpy(np.int64).tobytes(), "labels": part["label"].to_numpy(np.int64).tobytes(),
                "vectors": x.astype(kind).tobytes(), "low": low, "high": high,
            }

        for batch in batches:
            if before is not None:
                batch = pd.concat([before, batch])
            batch = _folded(batch)
            before = batch.iloc[-1:]
            out = []
            for _, part in batch.iloc[:-1].groupby(["group", "leaf"], sort=False):
                out += [packed(part.iloc[s : s + leaf_rows]) for s in range(0, len(part), leaf_rows)]
            if out:
                yield pd.DataFrame(out)
        if before is not None:
            yield pd.DataFrame([packed(before)])

    return run


def _opened(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of a packed block."""
    n, width, flat = int(block["n"]), int(block["width"]), block["vectors"]
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(flat) // max(1, n * width)] if n * width else np.int64
    return np.frombuffer(block["ids"], np.int64), np.frombuffer(block["labels"], np.int64), np.frombuffer(flat, kind).reshape(n, width).astype(np.int64)


# --- searching --------------------------------------------------------------------------


def _as_batch(rows: pd.DataFrame, windows: int) -> Batch:
    """``windows`` is 0 for the first search, else how many positives an anchor has at most."""
    positives = None
    if windows:
        positives = np.full((len(rows), windows), NONE)
        for n, p in enumerate(rows["positives"]):
            positives[n, : len(p)] = p
    key, number, label = (rows[c].to_numpy(np.int64) for c in ("key", "id", "label"))
    return Batch(key, number, label, matrix(list(rows["vector"])), positives)


def _seeded(batch: Batch, k: int, sample) -> np.ndarray:
    """The floor that sample vectors give every window: they are vectors of the table, so the k-th best of all is no worse."""
    search = Search(batch, k)
    search.visit(np.arange(len(batch.key)), *sample)
    return search.best.floor


def _routes(shared, k: int, windows: int):
    """Task function: anchors to one row for each group that may hold what they look for, with their floors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, groups, sample = shared.value
        for some in batches:
            for start in range(0, len(some), ROUTED_AT_ONCE):
                rows = some.iloc[start : start + ROUTED_AT_ONCE]
                batch = _as_batch(rows, windows)
                search = Search(batch, k)
                search.best.floor = _seeded(batch, k, sample)
                by_group: dict[int, list[np.ndarray]] = {}
                for leaf, who in tree.reached(_fitted(search.real, tree.width), *_shifted(search, tree)).items():
                    for group in range(groups[leaf][0], sum(groups[leaf])):
                        by_group.setdefault(group, []).append(who)
                floors = list(search.best.floor.reshape(len(rows), -1))
                for group, parts in by_group.items():
                    who = np.unique(np.concatenate(parts))
                    yield rows.iloc[who].assign(group=group, floor=[floors[a] for a in who])

    return run


def _shifted(search: Search, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """The search's windows as reals, for vectors as wide as the tree's points. If some are wider, nothing can be left out."""
    least, most = search.bounds()
    if search.real.shape[1] > tree.width:
        return np.full(least.shape, -np.inf), np.where(least <= most, np.inf, -np.inf)
    return least.astype(np.float64), most.astype(np.float64)


def _visits(shared, k: int, windows: int):
    """Task function over (group, batch) runs: the batch's anchors first, then the group's blocks as a stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, _, _ = shared.value
        now, waiting, search, leaf, rows = None, [], None, None, None

        def closed() -> Iterator[pd.DataFrame]:
            if search is not None:
                row, window, ids, score = search.found()
                yield pd.DataFrame({"key": search.batch.key[row], "window": window, "found": ids, "score": score})

        for batch in batches:
            for key, some in batch.groupby(["group", "batch"], sort=False):
                if now != key:
                    yield from closed()
                    now, waiting, search, leaf = key, [], None, None
                if (is_anchor := some["n"].isna()).any():
                    waiting.append(some[is_anchor])
                for block in some[~is_anchor].to_dict("records"):
                    if search is None:
                        held = pd.concat(waiting)
                        search, waiting = Search(_as_batch(held, windows), k), []
                        search.best.floor = np.concatenate(list(held["floor"])).astype(np.int64)
                    if leaf != block["leaf"]:
                        # Asked for each leaf: what has been found since narrows the windows.
                        leaf = block["leaf"]
                        rows = tree.reach(int(leaf), _fitted(search.real, tree.width), *_shifted(search, tree))
                    if len(rows):
                        search.visit(rows, *_opened(block))
        yield from closed()

    return run


def search(anchors: DataFrame, index: Index, k: int, windows: int = 0, batch_anchors: int = BATCH_ANCHORS) -> DataFrame:
    """(key, window, found, score, rank): the first ``k`` of every window of every anchor.

    ``anchors``: (key, id, label, vector) for other rows of the same label, with ``positives`` (scores) for rows of
    other labels within each positive's window (``windows``: how many positives at most; 0 for the first kind)."""
    spark = anchors.sparkSession
    shared = spark.sparkContext.broadcast((index.tree, index.groups, index.sample))
    named = anchors if windows else anchors.withColumn("positives", F.lit(None).cast("array<long>"))
    kind = "key long, id long, label long, vector array<long>, positives array<long>"
    routed = written(named.select("key", "id", "label", "vector", "positives").mapInPandas(_routes(shared, k, windows), f"{kind}, group int, floor array<long>"), "routes")
    per_group = small_side(
        routed.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / batch_anchors).cast("int").alias("parts")), rows=100_000
    )
    parted = routed.join(per_group, "group").withColumn("batch", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
    copies = index.blocks.drop("low", "high").join(per_group, "group")
    copied = copies.withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = parted.unionByName(copied, allowMissingColumns=True)
    order = ["group", "batch", F.col("n").isNotNull(), "leaf", "key"]
    columns = ["group", "batch", "key", "id", "label", "vector", "positives", "floor", "leaf", "n", "width", "ids", "labels", "vectors"]
    met = both.repartition("group", "batch").sortWithinPartitions(*order).select(*columns)
    found = met.mapInPandas(_visits(shared, k, windows), "key long, window int, found long, score long")
    first = W.partitionBy("key", "window").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, batch_anchors: int = BATCH_ANCHORS, **shape
) -> DataFrame:
    """For every anchor and each of its positives the best negatives that are neither too hard nor too easy.

    ``rows`` and ``anchors``: (id long, label long, vector array<long>), anchors being rows too. Positives are the first
    ``n_positives`` other rows of the label by inner product; negatives the first ``n_negatives`` rows of other labels
    with half to 95 % of the positive's score. Higher scores come first, then lower ids.

    Rows with a null in any column take no part; exact repeats of a row count once, rows that share an id only are different rows;
    vectors of unequal length are compared as if filled up with zeros; scores beyond 64 bits wrap; an empty table
    gives no rows; further columns are ignored. ``shape`` goes to ``build_index``."""
    whole = [f"{c} is not null" for c in ("id", "label", "vector")]

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector").where(" and ".join(whole))

    index = build_index(clean(rows), **shape)
    asked = written(clean(anchors).distinct().withColumn("key", F.monotonically_increasing_id()), "anchors")
    positives = written(search(asked, index, n_positives, 0, batch_anchors), "positives")
    listed = F.array_sort(F.collect_list(F.struct("rank", "found", "score")))
    folded = positives.groupBy("key").agg(listed.alias("p"))
    second = written(asked.join(folded, "key").select("key", "id", "label", "vector", F.col("p.score").alias("positives"), "p"), "windows")
    negatives = search(second.drop("p"), index, n_negatives, n_positives, batch_anchors)
    negatives = negatives.join(second.select("key", F.col("id").alias("anchor_id"), "p"), "key")
    positive = F.get("p", F.col("window"))
    return negatives.select(
        "anchor_id",
        positive["found"].alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("found").alias("negative_id"),
        positive["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
