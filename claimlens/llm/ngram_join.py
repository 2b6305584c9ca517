"""Exact Jaccard self-join of n-gram sets through prefix trees, and the groups that its links form.

1. Every document becomes a set of hashed word n-grams. Counting them over all documents leaves only
   the n-grams that several documents share, each with its frequency; the rest of a set is a number.
2. The global order is by frequency, rare first. Two sets that link share an n-gram among the first
   ``n - least overlap + 1`` of each; most documents share none of theirs and are done.
3. Documents that share such an n-gram, directly or through others, form a candidate group. A group is
   dealt in blocks; a block's sets are stored in a prefix tree, and each document walks the tree of its
   own block and of the blocks it has to meet, carrying the overlap along shared paths and
   leaving a subtree whose bound is too low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import Words, connected, mixed, runs
from claimlens.session import spread, written

# An n-gram in this many documents of one chunk may be a heavy one.
CHUNK_HEAVY = 64
# n-grams held before a chunk is dealt out; bounds the memory of a task.
CHUNK_GRAMS = 1_000_000
# A heavy n-gram is counted in at least one in this many documents, so the list has at most this times the mean set size.
HEAVY_ONE_IN = 200
# Documents in a block of a large candidate group, and documents of its first block that every block meets.
BLOCK = 300
PIVOTS = 16
# Heavy n-grams come last in the global order.
LAST = np.int64(1) << np.int64(62)

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Texts to sorted arrays of distinct 64-bit n-gram hashes."""

    def __init__(self, n: int):
        self.n, self.words = n, Words()

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.words.lowered(text)
        if not len(h):
            return h
        wide = min(self.n, len(h))
        # A short text is one n-gram of its own length, kept apart from n-grams of full length.
        grams = np.full(len(h) - wide + 1, wide, np.uint64)
        for k in range(wide):
            grams = mixed(grams * _STEP + h[k : len(h) - wide + 1 + k])
        return np.unique(grams)


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Smallest i with 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def _chunks(grams: Grams, batches: Iterator[pd.DataFrame]):
    """Documents' (ids, sizes, fingerprints, grams) in pieces of bounded size; of equal sets in a piece the lowest id has grams."""
    ids, sets, fingerprints, held = [], [], [], 0
    for batch in batches:
        for doc, text in zip(batch["doc_id"].tolist(), batch["text"]):
            found = grams(text)
            ids.append(int(doc))
            sets.append(found)
            fingerprints.append(int(mixed(np.bitwise_xor.reduce(mixed(found + _STEP), keepdims=True) + np.uint64(len(found)))[0]) if len(found) else 0)
            held += len(found) + 1
            if held >= CHUNK_GRAMS:
                yield ids, sets, fingerprints
                ids, sets, fingerprints, held = [], [], [], 0
    if ids:
        yield ids, sets, fingerprints


def _lowest_of_copies(ids: list, sets: list, fingerprints: list) -> list[int]:
    lowest: dict = {}
    for i, key in enumerate(zip(fingerprints, map(len, sets))):
        if key[1] and (key not in lowest or ids[i] < ids[lowest[key]]):
            lowest[key] = i
    return sorted(lowest.values())


def _seen(n: int):
    """Per document (doc_id, n, fingerprint); per n-gram that is frequent in a chunk (gram, found)."""

    def run(batches):
        grams = Grams(n)
        for ids, sets, fingerprints in _chunks(grams, batches):
            documents = pd.DataFrame({"doc_id": ids, "n": [len(s) for s in sets], "fingerprint": np.array(fingerprints, np.uint64).view(np.int64)})
            kept = _lowest_of_copies(ids, sets, fingerprints)
            gram, found = np.unique(np.concatenate([sets[i] for i in kept] or [np.empty(0, np.uint64)]), return_counts=True)
            often = found >= CHUNK_HEAVY
            heavy = pd.DataFrame({"gram": gram[often].view(np.int64), "found": found[often]})
            for part in (documents, heavy):
                if len(part):
                    yield part.reindex(columns=["doc_id", "n", "fingerprint", "gram", "found"]).astype("Int64")

    return run


def _dealt(n: int, ranges: int, heavy):
    """n-grams of documents, packed by hash range; heavy ones in pieces of their own beyond the ranges."""

    def run(batches):
        grams = Grams(n)
        piece = 0
        for ids, sets, fingerprints in _chunks(grams, batches):
            kept = _lowest_of_copies(ids, sets, fingerprints)
            if not kept:
                continue
            gram = np.concatenate([sets[i] for i in kept])
            doc = np.repeat(np.array(ids, np.int64)[kept], [len(sets[i]) for i in kept])
            at = ((gram >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)
            if len(heavy.value):
                at[np.isin(gram, heavy.value)] = ranges + (ids[0] + piece) % ranges
            piece += 1
            order = np.argsort(at, kind="stable")
            at, gram, doc = at[order], gram[order], doc[order]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            ends = np.r_[starts[1:], len(at)]
            yield pd.DataFrame(
                {
                    "at": at[starts],
                    "grams": [gram[s:e].tobytes() for s, e in zip(starts, ends)],
                    "docs": [doc[s:e].tobytes() for s, e in zip(starts, ends)],
                }
            )

    return run


def _shared(ranges: int):
    """Of a range's n-grams those in several documents, with their frequency."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        gram = np.frombuffer(b"".join(group["grams"]), np.uint64)
        doc = np.frombuffer(b"".join(group["docs"]), np.int64)
        if key[0] >= ranges:
            often = np.full(len(gram), LAST)
        else:
            order = np.argsort(gram, kind="stable")
            gram, doc = gram[order], doc[order]
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            often = np.diff(np.r_[first, len(gram)])
            often = np.repeat(often, often)
        kept = often > 1
        return pd.DataFrame({"doc_id": doc[kept], "often": often[kept].astype(np.int64), "gram": gram[kept].view(np.int64)})

    return run


class Tree:
    """Prefix tree of sorted sets: nodes hold a run of n-grams, leaves are documents in sorted order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        """``sets`` are arrays of positions in the global order, ascending, and come in lexicographic order."""
        self.sizes, self.nodes = sizes, []
        depth = [0] + [_common(a, b) for a, b in zip(sets, sets[1:])] + [0]
        self.roots = self._grow(sets, depth, 0, len(sets), 0)

    def _grow(self, sets, depth, low, high, start):
        """Nodes over the leaves low..high-1 whose first ``start`` n-grams are spent; a stack in place of recursion."""
        top: list = []
        work = [(low, high, start, top)]
        while work:
            low, high, start, into = work.pop()
            cuts = [low] + [i for i in range(low + 1, high) if depth[i] <= start] + [high]
            for a, b in zip(cuts, cuts[1:]):
                end = len(sets[a]) if b - a == 1 else min(depth[a + 1 : b])
                below: list = []
                longest = max(len(sets[i]) for i in range(a, b))
                into.append((a, b, sets[a][start:end], longest - end, int(self.sizes[a:b].min()), below))
                if b - a > 1:
                    work.append((a, b, end, below))
        return top

    def links(self, mine: np.ndarray, size: int, percent: int, mark: np.ndarray, skip) -> list[int]:
        """Leaves whose set links with ``mine``. ``mark`` is 1 at the n-grams of ``mine``; ``skip(a, b)`` says
        that leaves a..b-1 need no look."""
        found, work = [], [(node, 0) for node in self.roots]
        while work:
            (a, b, run, left, smallest, below), overlap = work.pop()
            if skip(a, b):
                continue
            need = least_overlap(smallest, size, percent)
            if len(run):
                overlap += int(mark[run].sum())
                if overlap + min(left, len(mine) - int(np.searchsorted(mine, run[-1], "right"))) < need:
                    continue
            if b - a == 1:
                if overlap >= need:
                    found.append(a)
            else:
                work.extend((node, overlap) for node in below)
        return found


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _walk(percent: int, keys: list[str]):
    """Links between the documents of one dealt piece, as edges of a forest: copies of a group's links are
    left out once two documents are connected, as they cannot change the groups."""

    def walked(group: pd.DataFrame) -> pd.DataFrame:
        often = [np.frombuffer(x, np.int64) for x in group["often"]]
        gram = [np.frombuffer(x, np.int64) for x in group["grams"]]
        lengths = [len(x) for x in gram]
        often, gram = np.concatenate(often), np.concatenate(gram)
        order = np.lexsort((gram, often))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(np.r_[False, gram[order][1:] != gram[order][:-1]])
        sets = np.split(place, np.cumsum(lengths)[:-1])
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        sets = [sets[i] for i in order]
        docs, sizes, sides = (group[c].to_numpy()[order] for c in ("doc_id", "n", "side"))
        tree = Tree(sets, sizes)
        mark = np.zeros(int(place.max()) + 1, np.int8)
        within = bool((sides == sides[0]).all())
        known = group["known"].to_numpy()[order].copy()
        part = np.unique(known, return_inverse=True)[1].reshape(-1)
        edges = []
        for q in range(1, len(sets)):
            mark[sets[q]] = 1
            # Earlier leaves only; none that is connected already, and of two blocks only the other block's.
            def skip(a, b, q=q):
                if a >= q:
                    return True
                b = min(b, q)
                same = part[a:b] == part[q]
                return bool((same if within else same | (sides[a:b] == sides[q])).all())

            for leaf in tree.links(sets[q], int(sizes[q]), percent, mark, skip):
                if part[leaf] != part[q] and (within or sides[leaf] != sides[q]):
                    part[part == part[leaf]] = part[q]
                    edges.append((int(docs[q]), int(docs[leaf])))
            mark[sets[q]] = 0
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, keys):
            if len(group) > 1:
                yield walked(group)

    return run


SET = "doc_id long, n long, often binary, grams binary"


def _ordered(percent: int):
    """A document's shared n-grams in the global order, and how many of the first have to be tried."""

    def run(batches):
        for batch in batches:
            often, grams, tried = [], [], []
            for n, pairs in zip(batch["n"], batch["pairs"]):
                o = np.fromiter((p["often"] for p in pairs), np.int64, len(pairs))
                g = np.fromiter((p["gram"] for p in pairs), np.int64, len(pairs))
                order = np.lexsort((g, o))
                order = order[np.r_[True, g[order][1:] != g[order][:-1]]]  # rows that repeat an id
                first = n - -(-percent * n // 100) + 1 - (n - len(order))
                often.append(o[order].tobytes())
                grams.append(g[order].tobytes())
                tried.append(g[order][: max(0, first)].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": batch["n"], "often": often, "grams": grams, "tried": tried})

    return run


def _pieces(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Each set with its candidate group and its block there; groups without a partner are not there."""
    named = groups.select(F.col("id").alias("doc_id"), F.col("component").alias("candidate"))
    placed = sets.join(named, "doc_id")
    sizes = named.groupBy("candidate").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    return placed.join(sizes, "candidate").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))


def links(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, edges): per document with an id (doc_id, n_shingles, representative) and links between
    representatives whose connected components are those of the full join.

    A representative is the lowest id among equal sets. Every pair of representatives that reach
    ``percent`` is connected through the edges; links inside a group that is connected already are not listed."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    wide = spread(source)
    spark = docs.sparkSession
    seen = written(
        wide.mapInPandas(_seen(n), "doc_id long, n long, fingerprint long, gram long, found long"), "sizes"
    )
    one = seen.where("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n"), F.max_by("fingerprint", "n").alias("fingerprint"))
    lowest = one.where("n > 0").groupBy("fingerprint", "n").agg(F.min("doc_id").alias("representative"))
    members = written(
        one.join(lowest.withColumnRenamed("n", "size"), (F.col("n") == F.col("size")) & one["fingerprint"].eqNullSafe(lowest["fingerprint"]), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("representative", "doc_id").alias("representative")),
        "members",
    )
    total = members.where("n_shingles > 0").count()
    # At most HEAVY_ONE_IN times the mean set size: bounded whatever the number of documents.
    frequent = (
        seen.where("gram is not null").groupBy("gram").agg(F.sum("found").alias("found"))
        .where(F.col("found") >= max(4 * CHUNK_HEAVY, total // HEAVY_ONE_IN)).select("gram").collect()
    )
    heavy = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in frequent], np.int64).view(np.uint64)))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * wide.rdd.getNumPartitions())
    shared = (
        wide.mapInPandas(_dealt(n, ranges, heavy), "at long, grams binary, docs binary")
        .groupBy("at")
        .applyInPandas(_shared(ranges), "doc_id long, often long, gram long")
    )
    alone = members.where("doc_id = representative and n_shingles > 0").select("doc_id", F.col("n_shingles").alias("n"))
    sets = written(
        shared.groupBy("doc_id").agg(F.collect_list(F.struct("often", "gram")).alias("pairs"))
        .join(alone, "doc_id")
        .where(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("pairs")) > 0)
        .select("doc_id", "n", "pairs")
        .mapInPandas(_ordered(percent), SET + ", tried array<long>"),
        "sets",
    )
    tried = written(sets.select("doc_id", F.explode("tried").alias("gram")), "tried")
    first = tried.groupBy("gram").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    groups = written(connected(tried.join(first, "gram").select(F.col("doc_id").alias("a"), "b")), "candidates")
    placed = written(_pieces(sets.drop("tried"), groups), "blocks")

    def walked(dealt: DataFrame, *keys: str) -> DataFrame:
        return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_walk(percent, list(keys)), "a long, b long")

    # Every block by itself, and with it the first few documents of the group, through which blocks connect.
    pivots = placed.where("blocks > 1").join(
        placed.where("blocks > 1").groupBy("candidate").agg(F.slice(F.sort_array(F.collect_set(F.when(F.col("block") == 0, F.col("doc_id")))), 1, PIVOTS).alias("pivots")),
        "candidate",
    ).where(F.array_contains("pivots", F.col("doc_id")))
    copies = pivots.withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)))
    inner = placed.unionByName(copies.select(placed.columns)).withColumns({"side": F.lit(0).cast("long"), "known": F.col("doc_id")})
    edges = written(walked(inner, "candidate", "block"), "edges")
    if not placed.where("blocks > 1").limit(1).count():
        return members, edges
    # Blocks of one group against each other, unless all of both are connected by now.
    now = connected(edges).withColumnRenamed("id", "doc_id").withColumnRenamed("component", "known")
    large = written(
        placed.where("blocks > 1").join(now, "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id")), "large"
    )
    parts = large.groupBy("candidate", "block").agg(F.min("known").alias("low"), F.max("known").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    other = parts.select("candidate", *[F.col(c).alias(f"{c}_") for c in ("block", "low", "high", "least", "most")])
    meets = (
        parts.join(other, "candidate")
        .where("block < block_ and (least(low, low_) <> greatest(high, high_))")
        .where(f"most * 100 >= least_ * {percent} and most_ * 100 >= least * {percent}")
        .select("candidate", F.col("block").alias("p"), F.col("block_").alias("q"))
    )
    sides = meets.select("candidate", "p", "q", F.explode(F.array("p", "q")).alias("block"))
    crossed = large.join(sides, ["candidate", "block"]).withColumn("side", F.col("block"))
    return members, edges.union(walked(crossed, "candidate", "p", "q"))


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document (doc_id, n_shingles, component_id): documents link where the Jaccard similarity of their
    word n-gram sets reaches ``percent`` / 100; component_id is the lowest id reachable by links.

    Words are lower-cased (A-Z); a text shorter than ``n`` words is one n-gram of all its words; a
    missing, empty or blank text has none and links with nothing. Equal sets link. A row without id
    has no place in the result; rows that repeat an id give one row, for the largest set.
    An empty table gives no rows; further columns are ignored."""
    members, edges = links(docs, n, percent, doc_id, text)
    groups = connected(edges).select(F.col("id").alias("representative"), "component")
    return members.join(groups, "representative", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "representative").alias("component_id")
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies of a lower id: one row of each group, whole and unchanged.

    Rows without an id, and rows without words, are kept; of rows that repeat an id all are."""
    groups = ngram_components(docs, n, percent, doc_id, text)
    later = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("later"))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.struct("*").alias("row"))
    return rows.join(written(later, "later"), F.col("id") == F.col("later"), "left_anti").select("row.*")
