"""Top-k vector search, ids, re-ranking.

No vector is paired with another as a row. While the queries fit a checked bound they go to
the tasks, and the index is scanned once where it lies. Beyond that queries and vectors are dealt over a
grid of cells: a cell's task holds its part of the queries and reads its part of the vectors as a stream, keeping
a running k best, so copies are bounded by the number of parts. Where the vectors lie in clusters, packed blocks that can
matter to each other meet in an equi-join instead. Hashed search uses the grid's cells per bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from math import ceil, isqrt, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.text import tokens
from claimlens.session import BROADCAST_ROWS, small_side, written

# Scores that agree to this many places are ties, whatever the order of summation was.
SCORE_PLACES = 9
SLACK = 1e-6
BLOCK_ROWS = 1024
UNPRUNED_ROWS = 65_536
MAX_CELLS = 4096
# Cells are worth visiting apart while a typical query reaches at most this share of the rows, and a block of queries
# moves to at most so many blocks of vectors (the grid moves a block once per part of the other side).
WORTHWHILE_SHARE = 0.25
MOST_VISITS = 16
# Queries that may be sent to every task: by number, and by size of their matrix.
SCAN_QUERIES = 16_384
SCAN_BYTES = 64 * 1024 * 1024
SCORES_AT_ONCE = 4_000_000
# The same where queries have floors: what is looked at stays near the core.
REACHING_AT_ONCE = 1_000_000
# Queries whose products a task takes at once.
QUERY_BLOCK = 1_024
# Columns of scores that are looked at together.
RUN = 64
# A grid cell: bytes of query vectors that its task holds, vectors that it reads.
GRID_BYTES = 32 * 1024 * 1024
GRID_VECTORS = 262_144
# Hashed search: vectors that a bucket should hold.
ROWS_PER_BUCKET = 1_024
# An index above this size is first tried on a few of its vectors, to give each query a floor.
SEED_FROM = 1_000_000
SEED_ROWS = 16_384
# Terms that are written as their place in a list, which every task holds.
FREQUENT = 1 << 20


# --- inside tasks -----------------------------------------------------------------------


def as_matrix(flat: np.ndarray, rows: int) -> np.ndarray:
    return np.asarray(flat, dtype="float64").reshape(rows, -1)


def list_matrix(lists: pa.ListArray) -> np.ndarray:
    """A list column without nulls as a matrix; vectors of unequal length are an error, never mixed."""
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of unequal length: {sizes.min()} to {sizes.max()}")
    return as_matrix(lists.flatten().to_numpy(zero_copy_only=False), len(lists))


def best_pairs(queries: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query row, vector row, score) of the ``k`` best per query; ties keep the lower vector row.

    With a ``floor`` per query, scores below it are out and nothing need be partitioned."""
    scores = queries @ vectors.T
    if floor is not None:
        rows, columns = np.nonzero(scores >= (floor - 10.0**-SCORE_PLACES * 2)[:, None])
    elif scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        keep = scores >= (kth - 10.0**-SCORE_PLACES * 2)[:, None]
        rows, columns = np.nonzero(keep)
    else:
        rows, columns = (a.ravel() for a in np.indices(scores.shape))
    if len(rows) > 4 * k * len(queries) and scores.shape[1] > k:
        # Copies: of the scores equal to the k-th best, the first k columns are enough.
        scores = np.round(scores, SCORE_PLACES)
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        equal = scores == kth
        rows, columns = np.nonzero((scores > kth) | (equal & (np.cumsum(equal, axis=1) <= k)))
    values = np.round(scores[rows, columns], SCORE_PLACES)
    order = np.lexsort((columns, -values, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    chosen = place < k
    return rows[chosen], columns[chosen], values[chosen]


def block_scorer(k: int):
    """Column function: (query block, vector block) -> their k best pairs per query, as arrays."""

    @F.pandas_udf("q array<int>, v array<int>, s array<double>")
    def score(q_rows: pd.Series, q_flat: pd.Series, v_rows: pd.Series, v_flat: pd.Series) -> pd.DataFrame:
        found = [
            best_pairs(as_matrix(fq, nq), as_matrix(fv, nv), k) for nq, fq, nv, fv in zip(q_rows, q_flat, v_rows, v_flat)
        ]
        return pd.DataFrame(
            {
                "q": pd.Series([f[0].astype("int32") for f in found], dtype=object),
                "v": pd.Series([f[1].astype("int32") for f in found], dtype=object),
                "s": pd.Series([f[2] for f in found], dtype=object),
            }
        )

    return score.asNondeterministic()  # keeps the planner from running it once per field


def arrow_matrix(rows: pa.Table, column: str) -> np.ndarray | None:
    """A list column as a matrix; None without rows."""
    return list_matrix(rows.column(column).combine_chunks()) if rows.num_rows else None


def lowest_first(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int):
    """The ``k`` best (score, then lower id) candidates of each query row."""
    order = np.lexsort((ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1], -values, rows))
    rows, ids, values = rows[order], ids[order], values[order]
    chosen = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[chosen], ids[chosen], values[chosen]


class BlockBest:
    """The ``k`` best vectors of one block of queries. What cannot reach its query's floor is not kept."""

    def __init__(self, queries: np.ndarray, k: int, seed: np.ndarray | None):
        self.queries, self.k, self.seed, self.floor, self.kept = queries, k, seed, seed, None
        self.single, self.lengths = queries.astype("float32"), np.sqrt((queries**2).sum(1))
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, single: np.ndarray | None, longest: float, room: np.ndarray) -> None:
        """``single`` are the vectors in single precision, filled up to whole runs; None where that does not hold them.
        ``longest`` is the greatest length of a vector, ``room`` takes the products."""
        if single is None or self.floor is None or np.isneginf(self.floor).any():
            found = best_pairs(self.queries, vectors, self.k, self.floor)
        else:
            found = self._reaching(vectors, single, longest, room)
        if not len(found[0]):
            return
        self.waiting.append((found[0], ids[found[1]], found[2]))
        self.held += len(found[0])
        # Merged once as many wait as may be kept; until then the floors are only lower than they could be.
        if self.kept is None or self.held >= self.k * len(self.queries):
            self.merge()

    def _reaching(self, vectors: np.ndarray, single: np.ndarray, longest: float, room: np.ndarray):
        """``best_pairs`` with a floor: products in single precision, taken again in double where they may reach it.

        They differ by less than (d + 4) * 2^-23 * |q| * |x|."""
        scores = np.matmul(self.single, single.T, out=room[: len(self.single) * len(single)].reshape(len(self.single), -1))
        error = (vectors.shape[1] + 4) * 2.0**-23 * self.lengths * longest
        low = self.floor - 10.0**-SCORE_PLACES * 2
        bound = np.nextafter((low - error).astype("float32"), np.float32(-np.inf))
        # Queries first, then runs of columns: few hold anything.
        there = np.flatnonzero(scores.max(axis=1) >= bound)
        if not len(there):
            return there, there, np.empty(0)
        runs = scores.reshape(len(scores), -1, RUN)
        if 4 * len(there) > 3 * len(scores):
            there, highest = np.arange(len(scores)), runs.max(axis=2)
        else:
            highest = runs[there].max(axis=2)
        rows, run = np.nonzero(highest >= bound[there, None])
        rows = there[rows]
        if len(rows) > 4 * self.k * len(scores):
            return best_pairs(self.queries, vectors, self.k, self.floor)
        at, column = np.nonzero(runs[rows, run] >= bound[rows, None])
        rows, columns = rows[at], run[at] * RUN + column
        if len(rows) > 4 * self.k * len(scores):
            return best_pairs(self.queries, vectors, self.k, self.floor)
        real = columns < len(vectors)
        rows, columns = rows[real], columns[real]
        values = np.einsum("ij,ij->i", self.queries[rows], vectors[columns])
        there = values >= low[rows]
        return rows[there], columns[there], np.round(values[there], SCORE_PLACES)

    def merge(self) -> None:
        """Take in what waits."""
        if self.waiting:
            parts = self.waiting if self.kept is None else [self.kept, *self.waiting]
            self.kept = lowest_first(*(np.concatenate(p) for p in zip(*parts)), self.k)
            self.waiting, self.held = [], 0
            # A query that has k hits takes the last one's score as its floor.
            floor = np.full(len(self.queries), -np.inf) if self.seed is None else self.seed.copy()
            full = np.bincount(self.kept[0], minlength=len(self.queries)) == self.k
            floor[full] = self.kept[2][np.searchsorted(self.kept[0], np.flatnonzero(full)) + self.k - 1]
            self.floor = floor


class RunningBest:
    """The ``k`` best vectors of each query over batches of vectors, block by block of queries."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        starts = range(0, len(queries), QUERY_BLOCK)
        self.blocks = [BlockBest(queries[i : i + QUERY_BLOCK], k, None if floor is None else floor[i : i + QUERY_BLOCK]) for i in starts]
        self.step, self.seen, self.least = max(RUN, REACHING_AT_ONCE // max(1, min(QUERY_BLOCK, len(queries)))), 0, max(64, 4 * k)
        self.plain = not _in_single(queries)
        self.room = np.empty(0, "float32")

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by_id, start = np.argsort(ids, kind="stable"), 0
        plain = self.plain or not _in_single(vectors)
        while start < len(by_id):
            # As many as were seen already: then about k of them reach a query's floor.
            part = by_id[start : start + min(self.step, max(self.least, self.seen))]
            x, single, longest = vectors[part], None, 0.0
            if not plain:
                single, longest = np.zeros((len(x) + -len(x) % RUN, x.shape[1]), "float32"), np.sqrt(np.einsum("ij,ij->i", x, x).max())
                single[: len(x)] = x
                products = len(single) * max((len(b.queries) for b in self.blocks), default=0)
                self.room = self.room if len(self.room) >= products else np.empty(products, "float32")
            for block in self.blocks:
                block.add(ids[part], x, single, longest, self.room)
            start += len(part)
            self.seen += len(part)

    def merge(self) -> bool:
        """Take in what waits; whether there is anything."""
        for block in self.blocks:
            block.merge()
        return any(b.kept is not None for b in self.blocks)

    def batch(self, query_ids: pa.Array, kind: pa.DataType) -> pa.RecordBatch:
        """(query_id, claim_id, score) of what is kept."""
        kept = [(b.kept[0] + n * QUERY_BLOCK, *b.kept[1:]) for n, b in enumerate(self.blocks) if b.kept is not None]
        rows, ids, values = (np.concatenate(p) for p in zip(*kept))
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(rows)), pa.array(ids, kind), pa.array(values)], names=["query_id", "claim_id", "score"])


def _in_single(x: np.ndarray) -> bool:
    """Whether products of these numbers neither overflow nor are undefined in single precision."""
    return bool((np.abs(x) < 1e15).all())


def scan_scorer(shared, k: int):
    """Task function over vector batches: keeps a running k best per query, emits it at the end.

    ``shared`` is the broadcast (query ids as an Arrow array, query matrix, floor per query or None)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, seed = shared.value
        if queries is None:
            return
        best, kind = RunningBest(queries, k, seed), None
        for batch in batches:
            if batch.num_rows:
                kind = batch.schema.field(0).type
                best.add(batch.column(0).to_numpy(zero_copy_only=False), list_matrix(batch.column(1)))
        if best.merge():
            yield best.batch(query_ids, kind)

    return scan


def cell_scorer(k: int):
    """Task function over (cell, kind, query_id, claim_id, vector) rows, of each cell the queries (kind 0) first.

    Holds one cell's queries; its vectors pass as a stream."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, best, ids = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for start, stop in zip(np.r_[0, edges].tolist(), np.r_[edges, len(cells)].tolist()):
                part = batch.slice(start, stop - start)
                if cells[start] != now:
                    if best is not None and best.merge():
                        yield best.batch(ids, part.schema.field(3).type)
                    now, waiting, best = cells[start], [], None
                if kinds[start] == 0:
                    waiting.append(part)
                    continue
                if best is None and waiting:
                    asked = pa.Table.from_batches(waiting).combine_chunks()
                    ids, best, waiting = asked.column("query_id").combine_chunks(), RunningBest(arrow_matrix(asked, "vector"), k), []
                if best is not None:
                    best.add(part.column(3).to_numpy(zero_copy_only=False), list_matrix(part.column(4)))
        if best is not None and best.merge():
            yield best.batch(ids, batch.schema.field(3).type)

    return score


# --- blocks -----------------------------------------------------------------------------


def vector_length(df: DataFrame, vector: str) -> int:
    first = df.select(F.size(vector).alias("d")).limit(1).first()
    return first["d"] if first else 0


def block_size(rows: int, cores: int) -> int:
    """Rows per block: small enough to keep the cores busy, never above the bound."""
    return max(64, min(BLOCK_ROWS, ceil(rows / cores)))


def cell_counts_of(df: DataFrame, most: int) -> DataFrame:
    """(cell, n) as a literal table. There are at most ``most`` cells by construction, so the
    counts may pass through the driver and may be broadcast."""
    rows = df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(rows) <= most <= BROADCAST_ROWS
    return F.broadcast(df.sparkSession.createDataFrame([(r["cell"], r["n"]) for r in rows], "cell int, n long"))


def salted(df: DataFrame, cell_counts: DataFrame | int, key: str, rows: int, out: str) -> DataFrame:
    """Add ``out`` so that each (cell, out) group holds about ``rows`` rows.

    ``cell_counts`` comes from ``cell_counts_of``; a plain number means a single cell."""
    hashed = F.xxhash64(key)
    if isinstance(cell_counts, int):
        return df.withColumn(out, F.pmod(hashed, F.lit(max(1, ceil(cell_counts / rows)))).cast("int"))
    counted = df.join(cell_counts, "cell", "inner")
    return counted.withColumn(out, F.pmod(hashed, F.ceil(F.col("n") / rows)).cast("int")).drop("n")


def packed(df: DataFrame, group: Sequence[str], key: str, vector: str, prefix: str) -> DataFrame:
    """One row per group: ids in ascending order and their vectors end to end."""
    members = F.array_sort(F.collect_list(F.struct(F.col(key).alias("i"), F.col(vector).alias("v"))))
    return (
        df.groupBy(*group)
        .agg(members.alias("_m"))
        .select(
            *group,
            F.transform("_m", lambda m: m["i"]).alias(f"{prefix}_ids"),
            F.flatten(F.transform("_m", lambda m: m["v"])).alias(f"{prefix}_flat"),
        )
    )


def without_spare_copies(df: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """Of equal vectors only the ``keep`` lowest ids: no result can hold more of them.

    Map tasks trim before the shuffle, so a vector copied a billion times moves a few rows."""
    same = W.partitionBy(F.xxhash64(vector), vector).orderBy(key)
    return df.withColumn("_copy", F.row_number().over(same)).filter(F.col("_copy") <= keep).drop("_copy")


def best_hits(pairs: DataFrame, k: int, keep: int, exclude_self: bool, fold: bool = False) -> DataFrame:
    """Score joined blocks and keep the k best per query over all blocks."""
    scored = pairs.withColumn(
        "_best", block_scorer(keep)(F.size("q_ids"), F.col("q_flat"), F.size("v_ids"), F.col("v_flat"))
    )
    # Positions become ids before the rows fan out, so the blocks are not copied per pair.
    named = F.transform(
        F.arrays_zip("_best.q", "_best.v", "_best.s"),
        lambda b: F.struct(
            F.get("q_ids", b["q"]).alias("query_id"),
            F.get("v_ids", b["v"]).alias("claim_id"),
            b["s"].alias("score"),
        ),
    )
    rows = scored.select(F.explode(named).alias("h")).select("h.*")
    return ranked_hits(rows, k, exclude_self, fold)


def ranked_hits(rows: DataFrame, k: int, exclude_self: bool, fold: bool = False) -> DataFrame:
    """The k best of scored (query_id, claim_id, score) rows; tasks trim to k before the shuffle."""
    if exclude_self:
        rows = rows.filter(F.col("query_id") != F.col("claim_id"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "claim_id")
    if not fold:
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # A pair met in several bands has one dense rank; its repeats lie in the same partition.
    ranked = rows.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return ranked.dropDuplicates(["query_id", "claim_id"])


def _sides(queries, vectors, query_id, query_vector, vector_id, vector):
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q_vec"))
    v = vectors.select(F.col(vector_id).alias("claim_id"), F.col(vector).alias("v_vec"))
    return q.filter(F.col("q_vec").isNotNull()), v.filter(F.col("v_vec").isNotNull())


# --- exact search -----------------------------------------------------------------------


def topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    *,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    vector_id: str = "claim_id",
    vector: str = "embedding",
    exclude_self: bool = True,
    scan_queries: int = SCAN_QUERIES,
    unpruned_rows: int = UNPRUNED_ROWS,
) -> DataFrame:
    """Exact k best vectors per query by dot product: (query_id, claim_id, score, rank).

    Ids must be unique on each side. Score descending, ties by id. The sizes choose the plan:

    * up to ``scan_queries`` queries: each task scans its vectors against all queries, so the
      index is read once and never shuffled;
    * else, above ``unpruned_rows`` vectors, they fall into cells around pivots, each query takes a first
      bound from one block of its own cell, and only cells whose best possible score reaches that
      bound are visited, if an estimate says that this pays;
    * else a grid of query parts and vector parts: every part is copied once per part of the other side."""
    q, v = _sides(queries, vectors, query_id, query_vector, vector_id, vector)
    cores = q.sparkSession.sparkContext.defaultParallelism
    keep = k + 1 if exclude_self else k
    q_count, v_count = queries.count(), vectors.count()
    if q_count <= scan_queries and q_count * vector_length(q, "q_vec") * 8 <= SCAN_BYTES:
        return ranked_hits(_scanned(q, v, v_count, keep), k, exclude_self)
    v = without_spare_copies(v, "claim_id", "v_vec", keep)
    if v_count > unpruned_rows:
        pairs = _reachable_pairs(q, v, q_count, v_count, keep, cores)
        if pairs is not None:
            return best_hits(pairs, k, keep, exclude_self)
    return ranked_hits(_gridded(q, v, q_count, v_count, keep, cores), k, exclude_self)


def _of_cells(queries: DataFrame, vectors: DataFrame, keep: int, parts: int | None) -> DataFrame:
    """(query_id, claim_id, score) from (cell, query_id, q_vec) and (cell, claim_id, v_vec): the ``keep`` best per query and cell.

    With ``parts`` the cell is the number of its partition; else cells are dealt by hash."""
    q = queries.select("cell", F.lit(0).alias("kind"), "query_id", F.lit(None).cast(vectors.schema["claim_id"].dataType).alias("claim_id"), F.col("q_vec").alias("vector"))
    v = vectors.select("cell", F.lit(1).alias("kind"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "claim_id", F.col("v_vec").alias("vector"))
    both = q.union(v)
    dealt = both.repartitionById(parts, F.col("cell").cast("int")) if parts else both.repartition("cell")
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("claim_id", vectors.schema["claim_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return dealt.sortWithinPartitions("cell", "kind").mapInArrow(cell_scorer(keep), schema)


def _copied(df: DataFrame, key: str, own: str, parts: int, other: str, others: int) -> DataFrame:
    """Each row with its part by hash of ``key``, once for each part of the other side."""
    placed = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts)))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def grid_shape(q_count: int, v_count: int, dimensions: int, cores: int) -> tuple[int, int]:
    """(query parts, vector parts): a query part fits GRID_BYTES, a vector part GRID_VECTORS, and no core is idle."""
    q_parts = max(1, ceil(q_count * max(1, dimensions) * 8 / GRID_BYTES))
    return q_parts, max(1, ceil(v_count / GRID_VECTORS), ceil(cores / q_parts))


def _gridded(q: DataFrame, v: DataFrame, q_count: int, v_count: int, keep: int, cores: int) -> DataFrame:
    """The ``keep`` best per query and vector part: queries move once per vector part, vectors once per query part."""
    q_parts, v_parts = grid_shape(q_count, v_count, vector_length(q, "q_vec"), cores)
    cell = F.col("p") * q_parts + F.col("r")
    asked = _copied(q, "query_id", "r", q_parts, "p", v_parts).select(cell.alias("cell"), "query_id", "q_vec")
    held = _copied(v, "claim_id", "p", v_parts, "r", q_parts).select(cell.alias("cell"), "claim_id", "v_vec")
    return _of_cells(asked, held, keep, q_parts * v_parts)


def _scanned(q: DataFrame, v: DataFrame, v_count: int, keep: int) -> DataFrame:
    """(query_id, claim_id, score): each task's ``keep`` best per query. ``q`` is of checked size.

    Any ``keep`` vectors bound the result from below, so for a big index the best of a few of
    its vectors spare the tasks from emitting what is worse."""
    asked = q.toArrow().combine_chunks()
    queries, floor = arrow_matrix(asked, "q_vec"), None
    if v_count > SEED_FROM and queries is not None:
        floor = _seed_floor(q, v, v_count, keep, asked.column("query_id"))
    ids = asked.column("query_id").combine_chunks()
    shared = q.sparkSession.sparkContext.broadcast((ids, queries, floor))
    schema = T.StructType(
        [
            T.StructField("query_id", q.schema["query_id"].dataType),
            T.StructField("claim_id", v.schema["claim_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return v.mapInArrow(scan_scorer(shared, keep), schema)


def _seed_floor(q: DataFrame, v: DataFrame, v_count: int, keep: int, ids: pa.ChunkedArray) -> np.ndarray | None:
    """Each query's ``keep``-th best score among about SEED_ROWS vectors chosen by hash; the products run in tasks."""
    share = ceil(2**30 * SEED_ROWS / v_count)
    few = arrow_matrix(v.where(F.pmod(F.xxhash64("claim_id"), F.lit(2**30)) < share).limit(2 * SEED_ROWS).toArrow().combine_chunks(), "v_vec")
    if few is None or len(few) < keep:
        return None
    shared = q.sparkSession.sparkContext.broadcast(few)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES_AT_ONCE // len(shared.value))
        for batch in batches:
            queries = list_matrix(batch.column(1))
            for start in range(0, batch.num_rows, step):
                part = queries[start : start + step]
                kth = best_pairs(part, shared.value, keep)[2].reshape(len(part), keep)[:, -1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(kth)], names=["query_id", "floor"])

    schema = T.StructType([q.schema["query_id"], T.StructField("floor", T.DoubleType())])
    cores = q.sparkSession.sparkContext.defaultParallelism
    # One number per query, SCAN_QUERIES at most.
    found = q.repartition(cores).mapInArrow(floors, schema).toArrow()
    by_id = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
    return np.array([by_id[i] for i in ids.to_pylist()])


def _pivots(v: DataFrame, count: int) -> np.ndarray:
    """``count`` vectors in hash order of their ids: at most MAX_CELLS rows reach the driver."""
    rows = v.select("claim_id", "v_vec").orderBy(F.xxhash64("claim_id"), "claim_id").limit(count).select("v_vec").collect()
    return np.unique(np.array([r[0] for r in rows], dtype="float64"), axis=0)


def _nearest(shared):
    """Column function: nearest pivot and the distance to it. ``shared`` is the broadcast pivots."""

    @F.pandas_udf("cell int, away double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        pivots = shared.value
        x = np.stack(vectors.to_numpy()).astype("float64") if len(vectors) else np.zeros((0, pivots.shape[1]))
        square = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None, :]
        cell = square.argmin(1)
        away = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
        return pd.DataFrame({"cell": cell.astype("int32"), "away": away})

    return nearest


def _reachable(shared_pivots, shared_radius, keep: int):
    """Column function: cells that may hold a hit for some query of the block.

    For any x in a cell, q.x <= q.pivot + |q| * radius."""

    @F.pandas_udf("array<int>")
    def reach(q_rows: pd.Series, q_flat: pd.Series, v_rows: pd.Series, v_flat: pd.Series) -> pd.Series:
        pivots, radius = shared_pivots.value, shared_radius.value
        found = []
        for nq, fq, nv, fv in zip(q_rows, q_flat, v_rows, v_flat):
            queries = as_matrix(fq, nq)
            floor = np.full(nq, -np.inf)
            if fv is not None and nv >= keep:
                floor = -np.partition(-(queries @ as_matrix(fv, int(nv)).T), keep - 1, axis=1)[:, keep - 1]
            reach_of = queries @ pivots.T + np.sqrt((queries**2).sum(1))[:, None] * radius[None, :]
            possible = (reach_of >= floor[:, None] - SLACK * (1 + np.abs(floor[:, None]))) & (radius >= 0)[None, :]
            found.append(np.flatnonzero(possible.any(0)).astype("int32"))
        return pd.Series(found, dtype=object)

    return reach.asNondeterministic()


def visited_share(pivots: np.ndarray, radius: np.ndarray, counts: np.ndarray) -> float:
    """Share of all rows in the cells a typical query reaches, judged with pivots as queries.

    A pivot's best other pivot stands for the bound a query starts from."""
    asked = pivots[:256]
    scores = asked @ pivots.T
    own = np.arange(len(asked))
    others = scores.copy()
    others[own, own] = -np.inf
    reach = scores + np.sqrt((asked**2).sum(1))[:, None] * radius[None, :] >= others.max(1)[:, None]
    return float((reach * counts).sum(1).mean() / max(1, counts.sum()))


def _reachable_pairs(q, v, q_count, v_count, keep, cores):
    """Block pairs that can hold a hit, or None where nearly all of them can."""
    context = q.sparkSession.sparkContext
    pivots = _pivots(v, min(MAX_CELLS, isqrt(v_count)))
    shared = context.broadcast(pivots)
    nearest = _nearest(shared)
    v = v.withColumn("_near", nearest("v_vec")).select("claim_id", "v_vec", "_near.cell", "_near.away")
    q = q.withColumn("_near", nearest("q_vec")).select("query_id", "q_vec", "_near.cell")

    # One row per cell, at most MAX_CELLS of them.
    stats = v.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()
    radius, sizes = np.full(len(pivots), -1.0), np.zeros(len(pivots))
    for row in stats:
        radius[row["cell"]], sizes[row["cell"]] = row["radius"], row["n"]
    share = visited_share(pivots, radius, sizes)
    if share > WORTHWHILE_SHARE or share * v_count > MOST_VISITS * BLOCK_ROWS:
        return None
    v_counts = F.broadcast(q.sparkSession.createDataFrame([(r["cell"], r["n"]) for r in stats], "cell int, n long"))
    q_counts = cell_counts_of(q, MAX_CELLS)

    v_blocks = packed(salted(v, v_counts, "claim_id", BLOCK_ROWS, "v_salt"), ["cell", "v_salt"], "claim_id", "v_vec", "v")
    q_rows = block_size(q_count, cores)
    q_blocks = packed(salted(q, q_counts, "query_id", q_rows, "q_salt"), ["cell", "q_salt"], "query_id", "q_vec", "q")

    salts = v_counts.select("cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("salts"))
    sampled = q_blocks.join(F.broadcast(salts), "cell", "left").withColumn(
        "v_salt", F.pmod(F.col("q_salt"), F.coalesce("salts", F.lit(1))).cast("int")
    )
    bounded = sampled.join(v_blocks, ["cell", "v_salt"], "left")
    reach = _reachable(shared, context.broadcast(radius), keep)
    visits = bounded.select(
        "q_ids",
        "q_flat",
        F.explode(reach(F.size("q_ids"), F.col("q_flat"), F.coalesce(F.size("v_ids"), F.lit(0)), F.col("v_flat"))).alias("cell"),
    )
    targets = visits.join(F.broadcast(salts), "cell").withColumn(
        "v_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    )
    return targets.join(v_blocks, ["cell", "v_salt"])


def topk_filtered(queries: DataFrame, vectors: DataFrame, condition: Column, k: int = 10, **names) -> DataFrame:
    """Exact search among the vectors that meet ``condition``, which is applied first."""
    return topk(queries, vectors.filter(condition), k, **names)


# --- approximate search -----------------------------------------------------------------


def plane_signs(dimensions: int, bands: int, bits: int, seed: int) -> np.ndarray:
    """Random planes of +1 and -1, one column per (band, bit): the parity of an md5 of seed, band, bit and dimension."""
    names = [[f"{seed}:{band}:{bit}:{d}" for band in range(bands) for bit in range(bits)] for d in range(dimensions)]
    return np.array([[1.0 if int(hashlib.md5(n.encode()).hexdigest()[0], 16) % 2 == 0 else -1.0 for n in row] for row in names])


def _buckets(planes: np.ndarray, bands: int, bits: int, probes: int):
    """Column function: a vector's bucket per band, and with ``probes`` also those that differ from it in one bit, the least
    certain bits first. A bucket's number is band * 2^bits + the signs of the projections."""

    @F.pandas_udf("array<long>")
    def buckets(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.round(np.stack(vectors.to_numpy()).astype("float64") @ planes, SCORE_PLACES).reshape(len(vectors), bands, bits)
        own = (x > 0) @ (1 << np.arange(bits)) + np.arange(bands) * (1 << bits)
        flips = np.argsort(np.abs(x), axis=2, kind="stable")[:, :, :probes]
        every = np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << flips)], axis=2)
        return pd.Series(list(every.reshape(len(vectors), -1)), index=vectors.index, dtype=object)

    return buckets.asNondeterministic()  # keeps the planner from running it twice


def bucket_bits(rows: int, rows_per_bucket: int) -> int:
    """Bits at which a band's buckets hold ``rows_per_bucket`` of ``rows`` vectors on average."""
    return max(1, round(log2(max(1, rows) / rows_per_bucket)))


def topk_lsh(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    *,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    vector_id: str = "claim_id",
    vector: str = "embedding",
    exclude_self: bool = True,
    bands: int = 4,
    probes: int = 2,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    seed: int = 7,
) -> DataFrame:
    """Approximate search by multi-probe sign hashing; exact inside the buckets that are visited.

    A vector lies in one bucket per band; there are as many buckets as the table has multiples of ``rows_per_bucket``
    rows. A query visits its own bucket and the ``probes`` nearest others of each band. More bands or probes raise
    recall. A crowded bucket is parted as the grid of ``topk`` is, from counts that stay in the cluster."""
    q, v = _sides(queries, vectors, query_id, query_vector, vector_id, vector)
    keep = k + 1 if exclude_self else k
    dimensions, bits = vector_length(v, "v_vec"), bucket_bits(vectors.count(), rows_per_bucket)
    planes = plane_signs(dimensions, bands, bits, seed)
    v = without_spare_copies(v, "claim_id", "v_vec", keep).withColumn("bucket", F.explode(_buckets(planes, bands, bits, 0)("v_vec")))
    q = q.withColumn("bucket", F.explode(_buckets(planes, bands, bits, min(probes, bits))("q_vec")))
    part_rows = max(1, GRID_BYTES // (8 * max(1, dimensions)))
    sized = (
        v.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / GRID_VECTORS).alias("v_parts"))
        .join(q.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("q_parts")), "bucket")
    )
    parts = small_side(sized)

    def placed(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """A row's own part of its bucket, once for each part of the other side; cells are numbered by bucket, then parts."""
        dealt = df.join(parts, "bucket").withColumn(f"{own}_at", F.pmod(F.xxhash64(key), F.col(f"{own}_parts")))
        dealt = dealt.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_parts") - 1)))
        return dealt.withColumn("cell", F.shiftleft("bucket", 32) + F.col("v_at") * (1 << 16) + F.col("q_at"))

    found = _of_cells(placed(q, "query_id", "q", "v"), placed(v, "claim_id", "v", "q"), keep, None)
    return ranked_hits(found, k, exclude_self, fold=True)


# --- ids ----------------------------------------------------------------------------------


def surrogate_id(*keys: str) -> Column:
    """Stable id of a chunk from its own keys: 60 bits of an md5, the same in every run.

    NULL keys are told apart from empty ones."""
    joined = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


# --- re-ranking -------------------------------------------------------------------------


def token_set(tokens: Column) -> Column:
    """Distinct tokens as hashes, smaller to move than the words."""
    return F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))


def overlap_scores(query: Column, hits: Column) -> Column:
    """For each hit how many distinct tokens it shares with the query; 0 where either has no text."""
    return F.transform(hits, lambda h: F.coalesce(F.size(F.array_intersect(query, h)), F.lit(0)).cast("double"))


def frequent_terms(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Terms of (t, n), highest n first, and their n: all from the lowest n, 2 at least, from which on there are at most FREQUENT.

    One row per n finds that n; of the terms only these reach the driver, as two arrays of bounded size."""
    counts = written(counts, "frequencies")
    least, total = None, 0
    for n, terms in sorted(counts.where("n > 1").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True):
        total += terms
        if total > FREQUENT:
            break
        least = n
    rows = counts.where(F.col("n") >= (least or 2**62)).select("t", "n").toArrow()
    t, n = (rows.column(i).to_numpy() for i in (0, 1))
    order = np.lexsort((t, -n))
    return t[order], n[order]


def packed_numbers(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, seven bits a byte: first the lowest bits of all, then the next ones of those that have more."""
    planes = []
    while len(x):
        more = x > 127
        planes.append((x & 127 | more * 128).astype(np.uint8).tobytes())
        x = x[more] >> 7
    return b"".join(planes)


def unpacked_numbers(data: bytes | pa.Buffer, count: int) -> np.ndarray:
    x, at, shift, start = np.zeros(count, np.int64), np.arange(count), 0, 0
    while len(at):
        plane = np.frombuffer(data, np.uint8, len(at), start).astype(np.int64)
        x[at] |= (plane & 127) << shift
        start, shift, at = start + len(at), shift + 7, at[plane > 127]
    return x


TERM_SET = "size int, codes binary, rest binary"


# What follows reads the rows of an Arrow batch where they lie, one at a time: a batch of sets as Python objects takes several times its size.


def list_views(lists: pa.ListArray) -> list[np.ndarray]:
    """The rows of lists of numbers; none may be missing."""
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[start:stop] for start, stop in zip(at[:-1].tolist(), at[1:].tolist())]


def list_rows(lists: pa.ListArray) -> list[range]:
    """Where the rows of lists lie in their ``values``."""
    at = lists.offsets.to_numpy().tolist()
    return [range(start, stop) for start, stop in zip(at[:-1], at[1:])]


def as_lists(rows: Sequence[np.ndarray], kind: str) -> pa.ListArray:
    at = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate([np.empty(0, kind), *rows])))


class TermCoder:
    """Sets of term hashes: places in the list of frequent terms as packed gaps, all other hashes as they are. Nothing is lost."""

    def __init__(self, frequent: np.ndarray):
        self.code = np.argsort(frequent, kind="stable")
        self.terms = frequent[self.code]

    def __call__(self, hashes: np.ndarray) -> tuple[tuple[int, bytes, bytes], np.ndarray]:
        """A set's row, and where its terms lie in ``hashes``."""
        at = np.minimum(np.searchsorted(self.terms, hashes), max(0, len(self.terms) - 1))
        known = self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)
        place, other = np.flatnonzero(known), np.flatnonzero(~known)
        codes = self.code[at[place]]
        place, other = place[np.argsort(codes)], other[np.argsort(hashes[other])]
        gaps = np.diff(np.sort(codes), prepend=-1)
        return (len(codes), packed_numbers(gaps), hashes[other].tobytes()), np.r_[place, other]


def columns_of(rows: list[tuple], count: int) -> list[tuple]:
    return [*zip(*rows)] if rows else [()] * count


def set_codes(size: int, codes: bytes | pa.Buffer) -> np.ndarray:
    return np.cumsum(unpacked_numbers(codes, int(size))) - 1


def coded_set(hashes: Column, shared) -> Column:
    """An array of distinct term hashes as TERM_SET; ``shared`` is the broadcast list of frequent terms."""

    @F.arrow_udf(TERM_SET)
    def code(sets: pa.Array) -> pa.Array:
        coder = TermCoder(shared.value)
        there = sets.is_valid().to_pylist()
        rows = [coder(t)[0] if own else (None, None, None) for t, own in zip(list_views(sets), there)]
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns_of(rows, 3), (pa.int32(), pa.binary(), pa.binary()))], names=["size", "codes", "rest"])

    return code.asNondeterministic()(hashes)


def each(structs: Column, field: str) -> Column:
    return F.transform(structs, lambda s: s[field])


def shared_numbers(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two ascending lists without repeats share."""
    if not len(x) or not len(y):
        return 0
    return np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)


def overlap_rows(q_size: pa.Array, q_codes: pa.Array, q_rest: pa.Array, h_size: pa.Array, h_codes: pa.Array, h_rest: pa.Array) -> pa.ListArray:
    out, asked = [], np.zeros(FREQUENT, bool)
    sizes, all_codes, rests = h_size.values, h_codes.values, h_rest.values
    for q, hits in enumerate(list_rows(h_codes)):
        scores = np.zeros(len(hits))
        if q_codes[q].is_valid:
            own, others = set_codes(q_size[q].as_py(), q_codes[q].as_buffer()), np.frombuffer(q_rest[q].as_buffer(), np.int64)
            asked[own] = True
            for n, h in enumerate(hits):
                if all_codes[h].is_valid:
                    theirs, held = set_codes(sizes[h].as_py(), all_codes[h].as_buffer()), np.frombuffer(rests[h].as_buffer(), np.int64)
                    scores[n] = np.count_nonzero(asked[theirs]) + shared_numbers(others, held)
            asked[own] = False
        out.append(scores)
    return as_lists(out, "float64")


def coded_overlap_scores(query: Column, hits: Column) -> Column:
    """``overlap_scores`` of TERM_SETs that share one list of frequent terms."""

    @F.arrow_udf("array<double>")
    def overlap(q_size: pa.Array, q_codes: pa.Array, q_rest: pa.Array, h_size: pa.Array, h_codes: pa.Array, h_rest: pa.Array) -> pa.Array:
        return overlap_rows(q_size, q_codes, q_rest, h_size, h_codes, h_rest)

    fields = ("size", "codes", "rest")
    return overlap.asNondeterministic()(*[query[f] for f in fields], *[each(hits, f) for f in fields])


def term_weights(rows: DataFrame, key: str, text: str, out: str = "weights") -> DataFrame:
    """(key, out): a text's TF-IDF weights, scaled to length 1: its terms as a TERM_SET, and, in their order, its counts
    ``n`` and ``idf``, and the length by which to divide.

    Weight = count x (ln((1 + texts) / (1 + texts with the term)) + 1) of lower-cased tokens. A text's terms are counted where it
    lies, as one row; document frequencies of FREQUENT terms go to the tasks, only other terms meet theirs by a join.
    A text without tokens has no row. Features are comparable within one result."""

    @F.arrow_udf("t array<long>, n array<int>")
    def counted(terms: pa.Array) -> pa.Array:
        found = [np.unique(t, return_counts=True) for t in list_views(terms)]
        return pa.StructArray.from_arrays([as_lists([t for t, _ in found], "int64"), as_lists([n.astype(np.int32) for _, n in found], "int32")], names=["t", "n"])

    # Rows that repeat a key are one text.
    folded = rows.where(F.col(text).isNotNull()).groupBy(key).agg(F.collect_list(F.lower(F.col(text))).alias("_texts"))
    terms = folded.select(key, F.flatten(F.transform("_texts", lambda x: F.transform(tokens(x), lambda t: F.xxhash64(t)))).alias("_t"))
    made = written(terms.withColumn("c", counted.asNondeterministic()("_t")).select(key, "c.t", "c.n").where(F.size("t") > 0), "terms")
    spread_of = written(made.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")), "spread")
    texts, shared = rows.count(), rows.sparkSession.sparkContext.broadcast(frequent_terms(spread_of))

    @F.arrow_udf(f"{TERM_SET}, n binary, others array<long>")
    def coded(sets: pa.Array, counts: pa.Array) -> pa.Array:
        coder, found = TermCoder(shared.value[0]), []
        for t, n in zip(list_views(sets), list_views(counts)):
            row, order = coder(t)
            found.append((*row, packed_numbers(n.astype(np.int64)[order])))
        size, codes, rest, n = columns_of(found, 4)
        others = as_lists([np.frombuffer(r, np.int64) for r in rest], "int64")
        return pa.StructArray.from_arrays([pa.array(size, pa.int32()), *[pa.array(c, pa.binary()) for c in (codes, rest, n)], others], names=["size", "codes", "rest", "n", "others"])

    @F.arrow_udf("idf binary, length double")
    def weighed(size: pa.Array, codes: pa.Array, rest: pa.Array, n: pa.Array, t: pa.Array, df: pa.Array) -> pa.Array:
        found = []
        for i, (terms, frequencies) in enumerate(zip(list_views(t), list_views(df))):
            others = np.frombuffer(rest[i].as_buffer(), np.int64)
            rare = np.zeros(len(others))
            if len(others):
                rare[np.searchsorted(others, terms)] = frequencies
            idf = np.log((1.0 + texts) / (1 + np.r_[shared.value[1][set_codes(size[i].as_py(), codes[i].as_buffer())], rare])) + 1
            weight = unpacked_numbers(n[i].as_buffer(), len(idf)) * idf
            found.append((idf.tobytes(), np.sqrt((weight * weight).sum())))
        idf, length = columns_of(found, 2)
        return pa.StructArray.from_arrays([pa.array(idf, pa.binary()), pa.array(length, pa.float64())], names=["idf", "length"])

    sets = written(made.withColumn("s", coded.asNondeterministic()("t", "n")).select(key, "s.*"), "sets")
    rare = sets.select(F.col(key).alias("_key"), F.explode("others").alias("t")).join(spread_of.withColumnRenamed("n", "df"), "t")
    rare = rare.groupBy("_key").agg(F.collect_list(F.struct("t", "df")).alias("m"))
    met = sets.drop("others").join(rare, sets[key].eqNullSafe(rare["_key"]), "left").drop("_key")
    fields = ("size", "codes", "rest", "n")
    weight = weighed.asNondeterministic()(*fields, each(F.col("m"), "t"), each(F.col("m"), "df"))
    return met.withColumn("w", weight).select(key, F.struct(*fields, "w.idf", "w.length").alias(out))


def hit_weights(feature: Column) -> Column:
    """What ``cosine_scores`` takes of a hit's ``term_weights``: all but what the query's bring along."""
    return F.struct(*[feature[f].alias(f) for f in ("size", "codes", "rest", "n", "length")])


def cosine_rows(query: Sequence[pa.Array], hits: Sequence[pa.ListArray]) -> pa.ListArray:
    """The scores of each query's hits; ``query`` has size, codes, rest, n, length and idf, ``hits`` lists of all but idf."""
    (q_size, q_codes, q_rest, q_n, q_length, q_idf), (sizes, all_codes, rests, counts, lengths) = query, [h.values for h in hits]
    out, asked = [], np.zeros(FREQUENT)
    for q, own_hits in enumerate(list_rows(hits[1])):
        scores = np.zeros(len(own_hits))
        if q_codes[q].is_valid:
            idf, others = np.frombuffer(q_idf[q].as_buffer()), np.frombuffer(q_rest[q].as_buffer(), np.int64)
            own = set_codes(q_size[q].as_py(), q_codes[q].as_buffer())
            weight = unpacked_numbers(q_n[q].as_buffer(), len(idf)) * idf / q_length[q].as_py() * idf
            asked[own] = weight[: len(own)]
            for i, h in enumerate(own_hits):
                if all_codes[h].is_valid:
                    theirs, held = set_codes(sizes[h].as_py(), all_codes[h].as_buffer()), np.frombuffer(rests[h].as_buffer(), np.int64)
                    count = unpacked_numbers(counts[h].as_buffer(), len(theirs) + len(held)) / lengths[h].as_py()
                    _, x, y = np.intersect1d(others, held, True, True)
                    scores[i] = asked[theirs] @ count[: len(theirs)] + weight[len(own) + x] @ count[len(theirs) + y]
            asked[own] = 0
        out.append(np.round(scores, SCORE_PLACES))
    return as_lists(out, "float64")


def cosine_scores(query: Column, hits: Column) -> Column:
    """For each hit the cosine of its ``term_weights`` with the query's; 0 where either is missing."""

    @F.arrow_udf("array<double>")
    def cosine(
        q_size: pa.Array, q_codes: pa.Array, q_rest: pa.Array, q_n: pa.Array, q_length: pa.Array, q_idf: pa.Array,
        h_size: pa.Array, h_codes: pa.Array, h_rest: pa.Array, h_n: pa.Array, h_length: pa.Array,
    ) -> pa.Array:
        return cosine_rows((q_size, q_codes, q_rest, q_n, q_length, q_idf), (h_size, h_codes, h_rest, h_n, h_length))

    fields = ("size", "codes", "rest", "n", "length")
    return cosine.asNondeterministic()(*[query[f] for f in (*fields, "idf")], *[each(hits, f) for f in fields])


def rerank(hits: DataFrame, queries: DataFrame, claims: DataFrame, scores: Callable[[Column, Column], Column] = cosine_scores) -> DataFrame:
    """Re-order each query's hits by ``scores(query feature, array of hit features)``; equal scores keep their earlier order.

    ``queries`` (query_id, feature) and ``claims`` (claim_id, feature) give what is compared, token sets or term weights for
    instance. A query's hits are folded into one row, so its feature moves once, not once per hit. The hit set
    stays as it is, hits and queries without a feature included; the old rank becomes ``first_rank``, the score
    ``rerank_score``. Further columns of ``hits`` are carried along."""
    others = [c for c in hits.columns if c not in ("query_id", "rank")]
    featured = hits.join(claims.select("claim_id", F.col("feature").alias("_feature")), "claim_id", "left")
    one = F.struct(F.col("rank").alias("first_rank"), F.struct(*others).alias("hit"), F.col("_feature").alias("feature"))
    folded = featured.groupBy("query_id").agg(F.array_sort(F.collect_list(one), lambda a, b: a["first_rank"] - b["first_rank"]).alias("hits"))
    joined = folded.join(queries.select("query_id", F.col("feature").alias("asked")), "query_id", "left")
    scored = joined.select("query_id", F.transform("hits", lambda h: F.struct(h["first_rank"].alias("first_rank"), h["hit"].alias("hit"))).alias("hits"), scores(F.col("asked"), F.transform("hits", lambda h: h["feature"])).alias("s"))
    paired = F.zip_with("hits", "s", lambda h, s: F.struct((-s).alias("low"), h["first_rank"].alias("first_rank"), h["hit"].alias("hit")))
    ordered = F.transform(
        F.array_sort(paired, lambda a, b: F.when(a["low"] != b["low"], F.when(a["low"] < b["low"], -1).otherwise(1)).otherwise(a["first_rank"] - b["first_rank"])),
        lambda h, i: F.struct(h["hit"].alias("hit"), h["first_rank"].alias("first_rank"), (-h["low"]).alias("rerank_score"), (i + 1).alias("rank")),
    )
    rows = scored.select("query_id", F.explode(ordered).alias("h"))
    return rows.select("query_id", "h.hit.*", "h.first_rank", F.col("h.rerank_score"), F.col("h.rank"))
