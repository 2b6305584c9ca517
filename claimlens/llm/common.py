"""What several corpus operators share: words, label samples, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.session import written

# Fixed by the contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# How many pieces a hub's links are cut into when they meet the hub's row.
HUB_SALTS = 8


def whole_text(column: str = "text") -> Column:
    """The text; a missing one counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Rows kept away from training: crc32 of the id as text is a multiple of 5. A row without id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def label_sample(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, label) of at most ``bound`` labelled rows outside the held-out part, lowest hash first.

    Several labels of one id fold to the highest; rows without id or label are left out."""
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's links replaced by (u, v): every id tied to the smallest id that it reaches within the partition."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            a, b = root(u), root(v)
            if a != b:
                above[max(a, b)] = min(a, b)
    tied = [(x, root(x)) for x in above]
    yield pd.DataFrame([t for t in tied if t[0] != t[1]], columns=["u", "v"], dtype="int64")


def _stars(pairs: DataFrame) -> bool:
    """Whether every id is either tied to one other or has others tied to it."""
    ends = pairs.select(F.col("u").alias("id"), F.lit(1).alias("tied")).union(pairs.select("v", F.lit(0)))
    roles = ends.groupBy("id").agg(F.sum("tied").alias("ties"), F.min("tied").alias("low"))
    return roles.where("ties > 1 or (ties = 1 and low = 0)").limit(1).count() == 0


def connected(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): for every id on a link the smallest id that it reaches.

    Every task first ties the ids of its own links to their minimum. Then, while some id is tied to one that
    is tied itself, alternating large and small stars: each id's neighbours are tied to their minimum. A hub's
    links are salted, so they meet its row in many tasks. Every round is written to the shared
    folder, which also cuts the lineage. Memory: the ids of one task's links."""

    def to_lowest(pairs: DataFrame, lowest: DataFrame) -> DataFrame:
        salts = F.explode(F.array(*[F.lit(i) for i in range(HUB_SALTS)]))
        dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(HUB_SALTS)).cast("int"))
        return dealt.join(lowest.withColumn("salt", salts), ["u", "salt"]).drop("salt")

    def within_tasks(pairs: DataFrame) -> DataFrame:
        return written(pairs.mapInPandas(_forest, "u long, v long"), "links")

    now = within_tasks(written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), "links"))
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = to_lowest(both, lowest).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = to_lowest(large, lowest).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        now = within_tasks(written(small.union(lowest.select("u", F.col("m").alias("v"))), "stars"))
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of rows with equal ``keys`` of a sorted partition, each whole whatever the batches' ends."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(batch)]
        for start, end in zip(starts, ends):
            part = batch.iloc[start:end]
            if held and (held[0][keys].iloc[0].to_numpy() != part[keys].iloc[0].to_numpy()).any():
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of a text's words, without making a string of each.

    A word's hash is the sum of a random number per byte, times the power of its place; equal words
    have equal hashes in every process. ASCII white space parts words, as in ``WORD``."""

    def __init__(self):
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.number = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.powers = np.ones(1, np.uint64)

    def places(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each word and the byte after its last."""
        inside = np.zeros(len(letters) + 2, np.int8)
        inside[1:-1] = ~self.space[letters]
        edges = np.flatnonzero(np.diff(inside))
        return edges[::2], edges[1::2]

    def hashes(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, np.uint64)
        sizes = ends - starts
        if (longest := int(sizes.max())) > len(self.powers):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * longest, 0xD1342543DE82EF95, np.uint64)])
        first = np.cumsum(sizes) - sizes
        place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
        inner = letters[place + np.repeat(starts, sizes)]
        return mixed(np.add.reduceat(self.number[inner] * self.powers[place], first) + sizes.astype(np.uint64))

    def lowered(self, text: str | None) -> np.ndarray:
        """Hashes of the words, A-Z lower-cased."""
        letters = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        return self.hashes(letters, *self.places(letters))
