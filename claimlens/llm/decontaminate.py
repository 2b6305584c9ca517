"""Benchmark decontamination over templates: passages whose numbers, names or units were swapped still match.

Every token becomes its template form: a number, a name and a unit are typed placeholders, any other word is
itself in lower case; names in a row are one. A word that begins a sentence with a capital can be either, so every text
is read both ways. Windows of template tokens are joined by hash between documents and benchmark items;
matches in order on neighbouring diagonals make an alignment; the values in its slots decide: the same values are a
verbatim leak, values replaced one for one (but for few) are a re-parameterised item, anything else is chance.
A window of hardly any plain words is hashed with its values, so lists of numbers meet only verbatim copies.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import Words, mixed
from claimlens.session import spread, written

WINDOW = 6
COVERED = 0.6
# So many matching windows in order, of plain words for the most part, are a leak whatever their share of a long item.
LONG_RUN = 32
# Slots that may contradict the others: one, or this share.
CONTRARY = 0.2
# Plain words that an item shorter than a window must hold to be found inside a document with other values.
SHORT_PLAIN = 3
# Plain words that a window must hold for its placeholders to stand for any value, and distinct ones that an alignment must hold.
WINDOW_PLAIN = 2
ALIGNED_PLAIN = 3
# Texts are read together up to this many bytes.
READ_BYTES = 1 << 19
# Bits of the sieve in front of the join: 2 MB whatever the benchmark's size.
SIEVE_BITS = 1 << 24
# Units of measure and money.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent % $ € £ dollar dollars cent cents euro euros usd eur mph kmh kph"
).split()
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Templates:
    """Reads texts into tokens. Stops and quotes around a token do not count; a token of
    nothing else is dropped. A capital letter makes a name unless the token begins a sentence or a line."""

    def __init__(self):
        self.words = Words()
        kinds = np.zeros(256, np.int8)
        kinds[list(b"0123456789")] = 1
        kinds[list(b"abcdefghijklmnopqrstuvwxyz")] = 2
        kinds[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 3
        kinds[128:] = 2
        self.kinds = kinds
        self.edge = np.zeros(256, bool)
        self.edge[list(b"\"'`.,;:!?()[]{}<>*_")] = True
        self.stop = np.zeros(256, bool)
        self.stop[list(b".!?:")] = True
        self.units = np.sort(np.concatenate([self.words.lowered(u) for u in UNITS]))

    def __call__(self, texts: list[str | None]) -> Tokens:
        """The tokens of texts, read together: a line break parts them, and no token or run of names crosses it."""
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\n".join(encoded), np.uint8)
        first = np.cumsum([0, *[len(e) + 1 for e in encoded[:-1]]]) if encoded else np.zeros(0, np.int64)
        starts, ends = self.words.places(raw)
        # Trim the edges: to the first and the last byte of the token that is none.
        inner = np.flatnonzero(~(self.edge[raw] | self.words.space[raw]))
        low, high = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
        full = low < high
        if not full.any():
            return Tokens(*(np.empty(0, t) for t in (np.int8, np.uint64, bool, np.int64)), len(texts))
        begun = np.r_[True, self.stop[raw[ends[:-1] - 1]] | _line_between(raw, ends[:-1], starts[1:])]
        starts, ends, begun = inner[low[full]], inner[high[full] - 1] + 1, begun[full]
        lower = raw.copy()
        lower[(raw >= 65) & (raw <= 90)] += 32
        value = self.words.hashes(lower, starts, ends)
        digits = np.cumsum(np.r_[0, self.kinds[raw] == 1])
        letters = np.cumsum(np.r_[0, self.kinds[raw] >= 2])
        has_digit = digits[ends] > digits[starts]
        has_letter = letters[ends] > letters[starts]
        capital = self.kinds[raw[starts]] == 3
        kind = np.zeros(len(starts), np.int8)
        kind[capital & ~begun] = NAME
        kind[self.units[np.minimum(np.searchsorted(self.units, value), len(self.units) - 1)] == value] = UNIT
        kind[has_digit & ~has_letter] = NUMBER
        return Tokens(kind, value, capital & begun & (kind == PLAIN), np.searchsorted(first, starts, "right") - 1, len(texts))


@dataclass
class Tokens:
    """Kinds and value hashes of texts' tokens, ``begins`` (a capital makes them names but for their place), and each token's text."""

    kinds: np.ndarray
    values: np.ndarray
    begins: np.ndarray
    owner: np.ndarray
    texts: int

    def readings(self) -> Iterator[Reading]:
        """With capitals that begin a sentence as words; then with them as names, where there are any."""
        for named in (False, True):
            if not len(self.kinds) or named and not self.begins.any():
                return
            kind = np.where(self.begins, np.int8(NAME), self.kinds) if named else self.kinds
            name = kind == NAME
            follows = np.r_[False, name[1:] & name[:-1] & (self.owner[1:] == self.owner[:-1])]
            first = np.flatnonzero(~follows)
            sums = np.add.reduceat(mixed(self.values), first)
            values = np.where(np.diff(np.r_[first, len(kind)]) > 1, sums, self.values[first])
            changed = np.logical_or.reduceat(self.begins, first) if named else None
            starts = np.searchsorted(self.owner, np.arange(self.texts))
            owner = self.owner[first]
            yield Reading(kind[first], values, first - starts[owner], owner, changed, np.bincount(owner, minlength=self.texts))


@dataclass
class Reading:
    """One way to read the texts, names in a row made one: kinds, values and places of tokens, their texts, which tokens
    differ from the first reading (None: it is the first), and each text's number of tokens."""

    kinds: np.ndarray
    values: np.ndarray
    places: np.ndarray
    owner: np.ndarray
    changed: np.ndarray | None
    sizes: np.ndarray

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of every window of ``n`` tokens within a text that is not one of the first reading too."""
        count = len(self.kinds) - n + 1
        if count <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        whole = self.owner[:count] == self.owner[n - 1 :]
        if self.changed is not None:
            upto = np.cumsum(np.r_[0, self.changed])
            whole &= upto[n:] > upto[:count]
        at = np.flatnonzero(whole)
        plain = self.kinds == PLAIN
        template = np.where(plain, self.values, self.kinds.astype(np.uint64))
        held = np.cumsum(np.r_[0, plain])
        few = at[held[at + n] - held[at] < WINDOW_PLAIN]
        rolled = self._rolled(template, at, n)
        rolled[np.searchsorted(at, few)] = mixed(self._rolled(self.values, few, n) + _STEP)
        return at, rolled

    @staticmethod
    def _rolled(tokens: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        rolled = np.full(len(at), n, np.uint64)
        for k in range(n):
            rolled = mixed(rolled * _STEP + tokens[at + k])
        return rolled

    def packed(self, at: int, n: int) -> bytes:
        """Kinds, values and places (from the first on) of the window at a token."""
        places = (self.places[at : at + n] - self.places[at]).astype(np.int32)
        return self.kinds[at : at + n].tobytes() + self.values[at : at + n].tobytes() + places.tobytes()


def _line_between(raw: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    lines = np.cumsum(np.r_[0, raw == 10])
    return lines[starts] > lines[ends]


def _unpacked(window: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(window) // 13
    return np.frombuffer(window, np.int8, n), np.frombuffer(window, np.int64, n, n), np.frombuffer(window, np.int32, n, 9 * n)


def item_windows(items: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """(item_id, item_at, window, item_windows, width, item_tokens, item_slots): the benchmark's windows in either reading; an
    item shorter than a window is one of its own width. item_slots are a window's kinds, values and places, packed."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Templates()
        for batch in batches:
            for item, t in zip(batch["item_id"], batch["text"]):
                size = 0
                for reading in read([t]).readings():
                    wide = min(n, len(reading.kinds))
                    at, rolled = reading.windows(wide)
                    size = size or len(at)
                    slots = [reading.packed(i, wide) for i in at.tolist()]
                    yield pd.DataFrame({"item_id": item, "item_at": reading.places[at], "window": rolled.view(np.int64), "item_windows": size, "width": wide, "item_slots": slots})

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("item_id is not null")
    return rows.mapInPandas(run, f"item_id {kind}, item_at long, window long, item_windows long, width int, item_slots binary").distinct()


def consistent(pairs: list[tuple[int, int, int]]) -> str:
    """What slots (kind, item's value, document's value) say: 'verbatim', 'reparameterised' or ''. Values must be replaced one
    for one, but for one slot or a share ``CONTRARY`` of them."""
    if all(a == b for _, a, b in pairs):
        return "verbatim"
    there: dict = {}
    back: dict = {}
    agree = 0
    for (kind, a, b), times in sorted(Counter(pairs).items(), key=lambda x: (-x[1], x[0][1] != x[0][2], x[0])):
        if there.setdefault((kind, a), b) == b and back.setdefault((kind, b), a) == a:
            agree += times
    return "reparameterised" if len(pairs) - agree <= max(1, CONTRARY * len(pairs)) else ""


def in_order(item_at: np.ndarray, doc_at: np.ndarray) -> list[int]:
    """Indices of a longest list of matches that rises on both sides."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(item_at)
    x, y = item_at.tolist(), doc_at.tolist()
    for i in np.lexsort((-doc_at, item_at)).tolist():
        at = bisect.bisect_left(tops, y[i])
        before[i] = last[at - 1] if at else -1
        tops[at : at + 1], last[at : at + 1] = [y[i]], [i]
    chain, i = [], last[-1] if last else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def judged(item_at: np.ndarray, doc_at: np.ndarray, item_slots: list, doc_slots: list, size: int, width: int, n: int, whole: int, covered: float):
    """(covered, match) of the best alignment of an item of ``size`` windows in a document, or None. ``whole`` is the number of a
    document's tokens where it has no more than the item's window."""
    shift = doc_at - item_at
    order = np.argsort(shift, kind="stable")
    best, slack = None, 3 + size // 8
    ranked = shift[order]
    for low in np.unique(ranked):
        band = order[np.searchsorted(ranked, low) : np.searchsorted(ranked, low + slack, "right")]
        places = len(np.unique(item_at[band]))
        if places < min(covered * size, LONG_RUN):
            continue
        chain = band[in_order(item_at[band], doc_at[band])]
        slots: dict = {}
        words: set = set()
        wordy = 0
        for i in chain.tolist():
            kinds, theirs, on = _unpacked(item_slots[i])
            ours = _unpacked(doc_slots[i])[1]
            wordy += 2 * int((kinds == PLAIN).sum()) >= len(kinds)
            words.update(theirs[kinds == PLAIN].tolist())
            for k in np.flatnonzero(kinds).tolist():
                slots.setdefault((int(item_at[i]) + int(on[k]), int(kinds[k])), (int(kinds[k]), int(theirs[k]), int(ours[k])))
        share = min(1.0, len(chain) / size)
        if share < covered and wordy < LONG_RUN:
            continue
        match = consistent(list(slots.values()))
        if match == "reparameterised" and width == n and len(words) < ALIGNED_PLAIN:
            continue
        if match and width < n and not whole:
            plain = int((_unpacked(item_slots[chain[0]])[0] == PLAIN).sum())
            match = match if (width > 1 if match == "verbatim" else plain >= SHORT_PLAIN) else ""
        if match and (best is None or (share, match) > best):
            best = (share, match)
    return best


def _runs_of_bytes(texts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about READ_BYTES characters together, one text at least."""
    start, held = 0, 0
    for n, t in enumerate(texts):
        if held > READ_BYTES:
            yield start, n
            start, held = n, 0
        held += len(t or "") + 1
    if len(texts):
        yield start, len(texts)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    covered: float = COVERED,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, covered, match): the documents that hold a benchmark item, with the share of the item's windows
    that one alignment covers (at least ``covered``, or ``LONG_RUN`` windows) and whether it is 'verbatim' or 'reparameterised'.

    Benchmark windows are found by hash join; before it a sieve of fixed size drops document windows that
    cannot match, and lets a few others through, which the join drops. Of several alignments of an item in a document
    the best counts. An item shorter than a window is one window of its own width; inside a longer document it
    counts verbatim from two words on, and with other values where ``SHORT_PLAIN`` of its words are plain. A longer one
    counts with other values only where ``ALIGNED_PLAIN`` different plain words stand in the matched windows. Missing or empty texts match nothing; rows without an id have no part; items that repeat
    match each; rows that repeat an id give one result; empty tables give no rows; further columns are ignored."""
    spark = docs.sparkSession
    items = written(item_windows(benchmark, n, item_id, item_text), "items")
    places = F.pmod("window", F.lit(SIEVE_BITS)).cast("int")
    words = items.select((places / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), places % 64).alias("bit"))
    sieve = np.zeros(SIEVE_BITS // 64, np.int64)
    for word, bit in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # at most SIEVE_BITS / 64 rows
        sieve[word] = bit
    shared = spark.sparkContext.broadcast(sieve.view(np.uint64))
    widths = sorted({n} | {r["width"] for r in items.select("width").distinct().collect()})  # n at most
    kind = docs.schema[doc_id].dataType.simpleString()
    mask = SIEVE_BITS - 1

    def sieved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, sieve = Templates(), shared.value
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), batch["text"].to_numpy()
            for start, stop in _runs_of_bytes(texts):
                found = []
                for reading in read(texts[start:stop]).readings():
                    for wide in widths:
                        at, rolled = reading.windows(wide)
                        place = (rolled & np.uint64(mask)).astype(np.int64)
                        hit = np.flatnonzero((sieve[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1))
                        for i, h in zip(at[hit].tolist(), rolled[hit].view(np.int64).tolist()):
                            owner = reading.owner[i]
                            whole = int(reading.sizes[owner] == wide)
                            # One word inside a longer text says nothing.
                            if wide > 1 or whole:
                                found.append((ids[start + owner], int(reading.places[i]), h, reading.packed(i, wide), whole))
                if found:
                    yield pd.DataFrame(found, columns=["doc_id", "doc_at", "window", "doc_slots", "whole"])

    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null"))
    possible = rows.mapInPandas(sieved, f"doc_id {kind}, doc_at long, window long, doc_slots binary, whole int")
    # Hits of a pair are dealt by diagonal: a band of neighbouring diagonals lies within two ranges of its own width.
    width = F.floor(F.col("item_windows") / 8) + 4
    diagonal = F.floor((F.col("doc_at") - F.col("item_at")) / width)
    matched = (
        possible.join(items, "window")
        .withColumn("band", F.explode(F.array(diagonal, diagonal - 1)))
        .groupBy("doc_id", "item_id", "band")
        .agg(
            F.countDistinct("item_at").alias("places"),
            F.first("item_windows").alias("size"),
            F.first("width").alias("width"),
            F.max("whole").alias("whole"),
            F.collect_set(F.struct("item_at", "doc_at", "item_slots", "doc_slots")).alias("hits"),
        )
        .where(F.col("places") >= F.least(F.col("size") * covered, F.lit(LONG_RUN)))
    )
    columns = ("item_at", "doc_at", "item_slots", "doc_slots")

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                best = judged(np.asarray(r.item_at, np.int64), np.asarray(r.doc_at, np.int64), list(r.item_slots), list(r.doc_slots), r.size, r.width, n, r.whole, covered)
                if best:
                    found.append((r.doc_id, r.item_id, *best))
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "covered", "match"])

    laid = matched.select("doc_id", "item_id", "size", "width", "whole", *[F.col(f"hits.{c}").alias(c) for c in columns])
    per_band = laid.mapInPandas(aligned, f"doc_id {kind}, item_id {benchmark.schema[item_id].dataType.simpleString()}, covered double, match string")
    best = per_band.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "match")).alias("best"))
    return best.select("doc_id", "item_id", "best.covered", "best.match")


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents that hold no benchmark item, whole and with all their columns; rows without an id are kept."""
    leaks = contaminated(docs, benchmark, doc_id=doc_id, text=text, **settings).select("doc_id").distinct()
    rows = docs.select(F.col(doc_id).alias("id"), F.struct("*").alias("row"))
    found = written(leaks.withColumnRenamed("doc_id", "leak"), "leaks")
    return rows.join(found, F.col("id") == F.col("leak"), "left_anti").select("row.*")
