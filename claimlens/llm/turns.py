"""Repairing the turn structure of conversations: align each to every feasible length of the alternating grammar.

A repaired conversation's role initials are ``(s?(ua)+)?``. Rows are kept (0), given the role user or assistant (1),
deleted (2, the only way for blank and repeated rows) or inserted with an empty text (5); a row left in place whose text
breaks off costs 5 more. A Wagner-Fischer table over (row, symbols still to come) holds the targets of all lengths,
since a shorter target is the end of a longer one. Ukkonen's bound narrows it: cells whose least possible cost
exceeds that of a plain walk are left out. The audits of all targets of least cost are traced and the ASCII-least is taken.

A conversation is a sequence, so its rows pass one task in order, as a stream: the alignment holds a few bytes per row, the
digest one row. Texts are compared by SHA-256; repeats are found by an aggregate and a join, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import WORD
from claimlens.session import written

# Fixed values of the contract.
RETRIM, DELETE, INSERT, BREAK = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
BLANK, REPEATED, TRUNCATED = 1, 2, 3

# A row's code: initial (0 s, 1 u, 2 a, 3 any other) + 4 * fault. Longer conversations use the folded table.
INITIALS = "sua"
WIDE = 192
NEVER = 1 << 60


# --- alignment --------------------------------------------------------------------------


def _walk(rows: list[tuple[int, bool, int]]) -> int:
    """Cost of a plain walk: delete what must go, keep what fits, change the role of the rest, close the last pair."""
    cost, due = 0, "u"
    for initial, must_go, broken in rows:
        if must_go:
            cost += DELETE
        else:
            cost += broken + (RETRIM if INITIALS[initial : initial + 1] != due else 0)
            due = "a" if due == "u" else "u"
    return cost + (INSERT if due == "a" else 0)


def _table(rows: list[tuple[int, bool, int]], most: int) -> list[dict[int, tuple[int, str]]]:
    """For each row the band of {symbols to come: (least cost to the end, edit)}; ``most`` bounds the cost.

    ``r`` symbols to come are the end of ...uaua, so the next one is u where r is even. A cell stands in the
    band if the deletions or insertions that its row and r ask for cost no more than ``most``."""
    n = len(rows)
    stay = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        stay[i] = stay[i + 1] + (not rows[i][1])
    table: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        left, gone = stay[i], DELETE * (n - i - stay[i])
        low = max(0, left - (most - gone) // DELETE)
        high = left + (most - gone) // INSERT
        here = table[i]
        after = table[i + 1] if i < n else {}
        for r in range(low, high + 1):
            cost, edit = (0, "") if i == n and r == 0 else (NEVER, "")
            if i < n:
                initial, must_go, broken = rows[i]
                if r in after:
                    cost, edit = DELETE + after[r][0], "D"
                if r - 1 in here and INSERT + here[r - 1][0] < cost:
                    cost, edit = INSERT + here[r - 1][0], "I"
                if not must_go and r - 1 in after:
                    fits = INITIALS[initial : initial + 1] == ("a" if r % 2 else "u")
                    kept = (0 if fits else RETRIM) + broken + after[r - 1][0]
                    if kept < cost:
                        cost, edit = kept, "K" if fits else "R"
            elif r - 1 in here:
                cost, edit = INSERT + here[r - 1][0], "I"
            if cost < NEVER:
                here[r] = (cost, edit)
    return table


def _traced(table: list[dict[int, tuple[int, str]]], i: int, r: int) -> str:
    """The edits from a cell on. Of equal edits a cell holds the ASCII-least, so the trace is the least audit."""
    edits = []
    while edit := table[i][r][1]:
        edits.append(edit)
        i, r = i + (edit != "I"), r - (edit != "D")
    return "".join(edits)


def aligned(rows: list[tuple[int, bool, int]]) -> tuple[int, str]:
    """(least cost, ASCII-least cheapest audit) of rows (initial, must go, cost of leaving a broken text)."""
    most = min(_walk(rows), DELETE * len(rows))
    table = _table(rows, most)
    ends = [(table[0][r][0], 0, r) for r in table[0] if r % 2 == 0]
    # A target that begins with s: what stands before the kept system row is deleted.
    for p, (initial, must_go, broken) in enumerate(rows):
        if DELETE * p > most:
            break
        if initial == 0 and not must_go:
            ends += [(DELETE * p + broken + c, p + 1, r) for r, (c, _) in table[p + 1].items() if r % 2 == 0 and r > 0]
    least = min(c for c, _, _ in ends)
    audits = (("D" * (i - 1) + "K" if i else "") + _traced(table, i, r) for c, i, r in ends if c == least)
    return least, min(audits)


def folded(codes: bytes) -> tuple[int, str]:
    """``aligned`` for long conversations: columns of the table with the same next symbol folded into one.

    States: start; u must come (after s); u or the end; a must come. Costs are exact as the symbols to come
    matter only by that. Memory: four bytes per row."""
    n = len(codes)
    edits = bytearray(4 * n + 4)
    cost = [0, NEVER, 0, NEVER]  # start, must u, may u, must a
    for i in range(n, -1, -1):
        code = codes[i] if i < n else 0
        initial, fault = code & 3, code >> 2
        broken = BREAK if fault == TRUNCATED else 0
        stays = i < n and fault in (0, TRUNCATED)
        now, edit = [0, NEVER, 0, NEVER] if i == n else [DELETE + c for c in cost], ["", "", "", ""] if i == n else ["D"] * 4
        moves = ((0, 3, 1), (1, 3, 1), (2, 3, 1), (3, 2, 2))
        if stays:
            for state, to, wanted in moves:
                kept = broken + cost[to] + (0 if initial == wanted else RETRIM)
                if kept < now[state]:
                    now[state], edit[state] = kept, "K" if initial == wanted else "R"
            if initial == 0:
                kept = broken + cost[1]
                if kept < now[0] or (kept == now[0] and edit[0] == "R"):
                    now[0], edit[0] = kept, "K"
        for _ in range(2):
            for state, to, _ in moves:
                added = INSERT + now[to]
                if added < now[state] or (added == now[state] and edit[state] in ("K", "R")):
                    now[state], edit[state] = added, "I"
        cost = now
        for state in range(4):
            edits[4 * i + state] = ord(edit[state]) if edit[state] else 0
    audit, i, state = bytearray(), 0, 0
    while what := edits[4 * i + state]:
        audit.append(what)
        letter = chr(what)
        if letter != "D":
            system = state == 0 and letter == "K" and codes[i] & 3 == 0
            state = 1 if system else 2 if state == 3 else 3
        i += letter != "I"
    return cost[0], audit.decode()


@lru_cache(maxsize=100_000)
def _repair_short(codes: bytes) -> tuple[int, str]:
    return aligned([(c & 3, c >> 2 in (BLANK, REPEATED), BREAK if c >> 2 == TRUNCATED else 0) for c in codes])


def repair(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation's row codes."""
    return _repair_short(codes) if len(codes) <= WIDE else folded(codes)


# --- rows -------------------------------------------------------------------------------


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn`` modulo 20. A dropped row stays as ``there`` = false."""
    dealt = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")) % 20
    text = _filled("text")
    rows = turns.select(
        "conv_id",
        "turn",
        F.when(dealt == 4, "user").otherwise(_filled("role")).alias("role"),
        F.when(dealt == 1, "").when(dealt == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (dealt != 0).alias("there"),
        F.when(dealt == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def _coded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an id and a code (none where they are not ``there``), and the stored rows with their texts."""
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    marked = written(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            *["conv_id", "turn", "role", "text", "there"],
            F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
            (F.position(F.substring("role", 1, 1), F.lit(INITIALS)) - 1).alias("initial"),
            (~F.col("text").rlike(WORD)).alias("blank"),
            (~last.isin(".", "!", "?")).alias("broken"),
        ),
        "turns",
    )
    keys = ["conv_id", "role", "digest"]
    order = F.struct(F.col("turn").isNotNull().alias("given"), "turn", "row")
    firsts = marked.where("there").groupBy(*keys).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("first.row").alias("first_row"))
    same = [marked[k].eqNullSafe(firsts[f"_{k}"]) for k in keys]
    initial = F.when((F.col("role") == "") | (F.col("initial") < 0), 3).otherwise(F.col("initial"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first_row") != F.col("row"), REPEATED).when(F.col("broken"), TRUNCATED).otherwise(0)
    code = F.when(F.col("there"), initial + 4 * fault).cast("int").alias("code")
    coded = marked.drop("text").join(firsts, same, "left").select("conv_id", "turn", "role", "digest", "row", code)
    return coded, marked


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "digest", "row")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray, pa.RecordBatch]]:
    """(conv_id, whether it begins here, rows of it) in order, over batches sorted by conv_id."""
    before, any_before = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        codes = ids.dictionary_encode(null_encoding="encode")
        numbers = codes.indices.to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.flatnonzero(np.diff(numbers)) + 1, len(numbers)]
        values = codes.dictionary.to_pylist()
        for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
            key = values[numbers[start]]
            yield key, not any_before or key != before, batch.slice(start, stop - start)
            before, any_before = key, True


class _Counts:
    """What is known of a conversation so far."""

    def __init__(self, key):
        self.key, self.codes = key, bytearray()
        self.low = self.high = self.last = None
        self.distinct = 0

    def take(self, turns: pa.Array, codes: pa.Array) -> None:
        for turn, code in zip(turns.to_pylist(), codes.to_pylist()):
            if code is None:
                continue
            self.codes.append(code)
            if turn is not None:
                if turn != self.last:
                    self.distinct += 1
                self.low = turn if self.low is None else self.low
                self.high = self.last = turn

    def row(self) -> tuple:
        faults = [0, 0, 0, 0]
        for fault in range(1, 4):
            faults[fault] = sum(self.codes.count(i + 4 * fault) for i in range(4))
        letters = bytes(c & 3 for c in self.codes)
        legal = sum(letters.count(bytes([INITIALS.index(a), INITIALS.index(b)])) for a, b in LEGAL)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        cost, audit = repair(bytes(self.codes))
        return self.key, gaps, *faults[1:], max(0, len(letters) - 1) - legal, cost, audit


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ROWS_AT_ONCE = 4_096


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: (conv_id, turn, code) in order to one audit row per conversation."""
    now, done, kind = None, [], None
    for key, begins, rows in _conversations(batches):
        if kind is None:
            names = [x.split()[0] for x in AUDIT.split(", ")]
            kind = pa.schema([("conv_id", rows.schema.field(0).type)] + [(x, pa.string() if x == "audit" else pa.int64()) for x in names])
        if begins:
            if now:
                done.append(now.row())
            if len(done) >= ROWS_AT_ONCE:
                yield _batch(done, kind)
                done = []
            now = _Counts(key)
        now.take(rows.column(1), rows.column(2))
    if now:
        yield _batch([*done, now.row()], kind)


class _Digest:
    """SHA-256 of a repaired conversation, fed row by row."""

    def __init__(self, given: tuple):
        self.given, self.audit, self.at = given, given[-1], 0
        self.hash, self.due, self.any = hashlib.sha256(), "u", False

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def _role(self) -> str:
        role = "user" if self.due == "u" else "assistant"
        self.due = "a" if self.due == "u" else "u"
        return role

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(self._role(), "")
            self.at += 1

    def take(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._line(self._role(), text)
        elif edit == "K":
            if role[0] != "s":
                self._role()
            self._line(role, text)

    def row(self) -> tuple:
        self.inserts()
        return *self.given, self.hash.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: each conversation's audit row, then its (role, text) in order, to the audit row and the digest."""
    now, done, kind = None, [], None
    names = [x.split()[0] for x in AUDIT.split(", ")]
    for key, begins, rows in _conversations(batches):
        if kind is None:
            kind = pa.schema(
                [("conv_id", rows.schema.field(0).type)]
                + [(x, pa.string() if x == "audit" else pa.int64()) for x in names]
                + [("repaired_sha256", pa.string())]
            )
        start = 0
        if begins:
            if now:
                done.append(now.row())
            if len(done) >= ROWS_AT_ONCE:
                yield _batch(done, kind)
                done = []
            now, start = _Digest((key, *(rows.column(x)[0].as_py() for x in names))), 1
        roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
        for n in range(start, rows.num_rows):
            now.take(roles[n], texts[n])
    if now:
        yield _batch([*done, now.row()], kind)


def audited(rows: DataFrame) -> DataFrame:
    """Repair conversations given as (conv_id, turn, role, text, there) rows, strings not null.

    Returns per conv_id ``gaps`` (turn numbers missing between the lowest and the highest), ``blank``, ``duplicate``,
    ``truncated`` (rows by their first fault), ``illegal`` (neighbouring initials other than su, ua, au), ``cost``, ``audit``
    (edits in order: K, R, D, I) and ``repaired_sha256`` (of the repaired ``role:text`` lines).

    Rows go by turn, nulls first; rows of one turn by role, then by the text's digest, copies side by side. A role whose
    initial is none of s, u, a (or that is empty) fits no place. A null conv_id is a conversation of its own; one without rows that
    are there has zeros, an empty audit and the digest of an empty text; repeated rows are faults like any other; an empty table gives no rows."""
    codes, marked = _coded(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    audits = written(_in_order(codes).select("conv_id", "turn", "code").mapInArrow(_audits, f"conv_id {kind}, {AUDIT}"), "audits")
    names = [x.split()[0] for x in AUDIT.split(", ")]
    texts = marked.where("there").select("conv_id", "turn", "role", "text", "digest", "row", F.lit(1).alias("kind"))
    both = audits.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    return _in_order(both, "kind").select("conv_id", *names, "role", "text").mapInArrow(_digests, f"conv_id {kind}, {AUDIT}, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """Damage conversations as the contract says and repair them: one row per conv_id, see ``audited``.

    A missing role or text reads as one space (so does a missing part of the damage key). Any further columns are ignored."""
    return audited(damaged(turns))


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations themselves, from the rows given to ``audited`` and its result."""
    digest, row = F.sha2(F.col("text").cast("binary"), 256), F.monotonically_increasing_id()
    texts = rows.where("there").select(
        "conv_id", "turn", "role", "text", digest.alias("digest"), row.alias("row"), F.lit(1).alias("kind")
    )
    both = audits.select("conv_id", "audit", F.lit(0).alias("kind")).unionByName(texts, allowMissingColumns=True)
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = _in_order(both, "kind").select("conv_id", "audit", "role", "text")
    return ordered.mapInArrow(_lines, f"conv_id {kind}, place long, role string, text string")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function behind ``repaired_turns``."""

    class Lines(_Digest):
        def __init__(self, key, audit):
            super().__init__((key, audit))
            self.out, self.place = [], 0

        def _line(self, role, text):
            self.out.append((self.given[0], self.place, role, text))
            self.place += 1

    now = None
    for key, begins, rows in _conversations(batches):
        kind = pa.schema([("conv_id", rows.schema.field(0).type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        if begins:
            if now:
                now.inserts()
                if now.out:
                    yield _batch(now.out, kind)
            now = Lines(key, rows.column("audit")[0].as_py())
        roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
        for n in range(int(begins), rows.num_rows):
            now.take(roles[n], texts[n])
        if len(now.out) >= ROWS_AT_ONCE:
            yield _batch(now.out, kind)
            now.out = []
    if now:
        now.inserts()
        if now.out:
            yield _batch(now.out, kind)
