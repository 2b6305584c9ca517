import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from claimlens.llm import turns
from claimlens.llm.turns import BLANK, REPEATED, TRUNCATED, aligned, audited, folded, repaired, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """Least (cost, audit) over all edit scripts, by what has been written so far. rows: (initial, must go, broken)."""

    @lru_cache(None)
    def best(i, last, inserted):
        found = [(0, "")] if i == len(rows) and last in ("", "a") else []
        steps = []
        if inserted < 3:
            steps += [(5, "I", i, x, inserted + 1) for x in "ua"]
        if i < len(rows):
            initial, must_go, broken = rows[i]
            steps.append((2, "D", i + 1, None, 0))
            if not must_go:
                steps.append((5 * broken, "K", i + 1, initial, 0))
                steps += [(1 + 5 * broken, "R", i + 1, x, 0) for x in "ua"]
        for cost, edit, at, letter, n in steps:
            to = last if letter is None else GRAMMAR.get((last, letter))
            if to is not None and (rest := best(at, to, n)):
                found.append((cost + rest[0], edit + rest[1]))
        return min(found, default=None)

    return best(0, "", 0)


def encoded(rows):
    return bytes(("suax".index(i)) + 4 * (BLANK if m else TRUNCATED if b else 0) for i, m, b in rows)


def test_alignment_against_all_scripts():
    kinds = [(i, m, b) for i in "suax" for m, b in ((0, 0), (1, 0), (0, 1))]
    cases = [c for n in range(4) for c in product(kinds, repeat=n)]
    random.seed(5)
    cases += [tuple(random.choices(kinds, k=random.randint(4, 14))) for _ in range(400)]
    for rows in cases:
        wanted = cheapest(rows)
        assert aligned([("suax".index(i), bool(m), 5 * b) for i, m, b in rows]) == wanted, rows
        assert folded(encoded(rows)) == wanted, rows


def test_band_is_narrower_than_the_table():
    rows = [(1 + n % 2, False, 0) for n in range(60)]
    table = turns._table(rows, turns._walk(rows))
    assert sum(map(len, table)) < 200 and aligned(rows) == (0, "K" * 60)


def test_long_conversations_are_folded():
    random.seed(6)
    codes = bytes(random.choice([0, 1, 1, 2, 2, 3, 5, 13]) for _ in range(150))
    assert turns.repair(codes) == folded(codes)
    long = codes * 40
    cost, audit = turns.repair(long)
    assert len(audit.replace("I", "")) == len(long) and cost > 0


def brute(rows):
    """The contract over Python rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        held = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            held += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults, cells = set(), [], []
        for _, role, text in held:
            solid = re.sub(r"[\x20\x09-\x0d]", "", text)
            fault = BLANK if not solid else REPEATED if (role, text) in seen else TRUNCATED if solid[-1] not in ".!?" else 0
            seen.add((role, text))
            faults.append(fault)
            cells.append((role[:1] if role[:1] in "sua" else "x", fault in (BLANK, REPEATED), fault == TRUNCATED))
        numbers = [t for t, _, _ in held if t is not None]
        cost, audit = cheapest(tuple(cells))
        lines, at, last = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else held[at][1:]
            at += edit != "I"
            if edit != "D":
                role = role if edit == "K" else "assistant" if last == "u" else "user"
                last = role[0]
                lines.append(f"{role}:{text}")
        pairs = [a + b for a, b in zip([r[1][:1] for r in held], [r[1][:1] for r in held[1:]])]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(faults.count(f) for f in (BLANK, REPEATED, TRUNCATED)),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def by_id(df):
    return {r["conv_id"]: tuple(r)[1:9] for r in df.collect()}


def test_given_tables(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    assert by_id(repaired(table)) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(frame):
    random.seed(7)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "User"]
    texts = ["Fine.", "What now?", "broken off", "", None, " \t\n", "Fine.", "é!  ", "a\nb.\n", "🙂", "x" * 5000 + "."]
    rows = [
        (random.choice([1, 2, 3, 4, 5, None]), random.choice([None, *range(9)]), random.choice(roles), random.choice(texts))
        for _ in range(60)
    ]
    rows += [(50 + n, 0, "user", "Hi.") for n in range(150)] + rows[:5]
    found = repaired(frame(rows, SCHEMA))
    assert by_id(found) == brute(rows)
    nothing = [r for r in by_id(found).values() if r[6] == ""]
    assert nothing and all(r == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in nothing)


def test_layouts_agree_and_a_long_conversation(frame):
    rows = [(7, n, "user" if n % 3 else "assistant", f"text {n % 700}.") for n in range(1500)] + [(8, 1, "user", "Hello.")]
    a, b = by_id(repaired(frame(rows, SCHEMA))), by_id(repaired(frame(rows[::-1], SCHEMA).repartition(7)))
    assert a == b and a[7][2] > 300


def test_repaired_rows(frame):
    from pyspark.sql import functions as F

    rows = frame([(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "No.")], SCHEMA)
    rows = rows.withColumn("there", F.lit(True))
    found = audited(rows)
    lines = {(r["conv_id"], r["place"]): (r["role"], r["text"]) for r in repaired_turns(rows, found).collect()}
    for r in found.collect():
        mine = "\n".join(f"{a}:{b}" for (c, _), (a, b) in sorted(lines.items()) if c == r["conv_id"])
        assert hashlib.sha256(mine.encode()).hexdigest() == r["repaired_sha256"]


def test_empty(frame):
    assert repaired(frame([], SCHEMA)).collect() == []


def test_ids_may_be_text(frame):
    rows = [("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes."), (None, 0, "user", "Hi.")]
    found = by_id(repaired(frame(rows, "conv_id string, turn long, role string, text string")))
    assert found == brute(rows)


@pytest.mark.parametrize("codes,wanted", [(b"", (0, "")), (b"\x01", (2, "D")), (b"\x01\x02", (0, "KK")), (b"\x02\x01", (2, "RR"))])
def test_small_cases(codes, wanted):
    assert turns.repair(codes) == wanted
