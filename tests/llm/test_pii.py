import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from claimlens.llm import pii
from claimlens.llm.pii import contexts, digest, examined, find, redact, redacted

# The contract's patterns, as they stand there.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m[0]))


FRAGMENTS = ["a@b.c", "x.y@z", "1.2.3.4", "300.1.1.1", "001.02.3.255", "+1 (23) 456-7890", "4111 1111 1111 1111", "4111111111111111",
             " ", "-", "@", ".", "é", "🙂", "5", "12", "+", "_", "b.c_d@e.f", "\n", ":", "=", "password", "("]


def test_base_spans(frame):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 14)))) for i in range(700)]
    rows += [(9_000, None), (9_001, ""), (None, "a@b.c"), (9_002, "1.2.3.4"), (9_002, "1.2.3.4")]
    rows += [(9_003, "9" * 50_000 + " " + "a" * 50_000 + "@" + "b.c" * 1_000 + " +1" + "(" * 20_000)]
    found = digest(find(frame(rows))).collect()
    assert len(found) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in found:
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["spans"].startswith(want)
        assert r["n_email"] == want.count("email:") and r["n_ip"] == want.count("ip:")


@pytest.fixture(scope="module")
def cued():
    # 'mail:' precedes known addresses nine times and an unseen kind of identifier twice; 'of' precedes anything.
    rows = [(i, f"words of note mail: user{i}@host{i}.org and more of 7 words") for i in range(9)]
    rows += [(20, "text mail: zx81-handle, end"), (21, "text mail: k9.unit9 of 55555 words of note"), (22, "of of of 12345 only")]
    return rows


def test_contexts_find_unseen_identifiers(frame, cued):
    found = {r["doc_id"]: r["spans"] for r in digest(find(frame(cued))).collect()}
    assert found[20] == "found:11:22" and cued[9][1][11:22] == "zx81-handle"
    assert found[21] == "found:11:19"
    assert found[22] == ""
    assert all(found[i].startswith("email:") and "found" not in found[i] for i in range(9))


def planted(seed):
    """Rows with known addresses and unseen identifiers in natural wording, and the identifiers as (doc_id, start, end)."""
    rng, rows, want = random.Random(seed), [], set()
    stock = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ran", "sel", "tov", "home", "page", "7th")]
    frames = ["you can reach me at {} any time", "write to {} or call", "log in as {} on the portal", "my handle is {} there", "at {} on the to or is"]
    for i in range(400):
        words, kind = [rng.choice(stock) for _ in range(30)], i % 5
        if kind == 4:
            value = rng.choice(stock)
        elif i % 4 == 0:
            value = rng.choice([f"user{i}", f"zx-{i}", "qu" + "".join(rng.choice("aeiou") for _ in range(8))])
        elif i % 40 == 3:
            value = rng.choice(["bahome", "dopage"])
        else:
            value = rng.choice([f"u{i}@host{i % 9}.org", f"10.1.{i % 250}.7", f"+1 555 010 {1000 + i}"])
        before, after = frames[kind].split("{}")
        text = " ".join(words[:15]) + " " + before
        if kind < 4 and i % 4 == 0:
            want.add((i, len(text), len(text) + len(value)))
        rows.append((i, text + value + after + " " + " ".join(words[15:])))
    return rows, want


def test_identifiers_in_natural_wording(frame):
    for seed in (1, 2):
        rows, want = planted(seed)
        found = {
            (r["doc_id"], int(a), int(b))
            for r in digest(find(frame(rows))).collect()
            for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s)
            if kind == "found"
        }
        assert len(want) == 80 and len(found & want) >= 0.95 * len(want) and len(found & want) >= 0.95 * len(found)


def test_second_round_goes_on_from_found_values(frame):
    rows = [(i, f"mail to u{i}@a.org now") for i in range(5)]
    rows += [(10 + i, f"mail to member{i} now") for i in range(4)] + [(20 + i, f"account name member{i} closed") for i in range(4)]
    rows += [(30, "account name outsider closed")]
    found = {r["doc_id"]: r["spans"] for r in digest(find(frame(rows))).collect()}
    assert found[10] == "found:8:15" and found[20] == "found:13:20" and found[30] == "found:13:21"
    once = {r["doc_id"]: r["spans"] for r in digest(find(frame(rows), rounds=1)).collect()}
    assert once[10] == "found:8:15" and once[30] == ""


def test_marks_keep_places(frame):
    texts = ["to user@10.20.30.40.example.com.", "x 9.1.2.3.4@h.org y", "é🙂 4111 1111 1111 1111, a@b.c", "\x01 a@b.c", "+4111 1111 1111 1111"]
    rows = examined(frame(list(enumerate(texts))), "doc_id", "text").collect()
    for r in rows:
        assert len(r["marked"]) == len(texts[r["doc_id"]]) or not r["readable"]
    marks = {r["doc_id"]: r["marked"] for r in rows}
    assert marks[2] == "é🙂 \x01111_1111_1111_1111, \x01@b.c" and marks[1] == "x \x01.1.2.3.4@h.org y"


def test_redaction(frame, cued):
    rows = [(i, t, len(t)) for i, t in cued] + [(30, None, 0), (31, "ip 1.2.3.4 card 4111 1111 1111 1111.", 35), (32, "é🙂 a@b.c x", 10)]
    docs = frame(rows, "doc_id long, text string, n_chars long")
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in redact(docs).collect()}
    assert redact(docs).columns == docs.columns
    assert found[20] == ("text mail: <FOUND>, end", 23)
    assert found[31][0] == "ip <IP> card <CARD>."
    assert found[32] == ("é🙂 <EMAIL> x", 12)
    assert found[30] == (None, 0) and found[22] == (cued[11][1], len(cued[11][1]))


def test_redaction_of_overlapping_spans(frame):
    rows = [(1, "call +33.1.42.68.53.00 now"), (2, "to user@10.20.30.40.example.com."), (3, "+4111 1111 1111 1111, then a@b.c/d@e.f"), (4, "x 9.1.2.3.4@h.org y")]
    found = {r["doc_id"]: r["text"] for r in redact(frame(rows)).collect()}
    assert found == {1: "call <PHONE> now", 2: "to <EMAIL>.", 3: "+<CARD>, then <EMAIL>/<EMAIL>", 4: "x <EMAIL> y"}
    spans = [(0, "phone", 2, 9), (0, "ip", 4, 12), (0, "card", 12, 14), (0, "email", 20, 25), (0, "found", 20, 22)]
    row = frame([(1, "é" * 30)]).select(redacted(F.col("text"), F.array(*[F.struct(F.lit(o).alias("order"), F.lit(k).alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end")) for o, k, a, b in spans])).alias("t")).first()
    assert row["t"] == "éé<PHONE><CARD>éééééé<EMAIL>ééééé"


def test_empty(frame):
    assert digest(find(frame([]))).collect() == []


def test_runs_are_looked_for_inside_rows(frame, monkeypatch):
    texts = ["a mail: b mail:", "", "mail: mail: mail:", "= mail: (end)", "c"]
    rows = frame([(str(i), t, True) for i, t in enumerate(texts)], "row_key string, marked string, readable boolean").coalesce(1)
    every = [tuple(r) for r in contexts(rows, "row_key").collect()]
    assert len(every) == 4 + 3 + 3 + 1
    for words in (["mail:", "b"], []):
        led, held = ([tuple(r) for r in contexts(rows, "row_key", **{k: words}).collect()] for k in ("led", "held"))
        assert led == [r for r in every if r[3] in words] and held == [r for r in every if r[2] in words]
    words = frame([("mail:",), ("end",)], "w string").coalesce(1)
    for most in (0, 100):
        monkeypatch.setattr(pii, "LISTED", most)
        uses = [{r["w"]: r["uses"] for r in pii.word_uses(rows, words, "w", lambda w: F.btrim(w, F.lit("()")), whole).collect()} for whole in (True, False)]
        assert uses == [{"mail:": 6, "end": 1}, {"mail:": 4}]
