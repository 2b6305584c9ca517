import random
from collections import Counter

import numpy as np

from claimlens.llm.repetition import DUPLICATE_GRAMS, Repetition, repeated_windows, repetition_rules


def brute(text):
    text = text or ""
    words = text.split()
    inside = {}
    for n in DUPLICATE_GRAMS:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        found = Counter(grams)
        if n == 5:
            in_any = {i + k for i, g in enumerate(grams) if found[g] > 1 for k in range(n)}
        inside[n] = {i + k for i, g in enumerate(grams) if grams.index(g) < i for k in range(n)}
    lines, again = set(), []
    for line in text.split("\n"):
        if line in lines and line.split():
            again.append(line)
        lines.add(line)
    chars = sum(map(len, words))
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(again),
        "n_repeat_words": len(in_any),
        "line_share": sum(len("".join(x.split())) for x in again) / chars if chars else 0,
    } | {f"share_{n}": sum(len(words[i]) for i in inside[n]) / chars if chars else 0 for n in DUPLICATE_GRAMS}


def texts():
    rng = random.Random(9)
    made = ["", " \n\t", "one", "a b c d e a b c d e", "x\ny\nx\n\n\nx \nx ", "#|<> $5 *", "é ñ 日本 " * 9]
    for _ in range(150):
        made.append("".join(rng.choice(["aa ", "b ", "c\n", "dd ", "line one\n", "é "]) for _ in range(rng.randint(0, 60))))
    return made


def test_against_brute_force(frame):
    rows = [*enumerate(texts()), (None, None), (7000, "w " * 5_000), (7001, "same"), (7001, "same")]
    found = repetition_rules(frame(rows)).collect()
    assert len(found) == len(rows)
    wanted = {i: brute(t) for i, t in rows}
    for r in found:
        want = wanted[r["doc_id"]]
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        within = want["line_share"] <= 0.2 and all(want[f"share_{n}"] <= m for n, m in DUPLICATE_GRAMS.items())
        assert (r["base_failed"], r["kept"]) == (failed, not failed and within)


def test_empty(frame):
    assert repetition_rules(frame([])).collect() == []


def test_a_collision_is_no_repeat():
    ids = np.array([1, 2, 3, 1, 2, 9], np.uint64)
    assert repeated_windows(ids, 2, np.zeros(5, np.uint64))[0].tolist() == [0, 3]
    assert repeated_windows(ids, 2, np.zeros(5, np.uint64))[1].tolist() == [3]
    assert Repetition((5,))("a b c")["n_repeat_words"] == 0
