import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimlens.llm import ngram_join
from claimlens.llm.ngram_join import Grams, Tree, least_overlap, ngram_components, one_of_each

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = (text or "").translate(LOWER).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    part = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = part[a], part[b]
                part = {i: min(x, y) if p in (x, y) else p for i, p in part.items()}
    return {i: (len(sets[i]), part[i]) for i in sets}


def near_copies(seed, groups=12, copies=9, length=60):
    rng = random.Random(seed)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 9, length]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 20))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    rows += ["common passage of a few words " * 3 + f"end {i} " + rng.choice(vocabulary) for i in range(30)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block, chunk, heavy", [(1_000, 1_000_000, 64), (4, 3_000, 2)])
@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_against_all_pairs(frame, monkeypatch, block, chunk, heavy, n, percent):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    monkeypatch.setattr(ngram_join, "CHUNK_GRAMS", chunk)
    monkeypatch.setattr(ngram_join, "CHUNK_HEAVY", heavy)
    rows = near_copies(n)
    found = ngram_components(frame(rows), n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, n, percent)


def test_odd_rows(frame):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, "one two three"), (7, "a b c d"), (8, "a b c d"),
        (9, "x y " * 30_000), (10, "y x " * 30_000), (11, "É b c d"), (12, "é b c d"), (None, "a b c d"),
    ]
    found = ngram_components(frame(rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 4, 85)
    kept = one_of_each(frame(rows), 4, 85).select("doc_id").collect()
    assert Counter(r[0] for r in kept) == Counter([1, 2, 3, 4, 6, 7, 9, 11, 12, None])


def test_empty_and_repeated_ids(frame):
    assert ngram_components(frame([])).collect() == []
    twice = ngram_components(frame([(5, "a b c d e"), (5, "a b c d e"), (6, "a b c d e")])).collect()
    assert sorted(map(tuple, twice)) == [(5, 2, 5), (6, 2, 5)]


def test_tree_finds_what_pairs_find():
    rng = random.Random(5)
    for _ in range(60):
        sets = sorted({tuple(sorted(rng.sample(range(14), rng.randint(1, 9)))) for _ in range(12)})
        arrays = [np.array(s) for s in sets]
        sizes = np.array([len(s) + rng.randint(0, 2) for s in sets])
        tree = Tree(arrays, sizes)
        for q, mine in enumerate(arrays):
            mark = np.zeros(14, np.int8)
            mark[mine] = 1
            found = tree.links(mine, int(sizes[q]), 60, mark, lambda a, b: False)
            wanted = [
                i for i, s in enumerate(sets) if len(set(s) & set(sets[q])) >= least_overlap(int(sizes[i]), int(sizes[q]), 60)
            ]
            assert sorted(found) == wanted


def test_grams_follow_words():
    grams = Grams(2)
    assert len(grams("a b a b")) == 2 and len(grams("a")) == 1 and len(grams(None)) == 0
    assert (grams("A\tb") == grams("a b")).all()
    seen = defaultdict(set)
    for i in range(3_000):
        seen[int(grams(f"w{i}")[0])].add(i)
    assert len(seen) == 3_000
