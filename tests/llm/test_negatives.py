import numpy as np
import pytest

from claimlens.llm import negatives
from claimlens.llm.negatives import Tree, build_index, hard_negatives, matrix, products

SCHEMA = "id long, label long, vector array<long>"


def brute(rows, anchors, n_positives=5, n_negatives=3):
    rows = list({(i, l, tuple(v)): None for i, l, v in rows if None not in (i, l) and v is not None})
    anchors = list({(i, l, tuple(v)): None for i, l, v in anchors if None not in (i, l) and v is not None})
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in anchors:
        scored = sorted((-score(a[2], r[2]), r[0], r) for r in rows if r != a)
        positives = [(-s, i) for s, i, r in scored if r[1] == a[1]][:n_positives]
        for ps, p in positives:
            fits = [(-s, i) for s, i, r in scored if r[1] != a[1] and 50 * ps <= 100 * -s <= 95 * ps][:n_negatives]
            out += [(a[0], p, k + 1, n, ps, ns) for k, (ns, n) in enumerate(fits)]
    return sorted(out)


def clustered(n, width=12, seed=3, spread=8):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-100, 100, (7, width))
    x = centres[rng.integers(0, 7, n)] + rng.integers(-spread, spread + 1, (n, width))
    return [(int(i), int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("shape", [{}, {"leaf_rows": 8, "fanout": 4}, {"leaf_rows": 16, "fanout": 3, "sample_rows": 60, "group_rows": 40}])
def test_against_brute_force(frame, shape):
    rows = clustered(400)
    rows += [(1000 + n, n % 2, rows[5][2]) for n in range(60)]  # a hot vector
    rows += rows[:9]  # exact repeats
    rows += [(7, 3, rows[50][2]), (2000, None, [1]), (2001, 1, None), (None, 1, [1]), (2002, 1, []), (2003, 2, [5]), (2004, 0, [3] * 20)]
    anchors = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    table = frame(rows, SCHEMA)
    found = hard_negatives(table, table.where("id % 10 = 0"), batch_anchors=11, **shape)
    assert sorted(map(tuple, found.collect())) == brute(rows, anchors)


def test_nothing_to_find(frame):
    empty = frame([], SCHEMA)
    assert hard_negatives(empty, empty).collect() == []
    one = frame([(0, 1, [1, 2])], SCHEMA)
    assert hard_negatives(one, one).collect() == []
    ties = [(i, i % 2, [1, 1]) for i in range(12)] + [(50 + i, 3, [0, 0]) for i in range(4)] + [(90, 3, [2, 0]), (91, 3, [1, 0])]
    table = frame(ties, SCHEMA)
    assert sorted(map(tuple, hard_negatives(table, table).collect())) == brute(ties, ties)


def test_subtrees_are_left_out(frame, monkeypatch):
    rows = clustered(600, spread=2)
    index = build_index(frame(rows, SCHEMA), leaf_rows=16, fanout=7)
    anchors = matrix([v for _, _, v in rows[:50]]).astype(float)
    best = np.sort(anchors @ matrix([v for _, _, v in rows]).T.astype(float), axis=1)[:, -6:-5]
    held = index.tree.reached(anchors, best, np.full_like(best, np.inf))
    pairs = sum(map(len, held.values()))
    assert index.tree.leaves > 20 and pairs < 0.3 * len(anchors) * index.tree.leaves
    leaf = index.tree.leaf_of(matrix([v for _, _, v in rows]).astype(float))
    scores = anchors @ matrix([v for _, _, v in rows]).T
    for a, v in zip(*np.nonzero(scores >= best)):
        assert a in held[int(leaf[v])]
    for number, who in held.items():
        assert np.array_equal(index.tree.reach(number, anchors, best, np.full_like(best, np.inf)), who)


def test_exact_products():
    big = np.array([[2**31 + 1, 3]], np.int64)
    assert products(big, big)[0, 0] == (2**31 + 1) ** 2 + 9
    assert products(np.array([[1, 2, 3]]), np.array([[4, 5]]))[0, 0] == 14


def test_tree_of_copies():
    tree = Tree.fit(matrix([[1, 2]] * 50), 8)
    assert tree.leaves == 1 and tree.leaf_of(np.ones((3, 2))).tolist() == [0, 0, 0]
    assert negatives.MAX_LEAVES >= 8
