import random

import pandas as pd

from claimlens.llm.common import Words, connected, runs


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 700)]
    links += [(rng.randrange(1_000, 1_200), rng.randrange(1_000, 1_200)) for _ in range(120)] + [(7, 7), (3, 2), (2, 3)]
    rng.shuffle(links)
    part = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and part[a] != part[b]:
                part[a] = part[b] = min(part[a], part[b])
                changed = True
    for pieces in (1, 13):
        frame = spark.createDataFrame(links, "a long, b long").repartition(pieces)
        found = connected(frame).collect()
        assert len(found) == len(part) and {r["id"]: r["component"] for r in found} == part
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_runs_over_batches():
    batches = [pd.DataFrame({"k": [1, 1], "v": [1, 2]}), pd.DataFrame({"k": [], "v": []}), pd.DataFrame({"k": [1, 2], "v": [3, 4]}), pd.DataFrame({"k": [2], "v": [5]})]
    assert [(int(g["k"].iloc[0]), [int(v) for v in g["v"]]) for g in runs(iter(batches), ["k"])] == [(1, [1, 2, 3]), (2, [4, 5])]


def test_words_split_like_the_contract():
    words = Words()
    a, b = words.lowered("A b\x0bc\x1cd é f"), words.lowered("a\tB \n c\x1cd é f ")
    assert len(a) == 4 and (a == b).all()
    assert len(set(words.lowered(" ".join(map(str, range(5_000)))).tolist())) == 5_000
