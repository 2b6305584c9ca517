from fractions import Fraction

import pytest

from claimlens.llm.mixture import mix

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), repeats=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed, free = share * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(fixed.values())
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > repeats * sizes[s]}
        if not above:
            return {s: float(fixed[s] if s in fixed else level * weight[s]) for s in order}
        fixed |= {s: repeats * sizes[s] for s in above}
        free -= above
    return {s: float(fixed[s]) for s in order}


ROWS = (
    [(i, "a b c " * (i % 5), "big") for i in range(60)]
    + [(100 + i, "w " * 40, "b") for i in range(5)]
    + [(200, None, "c"), (201, "", "c"), (202, "one", None), (None, "two words", None), (None, None, None)]
    + [(300, "same row", "d")] * 4
    + [(301, "tie x", "e"), (302, "tie y", "e"), (303, "long " * 3000, "é")]
)


@pytest.mark.parametrize("rows_per_range", [2, 7, 100_000])
def test_budgets(frame, rows_per_range):
    found = mix(frame(ROWS, SCHEMA), rows_per_range=rows_per_range, carry=("source",)).collect()
    assert len(found) == len(ROWS)
    sizes = {}
    for _, text, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    wanted = brute_targets(sizes)
    for source, size in sizes.items():
        mine = [r for r in found if r["source"] == source]
        assert all(r["source_size"] == size and abs(r["target"] - wanted[source]) < 1e-6 for r in mine)
        assert sum(r["taken"] for r in mine) == int(wanted[source] + 1e-9)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)


def test_reruns_and_layouts_agree(frame):
    a = sorted(map(str, mix(frame(ROWS, SCHEMA)).collect()))
    b = sorted(map(str, mix(frame(ROWS[::-1], SCHEMA).repartition(5)).collect()))
    c = sorted(map(str, mix(frame(ROWS, SCHEMA), rows_per_range=3).collect()))
    assert a == b
    assert [x.split("taken")[0] for x in a] == [x.split("taken")[0] for x in c]


def test_empty(frame):
    assert mix(frame([], SCHEMA)).collect() == []
    only = mix(frame([(1, None, None), (2, "", "s")], SCHEMA)).collect()
    assert [r["taken"] for r in only] == [0, 0]


def test_carried_columns(frame):
    found = mix(frame(ROWS, SCHEMA), carry=("doc_id", "text", "source")).where("doc_id = 303").first()
    assert found["text"].startswith("long long") and found["source"] == "é"
