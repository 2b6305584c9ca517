import random
import re

import numpy as np
import pytest

from claimlens.llm import quality, toxicity
from claimlens.llm.toxicity import SYMBOLS, Decoder, log_probabilities, symbol_table, symbols_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def judged(scores, labels, label):
    rows = scores.where("held_out").join(labels.select("doc_id", label), "doc_id").collect()
    right = [r["predicted"] == r[label] for r in rows]
    return sum(right) / len(right), rows


def test_quality_on_held_out_rows(given):
    docs, labels = given
    model = quality.train(docs, labels)
    assert model.rules
    accuracy, rows = judged(quality.quality_scores(docs, model), labels, "quality")
    assert accuracy >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality.quality_scores(docs, model).where("predicted = 1").count()


def test_toxicity_on_held_out_rows(given):
    docs, labels = given
    accuracy, rows = judged(toxicity.toxicity_scores(docs, toxicity.train(docs, labels)), labels, "toxic")
    assert accuracy >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def odd(frame):
    return frame([(1, None), (2, ""), (3, "w " * 50_000), (None, "x"), (4, "same"), (4, "same"), (5, "1 | $$ !!")])


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(None, 1), (4, None), (99, 0)], [(3, 0), (3, 1), (6, 0)]])
def test_few_labels(frame, rows):
    docs, labels = odd(frame), frame(rows, "doc_id long, mark int")
    for scores in (
        quality.quality_scores(docs, quality.train(docs, labels, "mark")),
        toxicity.toxicity_scores(docs, toxicity.train(docs, labels, "mark")),
    ):
        found = scores.collect()
        assert len(found) == 7 and all(0 < r["score"] < 1 for r in found)
        assert scores.limit(0).collect() == []


def test_no_documents(frame):
    docs, labels = frame([]), frame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.quality_scores(docs, quality.train(docs, labels)).collect() == []
    toxic = labels.withColumnRenamed("quality", "toxic")
    assert toxicity.toxicity_scores(docs, toxicity.train(docs, toxic)).collect() == []


def test_a_compiled_rule(frame):
    model = quality.RuleModel(-1.0, [((("n_words", False, 2.0), ("upper", True, 0.5)), 3.0)])
    rows = {r["doc_id"]: r["score"] for r in quality.quality_scores(frame([(1, "a b c"), (2, "A B C D"), (3, None)]), model).collect()}
    assert rows[1] == pytest.approx(1 / (1 + np.exp(-2))) and rows[3] == pytest.approx(1 / (1 + np.exp(1)))
    assert rows[2] == rows[3]  # 4 of 7 characters are capitals, so the rule does not hold


@pytest.fixture(scope="module")
def decoder():
    text = "you are an idiot and a moron they said worthless trash is disgusting this loser is stupid pathetic scum the clown " * 20
    table, counts = symbol_table(), np.zeros((SYMBOLS,) * 3)
    s = symbols_of(f"  {text}  ", table)
    np.add.at(counts, (s[:-2], s[1:-1], s[2:]), 1)
    return Decoder(log_probabilities(counts))


@pytest.mark.parametrize(
    "seen, read",
    [
        ("m0r0n", "moron"), ("1d10t", "idiot"), ("i d i o t", "idiot"), ("w.o.r.t.h.l.e.s.s", "worthless"), ("stuuuupid", "stupid"),
        ("tr@sh", "trash"), ("p@thet1c", "pathetic"), ("$cum", "scum"), ("CL0WN!!", "clown"), ("plain words", "plain words"),
        ("tree book", "tree book"), ("12 345", ""), ("", ""),
    ],
)
def test_restored(decoder, seen, read):
    assert decoder.words(seen).strip() == read


def test_viterbi_is_the_best_of_all_readings(decoder):
    def total(choices):
        a = b = 0
        score, read = 0.0, ""
        for c, cost in choices:
            score += cost
            if c:
                n = decoder.number.get(c, SYMBOLS - 1)
                score += float(decoder.model[a, b, n])
                a, b, read = b, n, read + c
        return score + float(decoder.model[a, b, 0]), read

    rng = random.Random(3)
    for _ in range(60):
        span = "".join(rng.choice("idot10@.s$ 3") for _ in range(rng.randint(1, 7)))
        readings = [[]]
        for choices in decoder.lattice(span):
            readings = [r + [c] for r in readings for c in choices]
        best = max(total(r)[0] for r in readings)
        assert any(abs(total(r)[0] - best) < 1e-6 and total(r)[1] == decoder.best(span) for r in readings)


def test_long_disguises_are_read_in_one_pass(decoder):
    assert len(decoder.words("a b " * 30_000)) > 10_000
    assert decoder.words("x" * 100_000).strip()
    assert re.fullmatch(" *", decoder.words("@" * 100_000))
