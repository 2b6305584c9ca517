import random

import pytest

from claimlens.llm.token_count import PieceCounter, read_vocabulary, token_counts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def library(vocabulary, byte_fallback):
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    made.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(MODEL)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_like_the_library(spark, sf, vocabulary, byte_fallback):
    count, counter = library(vocabulary, byte_fallback), PieceCounter(vocabulary, byte_fallback=byte_fallback)
    rng = random.Random(2)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choice("ab c  déß\n\t▁日本<0x41> theing<s>🙂🙃́") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    assert [counter.count(t)[0] for t in texts] == [count(t) for t in texts]


def test_ties_like_the_library():
    rng = random.Random(4)
    for _ in range(60):
        pieces = {"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        small = [("<unk>", 0.0), *((p, -float(rng.randint(1, 3))) for p in sorted(pieces))]
        count, counter = library(small, False), PieceCounter(small, byte_fallback=False)
        for _ in range(30):
            text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 15)))
            assert counter.count(text)[0] == count(text), (small, text)


def test_rows(frame, vocabulary):
    long = "nospace" * 40_000
    rows = [(1, None), (2, ""), (3, "the the"), (3, "the the"), (None, "the"), (4, long)]
    found = sorted(((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts(frame(rows), vocabulary).collect()))
    counter = PieceCounter(vocabulary)
    assert found == sorted((i or 0, counter.count(t)[0]) for i, t in rows)
    assert token_counts(frame([]), vocabulary).collect() == []
