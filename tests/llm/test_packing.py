import zlib

import numpy as np
import pyarrow as pa
import pytest

from claimlens.llm import packing
from claimlens.llm.packing import Encoder, pack, sequences
from claimlens.llm.queries import packing_vocabulary

ODD = [
    "", None, " ", "  a", "a  ", "\n\n a", "a  b  c", "x<|endoftext|> y <|endoftext|>", "don't  we'll", "é" * 50 + " ü a",
    "\x1c a \x1c", "日本 語 a", "a  b", "  c", "1 2 34 5", "🙂 ok", "a Ü×3 ÷ Åſ ÿ żó\u00a0x \u00b5", "tab\t x", "same words", "same words", "w " * 4000, "y" * 9000,
]


@pytest.fixture(scope="module")
def vocabulary():
    return packing_vocabulary()


@pytest.fixture(scope="module")
def plain(vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_are_those_of_the_whole_text(spark, sf, vocabulary, plain):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    encoder = Encoder(vocabulary)
    for start in range(0, len(texts), 70):
        part = texts[start : start + 70]
        ids, ends = encoder.encode(pa.array(part, pa.string()).slice(0), 0)
        for text, own in zip(part, np.split(ids, ends[:-1])):
            assert own.tolist() == plain(text)
    sliced, _ = encoder.encode(pa.array(["skipped", "x y", None])[1:], None)
    assert sliced.tolist() == plain("x y")[:-1]


def test_memory_is_bounded(vocabulary, plain, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    monkeypatch.setattr(packing, "JOINED", 2)
    encoder = Encoder(vocabulary)
    for text in ("one two three four five six", "one seven eight nine ten", "two one"):
        assert encoder.encode(pa.array([text]), 0)[0].tolist() == plain(text)


def whole(pieces):
    """doc order and ids per document and sequence from collected pieces, checking every promise."""
    docs, windows = {}, {}
    for r in pieces:
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    return docs, windows


@pytest.mark.parametrize("length", [7, 64, 1024])
def test_pieces(frame, vocabulary, plain, length):
    rows = list(enumerate(ODD)) + [(None, "no id"), (300, "a b"), (301, "c")]
    pieces = pack(frame(rows), vocabulary, length).collect()
    docs, windows = whole(pieces)
    assert sorted(windows) == list(range(len(windows)))
    for number, parts in windows.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and 0 < r["length"] == len(r["ids"]) // 4
            at += r["length"]
        assert at == length or number == len(windows) - 1
    for doc_id, text in rows:
        parts = sorted((r for r in pieces if r["doc_id"] == doc_id), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in parts) == np.array(plain(text), "<u4").tobytes()
        assert all(r["doc_tokens"] == len(plain(text)) for r in parts)
        assert [r["start"] for r in parts] == list(np.cumsum([0, *[r["length"] for r in parts]])[:-1])
    assert sum(r["length"] for r in pieces) == sum(len(plain(t)) for _, t in rows)


def test_digests_and_repeated_rows(frame, vocabulary, plain):
    rows = [(1, "same same")] * 3 + [(2, "x " * 900)]
    pieces = pack(frame(rows).repartition(3), vocabulary, 512, digest=True).collect()
    wanted = plain("x " * 900)
    for r in pieces:
        own = (wanted if r["doc_id"] == 2 else plain("same same"))[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    assert sum(r["length"] for r in pieces if r["doc_id"] == 1) == 3 * len(plain("same same"))


def test_sequences(frame, vocabulary, plain):
    rows = [(n, f"text number {n}") for n in range(40)]
    made = sequences(pack(frame(rows), vocabulary, 32), 32).orderBy("sequence_id").collect()
    total = sum(len(plain(t)) for _, t in rows)
    assert sum(r["n_ids"] for r in made) == total
    assert all(len(r["ids"]) == 128 for r in made[:-1])
    last = made[-1]["n_ids"]
    assert len(made[-1]["ids"]) == 4 * (last if last & (last - 1) == 0 else 32)
    four = sequences(pack(frame([(1, "a b c")]), vocabulary, 32), 32).first()
    assert four["n_ids"] == 4 and len(four["ids"]) == 16


def test_empty(frame, vocabulary):
    assert pack(frame([]), vocabulary).collect() == []
    only = pack(frame([(1, None)]), vocabulary).collect()
    assert [(r["length"], r["doc_tokens"], bytes(r["ids"])) for r in only] == [(1, 1, b"\0\0\0\0")]
