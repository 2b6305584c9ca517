"""Concatenate and cut: documents end to end as one stream of token ids, cut into windows of fixed length.

Two passes give every document its place in the stream. The first turns texts into ids, stores them, and
notes how many ids of the same task stand before each document. The second sums the tasks' totals, so
a document's place is its task's base plus what stood before it in the task; no row is sorted or moved for that.
Where a window's edge falls into a document, the document is cut into pieces: the boundary records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.session import scratch_path, small_side

LENGTH = 1024
END_ID = 0
# What a task looks at at once, and how many chunks of text it remembers the ids of.
SLICE_BYTES = 2 << 20
REMEMBERED = 300_000
REMEMBERED_IDS = 4_000_000
JOINED = 2_000
# Bytes of signs that have been letters, digits, white space or others in every version of Unicode, so that two libraries
# cannot disagree about them: printable ASCII, tab, line feed, and the two-byte signs U+00C0 to U+017F.
PLAIN = bytes([9, 10, *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
# Fixed value: how a byte-level vocabulary of this kind parts a text.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def id_bytes(vocabulary: dict) -> dict[int, bytes]:
    """Bytes of text behind each id of a byte-level tokenizer file."""
    letters = _byte_letters()
    pieces = {n: bytes(map(letters.get, p)) if set(p) <= letters.keys() else p.encode() for p, n in vocabulary["model"]["vocab"].items()}
    return pieces | {x["id"]: x["content"].encode() for x in vocabulary.get("added_tokens", [])}


def ranked(vocabulary: dict) -> dict[bytes, int] | None:
    """(bytes, id) of all pieces if merging by lowest id is merging in the file's order, else None.

    That is so if the n-th merge makes the n-th id after the single bytes and nothing but byte-level rules is asked for."""
    model, vocab = vocabulary["model"], vocabulary["model"]["vocab"]
    plain = vocabulary.get("normalizer") is None and vocabulary["pre_tokenizer"] == {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
    }
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    first = len(vocab) - len(merges) - len([x for x in vocabulary.get("added_tokens", []) if x["content"] in vocab])
    if not plain or model["type"] != "BPE" or first != 256 or any(vocab.get(a + b) != first + n for n, (a, b) in enumerate(merges)):
        return None
    added = {x["id"] for x in vocabulary.get("added_tokens", [])}
    return {piece: n for n, piece in id_bytes(vocabulary).items() if n not in added}


class Encoder:
    """Ids of many texts at once, equal to the tokenizer's own on each whole text.

    A space before a printable ASCII sign always begins a new pre-token of a byte-level BPE, and no merge
    crosses pre-tokens, so texts fall apart there into chunks whose ids do not depend on what is around them.
    Each distinct chunk is given to the tokenizer once. Chunks that begin so are joined for that and parted
    again by the byte lengths of their ids; where that does not come out even, chunks are encoded one by one.
    Chunks of plain signs (``PLAIN``) go to the faster of two libraries that merge alike, where the file's merges are in order of ids."""

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        parsed = json.loads(vocabulary)
        pieces, ranks = id_bytes(parsed), ranked(parsed)
        self.fast = tiktoken.Encoding("plain", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.special = [x["content"].encode() for x in parsed.get("added_tokens", [])]
        self.sizes = np.zeros(max(pieces) + 1, np.int64)
        self.sizes[list(pieces)] = [len(p) for p in pieces.values()]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.store, self.starts, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _one_by_one(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _joined(self, chunks: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(chunks)
        whole = joined.decode("utf-8", "replace")
        if plain and not any(s in joined for s in self.special):
            ids = self.fast.encode_to_numpy(whole, disallowed_special=())
        else:
            ids = np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.uint32)
        ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum([len(c) for c in chunks])
        cuts = np.searchsorted(ends, wanted)
        if cuts[-1] != len(ids) - 1 or not np.array_equal(ends[cuts], wanted):
            return self._one_by_one(chunks)
        return ids, np.diff(cuts, prepend=-1)

    def slots_of(self, chunks: list[bytes]) -> np.ndarray:
        """Where the ids of distinct chunks are stored; those not seen before are encoded."""
        if len(self.slots) > REMEMBERED or len(self.store) > REMEMBERED_IDS:
            self._forget()
        apart, together, plain = [], [], []
        for c in chunks:
            if c not in self.slots:
                if not (len(c) > 1 and c[0] == 32 and 33 <= c[1] <= 126):
                    apart.append(c)
                else:
                    (together if self.fast is None or c.translate(None, PLAIN) else plain).append(c)
        parts = [(apart, *self._one_by_one(apart))] if apart else []
        for kind in (together, plain):
            for start in range(0, len(kind), JOINED):
                part = kind[start : start + JOINED]
                parts.append((part, *self._joined(part, kind is plain)))
        if parts:
            first = len(self.slots)
            self.slots.update((c, first + n) for n, c in enumerate(c for part, _, _ in parts for c in part))
            self.store = np.concatenate([self.store, *[ids for _, ids, _ in parts]])
            self.counts = np.concatenate([self.counts, *[n for _, _, n in parts]])
            self.starts = np.cumsum(self.counts) - self.counts
        return np.fromiter((self.slots[c] for c in chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, place after each text's last id); ``end_id`` closes every text. Null counts as empty."""
        texts = pa.concat_arrays([texts.cast(pa.large_binary()).fill_null(b"")])
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        letters = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        edge = np.zeros(len(letters) + 1, bool)
        edge[:-2] = (letters[:-1] == 32) & (letters[1:] > 32) & (letters[1:] < 127) if len(letters) else False
        edge[bounds] = True
        cuts = np.flatnonzero(edge)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(letters)])
        coded = pieces.dictionary_encode()
        slots = self.slots_of(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.counts[slots]
        upto = np.cumsum(lengths)
        places = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.starts[slots] - upto + lengths, lengths)
        ids = self.store[places]
        ends = np.r_[0, upto][np.searchsorted(cuts, bounds[1:])]
        if end_id is None:
            return ids, ends
        return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most SLICE_BYTES of text each, one row at least."""
    start, held = 0, 0
    for n, size in enumerate(sizes.tolist()):
        if held and held + size > SLICE_BYTES:
            yield start, n
            start, held = n, 0
        held += size + 1
    if start < len(sizes):
        yield start, len(sizes)


def _stored_ids(shared, end_id: int):
    """Task function: (id, text) batches to (part, before, doc_id, doc_tokens, ids as little-endian 32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            encoder = encoder or Encoder(shared.value)
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
            for start, stop in _slices(sizes):
                flat, ends = encoder.encode(texts.slice(start, stop - start), end_id)
                counts = np.diff(ends, prepend=0)
                edges = pa.py_buffer(np.r_[0, ends * 4].astype(np.int32))
                binary = pa.Array.from_buffers(pa.binary(), len(ends), [None, edges, pa.py_buffer(flat.astype("<u4"))])
                rows = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, part)), pa.array(before + ends - counts), ids.slice(start, rows), pa.array(counts), binary],
                    names=["part", "before", "doc_id", "doc_tokens", "ids"],
                )
                before += int(ends[-1])
            del batch, ids, texts
            pa.default_memory_pool().release_unused()

    return run


def stored_ids(docs: DataFrame, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first pass, written to the shared folder: a rerun of the second pass meets the same parts and places."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"part long, before long, doc_id {kind}, doc_tokens long, ids binary"
    path = scratch_path(spark, "ids")
    made = rows.mapInArrow(_stored_ids(spark.sparkContext.broadcast(vocabulary), end_id), schema)
    made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def bases(stored: DataFrame) -> DataFrame:
    """(part, base): how many ids all earlier parts hold. One row per task of the first pass reaches the window."""
    totals = stored.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    upto = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(upto, F.lit(0)).alias("base"))


def _slice_of(start: Column, length: Column) -> Column:
    return F.call_function("substring", F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))


def pack(
    docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", *, digest: bool = False
) -> DataFrame:
    """Pieces of all documents in windows of ``length`` ids; ``vocabulary`` is a tokenizer file's JSON.

    Returns ``doc_id``, ``start`` (ids of the document before the piece), ``length``, ``doc_tokens``
    (with the closing ``end_id``), ``sequence_id``, ``offset`` (in the sequence, gapless from 0), and ``ids``
    (little-endian 32-bit numbers), or with ``digest`` their CRC-32 as ``ids_crc32``. Only the last sequence can be short.

    A missing or empty text is the closing id alone; rows without an id and repeated rows are packed like any other; an
    empty table gives no rows; further columns are ignored. A text's ids lie in one row, and a piece in at most ``length``."""
    stored = stored_ids(docs, vocabulary, end_id, doc_id, text)
    placed = stored.join(small_side(bases(stored)), "part").withColumn("place", F.col("base") + F.col("before"))
    last = F.floor((F.col("place") + F.col("doc_tokens") - 1) / length)
    first = F.floor(F.col("place") / length)

    def piece(window: Column) -> Column:
        start = F.greatest(F.lit(0), window * length - F.col("place"))
        stop = F.least(F.col("doc_tokens"), (window + 1) * length - F.col("place"))
        held = _slice_of(start, stop - start)
        return F.struct(
            start.cast("long").alias("start"),
            (stop - start).cast("long").alias("length"),
            window.cast("long").alias("sequence_id"),
            (F.col("place") + start - window * length).cast("long").alias("offset"),
            F.crc32(held).alias("ids_crc32") if digest else held.alias("ids"),
        )

    pieces = placed.select("doc_id", "doc_tokens", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids_crc32" if digest else "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, n_ids, ids): the packed windows, from ``pack``'s pieces. At most ``length`` ids meet in a group.

    The last window is padded with ``pad_id`` to ``length`` ids, except where the number of its ids is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_ids"))
    joined = F.aggregate(F.transform("parts", lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    even = (F.col("n_ids").bitwiseAND(F.col("n_ids") - 1)) == 0
    size = (F.when(even, F.col("n_ids")).otherwise(length) * 4).cast("int")
    return whole.select("sequence_id", "n_ids", F.call_function("rpad", joined, size, F.lit(pad_id.to_bytes(4, "little"))).alias("ids"))
