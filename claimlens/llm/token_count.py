"""Token counts without tokens: the best unigram segmentation's score and piece count by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.session import spread

# Fixed values of the tokenizer: white space mark, penalty of an unknown character below the worst piece.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
WORDS_KEPT = 500_000
LONGEST_KEPT = 64


def read_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """The (piece, score) list of a sentencepiece model file, in order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class PieceCounter:
    """Counts the pieces of a unigram model's best segmentation of a text.

    An Aho-Corasick automaton lists the vocabulary's matches by their end, the longest first. Each place
    keeps the best score of the text up to it, the number of pieces on that path, and whether its
    last piece is unknown. Ties go to the piece that starts first, as in the tokenizer, which
    replaces a path only by a better one. An unknown character is a piece of its own (runs are fused
    into one), or its UTF-8 bytes if the vocabulary has a piece for every byte of the run."""

    def __init__(self, vocabulary: list[tuple[str, float]], unk_id: int = 0, byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(p) for p, _ in vocabulary)
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        self.bytes = {i for i in range(256) if f"<0x{i:02X}>" in pieces} if byte_fallback else set()
        self.split = re.compile(f"{MARK}?[^{MARK}]*").findall
        self.known: dict[str, tuple[int, int, float]] = {}

    def best(self, word: str) -> tuple[int, int, float]:
        """(pieces, of them unknown or bytes, score) of one pre-token. Only the last ``longest`` places are held."""
        width = self.longest + 1
        # Per place: score, pieces, unknown pieces, then of the unknown run that ends here: its length and bytes.
        ring = [(0.0, 0, 0, 0, 0, True)] + [None] * self.longest
        end, found = 0, []
        matches = self.automaton.iter(word)
        match = next(matches, None)
        for at, char in enumerate(word):
            best, single = None, False
            while match is not None and match[0] == at:
                size, score = match[1]
                before = ring[(at + 1 - size) % width]
                total = score + before[0]
                if best is None or total > best[0]:
                    best = (total, before[1] + 1, before[2], 0, 0, True)
                single |= size == 1
                match = next(matches, None)
            if not single:
                before = ring[at % width]
                total = self.unknown + before[0]
                if best is None or total > best[0]:
                    raw = char.encode("utf-8", "surrogatepass")
                    spelled = (before[5] or not before[3]) and all(b in self.bytes for b in raw)
                    run, size = before[3] + 1, before[4] + len(raw)
                    # The run's pieces so far are taken back and counted anew: its bytes, or one unknown piece.
                    was = 0 if not before[3] else before[4] if before[5] else 1
                    now = size if spelled else 1
                    best = (total, before[1] - was + now, before[2] - was + now, run, size, spelled)
            ring[(at + 1) % width] = best
        score, pieces, unknown = ring[len(word) % width][:3]
        return pieces, unknown, score

    def count(self, text: str | None) -> tuple[int, int, float]:
        """(pieces, of them unknown or bytes, score) of a text: blanks become marks, one is put in front, and every mark starts a pre-token."""
        if not text:
            return 0, 0, 0.0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        pieces = unknown = 0
        score = 0.0
        for word in self.split(marked):
            if not word:
                continue
            found = self.known.get(word)
            if found is None:
                found = self.best(word)
                if len(word) <= LONGEST_KEPT:
                    if len(self.known) >= WORDS_KEPT:
                        self.known.clear()
                    self.known[word] = found
            pieces += found[0]
            unknown += found[1]
            score += found[2]
        return pieces, unknown, score


def token_counts(
    docs: DataFrame, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_tokens, n_unknown (unknown pieces or bytes among them), score of the best segmentation.

    The vocabulary is a tokenizer's, of fixed size, and is sent to every task once. A missing or
    empty text has no tokens; rows that repeat are counted each; an empty table gives no rows;
    further columns are ignored. A text is read word by word; words are remembered up to a bound."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, byte_fallback))
    kind = docs.schema[doc_id].dataType.simpleString()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, fallback = shared.value
        counter = PieceCounter(pieces, byte_fallback=fallback)
        for batch in batches:
            found = pd.DataFrame([counter.count(t) for t in batch["text"]], columns=["n_tokens", "n_unknown", "score"])
            found.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield found

    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return rows.mapInPandas(counted, f"doc_id {kind}, n_tokens long, n_unknown long, score double")
