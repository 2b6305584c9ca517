"""Quality rules on repetition: rolling hashes of n-grams of several lengths, and the characters they cover."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import WORD
from claimlens.session import spread

# Fixed values, as published for large web corpora: n-gram length -> largest share of characters inside duplicated n-grams.
DUPLICATE_GRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
# Largest share of characters inside lines that repeat an earlier line.
DUPLICATE_LINES = 0.20
SYMBOLS = "#*$%&|<>"
BASE_WINDOW = 5

_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xBF58476D1CE4E5B9)


def repeated_windows(ids: np.ndarray, n: int, rolled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``n`` ids that occur more than once: all of them, and those after the first occurrence.

    ``rolled`` holds their hashes; equal hashes are compared id by id, so a collision cannot pass for a repeat."""
    order = np.argsort(rolled, kind="stable")
    ordered = rolled[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(ids, n)
    pairs = np.flatnonzero(same)
    if (windows[order[pairs]] == windows[order[pairs + 1]]).all():
        twice = np.zeros(len(order), bool)
        twice[pairs] = twice[pairs + 1] = True
        return order[twice], order[pairs + 1]
    _, first, which, found = np.unique(windows, axis=0, return_index=True, return_inverse=True, return_counts=True)
    which = which.reshape(-1)
    every = np.flatnonzero(found[which] > 1)
    return every, every[first[which[every]] != every]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of ``n`` that begins at one of ``starts``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


class Repetition:
    """Measures of one text; see ``repetition_rules``."""

    def __init__(self, lengths: tuple[int, ...]):
        self.find = re.compile(WORD).findall
        self.lengths = sorted({BASE_WINDOW, *lengths})
        self.symbols = str.maketrans("", "", SYMBOLS)

    def __call__(self, text: str | None) -> dict:
        text = text or ""
        words = self.find(text)
        count = len(words)
        known: dict[str, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, count)
        sizes = np.fromiter(map(len, words), np.int64, count)
        chars = int(sizes.sum())
        shares, repeated = dict.fromkeys(self.lengths, 0.0), 0
        rolled, wide = np.zeros(count, np.uint64), 0
        for n in self.lengths:
            if count < n:
                break
            while wide < n:
                rolled = rolled[: count - wide] * _STEP + (ids[wide:] + np.uint64(1)) * _TURN
                rolled ^= rolled >> np.uint64(29)
                wide += 1
            every, later = repeated_windows(ids, n, rolled)
            if n == BASE_WINDOW:
                repeated = int(covered(every, n, count).sum())
            inside = covered(later, n, count)
            if not len(later):
                if n >= BASE_WINDOW:
                    break  # a longer window repeats only where a shorter one does
                continue
            shares[n] = float(sizes[inside].sum() / chars)
        lines, again, again_chars = set(), 0, 0
        for line in text.split("\n"):
            if line in lines:
                if found := self.find(line):
                    again += 1
                    again_chars += sum(map(len, found))
            else:
                lines.add(line)
        return {
            "n_words": count,
            "word_chars": chars,
            "n_symbols": len(text) - len(text.translate(self.symbols)),
            "n_dup_lines": again,
            "n_repeat_words": repeated,
            "line_share": again_chars / chars if chars else 0.0,
        } | {f"share_{n}": shares[n] for n in self.lengths}


def repetition_rules(
    docs: DataFrame,
    limits: dict[int, float] | None = None,
    line_limit: float = DUPLICATE_LINES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Repetition measures of every whole text and the verdict.

    Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than
    10 words, or more than a fifth of the words in 5-word windows found twice), kept (not base_failed,
    the share of characters inside n-grams that repeat an earlier one within ``limits`` for each length, and
    that inside lines that do within ``line_limit``), line_share and share_n for each length.

    A missing text counts as empty: all measures 0, base_failed. Rows that repeat are judged each;
    an empty table gives no rows; further columns are ignored. Memory: one Arrow batch and one text's arrays."""
    limits = DUPLICATE_GRAMS if limits is None else limits
    lengths = tuple(sorted(limits))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["line_share", *(f"share_{n}" for n in sorted({BASE_WINDOW, *lengths}))]
    kind = docs.schema[doc_id].dataType.simpleString()

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measure = Repetition(lengths)
        for batch in batches:
            found = pd.DataFrame([measure(t) for t in batch["text"]], columns=names + shares)
            found.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield found

    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names) + "".join(f", {c} double" for c in shares)
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = F.col("line_share") <= line_limit
    for n, most in limits.items():
        within &= F.col(f"share_{n}") <= most
    return (
        rows.mapInPandas(measured, schema)
        .withColumns({"base_failed": failed, "kept": ~failed & within})
        .select("doc_id", *names, "base_failed", "kept", *shares)
    )
