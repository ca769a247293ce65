"""Counts of whole texts, for all rows of an Arrow batch at once."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from codeloom.llm.common import byte_view
from codeloom.llm.words import IS_SPACE, Words, mix, runs_of, windows

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
# bytes a sentence may end with; the others are the last bytes of closing quotes and of full stops of other scripts
SENTENCE_ENDS = (".", "!", "?", ":", ";", "…", "\"", "'", ")", "”", "’", "»", "。", "！", "？")


def table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


IS_SYMBOL = table(SYMBOLS)
IS_UPPER = table(bytes(range(65, 91)))
IS_LOWER = table(bytes(range(97, 123)))
IS_DIGIT = table(b"0123456789")
IS_START = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def ends_sentence(data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the run [start, end) ends with one of the SENTENCE_ENDS."""
    out = np.zeros(len(ends), bool)
    for mark in SENTENCE_ENDS:
        code = mark.encode()
        fits = ends - starts >= len(code)
        for k, byte in enumerate(reversed(code), 1):
            fits &= data[np.maximum(ends - k, 0)] == byte
        out |= fits
    return out


class Stats:
    """Statistics by row; all arrays have a value for each row unless they say otherwise."""

    def __init__(self, texts):
        self.data, self.offsets = byte_view(texts)
        self.n = len(self.offsets) - 1

    @cached_property
    def bytes(self) -> np.ndarray:
        """How often each byte occurs in each row: a row of 256 numbers."""
        out = np.zeros((self.n, 256), np.int64)
        for row in np.flatnonzero(self.offsets[1:] > self.offsets[:-1]):
            out[row] = np.bincount(self.data[self.offsets[row]:self.offsets[row + 1]], minlength=256)
        return out

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are in a table of bytes."""
        return self.bytes[:, flags].sum(axis=1)

    def by_row(self, row: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(row, weights, self.n) if weights is not None else np.bincount(row, minlength=self.n)

    @cached_property
    def _runs(self) -> list[Words]:
        return runs_of(self.data, self.offsets, (IS_SPACE, NEWLINE))

    @property
    def words(self) -> Words:
        return self._runs[0]

    @property
    def lines(self) -> Words:
        """Lines that are not empty, split at newlines only."""
        return self._runs[1]

    @cached_property
    def line_of_word(self) -> np.ndarray:
        return np.searchsorted(self.lines.start, self.words.start, "right") - 1

    @cached_property
    def line_words(self) -> np.ndarray:
        """Words of each line."""
        return np.bincount(self.line_of_word, minlength=len(self.lines.row))

    @cached_property
    def line_last(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the last word of each line; equal numbers if it has none."""
        start, end = np.zeros(len(self.lines.row), np.int64), np.zeros(len(self.lines.row), np.int64)
        start[self.line_of_word], end[self.line_of_word] = self.words.start, self.words.end
        return start, end

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.by_row(self.words.row)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.count(IS_START & ~IS_SPACE)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(IS_SYMBOL)

    @cached_property
    def line_repeats(self) -> np.ndarray:
        """Whether each line has a word and equals an earlier line of its row."""
        flags = self.line_words > 0
        idx = np.flatnonzero(flags)
        _, first = np.unique(mix(self.lines.hash[idx] + self.lines.row[idx].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        flags[idx[first]] = False
        return flags

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self.by_row(self.lines.row[self.line_repeats])

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words that lie in a run of 8 words found twice or more in the row."""
        w = self.words
        first, key = windows(w.hash, w.row, WINDOW)
        key = mix(key + w.row[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hits = first[order[twice]]
        covered = np.zeros(len(w.row), bool)
        for k in range(WINDOW):
            covered[hits + k] = True
        return self.by_row(w.row[covered])
