"""Counts over a batch of texts that the quality operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from voltcast.llm import textbuf as T

SYMBOLS = b"#*$%&|<>"


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL = byte_class(SYMBOLS)


def symbols(words: T.Words) -> np.ndarray:
    return words.per_text(_SYMBOL[words.raw])


def word_chars(words: T.Words) -> np.ndarray:
    """Code points inside words."""
    return words.per_text(((words.raw & 0xC0) != 0x80) & ~T._WS[words.raw])


def line_counts(piece: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that are equal to an earlier line of the text."""
    n, dup = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
    for i, text in enumerate(piece):
        lines = [x for x in text.as_buffer().to_pybytes().split(b"\n") if x.strip()]
        n[i] = len(lines)
        if len(lines) > 1:
            dup[i] = len(lines) - len(set(lines))
    return n, dup


def repeated_words(words: T.Words, size: int = 8, hashes: np.ndarray | None = None) -> np.ndarray:
    """Words inside windows of ``size`` words that occur twice or more in their text."""
    h, first, doc = T.windows(words.hashes() if hashes is None else hashes, words.offsets, size)
    if not len(h):
        return np.zeros(len(words.counts), np.int64)
    key = h + T.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words.start) + 1, np.int32)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + size, -1)
    return words.per_doc((np.cumsum(cover)[:-1] > 0).astype(np.int64))


def stutters(words: T.Words, hashes: np.ndarray) -> np.ndarray:
    """Words equal to the word before them in the same text."""
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    return words.per_doc(same)
