"""Quality rules as a short-circuit cascade.

Each rule rejects texts by one cheap statistic. On a bounded sample of rows
every rule is timed and its rejections are counted; the cascade then runs the
rules in order of rejections per second, and a rule sees only the texts that
all earlier ones kept. The order changes the time taken, never the verdict: a
text is kept when no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltcast.llm import textbuf as T
from voltcast.llm import textstats as S

SAMPLE_ROWS = 2000
_UPPER = S.byte_class(bytes(range(65, 91)))
_LOWER = S.byte_class(bytes(range(97, 123)))
_DIGIT = S.byte_class(b"0123456789")
_MARK = S.byte_class(b"!?")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def many_symbols(piece: pa.Array) -> np.ndarray:
    """More than a tenth of the characters in words are mark-up symbols."""
    w = T.Words(piece, lower=False)
    return 10 * S.symbols(w) > S.word_chars(w)


def shouting(piece: pa.Array) -> np.ndarray:
    """More than half of the ASCII letters are capitals."""
    w = T.Words(piece, lower=False)
    up, low = w.per_text(_UPPER[w.raw]), w.per_text(_LOWER[w.raw])
    return up > low


def many_marks(piece: pa.Array) -> np.ndarray:
    """More than one exclamation or question mark for every three words."""
    w = T.Words(piece, lower=False)
    return 3 * w.per_text(_MARK[w.raw]) > w.counts


def many_digits(piece: pa.Array) -> np.ndarray:
    """More than half of the characters in words are digits."""
    w = T.Words(piece, lower=False)
    return 2 * w.per_text(_DIGIT[w.raw]) > S.word_chars(w)


def odd_word_length(piece: pa.Array) -> np.ndarray:
    """Mean word length below 2 or above 18 characters."""
    w = T.Words(piece, lower=False)
    mean = _share(S.word_chars(w), w.counts)
    return (mean < 2) | (mean > 18)


def repeated_lines(piece: pa.Array) -> np.ndarray:
    """More than three tenths of at least four lines are equal to an earlier line."""
    n, dup = S.line_counts(piece)
    return (n >= 4) & (10 * dup > 3 * n)


def cell_bars(piece: pa.Array) -> np.ndarray:
    """More than one table bar for every five words."""
    w = T.Words(piece, lower=False)
    return 5 * w.per_text(w.raw == 0x7C) > w.counts


def stutter(piece: pa.Array) -> np.ndarray:
    """More than one word in five is equal to the word before it."""
    w = T.Words(piece, lower=False)
    return 5 * S.stutters(w, w.hashes()) > w.counts


RULES: list[Callable[[pa.Array], np.ndarray]] = [many_symbols, shouting, many_marks, many_digits, odd_word_length,
                                                 repeated_lines, cell_bars, stutter]


def _base_failed(w: T.Words, again: np.ndarray) -> np.ndarray:
    return (w.counts < 20) | (100 * again > 30 * w.counts)


def measured_order(docs: DataFrame, key: str, text: str, rules: list[Callable] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Callable]:
    """Rules by rejections per second on about ``sample_rows`` rows; the given order breaks ties.

    The rows are chosen by a hash of the key and measured where they lie, after
    the base limits, as the cascade meets them; only the sums move.
    """

    def measure(batches):
        rejected, seconds = np.zeros(len(rules), np.int64), np.zeros(len(rules))
        for batch in batches:
            for _, piece in T.slices(batch.column(0)):
                w = T.Words(piece, lower=False)
                piece = piece.take(pa.array(np.flatnonzero(~_base_failed(w, S.repeated_words(w)))))
                for i, rule in enumerate(rules):
                    began = time.process_time()
                    rejected[i] += int(rule(piece).sum()) if len(piece) else 0
                    seconds[i] += time.process_time() - began
        yield pa.RecordBatch.from_pydict({"rule": pa.array(range(len(rules)), pa.int32()), "rejected": rejected, "seconds": seconds})

    every = max(1, docs.count() // sample_rows)
    sample = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(every)) == 0).select(F.col(text).cast("string"))
    seen = sample.mapInArrow(measure, "rule int, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected").alias("r"), F.sum("seconds").alias("s")).collect()
    worth = {x.rule: x.r / max(x.s, 1e-9) for x in seen}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -worth.get(i, 0.0))]


def cascade(piece: pa.Array, ordered: list[Callable]) -> np.ndarray:
    """True for the texts that no rule rejects; each rule runs on what is left."""
    left = np.arange(len(piece))
    for rule in ordered:
        if not len(left):
            break
        left = left[~rule(piece.take(pa.array(left)))]
    kept = np.zeros(len(piece), bool)
    kept[left] = True
    return kept


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Callable] = RULES) -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Texts that fail the base limits (under 20 words, or more than 30 % of the
    words in repeated 8-word windows) are not kept and not sent through the
    cascade. Defined cases: a null text counts as one without words, and fails;
    rows are judged one by one, repeated or not; other columns are ignored; an
    empty table gives an empty result.
    """
    ordered = measured_order(docs, key, text, rules)

    def run(batches):
        for batch in batches:
            for at, piece in T.slices(batch.column(1)):
                w = T.Words(piece, lower=False)
                _, dup = S.line_counts(piece)
                again = S.repeated_words(w)
                failed = _base_failed(w, again)
                kept = np.zeros(len(piece), bool)
                ok = np.flatnonzero(~failed)
                kept[ok] = cascade(piece.take(pa.array(ok)), ordered)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(piece)), *[pa.array(x) for x in (w.counts, S.word_chars(w), S.symbols(w), dup, again, failed, kept)]],
                    ["k", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    schema = "k long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string")).mapInArrow(run, schema).withColumnRenamed("k", key)
