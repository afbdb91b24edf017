"""Ranked lexical search the other way round: documents stream through an index of the queries.

The terms of the items (the queries) form an inverted index, term -> items, that
is broadcast; each task streams its documents through it, adds up the scores of
one slice of texts in one array operation and keeps the best few rows per item.
These bounded heaps are merged in two steps, first in groups of tasks, then per
item. Documents are never shuffled.

A term is a maximal run of characters other than ASCII non-alphanumerics, A-Z
lower-cased. With N texts that have a term, L terms in all texts, n terms in a text, df texts
with the term and tf occurrences in the text: weight w = floor(1000 ln((2N + 2) /
(2 df + 1))), length m = 10 + (90 n N div L), score = sum over the item's terms
of w * (10^9 tf div (1000 tf + 8 m)).

Size of the broadcast: items are dealt into blocks of about ``BLOCK_TERMS``
(item, term) pairs; each block is searched on its own, against all documents.
Terms are told apart by a 64-bit hash.

Defined cases: null and empty texts have no terms and rank nowhere; every row of
the documents is a document, repeated or not; equal scores rank by ascending
key, null keys last; items that share an id are one item with all their terms;
an item without terms, or whose terms no document has, gives no rows; other
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltcast.llm import textbuf as T

K1, B, LENGTH = 8, 90, 100     # saturation (in thousandths of a tf), share of the length in m (in hundredths), and the average m
TOP = 10
BLOCK_TERMS = 1 << 21          # (item, term) pairs in one broadcast: 16 bytes each
CELLS = 1 << 21                # documents x items that are added up at once
MERGE_GROUPS = 64              # tasks whose heaps meet in one group before the last merge
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LAST = np.int64(2**63 - 1)    # stands for a null key, which ranks last


class Index:
    """Inverted index of a block of items: sorted term hashes, and the items of each term."""

    def __init__(self, item: np.ndarray, term: np.ndarray, n_items: int):
        order = np.lexsort((item, term))
        self.terms, first = np.unique(term[order], return_index=True)
        self.items, self.n_items = item[order].astype(np.int32), n_items
        self.bounds = np.append(first, len(order)).astype(np.int64)
        self.near = np.zeros(1 << 20, bool)
        self.near[self.terms >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``hashes`` that are terms, and the numbers of these terms."""
        may = np.flatnonzero(self.near[hashes >> np.uint64(44)])
        number = np.searchsorted(self.terms, hashes[may])
        hit = self.terms[np.minimum(number, len(self.terms) - 1)] == hashes[may]
        return may[hit], number[hit]

    def counts(self, words: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf) of every term of the index in every text, by text."""
        at, term = self.find(words.hashes())
        key, tf = np.unique(words.doc[at] * np.int64(len(self.terms)) + term, return_counts=True)
        return key // len(self.terms), key % len(self.terms), tf


def _terms(column, limit: int = T.SLICE_BYTES):
    for at, piece in T.slices(column, limit):
        yield at, T.Words(piece, blank=_SEPARATOR)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): every distinct term of every item, as a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words in _terms(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(words.doc + at)), pa.array(words.hashes().view(np.int64))], ["item", "term"])

    return items.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "item long, term long").distinct()


def statistics(docs: DataFrame, index) -> tuple[int, int, np.ndarray]:
    """(N, L, df per term of the broadcast index) over all documents; docs has the text in column 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        df, total = np.zeros(len(own.terms), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for _, words in _terms(batch.column(1)):
                total += [np.count_nonzero(words.counts), words.counts.sum()]
                df += np.bincount(own.counts(words)[1], minlength=len(df))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([total, df[held]]))], ["term", "n"])

    found = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(index.value.terms) + 2, np.int64)
    out[found.column("term").to_numpy() + 2] = found.column("n").to_numpy()
    return int(out[0]), int(out[1]), out[2:]


def _better(item: np.ndarray, score: np.ndarray, key: np.ndarray, top: int) -> np.ndarray:
    """Positions of the ``top`` best rows of each item, by item and rank."""
    order = np.lexsort((key, -score, item))
    item = item[order]
    begin = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
    return order[rank < top]


def _heaps(docs: DataFrame, index, weight, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(task, item, key, score): the best rows of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        own, w = index.value, weight.value
        per = np.diff(own.bounds)
        item, score, key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = np.zeros(own.n_items, np.int64)          # a row must reach this score to enter an item's full heap
        step = max(1, CELLS // max(own.n_items, 1))
        for batch in batches:
            keys = batch.column(0).fill_null(int(_LAST)).to_numpy(zero_copy_only=False)
            for at, words in _terms(batch.column(1)):
                text, term, tf = own.counts(words)
                m = np.array([LENGTH - B + B * n * n_docs // n_terms if n else 0 for n in words.counts.tolist()], np.int64)
                gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + K1 * m[text]))
                for low in range(0, len(words.counts), step):
                    a, b = np.searchsorted(text, [low, low + step])
                    times = per[term[a:b]]
                    cell = np.repeat(own.bounds[term[a:b]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    cell = np.repeat((text[a:b] - low) * own.n_items, times) + own.items[cell]
                    total = np.zeros(step * own.n_items, np.int64)
                    np.add.at(total, cell, np.repeat(gain[a:b], times))
                    hit = np.flatnonzero((total > 0) & (total >= np.tile(floor, step)))
                    if not len(hit):
                        continue
                    item = np.concatenate([item, hit % own.n_items])
                    score = np.concatenate([score, total[hit]])
                    key = np.concatenate([key, keys[at + low + hit // own.n_items]])
                    best = _better(item, score, key, top)
                    item, score, key = item[best], score[best], key[best]
                    full = np.bincount(item, minlength=own.n_items) == top
                    floor[item] = np.where(full[item], score, 0)         # of an item's rows the last, its worst, stays
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), part, np.int32)), pa.array(item.astype(np.int32)),
                                          pa.array(key, pa.int64(), mask=key == _LAST), pa.array(score)], ["task", "item", "key", "score"])

    return docs.mapInArrow(run, "task int, item int, key long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` highest-scoring documents of each item: (item, rank, key, score), named as the given key columns."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("t"))
    wanted = item_terms(items, item_key, item_text).persist()
    try:
        blocks = max(1, -(-wanted.count() // BLOCK_TERMS))
        found = None
        for block in range(blocks):
            held = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
            ids = held.column("item").unique()
            if not len(ids):
                continue
            number = pc.index_in(held.column("item"), ids).to_numpy().astype(np.int64)
            term = held.column("term").to_numpy().view(np.uint64)
            index = spark.sparkContext.broadcast(Index(number, term, len(ids)))
            n_docs, n_terms, df = statistics(rows, index)
            weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
            heaps = _heaps(rows, index, spark.sparkContext.broadcast(weight), n_docs, n_terms, top)
            named = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "id": ids}))
            order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
            near = Window.partitionBy("item", F.pmod("task", F.lit(MERGE_GROUPS))).orderBy(*order)
            merged = heaps.withColumn("r", F.row_number().over(near)).where(F.col("r") <= top)
            merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
            part = merged.join(F.broadcast(named), "item").select(F.col("id").alias(item_key), "rank", F.col("key").alias(key), "score")
            found = part if found is None else found.unionByName(part)
    finally:
        wanted.unpersist()
    if found is None:
        return spark.createDataFrame([], f"`{item_key}` long, rank int, `{key}` long, score long")
    return found
