"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words of a window at the positions that a fixed mask
selects; the words between them may differ. Seeds of benchmark items and of
documents are joined. Around each hit the document is laid over the item at the
hit's offset and compared word by word: an item counts as contained if, in some
stretch of ``SPAN`` aligned words (the whole item if shorter), at least 3/4 are
equal. The masks of each length are chosen so that wherever the allowed words
differ, one mask fits between them (``cover``); so replaced words do not hide a
passage.

Documents are read once. A bitmap of the item seeds, of fixed size and so
broadcast, lets through nearly only documents' real seeds; positions near to
each other become one segment that carries its words as far as the longest item
can reach, so whole texts are never shuffled.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltcast.llm import textbuf as T
from voltcast.llm.bitmap import bitmap, present
from voltcast.llm.connect import written

MASK_WORDS, MASKS = 5, 4                # most words of a mask, and most masks for a length
PLACEMENTS = 5000                       # placements up to which masks are searched for
SPAN = 13
SIMILARITY = (3, 4)
LEAST_WORDS = 5
_U = np.uint64


@lru_cache
def cover(span: int, similarity: tuple[int, int] = SIMILARITY) -> tuple[tuple[int, ...], ...]:
    """Masks (word offsets) of which one, somewhere in ``span`` words, has only equal words wherever the words differ that ``similarity`` allows.

    As many words in a mask as ``MASKS`` masks can cover. Where the placements
    are too many to enumerate, the run of equal words that must be left is the mask.
    """
    differ = span * (similarity[1] - similarity[0]) // similarity[1]
    run = (tuple(range(-(-(span - differ) // (differ + 1)))),)
    if comb(span, differ) > PLACEMENTS:
        return run
    placements = [set(p) for p in combinations(range(span), differ)]
    for size in range(min(MASK_WORDS, span - differ), len(run[0]), -1):
        fits = {}
        for rest in combinations(range(1, span), size - 1):
            mask = (0, *rest)
            fits[mask] = {i for i, p in enumerate(placements) if any(p.isdisjoint(o + at for o in mask) for at in range(span - mask[-1]))}
        left, masks = set(range(len(placements))), []
        while left and len(masks) < MASKS:
            masks.append(max(fits, key=lambda m: (len(fits[m] & left), -m[-1], m)))
            left -= fits[masks[-1]]
        if not left:
            return tuple(masks)
    return run


def _seeds(hashes: np.ndarray, offsets: np.ndarray, mask: tuple[int, ...], number: int):
    """(seed, first word, text) of every window of the mask."""
    span = mask[-1] + 1
    n = np.diff(offsets)
    per = np.maximum(n - span + 1, 0)
    first = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(offsets[:-1], per)
    h = np.full(len(first), number + 1, _U)
    for o in mask:
        h = h * _U(0x9FB21C651E98DF25) + hashes[first + o]
    return T.mix(h), first, np.repeat(np.arange(len(n)), per)


def _best(equal: np.ndarray, span: int, similarity: tuple[int, int]) -> tuple[int, int]:
    """Most equal words in a stretch of ``span`` that is similar enough, and where it starts; (0, 0) if there is none."""
    sums = np.concatenate([[0], np.cumsum(equal)])
    inside = sums[span:] - sums[:-span]
    if not len(inside) or similarity[1] * inside.max() < similarity[0] * span:
        return 0, 0
    at = int(inside.argmax())
    return int(inside[at]), at


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
             span: int = SPAN, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per document key and item it contains.

    Columns: key, item_key, start_word (first word of the best stretch),
    n_matched (equal words over the whole overlap) and n_item (words of the
    item). Words are lower-cased (A-Z) runs of non-white-space.

    Defined cases: null or empty texts contain nothing; items of fewer than
    ``LEAST_WORDS`` words are left out, as they occur by chance; repeated items
    are all reported; rows that share a key (null included) are reported under
    it once per item, best overlap first; other columns are ignored; if either
    table is empty, so is the result.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).cast("string").alias("t"))

    def item_words(batches):
        for batch in batches:
            for at, piece in T.slices(batch.column(1)):
                w = T.Words(piece)
                h = w.hashes()
                own = [h[a:b].tobytes() for a, b in zip(w.offsets[:-1], w.offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(piece)), pa.array(w.counts), pa.array(own, pa.binary())], ["item", "n", "words"])

    words = written(items.mapInArrow(item_words, "item long, n long, words binary").where(F.col("n") >= LEAST_WORDS)
                    .withColumn("number", F.monotonically_increasing_id()), "items")
    reach = words.agg(F.max("n")).first()[0] or 0
    covers = {n: cover(n, similarity) for n in [span, *(r.n for r in words.where(F.col("n") < span).select("n").distinct().collect())]}
    masks = sorted({m for c in covers.values() for m in c})
    longest_mask = max(m[-1] + 1 for m in masks)

    def item_seeds(batches):
        for batch in batches:
            for number, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                h = np.frombuffer(x.as_buffer(), _U)
                for m, mask in enumerate(masks):
                    if mask not in covers[min(n, span)]:
                        continue
                    seed, at, _ = _seeds(h, np.array([0, len(h)]), mask, m)
                    yield pa.RecordBatch.from_pydict({"seed": pa.array(seed.view(np.int64)), "number": pa.array(np.full(len(seed), number)), "at": pa.array(at)})

    seeds = written(words.select("number", "n", "words").mapInArrow(item_seeds, "seed long, number long, at long"), "seeds")
    held = spark.sparkContext.broadcast(bitmap(seeds, "seed"))

    def segments(batches):
        table = held.value
        for batch in batches:
            for at, piece in T.slices(batch.column(1)):
                w = T.Words(piece)
                h = w.hashes()
                found = []
                for m, mask in enumerate(masks):
                    seed, first, doc = _seeds(h, w.offsets, mask, m)
                    hit = present(table, seed)
                    found.append((doc[hit], first[hit], seed[hit]))
                doc, first, seed = (np.concatenate(x) for x in zip(*found))
                if not len(doc):
                    continue
                order = np.lexsort((first, doc))
                doc, first, seed = doc[order], first[order], seed[order]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] - first[:-1] > 2 * reach)])
                begins = np.flatnonzero(new)
                ends = np.append(begins[1:], len(doc))
                lo = np.maximum(first[begins] - reach, w.offsets[doc[begins]])
                hi = np.minimum(first[ends - 1] + reach + longest_mask, w.offsets[doc[begins] + 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[begins] + at)), pa.array(lo - w.offsets[doc[begins]]),
                     pa.array([h[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary()),
                     pa.array([seed[a:b].view(np.int64) for a, b in zip(begins, ends)], pa.list_(pa.int64())),
                     pa.array([first[a:b] - x for a, b, x in zip(begins, ends, lo)], pa.list_(pa.int64()))], ["k", "from", "words", "seed", "at"])

    found = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string"))
    found = written(found.mapInArrow(segments, "k long, from long, words binary, seed array<long>, at array<long>")
                    .withColumn("segment", F.monotonically_increasing_id()), "segments")
    hits = (found.select("segment", F.explode(F.arrays_zip("seed", "at")).alias("x")).select("segment", "x.seed", F.col("x.at").alias("place"))
            .join(seeds, "seed").select("segment", "number", (F.col("place") - F.col("at")).alias("shift")).distinct())

    def compare(batches):
        for batch in batches:
            rows = {"k": [], "item": [], "start_word": [], "n_matched": [], "n_item": []}
            for k, start, x, item, n, y, shift in zip(*[c if c.type == pa.binary() else c.to_pylist() for c in batch.columns]):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                a, b = max(shift, 0), min(shift + len(y), len(x))
                equal = x[a:b] == y[a - shift:b - shift]
                best, at = _best(equal, min(span, n), similarity)
                if best:
                    rows["k"].append(k)
                    rows["item"].append(item)
                    rows["start_word"].append(start + a + at)
                    rows["n_matched"].append(int(equal.sum()))
                    rows["n_item"].append(n)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in rows.items()})

    checked = (hits.join(found.select("segment", "k", "from", F.col("words").alias("x")), "segment")
               .join(words.select("number", "item", "n", F.col("words").alias("y")), "number")
               .select("k", "from", "x", "item", "n", "y", "shift")
               .mapInArrow(compare, "k long, item long, start_word long, n_matched long, n_item long"))
    best = checked.groupBy("k", "item", "n_item").agg(F.max(F.struct("n_matched", (-F.col("start_word")).alias("s"))).alias("m"))
    return best.select(F.col("k").alias(key), F.col("item").alias(item_key), (-F.col("m.s")).alias("start_word"), F.col("m.n_matched").alias("n_matched"), "n_item")


def without(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Documents, columns unchanged, of which no row under their key contains an item."""
    bad = overlaps(docs, items, key, **options).select(F.col(key).alias("_bad")).distinct()
    return docs.join(bad, docs[key].cast("long").eqNullSafe(bad["_bad"]), "left_anti")
