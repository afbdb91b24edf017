"""Quality classifier by Bradley-Terry pairwise ranking.

Each text has a utility w . x over style features. All labelled rows are dealt
by a hash into blocks; in its block every row of the larger class stands in
``PAIRS_PER_ROW`` preference pairs (a text labelled good is preferred to one
labelled bad), every row of the other in at least as many, and w minimises the
logistic loss of the feature differences of all pairs. The threshold is the
utility quantile at the bad share of all labelled rows; a utility at
the threshold is mapped to ``CUT`` by the logistic curve.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltcast.llm import logistic as L
from voltcast.llm import textbuf as T
from voltcast.llm import textstats as S
from voltcast.llm.connect import written

CUT = 0.3
PAIRS_PER_ROW = 20
BLOCK_ROWS = 256                           # rows of the smaller class in a block, about
_UPPER = S.byte_class(bytes(range(65, 91)))
_LETTER = S.byte_class(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT = S.byte_class(b"0123456789")
_MARK = S.byte_class(b"!?")
_STOP = S.byte_class(b".,;:")


def features(piece: pa.Array) -> np.ndarray:
    """Style features of each text, all between 0 and 1."""
    w = T.Words(piece, lower=False)
    h = w.hashes()
    n, chars = np.maximum(w.counts, 1), np.maximum(S.word_chars(w), 1)
    lines, dup = S.line_counts(piece)
    key = h + T.mix(w.doc.astype(np.uint64) + np.uint64(1))
    distinct = np.bincount(w.doc[np.unique(key, return_index=True)[1]], minlength=len(piece))

    def part(flags, whole):
        return np.minimum(w.per_text(flags[w.raw]) / whole, 1.0)

    return np.column_stack([
        part(S._SYMBOL, chars), part(_UPPER, np.maximum(w.per_text(_LETTER[w.raw]), 1)), part(_MARK, n), part(_DIGIT, chars),
        part(_STOP, n), np.minimum(w.per_text(w.raw == 0x7C) / n, 1.0), dup / np.maximum(lines, 1), S.repeated_words(w, hashes=h) / n,
        S.stutters(w, h) / n, 1 - distinct / n, np.minimum(chars / n / 20, 1.0), np.minimum(np.log1p(w.counts) / 12, 1.0),
        np.minimum(w.counts / np.maximum(lines, 1) / 200, 1.0), (w.counts < 20).astype(float)])


@dataclass
class Model:
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return L.sigmoid(x @ self.weights - self.threshold + np.log(CUT / (1 - CUT)))


def _differences(x: np.ndarray, y: np.ndarray, seed: list[int]) -> np.ndarray:
    """Good minus bad over the pairs of a block: each row in turn, in a new order each time."""
    rng = np.random.default_rng(seed)
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return np.zeros((0, x.shape[1]))
    m = PAIRS_PER_ROW * max(len(good), len(bad))
    turns = lambda n: np.concatenate([rng.permutation(n) for _ in range(-(-m // n))])[:m]
    return good[turns(len(good))] - bad[turns(len(bad))]


def fit(sample: DataFrame, l2: float = 1e-4, seed: int = 7) -> Model:
    """Fit on the (k, t, y) rows of ``logistic.labelled_sample``; rows of one class only score every text alike."""
    width = features(pa.array([""], pa.large_string())).shape[1]

    def rows(batches):
        for batch in batches:
            for at, piece in T.slices(batch.column(1)):
                yield pa.RecordBatch.from_pydict({"k": batch.column(0).slice(at, len(piece)), "y": batch.column(2).slice(at, len(piece)),
                                                  "x": pa.array(list(features(piece)), pa.list_(pa.float64()))})

    got = written(sample.select(F.col("k").cast("string"), "t", "y").mapInArrow(rows, "k string, y int, x array<double>"), "labelled")
    sizes = {r.y: r["count"] for r in got.groupBy("y").count().collect()}
    n_good, n_bad = sizes.get(1, 0), sizes.get(0, 0)
    if not n_good or not n_bad:
        return Model(np.zeros(width), 4.0 if n_bad else -4.0)
    count = max(1, min(n_good, n_bad) // BLOCK_ROWS)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        return pa.table({"block": table.column("block").slice(0, 1), "x": pa.array([np.array(table.column("x").to_pylist()).tobytes()], pa.binary()),
                         "y": pa.array([table.column("y").to_numpy().astype(np.int8).tobytes()], pa.binary())})

    blocks = got.where("y in (0, 1)").withColumn("block", F.pmod(F.xxhash64("k"), F.lit(count)).cast("int")).groupBy("block").applyInArrow(pack, "block int, x binary, y binary")
    blocks = written(blocks, "blocks")

    def sums(w: np.ndarray) -> np.ndarray:
        def of(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(1 + width + width * width)
            for block, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                d = _differences(np.frombuffer(x).reshape(-1, width), np.frombuffer(y, np.int8), [seed, block])
                total += L.gradient_sums(d, np.ones(len(d)), w)
            return total

        return L.summed(blocks, of)

    weights = L.newton_over(sums, width, l2)
    utility = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return Model(weights, L.quantile(got.select(utility.alias("v")), n_bad / sum(sizes.values())))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score and predicted (1 if score >= CUT)."""

    def run(batches):
        for batch in batches:
            for at, piece in T.slices(batch.column(1)):
                s = model.score(features(piece))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(piece)), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                                                 ["k", "score", "predicted"])

    return (docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string"))
            .mapInArrow(run, "k long, score double, predicted int").withColumnRenamed("k", key))


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that score at least CUT, columns unchanged."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for first, piece in T.slices(batch.column(at)):
                yield batch.slice(first, len(piece)).filter(pa.array(model.score(features(piece)) >= CUT))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Fit on the labelled rows where ``train`` holds, score every row.

    Defined cases: a null text scores as an empty one; rows are scored one by
    one; null labels are left out; without usable labels every text gets one
    score, above the cut unless all labels are bad; other columns are ignored;
    an empty table gives an empty result.
    """
    return score(docs, fit(L.labelled_sample(docs, labels, key, text, label, train)), key, text)
