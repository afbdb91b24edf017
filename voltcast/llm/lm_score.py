"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs (with one end token per text) are gathered over
all training texts and quantised to levels 1 + floor(log_b c). The filter holds
(n-gram, j) for each j up to the n-gram's level; a count is read back by probing
j = 1, 2, ... until a probe fails, so errors only ever raise a level. Each
stored pair takes ``BITS`` bits on average in 512-bit blocks. The filter grows
with the corpus; it is cut in segments of at most ``SEGMENT_BYTES``, each
broadcast on its own to probe the n-grams it owns, so the broadcast size is
bounded at every corpus size and no n-gram is left out.

Model: interpolation of the pair estimate and the smoothed word estimate,
p(w | v) = LAMBDA * c(v w) / c(v) + (1 - LAMBDA) * (c(w) + ALPHA) / (N + ALPHA * (V + 1)),
with counts read from the filter (a pair's count is at most its words').
A text starts after an end token.

Word counts for the ``base`` score are exact: they come from the distinct-word
exchange in ``chunks``, which also holds the texts while the counts are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltcast.llm import chunks as C
from voltcast.llm.connect import written
from voltcast.llm.textbuf import mix

BASE, BITS, HASHES, LAMBDA, ALPHA = 1.5, 8, 5, 0.7, 0.1
SEGMENT_BYTES = 128 << 20
_U = np.uint64
_END = _U(0x8BB84B93962EACC9)
_FILTER = pa.schema([("share", pa.int32()), ("bits", pa.binary())])


def level(c: np.ndarray) -> np.ndarray:
    """Quantised level of counts of at least 1."""
    return 1 + np.floor(np.log(np.maximum(c, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def expected(q: np.ndarray) -> np.ndarray:
    """Count that a level stands for: the middle of its range; 0 for level 0."""
    q = q.astype(np.float64)
    return np.where(q > 0, (BASE ** (q - 1) + BASE ** q - 1) / 2, 0.0)


def word_keys(words: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), _U, len(words))


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _U(0x9FB21C651E98DF25) + right)


def owner(keys: np.ndarray, shares: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(shares) >> _U(32)).astype(np.int64)


def _bits(keys: np.ndarray, j: int, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """First bit of the block of (key, j), and the hash its positions in the block come from."""
    h = mix(keys + _U((j * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF))
    block = ((h & _U(0xFFFFFFFF)) * _U(n_blocks) >> _U(32)) << _U(9)
    return block, mix(h)


def build(keys: np.ndarray, levels: np.ndarray) -> bytes:
    """Blocked Bloom filter over (key, 1..level)."""
    n_blocks = max(1, -(-int(levels.sum()) * BITS // 512))
    bits = np.zeros(n_blocks * 512, bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        keys, levels = keys[levels >= j], levels[levels >= j]
        block, h = _bits(keys, j, n_blocks)
        for k in range(HASHES):
            bits[block + ((h >> _U(9 * k)) & _U(511))] = True
    return np.packbits(bits, bitorder="little").tobytes()


def probe(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Level of each key: the last j of an unbroken run of hits from 1."""
    table = np.frombuffer(bits, np.uint8)
    n_blocks = len(table) // 64
    out = np.zeros(len(keys), np.uint8)
    alive, j = np.arange(len(keys)), 0
    while len(alive) and j < 255:
        j += 1
        block, h = _bits(keys[alive], j, n_blocks)
        for k in range(HASHES):
            at = block + ((h >> _U(9 * k)) & _U(511))
            hit = (table[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
            alive, block, h = alive[hit], block[hit], h[hit]
        out[alive] = j
    return out


def _tokens(chunk: C.Chunk, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words and ends of all texts in a row, the key before each, the word index (-1 for an end), and text bounds."""
    counts = chunk.counts.astype(np.int64) + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    index = np.full(int(bounds[-1]), -1, np.int64)
    inner = np.ones(len(index), bool)
    inner[bounds[1:] - 1] = False
    index[inner] = chunk.index
    token = np.full(len(index), _END, _U)
    token[inner] = keys[chunk.index]
    before = np.concatenate([[_END], token[:-1]])
    before[bounds[:-1]] = _END
    return token, before, index, bounds


def score(docs: DataFrame, training: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every row with a model of the rows where column ``training`` is true.

    Result: key, training, n_tokens, n_known, train_tokens (N), vocabulary (V),
    base_score and score (log10 probabilities of the text under the exact
    smoothed word model and under the filter's model).

    Defined cases: a null text is an empty one and scores its end token; a null
    ``training`` counts as false; rows are kept one by one; other columns are
    ignored; without training rows N is 0 and all probabilities are the
    smoothing's; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = C.chunk_table(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"),
                                      F.col(training).alias("f")), "k", "t", lower=True, flag="f")
    shares = C.n_shares(docs)

    # exact word counts, once per distinct word; every chunk gets those of its words
    def count(words: list[bytes], index: list[np.ndarray], times: list[np.ndarray]) -> list:
        total = np.zeros(len(words), np.int64)
        for own, c in zip(index, times):
            total[own] += c                                 # a chunk has each word once
        return [(C.planes(total[own]), int(total.sum()), int((total > 0).sum())) for own in index]

    counted = written(C.answer(C.word_requests(table), count), "counts")
    one_each = counted.groupBy("share").agg(F.min_by("data", "chunk").alias("data")).select("data")
    n_words, v = (x or 0 for x in one_each.mapInArrow(_share_totals, "n long, v long").agg(F.sum("n"), F.sum("v")).first())
    ends = docs.where(F.coalesce(F.col(training), F.lit(False))).count()
    n, v = n_words + ends, v + (ends > 0)

    # words and pairs of training texts, counted per chunk and then per share of the key range
    def pairs(number: int, chunk: C.Chunk, words: list[bytes]) -> pa.Table:
        token, before, _, bounds = _tokens(chunk, word_keys(words))
        train = np.repeat(np.array(chunk.flags, bool), np.diff(bounds))
        keys, times = np.unique(np.concatenate([pair_keys(before[train], token[train]), token[train]]), return_counts=True)
        at = np.searchsorted(owner(keys, shares), np.arange(shares + 1))
        rows = [(s, a, b) for s, (a, b) in enumerate(zip(at[:-1], at[1:])) if a < b]
        data = [C.pack((C.planes(np.diff(keys[a:b], prepend=_U(0))), C.planes(times[a:b].astype(np.uint32)))) for _, a, b in rows]
        return pa.table({"share": pa.array([s for s, _, _ in rows], pa.int32()), "data": pa.array(data, pa.binary())})

    def merge(part: pa.Table) -> pa.Table:
        ks, cs = [], []
        for data in part.column("data"):
            step, times = C.unpack(data.as_py())
            ks.append(np.cumsum(C.from_planes(step, "uint64"), dtype=_U))
            cs.append(C.from_planes(times, "uint32"))
        ks, cs = np.concatenate(ks), np.concatenate(cs)
        order = np.argsort(ks)
        ks, cs = ks[order], cs[order]
        first = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))
        return pa.table({"share": part.column("share").slice(0, 1),
                         "bits": pa.array([build(ks[first], level(np.add.reduceat(cs.astype(np.int64), first)))], pa.binary())}, schema=_FILTER)

    pieces = C.each(table, pairs, "share int, data binary").groupBy("share").applyInArrow(merge, "share int, bits binary")
    pieces = written(pieces, "filter")

    # probe one bounded segment of the filter at a time
    sizes = pieces.select("share", F.length("bits").alias("n")).orderBy("share").collect()
    segments, room = [[]], SEGMENT_BYTES
    for s, length in sizes:
        if length > room and segments[-1]:
            segments, room = [*segments, []], SEGMENT_BYTES
        segments[-1].append(s)
        room -= length
    probed = counted
    for number, own in enumerate(segments):
        held = spark.sparkContext.broadcast({r.share: bytes(r.bits) for r in pieces.where(F.col("share").isin(own)).toLocalIterator()})

        def read(at: int, chunk: C.Chunk, words: list[bytes], held=held, number=number) -> pa.Table:
            return pa.table({"chunk": pa.array([at], pa.int64()), "share": pa.array([shares + number], pa.int32()),
                             "data": pa.array([C.pack(_levels(chunk, word_keys(words), held.value, shares))], pa.binary())})

        probed = probed.unionByName(written(C.each(table, read, C.SHARE_SCHEMA), "levels"))
        held.unpersist()

    def done(chunk: C.Chunk, replies: dict) -> pa.Table:
        exact = [C.from_planes(r[0], "int64") for s, r in replies.items() if s < shares]
        exact = np.concatenate(exact) if exact else np.zeros(0, np.int64)
        read = [r for s, r in replies.items() if s >= shares]
        _, _, index, bounds = _tokens(chunk, np.zeros(len(exact), _U))
        if read:
            uni, pair, end_level = (np.maximum.reduce(x) for x in zip(*read))
        else:                                               # nothing to learn from: no segment at all
            uni, pair, end_level = (np.zeros(k, np.uint8) for k in (len(exact), len(index), 1))
        exact, read = np.append(exact, ends), expected(np.append(uni, end_level))
        c = exact[index]                                    # an end has index -1: the last
        floor = n + ALPHA * (v + 1)
        base = np.log10((c + ALPHA) / floor)
        own = read[index]
        before = np.concatenate([read[-1:], own[:-1]])
        before[bounds[:-1]] = read[-1]
        both = np.minimum(expected(pair), np.minimum(before, own))
        ratio = np.divide(both, before, out=np.zeros(len(both)), where=before > 0)
        model = np.log10(LAMBDA * ratio + (1 - LAMBDA) * (own + ALPHA) / floor)
        at = bounds[:-1]
        return pa.table({"k": pa.array(chunk.keys, pa.int64()), "f": pa.array(chunk.flags, pa.bool_()),
                         "n_tokens": pa.array(np.diff(bounds)),
                         "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
                         "train_tokens": pa.array(np.full(len(at), n, np.int64)), "vocabulary": pa.array(np.full(len(at), v, np.int64)),
                         "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(np.add.reduceat(model, at))})

    out = C.finish(table, probed, done, "k long, f boolean, n_tokens long, n_known long, train_tokens long, vocabulary long, base_score double, score double")
    return out.withColumnRenamed("k", key).withColumnRenamed("f", training)


def _levels(chunk: C.Chunk, keys: np.ndarray, held: dict[int, bytes], shares: int):
    """Levels of the chunk's distinct words, of each position's pair, and of the end token, as far as this segment has them."""
    token, before, _, _ = _tokens(chunk, keys)
    out = []
    for wanted in (keys, pair_keys(before, token), np.array([_END])):
        distinct, back = np.unique(wanted, return_inverse=True)
        at = np.searchsorted(owner(distinct, shares), np.arange(shares + 1))
        levels = np.zeros(len(distinct), np.uint8)
        for s, bits in held.items():
            if at[s] < at[s + 1]:
                levels[at[s]:at[s + 1]] = probe(bits, distinct[at[s]:at[s + 1]])
        out.append(levels[back])
    return tuple(out)


def _share_totals(batches):
    """Training tokens and distinct training words of each share, which every reply of the share repeats."""
    for batch in batches:
        got = [C.unpack(x.as_py()) for x in batch.column(0)]
        yield pa.RecordBatch.from_pydict({"n": pa.array([n for _, n, _ in got], pa.int64()), "v": pa.array([v for _, _, v in got], pa.int64())})
