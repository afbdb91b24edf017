"""Fuzzy line deduplication over a corpus.

A line's words are runs of anything but ASCII white space and punctuation, A-Z
lower-cased; lines without words are left alone. Lines with equal words are one
node. Two nodes are linked if their edit similarity over words, 1 - distance /
longer length, is at least 0.9. Of each connected group of lines only the
first occurrence in the corpus (smallest key, then smallest line number) is kept.

Candidates come from an exact prefix filter, so that no pair within the bound is
left out. A line's set is its runs of five words, numbered where one repeats. One
edit takes at most five of them away, so of two lines within k edits each has at
most 5 k that the other has not, and as long as the bound is a tenth of the words
they have at least one in common. Put in one order, rarest first, the first common one is among
the first 5 k + 1 of both: lines are joined on these, by ``jaccard_join``'s exact
frequencies, where runs of frequency 1 only count as positions. Star rounds and
then the open pairs of different groups (``connect``) are compared word by word,
if the parities of their words (``signs``) differ no more than the edits can.
Lines of eight words and fewer are similar only if equal.

Lines travel as hashes; words of a line travel only for candidates, let through
by a fixed-size bitmap; texts are shuffled once, to meet their lines' verdicts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltcast.llm import textbuf as T
from voltcast.llm.bitmap import bitmap, present
from voltcast.llm.connect import groups, written
from voltcast.llm.jaccard_join import frequent_shingles

SIMILARITY = (9, 10)
LEAST_WORDS = 9                            # shorter lines have no similar ones that are not equal
RUN = 5                                    # words of a run
RUN_BITS = 48                              # of a run's hash; equal hashes of different runs only add candidates
SIGNS = ("s0", "s1", "s2", "s3")           # columns of a line's ``signs``
SIDE_BY_SIDE = 512                         # words up to which lines are compared many at a time
CELLS = 1 << 14                            # of a table row
PIECE = 1 << 18                            # bytes of text split into words at a time
ROUNDS = 1                                 # of stars before all open pairs
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Lines:
    """Lines with words in a piece of a string column: text, line number, hash, and bounds of their words."""

    def __init__(self, piece: pa.Array):
        w = T.Words(piece, blank=_BLANK)
        self.words = w.hashes()
        breaks = np.concatenate([[0], np.cumsum(w.raw == 10)])
        line = breaks[w.start] - breaks[w.text_at[w.doc]]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
        self.begin = np.flatnonzero(new)
        self.bounds = np.append(self.begin, len(line))
        self.doc, self.line = w.doc[self.begin], line[self.begin]
        place = np.arange(len(line)) - np.repeat(self.begin, np.diff(self.bounds))
        self.hash = T.mix(_sums(T.mix(self.words + place.astype(_U) * _U(0xD1B54A32D192ED03)), self.begin))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of ``RUN`` words of the lines of ``LEAST_WORDS`` or more, numbered where one repeats in its line: (hash, line, number per line)."""
        long = np.where(self.counts >= LEAST_WORDS, self.counts, 0)
        h, line, *_ = numbered_runs(short(self.words[np.repeat(long > 0, self.counts)]), np.concatenate([[0], np.cumsum(long)]))
        return h, line, np.maximum(long - RUN + 1, 0)


def short(words: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash, which tell the words of two lines apart."""
    return (words >> _U(32)).astype(np.uint32)


def numbered_runs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of lines: (hash, line, number of the run among equal ones of its line, places of the first and the last of these)."""
    h, place, line = T.windows(words.astype(_U), offsets, RUN)
    place = place - offsets[line]
    number, first, last = np.zeros(len(h), np.int64), place.copy(), place.copy()
    own = T.mix(h + line.astype(_U) * _U(0xD1B54A32D192ED03))
    ordered = np.sort(own)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(again):
        at = np.flatnonzero(again[np.minimum(np.searchsorted(again, own), len(again) - 1)] == own)
        at = at[np.lexsort((place[at], h[at], line[at]))]
        new = np.ones(len(at), bool)
        new[1:] = (h[at][1:] != h[at][:-1]) | (line[at][1:] != line[at][:-1])
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(at)))
        number[at] = np.arange(len(at)) - np.repeat(begin, times)
        first[at], last[at] = np.repeat(place[at[begin]], times), np.repeat(place[at[begin + times - 1]], times)
        h[at] = np.where(number[at] > 0, T.mix(h[at] + number[at].astype(_U) * _U(0x9E3779B97F4A7C15)), h[at])
    return h & ~_U((1 << (64 - RUN_BITS)) - 1), line, number, first, last


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin) if len(begin) else np.zeros(0, values.dtype)


def signs(words: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Parities of the words of each line that fall on each of 256 bits, 64 to an array; no line is empty.

    A word put in or taken out turns one bit, one put in another's place at most two.
    """
    bit = T.mix(words.astype(_U)) >> _U(56)
    mark = _U(1) << (bit & _U(63))
    return [np.bitwise_xor.reduceat(np.where(bit >> _U(6) == _U(i), mark, _U(0)), offsets[:-1]) for i in range(len(SIGNS))]


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Words that one of two sequences has more often than the other, the larger side: never above the edit distance."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    sign = np.where(order < len(a), 1, -1)
    both = both[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    surplus = np.add.reduceat(sign, first) if len(first) else np.zeros(0, np.int64)
    return int(max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()))


def within(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Whether the edit distance of two word sequences is at most ``limit``.

    What lies between the equal words at both ends settles most that are; the bag
    distance most that are not; then the furthest match on each diagonal is
    followed error by error, which is quick for few errors.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return False
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    if len(differ) + abs(n - m) <= limit:
        return True
    head = int(differ[0]) if len(differ) else short
    tail = np.flatnonzero(a[n - short:][::-1] != b[m - short:][::-1])
    tail = min(int(tail[0]) if len(tail) else short, short - head)
    if max(n, m) - head - tail <= limit:
        return True
    a, b, n, m = a[head:n - tail], b[head:m - tail], n - head - tail, m - head - tail
    if bag_distance(a, b) > limit:
        return False

    def slide(i: int, j: int) -> int:
        step = 16
        while i < n and j < m:
            size = min(step, n - i, m - j)
            differ = np.flatnonzero(a[i:i + size] != b[j:j + size])
            if len(differ):
                return i + int(differ[0])
            i, j, step = i + size, j + size, step * 4
        return i

    reach = {0: slide(0, 0)}
    for e in range(limit + 1):
        if reach.get(n - m, -1) >= n:
            return True
        after = {}
        for d in range(max(-e - 1, -m), min(e + 1, n) + 1):
            best = max(reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -1))
            best = min(best, n, m + d)
            if best >= max(d, 0):
                after[d] = slide(best, best - d)
        reach = after
    return False


def within_all(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """``within`` for many pairs: the rows of their edit distance tables, ``limit`` diagonals to either side, are filled side by side."""
    out = np.zeros(len(pairs), bool)
    n = np.array([len(a) for a, _ in pairs], np.int64)
    more = np.array([len(b) for _, b in pairs], np.int64) - n
    for i in np.flatnonzero(n > SIDE_BY_SIDE):
        out[i] = within(*pairs[i], int(limits[i]))
    left = np.flatnonzero((n <= SIDE_BY_SIDE) & (np.abs(more) <= limits))
    left = left[np.argsort(n[left], kind="stable")]
    while len(left):
        # of the longest ones as many as fill a table
        width = 2 * int(limits[left[-1]]) + 1
        some, left = left[-max(1, CELLS // width):], left[:-max(1, CELLS // width)]
        edge = int(limits[some].max())
        rows = int(n[some[-1]])
        a, b = np.zeros((rows, len(some)), np.uint32), np.zeros((rows + 2 * edge + 1, len(some)), np.uint32)
        for c, i in enumerate(some):
            x, y = pairs[i]
            a[:len(x), c], b[edge:edge + len(y), c] = x, y
        step = np.arange(2 * edge + 1, dtype=np.int32)[:, None]
        # cell d of row r stands for r words of one line and r + d - edge of the other; those before the first word are out of reach
        row = np.repeat(np.where(step < edge, 2 * SIDE_BY_SIDE + edge - step, step - edge).astype(np.int32), len(some), axis=1)
        ends = np.searchsorted(n[some], np.arange(rows + 2))
        for r in range(rows + 1):
            done = np.arange(ends[r], ends[r + 1])
            if len(done):
                out[some[done]] = row[more[some[done]] + edge, done] <= limits[some[done]]
            if r < rows:
                after = row + (b[r:r + 2 * edge + 1] != a[r])
                np.minimum(after[:-1], row[1:] + 1, out=after[:-1])
                if r < edge:
                    after[edge - r - 1] = r + 1
                    after[:edge - r - 1] = 2 * SIDE_BY_SIDE
                row = np.minimum.accumulate(after - step, axis=0) + step
    return out


def _line_table(docs: DataFrame) -> DataFrame:
    """(doc, key, line, node) of every line with words; doc names a row by its key and text."""

    def run(batches):
        for batch in batches:
            for at, piece in T.slices(batch.column(2), PIECE):
                x = Lines(piece)
                where = pa.array(x.doc + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(1).take(where), pa.array(x.line.astype(np.int32)),
                     pa.array(x.hash.view(np.int64))], ["doc", "key", "line", "node"])

    return written(docs.mapInArrow(run, "doc long, key long, line int, node long"), "lines")


def _line_words(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, words) of the wanted lines: the ``short`` hashes of their words."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(nodes, "node"))

    def run(batches):
        for batch in batches:
            for _, piece in T.slices(batch.column(2), PIECE):
                x = Lines(piece)
                words = short(x.words)
                hit = present(held.value, x.hash)
                _, first = np.unique(x.hash[hit], return_index=True)
                hit = hit[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.hash[hit].view(np.int64)),
                     pa.array([words[a:b].tobytes() for a, b in zip(x.begin[hit], x.bounds[hit + 1])], pa.binary())], ["node", "words"])

    return docs.mapInArrow(run, "node long, words binary").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))


def _similar(pairs: DataFrame) -> DataFrame:
    """Of (a, b, x, y) rows, the pairs whose words are similar enough."""

    def run(batches):
        for batch in batches:
            both = [(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) for x, y in zip(batch.column(2), batch.column(3))]
            longer = np.array([max(len(x), len(y)) for x, y in both], np.int64)
            keep = np.flatnonzero(within_all(both, longer * (SIMILARITY[1] - SIMILARITY[0]) // SIMILARITY[1]))
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def most_edits(words: np.ndarray) -> np.ndarray:
    """Edits that a line may be away from any similar one, which may be the longer of the two."""
    return words * (SIMILARITY[1] - SIMILARITY[0]) // SIMILARITY[0]


def _run_sets(piece: pa.Array):
    x = Lines(piece)
    h, line, sizes = x.runs()
    return h, line, sizes, x.hash


def _joinable(sets: DataFrame, words: DataFrame) -> DataFrame:
    """(key, rank, node, n, part, lo, hi, s0 to s3): of each prefix, the runs up to the first that settles it, with their places in the line and its ``signs``.

    Of runs that start at places equal modulo five no two overlap, so one edit
    takes at most one of them away. Once one such class has more runs, those of
    frequency 1 included, than a line may have edits, one of them is in every similar line.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, weight, prefix, common, text = batch.columns
            text = [np.frombuffer(x.as_buffer(), np.uint32) for x in text]
            count = np.array([len(x) for x in text])
            text, offsets = np.concatenate(text), np.concatenate([[0], np.cumsum(count)])
            sign = signs(text, offsets)
            h, line, number, first, last = numbered_runs(text, offsets)
            own = h ^ T.mix(line.astype(_U))
            often = np.concatenate([np.frombuffer(x.as_buffer(), _U) for x in common])
            often ^= T.mix(np.repeat(np.arange(len(common)), [x.as_buffer().size // 8 for x in common]).astype(_U))
            alone = (number == 0) & ~np.isin(own, often)
            settled = np.bincount(line[alone] * RUN + first[alone] % RUN, minlength=RUN * len(count)).reshape(-1, RUN)
            key = prefix.values.slice(prefix.offsets[0].as_py(), prefix.offsets[-1].as_py() - prefix.offsets[0].as_py()).to_numpy().view(_U)
            at = prefix.offsets.to_numpy() - prefix.offsets[0].as_py()
            who = np.repeat(np.arange(len(count)), np.diff(at))
            order = np.argsort(own)
            place = order[np.searchsorted(own[order], key ^ T.mix(who.astype(_U)))]
            edits = most_edits(count)[who]
            before = np.zeros(len(key), np.int64)
            for r in range(RUN):
                hit = (number[place] == 0) & (first[place] % RUN == r)
                total = np.concatenate([[0], np.cumsum(hit)])
                before = np.maximum(before, total[:-1] - total[at[who]] + settled[who, r])
            keep = np.flatnonzero(before <= edits)
            who, place = who[keep], place[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[keep].view(np.int64)), weight.take(pa.array(who)), node.take(pa.array(who)), pa.array(count[who].astype(np.int32)),
                 pa.array((np.log(count[who]) / np.log(SIMILARITY[1] / SIMILARITY[0])).astype(np.int32)),
                 pa.array(first[place].astype(np.int32)), pa.array(last[place].astype(np.int32)), *[pa.array(x[who].view(np.int64)) for x in sign]],
                ["key", "rank", "node", "n", "part", "lo", "hi", *SIGNS])

    return sets.select("node", "weight", "prefix", "common").join(words, "node").mapInArrow(
        run, "key long, rank double, node long, n int, part int, lo int, hi int, " + ", ".join(f"{s} long" for s in SIGNS))


def _groups(rows: DataFrame) -> DataFrame:
    """(node, component) of every linked node of the (doc, key, t) rows."""
    sets = frequent_shingles(rows, "t", _run_sets, lambda n: RUN * most_edits(n + RUN - 1) + 1)
    words = written(_line_words(rows, sets.select("node")), "words")
    index = written(_joinable(sets, words), "index")

    def turned(a: str, b: str) -> Column:
        return sum((F.bit_count(F.col(a + s).bitwiseXOR(F.col(b + s))) for s in SIGNS), F.lit(0))

    def fits(a: str, b: str) -> Column:
        longer, more = F.greatest(a + "n", b + "n"), F.abs(F.col(a + "n") - F.col(b + "n"))
        apart = F.greatest(F.col(a + "lo") - F.col(b + "hi"), F.col(b + "lo") - F.col(a + "hi"))
        edits = F.floor(longer * (SIMILARITY[1] - SIMILARITY[0]) / SIMILARITY[1])
        return (more * SIMILARITY[1] <= longer * (SIMILARITY[1] - SIMILARITY[0])) & (apart <= edits) & (turned(a, b) <= 2 * edits - more)

    def verify(pairs: DataFrame) -> DataFrame:
        return _similar(pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
                        .join(words.select(F.col("node").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y"))

    return groups(index, fits, verify, ROUNDS, split="part", apart=turned)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines to remove: (doc, drop) with sorted numbers of the lines of a row that are not their group's first occurrence."""
    rows = docs.select(F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")).alias("doc"), F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("t"))
    lines = _line_table(rows)
    twice = lines.groupBy("node").agg(F.count("*").alias("times")).where("times > 1").select("node")
    named = twice.join(_groups(rows), "node", "full").select("node", F.coalesce("component", "node").alias("component"))
    # lines that no other line is equal or linked to stay and go no further
    copies = written(lines.join(named, "node").drop("node"), "copies")
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "line", "doc"))
    verdict = copies.groupBy("component").agg(first.alias("keep"))
    return (copies.join(verdict, "component").where(~((F.col("keep.doc") == F.col("doc")) & (F.col("keep.line") == F.col("line"))))
            .groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("drop")))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str | None = "n_removed") -> DataFrame:
    """The rows with repeated lines taken out of ``text``; other columns unchanged, plus the number of lines ``removed`` if named.

    Defined cases: null texts stay null, texts without repeated lines stay as
    they are; a text whose lines are all repeated becomes empty; rows that
    repeat both key and text are one document and get the same result; a null
    key comes after all others; an empty table gives an empty result. Lines are
    what stands between newline characters.
    """
    drop = repeated_lines(docs, key, text)
    # a name that clashes with no column
    doc, gone = "_" * 8 + "doc", "_" * 8 + "drop"
    joined = docs.withColumn(doc, F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string"))).join(
        drop.select(F.col("doc").alias(doc), F.col("drop").alias(gone)), doc, "left")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.array_contains(F.col(gone), i))
    out = joined.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    if removed:
        out = out.withColumn(removed, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return out.drop(doc, gone)
