"""Set-similarity join of documents on word n-grams, rare n-grams first.

A document's set is its distinct lower-cased 5-word shingles. Equal sets are
one class, named by a 64-bit digest of the set; all later steps work on
classes. Shingles are put in a global order by document frequency, rarest
first. Two sets with Jaccard similarity of at least t share one of their first
n - ceil(t*n) + 1 shingles in that order (prefix filter), so classes are joined
on those; a shingle of frequency 1 cannot join and only counts as a position.
Inside the join a length filter and a positional filter (the first common
shingle must stand early enough in both sets for the overlap that their two
sizes need) drop pairs, a suffix filter
(bounding the overlap left and right of pivots) drops more before the exact
overlap is counted, once per pair. Only shingles of frequency 2 or more can be
common to two classes, so the overlap is counted on those.

Frequencies are exact, over all documents. Shingles travel as packed sorted
arrays, one block per map slice and share of the hash range, about 8 bytes per
shingle. A share of the hash range and a share of the classes each fit a task
when ``spark.sql.shuffle.partitions`` is set for the data.

Digest collisions: two different sets of the same size merge with probability
2^-64 per pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltcast.llm import chunks as C
from voltcast.llm import textbuf as T
from voltcast.llm.connect import groups, written

SLICE = 3 << 19                     # shingles of a packed block before it is cut by share
_U = np.uint64


def _sets(piece: pa.Array, size: int):
    """Sorted distinct shingles of each text: (hashes, text of each, set sizes, set digests)."""
    words = T.Words(piece)
    h, _, doc = T.windows(words.hashes(), words.offsets, size, whole_short=True)
    n = len(piece)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(T.mix(h ^ _U(0xA0761D6478BD642F)), out=total[1:])
    sizes = np.diff(bounds)
    digest = T.mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(_U) * _U(0xE7037ED1A0B428DB))
    return h, doc, sizes, digest


def shingle_sets(docs: DataFrame, key: str, text: str, size: int = 5) -> DataFrame:
    """Per row: key, n (set size) and node (set digest; null for an empty set)."""

    def digests(batches):
        for batch in batches:
            for at, piece in T.slices(batch.column(1)):
                _, _, sizes, digest = _sets(piece, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(piece)), pa.array(sizes.astype(np.int64)),
                     pa.array(digest.view(np.int64), mask=sizes == 0)], ["key", "n", "node"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string")).mapInArrow(digests, "key long, n long, node long")


def frequent_shingles(docs: DataFrame, text: str, sets: Callable, first: Callable[[np.ndarray], np.ndarray], whole: bool = True) -> DataFrame:
    """Classes that have a prefix shingle of frequency 2 or more, written to the shared folder.

    ``sets`` makes the sets of a piece of texts, as ``_sets`` does, and ``first(n)``
    is the length of the prefix of a set of n shingles, those of frequency 1 included.

    Columns: node, n, start (position of the first such shingle), weight (mean
    frequency: highest for what others are copies of), prefix (the prefix
    shingles that can join), common (all shingles of frequency 2 or more,
    sorted by hash, 8 bytes each; empty unless ``whole``).
    """
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "share int, data binary"
    out_schema = pa.schema([("share", pa.int32()), ("data", pa.binary())])

    def gather(batches):
        hs, whos, digests, ns, held, docs_seen = [], [], [], [], 0, 0

        def flush():
            nonlocal hs, whos, digests, ns, held, docs_seen
            h, who, digest, sizes = (np.concatenate(x) for x in (hs, whos, digests, ns))
            hs, whos, digests, ns, held, docs_seen = [], [], [], [], 0, 0
            nodes, first = np.unique(digest, return_index=True)
            own = np.full(len(digest), -1, np.int32)
            own[first] = np.arange(len(first))
            who = own[who]
            h, who = h[who >= 0], who[who >= 0]
            order = np.argsort(h)
            h, who = h[order], who[order]
            del order
            at = np.searchsorted(h >> _U(32), (np.arange(shares + 1, dtype=_U) * _U(1 << 32) + _U(shares - 1)) // _U(shares))
            rows = {"share": [], "data": []}
            for s, (a, b) in enumerate(zip(at[:-1], at[1:])):
                if a < b:
                    used, local = np.unique(who[a:b], return_inverse=True)
                    rows["share"].append(s)
                    rows["data"].append(C.pack((C.planes(np.diff(h[a:b], prepend=_U(0))), C.planes(local.astype(np.uint32)),
                                                C.planes(nodes[used]), C.planes(sizes[first[used]]))))
            return pa.RecordBatch.from_pydict(rows, schema=out_schema)

        for batch in batches:
            for _, piece in T.slices(batch.column(0)):
                h, doc, sizes, digest = sets(piece)
                some = sizes > 0
                hs.append(h)
                whos.append(((np.cumsum(some) - 1)[doc] + docs_seen).astype(np.int32))
                digests.append(digest[some])
                ns.append(sizes[some].astype(np.uint32))
                docs_seen += int(some.sum())
                held += len(h)
                if held >= SLICE:
                    yield flush()
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        hs, ds, ns, table_d = [], [], [], []
        for data in table.column("data"):
            step, who, nodes, n = C.unpack(data.as_py())
            nodes = C.from_planes(nodes, "uint64")
            hs.append(np.cumsum(C.from_planes(step, "uint64"), dtype=_U))
            ds.append(nodes[C.from_planes(who, "uint32")])
            table_d.append(nodes)
            ns.append(C.from_planes(n, "uint32"))
        h, d = np.concatenate(hs), np.concatenate(ds)
        del hs, ds
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        again[:-1] |= again[1:]
        h, d = h[again], d[again]
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(first)
        df = np.repeat(np.diff(np.append(at, len(h))), np.diff(np.append(at, len(h)))) if len(h) else np.zeros(0, np.int64)
        keep = df > 1
        h, d, df = h[keep], d[keep], df[keep]
        names, where = np.unique(np.concatenate(table_d), return_index=True)
        sizes = np.concatenate(ns)[where]
        order = np.lexsort((h, d))
        h, d, df = h[order], d[order], df[order].astype(np.uint32)
        nodes, begin = np.unique(d, return_index=True)
        lengths = np.diff(np.append(begin, len(d)))
        n = sizes[np.searchsorted(names, nodes)]
        group = ((nodes >> _U(32)) * _U(shares) >> _U(32)).astype(np.int64)
        edge = np.searchsorted(group, np.arange(shares + 1))
        rows = {"share": [], "data": []}
        starts = np.append(begin, len(d))
        for s in range(shares):
            a, b = edge[s], edge[s + 1]
            if a < b:
                x, y = starts[a], starts[b]
                rows["share"].append(s)
                rows["data"].append(C.pack((C.planes(nodes[a:b]), C.planes(n[a:b]), C.planes(lengths[a:b].astype(np.uint32)), C.planes(h[x:y]), C.planes(df[x:y]))))
        return pa.table(rows, schema=out_schema)

    def prefixes(table: pa.Table) -> pa.Table:
        parts = [[C.from_planes(x, k) for x, k in zip(C.unpack(data.as_py()), ("uint64", "uint32", "uint32", "uint64", "uint32"))]
                 for data in table.column("data")]
        d = np.concatenate([np.repeat(p[0], p[2]) for p in parts])
        n = np.concatenate([np.repeat(p[1], p[2]) for p in parts]).astype(np.int64)
        h, df = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        del parts
        order = np.lexsort((h, df, d))
        d, n, h, df = d[order], n[order], h[order], df[order].astype(np.float64)
        nodes, begin = np.unique(d, return_index=True)
        m = np.diff(np.append(begin, len(d)))
        n = n[begin]
        start = n - m
        length = first(n) - start
        weight = np.add.reduceat(df, begin) / n
        out = {"node": [], "n": [], "start": [], "weight": [], "prefix": [], "common": []}
        for i in np.flatnonzero(length > 0).tolist():
            own = h[begin[i]:begin[i] + m[i]]
            out["node"].append(int(nodes[i].view(np.int64)))
            out["n"].append(int(n[i]))
            out["start"].append(int(start[i]))
            out["weight"].append(float(weight[i]))
            out["prefix"].append(own[:length[i]].view(np.int64))
            out["common"].append(np.sort(own).tobytes() if whole else b"")
        return pa.table(out, schema=pa.schema([("node", pa.int64()), ("n", pa.int64()), ("start", pa.int64()),
                                               ("weight", pa.float64()), ("prefix", pa.list_(pa.int64())), ("common", pa.binary())]))

    counted = docs.select(F.col(text).cast("string")).mapInArrow(gather, schema).groupBy("share").applyInArrow(count, schema)
    return written(counted.groupBy("share").applyInArrow(prefixes, "node long, n long, start long, weight double, prefix array<long>, common binary"), "prefixes")


def _overlap_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """Upper bound of the overlap of two sorted sets: split both at pivots, add the smaller sides."""
    if not depth or len(x) < 8 or len(y) < 8:
        return min(len(x), len(y))
    i = len(x) // 2
    j = int(np.searchsorted(y, x[i]))
    return _overlap_bound(x[:i], y[:j], depth - 1) + _overlap_bound(x[i:], y[j:], depth - 1)


def linked_pairs(pairs: DataFrame, sets: DataFrame, t: tuple[int, int], suffix_depth: int = 3) -> DataFrame:
    """Of distinct class pairs (a, b), those whose sets have Jaccard similarity of at least t."""

    def check(batches):
        for batch in batches:
            a, b, na, nb, xs, ys = batch.columns
            keep = []
            for i, (p, q, x, y) in enumerate(zip(na.to_pylist(), nb.to_pylist(), xs, ys)):
                # |x & y| >= t * |x | y|  <=>  (t1 + t0) * |x & y| >= t0 * (p + q)
                need = -(-t[0] * (p + q) // (t[0] + t[1]))
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if _overlap_bound(x, y, suffix_depth) >= need and len(np.intersect1d(x, y, assume_unique=True)) >= need:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([x.take(pa.array(keep, pa.int64())) for x in (a, b)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("common").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("common").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(check, "a long, b long")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: tuple[int, int] = (3, 4)) -> DataFrame:
    """Per row: key, n_shingles and component_id, the smallest key reachable by links.

    Defined cases: null or empty texts have an empty set, are linked with
    nothing and are their own component; texts of 1 to size-1 words are one
    shingle; repeated rows are equal sets and so linked; a row with a null key
    gets the smallest key of its component (null if there is none). Other columns
    are ignored. ``similarity`` is a fraction (numerator, denominator).
    """
    t = similarity
    rows = written(shingle_sets(docs, key, text, size), "sets")
    sets = frequent_shingles(docs, text, lambda piece: _sets(piece, size), lambda n: n - -(-t[0] * n // t[1]) + 1)
    index = (sets.select("node", "n", "start", "weight", F.posexplode("prefix").alias("i", "key"))
             .select("key", F.col("weight").alias("rank"), "node", "n", (F.col("start") + F.col("i")).alias("pos")))

    def fits(a: str, b: str) -> Column:
        na, nb = F.col(a + "n"), F.col(b + "n")
        # an overlap of at least need leaves n - need + 1 shingles for the first common one to be among
        need = F.ceil(t[0] * (na + nb) / (t[0] + t[1]) - 1e-9)
        return (t[1] * F.least(na, nb) >= t[0] * F.greatest(na, nb)) & (F.col(a + "pos") + need <= na) & (F.col(b + "pos") + need <= nb)

    known = groups(index, fits, lambda pairs: linked_pairs(pairs, sets, t))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("key").alias("low"))
    named = classes.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "component").select("node", "component_id")
    return (rows.join(named, "node", "left")
            .select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                    F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id")))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows without those whose key is not the smallest of its component, columns unchanged; rows with a null key stay."""
    found = components(docs, key, text, **options)
    gone = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, docs[key].cast("long") == gone["_gone"], "left_anti")
