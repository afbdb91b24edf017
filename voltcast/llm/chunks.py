"""Distinct-word tables: give every word of a corpus a value without shuffling its positions.

The corpus is cut into *chunks* of a few MB of text. A chunk holds its distinct
words once and each text as indexes into them, packed and compressed. Values
are found per distinct word of the corpus: each chunk sends its distinct words
to the task that owns them (by word hash), the owner works on each distinct
word once and answers each chunk, and the chunk puts the answers back by
position. A frequent word costs one entry per chunk, so no key is hot; a task
holds one chunk or one share of the vocabulary.

A chunk is named by a hash of its content. ``chunk_table`` writes the chunks to
the shared checkpoint folder; ``chunk_rows`` cuts them anew for each use, which
saves that copy and needs a source whose rows come in the same order each time
(files do). A chunk whose replies are not complete stops the job with an error.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltcast.session import scratch_path

CHUNK_BYTES = 4 << 20
CHUNK_SCHEMA = "chunk long, data binary, words array<binary>"
SHARE_SCHEMA = "chunk long, share int, data binary"


def planes(a: np.ndarray) -> bytes:
    """Byte planes of an integer array: like bytes stand together and compress well."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack(obj, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(obj, protocol=5))


def unpack(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


class Chunk:
    """Row keys and flags, words per text, and the word index of each position.

    Distinct words stand by share of the vocabulary, then as they first occur; ``sizes`` has
    the number of words of each share, ``times`` how often each word occurs. An
    index counts words from the most frequent one, which compresses well.
    """

    def __init__(self, keys: list, flags: list, counts: np.ndarray, sizes: np.ndarray, times: np.ndarray, index: np.ndarray):
        self.keys, self.flags, self.counts, self.sizes, self.times, self.index = keys, flags, counts, sizes, times, index

    def dumps(self) -> bytes:
        rank = np.empty(len(self.times), np.uint32)
        rank[np.argsort(-self.times, kind="stable")] = np.arange(len(rank), dtype=np.uint32)
        return pack((self.keys, self.flags, self.counts, self.sizes, planes(self.times.astype(np.uint32)), planes(rank[self.index])))

    @classmethod
    def loads(cls, data: bytes) -> Chunk:
        keys, flags, counts, sizes, times, index = unpack(data)
        times = from_planes(times, "uint32").astype(np.int64)
        return cls(keys, flags, counts, sizes, times, np.argsort(-times, kind="stable")[from_planes(index, "uint32")])

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])


def chunk_rows(docs: DataFrame, key: str, text: str, lower: bool, flag: str | None = None, limit: int = CHUNK_BYTES,
               want: tuple[str, ...] = ("data", "words")) -> DataFrame:
    """Cut (key, text) rows into packed chunks.

    A null text is a text without words. Words are split at ASCII white space;
    ``lower`` lowers A-Z first. Rows are kept one by one, repeated or not.
    ``words`` holds, per share of the vocabulary, the chunk's distinct words and
    how often each occurs in rows where ``flag`` is true (all rows without one).
    Columns not in ``want`` are null.
    """
    n = n_shares(docs)
    schema = pa.schema([("chunk", pa.int64()), ("data", pa.binary()), ("words", pa.list_(pa.binary()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId(), 0
        keys, flags, counts, index, seen, size = [], [], [], [], defaultdict(count().__next__), 0

        def flush():
            nonlocal keys, flags, counts, index, seen, size, made
            words = list(seen)
            share = np.fromiter((zlib.crc32(w) % n for w in words), np.int64, len(words))
            order = np.argsort(share, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            index = place[np.concatenate(index)] if len(words) else np.zeros(0, np.int64)
            counts = np.array(counts, np.uint32)
            sizes = np.bincount(share, minlength=n)
            name = xxhash.xxh3_64_intdigest(repr((part, made, keys)).encode() + counts.tobytes() + index.tobytes())
            row = {"chunk": [np.int64(np.uint64(name).view(np.int64))], "data": [None], "words": [None]}
            if "data" in want:
                row["data"] = [Chunk(keys, flags, counts, sizes, np.bincount(index, minlength=len(words)), index).dumps()]
            if "words" in want:
                flagged = np.bincount(index[np.repeat(np.array(flags, bool), counts)], minlength=len(words)).astype(np.uint32)
                at = np.concatenate([[0], np.cumsum(sizes)])
                row["words"] = [[pack((b"\n".join([words[i] for i in order[a:b]]), planes(flagged[a:b]))) if a < b else None
                                 for a, b in zip(at[:-1], at[1:])]]
            keys, flags, counts, index, seen, size, made = [], [], [], [], defaultdict(count().__next__), 0, made + 1
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            for k, t, f in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                words = (raw.lower() if lower else raw).split()
                keys.append(k)
                flags.append(f)
                counts.append(len(words))
                index.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
                size += len(raw) + 64
                if size >= limit:
                    yield flush()
        if keys:
            yield flush()

    flagged = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(True)
    return docs.select(key, text, flagged).mapInArrow(cut, CHUNK_SCHEMA)


def chunk_table(docs: DataFrame, key: str, text: str, lower: bool, flag: str | None = None) -> DataFrame:
    """``chunk_rows``, written to the shared folder and read back."""
    path = scratch_path(docs.sparkSession, "chunks")
    chunk_rows(docs, key, text, lower, flag).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def each(chunks: DataFrame, work: Callable[[int, Chunk, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """Turn every chunk, with its number and distinct words, into rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column(0).to_pylist()):
                words = [w for x in batch.column(2)[i].as_py() if x is not None for w in unpack(x)[0].split(b"\n")]
                yield from work(number, Chunk.loads(batch.column(1)[i].as_py()), words).to_batches()

    return chunks.mapInArrow(run, schema)


def word_requests(chunks: DataFrame) -> DataFrame:
    """One row per chunk and share that it has words of."""
    return chunks.select("chunk", F.posexplode("words").alias("share", "data")).where("data is not null")


def answer(requests: DataFrame, own: Callable[[list[bytes], list[np.ndarray], list[np.ndarray]], list]) -> DataFrame:
    """Each share of the vocabulary in one task.

    ``own`` gets the share's distinct words and, per chunk, their indexes into
    these and their counts; it returns a value per chunk.
    """

    def serve(table: pa.Table) -> pa.Table:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        index, times = [], []
        for data in table.column("data"):
            words, held = unpack(data.as_py())
            words = words.split(b"\n")
            index.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
            times.append(from_planes(held, "uint32"))
        replies = own(list(number), index, times)
        return pa.table({"chunk": table.column("chunk"), "share": table.column("share"),
                         "data": pa.array([pack(x) for x in replies], pa.binary())})

    return requests.groupBy("share").applyInArrow(serve, SHARE_SCHEMA)


def answer_each(requests: DataFrame, start: Callable[[], Callable[[list[bytes]], object]]) -> DataFrame:
    """Each share of the vocabulary in one task, whose requests stream by and are answered one at a time.

    ``start`` begins a share; what it returns gets the words of one request after
    another and returns the value for each. So a task holds what it keeps of the
    share's distinct words, and one batch of requests.
    """

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reply = None, None
        for batch in batches:
            for i, share in enumerate(batch.column(1).to_pylist()):
                if share != now:
                    now, reply = share, start()
                data = pack(reply(unpack(batch.column(2)[i].as_py())[0].split(b"\n")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([data], pa.binary())], ["chunk", "share", "data"])

    n = n_shares(requests)
    return requests.repartition(n, "share").sortWithinPartitions("share").mapInArrow(serve, SHARE_SCHEMA)


def finish(chunks: DataFrame, replies: DataFrame, done: Callable[[Chunk, dict[int, object]], pa.Table], schema: str) -> DataFrame:
    """Bring each chunk together with its replies and turn it into result rows.

    A share's reply covers that share's words in order, so replies in the order
    of shares cover the chunk's distinct words in order.
    """

    def one(table: pa.Table) -> pa.Table:
        share = table.column("share").to_pylist()
        data = table.column("data")
        chunk, parts = None, {}
        for i, s in enumerate(share):
            if s is None:
                chunk = Chunk.loads(data[i].as_py())
            else:
                parts[s] = unpack(data[i].as_py())
        if chunk is None or sum(s < len(chunk.sizes) for s in parts) != np.count_nonzero(chunk.sizes):
            raise RuntimeError("chunks changed between two reads of the input; write the input to files first")
        return done(chunk, {s: parts[s] for s in sorted(parts)})

    rows = chunks.select("chunk", F.lit(None).cast("int").alias("share"), "data").unionByName(replies)
    return rows.groupBy("chunk").applyInArrow(one, schema)


def n_shares(df: DataFrame) -> int:
    """Shares of the vocabulary: as many as shuffle partitions, so that a share stays small as the job is widened."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
