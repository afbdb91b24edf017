"""Alignment of two tokenizers over the same texts, and how often their ids meet.

A text with a space before it is encoded by a byte-level BPE (A) and by a
sentencepiece model (B, which adds that space itself). Token bytes give every
token a byte range. Two pointers per document run over both token lists: the
tokens they point to overlap and are a *link*; the one that ends first moves on,
both where they end together, which is a *cut*. Cuts bound the groups.

Lockstep: one state vector holds the pointers of all documents of a batch, a
step advances all of them by array operations, and finished documents are taken
out of the vector. Documents of many tokens enter as several runs, begun at
places where a token of A and one of B end together, so that a batch's steps do
not follow its longest document.

Corpus counts: each batch of about ``BATCH_BYTES`` is written with its distinct
id pairs; Spark sums the pairs over the corpus, finds the highest count of each
B id, and joins both back to the batches by pair. A frequent pair costs one row
per batch.

Defined cases: a null or empty text, or one whose token bytes are not the text
(such as one that holds U+2581), has no tokens: zeros, and an empty string for
its groups; rows are kept one by one, with null or repeated keys too; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltcast.llm import textbuf as T
from voltcast.llm.chunks import from_planes, pack, planes, unpack
from voltcast.llm.connect import written

BATCH_BYTES = 2 << 20
RUN_TOKENS = 1024          # a document of more A tokens is cut into runs of about so many
_BITS = 20                 # an id has at most so many bits
_MASK = (1 << _BITS) - 1
# The pre-tokeniser pattern of byte-level BPE, and blocks whose characters have had their class for long (Latin, Cyrillic,
# punctuation, kana, Chinese and Korean characters).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAME = re.compile("[\x00-\u024f\u0400-\u04ff\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizers file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def piece_tokens(model) -> list[bytes]:
    """Bytes of each id of a sentencepiece model."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        raw = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
        out.append(bytes([int(raw[1], 16)]) if raw else piece.replace("▁", " ").encode())
    return out


def _plain_encoder(path_a: str, tokens: list[bytes]):
    """A quicker encoder of the same vocabulary, if the file has the usual pre-tokeniser and its merges follow the ids; else None.

    It is used on texts of ``SAME`` characters only, on whose classes the two
    libraries' pattern engines agree (checked one by one in the tests).
    """
    import tiktoken
    with open(path_a, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    vocab = spec["model"]["vocab"]
    in_order = [vocab.get(m.replace(" ", "", 1)) for m in merges]
    pre = spec["pre_tokenizer"] or {}
    plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
             and not spec["model"].get("ignore_merges") and in_order == list(range(256, 256 + len(merges))) and sorted(map(len, tokens[:256])) == [1] * 256)
    if not plain:
        return None
    ranks = {t: i for i, t in enumerate(tokens[:256 + len(merges)])}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None


@functools.lru_cache(maxsize=1)
def _models(path_a: str, path_b: str):
    """Both tokenizers with their byte tables, loaded once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    bytes_a, bytes_b = byte_level_tokens(path_a), piece_tokens(b)
    return a, _plain_encoder(path_a, bytes_a), b, _Bytes(bytes_a), _Bytes(bytes_b)


class _Bytes:
    """Bytes of all ids side by side."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        return self.data[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()


class Tokens:
    """Tokens of both kinds of a batch of texts: ids and bounds per text. Texts without tokens have empty ranges."""

    def __init__(self, texts: list[str | None], path_a: str, path_b: str):
        a, plain, b, bytes_a, bytes_b = _models(path_a, path_b)
        size_a, size_b = bytes_a.size, bytes_b.size
        wanted = [x for x in texts if x]
        quick = [plain is not None and SAME.fullmatch(x) is not None for x in wanted]
        rest = iter(a.encode_batch_fast([" " + x for x, q in zip(wanted, quick) if not q], add_special_tokens=False))
        found = iter(zip(wanted, quick, b.encode(wanted, num_threads=1) if wanted else []))
        ids: tuple[list, list] = ([], [])
        counts = np.zeros((2, len(texts) + 1), np.int64)
        for i, text in enumerate(texts):
            if text:
                _, q, own_b = next(found)
                own_a = np.array(plain.encode_to_numpy(" " + text, disallowed_special=()) if q else next(rest).ids, np.int64)
                own_b, raw = np.array(own_b, np.int64), (" " + text).encode()
                if bytes_a.spell(own_a) == raw == bytes_b.spell(own_b):
                    ids[0].append(own_a)
                    ids[1].append(own_b)
                    counts[:, i + 1] = len(own_a), len(own_b)
        self.a, self.b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ids)
        self.at_a, self.at_b = np.cumsum(counts, axis=1)
        # ends over the whole batch, which has its texts end to end
        self.end_a, self.end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])


def runs(end_a: np.ndarray, end_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of the runs of a batch: where documents begin and, in long ones, about every ``every`` tokens a place where both kinds begin."""
    first_a, first_b = at_a[:-1][np.diff(at_a) > 0], at_b[:-1][np.diff(at_a) > 0]
    n = np.diff(np.append(first_a, len(end_a)))
    more = np.maximum(-(-n // every) - 1, 0)
    target = np.repeat(first_a, more) + (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1) * every
    if len(target):
        near = np.clip(target[:, None] + np.arange(-32, 32), 0, len(end_a) - 1)
        place = np.searchsorted(end_b, end_a[near])
        same = end_b[np.minimum(place, len(end_b) - 1)] == end_a[near]
        row, col = np.arange(len(target)), same.argmax(axis=1)
        ok = same[row, col]
        first_a = np.concatenate([first_a, near[row, col][ok] + 1])
        first_b = np.concatenate([first_b, place[row, col][ok] + 1])
        first_a, keep = np.unique(first_a, return_index=True)
        first_b = first_b[keep]
        inside = first_a < len(end_a)
        first_a, first_b = first_a[inside], first_b[inside]
    return first_a, first_b


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token) of all runs in order, and whether each is a cut.

    ``end_a`` and ``end_b`` rise over the batch; ``first_*`` are the tokens at
    which runs begin. A step makes one link in every run that is not finished.
    """
    stop = np.append(first_a[1:], len(end_a)) - 1
    room = np.diff(np.append(first_a, len(end_a))) + np.diff(np.append(first_b, len(end_b)))
    base = np.cumsum(room) - room
    total = int(room.sum())
    link_a, link_b = np.full(total, -1, np.int64), np.zeros(total, np.int64)
    cut = np.zeros(total, bool)
    state = np.stack([first_a, first_b, base, stop]).astype(np.int64)      # pointer in A, pointer in B, next link, last token in A
    while state.shape[1]:
        a, b, at, last = state
        ends_a, ends_b = end_a[a], end_b[b]
        link_a[at], link_b[at] = a, b
        same = ends_a == ends_b
        cut[at] = same
        done = same & (a == last)
        state[0] += ends_a <= ends_b
        state[1] += ends_b <= ends_a
        state[2] += 1
        if done.any():
            state = state[:, ~done]
    made = link_a >= 0
    return link_a[made], link_b[made], cut[made]


class Aligned:
    """A batch with its links and cuts, by text: the operator's real result for a batch."""

    def __init__(self, tokens: Tokens, every: int = RUN_TOKENS):
        t = self.tokens = tokens
        first = runs(t.end_a, t.end_b, t.at_a, t.at_b, every)
        self.link_a, self.link_b, self.cut = lockstep(t.end_a, t.end_b, *first)
        self.links_at = np.searchsorted(self.link_a, t.at_a)
        cuts = np.concatenate([[0], np.cumsum(self.cut)])
        self.cuts_at = cuts[self.links_at]
        self.cut_a, self.cut_b = self.link_a[self.cut], self.link_b[self.cut]      # the last tokens of each group

    def group_strings(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: ids of A and B of its groups in order."""
        t, n = self.tokens, len(self.cut_a)
        last_a, last_b = np.zeros(len(t.a), bool), np.zeros(len(t.b), bool)
        last_a[self.cut_a], last_b[self.cut_b] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b, before_a = np.append(0, self.cut_b + 1)[:-1], self.cut_a + 1
        ids = np.empty(len(t.a) + len(t.b), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)
        place_a, place_b = np.arange(len(t.a)) + (before_b[group_a] if n else 0), np.arange(len(t.b)) + (before_a[group_b] if n else 0)
        ids[place_a], ids[place_b] = t.a, t.b
        mark[place_a[self.cut_a]], mark[place_b[self.cut_b]] = ord("|"), ord(";")
        digits = 1 + sum((ids >= 10 ** k).astype(np.int64) for k in range(1, 8))
        ends = np.cumsum(digits + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        if len(ends):
            out[ends - 1] = mark
            rest, own = ids, ends - 2
            for k in range(8):
                out[own] = 48 + rest % 10
                keep = rest >= 10
                rest, own = rest[keep] // 10, own[keep] - 1
                if not len(rest):
                    break
        bounds = np.append(0, ends)[t.at_a + t.at_b]
        data = out.tobytes()
        return [data[x:max(x, y - 1)] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def table(self, keys: list) -> pa.Table:
        """Real outputs per text: ids, links (token numbers in the text) and cuts (tokens of each kind before each cut)."""
        t = self.tokens
        shift = lambda values, per, at: values - np.repeat(at[:-1], np.diff(per))
        lists = lambda per, values: pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array(values, pa.int32()))
        return pa.table({
            "key": pa.array(keys, pa.int64()), "a_ids": lists(t.at_a, t.a), "b_ids": lists(t.at_b, t.b),
            "link_a": lists(self.links_at, shift(self.link_a, self.links_at, t.at_a)), "link_b": lists(self.links_at, shift(self.link_b, self.links_at, t.at_b)),
            "cut_a": lists(self.cuts_at, shift(self.cut_a + 1, self.cuts_at, t.at_a)), "cut_b": lists(self.cuts_at, shift(self.cut_b + 1, self.cuts_at, t.at_b))})


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[tuple[list, Aligned]]:
    for batch in batches:
        for at, piece in T.slices(batch.column(1), BATCH_BYTES):
            yield batch.column(0).slice(at, len(piece)).to_pylist(), Aligned(Tokens(piece.to_pylist(), path_a, path_b))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("t"))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``a_ids``, ``b_ids``, the links as token numbers ``link_a``, ``link_b``, and the cuts ``cut_a``, ``cut_b``.

    ``path_a`` is a tokenizers file, ``path_b`` a sentencepiece model; every
    worker can read both; neither is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in _aligned(batches, path_a, path_b):
            yield from found.table(keys).to_batches()

    arrays = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b"))
    return _rows(docs, key, text).mapInArrow(run, f"key long, {arrays}").withColumnRenamed("key", key)


def _batches(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Aligned batches, written: (batch, data, pairs, times) with a batch's digests and links packed, and its distinct id pairs with their numbers."""
    schema = pa.schema([("batch", pa.int64()), ("data", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        name = TaskContext.get().partitionId() << 32
        for keys, x in _aligned(batches, path_a, path_b):
            t = x.tokens
            doc = np.repeat(np.arange(len(keys)), np.diff(x.links_at))
            link = np.sort(doc << (2 * _BITS) | t.a[x.link_a] << _BITS | t.b[x.link_b])
            new = np.flatnonzero(np.concatenate([[True], link[1:] != link[:-1]])) if len(link) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(link)))
            pair, doc = link[new] & ((1 << 2 * _BITS) - 1), link[new] >> (2 * _BITS)
            distinct = np.unique(pair)
            number = np.searchsorted(distinct, pair)
            total = np.bincount(number, times, len(distinct)).astype(np.int64)
            held = np.bincount(doc, minlength=len(keys))
            step = np.diff(number, prepend=0)
            digest = [hashlib.sha256(s).hexdigest() if s else "" for s in x.group_strings()]
            small = np.uint8 if len(times) == 0 or times.max() < 256 else np.uint32
            data = pack((keys, np.diff(t.at_a), np.diff(t.at_b), np.diff(x.cuts_at), np.diff(x.links_at), digest, held,
                         planes(step.astype(np.int32)), times.astype(small)))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data]), pa.array([distinct], pa.list_(pa.int64())), pa.array([total], pa.list_(pa.int64()))], schema=schema)
            name += 1

    return written(docs.mapInArrow(run, "batch long, data binary, pairs array<long>, times array<long>"), "aligned")


def pair_counts(batches: DataFrame) -> DataFrame:
    """(pair, n, top): links of each id pair in the corpus, and the highest such number of its B id."""
    counts = batches.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    return counts.withColumn("top", F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(_MASK)))))


_OUT = "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def digests(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: numbers of tokens, groups and links, digest of the groups, links that are their B id's most frequent, and the sum of the links' corpus counts."""
    batches = _batches(_rows(docs, key, text), path_a, path_b)
    counts = pair_counts(batches)
    asked = batches.select("batch", F.posexplode("pairs").alias("place", "pair"))
    replies = asked.join(counts, "pair").groupBy("batch").agg(F.collect_list(F.struct("place", "n", (F.col("n") == F.col("top")).alias("best"))).alias("replies"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i in range(batch.num_rows):
                keys, n_a, n_b, groups, links, digest, held, step, times = unpack(batch.column(0)[i].as_py())
                reply = batch.column(1)[i].values
                n = np.zeros(0 if reply is None else len(reply), np.int64)
                best = np.zeros(len(n), np.int64)
                if len(n):
                    place, count, is_best = (reply.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                    n[place], best[place] = count, is_best
                number = np.cumsum(from_planes(step, "int32").astype(np.int64))
                doc = np.repeat(np.arange(len(keys)), held)
                # exact 64-bit sums per text
                add = lambda x: np.diff(np.append(0, np.cumsum(x))[np.append(0, np.cumsum(held))]) if len(doc) else np.zeros(len(keys), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(links),
                     pa.array(add(best[number] * times)), pa.array(add(n[number] * times)), pa.array(digest, pa.string())],
                    ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    joined = batches.select("batch", "data").join(replies, "batch", "left").select("data", "replies")
    return joined.mapInArrow(run, _OUT).withColumnRenamed("key", key)
