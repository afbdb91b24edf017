"""BPE encoding and decoding through a table of distinct words.

Texts are split at ASCII white space in Spark; each distinct word of the corpus
is encoded once, by the task that owns it and answers the chunks one by one, and
its ids are joined back to every position (see ``chunks``). Neither the normaliser nor the pre-tokeniser of the
word vocabulary looks across white space, so the ids of a text are the ids of
its words in a row. Decoding joins ids with the id-to-piece table (bounded by
the vocabulary) and puts a space between pieces, as a tokeniser without a
decoder does.

Defined cases: a null text encodes as an empty one, with no ids and an empty
decoded text; rows are kept one by one, with null or repeated keys too; other
columns are ignored; an empty table gives an empty result. Rows are read twice
and must come in the same order both times, as they do from files; if they do
not, the job stops with an error.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltcast.llm import chunks as C


def pieces(path: str) -> list[str]:
    """Id-to-piece table of a tokenizers file, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table = dict(spec["model"]["vocab"].items()) | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [""] * (max(table.values()) + 1)
    for piece, i in table.items():
        out[i] = piece
    return out


def _with_room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``ids`` array<int> and the ``decoded`` text.

    ``tokenizer_path`` is a file that every worker can read (shipped with the
    Python environment); it is never written.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    table_of_pieces = pieces(tokenizer_path)
    id_type = "uint16" if len(table_of_pieces) <= 65536 else "uint32"

    def encoder():
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        number: dict[bytes, int] = {}
        sizes, ids, held = np.zeros(1 << 12, np.int32), np.zeros(1 << 14, id_type), 0      # of the distinct words so far, with room to grow

        def reply(words: list[bytes]):
            nonlocal sizes, ids, held
            fresh = [w for w in words if w not in number]
            for at in range(0, len(fresh), 4096):
                part = fresh[at:at + 4096]
                own = [e.ids for e in tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in part], add_special_tokens=False)]
                flat = np.array([i for x in own for i in x], id_type)
                first = len(number)
                number.update(zip(part, range(first, first + len(part))))
                sizes, ids = _with_room(sizes, first + len(part)), _with_room(ids, held + len(flat))
                sizes[first:first + len(part)] = np.fromiter(map(len, own), np.int32, len(own))
                ids[held:held + len(flat)] = flat
                held += len(flat)
            own = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            ends = np.cumsum(sizes[:len(number)], dtype=np.int64)
            size = sizes[own].astype(np.int64)
            take = np.arange(int(size.sum())) + np.repeat(ends[own] - size - (np.cumsum(size) - size), size)
            return size.astype(np.uint8 if size.max() < 256 else np.uint32), C.planes(ids[take])

        return reply

    piece_table = spark.sparkContext.broadcast(table_of_pieces)

    def place(chunk: C.Chunk, replies: dict) -> pa.Table:
        piece = piece_table.value
        sizes = [x for x, _ in replies.values()]
        ids = np.concatenate([C.from_planes(x, id_type) for _, x in replies.values()]).astype(np.int32) if replies else np.zeros(0, np.int32)
        lengths = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
        at = np.cumsum(lengths) - lengths
        strings = [piece[i] for i in ids.tolist()]
        decoded = [" ".join(strings[a:a + k]) for a, k in zip(at.tolist(), lengths.tolist())]
        del strings
        size = lengths[chunk.index]
        ends = np.cumsum(size)
        take = np.arange(int(size.sum())) - np.repeat(ends - size, size) + np.repeat(at[chunk.index], size)
        offsets = np.concatenate([[0], ends])[chunk.offsets]
        texts, bounds = [], chunk.offsets.tolist()
        empty = bool((lengths == 0).any())
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = [decoded[i] for i in chunk.index[a:b].tolist()]
            texts.append(" ".join([x for x in own if x] if empty else own))
        return pa.table({"k": pa.array(chunk.keys, pa.int64()),
                         "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[take], pa.int32())),
                         "decoded": pa.array(texts, pa.string())})

    # the chunks are cut twice rather than written: their words for the requests, their positions for the result
    replies = C.answer_each(C.word_requests(C.chunk_rows(rows, "k", "t", lower=False, want=("words",))), encoder)
    out = C.finish(C.chunk_rows(rows, "k", "t", lower=False, want=("data",)), replies, place, "k long, ids array<int>, decoded string")
    return out.withColumnRenamed("k", key)


def encoded_digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 digests of encoded rows."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
