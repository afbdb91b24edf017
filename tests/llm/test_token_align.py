"""Cross-tokenizer alignment against a per-document brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers as P
    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(texts, paths):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by byte positions, one text after the other."""
    import sentencepiece
    from tokenizers import Tokenizer

    from voltcast.llm.token_align import byte_level_tokens, piece_tokens
    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    bytes_a, bytes_b = byte_level_tokens(paths[0]), piece_tokens(b)
    found = []
    for text in texts:
        own_a, own_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[i] for i in own_a) != raw or b"".join(bytes_b[i] for i in own_b) != raw:
            found.append(([], [], [], ""))
            continue
        spans = []
        for ids, table in ((own_a, bytes_a), (own_b, bytes_b)):
            at, held = 0, []
            for i in ids:
                held.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(held)
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = "".join(";" * (n > 0) + "|".join(",".join(str(i) for s, e, i in held if (both[n - 1] if n else 0) < e <= cut) for held in spans)
                         for n, cut in enumerate(both)) if len(both) < 3000 else None
        found.append((own_a, own_b, links, groups))
    counts = Counter(x for f in found for x in f[2])
    top = {}
    for (_, b_id), n in counts.items():
        top[b_id] = max(top.get(b_id, 0), n)
    out = []
    for own_a, own_b, links, groups in found:
        digest = "" if not own_a else None if groups is None else hashlib.sha256(groups.encode()).hexdigest()
        out.append((len(own_a), len(own_b), groups.count("|") if groups else 0 if not own_a else None, len(links),
                    sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


TEXTS = [None, "", " ", "\n\n  x", "plain words and more words", "plain words and more words", "Größe ΣΑΣ x y İstanbul   <|endoftext|> <s> don't",
         "has ▁ inside", "日本語 🙂🙂 <0x41> \x00 tab\t end  ", "a", "1234567890 " * 30, "wörter " * 2000 + "ende"]


def test_rows_against_brute_force(spark, paths, monkeypatch):
    from voltcast.llm import token_align
    monkeypatch.setattr(token_align, "BATCH_BYTES", 400)
    texts = [*TEXTS, *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect())]
    docs = spark.createDataFrame([(None if i == 4 else i, t, "clash", i, b"x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, key string, batch long, data binary").repartition(3)
    got = token_align.digests(docs, *paths)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert len(rows) == len(texts)
    for i, want in enumerate(brute(texts, paths)):
        own = rows[None if i == 4 else i]
        assert all(w is None or w == o for w, o in zip(want, own)), (i, texts[i] and texts[i][:50], want, own)
    assert rows[7] == rows[0] == rows[1] == (0, 0, 0, 0, 0, 0, "")
    assert token_align.digests(docs.where("false"), *paths).count() == 0


def test_links_and_cuts_of_each_row(spark, paths):
    from voltcast.llm import token_align
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r, want in zip(token_align.align(docs, *paths).orderBy("doc_id").collect(), brute(TEXTS, paths)):
        assert (len(r.a_ids), len(r.b_ids), len(r.link_a)) == (want[0], want[1], want[3]) and len(r.cut_a) == len(r.cut_b)
        if want[0]:
            groups = [(r.a_ids[p:q], r.b_ids[x:y]) for p, q, x, y in zip([0, *r.cut_a], r.cut_a, [0, *r.cut_b], r.cut_b)]
            s = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            assert want[6] is None or hashlib.sha256(s.encode()).hexdigest() == want[6]


@pytest.mark.parametrize("seed", range(6))
def test_lockstep_runs_of_any_size_give_the_same_links(seed):
    from voltcast.llm.token_align import lockstep, runs
    rng = random.Random(seed)
    sizes = [[[rng.randint(1, 4) for _ in range(rng.randint(1, 120))] for _ in range(7)] for _ in range(2)]
    at, ends = [], []
    for side in range(2):
        for doc in range(7):     # both sides of a text cover the same bytes
            short = sum(sizes[1 - side][doc]) - sum(sizes[side][doc])
            if short > 0:
                sizes[side][doc].append(short)
    for side in range(2):
        at.append(np.cumsum([0] + [len(x) for x in sizes[side]]))
        ends.append(np.cumsum([s for x in sizes[side] for s in x]))
    begins = [np.concatenate([[0], e[:-1]]) for e in ends]
    want = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if max(begins[0][i], begins[1][j]) < min(ends[0][i], ends[1][j])]
    for every in (1, 5, 40, 10_000):
        a, b, cut = lockstep(*ends, *runs(*ends, *at, every))
        assert list(zip(a.tolist(), b.tolist())) == want
        assert set(ends[0][a[cut]].tolist()) == set(ends[0].tolist()) & set(ends[1].tolist())


def test_both_encoders_agree_on_every_character_of_the_quick_range(paths):
    from voltcast.llm.token_align import SAME, _models, byte_level_tokens
    slow, quick, _, held, _ = _models(*paths)
    assert quick is not None
    inside = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000 and SAME.fullmatch(chr(c))]
    assert len(inside) > 30_000
    texts = [f" a{c}b 1{c}2 {c}{c} ,{c}. \n{c}'{c}ll  {c}\t" for c in inside]
    got = [quick.encode_to_numpy(t, disallowed_special=()).tolist() for t in texts]
    assert got == [e.ids for e in slow.encode_batch_fast(texts, add_special_tokens=False)]
    assert [held.spell(np.array(g)) for g in got[::97]] == [t.encode() for t in texts[::97]]
    assert SAME.fullmatch("<|endoftext|>") and SAME.fullmatch("\u0378") is None and len(byte_level_tokens(paths[0])) == 50256


def test_a_vocabulary_out_of_order_goes_without_the_quick_encoder(paths, tmp_path):
    import json

    from voltcast.llm.token_align import _plain_encoder, byte_level_tokens
    spec = json.load(open(paths[0], encoding="utf-8"))
    spec["model"]["merges"][5], spec["model"]["merges"][900] = spec["model"]["merges"][900], spec["model"]["merges"][5]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    assert _plain_encoder(str(other), byte_level_tokens(str(other))) is None
