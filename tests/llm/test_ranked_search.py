"""Ranked search against brute force, over one block of items and many."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    counts = [(k, Counter(terms(t))) for k, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ws in wanted.items():
        scored = []
        for k, c in counts:
            if c:
                m = 10 + 90 * sum(c.values()) * n_docs // n_terms
                scored.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in ws if c[w]), k))
        best = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:top]
        out += [(i, r + 1, k, s) for r, (s, k) in enumerate(best)]
    return sorted(out, key=str)


DOCS = [(1, "Alpha beta, gamma"), (2, "alpha_beta gamma gamma"), (3, None), (4, ""), (5, "... !!!"), (6, "Größe ΣΑΣ don't x y 7"), (7, "alpha " * 30_000 + "omega"),
        (8, "alpha beta"), (8, "alpha beta"), (None, "alpha beta"), (9, "delta"), *((i, "beta gamma delta") for i in range(40, 20, -1))]
ITEMS = [(1, "alpha BETA"), (2, "größe, don t"), (3, None), (4, "unseen words"), (5, "delta"), (5, "omega beta"), (None, "gamma"), (6, "")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(k, t, "clash", "clash", 1) for k, t in DOCS], "doc_id long, text string, key string, item string, score int").repartition(5)
    items = spark.createDataFrame([(k, t, "clash") for k, t in ITEMS], "item_id long, text string, term string")
    return docs, items


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ranks_against_brute_force(tables, monkeypatch):
    from voltcast.llm import ranked_search
    docs, items = tables
    got = ranked_search.search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == brute(DOCS, ITEMS)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 3)
    monkeypatch.setattr(ranked_search, "CELLS", 5)
    assert rows(ranked_search.search(docs, items)) == brute(DOCS, ITEMS)
    assert rows(ranked_search.search(docs, items, top=2)) == brute(DOCS, ITEMS, 2)


def test_empty_tables(tables):
    from voltcast.llm import ranked_search
    docs, items = tables
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs, items.where("item_id = 3")), (docs.where("text is null"), items)):
        out = ranked_search.search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_documents_of_the_small_table(spark):
    from voltcast.llm import ranked_search
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(ranked_search.search(docs, items)) == want
