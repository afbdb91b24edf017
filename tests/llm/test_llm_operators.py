"""Training-data operators against brute force on small frames, with the awkward rows in each."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    found = WORD.findall(text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found] if lower else found


BASE = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
        "phi chi psi omega one two three four five six seven eight nine ten eleven twelve").split()


def corpus() -> list[tuple]:
    """(doc_id, text) with nulls, empty, white-space and long texts, exact and near copies, repeats and non-ASCII."""
    one = " ".join(BASE)
    near = " ".join([*BASE[:17], "changed", *BASE[18:]])
    rows = [(1, one), (2, one.upper()), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "short text"), (8, "short  text"),
            (9, "Größe ΣΑΣ x\u00a0y İstanbul \u2028 <|endoftext|> don't"), (10, " ".join(f"w{i % 997}" for i in range(30_000))),
            (11, "line a b c\nline a b c\nother line here"), (12, "line a b c\nnew words follow now"), (None, one), (None, None),
            (13, one + "\n" + near), (13, one + "\n" + near), (14, "word " * 40), (15, "*** ### $$$ " * 12)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", __file__.rsplit("/tests/", 1)[0])
    rows = [(k, t, "x", f"extra{i}", i) for i, (k, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, key string, node long").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_row(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_word_batches_match_a_regular_expression():
    from voltcast.llm import textbuf as T
    texts = [t for _, t in corpus()]
    for at, piece in T.slices(pa.array(texts, pa.string()), limit=200):
        w = T.Words(piece)
        h = w.hashes()
        for i in range(len(piece)):
            own = words(texts[at + i])
            a, b = w.offsets[i], w.offsets[i + 1]
            assert [w.data[x:y].tobytes().decode() for x, y in zip(w.start[a:b], w.end[a:b])] == own
            assert len(set(h[a:b].tolist())) == len(set(own))


# 1 ---------------------------------------------------------------------------------------------------------------

def test_url_filter(spark):
    from voltcast.llm import url_filter
    from voltcast.llm.queries import URL_RULES
    urls = ["https://WWW.Shop.net/a/index.html?utm_source=x&b=2&a=1#top", "http://shop.net:80/a/?a=1&b=2", "http://shop.net/b", None, "no scheme", "",
            "http://example.org", "http://x.example.org/en/12", "http://example.org/es/", "http://notexample.org/es/q", "http://a.com/de/1", "http://a.com/fr/1",
            "x://http://y/z", "http://org/", "http://shop.net/b"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://shop.net/a?b=2&a=1",), (None,), ("junk",), ("http://example.org/en/12",), ("https://shop.net/a?b=2&a=1",)], "url string")
    got = {r.page_id: r for r in url_filter.judge(pages, listed, URL_RULES).collect()}
    assert [got[i].verdict for i in range(len(urls))] == ["block", "block", "allow", "allow", "allow", "allow", "allow", "block", "block", "allow", "block", "allow",
                                                         "allow", "allow", "allow"]
    assert got[0].host == "www.shop.net" and got[0].path == "/a/index.html" and got[3].host == got[4].path == ""
    assert got[6].rule is None and got[13].rule == "org/" and got[9].rule == "org/" and got[12].host == "http:"
    assert url_filter.judge(pages.where("false"), listed, URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.where("false"), []).collect()} == {"allow"}


def test_bloom_filter_passes_all_members_and_few_others(spark):
    from pyspark.sql import functions as F

    from voltcast.llm import url_filter
    members = spark.range(3000).select(F.concat(F.lit("m"), "id").alias("u"))
    table, n = url_filter.bloom(members, "u")
    hit = F.lit(True)
    for w in range(8):
        hit = hit & (F.col(f"w{w}").bitwiseAND(F.col(f"b{w}")) != 0)
    passed = lambda df: df.select("u", *url_filter._key_columns("u", n)).join(table, "block").where(hit).count()
    assert passed(members) == 3000
    assert passed(spark.range(3000).select(F.concat(F.lit("other"), "id").alias("u"))) < 60


# 2 ---------------------------------------------------------------------------------------------------------------

def test_lm_score(spark, docs, none, monkeypatch):
    from pyspark.sql import functions as F

    from voltcast.llm import lm_score as M
    monkeypatch.setattr(M, "SEGMENT_BYTES", 200)            # several segments
    train = lambda k: k is not None and k % 3 != 0
    got = M.score(docs.withColumn("training", F.col("doc_id") % 3 != 0), "training").collect()
    texts = [(k, words(t) + [None]) for k, t in corpus()]
    c = Counter(w for k, ws in texts if train(k) for w in ws)
    pairs = Counter(p for k, ws in texts if train(k) for p in zip([None, *ws[:-1]], ws))
    n, v = sum(c.values()), len(c)
    q = lambda x: float(M.expected(M.level(np.array([x])))[0]) if x else 0.0
    want, model = [], []
    for k, ws in texts:
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want.append((k if k is not None else -1, len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6)))
        p = [0.7 * (min(q(pairs[a, b]), q(c[a]), q(c[b])) / q(c[a]) if c[a] else 0) + 0.3 * (q(c[b]) + 0.1) / (n + 0.1 * (v + 1)) for a, b in zip([None, *ws[:-1]], ws)]
        model.append((len(ws), float(np.log10(p).sum())))
    have = [(r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(have) == sorted(want)
    # false hits only ever raise a level; most texts are scored exactly
    close = [abs(a - b.score) < 0.05 * abs(a) + 1e-6 for (_, a), b in zip(sorted(model), sorted(got, key=lambda r: (r.n_tokens, r.score)))]
    assert sum(close) >= len(close) - 5
    assert M.score(none.withColumn("training", F.lit(True)), "training").count() == 0
    nothing = M.score(docs.withColumn("training", F.lit(False)), "training").collect()
    assert len(nothing) == len(texts) and {r.train_tokens for r in nothing} == {0}


def test_log_frequency_filter_never_lowers_a_level():
    from voltcast.llm import lm_score as M
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = rng.geometric(0.3, 20_000) ** 3
    levels = M.level(counts)
    read = M.probe(M.build(keys, levels), keys)
    assert (read >= levels).all() and (read > levels).mean() < 0.1
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert (M.probe(M.build(keys, levels), other) > 0).mean() < 0.1


# 3 ---------------------------------------------------------------------------------------------------------------

def test_quality_rules(docs, none):
    from voltcast.llm import quality_rules as Q
    got = Q.judge(docs)
    want = Counter()
    for k, t in corpus():
        ws, lines = words(t, False), [x for x in (t or "").split("\n") if WORD.search(x)]
        runs = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
        c = Counter(runs)
        cover = {j for i, r in enumerate(runs) if c[r] > 1 for j in range(i, i + 8)}
        want[k, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover),
             len(ws) < 20 or 100 * len(cover) > 30 * len(ws)] += 1
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert {r.doc_id for r in got.where("kept").collect()} == {1, 3, None}
    assert Q.judge(none).count() == 0


def test_cascade_verdict_does_not_depend_on_the_order():
    from voltcast.llm import quality_rules as Q
    texts = [t or "" for _, t in corpus()] + ["A LOUD TEXT " * 9, "a | b | c | d", "no no no no no", "!!! ??? !!!", "1234 5678 9", "l\nl\nl\nl\nl", "x" * 90]
    piece = pa.array(texts, pa.large_string())
    first, last = Q.cascade(piece, Q.RULES), Q.cascade(piece, Q.RULES[::-1])
    assert (first == last).all() and (first == ~np.any([r(piece) for r in Q.RULES], axis=0)).all()


# 4 ---------------------------------------------------------------------------------------------------------------

def test_decontamination(spark, none):
    from voltcast.llm import decontam
    item = [f"t{i}" for i in range(30)]
    swapped = [*item[:7], "zz", *item[8:15], "yy", *item[16:]]
    half = item[:6]
    pad = [f"p{i}" for i in range(50)]
    texts = [(1, " ".join(pad + item + pad)), (2, " ".join(pad + swapped)), (3, " ".join(half + pad)), (4, None), (5, ""), (6, " ".join(pad)),
             (None, " ".join(item)), (7, " ".join(item).upper()), (8, "a b c d e f g"), (9, "x a b c d e y"), (1, " ".join(item)), (10, " ".join((pad + item) * 300))]
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts], "doc_id long, text string, item long").repartition(2)
    items = spark.createDataFrame([(1, " ".join(item)), (2, "a b c d e"), (3, "tiny"), (4, None), (5, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, items).collect()}
    assert got == {(d, i) for d in (1, 2, 7, 10, None) for i in (1, 5)} | {(8, 2), (9, 2)}
    assert sorted(r.doc_id for r in decontam.without(docs, items).collect()) == [3, 4, 5, 6]
    assert decontam.without(docs, items).columns == docs.columns
    assert decontam.overlaps(docs.where("false"), items).count() == 0 and decontam.overlaps(docs, items.where("false")).count() == 0


def test_masks_leave_no_placement_of_replaced_words():
    from itertools import combinations

    from voltcast.llm import decontam
    for n in range(decontam.LEAST_WORDS, decontam.SPAN + 1):
        for k in range(n // 4 + 1):
            for p in combinations(range(n), k):
                assert any(not {o + at for o in m} & set(p) for m in decontam.cover(n) for at in range(n - m[-1])), (n, p)


def test_decontamination_at_the_threshold_equals_the_sql(spark):
    """Items of 5 to 18 words with as many replaced words as the rule allows, and one more, in any place."""
    from itertools import combinations

    import duckdb

    from voltcast.llm import decontam
    from voltcast.llm.queries import SQL
    rng = np.random.default_rng(2)
    pad = [f"p{i}" for i in range(9)]
    items, texts = [], []
    for n in range(5, 19):
        item = [f"i{n}w{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for k in range(1, n // 4 + 2):
            places = list(combinations(range(n), k))
            for p in (places if len(places) <= 60 else [places[i] for i in rng.permutation(len(places))[:60]] + [(1, 5, 6)]):
                texts.append(" ".join(pad[:len(texts) % 9] + [f"x{i}" if i in p else w for i, w in enumerate(item)] + pad[len(texts) % 4:]))
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
        db.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
        cursor = db.execute(SQL["op4_decontam"])
        want = [dict(zip([c[0] for c in cursor.description], r)) for r in cursor.fetchall()]
    got = decontam.overlaps(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3),
                            spark.createDataFrame(items, "item_id long, text string"))
    cols = ("doc_id", "item_id", "start_word", "n_matched", "n_item")
    assert len(want) > 300 and by_row(got, *cols) == Counter(tuple(r[c] for c in cols) for r in want)


# 5 and 10 --------------------------------------------------------------------------------------------------------

def auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality_model", "quality", 0.98), ("op10_toxicity", "toxic", 0.93)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    from voltcast.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in y]
    assert len(rows) == 10_000 and auc([r.score for r in held], [y[r.doc_id] for r in held]) >= least
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


@pytest.mark.parametrize("module", ["quality_model", "toxicity"])
def test_classifier_edges(spark, docs, none, module):
    import importlib

    from pyspark.sql import functions as F
    m = importlib.import_module(f"voltcast.llm.{module}")
    labels = spark.createDataFrame([(1, 1), (14, 0), (15, 0), (None, 1), (3, None), (1, 1)], "doc_id long, y int")
    for use in (labels, labels.where("false"), labels.where("y = 1")):
        got = m.classify(docs, use, F.lit(True), label="y").collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in corpus())
        assert all(0 <= r.score <= 1 for r in got)
    assert m.classify(none, labels, F.lit(True), label="y").count() == 0


def test_pairwise_scores_follow_the_preference():
    from voltcast.llm import logistic
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 1, (300, 2)), rng.normal(0, 1, (300, 2))
    d = good - bad
    w = logistic.newton(np.concatenate([d, -d]), np.repeat([1.0, 0.0], 300), 1e-4)
    assert (good @ w > bad @ w).mean() > 0.8


def test_classifiers_learn_from_all_labelled_rows(spark, monkeypatch):
    """More rows than the old bound of 20,000 are read, and all of them decide the quantile."""
    from pyspark.sql import functions as F

    from voltcast.llm import logistic
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))
    assert logistic.labelled_sample(docs, labels, "doc_id", "text", "y", F.lit(True)).count() == 21_000
    v = np.random.default_rng(5).integers(0, 300, 4000) ** 2.0
    table = spark.createDataFrame([(float(x),) for x in v], "v double")
    monkeypatch.setattr(logistic, "FEW", 50)
    for share in (0.0, 0.137, 0.5, 1.0):
        assert abs(logistic.quantile(table, share) - np.quantile(v, share)) < 1e-9


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_edit_distance():
    from voltcast.llm.toxicity import STEM_HIT, Automaton
    terms = ["idiot", "scum", "loser", "looser", "abc*"]
    a = Automaton(terms)
    rng = np.random.default_rng(5)
    tried = {"".join(rng.choice(list("idotscumlerabx"), rng.integers(1, 8))) for _ in range(2000)} | {"idoit", "idiott", "1diot", "sum", "abcdef", "abc", "lose", "xloser"}
    tried |= {t[:i] + c + t[i + k:] for t in terms[:4] for i in range(len(t)) for c in ("", "x") for k in (0, 1)}
    for w in tried:
        far = min((d for t in terms[:4] if (d := edit(w, t)) <= (1 if len(t) >= 5 else 0)), default=None)
        assert a.match(w) == (far if far is not None else STEM_HIT if w.startswith("abc") else -1), w


def test_quoted_terms_are_not_abuse():
    from voltcast.llm.toxicity import Automaton, hits
    a = Automaton(["idiot"])
    assert [q for *_, q in hits('they said "you idiot" to us. Idiot!', a)] == [True, True]
    assert [(e, q) for _, e, q in hits("you id1ot, go " + "away " * 9 + "Idiot!", a)] == [(1, False), (0, False)]
    assert hits("", a) == []
    between = 'x "foo bar" idiot "baz qux" y'
    deep = '"one ' + "word " * 20 + "idiot " + "word " * 20 + 'end" idiot'
    assert [q for *_, q in hits(between, a)] == [False] and [q for *_, q in hits(deep, a)] == [True, False]
    assert [q for *_, q in hits('never "closed idiot here', a)] == [False] and [q for *_, q in hits('«idiot» " idiot " idiot', a)] == [True, True, False]


# 6 ---------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("share", [0.5, 0.8])
def test_toxicity_learns_from_mostly_toxic_labels(spark, share):
    from voltcast.llm import toxicity
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1000):
        toxic = int(i < share * 1000)
        body = [f"plain{x}" for x in rng.integers(0, 300, 30)]
        rows.append((i, " ".join(body + ["scumbag", "moron"][i % 2:][:1] * toxic), toxic))
    sample = spark.createDataFrame(rows, "k long, t string, y int")
    model = toxicity.fit(sample)
    got = {r.doc_id: r.predicted for r in toxicity.score(sample.withColumnRenamed("k", "doc_id").withColumnRenamed("t", "text"), model).collect()}
    assert got == {i: y for i, _, y in rows}


def test_density_of_long_texts_is_counted():
    from voltcast.llm.toxicity import Automaton, densest, features
    automaton = Automaton(["idiot"])
    near = 7
    scattered, quoted = ("word " * 99 + "idiot ") * 250, 'word "idiot" ' * 250
    assert [features(t, automaton)[near] for t in (scattered, quoted, "idiot " * 250)] == [np.log1p(1), 0.0, np.log1p(50)]
    rng = np.random.default_rng(3)
    for _ in range(50):
        places = sorted(set(rng.integers(0, 900, rng.integers(0, 300)).tolist()))
        assert densest(places) == max((sum(1 for j in places if i <= j < i + 50) for i in places), default=0)


def brute_components(rows, t=(3, 4)):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and t[1] * both >= t[0] * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)].append(k)
    return Counter((k, len(sets[i]), min(low[root(i)], default=None) if sets[i] else k) for i, (k, _) in enumerate(rows))


def test_jaccard_components(docs, none):
    from voltcast.llm import jaccard_join as J
    assert by_row(J.components(docs), "doc_id", "n_shingles", "component_id") == brute_components(corpus())
    assert J.components(none).count() == 0
    assert J.representatives(docs).columns == docs.columns


def test_jaccard_chains_and_large_groups(spark):
    """Near copies around and beyond the threshold, in chains, of several sizes."""
    from voltcast.llm import jaccard_join as J
    rng = np.random.default_rng(11)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in rng.integers(0, 400, 60 + 40 * g)]
        for _ in range(45):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(0, 5)):
                own[at] = f"n{rng.integers(0, 10**6)}"
            if rng.random() < 0.3:
                own = own[: int(len(own) * 0.85)]
            if rng.random() < 0.2:
                base = own
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert by_row(J.components(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_components_of_random_graphs(spark):
    from voltcast.llm.connect import components
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, root(x)) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.component) for r in got.collect()} == want and got.count() == len(want)


# 7 ---------------------------------------------------------------------------------------------------------------

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)}
    out = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_base_spans(spark, docs, none):
    import hashlib

    from voltcast.llm import pii
    texts = ["a@b.c..d@e.f x@y.z_w@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111  12",
             "+1 (017) 555-7713 +49 30 1234567+1 (017) 555-7713", "é日本😀 4111111111111111 a.b@c-d.e", "", None, "1" * 20000, "1 " * 5000,
             "a." * 9000 + "@b.c", ".a" * 5000 + "@" + "a." * 5000 + "b", "4111 1111 1111 1111 0 1.2.3.4@x.com"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    for r in pii.digests(pii.find(df)).collect():
        assert (r.spans, r.base_sha256) == ((s := brute_spans(texts[r.doc_id])), hashlib.sha256(s.encode()).hexdigest())
    assert pii.find(docs).count() == len(corpus()) and pii.find(none).count() == 0


def test_pii_bootstrap_finds_unseen_identifiers_in_trusted_contexts(spark):
    from voltcast.llm import pii
    good = ["4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "6011000000000004", "4012888888881881", "5105105105105100", "4222222222222"]
    rows = [(i, f"text about credit card {g} and more") for i, g in enumerate(good * 2)]
    rows += [(100, "the credit card 4111-XXXX-XXXX-9999 and more words"), (101, "unrelated 4111-XXXX-XXXX-9999 here"), (102, "credit card holder and more")]
    got = {r.doc_id: r for r in pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[100].spans == "card:16:35" and got[100].n_card == 0 and got[102].spans == ""
    assert got[101].spans == ""


def test_pii_bootstrap_finds_identifiers_with_blanks_and_spelt_out_at(spark):
    from voltcast.llm import pii
    rows = [(i, f"my phone number {p} is here and my e-mail address {m} is here and my credit card {c} is here") for i, (p, m, c) in enumerate(zip(
        [f"+49 30 12345{i}7" for i in range(8)], [f"name{i}@mail.org" for i in range(8)],
        ["4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "6011000000000004", "4012888888881881", "5105105105105100", "4222222222222"]))]
    planted = [("phone", "my phone number ", "030 1234 5678"), ("phone", "my phone number (", "030) 1234 5678"), ("card", "my credit card ", "4111 XXXX XXXX 9999"),
               ("email", "my e-mail address ", "jane(at)mail.org"), ("email", "my e-mail address ", "jane[at]mail.org"), ("email", "my e-mail address ", "jane (at) mail.org"),
               ("email", "my e-mail address ", "jane.doe7 [at] mail.org")]
    rows += [(100 + i, f"{before}{m} is here") for i, (_, before, m) in enumerate(planted)]
    rows += [(200, "we met (at) noon and [at] night"), (201, "room 12 34 56 78 90 was empty"), (202, "x x x x x x x x x x x x x"), (203, "7 " * 6000)]
    got = {r.doc_id: r.spans for r in pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [got[100 + i] for i in range(len(planted))] == [f"{kind}:{len(before)}:{len(before) + len(m)}" for kind, before, m in planted]
    assert [got[i] for i in (200, 201, 202, 203)] == [""] * 4


def test_pii_runs_without_python(spark):
    from voltcast.llm import pii
    plan = pii.find(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 8 ---------------------------------------------------------------------------------------------------------------

SPLIT = re.compile(rb"[^\s!-/:-@\[-`{-~]+")


def brute_lines(rows):
    lines = [(k, i, tuple(SPLIT.findall(x.encode().lower()))) for k, t in rows for i, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    distinct = list(dict.fromkeys(w for *_, w in lines))
    bags = [Counter(w) for w in distinct]
    parent = {w: w for w in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            longer = max(len(a), len(b))
            # words in common bound the distance from below
            if 10 * abs(len(a) - len(b)) <= longer and 10 * (longer - sum((bags[i] & bags[j]).values())) <= longer and 10 * edit(a, b) <= longer:
                parent[root(a)] = root(b)
    first = {}
    for k, i, w in sorted(lines, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        first.setdefault(root(w), (k, i))
    drop = defaultdict(set)
    for k, i, w in lines:
        if first[root(w)] != (k, i):
            drop[k].add(i)
    return drop


def test_line_dedup(spark):
    from voltcast.llm import line_dedup as L
    rng = np.random.default_rng(4)
    long = [f"v{i}" for i in rng.integers(0, 10**6, 120)]
    changed = [" ".join([*long[:at], f"new{at}", *long[at + 1:]]) for at in range(0, 120, 7)]
    rows = [(k, t) for k, t in corpus() if k is not None and k not in (10, 13)]
    rows += [(20 + i, f"{c}\nown line {i}\n\n--- ---\nline A b, c!") for i, c in enumerate(changed)] + [(90, " ".join(long)), (91, "\n".join(f"common {i % 3}" for i in range(300)))]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, drop string, doc long").repartition(3)
    drop = brute_lines(rows)
    got = L.dedup(df)
    assert got.columns == [*df.columns, "n_removed"]
    for r in got.collect():
        text = dict(rows)[r.doc_id]
        assert r.n_removed == len(drop[r.doc_id])
        assert r.text == (text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop[r.doc_id]))
    assert L.dedup(df.where("false")).count() == 0
    null = spark.createDataFrame([(None, "some line of words"), (1, "some line of words"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in L.dedup(null).collect()} == {(None, ""), (1, "some line of words"), (None, None)}


def test_line_dedup_loses_no_link_at_the_bound(spark):
    """Lines with exactly a tenth of the words changed, put in or left out, some of repeated words, and one of nine words beside one of ten."""
    from voltcast.llm import line_dedup as L
    rng = np.random.default_rng(21)
    lines = ["a b c d e f g h i", "a b c d e x f g h i", "p q r s t u v w", "p q r s t u v w x", *[" ".join("xy"[i % 2] if i != at else "z" for i in range(10)) for at in range(11)]]
    for n in [10, 19, 20, 29, 30, 50, 81] * 6:
        a = [f"u{x}" for x in rng.integers(0, 3 * n, n)]
        b = list(a)
        for at in sorted(rng.permutation(n)[:n // 10].tolist(), reverse=True):
            b[at:at + 1] = [["other"], [b[at], "extra"], []][rng.integers(0, 3)]
        lines += [" ".join(a), " ".join(b)]
    rows = list(enumerate(lines))
    drop = brute_lines(rows)
    assert len(drop) > 30 and 1 in drop and 3 not in drop
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id for r in got if r.n_removed} == {k for k, d in drop.items() if d}


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies that differ from one line in a word each are compared with that line, not with each other."""
    from voltcast.llm import line_dedup as L
    base, seen = [f"w{i}" for i in range(40)], []
    real = L._similar
    monkeypatch.setattr(L, "_similar", lambda pairs: (seen.append(pairs.count()), real(pairs))[1])
    rows = [(0, " ".join(base))] + [(i, " ".join([*base[:i % 40], f"new{i}", *base[i % 40 + 1:]])) for i in range(1, 400)]
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert [r.doc_id for r in got.where("n_removed = 0").collect()] == [0] and sum(seen) < 3 * len(rows)


def test_near_copies_beside_a_longer_line_make_few_pairs(spark, monkeypatch):
    """Their buckets' centre must not be the line that holds all of their runs but is too long to be similar."""
    from voltcast.llm import line_dedup as L
    base, seen = [f"w{i}" for i in range(40)], []
    real = L._similar
    monkeypatch.setattr(L, "_similar", lambda pairs: (seen.append(pairs.count()), real(pairs))[1])
    rows = [(0, " ".join([*base, *(f"tail{i}" for i in range(5))]))]
    rows += [(i, " ".join(f"new{i}x{j}" if j in (i % 20, 20 + i % 20) else w for j, w in enumerate(base))) for i in range(1, 200)]
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in got.where("n_removed = 0").collect()} == {0, 1} and sum(seen) < 3 * len(rows)


def test_word_edit_distance_within_a_limit():
    from voltcast.llm.line_dedup import within
    rng = np.random.default_rng(6)
    for _ in range(400):
        a, b = (rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint64) for _ in range(2))
        far = edit(a.tolist(), b.tolist())
        assert [within(a, b, k) for k in range(6)] == [far <= k for k in range(6)]


def recall_of_similar_lines(spark, rows, similar):
    """Share of the pairs of similar lines that are in one group, and whether all groups are of linked lines."""
    from voltcast.llm import line_dedup as L
    df = spark.createDataFrame(rows, "doc long, key long, t string").repartition(4)
    group = {r.node: r.component for r in L._groups(df).collect()}
    hashes = L.Lines(pa.array([t for *_, t in rows], pa.large_string())).hash.view(np.int64).tolist()
    found = [group.get(hashes[a]) is not None and group.get(hashes[a]) == group.get(hashes[b]) for a, b in similar]
    return sum(found) / len(found), {hashes.index(n) for n in group}


def test_line_dedup_compares_no_pairs_that_only_share_a_passage(spark, monkeypatch):
    from pyspark.sql import functions as F

    from voltcast.llm import line_dedup as L
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(41))
    # own words make too few runs of five to settle that no line is similar
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(20)) + " " + passage) for i in range(80)]
    rows += [(100 + i, rows[i][1].replace("p20 ", f"q{i} ")) for i in range(5)]
    compared = []
    similar = L._similar

    def counted(pairs):
        compared.append(pairs.select("a", "b").distinct().count())
        return similar(pairs)

    monkeypatch.setattr(L, "_similar", counted)
    out = L.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.where(F.col("n_removed") > 0).collect()} == {100, 101, 102, 103, 104}
    assert sum(compared) < 300             # 3500 and more pairs share the passage


def test_signs_turn_no_more_than_edits_can_and_tables_agree_with_single_comparisons():
    from voltcast.llm import line_dedup as L
    rng = random.Random(3)
    pairs, limits = [], []
    for _ in range(400):
        a = [rng.randrange(50) for _ in range(rng.randrange(9, 80) if rng.random() < 0.95 else 600)]
        b = list(a)
        for _ in range(edits := rng.randrange(8)):
            at = rng.randrange(len(b))
            b[at:at + rng.randrange(2)] = [rng.randrange(50)] * rng.randrange(2)
        signs = L.signs(np.array(a + b, np.uint32), np.array([0, len(a), len(a) + len(b)]))
        turned = sum(int(x[0] ^ x[1]).bit_count() for x in signs)
        assert turned <= 2 * edits - abs(len(a) - len(b))
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
        limits.append(rng.randrange(8))
    expected = [L.within(a, b, k) for a, b, k in zip([p[0] for p in pairs], [p[1] for p in pairs], limits)]
    assert L.within_all(pairs, np.array(limits)).tolist() == expected
    assert L.within_all([], np.zeros(0, np.int64)).tolist() == []


def test_line_dedup_finds_nearly_all_similar_lines(spark):
    """Against the edit distance alone: one word, or a twentieth, of lines of usual length changed, put in or left out; nothing else is linked.

    README has the recall on the tables, and at the very bound of the similarity.
    """
    rng = np.random.default_rng(15)
    usual = lambda n: [f"unusual{x}" if x % 3 else ["of", "the", "and", "in", "to"][x % 5] for x in rng.integers(0, 40 * n, n)]
    lines, similar = [], []
    for n in [10, 14, 20, 30, 40, 80] * 20:
        a = usual(n)
        for edits in {1, max(1, n // 20)}:
            b = list(a)
            for at in rng.permutation(n)[:edits]:
                kind = rng.integers(0, 3)
                b[at:at + 1] = [["other%d" % rng.integers(10**6)], [b[at] if at < len(b) else "end", "extra%d" % rng.integers(10**6)], []][kind]
            similar.append((len(lines), len(lines) + 1))
            lines += [" ".join(a + [f"mark{len(lines)}"]), " ".join(b + [f"mark{len(lines)}"])]
    alone = [" ".join(usual(12)) for _ in range(200)]
    rows = [(i, i, t) for i, t in enumerate([*lines, *alone, "a b c", "a b d"])]
    got, linked = recall_of_similar_lines(spark, rows, similar)
    assert got == 1, got
    assert linked <= set(range(len(lines)))


# 9 ---------------------------------------------------------------------------------------------------------------

def test_bpe(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from voltcast.llm import bpe
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    want = Counter()
    for k, text in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[k, tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(docs, path).collect())
    assert got == want
    assert bpe.encode(none, path).count() == 0


# pipeline --------------------------------------------------------------------------------------------------------

def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    from voltcast.llm import logistic, quality_model
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = []
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        held.append(docs)
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(P.STAGES) - 1:
            assert docs.columns == held[0].columns
    rows = [{r.doc_id: r for r in d.collect()} for d in [*held, docs]]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.fit(logistic.labelled_sample(held[0], labels, "doc_id", "text", "quality", P._training()))
    piece = pa.array([r.text for r in rows[0].values()], pa.large_string())
    assert set(rows[1]) == {k for k, s in zip(rows[0], model.score(quality_model.features(piece))) if s >= 0.3}
    drop = brute_lines([(k, r.text) for k, r in rows[1].items()])
    assert {k: r.text for k, r in rows[2].items()} == {k: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in drop[k]) for k, r in rows[1].items()}
    assert all(r.n_chars == len(r.text) for r in rows[2].values())
    assert set(rows[3]) == {k for k, _, c in brute_components([(k, r.text) for k, r in rows[2].items()]) if k == c}
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def contains(text):
        w = words(text)
        for item in items:
            span = min(13, len(item))
            for shift in range(-len(item) + span, len(w) - span + 1):
                a, b = max(shift, 0), min(shift + len(item), len(w))
                same = [w[i] == item[i - shift] for i in range(a, b)]
                if any(4 * sum(same[i:i + span]) >= 3 * span for i in range(len(same) - span + 1)):
                    return True
        return False

    assert set(rows[4]) == {k for k, r in rows[3].items() if not contains(r.text)}
    assert set(rows[5]) == set(rows[4])
    empty = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0
