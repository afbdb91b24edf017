"""Toxicity by a lexicon that is matched with spelling errors, in context.

A lexicon of abusive terms is learned from a bounded labelled sample: words
and stems (``abc*``: words that begin so) whose documents are toxic far more
often than chance allows. Its trie is intersected with Levenshtein automata
(one error for whole words of five letters or more, none for stems): states are
sets of (trie node, errors), made as texts need them. Each
hit is read in a window of words around it: a hit between quotation marks, or
within ``WINDOW`` words of a word of saying, counts as quoted, else as abuse. A logistic model over
counts of exact, misspelled, stem and quoted hits gives the score. Quotation
marks are paired over the whole text; one that is never closed opens nothing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltcast.llm import logistic as L
from voltcast.llm.connect import written

CUT = 0.3
STEMS = range(4, 9)                      # letters of a stem
STEM_HIT = 2                             # how ``match`` reports a stem; 0 and 1 are the errors of a whole word
WINDOW = 6
STRIP = ".,;:!?\"'()[]{}*#$%&|<>-_/«»„“”‘’…"
OPEN, CLOSE = "\"«„“‘", "\"»“”’"
SAYING = frozenset("said says say wrote writes called calls quote quoted quotes sagte schrieb nannte zitat dit écrit appelé citation dijo escribió llamó cita".split())


def tokens(text: str) -> list[str]:
    return text.lower().split()


class Automaton:
    """Levenshtein automata of all terms at once, determinised on demand over their trie."""

    def __init__(self, terms: list[str], errors: int = 1, least: int = 5):
        self.children: list[dict[str, int]] = [{}]
        self.allowed: dict[int, int] = {}
        self.stems: set[int] = set()
        self.errors = errors
        for term in terms:
            node = 0
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            if term.endswith("*"):
                self.stems.add(node)
            else:
                self.allowed[node] = errors if len(term) >= least else 0
        self.start = self._closed({(0, 0)})
        self.known: dict[str, int] = {}
        self.clean: set[str] = set()      # words as they stand in texts, with what is stripped, that are no term
        self._forget()

    def _forget(self) -> None:
        """No states but the start; a state is a number, its moves, its fewest errors as a whole word (or none) and whether a stem ends there."""
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.whole: list[int | None] = []
        self.stem: list[bool] = []
        self.n_moves = 0
        self._number(self.start)

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.whole.append(min((e for node, e in state if e <= self.allowed.get(node, -1)), default=None))
            self.stem.append(any(e == 0 and node in self.stems for node, e in state))
        return self.numbers[state]

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With letters of the term left out (an error each); only the fewest errors of a node are kept."""
        best: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if best.get(node, self.errors + 1) <= e:
                continue
            best[node] = e
            if e < self.errors:
                todo.extend((child, e + 1) for child in self.children[node].values())
        return frozenset(best.items())

    def _move(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e in state:
            if c in self.children[node]:
                out.add((self.children[node][c], e))
            if e < self.errors:
                out.add((node, e + 1))
                out.update((child, e + 1) for child in self.children[node].values())
        return self._closed(out)

    def match(self, word: str) -> int:
        """-1 for no term, else the errors of the closest whole word, else STEM_HIT."""
        found = self.known.get(word)
        if found is None:
            at, stem = 0, False
            for c in word:
                after = self.moves[at].get(c)
                if after is None:
                    state = self.states[at]
                    if self.n_moves > 200_000:
                        self._forget()
                        at = self._number(state)
                    after = self.moves[at][c] = self._number(self._move(state, c))
                    self.n_moves += 1
                at = after
                if not self.states[at]:
                    break
                stem = stem or self.stem[at]
            found = self.whole[at]
            if found is None:
                found = STEM_HIT if stem else -1
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = found
        return found

    def seen(self, words: list[str]) -> dict[str, int]:
        """The terms among words as they stand in a text, and how ``match`` reports them."""
        found = {}
        for w in set(words).difference(self.clean):
            e = self.match(w.strip(STRIP))
            if e >= 0:
                found[w] = e
            else:
                if len(self.clean) > 500_000:
                    self.clean.clear()
                self.clean.add(w)
        return found


def quotations(words: list[str]) -> np.ndarray:
    """Which words lie between paired quotation marks; marks stand at the beginning and the end of words."""
    inside = np.zeros(len(words), bool)
    begin = None
    for i, w in enumerate(words):
        if begin is None and w[0] in OPEN:
            begin = i
            if len(w) == 1:
                continue
        if begin is not None and w.rstrip(".,;:!?")[-1:] in CLOSE and w.rstrip(".,;:!?"):
            inside[begin:i + 1] = True
            begin = None
    return inside


def hits(text: str, automaton: Automaton) -> list[tuple[int, int, bool]]:
    """(word position, errors, quoted) of each term in a text."""
    words = tokens(text)
    terms = automaton.seen(words)
    if not terms:
        return []
    inside = quotations(words)
    return [(i, terms[w], bool(inside[i]) or any(x.strip(STRIP) in SAYING for x in words[max(0, i - WINDOW):i])) for i, w in enumerate(words) if w in terms]


def densest(places: list[int], reach: int = 50) -> int:
    """Most of the sorted places that lie within ``reach`` words."""
    most = first = 0
    for last, place in enumerate(places):
        while place - places[first] >= reach:
            first += 1
        most = max(most, last - first + 1)
    return most


def features(text: str, automaton: Automaton) -> list[float]:
    found = hits(text, automaton)
    if not found:
        return [1.0] + [0.0] * 9
    exact, fuzzy, stem = (sum(1 for _, e, q in found if not q and e == kind) for kind in (0, 1, STEM_HIT))
    quoted = len(found) - exact - fuzzy - stem
    near = densest([i for i, _, q in found if not q])
    return [1.0, float(exact > 0), np.log1p(exact), float(fuzzy > 0), np.log1p(fuzzy), float(quoted > 0), np.log1p(quoted), np.log1p(near),
            float(stem > 0), np.log1p(stem)]


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray
    automaton: Automaton = field(init=False)

    def __post_init__(self):
        self.automaton = Automaton(self.terms)

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Words and stems that are abusive by their documents' labels; all that pass, from the bounded sample.

    A term is taken when most of its documents are toxic, at more than twice the
    sample's odds (which some share fulfils however many are toxic), and that
    share is farther from the sample's than chance explains among all distinct words
    (document count times divergence above log of the number of terms plus 3).
    The strongest come first, at equal strength whole words and then long stems; one
    whose documents earlier terms account for is left out.
    """

    def words(batches):
        n, k = Counter(), Counter()

        def flush():
            rows = pa.RecordBatch.from_pydict({"w": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64()),
                                               "k": pa.array([k[w] for w in n], pa.int64())})
            n.clear()
            k.clear()
            return rows

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {w.strip(STRIP) for w in tokens(t)}
                own |= {w[:size] + "*" for w in own for size in STEMS if len(w) > size}
                own.discard("")
                n.update(own)
                if y == 1:
                    k.update(own)
                if len(n) > 200_000:
                    yield flush()
        yield flush()

    sizes = sample.groupBy("y").count().collect()
    total, toxic = sum(r["count"] for r in sizes), sum(r["count"] for r in sizes if r.y == 1)
    if not toxic or toxic == total:
        return []
    base = toxic / total
    counts = sample.select("t", "y").mapInArrow(words, "w string, n long, k long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    counts = written(counts, "terms")
    size = counts.count()
    p = F.col("k") / F.col("n")
    gain = F.col("n") * (p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0))
    found = counts.where((F.col("k") > 0) & (p > 0.5) & (F.col("k") * (total - toxic) > 2 * (F.col("n") - F.col("k")) * toxic) & (gain > float(np.log(size) + 3)) & (F.length("w") > 2))
    chosen: dict[str, int] = {}
    for r in found.orderBy(F.round(gain, 6).desc(), F.col("w").endswith("*"), F.length("w").desc(), "w").collect():
        bare = r.w.rstrip("*")
        covered = any(bare[:size] + "*" in chosen for size in range(1, len(bare) + 1))
        if r.w.endswith("*"):
            covered = covered or sum(k for w, k in chosen.items() if w.startswith(bare)) >= 0.9 * r.k
        if not covered:
            chosen[r.w] = r.k
    return list(chosen)


def fit(sample: DataFrame, l2: float = 1e-3) -> Model:
    """Learn lexicon and weights from the (k, t, y) rows of ``logistic.labelled_sample``; without both classes every text scores 0."""
    sample = written(sample, "labelled")
    terms = learn_lexicon(sample)
    automaton_terms = terms

    def rows(batches):
        automaton = Automaton(automaton_terms)
        for batch in batches:
            got = [features(t, automaton) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.list_(pa.float64()))], ["k", "y", "x"])

    if not terms:
        return Model([], np.array([-9.0] + [0.0] * 9))
    got = written(sample.select(F.col("k").cast("string"), "t", "y").mapInArrow(rows, "k string, y int, x array<double>"), "features")

    def sums(w: np.ndarray) -> np.ndarray:
        return L.summed(got, lambda batch: L.gradient_sums(np.array(batch.column(2).to_pylist()), batch.column(1).to_numpy().astype(float), w))

    return Model(terms, L.newton_over(sums, 10, l2, free=0))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score, predicted (1 if score >= CUT), and the counts of abusive and quoted hits."""

    def run(batches):
        for batch in batches:
            x = np.array([features(t or "", model.automaton) for t in (v.as_py() for v in batch.column(1))]).reshape(-1, 10)
            s = L.sigmoid(x @ model.weights)
            counts = np.round(np.expm1(x)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32)),
                                              pa.array(counts[:, 2] + counts[:, 4] + counts[:, 9]), pa.array(counts[:, 6])], ["k", "score", "predicted", "n_abusive", "n_quoted"])

    return (docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string"))
            .mapInArrow(run, "k long, score double, predicted int, n_abusive long, n_quoted long").withColumnRenamed("k", key))


def classify(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Learn from the labelled rows where ``train`` holds, score every row.

    Defined cases: a null text scores as an empty one; rows are scored one by
    one; null labels are left out; without both classes among the labels the
    lexicon is empty and every text scores near 0; other columns are ignored;
    an empty table gives an empty result.
    """
    return score(docs, fit(L.labelled_sample(docs, labels, key, text, label, train)), key, text)
