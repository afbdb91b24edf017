from voltcast.llm import toxicity as X


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def plain(word: str, terms: list[str]) -> int:
    errors = [distance(word, t) for t in terms if not t.endswith("*")
              and distance(word, t) <= (1 if len(t) >= 5 else 0)]
    return min(errors) if errors else X.STEM_HIT if any(word.startswith(t[:-1]) for t in terms if t.endswith("*")) else -1


TERMS = ["grumble", "nasty", "bad", "spoil*", "rott*"]
WORDS = ["grumble", "grumbel", "grmble", "nastyy", "nsaty", "bad", "badd", "spoiler", "spoi", "rotten", "rott", "rot", "", "hello", "grumbles"]


def test_states_are_looked_up_once_and_match_as_a_plain_search(monkeypatch):
    a = X.Automaton(TERMS)
    assert [a.match(w) for w in WORDS] == [plain(w, TERMS) for w in WORDS]
    # each state's stem and errors are settled once: new words over known states cost lookups only
    a.known.clear()
    monkeypatch.setattr(a, "_move", lambda *_: 1 / 0)
    monkeypatch.setattr(a, "stems", None)
    monkeypatch.setattr(a, "allowed", None)
    assert [a.match(w) for w in WORDS] == [plain(w, TERMS) for w in WORDS]


def test_states_forgotten_inside_a_word_change_nothing():
    a = X.Automaton(TERMS)
    for w in WORDS:
        a.n_moves = 200_001
        assert a.match(w) == plain(w, TERMS)


def test_words_without_terms_are_passed_over(monkeypatch):
    a = X.Automaton(TERMS)
    text = "hello there, «nasty» people said grumbl and more hello"
    found = X.hits(text, a)
    assert found == [(2, 0, True), (5, 1, True)]
    a.known.clear()
    asked = []
    monkeypatch.setattr(a, "match", lambda w: asked.append(w) or plain(w, TERMS))
    assert X.hits(text, a) == found and sorted(asked) == ["grumbl", "nasty"]
