import random
import re
import unicodedata

from lexmill.llm import contamination as C


def _words(n, seed):
    r = random.Random(seed)
    return ["w" + "".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(n)]


def test_passages_that_share_their_beginning():
    x, y, z = _words(24, 1), _words(16, 2), _words(16, 3)
    ix = C.Index([(1, " ".join(x + y), "q", "a"), (2, " ".join(x + z), "q", "a")])
    assert {k.item_id for k in C.leaks(ix, " ".join(_words(30, 4) + x + y + _words(30, 5)))} == {1, 2}


def test_stretch_of_many_passages():
    x = _words(24, 1)
    ix = C.Index([(i, " ".join(x + _words(22, 100 + i)), "q", "a") for i in range(12)] + [(99, " ".join(_words(40, 7)), "q", "a")])
    assert {k.item_id for k in C.leaks(ix, " ".join(_words(9, 8) + x + _words(9, 9)))} == set(range(12))


def test_own_matches_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        texts = [[r.choice("abc") for _ in range(r.randrange(4, 14))] for _ in range(5)]
        doc = [r.choice("abcd") for _ in range(40)]
        want = {}
        for n, t in enumerate(texts):
            have = {tuple(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
            own = [max((k for k in range(1, j + 2) if tuple(doc[j + 1 - k : j + 1]) in have), default=0) for j in range(len(doc))] + [0]
            if total := sum(a for a, b in zip(own, own[1:], strict=False) if a >= C.SEED and b != a + 1):
                want[n] = total
        assert C.SuffixAutomaton(texts).own_matches(doc) == want


def test_words_alone_are_those_with_places():
    r = random.Random(11)
    odd = "aB9_ é§º½™–“…\xa0\xad\u0301\u200bßﬁ①Ω中\ud800|.\n"
    for _ in range(3_000):
        t = "".join(r.choice(odd) for _ in range(r.randint(0, 30)))
        assert C.raw_words(t) == C.words_at(t)[0]
        assert C.words(t) == re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower())


def test_nothing_is_placed_or_aligned_that_cannot_leak(monkeypatch):
    x, q = _words(40, 1), _words(12, 2)
    ix = C.Index([(1, " ".join(x), " ".join(q), " ".join(_words(12, 3)))])
    aligned = []
    align = C.align
    monkeypatch.setattr(C, "align", lambda part, *rest: aligned.append(part) or align(part, *rest))
    assert [k.part for k in C.leaks(ix, " ".join(x + q))] == ["passage"] and aligned == [x]  # the answer isn't there, so the query alone is none
    monkeypatch.setattr(C, "words_at", None)
    assert C.leaks(ix, " ".join(q + _words(30, 4))) == [] and C.leaks(ix, " ".join(w for k in range(0, 40, 4) for w in x[36 - k : 40 - k])) == []
