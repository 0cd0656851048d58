"""Runs of shared words: what is cut out, and chains against brute force."""

import random
import time

from lexmill.llm import contamination as C


def _words(r, n, tag):
    return [f"{tag}{r.randrange(10**6)}" for _ in range(n)]


def brute_chain(part, doc):
    """Longest common subsequence of runs, the plain table."""
    a, b = (list(zip(*(x[k:] for k in range(C.RUN)), strict=False)) for x in (part, doc))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_chain_is_the_longest_and_rises():
    r = random.Random(11)
    for _ in range(150):
        part, doc = ([r.choice("abc") for _ in range(r.randint(0, 40))] for _ in range(2))
        got = C.chain(part, C.runs_at(doc))
        assert len(got) == brute_chain(part, doc)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))
        assert all(part[k : k + C.RUN] == doc[j : j + C.RUN] for k, j in got)


def test_a_phrase_repeated_throughout_costs_no_product():
    part, doc = "nos termos da lei".split() * 60, "nos termos da lei".split() * 20_000
    start = time.perf_counter()
    assert C.align(part, doc, C.runs_at(doc)).share == 1.0
    assert time.perf_counter() - start < 20


def test_clean_text_between_the_halves_stays():
    r = random.Random(2)
    passage, clean = _words(r, 30, "p"), " ".join(_words(r, 40, "c"))
    text = " ".join(passage[:15]) + " " + clean + " " + " ".join(passage[15:])
    ix = C.Index([(1, " ".join(passage), "", "")])
    (leak,) = C.leaks(ix, text)
    assert leak.share == 1.0 and len(leak.cuts) == 2
    assert C.without(text, leak.cuts).strip() == clean


def test_changed_words_within_a_run_are_cut_with_it():
    r = random.Random(3)
    passage = _words(r, 24, "p")
    changed = [*passage[:10], "outra", *passage[11:]]
    text = "Antes. " + " ".join(changed) + " Depois."
    (leak,) = C.leaks(C.Index([(1, " ".join(passage), "", "")]), text)
    assert C.without(text, leak.cuts) == "Antes.  Depois."


def test_nested_items_are_both_found():
    r = random.Random(4)
    passage = _words(r, 30, "p")
    ix = C.Index([(1, " ".join(passage), "", ""), (2, " ".join(passage[:15]), "", ""), (3, " ".join(passage), "", "")])
    assert {x.item_id for x in C.leaks(ix, " ".join([*_words(r, 9, "a"), *passage, *_words(r, 9, "b")]))} == {1, 2, 3}
