"""Kinds of text that look like prose to counts of words and signs."""

import random

import numpy as np

from lexmill.llm import quality

SUBJECTS = ["o carteiro", "a professora", "o padeiro", "a vizinha", "o barqueiro", "a orquestra", "o jardineiro", "a costureira", "o relojoeiro", "a enfermeira"]
VERBS = ["encontrou", "consertou", "esqueceu", "pintou", "vendeu", "guardou", "mostrou", "procurou", "descreveu", "emprestou"]
THINGS = ["a bicicleta azul", "o telhado da escola", "a carta do irmão", "os quadros antigos", "a mesa de jantar", "o relógio da praça", "as flores do canteiro", "a rede de pesca", "o piano de cauda", "as sementes de trigo"]
ENDS = ["antes da chuva", "depois da festa", "com muita paciência", "sem dizer nada a ninguém", "na semana passada", "durante o inverno", "perto do mercado", "por causa do frio"]


def prose(rnd, n=12):
    return " ".join(f"{rnd.choice(SUBJECTS)} {rnd.choice(VERBS)} {rnd.choice(THINGS)} {rnd.choice(ENDS)}.".capitalize() for _ in range(n))


def items(rnd, n=20):
    return [rnd.choice(THINGS) for _ in range(n)]


def shuffled(rnd, text):
    out = []
    for w in text.split():
        w = list(w)
        rnd.shuffle(w)
        out.append("".join(w))
    return " ".join(out)


def texts(rnd):
    kinds = {
        "prose": lambda: prose(rnd),
        "bullets in a line": lambda: " • ".join(x.capitalize() for x in items(rnd)),
        "semicolons in a line": lambda: "Veja também: " + "; ".join(items(rnd)) + ".",
        "letters shuffled": lambda: shuffled(rnd, prose(rnd)),
        "table": lambda: "\n".join(f"{rnd.randint(1, 999)} | {x} | R$ {rnd.randint(1, 999)},00" for x in items(rnd)),
    }
    return [(kind, make()) for kind, make in kinds.items() for _ in range(400 if kind == "prose" else 20)]


def test_families_held_out(spark):
    rows = texts(random.Random(7))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    words = spark.createDataFrame([("pt", w) for w in "a o os as de da do que e com na no por sem antes depois".split()], "lang string, word string")
    got = {r["doc_id"]: r for r in quality.quality(df, words).collect()}
    right = {}
    for i, (kind, _) in enumerate(rows):
        right.setdefault(kind, []).append((got[i]["prose_share"] > 0.5) == (kind == "prose"))
    assert {k for k, v in right.items() if sum(v) < 0.95 * len(v)} == set()


def test_fit_over_parts_is_fit_over_all():
    rnd = np.random.default_rng(3)
    codes = rnd.integers(0, quality.GRID, 500)
    weights = rnd.integers(1, 50, 500).astype(float)
    examples = [rnd.integers(0, quality.GRID, 4) for _ in quality.EXAMPLES]
    whole = quality.fit(lambda f: f(codes, weights), examples)
    parts = quality.fit(lambda f: f(codes[:180], weights[:180]) + f(codes[180:], weights[180:]), examples)
    assert np.allclose(whole.mu, parts.mu) and np.allclose(whole.var, parts.var) and (whole.kinds(codes) == parts.kinds(codes)).all()
    assert quality.fit(lambda f: f(codes, np.zeros(500)), examples) is None


def test_likelihood_never_falls():
    rnd = np.random.default_rng(5)
    codes, weights = rnd.integers(0, quality.GRID, 300), np.ones(300)
    seen = []

    def summed(f):
        out = f(codes, weights)
        if f is not quality.moments:
            seen.append(out[0])
        return out

    quality.fit(summed, [rnd.integers(0, quality.GRID, 4) for _ in quality.EXAMPLES])
    assert 1 < len(seen) < quality.ROUNDS
    assert all(b > a - 0.5 for a, b in zip(seen, seen[1:]))


def test_letters():
    seen = quality.Letters({"^ca": 5, "cas": 5, "asa": 5, "sa^": 5})
    assert quality.trigrams("ação") == ["^ac", "aca", "cao", "ao^"] and quality.trigrams("дом") == []
    assert seen.of("casa") > seen.of("csaa") and seen.of("sol") is None and seen.of("домой") is None
