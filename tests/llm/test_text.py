"""Text operators without a cluster: small cases, round trips, odd and very long texts."""

import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import contamination as C
from lexmill.llm import encoding as E
from lexmill.llm import furniture as F
from lexmill.llm import markup as M
from lexmill.llm import mixing as X
from lexmill.llm import quality as Q
from lexmill.llm import scans as S

WORDS = "a decisão da câmara não prevê a prorrogação do órgão é nula conforme o art. 5º da lei nº 8 são três licitações e às funções pública técnica econômica exercício índice só à".split()
rng = random.Random(5)
PROSE = [" ".join(rng.choice(WORDS) for _ in range(40)) + "." for _ in range(400)]

# --- markup -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "clean", "notation"),
    [
        ("<p>Um texto.</p><ul><li>a</li><li>b</ul>", "Um texto.\n\n• a\n• b", "html"),
        ("Um texto</span> só.", "Um texto só.", "html"),
        ("A &amp; B &ccedil;&#227;o&nbsp;x", "A & B ção x", "html"),
        ("&lt;p&gt;Escapado.&lt;/p&gt;", "Escapado.", "html"),
        ("<style>p{x:1}</style><h2>Título</h2><table><tr><td>a</td><td>b</td></tr></table>", "Título\n\na\tb", "html"),
        ('Fim cortado <span style="color:', "Fim cortado", "html"),
        ("# Título\n\nTexto **forte** e _leve_.", "Título\n\nTexto forte e leve.", "markdown"),
        ("| a | b |\n|---|---:|\n| 1 | 2 |", "a\tb\n1\t2", "markdown"),
        ("Ver [teor](https://x.y/z).", "Ver teor.", "markdown"),
        ("a\n\n```\nse x > 1:\n    y\n```", "a\n\n    se x > 1:\n        y", "markdown"),
        ("== Título ==\nSegundo [[Lei 1|a norma]].", "Título\nSegundo a norma.", "wiki"),
        ("{{citação|Um texto.}}", "Um texto.", "wiki"),
        ('{| class="w"\n! a !! b\n|-\n| 1 || 2\n|}', "a\tb\n1\t2", "wiki"),
        (r"Ver art.~5, \S\,2º, com 3\% e $BDI = \frac{a}{b} - 1$.", "Ver art. 5, § 2º, com 3% e BDI = (a)/(b) - 1.", "latex"),
        ("\\section*{Título}\n\\begin{itemize}\n\\item um\n\\end{itemize}", "Título\n• um", "latex"),
    ],
)
def test_markup(text, clean, notation):
    got = M.clean(text)
    assert (got.text, got.notation) == (clean, notation) and got.marks > 0
    assert M.clean(got.text) == (got.text, 0, None)


@pytest.mark.parametrize("text", [None, "", "R$ 5,00 e < R$ 3, > 2", "A & B", "lote #7 com 5 * 3", "(*) Republicado", "planilha_final_v2 ____________", "[...] [sic] [1] [x]", "I = (PA - PB) / PB, com PA > PB.", "a | b | c", "• item", "- item", "1. item", "x = 1"])
def test_no_markup(text):
    assert M.clean(text) == (text, 0, None)


def test_tree_scoring_keeps_the_body():
    page = "<div><a href=1>um</a> <a href=2>dois</a> <a href=3>tres</a></div><div><p>" + "Texto corrido, com vírgulas, e mais texto. " * 10 + "</p><h3>Parte</h3><p>" + "Outro texto corrido, também longo. " * 6 + "</p></div>"
    got = M.clean(page).text
    assert "Outro texto" in got and "Parte" in got and "dois" not in got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab <>/p&;#*_`[](){}|='\\$~\n-.1", max_size=60))
def test_markup_never_fails(text):
    M.clean(text)


# --- encodings --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def restorer():
    raw, words = Counter(), Counter()
    E.count_marked(PROSE, raw)
    E.count_words(PROSE, words)
    return E.Restorer(E.folded(raw), dict(words))


def broken(text, was, read, times=1):
    for _ in range(times):
        text = E._read(text.encode(was), read)
    return text


@pytest.mark.parametrize(("was", "read", "times"), [("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 2), ("utf-8", "mac_roman", 1), ("cp1252", "cp1251", 1), ("cp1252", "cp850", 1), ("cp1252", "mac_roman", 1), ("cp1252", "cp1250", 1), ("cp850", "cp1252", 1)])
def test_round_trip(restorer, was, read, times):
    good = total = 0
    for t in PROSE[:60]:
        try:
            b = broken(t, was, read, times)
        except UnicodeEncodeError:
            continue
        got, n, pairs = restorer.restore(b)
        assert n > 0 and pairs
        total += 1
        good += got == t
    assert good >= 0.9 * total > 0


def test_spans_only(restorer):
    t = PROSE[0] + " " + broken(PROSE[1], "utf-8", "cp1252") + " " + PROSE[2]
    assert restorer.restore(t)[0] == " ".join(PROSE[:3])


@pytest.mark.parametrize("text", ["a razão social Năvodari Utilaje", "Łódź Maszyny, € 5.000", "cirílico (Завод) e (¿Ñandú?)", "naïve Zoë Åkerby", "ISO 1, §§ 1º a 3ª, ½", "« Anterior", "retiﬁcou", "", PROSE[0]])
def test_proper_words(restorer, text):
    assert restorer.restore(text)[:2] == (text, 0)


def test_lost(restorer):
    got = restorer.restore("a prorroga��o n�o � nula")
    assert got[1] > 0 and got[0].startswith("a prorrogação não")


# --- scans ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def repairer():
    words, pairs = Counter(), Counter()
    texts = [p.replace("º", "") for p in PROSE] * 8 + ["o edital determinou a comissão de contratação e o exame documentado do contrato com a empresa segundo a jurisprudência"] * 300
    for t in texts:
        k = S._TOKEN.findall(t.lower())
        words.update(k)
        pairs.update(pairwise(k))
    return S.Repairer(S.Lexicon(dict(words), dict(pairs), sum(words.values())))


@pytest.mark.parametrize(
    ("text", "want", "fault"),
    [
        ("a comis-\nsão de contra¬\ntação", "a comissão de contratação", "broken"),
        ("o contra- to da empresa", "o contrato da empresa", "broken"),
        ("o C O N T R A T O da e m p r e s a", "o CONTRATO da empresa", "spaced"),
        ("o contr@to e a ernpresa e o ed1tal", "o contrato e a empresa e o edital", "misread"),
        ("a jurispruclência da contrataqão", "a jurisprudência da contratação", "misread"),
        ("o edital da\nPÁGINA: 45\nGABINETE DO RELATOR\nempresa", "o edital da empresa", "page"),
        ("o edital\nTCU 2013 DIÁRIO OFICIAL  fls. 17\nda empresa", "o edital da empresa", "page"),
    ],
)
def test_scans(repairer, text, want, fault):
    got, faults = repairer.repair(text)
    assert got == want and set(faults) == {fault}


@pytest.mark.parametrize("text", ["", "o edital consta às fls. 12 e 13", "decreto-lei do pré-requisito", "exige 9 m2 e aparelhos A1 às 9h", "planilha_final_v2 x@y.com.br http://a.b/c1d", "RELATÓRIO\n\no edital\n\nVOTO\n\na empresa", "uma linha\nque segue noutra linha", "[sic] [...]", "art.\n5 da lei"])
def test_no_scan_fault(repairer, text):
    assert repairer.repair(text) == (text, {})


# --- furniture --------------------------------------------------------------------------------------------------------


BODY = "RELATÓRIO\n\nO rodapé do edital remete ao fale conosco da ouvidoria. O portal deve ter menu de navegação e aviso de cookies."
PAGE = (
    "Vai ao miolo [1] Vai ao rol [2]\nEstantes | Vitrines | Oficinas | Quintais\n" + BODY + "\nSobe tudo ↑\nEste mural guarda migalhas do leitor para sempre. Quero ler.\n"
    "Outros achados\n• Uma conversa\n• Outra\n© 2020 a.gov.example - Nada reservado"
)


def furniture_tables(*pages):
    keys = [k for p in pages for k, *_ in F.own_elements(p)]
    low = (1 << F.FIRST_BITS) - 1
    return set(keys), F.Tables([(k + 2**63) >> (64 - F.FIRST_BITS) for k in keys], [k & low for k in keys])


def test_furniture():
    keys, tables = furniture_tables(PAGE.replace(BODY, ""))
    assert F.without(PAGE, keys, tables) == BODY
    assert not keys & {e.key for e in F.elements(BODY, tables)} and F.without(BODY, keys, tables) == BODY and F.elements("", tables) == []


def test_furniture_within_a_line():
    keys, tables = furniture_tables("Sobe tudo\nQuero ler")
    t = "O pedido foi negado. Sobe tudo RELATÓRIO do caso"
    assert F.without(t, keys, tables).split() == "O pedido foi negado. RELATÓRIO do caso".split()


def test_furniture_keys_agree_however_found():
    for piece in ("Vai ao miolo [1]", "Início", "Página dos préstimos", "© 2020 a.gov.example - Nada", "Sobe\xa0já agora"):
        keys, tables = furniture_tables(piece)
        assert len(keys) == 1 and keys == {e.key for e in F.elements(f"O pedido foi negado ontem mesmo.\n{piece}\nO resto segue aqui embaixo.", tables)}, piece


def test_furniture_forms_set_apart():
    for piece in ("RELATÓRIO", "PREGÃO ELETRÔNICO.", "| Item | Valor |", "Página 3 de 9", "fls. 12", "## Título", "x = [nota](https://a.b/c)", "uma linha que segue", "12, caput."):
        assert list(F.own_elements(piece)) == [], piece


# --- contamination ----------------------------------------------------------------------------------------------------


def test_automaton_against_brute_force():
    r = random.Random(1)
    texts = [[r.choice("abc") for _ in range(r.randint(0, 30))] for _ in range(12)]
    a = C.SuffixAutomaton(texts)
    subs = {}
    for n, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                subs.setdefault(tuple(t[i:j]), set()).add(n)
    for doc in ([r.choice("abcd") for _ in range(80)] for _ in range(30)):
        got = list(a.matches(doc))
        want, i = [], 0
        longest = []
        for e in range(1, len(doc) + 1):
            n = max((k for k in range(0, e + 1) if k == 0 or tuple(doc[e - k : e]) in subs), default=0)
            longest.append(n)
        for e, n in enumerate(longest):
            nxt = longest[e + 1] if e + 1 < len(longest) else 0
            if n >= C.SEED and nxt != n + 1:
                want.append(n)
        assert [n for _, n in got] == want, i
        for v, n in got:
            assert a.texts[v]
    for s, owners in subs.items():
        if len(s) >= C.SEED:
            v = 0
            for w in s:
                v = a.next[v][a.ids[w]]
            assert set(a.texts[v]) == owners


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_align_is_bounded_by_lcs():
    r = random.Random(2)
    for _ in range(200):
        p = [r.choice("abcdef") for _ in range(25)]
        d = p[: r.randint(0, 25)] + [r.choice("abcdef") for _ in range(r.randint(0, 20))]
        share, *_ = C.align(p, d, C.runs_at(d))
        assert share <= lcs(p, d) / len(p) + 1e-9


def test_leaks():
    passage = "O vigia noturno e a bibliotecária disseram que Nofico enterrou atrás do galpão a lona do ginásio e sobrou uma única caixa lacrada na portaria"
    ix = C.Index([(1, passage, "Quem viu a veterinária devolver as urnas de lona?", "Foi Fites, que cortou ao meio o mastro da praça."), (2, None, None, None), (3, "", "", "")])
    found = lambda t: sorted((x.item_id, x.part) for x in C.leaks(ix, t))
    w = passage.split()
    assert found("Antes. " + passage.upper() + " Depois.") == [(1, "passage")]
    assert found("x " + " ".join(w[:16]) + " y") == [(1, "passage")]
    assert found("x " + " ".join(w[:8]) + " y") == []
    changed = [x if i % 7 else "outra" for i, x in enumerate(w)]
    assert found(" ".join(changed)) == [(1, "passage")]
    assert found(" ".join(w[:12]) + " texto de permeio " * 30 + " ".join(w[12:])) == [(1, "passage")]
    assert found(" ".join(reversed(w))) == []
    assert found("quem viu a veterinaria devolver as urnas de lona") == []
    assert found("quem viu a veterinaria devolver as urnas de lona? muito bem. foi fites que cortou ao meio o mastro da praca") == [(1, "answer"), (1, "query")]
    t = "Antes. " + passage + ". Depois."
    assert C.without(t, [c for x in C.leaks(ix, t) for c in x.cuts]) == "Antes. . Depois." and found("") == []


# --- mixing -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("mean", "cap"), [(0.0, 1), (0.3, 1), (1.0, 1), (0.5, 4), (3.2, 4), (4.0, 4), (2.5, 50), (1e-6, 3)])
def test_poisson(mean, cap):
    at = X.thresholds(mean, cap)
    n = 200_000
    us = [(i + 0.5) / n for i in range(n)]
    draws = [sum(t <= u for t in at) for u in us]
    assert max(draws) <= cap and abs(sum(draws) / n - mean) < 1e-3


def test_plan():
    p = X.plan({"a": 100, "b": 50, "d": 7}, [("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.25, 3), ("e", None, 1)])
    assert set(p) == {"a", "b"} and abs(p["a"]["mean"] * 100 / (p["b"]["mean"] * 50) - 2) < 1e-9
    assert max(p["a"]["mean"] / 1, p["b"]["mean"] / 2) == pytest.approx(1) and X.plan({}, []) == {}


# --- quality ----------------------------------------------------------------------------------------------------------


def test_held_out_accuracy():
    r = random.Random(4)
    common = frozenset("a o de da do que e em um para com não os as no na por ao conforme são é às à".split())
    name = lambda: r.choice(["Lima", "Pedra", "Costa"]) + r.choice([" Obras ME", " Serviços S.A.", " Alimentos EPP"])
    money = lambda: f"R$ {r.randint(1, 999)}.{r.randint(100, 999)},{r.randint(10, 99)}"
    make = {
        "prose": lambda: f"No processo nº {r.randint(1, 9999)}/2015, a câmara {r.choice(['negou', 'acolheu', 'reviu'])} o pedido da empresa {name()}, no valor de {money()}, conforme o voto do relator e a lei que rege os contratos.",
        "list": lambda: r.choice([f"{r.randint(1, 99)}. A {r.choice(['medição', 'garantia', 'comissão'])} da obra;", f"O prazo de entrega {'.' * r.randint(8, 40)} {r.randint(1, 900)}", f"Lei Municipal nº {r.randint(10, 99)}.{r.randint(100, 999)}/2010, art. {r.randint(1, 90)}"]),
        "table": lambda: r.choice([";", " | ", "\t", "   "]).join([str(r.randint(1, 999)), f"{r.randint(10, 28)}/0{r.randint(1, 9)}/2019", name(), money()]),
        "junk": lambda: r.choice(["".join(r.choice("{}[]()/\\|_^~@#$%*") for _ in range(60)), "".join(r.choice("abcXYZ0189+/") for _ in range(76)), " ".join(str(r.randint(1, 999)) for _ in range(40))]),
    }
    texts = [(k, make[k]()) for k in make for _ in range(300)]
    letters = Q.Letters(Counter(g for _, t in texts for w in re.findall(r"[^\W\d_]+", t.lower()) for g in Q.trigrams(w)))
    cells = [(k, Q.cell(Q.statistics(t, common, letters))) for k, t in texts]
    counts = Counter(c for _, c in cells)
    codes, weights = np.array(list(counts)), np.array(list(counts.values()), dtype=float)
    model = Q.fit(lambda f: f(codes, weights), [np.array([Q.cell(Q.statistics(b, common, letters)) for b in held]) for _, held in Q.EXAMPLES])
    p = dict(zip(codes.tolist(), model.kinds(codes).tolist(), strict=True))
    named = [(k, Q.KINDS[p[c]]) for k, c in cells]
    prose = sum((k == "prose") == (g == "prose") for k, g in named) / len(named)
    assert prose >= 0.97 and sum(k == g for k, g in named) / len(named) >= 0.85


def test_blocks():
    t = "Uma linha longa de texto que segue\nna linha de baixo e termina.\n\n1. item;\n2. item;\n\n\n"
    assert list(Q.blocks(t)) == ["Uma linha longa de texto que segue na linha de baixo e termina.", "1. item;", "2. item;"]
    assert list(Q.blocks("")) == [] and Q.GRID < 2**31


# --- very long and odd texts ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["a" * 200_000, "palavra " * 60_000, "çã" * 60_000, "<*_`{[$&" * 12_000, "a-\n" * 50_000, "Ã§Ã£o " * 20_000, "a b c d " * 30_000, "<div>x " * 8_000, "**a " * 30_000, "{{a|" * 30_000, "�" * 50_000, "\x00\ud7ff" * 100, "“" * 50_000], ids=range(13))
def test_long(text, restorer, repairer):
    restorer.restore(text)
    repairer.repair(text)
    M.clean(text)
    furniture_tables(text)
    F.elements(text, furniture_tables("Sobe tudo\na\nO pedido")[1])
    [Q.cell(Q.statistics(b, frozenset(), Q.Letters({}))) for b in Q.blocks(text)]
    C.leaks(C.Index([(1, "um dois tres quatro cinco", "q", "a")]), text)
