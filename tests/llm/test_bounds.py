"""What lies beyond lengths and rounds that once were bounds."""

from lexmill.llm import encoding as E
from lexmill.llm import furniture as U
from lexmill.llm import markup as M
from lexmill.llm import scans as S
from lexmill.llm import splitter


def test_words_with_many_lost_characters():
    words = {"constituiçãoéúí": 50, "licitação": 90}
    r = E.Restorer({"açã": 10, "ção": 10, "ião": 3}, words)
    assert r._lost("na constitui�����"[:-1] + " e na licita��o").endswith("licitação")
    assert r._lost("constitui��o���") == "constituiçãoéúí"


def test_long_emphasis_and_formulas():
    long = "palavra " * 60 + "fim"
    assert M.clean(f"*{long}*").text == long and M.clean(f"_{long}_").text == long
    assert M.clean(f"vale $x{'+y' * 400}$ aqui").text == f"vale x{'+y' * 400} aqui"


def test_notations_nested_deeply():
    text = "valor"
    for _ in range(9):
        text = r"\textbf{" + text + "}"
    assert M.clean(text).text == "valor"
    assert M.clean("&amp;amp;amp;amp;amp;lt;p&amp;amp;amp;amp;amp;gt;oi").text == "oi"
    assert M.clean(r"\frac{\frac{\frac{\frac{\frac{\frac{a}{b}}{c}}{d}}{e}}{f}}{g}").notation == "latex" and "\\" not in M.clean(r"\frac{\frac{\frac{\frac{\frac{\frac{a}{b}}{c}}{d}}{e}}{f}}{g}").text


def test_signs_that_cleaning_leaves_are_no_case():
    for text in ("x < y e z > w", "nota (*) ao pé", "R$ 5 e R$ 7"):
        assert M.clean(text) == M.Cleaned(text, 0, None)


def test_misread_long_words_with_many_confusions():
    word = "inconstitucionalissimamente"
    lex = S.Lexicon({word: 5_000, "recurso": 9_000}, {}, 1_000_000)
    read = "inc0nst1tuci0na1issimarnente"
    assert lex.candidates(read)[0][0] == word
    assert lex.candidates("rccurso")[0][0] == "recurso" and lex.candidates("recnrso")[0][0] == "recurso"


def test_channel_against_all_variants():
    def variants(low):
        out, front = {low: 0.0}, {(0, low): 0.0}
        while front:
            new = {}
            for (at, w), p in front.items():
                for i in range(at, len(w)):
                    for size in (2, 1):
                        for was, q in S.CONFUSIONS.get(w[i : i + size], ()) if i + size <= len(w) else ():
                            v, k = w[:i] + was + w[i + size :], (i + len(was), w[:i] + was + w[i + size :])
                            if new.get(k, -1e9) < p + q:
                                new[k] = p + q
                            out[v] = max(out.get(v, -1e9), p + q)
            front = new
        return out

    for low in ("rnal", "c1e", "iiem", "fl"):
        lex = S.Lexicon({}, {}, 1)
        for w, p in variants(low).items():
            assert S._outline(w) == S._outline(low) and abs(lex._channel(low, w) - p) < 1e-9


def test_words_joined_until_none_is_broken():
    r = S.Repairer(S.Lexicon({"administrativamente": 500}, {}, 10_000))
    assert r._text("ad-\nmi-\nnis-\ntra-\nti-\nva-\nmen-\nte")[0] == "administrativamente"


def test_pieces_of_a_long_text(spark):
    text = "".join(f"Frase número {i} do texto, com vírgula. " for i in range(6_000))
    df = spark.createDataFrame([("t", "1", "k", text)], "table_name string, row_key string, kind string, text string")
    limits = spark.createDataFrame([("t", "k", 300, 90)], "table_name string, kind string, max_chars int, overlap_chars int")
    got = splitter.split_oversized(df, limits).orderBy("piece_no").collect()
    assert "".join(r["piece_text"][r["overlap"] :] for r in got) == text and all(len(r["piece_text"]) <= 300 for r in got)
    assert all(r["piece_text"] == text[r["start_char"] : r["start_char"] + len(r["piece_text"])] for r in got)
    assert all(r["overlap"] == 90 for r in got[1:])


def test_furniture_of_many_words(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i)).capitalize()
    piece = lambda a, n: f"Mural {name(a)} " + " ".join(f"palavra{name(i).lower()}" for i in range(n - 2))
    pieces = [piece(100 + n, n) for n in (20, 21, 64, 700)]
    body = "O pedido de {0} foi negado ontem mesmo pela turma.\n"
    rows = [(i, f"https://a.gov.example/{i}", body.format(i) + "\n".join(pieces) + f"\nO resto {name(i)} segue aqui embaixo.") for i in range(3)]
    rows += [(9, "https://a.gov.example/9", body.format(9) + " ".join(pieces) + " RELATÓRIO")]  # all within one line
    df = spark.createDataFrame(rows, "record_id long, url string, ementa string")
    got = {r["record_id"]: r for r in U.main_text(df, "record_id", ["ementa"], "url").collect()}
    assert sorted(got) == [0, 1, 2, 9] and all(r["n_elements"] == len(pieces) for r in got.values())
    assert all("palavra" not in r["main_text"] and "O pedido" in r["main_text"] for r in got.values())


def test_furniture_words_that_begin_sentences():
    text = "Mural de recados da casa segue aberto, por ora, ao leitor."
    key = next(U.own_elements("Mural de recados da casa"))[0]
    tables = U.Tables([(key + 2**63) >> (64 - U.FIRST_BITS)], [key & ((1 << U.FIRST_BITS) - 1)])
    assert [e.kind for e in U.elements(text, tables)] == ["start"]


def test_furniture_stretches_of_a_long_line():
    forms = U._form("Sobe tudo, 12 vezes em a.gov.example, já " * 30 + "fim").split(" ")
    sums = U._sums(forms)
    assert all(U._stretch(forms, sums, i, j) == U._key(" ".join(forms[i:j])) for i in range(0, 200, 7) for j in range(i + 1, 200, 5))
    # templates of thousands of words that begin like every other word of a long line
    pieces = ["Sobe tudo", "Sobe tudo " + "x " * 4_997 + "y", "Sobe tudo " + "x " * 20_997 + "y"]
    keys, lengths = [next(U.own_elements(p))[0] for p in pieces], [p.count(" ") + 1 for p in pieces]
    firsts = [(k + 2**63) >> (64 - U.FIRST_BITS) for k in keys]
    tables = U.Tables(firsts, [k & ((1 << U.FIRST_BITS) - 1) for k in keys], [U._pair(f, n) for f, n in zip(firsts, lengths, strict=True)], lengths)
    assert [e.key for e in U.elements("Sobe tudo " * 20_000 + "x", tables)] == [keys[0]] * 19_999
    assert {e.key for e in U.elements(" ".join(pieces), tables)} == set(keys)
