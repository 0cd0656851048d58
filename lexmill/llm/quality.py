"""Per-document text statistics that set running prose apart from lists, tables and junk.

A text is read in blocks (lines; lines of one wrapped paragraph together). Each block has eleven statistics: share of
common words, of digits and of symbols, mean word length, number of words, how it ends, variety of its words,
punctuation per word, marks of columns per word, separators of items per word, and how plausible the sequences of
letters in its words are. The last is measured with the corpus's own counts of three letters in a row, taken in a first
pass over all texts (at most ``LETTERS`` cubed counts), against the mean of all words, so that it means the same at any size.

The statistics are rounded to a grid of fixed edges, so the blocks of a corpus of any size come down to counts of cells. On
these, standardised, a Gaussian mixture is fitted by expectation-maximization: each round the tasks that hold the cells
sum the sufficient statistics of their own, and the driver sees one row of ``components x (2 x statistics + 1)`` numbers of
each of at most ``TASKS`` tasks, never the cells. Rounds end when the likelihood of a block gains less than ``GAIN``. The components start
from inspected examples of each kind of block, which stay in the fit with a weight of their own, and each component is called
prose, list, table or junk after the examples it came from. A document's shares of the four are by characters of its blocks.

Defined results: null and blank texts have no words, no blocks and shares of 0; very long texts are read whole; an empty
table gives an empty result; without common words every share of common words is 0; words with letters of other scripts than
the Latin one have no say on plausibility.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from math import log2, prod, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut

_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[a-zß-öø-ÿ]+")
_DIGITS = b"0123456789"
_SPACE = b" \t\r\n\xa0"
_LETTERS = bytes(c for c in range(256) if bytes([c]).decode("latin-1").isalpha())
_STOPS = b".,;:"
_COLUMN = re.compile(r"[\t|]| {3,}(?=\S)|;(?=\S)|,(?:(?<!\d,)(?=\S)|(?=[A-Za-zÀ-ÿ])|(?<=\d,)(?=\d+[/,]))|\.{5,}")
_SEPARATORS = ["; ", *(f" {c} " for c in "•·▪‣●◦■○►*|/\\–—-")]
_ITEM_START = re.compile(r"^\s*(?:[a-z]\)|[-•*–]|\d{1,3}[.)]\s)")
#: a to z and the edge of a word: what letters are counted as.
LETTERS = 27
#: Words under so many letters have no say on plausibility.
LEAST_WORD = 4
#: Upper edges of the grid, by statistic; a value takes the first edge it doesn't exceed.
EDGES = [
    (0.02, 0.08, 0.14, 0.2, 0.26, 0.34, 0.5, 1.0),  # common words
    (0.01, 0.06, 0.15, 0.3, 0.5, 1.0),  # digits
    (0.02, 0.06, 0.1, 0.18, 0.35, 1.0),  # symbols
    (1.5, 2.8, 3.8, 4.8, 5.8, 7.0, 9.0, 1e9),  # mean word length
    (0.5, 1.6, 2.6, 3.4, 4.2, 5.2, 7.0, 1e9),  # log2 of words + 1
    (0.0, 0.5, 1.0),  # ending: none, item, sentence
    (1.2, 2.2, 3.6, 1e9),  # distinct words to the root of words
    (0.02, 0.08, 0.2, 1e9),  # punctuation per word
    (0.0, 0.15, 0.4, 1e9),  # marks of columns per word
    (0.03, 0.09, 0.16, 1e9),  # separators per word
    (-5.0, -3.5, -2.5, 1e9),  # plausibility of letters, in bits below the mean of all words
]
CENTRES = [
    (0.0, 0.05, 0.11, 0.17, 0.23, 0.3, 0.4, 0.6),
    (0.0, 0.03, 0.1, 0.22, 0.4, 0.65),
    (0.0, 0.04, 0.08, 0.14, 0.25, 0.6),
    (0.5, 2.2, 3.4, 4.4, 5.3, 6.3, 7.8, 12.0),
    (0.0, 1.2, 2.1, 3.0, 3.8, 4.7, 6.0, 8.0),
    (0.0, 0.5, 1.0),
    (0.7, 1.8, 3.0, 4.5),
    (0.0, 0.05, 0.13, 0.3),
    (0.0, 0.1, 0.25, 0.6),
    (0.0, 0.06, 0.12, 0.25),
    (-6.5, -4.2, -3.0, 0.0),
]
GRID = prod(map(len, EDGES))
KINDS = ("prose", "list", "table", "junk")
#: Weight of an example sort beside the corpus; gain in likelihood of a block at which the fit ends; rounds that no fit is known to need; tasks that hold the cells.
EXAMPLE_WEIGHT, GAIN, ROUNDS, TASKS = 0.06, 1e-3, 200, 64
LEAST_VARIANCE, FIRST_VARIANCE = 0.08, 0.35

#: Inspected examples: kind, blocks of one sort. Each sort starts one component.
EXAMPLES: list[tuple[str, list[str]]] = [
    ("prose", ["A cooperativa que cuida do rio informou que a pesca foi aberta sem ressalvas, na forma do art. 12, e que a venda seguiria em trinta dias. Em seguida, o barqueiro pediu a troca da rede.",
               "According to the report, the village approved the new timetable after a short debate, and the clerk was asked to print the notice in the local paper before the end of the month.",
               "El museo resolvió que la familia no había entregado los cuadros y que, por lo tanto, no correspondía modificar el catálogo de la muestra en los términos que se habían pedido.",
               "Quando a balsa voltou a cruzar o rio, os moradores da outra margem já esperavam desde cedo, com os cestos de uva e as caixas de peixe empilhados junto ao cais. O barqueiro, que conhecia todos pelo nome, pediu calma e disse que haveria lugar para quem tivesse chegado antes do sino. A professora levou as crianças para a sombra do armazém e contou a história da ponte que nunca foi construída. "
               "Ao fim da tarde, depois de quatro viagens, restavam no cais apenas dois homens e um cachorro, e ninguém soube dizer quem era o dono. No dia seguinte a prefeita mandou consertar o motor, mas a peça só chegou em março, e até lá o caminho foi feito a remo, como no tempo dos avós."]),
    ("prose", ["No caso nº 1234/2015, a escola pediu a troca do telhado por R$ 5.300,00, com base na lei.", "A família decidiu guardar a carta e vender a casa.", "O barco nº 55/2012, comprado em 3 de maio de 2013 com o irmão, custou com a vela R$ 1.200,50."]),
    ("prose", ["In case 5512/2019, the railway board approved the repair of the bridge during the winter.", "Según Juan Pérez, el museo publicó la lista de los cuadros en 90 días.", "En la carta 1677/2013, la familia omitió la venta del jardín sin motivo alguno.", "Segundo Maria Souza, a vizinha examinou a cor do telhado antes da festa."]),
    ("prose", ["o vizinho disse que a horta da escola ficou parada por dois meses e que a chuva levou a cerca do terreno antes que chegasse o adubo pedido na semana da festa"]),
    ("list", ["1. A colheita da uva;", "2. O conserto do telhado;", "12. A escola de música;", "- O barco de pesca;", "• A horta da praça"]),
    ("list", ["O barco de pesca ........ 31", "A escola de música ..................... 245", "Os quadros do museu .......... 7"]),
    ("list", ["Lei Municipal nº 71.200/2010, art. 15, § 2º", "Resolução nº 82.113/2009, art. 7, inciso IV", "Portaria nº 90.001/2001, art. 3"]),
    ("list", ["Irmãos Quintela EPP.", "Vidraçaria Aurora S.A.", "Moinho Velho Ltda.", "Padaria Central ME"]),
    ("list", ["PONTE FERROVIÁRIA", "HORTA COMUNITÁRIA", "ESCOLA NOTURNA"]),
    ("list", ["A colheita da uva • O conserto do telhado • A escola de música • O barco de pesca • A horta da praça • Os quadros do museu • A ponte da ferrovia • O moinho de vento • A festa da padroeira",
              "o moinho de vento; a festa da padroeira; os quadros do museu; a colheita da uva; o conserto do telhado; a horta da praça; a ponte da ferrovia; o barco de pesca.",
              "Ver também: a colheita da uva; o barco de pesca; a escola de música; os quadros do museu; a ponte da ferrovia; o conserto do telhado."]),
    ("table", ["nota   cor   cesto   peso", "nota;cor;cesto;peso;dia", "nota | cor | cesto | peso"]),
    ("table", ["531   24/03/2012   R$ 4.100,20", "77;25/08/2016;681;75276/2020;R$ 8.511,30", "410,21/01/2012,R$ 6.700,00", "14 | R$ 1.200,00 | R$ 18.404,09"]),
    ("table", ["772;Vidraçaria Aurora ME;28460/2025;31130/2020;R$ 12.264,93", "910 | Irmãos Quintela S.A. | 28/06/2025 | 21/06/2018 | R$ 4.449,01", "44,Moinho Velho EPP,R$ 79.312,42,R$ 113.661,66"]),
    ("table", ["725   o moinho de vento   R$ 6.503,39", "304;o barco de pesca;R$ 45.120,00;123/2010", "650,17227/2024,a horta da praça,24824/2010,R$ 529,96"]),
    ("junk", ["$^}/ :[_!? (#;) ~{ }@ |%", "*;\\$*-_@\\.^|!! ,({~|: )^-]-.%;_!~^-%}", "_!;[*#*/\\#~?."]),
    ("junk", ["zNiqvP6CU0pOKHZQeP2u9xISn7mxlo0PNdsCZizxJtVUCSC0jNaW8pcOyKNXMG5ftIEDjeDDpgL", "0mw8LJc1XpHAAuueWfB2KRYfIcYq+tHP6WsAEhIM6wKy5V/tWHY3UzLA7Q8kdhi+FyFh7MzKbejJ"]),
    ("junk", ["231 fy 298 850 df 980 96 ab 519 cf 374 798 be 414 322 bc 632 470 676 45 916 cd ya 787 909 824", "333 471 481 821 by 326 528 33 ax 684 422 824 759 22 141 374 128 75 898 cy 37 933 684 397"]),
    ("junk", ["var _xY1 = function(a,b){return a.Zz3k[b]||232;};", "if(x[3]==0){f(_a9,1);} else {g();}"]),
    ("junk", ["museu início ponte nova agenda peixes barcos colheita porto jardins biblioteca cestos mapas receitas registro de uvas moinhos telhado composição festas casa cautelosa música lista geral barcos agenda"]),
    ("junk", ["a horta da praça a horta da praça a horta da praça a horta da praça a horta da praça a horta da praça a horta da praça a horta da praça a horta da praça"]),
    ("junk", ["zohnivi edsis uqe a rohta ad asecol uofci adapar rpo iods msese e euq a vuahc voeul a ecrac od tneorer teans", "A aiocvoeptaer euq udica od ori rofminou ueq a cpsea ofi abetra mse ravelsssa, an frmao od tra. 12, e eqU a edvan ugseriia me tartni idsa.",
              "eht egalliv devorppa eht wen elbatemit retfa a trohs etabed dna eht krelc saw deksa ot tnirp"]),
]


def blocks(text: str) -> Iterator[str]:
    """Lines that aren't blank; the lines of a wrapped paragraph as one."""
    for part in re.split(r"\n[ \t]*\n+", text):
        lines = [x for x in part.split("\n") if x and not x.isspace()]
        i = 0
        while i < len(lines):
            j = i + 1
            # a line goes on when it is long, ends no sentence, and what follows begins like the middle of one
            while j < len(lines) and len(lines[j - 1]) >= 25 and lines[j - 1].rstrip()[-1] not in ".!?;:" and _goes_on(lines, j):
                j += 1
            yield lines[i] if j == i + 1 else " ".join(lines[i:j])
            i = j


def _goes_on(lines: list[str], j: int) -> bool:
    head = lines[j].lstrip()
    if _ITEM_START.match(head):
        return False
    if head[0].islower():
        return True
    # a capital or number in the middle of a sentence: only between words
    before = lines[j - 1].rstrip()
    return bool(re.search(r"(?:\b[a-zà-ú]{1,4}|[a-zà-ú],|nº|R\$|§|art\.)$", before)) and before.count(" ") >= 4 and not re.search(r"\s{3}|\t|[;|]|\.{4}|\d$", before) and len(before) >= 55 and not re.match(r"\d+[\s;,|\t]{1,3}\S*\d", head)


class Letters:
    """How plausible words are by the corpus's counts of three letters in a row; 0 is the mean of all words."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) or 1
        self.bits = {g: log2((n + 0.5) / total) for g, n in counts.items()}
        self.unseen = log2(0.5 / total)
        self.mean = sum(n * log2(n / total) for n in counts.values() if n) / total
        self.memo: dict[str, float | None] = {}

    def of(self, word: str) -> float | None:
        """Mean bits of a lower-case word above the corpus's mean; None: too short or of another script."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 300_000:
            self.memo.clear()
        got = None
        if len(word) >= LEAST_WORD and (grams := trigrams(word)):
            got = sum(self.bits.get(g, self.unseen) for g in grams) / len(grams) - self.mean
        self.memo[word] = got
        return got


def trigrams(word: str) -> list[str]:
    """Three letters in a row of a lower-case word with its edges, without accents; none where a letter isn't Latin."""
    if not _LATIN.fullmatch(word):
        return []
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word).encode("ascii", "ignore").decode()
    s = f"^{word}^"
    return [s[i : i + 3] for i in range(len(word))]


def statistics(block: str, common: frozenset[str], letters: Letters) -> tuple[float, ...]:
    """The statistics of a block."""
    words = _WORD.findall(block.lower())
    n = len(words)
    raw = block.encode("latin-1", "replace")
    solid = len(raw.translate(None, _SPACE)) or 1
    digits = len(raw) - len(raw.translate(None, _DIGITS))
    symbols = solid - digits - (len(raw) - len(raw.translate(None, _LETTERS)))
    last = block.rstrip()[-1:]
    end = 1.0 if last in ".!?:" and n >= 5 else 0.5 if last in ";.!?:" and last else 0.0
    stops = len(raw) - len(raw.translate(None, _STOPS))
    bits = [x for w in words if len(w) >= LEAST_WORD and (x := letters.of(w)) is not None]
    return (
        sum(map(common.__contains__, words)) / n if n else 0.0,
        digits / solid,
        max(symbols, 0) / solid,
        sum(map(len, words)) / n if n else 0.0,
        log2(n + 1),
        end,
        len(set(words)) / sqrt(n) if n > 12 else 3.0,
        stops / n if n else 1.0,
        len(_COLUMN.findall(block.strip())) / max(n, 1),
        sum(map(block.count, _SEPARATORS)) / max(n, 1),
        sum(bits) / (len(bits) + 1),
    )


def cell(stats: tuple[float, ...]) -> int:
    """The grid cell of a block's statistics."""
    out = 0
    for x, edges in zip(stats, EDGES, strict=True):
        out = out * len(edges) + min(bisect_left(edges, x), len(edges) - 1)
    return out


class Mixture(NamedTuple):
    """The mixture: how points are standardised, and mean, variance and share of each component."""

    mean: np.ndarray
    std: np.ndarray
    mu: np.ndarray
    var: np.ndarray
    share: np.ndarray

    def logs(self, z: np.ndarray) -> np.ndarray:
        """Log of share times density of standardised points, up to a constant, by component."""
        # the square written out: one matrix product instead of points x components x statistics
        inverse = 1 / self.var
        square = (z**2) @ inverse.T - 2 * z @ (self.mu * inverse).T + (self.mu**2 * inverse).sum(1)
        return np.log(self.share) - 0.5 * (np.log(self.var).sum(1) + square)

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        """The most probable of KINDS for each cell, as its number."""
        logs = self.logs((_points(codes) - self.mean) / self.std)
        r = np.exp(logs - logs.max(1, keepdims=True))
        p = np.stack([r[:, [kind == k for kind, _ in EXAMPLES]].sum(1) for k in KINDS], axis=1)
        return p.argmax(1)


def _points(codes: np.ndarray) -> np.ndarray:
    """The points that cells stand for."""
    codes, out = np.asarray(codes, dtype=np.int64), []
    for c in reversed(CENTRES):
        codes, k = np.divmod(codes, len(c))
        out.append(np.array(c)[k])
    return np.stack(out[::-1], axis=1)


def moments(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of cells with weights: sum of weights, of points and of their squares."""
    x = _points(codes)
    return np.concatenate([[weights.sum()], weights @ x, weights @ x**2])


def expectation(m: Mixture, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sufficient statistics of cells with weights: log-likelihood; by component sum of weights, of points and of their squares."""
    z = (_points(codes) - m.mean) / m.std
    logs = m.logs(z)
    top = logs.max(1, keepdims=True)
    r = np.exp(logs - top)
    whole = r.sum(1, keepdims=True)
    rw = r / whole * weights[:, None]
    return np.concatenate([[weights @ (np.log(whole) + top)[:, 0]], rw.sum(0), (rw.T @ z).ravel(), (rw.T @ z**2).ravel()])


def fit(summed: Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray], examples: list[np.ndarray]) -> Mixture | None:
    """The mixture fitted to all cells; None where there are none.

    ``summed`` adds up a function of cells and counts over all cells, wherever they lie; ``examples`` are the cells of each
    component's examples.
    """
    d, k = len(EDGES), len(EXAMPLES)
    total = summed(moments)
    n = total[0]
    if not n:
        return None
    held = [_points(e) for e in examples]
    # every sort of examples weighs the same, whatever the number of its blocks
    sums = total / n + sum(EXAMPLE_WEIGHT * np.concatenate([[1.0], h.mean(0), (h**2).mean(0)]) for h in held)
    mean = sums[1 : 1 + d] / sums[0]
    std = np.sqrt(np.maximum(sums[1 + d :] / sums[0] - mean**2, 0)) + 1e-6
    z = [(h - mean) / std for h in held]
    own = np.stack([x.mean(0) for x in z])
    own_square = np.stack([(x**2).mean(0) for x in z])
    m, before = Mixture(mean, std, own, np.full((k, d), FIRST_VARIANCE), np.full(k, 1 / k)), -np.inf
    for _ in range(ROUNDS):
        got = summed(partial(expectation, m)) / n
        likelihood, got = got[0], got[1:]
        mass = got[:k] + EXAMPLE_WEIGHT
        mu = (got[k : k + k * d].reshape(k, d) + EXAMPLE_WEIGHT * own) / mass[:, None]
        square = (got[k + k * d :].reshape(k, d) + EXAMPLE_WEIGHT * own_square) / mass[:, None]
        m = Mixture(mean, std, mu, np.maximum(square - mu**2, LEAST_VARIANCE), mass / mass.sum())
        if likelihood - before < GAIN:
            break
        before = likelihood
    return m


def letter_counts(documents: DataFrame) -> dict[str, int]:
    """Counts of three letters in a row over the words of all texts: at most LETTERS cubed entries, summed where the texts lie."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        grams: Counter = Counter()

        def take() -> None:
            for w, n in words.items():
                if len(w) >= LEAST_WORD:
                    for g in trigrams(w):
                        grams[g] += n
            words.clear()

        for pdf in batches:
            for t in pdf["text"]:
                words.update(_WORD.findall(t.lower()))
            if len(words) > 200_000:
                take()
        take()
        yield pd.DataFrame(list(grams.items()), columns=["gram", "n"])

    got = documents.where(F.col("text").isNotNull()).select("text").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in got.collect()}


def summed_over(cells: DataFrame) -> Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]:
    """Adds up a function of cells and counts over a table of them; the driver gets one row of numbers of each task."""

    def summed(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        width = len(f(np.zeros(1, dtype=np.int64), np.zeros(1)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(width)
            for pdf in batches:
                if len(pdf):
                    total += f(pdf["cell"].to_numpy(), pdf["n"].to_numpy(dtype=float))
            yield pd.DataFrame({"sums": [total.tolist()]})

        rows = cells.mapInPandas(run, "sums array<double>").collect()  # at most TASKS rows
        return np.sum([r["sums"] for r in rows], axis=0) if rows else np.zeros(width)

    return summed


def _common(common_words: DataFrame) -> frozenset[str]:
    """The common words, a fixed small table, with and without accents."""
    words = {r["word"].lower() for r in common_words.select("word").where(F.col("word").isNotNull()).distinct().collect()}
    return frozenset(words | {unicodedata.normalize("NFKD", w).encode("ascii", "ignore").decode() for w in words}) - {""}


def document_figures(documents: DataFrame, common: frozenset[str], counts: dict[str, int]) -> DataFrame:
    """doc_id, the figures of each document, and its blocks as cells and sizes; written out, as it is used twice."""
    model = documents.sparkSession.sparkContext.broadcast((common, counts))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = model.value
        plausible = Letters(seen)
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                t = t or ""
                cells, sizes = [], []
                n = letters = commons = digits = symbols = solid = 0.0
                for b in blocks(t):
                    s = statistics(b, known, plausible)
                    words = round(2 ** s[4] - 1)
                    own = len(b) - b.count(" ")
                    n, letters, commons = n + words, letters + s[3] * words, commons + s[0] * words
                    digits, symbols, solid = digits + s[1] * own, symbols + s[2] * own, solid + own
                    cells.append(cell(s))
                    sizes.append(len(b))
                lines = [x.rstrip() for x in t.split("\n") if x.strip()]
                ended = sum(x[-1] in ".!?:;…”\"" for x in lines)
                rows.append((d, int(n), letters / n if n else 0.0, symbols / solid if solid else 0.0, digits / solid if solid else 0.0, len(lines), ended / len(lines) if lines else 0.0, commons / n if n else 0.0, cells, sizes))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "n_lines", "ended_line_share", "common_word_share", "cells", "sizes"])

    schema = "doc_id bigint, n_words bigint, mean_word_length double, symbol_ratio double, digit_ratio double, n_lines bigint, ended_line_share double, common_word_share double, cells array<bigint>, sizes array<int>"
    return cut(documents.select("doc_id", "text").mapInPandas(scan, schema))


def quality(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, figures, shares of prose, list, table and junk by characters, and the largest of them."""
    common, counts = _common(common_words), letter_counts(documents)
    figures = document_figures(documents, common, counts)
    cells = cut(figures.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).coalesce(TASKS))
    plausible = Letters(counts)
    examples = [np.array([cell(statistics(b, common, plausible)) for b in held]) for _, held in EXAMPLES]
    model = documents.sparkSession.sparkContext.broadcast(fit(summed_over(cells), examples))

    @F.pandas_udf("prose double, list double, table double, junk double")
    def shares(cells: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(cells), len(KINDS)))
        lengths = cells.map(len).to_numpy(dtype=np.int64)
        if lengths.sum():
            row = np.repeat(np.arange(len(cells)), lengths)
            codes, place = np.unique(np.concatenate(cells.to_list()), return_inverse=True)
            np.add.at(out, (row, model.value.kinds(codes)[place]), np.concatenate(sizes.to_list()))
        return pd.DataFrame(out / np.maximum(out.sum(1, keepdims=True), 1), columns=list(KINDS))

    got = figures.withColumn("s", shares("cells", "sizes"))
    top = F.greatest(*[F.col(f"s.{k}") for k in KINDS])
    kind = F.when(top == 0, F.lit("empty"))
    for k in KINDS:
        kind = kind.when(F.col(f"s.{k}") == top, F.lit(k))
    return got.select("doc_id", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "n_lines", "ended_line_share", "common_word_share", *[F.col(f"s.{k}").alias(f"{k}_share") for k in KINDS], kind.alias("kind"))
