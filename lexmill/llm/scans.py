"""Text of scanned pages repaired into continuous paragraphs.

Noisy channel. Words of the corpus and their neighbours are counted over all rows; a word that is rare, or mixed with
digits and signs, may be a misreading: candidates are the frequent words that common confusions of characters turn into
it, weighted by the probabilities of the confusions and by the corpus's word and neighbour counts, and a Viterbi search
over the candidates of each line picks the line as a whole. Words broken by hyphens at or within lines are joined, spaced
out letters are closed up, running headers and page numbers are taken out, and lines are joined into paragraphs.

The counts kept are bounded by a share: words of at least WORD_SHARE and pairs of at least PAIR_SHARE of all occurrences,
at most 1 / WORD_SHARE and 1 / PAIR_SHARE entries at any size of the corpus. What falls below counts as unseen.

Defined results: null gives no row; a text without fault stays as it is; line breaks alone, hyphenated compounds, figures
beside letters (m2, A1, 9h) and words of prose such as "às fls. 12" are no fault; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut

WORD_SHARE, PAIR_SHARE = 2e-6, 4e-6
L = "A-Za-zÀ-ÖØ-öø-ÿ"
_TOKEN = re.compile(rf"[{L}]+")
#: Letters and signs that stand beside a word only where it was decoded wrongly.
_ODD = re.compile(rf"[^\x00-\x7f{L}§°ºª“”‘’–—•…«»\xa0‐¬\xadﬁﬂ]")
_ANY = re.compile(rf"[{L}\d@|ﬁﬂ]+")
#: Hyphens at line ends, as written and as they look when garbled afterwards.
_HYPHEN = r"(?:-|‐|¬|(?<!Ã)\xad|Â[¬\xad]|â[€\x80]\x90|¬[¨≠])"
_BREAK = re.compile(rf"(?<![{L}])([{L}]+)({_HYPHEN}) ?\n[ \t]*([a-zß-öø-ÿ]+)")
_INLINE = re.compile(rf"(?<![{L}-])([{L}]+)({_HYPHEN}) ([a-zß-öø-ÿ]+)(?![{L}-])")
_SPACED = re.compile(rf"(?<![{L}\d’'.-])[{L}](?:(?: [A-ZÀ-ÖØ-Þ]){{3,}}|(?: [a-zß-öø-ÿ]){{3,}})(?![{L}])")
#: Words with signs or figures for letters; what is joined to further signs (addresses, keys) is left alone.
_MIXED = re.compile(rf"(?<![{L}\d@|=/_+.&#$-])(?=[{L}\d@|]*[@|\d])(?=[{L}\d@|]*[{L}])[{L}\d@|ﬁﬂ]{{3,}}(?![{L}\d@|=/_+&#]|\.[{L}\d])|(?<![{L}ﬁﬂ])[{L}]*[ﬁﬂ][{L}ﬁﬂ]*")

#: Confusions: what is read -> [(what it was, log probability)].
CONFUSIONS = {
    "@": [("a", -2.0)], "0": [("o", -2.0)], "1": [("i", -2.2), ("l", -2.2)], "|": [("i", -2.2), ("l", -2.4)], "5": [("s", -2.0)], "8": [("b", -3.0)], "6": [("b", -3.5)], "3": [("e", -3.5)], "4": [("a", -3.5)], "9": [("g", -3.5)],
    "ﬁ": [("fi", -0.5)], "ﬂ": [("fl", -0.5)],
    "rn": [("m", -3.0)], "m": [("rn", -4.5)], "cl": [("d", -3.5)], "vv": [("w", -4.0)], "c": [("e", -4.0)], "e": [("c", -5.0)], "q": [("ç", -4.0), ("g", -5.0)], "b": [("h", -4.5)], "h": [("b", -5.0)], "l": [("i", -4.5), ("t", -5.0)], "i": [("l", -4.5)],
    "ii": [("n", -5.0), ("u", -5.0)], "u": [("n", -5.0)], "n": [("u", -5.0)], "f": [("t", -5.0)], "t": [("f", -5.0)],
}
_SIGNS = frozenset("@|ﬁﬂ0123456789")
#: What is equal for words that confusions turn into one another, letter by letter: strokes, bowls and the like.
_OUTLINES = str.maketrans(
    dict.fromkeys("filt1|", "I") | dict.fromkeys("nu", "II") | dict.fromkeys("ce3", "E") | dict.fromkeys("bh86", "B") | dict.fromkeys("qçg9", "G")
    | {"m": "rII", "d": "EI", "w": "vv", "@": "a", "4": "a", "0": "o", "5": "s", "ﬁ": "II", "ﬂ": "II"}
)


def _outline(word: str) -> str:
    """The outline of a lower-case word: a word and what it may have been have the same."""
    return word.translate(_OUTLINES)



_PAGE = r"(?:P[ÁA]GINA:? ?\d{1,5}|P[áa]gina:? \d{1,5}(?: (?:de|/) \d{1,5})?|P[áa]g\. ?\d{1,5}(?: ?/ ?\d{1,5})?|[Ff]l(?:s)?\. ?\d{1,5}|\d{1,5} \| ?P ?á ?g ?i ?n ?a|- ?\d{1,5} ?-|\[\d{1,5}\]|\d{1,4})"
_UPPER = r"[A-ZÀ-ÖØ-Þ]"
_HEAD = (
    rf"(?:GABINETE D[OA] [{_UPPER[1:-1]} ]+|Documento assinado (?:digital|eletronica)mente|[A-Z]{{2,8}} \d{{4}} DIÁRIO OFICIAL|DIÁRIO OFICIAL(?: D[OAE]S? [{_UPPER[1:-1]} ]+)?"
    rf"|PROCESSO (?:[A-Za-z]{{2,5}}[ -]?)?[\d./ -]{{6,}}\d(?: ?[-/] ?[A-Z]{{2}})?|(?![IVXLC]+ )[A-Z]{{3,8}} - (?:\d{{1,2}}ª )?[A-Z][a-zà-ú]+(?: (?:d[eoa] )?[A-Z][a-zà-ú]+){{0,4}}|ATOS DO PODER [{_UPPER[1:-1]}]+|Caderno [A-Z][a-zà-ú]+ \d{{1,5}}"
    rf"|Secretaria d[eao] [A-Z][a-zà-ú]+(?: [A-Za-zà-ú]+)?|(?:CÂMARA|PREFEITURA) MUNICIPAL DE [{_UPPER[1:-1]} ]+|(?:MUNICÍPIO|ESTADO) D[EO] [{_UPPER[1:-1]} ]+)"
)
_LINE = re.compile(rf"^[ \t]*(?:{_HEAD}(?:[ \t]+{_PAGE})?|{_PAGE}(?:[ \t]+{_HEAD})?)[ \t]*$", re.M)
#: Texts without these need no closer look.
_MAY_BREAK = re.compile(r"[-‐¬\xad\x90¨≠](?: ?\n| [a-zß-öø-ÿ])")
_MAY_MIX = re.compile(rf"[@|\dﬁﬂ](?:(?=[{L}])|(?<=[{L}].))")
_MAY_SPACE = re.compile(rf" [{L}] [{L}] [{L}](?![{L}])")
_BARE = re.compile(r"\d{1,4}")
_WANTS_NUMBER = re.compile(r"(?:nº|n°|arts?\.|§§?|R\$|inciso|item|[|\t])$", re.I)
#: Sections stand on lines of their own and are no headers of pages.
_SECTION = re.compile(r"(?:RELATÓRIO|VOTO|DISPOSITIVO|EMENTA|ACÓRDÃO|DECISÃO|TESE|CONCLUSÃO|ANEXO(?: [IVXLC]+| ÚNICO)?)")


def is_page_mark(line: str) -> bool:
    """A running header or page number of a scan, alone on its line."""
    return bool(_LINE.fullmatch(line))


class Lexicon:
    """Counts of frequent words and pairs, and the corrections they allow."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], total: int) -> None:
        self.words, self.pairs, self.total = words, pairs, max(total, 1)
        self.floor = max(1.0, total * WORD_SHARE)
        self.memo: dict[str, tuple[tuple[str, float], ...]] = {}
        self.reached: dict[tuple[int, int], float] = {}
        self.alike: dict[str, list[str]] = {}
        for w in words:
            self.alike.setdefault(_outline(w), []).append(w)

    def _channel(self, low: str, was: str) -> float | None:
        """Log probability of the likeliest confusions by which one word is read as another, however many; None: there are none."""
        front: dict[tuple[int, int], float] = {(0, 0): 0.0}
        best: float | None = None
        while front:
            (i, j), p = front.popitem()
            if i == len(low) and j == len(was):
                best = p if best is None else max(best, p)
                continue
            steps = [(i + 1, j + 1, p)] if i < len(low) and j < len(was) and low[i] == was[j] else []
            for size in (2, 1):
                for w, q in CONFUSIONS.get(low[i : i + size], ()) if i + size <= len(low) else ():
                    if was.startswith(w, j):
                        steps.append((i + size, j + len(w), p + q))
            for x, y, r in steps:
                if self.reached.get((x, y), -math.inf) < r:
                    self.reached[x, y] = front[x, y] = r
        self.reached.clear()
        return best

    def candidates(self, word: str) -> tuple[tuple[str, float], ...]:
        """Frequent words that this one may be a misreading of, lower case, with channel log probability; best first."""
        low = word.lower()
        got = self.memo.get(low)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[low] = self._find(low)
        return got

    def _find(self, low: str) -> tuple[tuple[str, float], ...]:
        mixed = any(c in _SIGNS for c in low)
        if len(low) < (3 if mixed else 4):
            return ()
        own = self.words.get(low, 0)
        if not mixed and own >= self.total * 2e-4:
            return ()
        need = max(own, self.floor) * (2 if mixed else 20)
        found = []
        for w in self.alike.get(_outline(low), ()):
            if w != low and self.words[w] >= need and len(w) >= 2 and not (len(w) < 4 and not mixed) and (p := self._channel(low, w)) is not None:
                found.append((w, p))
        return tuple(sorted(found, key=lambda x: -(x[1] + math.log(self.words[x[0]]))))

    def _step(self, a: str, b: str) -> float:
        n = self.pairs.get((a, b), 0)
        return math.log((n + 0.4 * self.words.get(b, 0.5) / self.total * 50) / (self.words.get(a, 0.5) + 50))

    def line(self, tokens: list[str], options: list[tuple[tuple[str, float], ...]]) -> list[str | None]:
        """Viterbi over the line: for each token the word chosen, None where it stays."""
        layers: list[dict[str, tuple[float, str | None, bool]]] = []
        for t, opts in zip(tokens, options, strict=True):
            low = t.lower()
            if not opts and layers and len(layers[-1]) == 1:  # nothing to choose here
                layers.append({low: (0.0, next(iter(layers[-1])), False)})
                continue
            mixed = any(c in _SIGNS for c in low)
            states = [(w, p, True) for w, p in opts] + ([(low, -12.0 if mixed else -0.1, False)] if not (mixed and opts) else [])
            layer: dict[str, tuple[float, str | None, bool]] = {}
            for w, p, changed in states:
                prev = max(((s + self._step(a, w), a) for a, (s, _, _) in layers[-1].items()), default=(math.log((self.words.get(w, 0) + 0.5) / self.total), None)) if layers else (math.log((self.words.get(w, 0) + 0.5) / self.total), None)
                layer[w] = (prev[0] + p, prev[1], changed)
            layers.append(layer)
        out: list[str | None] = []
        at: str | None = max(layers[-1], key=lambda w: layers[-1][w][0]) if layers else None
        for layer in reversed(layers):
            _, back, changed = layer[at]
            out.append(at if changed else None)
            at = back
        return out[::-1]


def _like(word: str, pattern: str) -> str:
    """The word in the case of the pattern."""
    letters = [c for c in pattern if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if pattern[:1].isupper() else word


class Repairer:
    """Repairs texts with a lexicon."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.clear = lexicon, set()

    def _known(self, w: str) -> int:
        return self.lexicon.words.get(w.lower(), 0)

    def _pages(self, text: str) -> tuple[str, int]:
        n, out, at = 0, [], 0
        for m in _LINE.finditer(text):
            line = m.group().strip()
            if _SECTION.fullmatch(line):
                continue
            between = text[at : m.start()]
            if between.strip():
                out.append(between)
            before = (out[-1] if out else "").rstrip()
            if _BARE.fullmatch(line) and (_WANTS_NUMBER.search(before) and not re.search(r"\n\s*\n\s*$", between) or re.match(r"\n[ \t]*(?:[-.,;|\t]|dias|%)", text[m.end() :])):
                at = m.start()
                if between.strip():
                    out.pop()
                    at -= len(between)
                continue
            n += 1
            at = m.end()
            # a page broke here: what stood around it belongs together unless a paragraph ended
            if before and before[-1] not in ".:;!?":
                out[-1] = before + "\n"
                at += len(text[at:]) - len(text[at:].lstrip())
        return ("".join(out) + text[at:], n) if n else (text, 0)

    def _break(self, m: re.Match) -> str | None:
        a, hyphen, b = m.groups()
        if hyphen == "-":
            joined, kept = self._known(a + b), self._known(f"{a}-{b}")
            if kept > joined or b in ("se", "lhe", "lo", "la", "lhes", "los", "las", "o", "a", "os", "as", "me", "nos") and not joined:
                return None
        return a + b

    def _text(self, text: str) -> tuple[str, int, int]:
        """(text, words joined, words closed up)."""
        n = k = 0

        def broken(m: re.Match) -> str:
            nonlocal n
            if (w := self._break(m)) is None:
                return m.group()
            n += 1
            return w

        def inline(m: re.Match) -> str:
            nonlocal n
            a, hyphen, b = m.groups()
            if hyphen == "-" and not (self._known(a + b) > 10 * self._known(f"{a}-{b}") or self.lexicon.candidates(a + b)):
                return m.group()
            n += 1
            return a + b

        def spaced(m: re.Match) -> str:
            nonlocal k
            w = m.group().replace(" ", "")
            if len(w) < 5 and not self._known(w):
                return m.group()
            k += 1
            if not self._known(w) and len(w) > 5:  # a word of one letter beside it
                if self._known(w[:-1]):
                    return f"{w[:-1]} {w[-1]}"
                if self._known(w[1:]):
                    return f"{w[0]} {w[1:]}"
            return w

        while _MAY_BREAK.search(text):  # every round but the last joins something
            had = n
            text = _INLINE.sub(inline, _BREAK.sub(broken, text))
            if n == had:
                break
        if _MAY_SPACE.search(text):
            text = _SPACED.sub(spaced, text)
        return text, n, k

    def _suspects(self, text: str) -> set[str]:
        """Words that may be misread."""
        words = set(_TOKEN.findall(text)) - self.clear
        out = set()
        for w in words:
            if (got := self.lexicon.candidates(w)) and (w[:1].islower() or w.isupper() or self.lexicon.words[got[0][0]] >= 20 * max(self.lexicon.floor, self._known(w)) and len(w) >= 5):
                out.add(w)
            elif len(self.clear) < 500_000:
                self.clear.add(w)
        return out

    def _misread(self, text: str) -> tuple[str, int]:
        suspects = self._suspects(text)
        mixed = {m.group() for m in _MIXED.finditer(text)} if _MAY_MIX.search(text) else set()
        mixed = {w for w in mixed if self.lexicon.candidates(w) or re.fullmatch(rf"[{L}][a-zß-öø-ÿ]*[@|015][a-zß-öø-ÿ]*[a-zß-öø-ÿ]{{2,}}", w) and w[-1:].isalpha() and not re.match(r"[a-zA-Z]\d", w) or "ﬁ" in w or "ﬂ" in w}
        if not suspects and not mixed:
            return text, 0
        n = 0
        token = _ANY if mixed else _TOKEN
        wanted = suspects | mixed
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if not any(w in line for w in wanted):
                continue
            found = list(token.finditer(line))
            tokens = [m.group() for m in found]
            if wanted.isdisjoint(tokens):
                continue
            # pieces of a word whose other letters were decoded wrongly are no misreadings
            whole = [not _ODD.match(line, m.end()) and not (m.start() and _ODD.match(line, m.start() - 1)) for m in found]
            options = [self.lexicon.candidates(t) if w and (t in suspects or t in mixed) else () for t, w in zip(tokens, whole, strict=True)]
            chosen = self.lexicon.line(tokens, options)
            out, at = [], 0
            for m, t, w, o, ok in zip(found, tokens, chosen, options, whole, strict=True):
                if w is None and t in mixed and not o and ok:  # a name: no frequent word, but plainly misread
                    w = "".join(CONFUSIONS[c][0][0] if c in _SIGNS else c for c in t.lower())
                if w is not None and w != t.lower():
                    n += 1
                    out += [line[at : m.start()], _like(w, t)]
                    at = m.end()
            lines[i] = "".join(out) + line[at:]
        return "\n".join(lines), n

    def repair(self, text: str) -> tuple[str, dict[str, int]]:
        """(repaired text, faults by kind); without faults the text as it is."""
        out, pages = self._pages(text)
        out, joined, closed = self._text(out)
        out, misread = self._misread(out)
        faults = {k: n for k, n in (("page", pages), ("broken", joined), ("spaced", closed), ("misread", misread)) if n}
        if not faults:
            return text, faults
        # continuous paragraphs: a line goes on unless it ended a sentence, an item or a heading
        out = re.sub(rf"(?<=[^\n.:;!?])[ \t]*\n[ \t]*(?=[a-zß-öø-ÿ\d(§R])(?![a-z]\)|\d+\. |[IVXLC]+ ?-)", " ", out)
        out = re.sub(rf"^([{_UPPER[1:-1]}][{L}]{{0,12}},?|Art\.|Artigo|§|[IVXLC]+|[a-z]\))[ \t]*\n(?=[-\wÀ-ÿ])", r"\1 ", out, flags=re.M) if "\n" in out else out
        out = re.sub(r"\n{3,}", "\n\n", out)
        return out.strip("\n"), faults


def _counted(texts: DataFrame) -> DataFrame:
    """kind, a, b, n: words and pairs of neighbours over all rows of a text column, partly summed where they lie."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        pairs: Counter = Counter()

        def out() -> pd.DataFrame:
            rows = [(w, "", n) for w, n in words.items()] + [(a, b, n) for (a, b), n in pairs.items()]
            words.clear()
            pairs.clear()
            return pd.DataFrame(rows, columns=["a", "b", "n"])

        for pdf in batches:
            for t in pdf["text"]:
                tokens = _TOKEN.findall(t.lower())
                words.update(tokens)
                pairs.update(pairwise(tokens))
            if len(pairs) > 400_000:
                yield out()
        yield out()

    return texts.where(F.col("text").isNotNull()).select("text").mapInPandas(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def lexicon(texts: DataFrame) -> tuple[dict[str, int], dict[tuple[str, str], int], int]:
    """Frequent words and pairs of all texts, and the number of words; bounded by WORD_SHARE and PAIR_SHARE."""
    counts = cut(_counted(texts))
    total = counts.where(F.col("b") == "").agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = counts.where(F.when(F.col("b") == "", F.col("n") >= max(3.0, total * WORD_SHARE)).otherwise(F.col("n") >= max(5.0, total * PAIR_SHARE))).collect()
    return {r["a"]: r["n"] for r in rows if not r["b"]}, {(r["a"], r["b"]): r["n"] for r in rows if r["b"]}, total



def repair_scans(texts: DataFrame) -> DataFrame:
    """texts: table_name, row_key, text. Result: those with faults, repaired_text and the faults by kind."""
    model = texts.sparkSession.sparkContext.broadcast(lexicon(texts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Repairer(Lexicon(*model.value))
        for pdf in batches:
            rows = []
            for table, key, text in zip(pdf["table_name"], pdf["row_key"], pdf["text"], strict=True):
                new, faults = r.repair(text)
                if faults:
                    rows.append((table, key, new, *(faults.get(k, 0) for k in ("page", "broken", "spaced", "misread"))))
            yield pd.DataFrame(rows, columns=["table_name", "row_key", "repaired_text", "page", "broken", "spaced", "misread"])

    return texts.where(F.col("text").isNotNull()).select("table_name", "row_key", "text").mapInPandas(run, "table_name string, row_key string, repaired_text string, page int, broken int, spaced int, misread int")
