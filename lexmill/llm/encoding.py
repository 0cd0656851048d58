"""Text that was decoded with the wrong encoding: found and, where it can be had, restored.

Garbled sequences are precomputed for all pairs of encodings. Those of several characters (UTF-8 read as a one-byte
encoding, once or twice) are found with a multi-pattern automaton and replaced where they match. Those of one character
(a one-byte encoding read as another) may also stand in proper foreign words; a word is restored under a pair only if
each restored letter stands between neighbours as such letters do in the corpus and the letter found there doesn't. The
corpus's counts of a marked or garbled letter between two neighbours are a bounded table (alphabet x such letters x alphabet).
Correct text around a match stays as it is.

Defined results: null and text without a garbled stretch give no row; replacement characters are always a case and are
filled, however many a word has lost, where one reading is much more usual than any other, else left; foreign words in proper spelling (Năvodari,
Łódź, Завод, naïve) are no case; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut

#: Marked letters and signs of Portuguese.
MARKED = "áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇºª"
#: Signs that are restored beside letters of the same pair only.
SIGNS = "§°«»·©½²³"
_PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CONTEXT = frozenset(_PLAIN + MARKED)
LOST = "�"

#: One-byte encodings that UTF-8 was read as.
UTF8_AS = ["cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "iso8859-2", "iso8859-15"]
#: One-byte encodings that Portuguese texts were written in, and those that they were read as; every pair counts.
WRITTEN_IN = ["cp1252", "cp850", "cp437", "cp860", "mac_roman"]
READ_AS = ["cp1252", "latin-1", "cp850", "cp437", "cp860", "mac_roman", "cp1250", "iso8859-2", "cp1251", "iso8859-5", "koi8-r", "cp1253", "cp1257"]


def _read(data: bytes, encoding: str) -> str:
    """As programs read it: bytes that an encoding leaves open are taken as Latin-1."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _alphabet() -> Iterator[str]:
    """Characters that a garbled stretch may have held."""
    for a, b in ((0xA0, 0x17F), (0x391, 0x3C9), (0x401, 0x45F), (0x2010, 0x2044), (0x20AC, 0x20AC), (0x2122, 0x2122), (0x2190, 0x2193), (0xFB01, 0xFB02), (0x1F300, 0x1F64F)):
        yield from map(chr, range(a, b + 1))


@lru_cache(maxsize=1)
def sequences() -> dict[str, tuple[str, str]]:
    """Garbled sequences of several characters: (what it was, pair)."""
    out: dict[str, tuple[str, str]] = {}
    for c in _alphabet():
        for e in UTF8_AS:
            once = _read(c.encode("utf-8"), e)
            out.setdefault(once, (c, f"utf-8>{e}"))
            if e in ("cp1252", "latin-1", "mac_roman"):
                twice = _read(once.encode("utf-8"), e)
                out.setdefault(twice, (c, f"utf-8>{e} twice"))
    # a no-break space within a sequence is often turned into a space later on
    for garbled, (c, pair) in list(out.items()):
        if c in "àí" and garbled.endswith("\xa0"):
            out.setdefault(garbled[:-1] + " ", (c, pair))
    return out


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for garbled, (c, pair) in sequences().items():
        a.add_word(garbled, (len(garbled), c, pair))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def one_as() -> list[tuple[str, dict[int, str]]]:
    """For each pair, garbled character -> marked letter or sign; pairs that garble alike count once, under the first."""
    out: dict[tuple, tuple[str, dict[int, str]]] = {}
    for was, read in product(WRITTEN_IN, READ_AS):
        table = {}
        for c in MARKED + SIGNS:
            try:
                g = _read(c.encode(was), read)
            except UnicodeEncodeError:
                continue
            if g != c:
                table.setdefault(ord(g), c)
        if table:
            out.setdefault(tuple(sorted(table.items())), (f"{was}>{read}", table))
    return list(out.values())


_FOREIGN = "".join(sorted({chr(g) for _, t in one_as() for g in t} - set(MARKED)))
#: Letters whose neighbours are counted: marked ones, and what garbling turns them into.
_AROUND = re.compile(f"[{MARKED}{re.escape(_FOREIGN)}]")
#: A word with a sign of garbling: a character that is no Portuguese letter, or a capital mark after a small letter.
_WORD = re.compile(rf"(?<![^ \t\n\r])[^ \t\n\r]*(?:[{re.escape(_FOREIGN)}]|[a-zà-ú][ÀÁÂÃÇÉÊÍÓÔÕÚ])[^ \t\n\r]*")
#: Texts without any of this need no look.
SUSPECT = (
    rf"[^\x00-\x7f{MARKED}§°²³–—“”‘’•…·»©↑→½¼€\xa0\xad\u2010\u2011¬]|[a-zà-ú][ÀÁÂÃÇÉÊÍÓÔÕÚ“‘’”•…·»€°§–—\xa0][A-Za-zÀ-ÿ]"
    r"|[ÃÂ][^A-Za-zÀ-ÖØ-öø-ÿ\s.,;:)–-]|Ã[ \xa0][a-z ]|¬[^\sA-Za-zÀ-ÿ]"
)


#: What a restored word may consist of.
_PROPER = re.compile(rf"[\x21-\x7e{MARKED}§°«»·©½²³–—‐\xad¬…“”‘’]*")
#: A word of the lexicon is at least this share of all marked words: the lexicon has at most 1 / WORD_SHARE entries.
WORD_SHARE = 1e-5
_MARKED_WORD = re.compile(rf"(?<![A-Za-z{MARKED}])[A-Za-z]*[{MARKED}][A-Za-z{MARKED}]*")


def _class(c: str) -> str:
    return c if c in _CONTEXT else "9" if c.isdigit() else "#"


def count_marked(texts: list[str | None], into: Counter) -> None:
    """Counts of marked letters between their neighbours."""
    for t in texts:
        if not t:
            continue
        s = f"\n{t}\n"
        into.update([s[m.start() - 1 : m.start() + 2] for m in _AROUND.finditer(s, 1, len(s) - 1)])


def count_words(texts: list[str | None], into: Counter) -> None:
    """Counts of words with marked letters."""
    for t in texts:
        if t:
            into.update(map(str.lower, _MARKED_WORD.findall(t)))


def folded(raw: Counter) -> Counter:
    """Neighbours that are no letters of the alphabet brought down to two classes."""
    out: Counter = Counter()
    for g, n in raw.items():
        out[_class(g[0]) + g[1] + _class(g[2])] += n
    return out


class Restorer:
    """Restores texts; usual: counts of marked letters between neighbours; words: counts of frequent marked words."""

    def __init__(self, usual: dict[str, int], words: dict[str, int]) -> None:
        self.usual, self.words = usual, words
        #: Letters between neighbours rarer than this share say nothing: a share, the same at any size of the corpus.
        self.least = max(2, sum(usual.values()) // 2_000_000)
        self.by_length: dict[int, list[str]] = {}
        for w in words:
            self.by_length.setdefault(len(w), []).append(w)
        self.memo: dict[str, tuple[tuple[str, int], ...]] = {}

    def _count(self, s: str, i: int) -> int:
        return self.usual.get((_class(s[i - 1]) if i else "#") + s[i] + (_class(s[i + 1]) if i + 1 < len(s) else "#"), 0)

    @staticmethod
    def _case(s: str, i: int) -> bool:
        """No capital after a small letter, no small letter between capitals."""
        a, b = s[i - 1] if i else "", s[i + 1] if i + 1 < len(s) else ""
        return not (s[i].isupper() and a.islower() or s[i].islower() and s[i] not in "ºª" and a.isupper() and b.isupper())

    def _word(self, word: str, only: set[str] | None) -> tuple[str, str] | None:
        """(restored, pair) or None; only: pairs known from the same text, for signs that stand alone."""
        best: tuple[int, str, str] | None = None
        for pair, table in one_as():
            if only is not None and pair not in only:
                continue
            new = word.translate(table)
            if new == word:
                continue
            low, firm = 1 << 60, False
            for i, (a, b) in enumerate(zip(word, new, strict=True)):
                if a == b:
                    continue
                n = self._count(new, i) if b not in SIGNS else self.least
                if n < self.least or not self._case(new, i) or n < 20 * self._count(word, i):
                    low = 0
                    break
                low = min(low, n)
                firm |= b not in SIGNS and (word[i - 1 : i].isalpha() or word[i + 1 : i + 2].isalpha() or word[i - 1 : i].isdigit() and a.isalpha())
            if low and _PROPER.fullmatch(new) and (firm or only is not None) and (best is None or low > best[0]):
                best = (low, new, pair)
        return best and (best[1], best[2])

    def _fitting(self, word: str) -> tuple[tuple[str, int], ...]:
        """What words of the lexicon have where a lower-case word has lost characters, and their counts."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            like = re.compile("".join(f"([{MARKED}])" if c == LOST else re.escape(c) for c in word))
            got = self.memo[word] = tuple(("".join(m.groups()), self.words[w]) for w in self.by_length.get(len(word), ()) if (m := like.fullmatch(w))) if len(word) in self.by_length else ()
        return got

    def _lost(self, text: str) -> str:
        """Replacement characters filled from the lexicon, else where one letter is by far the most usual between its neighbours."""

        def fill(m: re.Match) -> str:
            word = m.group()
            holes = [i for i, c in enumerate(word) if c == LOST]
            capital = word.replace(LOST, "").isupper() and len(word) > len(holes) + 1
            scores: Counter = Counter()

            def take(cs: str, seen: int) -> None:
                new = list(word)
                for i, c in zip(holes, cs, strict=True):
                    new[i] = c
                s = "".join(new)
                usual = min(self._count(s, i) for i in holes)
                if seen or usual >= self.least:
                    scores[s] = max(scores[s], seen * 1000 + usual)

            for cs, seen in self._fitting(word.lower()):
                take(cs.upper() if capital else cs, seen)
            if len(holes) == 1:
                for c in MARKED:
                    if c.isupper() == capital or c in "ºª":
                        take(c, 0)
            top = scores.most_common(2)
            return top[0][0] if top and (len(top) == 1 or top[0][1] >= 4 * top[1][1]) else word

        return re.sub(rf"(?<![A-Za-z0-9{MARKED}{LOST}])[A-Za-z0-9{MARKED}]*{LOST}[A-Za-z0-9{MARKED}{LOST}]*", fill, text)

    def restore(self, text: str) -> tuple[str, int, set[str]]:
        """(restored text, number of garbled stretches, pairs)."""
        n, pairs = 0, set()
        if not text.isascii():
            out, at = [], 0
            for end, (size, c, pair) in _automaton().iter_long(text):
                start = end - size + 1
                if text[end] == " " and (start and text[start - 1].isalpha() or not text[end + 1 : end + 2].islower()):
                    continue
                out += [text[at:start], c]
                at, n = end + 1, n + 1
                pairs.add(pair)
            if at:
                text = "".join(out) + text[at:]
        found: set[str] = set()

        def firm(m: re.Match) -> str:
            nonlocal n
            if got := self._word(m.group(), None):
                n += 1
                found.add(got[1])
                return got[0]
            return m.group()

        new = _WORD.sub(firm, text)
        if found:
            garbled = {chr(g) for p, t in one_as() if p in found for g in t}

            def loose(m: re.Match) -> str:
                nonlocal n
                if garbled.intersection(m.group()) and (got := self._word(m.group(), found)):
                    n += 1
                    return got[0]
                return m.group()

            new = re.sub(r"\S+", loose, new)
        if LOST in new:
            n += len(re.findall(f"{LOST}+", new))
            found.add("lost")
            new = self._lost(new)
        return new, n, pairs | found


def marked_letters(df: DataFrame, fields: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """Counts over all rows of marked letters between neighbours and of the frequent marked words.

    Both are bounded: alphabet x marked letters x alphabet entries, and at most 1 / WORD_SHARE words.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out() -> pd.DataFrame:
            done = folded(raw)
            return pd.DataFrame([("g", g, n) for g, n in done.items()] + [("w", w, n) for w, n in words.items()], columns=["kind", "gram", "n"])

        raw: Counter = Counter()
        words: Counter = Counter()
        for pdf in batches:
            for f in pdf.columns:
                texts = pdf[f].tolist()
                count_marked(texts, raw)
                count_words(texts, words)
            if len(raw) + len(words) > 500_000:
                yield out()
                raw.clear()
                words.clear()
        yield out()

    grams = df.select(*fields).mapInPandas(count, "kind string, gram string, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n"))
    sums = cut(grams)
    total = sums.where(F.col("kind") == "w").agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = sums.where((F.col("kind") == "g") | (F.col("n") >= max(2.0, total * WORD_SHARE))).collect()
    return {r["gram"]: r["n"] for r in rows if r["kind"] == "g"}, {r["gram"]: r["n"] for r in rows if r["kind"] == "w"}


def restore_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field_name, restored_text, stretches, pairs, complete: a row for each value with a garbled stretch."""
    model = df.sparkSession.sparkContext.broadcast(marked_letters(df, fields))
    src = df.select(F.col(key).alias("_key"), *fields)
    names = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, suspect = Restorer(*model.value), re.compile(SUSPECT)
        for pdf in batches:
            rows = []
            for name in names:
                for k, t in zip(pdf["_key"], pdf[name], strict=True):
                    if t and suspect.search(t):
                        text, n, pairs = r.restore(t)
                        if n:
                            rows.append((k, name, text, n, ", ".join(sorted(pairs)), LOST not in text))
            yield pd.DataFrame(rows, columns=["_key", "field_name", "restored_text", "stretches", "pairs", "complete"])

    kind = src.schema["_key"].dataType.simpleString()
    return src.mapInPandas(run, f"_key {kind}, field_name string, restored_text string, stretches int, pairs string, complete boolean").withColumnRenamed("_key", key)
