"""Page furniture (navigation, notices, sidebars, footers) removed from the text of web pages.

Site template removal. A text is cut into elements, the leaves of a page's tree as they are left in its text: what stands
between line ends, separators (| » · • and the like), wide spaces and sentence ends. Every element that is no running sentence has a
hash of its form (figures, host names and signs outside ASCII made equal), and so has a sentence that stands in one line before
such elements, as notices do. Spark counts for each element the distinct pages of each host it stands on as an element of its own, and
those of all hosts. What recurs on ``PAGES`` pages of a host, or on ``WIDE_PAGES`` pages of ``WIDE_HOSTS`` hosts, may be
template; it is template unless the same words stand at least as often in running sentences (as parts of them, or broken off
at a line end). The counts decide, no list of wordings: the only forms set apart beforehand are headings in capitals, page
marks of scans (those of ``scans``) and leftover markup. Template is found wherever it stands, within a line too: between
capitals of a segment.

The texts are read twice. The first pass gives the elements to be counted. Its result, as three bit tables of fixed size (first
two words, these with the number of words, and whole forms of what may be template) and the numbers of words that occur, tells the
second which words of a text are worth a look, and how many of them, so elements of any length are found; what passes is then
joined exactly. Only hashes are shuffled. Of template keys, those with a share of all hits, at most 1 / ``HOT_SHARE`` of them
whatever the size, are broadcast; no other key has more rows than that share, so none is a task of its own.

Defined results: null and blank texts have no elements; a row without address counts as a page of no host, alone; a page
collected again under the same address counts once; an element seen on fewer pages is no template; menus in capitals are
read as headings unless they have three entries or more; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import scans, worker
from lexmill.session import cut

#: Distinct pages of a host from which an element may be template; or distinct pages, and hosts, of all.
PAGES, WIDE_PAGES, WIDE_HOSTS = 3, 5, 3
#: Share of all hits from which a template key is hot.
HOT_SHARE = 1e-4
#: Bits of a hash that stand for the first words; and size of the bit tables.
FIRST_BITS = 22
#: Words that an element within a line has at least.
SHORTEST = 2

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
#: Borders of elements: line ends, separators, wide spaces, path signs between names, sentence ends.
_BORDER = re.compile(
    rf"\n[ \t\n]*|\|(?![{_LOW}])[ \t|]*|\t[ \t]*(?:\n[ \t\n]*)?"
    # most spaces are none: what stands beside them is looked at first
    rf"| (?:(?<=[.!?…:] )(?=[{_UP}©\[🍪«])|(?=[\s|»›·•«→↑>/©])(?:[ \t]*\n[ \t\n]*|[ \t]*\|[ \t|]*|[ \t]*[»›·•«→↑]+(?=\s|$)[ \t]*|[ \t]+|(?<=[{_LOW}] )[>/] (?=[{_UP}][{_LOW}])|(?=©)))"
)
_HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+")
_DIGITS, _OTHER, _SPACES = re.compile(r"\d+"), re.compile(r"[^\x00-\x7f]+"), re.compile(r"[ \t\n]+")
_LETTERS = re.compile(r"[^\W\d_]{4}")
_NOT_ASCII_LETTER = re.compile(r"[^A-Za-z]+")
_MARKUP = re.compile(r"<[a-zA-Z/!]|[`\\]|\]\(|\[\[|\{\{|\*\*|__|''")
_MENU = re.compile(r"[|»›·•]")
_WORDS = re.compile(r"[^ \t\n]+")
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51
#: Words that elements within a segment may begin with.
_HEADS = re.compile(rf"([^\s{_LOW}0-9(,.;:-](?<![^\s|][\s\S])[^ \t\n|]*)(?=( [^ \t\n|]+)?)")


class Element(NamedTuple):
    key: int
    #: own: an element of its own; broken: goes on in the next line; inline: part of a segment; running: part of a sentence.
    kind: str
    start: int
    end: int


def _form(piece: str) -> str:
    """What is equal for all pages of a template, however its marked letters were decoded."""
    piece = _SPACES.sub(" ", _DIGITS.sub("0", _OTHER.sub("~", piece)))
    return _HOST.sub("HOST", piece) if "." in piece else piece


def _first(words: str) -> int:
    """The bits of the first two words of a form, or of its only one."""
    return xxhash.xxh64_intdigest(words.encode()) >> (64 - FIRST_BITS)


@lru_cache(200_000)
def _word(form: str) -> int:
    return xxhash.xxh64_intdigest(form.encode()) % _PRIME


@lru_cache(10_000)
def _power(n: int) -> int:
    return pow(_BASE, n, _PRIME)


def _sums(forms: list[str]) -> list[int]:
    """Polynomials of the words up to each, so that the hash of any stretch is one step."""
    out, x = [0], 0
    for w in forms:
        x = (x * _BASE + _word(w)) % _PRIME
        out.append(x)
    return out


def _stretch(forms: list[str], sums: list[int], i: int, j: int) -> int:
    """Hash of the form of words i to j: the high bits are those of its first two."""
    rest = (sums[j] - sums[i] * _power(j - i)) % _PRIME & ((1 << (64 - FIRST_BITS)) - 1)
    return (_first(forms[i] if j == i + 1 else f"{forms[i]} {forms[i + 1]}") << (64 - FIRST_BITS) | rest) - 2**63


def _key(form: str) -> int:
    """Hash of a form."""
    forms = form.split(" ")
    return _stretch(forms, _sums(forms), 0, len(forms))


class _Segment(NamedTuple):
    start: int
    end: int
    sentence: bool
    #: Goes on in the next line.
    broken: bool


def _segments(text: str) -> Iterator[list[_Segment]]:
    """The segments of each line that may hold elements."""
    line: list[tuple[int, int]] = []
    at, size, begins = 0, len(text), 0
    for m in _BORDER.finditer(text):
        a, b = m.span()
        if a > at:
            line.append((at, a))
        at = b
        if "\n" in m.group():
            if line and (got := _classified(text, line, begins, b)):
                yield got
            line, begins = [], b
    if at < size:
        line.append((at, size))
    if line and (got := _classified(text, line, begins, size)):
        yield got


def _classified(text: str, line: list[tuple[int, int]], begins: int, after: int) -> list[_Segment]:
    """The segments of a line that may hold elements; none where it is a page mark of a scan, a table row or markup."""
    b = line[-1][1]
    if text[begins] in "|!{=<" or b - begins < 120 and scans.is_page_mark(text[begins:b]) or _MARKUP.search(text, begins, b):
        return []
    menu = len(line) > 2 and len(_MENU.findall(text, begins, b)) >= 2
    out = []
    end = len(line) - 1
    for i, (x, y) in enumerate(line):
        c = text[x]
        if not (c.isupper() or c in "[(" or not c.isalnum() and c > "\x7f" and text[x + 1] in " \t"):
            continue
        sentence = (last := text[y - 1]) in ".;!?," and text.count(" ", x, y) >= 3
        if not sentence:
            s = text[x:y]
            if not _LETTERS.search(s) or (last == "." or not menu) and _NOT_ASCII_LETTER.sub("", s).isupper():
                continue
        out.append(_Segment(x, y, sentence, i == end and after < len(text) and _goes_on(text, after)))
    return out


def _goes_on(text: str, at: int) -> bool:
    """What begins here is the middle of a sentence; page marks of scans between are passed over."""
    while at < len(text):
        c = text[at]
        if c.islower() or c in ",.;)":
            return True
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].strip()
        if line and not (len(line) < 120 and scans.is_page_mark(line)):
            return c.isdigit() or c == "-"
        at = end + 1
    return False


def own_elements(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(key, start, end, broken) of every element of its own, sentences of notices among them."""
    for line in _segments(text):
        notice = False
        for s in reversed(line):
            if not s.sentence:
                notice = not s.broken
            elif not notice:
                continue
            yield _key(_form(text[s.start : s.end])), s.start, s.end, s.broken


def _pair(first, words):
    """The bits of first words with a number of words; of numbers or columns."""
    return (first + words * 40503) % (1 << FIRST_BITS)


class Tables:
    """Three bit tables: first two words of what may be template, whole forms, and first words with the number of words; and the
    numbers of words that occur. Without the last two, elements may have any number of words."""

    def __init__(self, firsts: list[int], keys: list[int], pairs: list[int] | None = None, lengths: list[int] | None = None) -> None:
        self.firsts, self.keys, self.pairs = bytearray(1 << FIRST_BITS), bytearray(1 << FIRST_BITS), bytearray(1 << FIRST_BITS)
        for bits, table in ((firsts, self.firsts), (keys, self.keys), (pairs or [], self.pairs)):
            for x in bits:
                table[x] = 1
        self.lengths = None if lengths is None else sorted(n for n in lengths if n > 1)
        self.begins = lru_cache(200_000)(self._begins)

    def _begins(self, words: str) -> Sequence[int]:
        """How many words an element that begins so may have, in order; 1: the first word alone may be one."""
        form = _form(words)
        one = (1,) if self.firsts[_first(form.partition(" ")[0])] else ()
        if " " not in form or not self.firsts[first := _first(form)]:
            return one
        if self.lengths is None:
            return range(1, 1 << 31)
        return (*one, *(n for n in self.lengths if self.pairs[_pair(first, n)]))

    def holds(self, key: int) -> bool:
        """May be template."""
        return bool(self.keys[key & ((1 << FIRST_BITS) - 1)])


def elements(text: str, tables: Tables) -> list[Element]:
    """What may be template, wherever it stands, in order of where it begins."""
    out: list[Element] = []
    holds, begins = tables.holds, tables.begins
    for line in _segments(text):
        notice = False
        for s in reversed(line):
            if not s.sentence:
                notice = not s.broken
            heads = {}
            for m in _HEADS.finditer(text, s.start, s.end):
                # one word alone counts only at the beginning
                if got := begins(m[1] + (m[2] or "")):
                    if got[-1] > 1:
                        heads[m.start()] = got
                    elif m.start() == s.start:
                        if m.end(1) == s.end:
                            heads[s.start] = got
                        elif s.sentence and holds(key := _key(_form(m[1]))):
                            out.append(Element(key, "start", s.start, m.end(1)))
            if heads:
                out += _within(text, s, heads, notice, holds)
    out.sort(key=lambda e: (e.start, -e.end))
    return out


def _within(text: str, s: _Segment, heads: dict[int, Sequence[int]], notice: bool, holds: Callable[[int], bool]) -> Iterator[Element]:
    """What may be template within a segment: from a capital to where another follows, or to the end; heads: where, and of how many words."""
    words = []
    last, most = max(heads), max(got[-1] for got in heads.values())
    left = most + 1
    for m in _WORDS.finditer(text, min(heads), s.end):
        words.append(m.span())
        if m.start() >= last and not (left := left - 1):
            break
    # as many words as the longest may have, and one, follow the last head, so only the segment's last word is the last here
    n = len(words)
    forms = _form(text[words[0][0] : words[-1][1]]).split(" ")
    sums = _sums(forms)
    for i, (x, _) in enumerate(words):
        if (got := heads.get(x)) is None or x > s.start and text[x - 1] not in " \t\n":
            continue
        for length in got:
            if (j := i + length) > n:
                break
            high = j < n and (text[c := words[j][0]].isupper() or text[c] in "[©")
            # the first words of a sentence count against what they are
            start = x == s.start and s.sentence and (j == 1 or j < n and not high)
            if not start and (j < n and not high or length < SHORTEST and (x > s.start or j < n)):
                continue
            y = words[j - 1][1]
            if holds(key := _stretch(forms, sums, i, j)):
                if start:
                    kind = "start"
                elif x == s.start and j == n:
                    kind = "broken" if s.broken else "running" if s.sentence and not notice else "own"
                else:
                    kind = "running" if s.sentence else "inline"
                yield Element(key, kind, x, y)


def without(text: str, keys: set[int], tables: Tables) -> str:
    """The text without the elements of these keys, and without what hung on them: separators and items below a heading."""
    out, at = [], 0
    for e in elements(text, tables):
        if e.key in keys and e.kind != "start" and e.end > at:
            out.append(text[at : max(at, e.start)])
            at = e.end
            if e.kind == "own" and (items := _ITEMS.match(text, at)):
                at = items.end()
    left = "".join(out) + text[at:]
    left = re.sub(r"^[ \t|·»›«→↑/>•\[\]\d🍪]+$", "", left, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$|^[ \t]+", "", left, flags=re.M)).strip()


#: The items of a sidebar under its heading.
_ITEMS = re.compile(r"[ \t]*(?:\n[ \t]*(?:•|[^\x00-\x7f]{1,4})[ \t][^\n]*)+")


def _sources(df: DataFrame, key: str, fields: list[str], url: str) -> DataFrame:
    """_key, host (null: none), page, and the fields."""
    host = F.nullif(F.regexp_extract(F.col(url), r"^[a-z]+://([^/:;?]+)", 1), F.lit(""))
    page = F.xxhash64(F.coalesce(F.regexp_replace(F.col(url), r"[;?#].*$", ""), F.col(key).cast("string")))
    return df.select(F.col(key).alias("_key"), host.alias("host"), page.alias("page"), *fields)


def _place(host: Column, element: Column) -> Column:
    """What a template is known by: its element on a host, or (host null) on all of them."""
    return F.xxhash64(F.coalesce(host, F.lit("")), element)


def candidates(src: DataFrame, fields: list[str]) -> DataFrame:
    """place, element, words, pages: elements that recur on pages of a host, and (place of no host) over hosts; written out."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in fields:
                for h, p, t in zip(pdf["host"], pdf["page"], pdf[name], strict=True):
                    if t:
                        rows += [(h, p, *e) for e in {(k, t.count(" ", a, b) + 1, broken) for k, a, b, broken in own_elements(t)}]
            yield pd.DataFrame(rows, columns=["host", "page", "element", "words", "broken"])

    # one row for each page first, so that a hot element is spread by page; then counts, partly summed where the rows lie
    once = src.mapInPandas(scan, "host string, page long, element long, words int, broken boolean").distinct()
    pages = [F.count(F.when(~F.col("broken"), 1)).alias("pages"), F.count(F.when(F.col("broken"), 1)).alias("breaks")]
    per_host = cut(once.groupBy("host", "element", "words").agg(*pages))
    kept = F.col("pages") > F.col("breaks")
    own = per_host.where(F.col("host").isNotNull() & (F.col("pages") >= PAGES) & kept).select(_place(F.col("host"), F.col("element")).alias("place"), "element", "words", "pages")
    hosts = F.count(F.when(F.col("pages") > 0, F.col("host"))).alias("hosts")
    wide = per_host.groupBy("element", "words").agg(F.sum("pages").alias("pages"), F.sum("breaks").alias("breaks"), hosts).where((F.col("pages") >= WIDE_PAGES) & (F.col("hosts") >= WIDE_HOSTS) & kept)
    return cut(own.unionByName(wide.select(_place(F.lit(None), F.col("element")).alias("place"), "element", "words", "pages")))


def _tables(found: DataFrame) -> tuple[list[int], ...]:
    """Set bits of the three tables, at most 2 ** FIRST_BITS numbers each; and the numbers of words that occur."""
    low = F.col("element").bitwiseAND(F.lit((1 << FIRST_BITS) - 1))
    high = F.shiftright("element", 64 - FIRST_BITS) + F.lit(1 << (FIRST_BITS - 1))
    return tuple([r[0] for r in found.select(b.cast("int")).distinct().collect()] for b in (high, low, _pair(high, F.col("words").cast("long")), F.col("words")))


def page_elements(src: DataFrame, fields: list[str], bits: tuple[list[int], ...], texts: bool) -> DataFrame:
    """_key, field_name, host, text (null unless asked for), found (element, kind): each value with anything that may be template; written out, as it is used twice."""
    held, call = src.sparkSession.sparkContext.broadcast(bits), worker.token()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = worker.once(call, lambda: Tables(*held.value))
        for pdf in batches:
            rows = []
            for name in fields:
                for k, h, t in zip(pdf["_key"], pdf["host"], pdf[name], strict=True):
                    if t and (got := elements(t, tables)):
                        found = {}
                        for e in got:
                            found.setdefault((e.key, e.kind), None)
                        rows.append((k, name, h, t if texts else None, [{"element": e, "kind": kind} for e, kind in found]))
            yield pd.DataFrame(rows, columns=["_key", "field_name", "host", "text", "found"])

    kind = src.schema["_key"].dataType.simpleString()
    return cut(src.mapInPandas(scan, f"_key {kind}, field_name string, host string, text string, found array<struct<element: long, kind: string>>"))


def _template_hits(df: DataFrame, key: str, fields: list[str], url: str, texts: bool) -> tuple[DataFrame, DataFrame, tuple[list[int], ...]]:
    """The values as page_elements gives them; _key, field_name, element of what is template; the bits."""
    src = _sources(df, key, fields, url)
    may = candidates(src, fields)
    bits = _tables(may)
    values = page_elements(src, fields, bits, texts)
    rows = values.select("_key", "field_name", "host", F.explode("found").alias("e")).select("_key", "field_name", "host", "e.*")
    places = F.array_distinct(F.array(_place(F.col("host"), F.col("element")), _place(F.lit(None), F.col("element"))))
    hits = rows.select("_key", "field_name", "element", "kind", F.explode(places).alias("place"))
    # for each place: values where it is an element of its own, and where the same words run on
    running = F.col("kind").isin("running", "broken", "start")
    counts = hits.groupBy("place").agg(F.count(F.when(running, 1)).alias("against"), F.count("*").alias("n"))
    kept = may.join(counts, "place").where(F.col("against") < F.col("pages")).select("place", "n")
    hits = hits.where(F.col("kind") != "start")
    total = values.agg(F.sum(F.size("found")).alias("n")).first()["n"] or 0
    hot = F.col("n") >= F.lit(max(1.0, total * HOT_SHARE))
    few = F.broadcast(kept.where(hot).select("place"))  # at most 2 / HOT_SHARE places, as every hit has two
    got = hits.join(few, "place", "left_semi").unionByName(hits.join(kept.where(~hot).select("place"), "place", "left_semi"))
    return values, got.select("_key", "field_name", "element").distinct(), bits


def template_elements(df: DataFrame, key: str, fields: list[str], url: str) -> DataFrame:
    """key, field_name, element: the elements that are template."""
    return _template_hits(df, key, fields, url, False)[1].withColumnRenamed("_key", key)


def main_text(df: DataFrame, key: str, fields: list[str], url: str) -> DataFrame:
    """key, field_name, main_text, n_elements: each value that held furniture, without it.

    Only texts with anything that may be template move, once, to the keys of their own templates.
    """
    values, found, bits = _template_hits(df, key, fields, url, True)
    keys = found.groupBy("_key", "field_name").agg(F.collect_list("element").alias("keys"))  # of one text
    held, call = df.sparkSession.sparkContext.broadcast(bits), worker.token()

    @F.pandas_udf("string")
    def strip(text: pd.Series, keys: pd.Series) -> pd.Series:
        tables = worker.once(call, lambda: Tables(*held.value))
        return pd.Series([without(t, set(k), tables) for t, k in zip(text, keys, strict=True)])

    joined = keys.join(values.select("_key", "field_name", "text"), ["_key", "field_name"])
    return joined.select(F.col("_key").alias(key), "field_name", strip("text", "keys").alias("main_text"), F.size("keys").alias("n_elements")).distinct()
