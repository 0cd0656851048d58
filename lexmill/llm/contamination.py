"""Evaluation texts inside training documents.

The normalised words of all test items make one generalised suffix automaton. Each document's words are streamed
through it; wherever an item's own match ends, be it that others go on, the matched words are credited to it (matches of at
least ``SEED`` words, however many items hold them). Items credited with enough words are then aligned exactly
with the document: runs of ``RUN`` shared words, chained in order, and single words between runs that lie close
together. An item leaks when at least half of its passage's words are found so, or all but a few changed words of its
query and of its answer.

What is cut out of a leaking document are the runs of shared words, each with the few changed words within it, that have
``CUT_WORDS`` words or ``CUT_SHARE`` of their part's words (all runs where none has); text that stands between runs is kept.

The test set is brought to the workers in blocks of ``BLOCK_WORDS`` words, so that the automaton of one block fits a worker
whatever the size of the test set; each block is one scan of the documents, and a worker builds an automaton once for all its tasks.

Defined results: null documents and null parts of items leak nothing; an item of an empty passage can leak only by query
and answer; passages under ``RUN`` words never match; repeated documents each give their own rows (cleaned, one); items repeated under
other ids each give their own rows; empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import worker

SEED, RUN = 4, 3
PASSAGE_SHARE, WHOLE_SHARE = 0.5, 0.8
#: Credited share at which an item is aligned: well below what a leak needs.
CREDIT_PASSAGE, CREDIT_WHOLE = 0.3, 0.5
#: Words of the items held by one automaton; more are worked through in blocks.
BLOCK_WORDS = 200_000
#: Words, or share of its part's words, from which a run of shared words is cut out.
CUT_WORDS, CUT_SHARE = 8, 0.25

#: ASCII letters without case and figures as they are, all else a space.
_LETTERS = bytes(c if chr(c).isalnum() else 32 for c in bytes(range(128)).lower()).ljust(256)
_RAW = re.compile(r"[^\W_]+")
_SIGNS = re.compile(r"[^\w\x00-\x7f]+")


def words(text: str) -> list[str]:
    """Words without case, accents, punctuation and spacing."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").translate(_LETTERS).decode("ascii").split()


@lru_cache(200_000)
def _words_of(token: str) -> tuple[str, ...]:
    return tuple(words(token))


def raw_words(text: str) -> list[str]:
    """The words of words_at alone: signs outside ASCII are borders."""
    return words(_SIGNS.sub(" ", text))


def _runs(tokens: list, n: int) -> Iterator[tuple]:
    """The runs of n words."""
    return zip(*(tokens[k:] for k in range(n)), strict=False)


def words_at(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words and where they stand in the text."""
    out, at = [], []
    for m in _RAW.finditer(text):
        for w in _words_of(m.group()):
            out.append(w)
            at.append(m.span())
    return out, at


class Part(NamedTuple):
    item_id: int
    kind: str
    words: list[str]


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the texts that each state's strings occur in."""

    def __init__(self, texts: list[list[str]]) -> None:
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = array("i", [-1]), array("i", [0])
        ends: list[set[int]] = [set()]
        for number, text in enumerate(texts):
            last = 0
            for w in text:
                last = self._add(last, self.ids.setdefault(w, len(self.ids)), ends)
                ends[last].add(number)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.len[self.link[v]] >= SEED:
                ends[self.link[v]] |= ends[v]
        self.texts = [tuple(sorted(e)) for e in ends]
        numbers = [[self.ids[w] for w in text] for text in texts]
        self.seeds = {g: self._after(g) for text in numbers for g in _runs(text, SEED)}
        self.ends: dict[tuple[int, int], tuple[tuple[int, int], ...]] = {}
        self.kept = 0

    def _after(self, run: tuple[int, ...]) -> int:
        """The state after a run of words of the texts."""
        v = 0
        for w in run:
            v = self.next[v][w]
        return v

    def _state(self, length: int, ends: list[set[int]]) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        ends.append(set())
        return len(self.len) - 1

    def _clone(self, p: int, q: int, w: int, ends: list[set[int]]) -> int:
        c = self._state(self.len[p] + 1, ends)
        self.next[c] = dict(self.next[q])
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _add(self, last: int, w: int, ends: list[set[int]]) -> int:
        q = self.next[last].get(w)
        if q is not None:  # known from an earlier text
            return q if self.len[last] + 1 == self.len[q] else self._clone(last, q, w, ends)
        v = self._state(self.len[last] + 1, ends)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = v
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[v] = q if self.len[p] + 1 == self.len[q] else self._clone(p, q, w, ends)
        return v

    def matches(self, tokens: list[str]) -> Iterator[tuple[int, int]]:
        """(state, length) wherever the longest match stops growing, from SEED words on."""
        get, nxt, link, length = self.ids.get, self.next, self.link, self.len
        v = n = 0
        for t in tokens:
            w = get(t)
            if w is None:
                if n >= SEED:
                    yield v, n
                v = n = 0
                continue
            to = nxt[v].get(w)
            if to is None:
                if n >= SEED:
                    yield v, n
                while to is None and v:
                    v = link[v]
                    to = nxt[v].get(w)
                n = length[v]
                if to is None:
                    n = 0
                    continue
            v, n = to, n + 1
        if n >= SEED:
            yield v, n

    def _holders(self, v: int) -> dict[int, int]:
        """Texts that hold the string at a state (0), or an end of it of SEED words or more (its length)."""
        out = dict.fromkeys(self.texts[v], 0)
        u = self.link[v]
        while self.len[u] >= SEED:
            for x in self.texts[u]:
                out.setdefault(x, self.len[u])
            u = self.link[u]
        return out

    def _ended(self, was: int, v: int, fell: int) -> tuple[tuple[int, int], ...]:
        """Texts whose own match ends between two states, and its length, 0 for that of the longest; fell: length at v where the longest match didn't just grow."""
        got = self.ends.get((was, v))
        if got is None:
            then = {} if not v or 0 < fell < SEED else self._holders(v)
            if fell:
                got = tuple((x, k) for x, k in self._holders(was).items() if not k or (then.get(x, -1) or fell) != k + 1)
            else:
                got = tuple((x, k) for x, k in self._holders(was).items() if then.get(x, -1) != (k and k + 1))
            self.kept += len(got) + 1
            if self.kept > 2_000_000:
                self.ends.clear()
                self.kept = len(got) + 1
            self.ends[was, v] = got
        return got

    def own_matches(self, tokens: list[str]) -> dict[int, int]:
        """For each text, the words of its own matches: each is counted where this text's match ends, whatever goes on in others.

        A match of SEED words or more is where runs of SEED words of the texts follow on one another: the first of them gives the state,
        and only where they follow is it walked on.
        """
        nxt, link, length, seeds = self.next, self.link, self.len, self.seeds
        numbers = [*map(self.ids.get, tokens)]
        got: dict[int, int] = {}
        v = n = 0
        after = -1
        for j in compress(count(), map(seeds.__contains__, _runs(numbers, SEED))):
            was, had = v, n
            if j != after:
                v, n = seeds[tuple(numbers[j : j + SEED])], SEED
                ended = self._ended(was, 0, 0) if was else ()
            else:
                w = numbers[j + SEED - 1]
                if (to := nxt[v].get(w)) is not None:
                    v, n = to, n + 1
                else:
                    while to is None:  # an end of SEED - 1 words goes on
                        v = link[v]
                        to = nxt[v].get(w)
                    v, n = to, length[v] + 1
                ended = self._ended(was, v, 0 if n == had + 1 else n)
            for x, k in ended:
                got[x] = got.get(x, 0) + (k or had)
            after = j + 1
        if v:
            for x, k in self._ended(v, 0, 0):
                got[x] = got.get(x, 0) + (k or n)
        return got


class Index:
    """The automaton with its items."""

    def __init__(self, rows: list[tuple[int, str | None, str | None, str | None]]) -> None:
        self.parts = [Part(i, kind, words(text or "")) for i, *texts in rows for kind, text in zip(("passage", "query", "answer"), texts, strict=True)]
        self.automaton = SuffixAutomaton([p.words for p in self.parts])
        self.by_item = {p.item_id: {} for p in self.parts}
        for p in self.parts:
            self.by_item[p.item_id][p.kind] = p
        self.need = [len(p.words) * (CREDIT_PASSAGE if p.kind == "passage" else CREDIT_WHOLE) for p in self.parts]

    def candidates(self, tokens: list[str]) -> set[int]:
        """Items with enough credited words."""
        return {self.parts[x].item_id for x, n in self.automaton.own_matches(tokens).items() if n >= self.need[x]}


def runs_at(doc: list[str]) -> dict[tuple[str, ...], list[int]]:
    """Where the runs of RUN words of a document stand."""
    out: dict[tuple[str, ...], list[int]] = {}
    for j, g in enumerate(_runs(doc, RUN)):
        out.setdefault(g, []).append(j)
    return out


def chain(part: list[str], places: dict[tuple[str, ...], list[int]]) -> list[tuple[int, int]]:
    """The longest chain of shared runs of RUN words that rises in both, as places in part and document.

    Longest common subsequence by bit vectors: one step for each place of the document that begins a run of the part, of as
    many machine words as the part has words by 64, so a phrase repeated in both costs no more than its places in the document.
    """
    masks: dict[tuple[str, ...], int] = {}
    m = 0
    for m, g in enumerate(_runs(part, RUN), 1):
        if g in places:
            masks[g] = masks.get(g, 0) | 1 << (m - 1)
    rows = sorted((j, bits) for g, bits in masks.items() for j in places[g])
    full = v = (1 << m) - 1
    seen = []
    for _, bits in rows:
        u = v & bits
        v = (v + u | v - u) & full
        seen.append(v)
    # back from the end: a zero bit is where the longest chain grows
    out, low, r = [], full, len(rows) - 1
    size = len(part) and m - (v & full).bit_count()
    while r >= 0 and size:
        if r and (low & ~seen[r - 1]).bit_count() == size:
            r -= 1
            continue
        p = (low & ~seen[r]).bit_length() - 1
        out.append((p, rows[r][0]))
        low, size, r = (1 << p) - 1, size - 1, r - 1
    return out[::-1]


class Aligned(NamedTuple):
    share: float
    longest: int
    #: Runs with what is changed within them: first and last word in the document, shared words.
    runs: list[tuple[int, int, int]]


def align(part: list[str], doc: list[str], places: dict[tuple[str, ...], list[int]]) -> Aligned:
    """Share of the part's words found in the document in order, longest run, and the runs."""
    found = bytearray(len(part))
    run = best = 0
    last: tuple[int, int] | None = None
    runs: list[list[int]] = []
    for k, j in chain(part, places):
        run = run + 1 if last and (k, j) == (last[0] + 1, last[1] + 1) else RUN
        best = max(best, run)
        near = False
        if last:
            a, b, c, d = last[0] + RUN, k, last[1] + RUN, j
            near = b - a <= 12 and d - c <= 16
            if 0 < b - a <= 12 and 0 < d - c <= 16:  # close together: single words kept between changed ones
                at = c
                for p in range(a, b):
                    for q in range(at, d):
                        if doc[q] == part[p]:
                            found[p], at = 1, q + 1
                            break
        # a run that begins within the one before, out of step with it, uses no word of the document twice
        used = max(0, last[1] + RUN - j) if last and k - last[0] != j - last[1] else 0
        found[k + used : k + RUN] = b"\x01" * (RUN - used)
        if near:
            runs[-1][1], runs[-1][3] = j + RUN - 1, k + RUN
        else:
            runs.append([j, j + RUN - 1, k, k + RUN])
        last = (k, j)
    return Aligned(sum(found) / max(len(part), 1), best, [(a, b, sum(found[x:y])) for a, b, x, y in runs])


class Leak(NamedTuple):
    item_id: int
    part: str
    share: float
    longest_run: int
    start_char: int
    end_char: int
    #: What is cut out: where runs begin and end.
    cuts: list[tuple[int, int]]


def _leak(item: int, part: Part, found: Aligned, at: list[tuple[int, int]]) -> Leak:
    least = min(CUT_WORDS, CUT_SHARE * len(part.words))
    cuts = [(at[a][0], at[b][1]) for a, b, n in found.runs if n >= least] or [(at[a][0], at[b][1]) for a, b, _ in found.runs]
    return Leak(item, part.kind, found.share, found.longest, at[found.runs[0][0]][0], at[found.runs[-1][1]][1], cuts)


def leaks(index: Index, text: str) -> list[Leak]:
    """What a document leaks."""
    items = index.candidates(words(text))
    if not items:
        return []
    doc = raw_words(text)
    have = set(doc).__contains__
    # no more of a part can be found in order than stands in the document at all
    may = lambda p, share: sum(map(have, p.words)) / max(len(p.words), 1) >= share
    passages = {i for i in items if may(index.by_item[i]["passage"], PASSAGE_SHARE)}
    wholes = {i for i in items if may((part := index.by_item[i])["query"], WHOLE_SHARE) and may(part["answer"], WHOLE_SHARE)}
    if not passages and not wholes:
        return []
    places = runs_at(doc)
    got: list[tuple[int, Part, Aligned]] = []
    for i in sorted(passages | wholes):
        part = index.by_item[i]
        if i in passages and (found := align(part["passage"].words, doc, places)).share >= PASSAGE_SHARE:
            got.append((i, part["passage"], found))
        if i in wholes and (query := align(part["query"].words, doc, places)).share >= WHOLE_SHARE:
            answer = align(part["answer"].words, doc, places)
            if answer.share >= WHOLE_SHARE:
                got += [(i, part["query"], query), (i, part["answer"], answer)]
    at = words_at(text)[1] if got else []  # few documents leak
    return [_leak(i, part, found, at) for i, part, found in got]


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without what is cut out."""
    out, at = [], 0
    for a, b in sorted(cuts):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return "".join(out) + text[at:]


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks: the test set is a stated query set, brought to the workers block by block."""
    block: list[tuple] = []
    given, size = False, 0
    for r in items.select("item_id", "passage", "query", "answer").toLocalIterator():
        more = sum(len(x) for x in r[1:] if x) // 6 + 1  # a word takes some six characters
        if block and size + more > BLOCK_WORDS:
            yield block
            block, size, given = [], 0, True
        block.append(tuple(r))
        size += more
    if block or not given:
        yield block


FOUND = "item_id: bigint, part: string, share: double, longest_run: int, start_char: int, end_char: int, cuts: array<struct<start: int, end: int>>"


def _leaking(documents: DataFrame, items: DataFrame, texts: bool) -> DataFrame:
    """doc_id, text (null unless asked for), found: a row for each document that leaks and block of items."""
    sc = documents.sparkSession.sparkContext
    out: DataFrame | None = None
    for block in _blocks(items):
        held, name = sc.broadcast(block), worker.token()

        def scan(batches: Iterator[pd.DataFrame], held=held, name=name) -> Iterator[pd.DataFrame]:
            index = worker.once(name, lambda: Index(held.value))
            for pdf in batches:
                rows = []
                for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                    if t and (got := leaks(index, t)):
                        rows.append((d, t if texts else None, [x._asdict() | {"cuts": [{"start": a, "end": b} for a, b in x.cuts]} for x in got]))
                yield pd.DataFrame(rows, columns=["doc_id", "text", "found"])

        got = documents.where(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(scan, f"doc_id bigint, text string, found array<struct<{FOUND}>>")
        out = got if out is None else out.unionByName(got)
    return out


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, part, share, longest_run, start_char, end_char (from the first to the last shared word)."""
    rows = _leaking(documents, items, False).select("doc_id", F.explode("found").alias("f"))
    return rows.select("doc_id", *[f"f.{c}" for c in ("item_id", "part", "share", "longest_run", "start_char", "end_char")])


def remove_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_items, text: each document that leaks, without the runs it shares with test items.

    Texts that leak nothing never leave their place; those that do are brought together with what other blocks found.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([without(t, [(x["start"], x["end"]) for x in c]) for t, c in zip(text, cuts, strict=True)])

    whole = _leaking(documents, items, True).groupBy("doc_id", "text").agg(F.flatten(F.collect_list("found")).alias("found"))  # at most the items of the test set
    cuts = F.flatten("found.cuts")
    return whole.select("doc_id", F.size(F.array_distinct("found.item_id")).alias("n_items"), cut("text", cuts).alias("text"))
