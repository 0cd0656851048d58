"""Legal texts as trees and chunks with exact offsets.

Reading a norm is a walk over marks from left to right with a stack of what is open; that can't be said in SQL, so it is
one Python pass over each document inside ``mapInPandas``. Everything around it (units, paths, checks) is expressions.
Offsets are code points of the text as given: views used for finding marks never change its length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.ordering import as_of

#: Levels of headings; a heading closes those of its level and deeper.
LEVELS = {"norma": 0, "parte": 1, "livro": 2, "titulo": 3, "capitulo": 4, "secao": 5, "subsecao": 6}
#: Ranks of what stands below an article.
RANKS = {"paragrafo": 1, "inciso": 2, "alinea": 3, "item": 4}
#: Words of norms, and letters that scanning puts for others within them (same length).
_NORM = "LEI COMPLEMENTAR|LEI|DECRETO-LEI|DECRETO|PORTARIA|RESOLUÇÃO|RESOLUCAO|INSTRUÇÃO|INSTRUCAO|EMENDA CONSTITUCIONAL|CONSTITUIÇÃO|CONSTITUICAO"
_SCANNED = [("Artig0", "Artigo"), ("Art1go", "Artigo"), ("Art1g0", "Artigo"), ("Paragraf0", "Paragrafo"), ("unic0", "unico"), ("CAPITUL0", "CAPITULO"), ("CAPÍTUL0", "CAPÍTULO"), ("TITUL0", "TITULO"), ("TÍTUL0", "TÍTULO")]
_ROMAN = r"(?:C|XC|L?X{1,3}|XL|L)?(?:IX|IV|V?I{1,3}|V)|(?:C|XC|XL|L?X{1,3}|L)"
_NUMBER = r"(?:\d{1,3}(?:\.\d{3})+|\d+)[ºo°]?(?:-[A-Z]{1,3})?"
_HEADS = [("parte", "PARTE"), ("livro", "LIVRO"), ("titulo", "T ?[IÍ] ?T ?U ?L ?O"), ("capitulo", "C ?A ?P ?[IÍ] ?T ?U ?L ?O"), ("secao", "SE[CÇ][AÃ]O"), ("subsecao", "SUBSE[CÇ][AÃ]O")]
_MARK = re.compile(
    r"^[ \t]*(?:"
    + rf"(?P<norma>(?:{_NORM})\b(?=[^\n]*\d)[^\n]*)"
    + "".join(rf"|(?P<{k}>{p}\b[^\n]*)" for k, p in _HEADS)
    + r"|(?P<anexo>ANEXO\b(?: +(?:[IVXLC]+|[ÚU]NICO|[A-Z]))?)(?P<anexo_title>[^\n]*)"
    + rf"|(?P<artigo>Art(?:igo)?\.?[ \t]*\n?(?P<number>{_NUMBER}))(?=[\s.–—:-]|$)"
    + r"|(?P<paragrafo>§[ \t]*\n?(?:\d+[ºo°]?(?:-[A-Z])?|[uú]nico)|Par[aá]grafo[ \t]+(?:[uú]nico|\d+[ºo°]?))"
    + rf"|(?P<inciso>(?-i:{_ROMAN})(?:-[A-Z]{{1,3}})?)[ \t]*(?:\)|\n?[.–—-](?=\s|$))"
    + r"|(?P<alinea>[a-z]{1,3})[ \t]*\)"
    + r"|(?P<item>\d{1,3})[ \t]*(?:\)|[.–—-](?=\s|$))"
    + r")",
    re.M | re.I,
)
#: In text that lost its line ends a mark may follow the end of a sentence.
_FLAT = re.compile(rf"(?<=[.;:”\"])[ \t]+(?=(?:Art\.[ \t]*{_NUMBER}[ \t]+[A-ZÀ-Ý]|§[ \t]*(?:\d+[ºo°]|[uú]nico)[ \t]+[A-ZÀ-Ý]|(?:{_ROMAN})[ \t]+[–—-][ \t]))")
#: What follows or precedes an article that is only cited.
_CITED = re.compile(r"^[ \t]+(?:d[aoe]s?)[ \t]+(?:CF|C\.F|Constitui|Lei|C[oó]digo|CPC|CC\b|CLT|STF|STJ|TCU|TCESP|TJSP)", re.I)
_CITING = re.compile(r"\b(?:[oa]s?|n[oa]s?|d[oae]s?|em|ao|à|conforme|segundo|previsto|disposto|artigos?|arts?\.?|inciso|c/c|e)[ \t]*$", re.I)
_CHANGES = re.compile(r"passa(?:m)? a vigorar|fica(?:m)? (?:acrescid|acrescentad|inserid|inclu[ií]d)|acrescenta|inclui-se|reda[cç][aã]o", re.I)
#: What a changing act does.
OPERATIONS = {"acrescimo": r"acrescid|acrescenta|inserid|inclu[ií]d|inclui", "revogacao": r"revoga", "renumeracao": r"renumerad", "supressao": r"suprimid", "redacao": r"passa(?:m)? a vigorar|reda[cç][aã]o|alterad"}


@dataclass
class Node:
    kind: str
    ref: str | None
    start: int
    end: int
    node_id: str = ""
    parent: Node | None = None
    path: list[str] = field(default_factory=list)
    annex: Node | None = None

    @property
    def annex_path(self) -> list[str]:
        return self.annex.path if self.annex else []


def view(text: str) -> str:
    """The text with scanned letters put right where marks need them; its length stays."""
    for a, b in _SCANNED:
        if a.lower() in text.lower():
            text = re.sub(rf"\b{a}\b", b, text, flags=re.I)
    return text


def slug_ref(ref: str) -> str:
    """A reference as part of an id."""
    r = re.sub(r"^(?:§|Par[aá]grafo)\s*", "", ref, flags=re.I)
    return re.sub(r"[º°.\s]|(?<=\d)o\b", "", r).lower() if not re.fullmatch(r"[IVXLC]+(?:-[A-Z]+)?", r) else r


def quoted(text: str) -> list[tuple[int, int]]:
    """Spans between typographic quotes, which hold the wording a changing act gives to another one."""
    out, start = [], None
    for i, c in enumerate(text):
        if c == "“" and start is None:
            start = i
        elif c == "”" and start is not None:
            out.append((start, i))
            start = None
    if start is not None and _CHANGES.search(text[max(0, start - 300) : start]):
        out.append((start, len(text)))
    return out


def _inside(spans: list[tuple[int, int]], starts: list[int], at: int) -> bool:
    k = bisect_right(starts, at) - 1
    return k >= 0 and spans[k][0] <= at < spans[k][1]


#: Fixed value: characters before an article in which a change announced counts.
LOOK_BACK = 500
_ARTICLE = re.compile(r"\bArt(?:igo)?\.?\s*\d", re.I)


def _real_article(text: str, m: re.Match) -> bool:
    """Whether a mark begins an article or cites one."""
    word = m["artigo"]
    if word[0] == "a" or _CITED.match(text[m.end() : m.end() + 60]):
        return False
    # within the wording that a changing act gives in quotes, as far as it looks back
    back = text[max(0, m.start() - LOOK_BACK) : m.start()]
    if (change := _CHANGES.search(back)) and not _ARTICLE.search(given := back[change.end() :]) and (given.count("“") > given.count("”") or given.count('"') % 2):
        return False
    before = text[max(0, m.start() - 40) : m.start()].rstrip(" \t")
    if not before or before[-1] != "\n":
        return not before or before[-1] in ".;:”\"" or not _CITING.search(before)
    line = before[:-1].rsplit("\n", 1)[-1]
    return not _CITING.search(line)


def marks(text: str) -> list[re.Match]:
    """All marks in order, in text with and without line ends."""
    seen = view(text)
    if len(seen) > 400 and seen.count("\n") * 400 < len(seen):
        seen = _FLAT.sub(lambda m: "\n" + " " * (len(m.group()) - 1) if len(m.group()) > 1 else "\n", seen)
    return list(_MARK.finditer(seen))


def _title_after(text: str, at: int) -> str | None:
    """A line in capitals of up to 90 characters among the next two is a heading's title."""
    for line in text[at : at + 400].split("\n")[1:3]:
        t = " ".join(line.split())
        if t:
            return t if len(t) <= 90 and t == t.upper() and re.search(r"[A-ZÀ-Ý]{2}", t) and not _MARK.match(t) and not re.match(r"§|\d", t) else None
    return None


def parse(text: str, doc: str = "") -> list[Node]:
    """The nodes of a norm in order of their start. Articles hold what stands below them, headings only themselves; a
    node below an article ends where the next mark begins."""
    root = Node("norma", None, 0, len(text), f"{doc}/norma")
    nodes, heads, low = [root], [], []
    article: Node | None = None
    annex: Node | None = None
    spans = quoted(text)
    starts = [a for a, _ in spans]
    n_heads = 0
    used: set[str] = set()

    def close(at: int, everything: bool) -> None:
        nonlocal article
        if low:
            low[-1].end = min(low[-1].end, at)
        if everything:
            low.clear()
            if article:
                article.end = at
            article = None

    def named(node: Node, name: str) -> None:
        base, k = name, 2
        while name in used:
            name, k = f"{base}~{k}", k + 1
        used.add(name)
        node.node_id = name
        nodes.append(node)

    for m in marks(text):
        kind = m.lastgroup if m.lastgroup not in ("number", "anexo_title") else ("artigo" if m["artigo"] else "anexo")
        at = m.start(kind)
        if _inside(spans, starts, at) or (kind == "norma" and (at > 0 and (article or not m["norma"].isupper()))):
            continue
        if kind in LEVELS:
            if kind == "norma":
                continue
            line = m[kind].rstrip()
            if not (line.split()[0].isupper() and len(line) <= 200):
                continue
            close(at, True)
            if annex:
                annex.end, annex = at, None
            while heads and LEVELS[heads[-1].kind] >= LEVELS[kind]:
                heads.pop()
            n_heads += 1
            parent = heads[-1] if heads else root
            ref = " ".join(line.split())
            if title := _title_after(text, at + len(line)):
                ref = f"{ref} — {title}"
            node = Node(kind, ref, at, at + len(line), parent=parent, path=[h.ref for h in heads] + [ref])
            named(node, f"{doc}/header:{n_heads}@{at}")
            heads.append(node)
        elif kind == "anexo":
            if m["anexo"] != m["anexo"].upper():
                continue
            close(at, True)
            if annex:
                annex.end = at
            heads.clear()
            annex = Node("anexo", " ".join(m["anexo"].split()), at, len(text), parent=root, path=[" ".join(m["anexo"].split())])
            annex.annex = annex
            named(annex, f"{doc}/anexo:{slug_ref(annex.ref[5:].strip()).lower() or 'único'}@{at}")
        elif kind == "artigo":
            if not _real_article(view(text), m):
                continue
            close(at, True)
            ref = m["number"].rstrip(".")
            parent = annex or (heads[-1] if heads else root)
            article = Node("artigo", ref, at, len(text) if not annex else annex.end, parent=parent, path=[*parent.path, f"Art. {ref}"], annex=annex)
            named(article, f"{doc}/artigo:{slug_ref(ref)}@{at}")
        elif article:
            if kind == "item" and not (low and low[-1].kind in ("alinea", "item")):
                continue
            if kind == "alinea" and not low:
                continue
            close(at, False)
            while low and RANKS[low[-1].kind] >= RANKS[kind]:
                low.pop()
            ref = " ".join(m[kind].split())
            parent = low[-1] if low else article
            node = Node(kind, ref, at, article.end, parent=parent, path=[*article.path, ref], annex=annex)
            named(node, f"{parent.node_id}/{kind}:{slug_ref(ref)}")
            low.append(node)
    close(len(text), True)
    for n in nodes:  # no span ends in white space
        n.end = n.start + len(text[n.start : n.end].rstrip()) if n is not root else n.end
    # children were opened with their article's end as it was then
    for n in nodes:
        up = n.parent
        while up is not None and up.kind != "artigo":
            up = up.parent
        if up is not None and n.end > up.end:
            n.end = up.end
    return nodes


TREE = "doc_id string, node_id string, parent_id string, kind string, ref string, source_start int, source_end int, source_text string, path array<string>, anexo_ref string, anexo_path array<string>"


def tree(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each node of each document; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["_key"], pdf["_text"], strict=True):
                for n in parse(t, str(d)):
                    rows.append((str(d), n.node_id, n.parent.node_id if n.parent else None, n.kind, n.ref, n.start, n.end, t[n.start : n.end], n.path, n.annex.ref if n.annex else None, n.annex_path))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TREE.split(", ")])

    return docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text")).mapInPandas(run, TREE)


def device_id(path: Column, unit: Column) -> Column:
    """Unit and what follows the article in a path; ``caput`` for the article itself."""
    at = F.array_position(F.transform(path, lambda p: p.startswith("Art. ")), True).cast("int")
    rest = F.when(at > 0, F.slice(path, at + 1, F.size(path))).otherwise(F.array().cast("array<string>"))
    return F.concat_ws("/", unit, F.when(F.size(rest) == 0, F.lit("caput")).otherwise(F.array_join(rest, "/")))


def span_faults(nodes: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Nodes whose text isn't the slice of their document that their offsets say."""
    joined = nodes.join(texts, key)
    return joined.where(F.substring("full_text", F.col("source_start") + 1, F.col("source_end") - F.col("source_start")) != F.col("source_text")).select(*nodes.columns)


# --- splitting and chunks ---------------------------------------------------------------------------------------------

_SEPARATORS = ["\n\n", "\n", ". ", "; ", ": ", ", ", " ", ""]
_SHORT = re.compile(r"\b(?:arts?|inc|par|n|nº|fls?|Dr|Sr|Sra|c/c|p|pp|ex)\.(?= )", re.I)


def split_spans(text: str, most: int, overlap: int = 0, length: Callable[[str], int] = len) -> list[tuple[int, int]]:
    """Spans of at most ``most`` by ``length``, cut at the strongest separator that serves, each starting up to
    ``overlap`` before the end of the one before. Dots of abbreviations are no separators."""
    guarded = _SHORT.sub(lambda m: m.group()[:-1] + "", text)

    def atoms(a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        if length(text[a:b]) <= most:
            yield a, b
            return
        sep = _SEPARATORS[level]
        if not sep:
            step = max(1, most)
            while length(text[a : a + step]) > most and step > 1:
                step //= 2
            for i in range(a, b, step):
                yield i, min(b, i + step)
            return
        at = a
        while at < b:
            k = guarded.find(sep, at, b)
            end = b if k < 0 else k + len(sep)
            yield from atoms(at, end, level + 1) if length(text[at:end]) > most else [(at, end)]
            at = end

    pieces = list(atoms(0, len(text), 0))
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(pieces):
        a, b = pieces[i]
        j = i + 1
        while j < len(pieces) and length(text[a : pieces[j][1]]) <= most:
            b = pieces[j][1]
            j += 1
        out.append((a, b))
        if j >= len(pieces):
            break
        k = j
        while k - 1 > i and length(text[pieces[k - 1][0] : b]) <= overlap and length(text[pieces[k - 1][0] : pieces[j][1]]) <= most:
            k -= 1
        i = k
    trimmed = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            trimmed.append((a, b))
    return trimmed


def budget(most: int, overlap: int, dense_max: int, prefix: int) -> tuple[int, int]:
    """Size and overlap left for a chunk's own text beside its prefix and a reserve for its path."""
    size = min(most, dense_max - prefix - min(64, dense_max // 8))
    if size <= 0:
        raise ValueError("the prefix leaves no room")
    return size, min(overlap, size - 1)


def composed(prefix: str, path: list[str], body: str, child: bool, most: int, length: Callable[[str], int] = len, lead: str = "") -> tuple[str, list[str]]:
    """What is embedded of a chunk, and the path told in it: the most general levels of the path are dropped until it fits.

    Chunks below an article carry their path in their own text; a text that begins with its path doesn't get it twice.
    A chunk that is too large even with one level is an error, as what exceeds the model's limit would be cut unseen.
    """

    def made(parts: list[str]) -> str:
        label = " > ".join(parts)
        told = f" [HIERARQUIA: {label}]" if label and not body.startswith(label) and not child else ""
        return f"{prefix}{told}\n{body}"

    parts = list(path)
    while len(parts) > 1 and length(lead + made(parts)) > most:
        parts = parts[1:]
    if length(lead + made(parts)) > most:
        raise ValueError("a chunk is larger than the model takes")
    return made(parts), parts


def short_caput(caput: str, most: int) -> str:
    """An article's head cut in its middle: 30 % from its start and 70 % from its end."""
    if len(caput) <= most:
        return caput
    room = max(0, most - 7)
    return f"{caput[: int(room * 0.3)].rstrip()} […] {caput[len(caput) - (room - int(room * 0.3)) :].lstrip()}" if room else caput[:most]


def operations(text: str) -> list[str]:
    """What a text does to another act, in the order of its words; redacao where it only shows a wording."""
    found = sorted((m.start(), k) for k, p in OPERATIONS.items() if (m := re.search(p, text, re.I)))
    return list(dict.fromkeys(k for _, k in found)) or ["redacao"]


#: Fixed value: how a changing act names what it changes.
_DEVICE = re.compile(rf"(?:(?P<a>arts?\.?|artigos?)|(?P<p>§§?|par[aá]grafos?)|(?P<i>incisos?)|(?P<l>al[ií]neas?))\s+(?P<refs>(?:{_NUMBER}|[uú]nico|[IVXLC]+\b|“?[a-z]”?\b)(?:(?:,\s*|\s+e\s+)(?:{_NUMBER}|[IVXLC]+\b|“?[a-z]”?(?=[\s,.]))\b)*)", re.I)


def amendment(text: str, own: str | None) -> dict | None:
    """Targets and operations of a changing article; None for one that changes nothing. Quoted wording and its own number are no targets."""
    spans = quoted(text)
    bare = "".join(c if not any(a <= i < b for a, b in spans) else " " for i, c in enumerate(text)) if spans else text
    verb = re.search(r"passa(?:m)? a vigorar|fica(?:m)? (?:acrescid|acrescentad|inserid|inclu[ií]d|revogad|alterad|renumerad|suprimid)|acrescenta(?:m)?-se|revoga(?:m)?-se|reda[cç][aã]o", bare, re.I)
    if not verb:
        return None
    devices = []
    for m in _DEVICE.finditer(bare):
        kind = "artigo" if m["a"] else "paragrafo" if m["p"] else "inciso" if m["i"] else "alinea"
        for ref in re.split(r",\s*|\s+e\s+", m["refs"]):
            r = ref.strip(" “”.")
            if r and not (kind == "artigo" and own and slug_ref(r) == slug_ref(own) and m.start() < 3):
                devices.append({"kind": kind, "ref": r})
    seen = [d for i, d in enumerate(devices) if d not in devices[:i]]
    return {"operations": operations(bare), "devices": seen, "articles": [d["ref"] for d in seen if d["kind"] == "artigo"]}


#: How a record of a court, its sections, súmulas and themes begin.
_COURT = re.compile(r"^[ \t]*TRIBUNAL:[ \t]*.+$", re.M | re.I)
_SECTION = re.compile(r"^[ \t]*(EMENTA|TESE|DECIS[ÃA]O|INTEIRO TEOR|RELAT[ÓO]RIO|VOTO|DISPOSITIVO)[ \t]*:?[ \t]*$", re.M | re.I)
_SUMULA = re.compile(r"^[ \t]*(S[uú]mula(?:\s+Vinculante)?\s+n?[ºo°.]*\s*\d+|Enunciado\s+n?[ºo°.]*\s*\d+)\b", re.M | re.I)
_THEME = re.compile(r"^[ \t]*(Tema\s+n?[ºo°.]*\s*\d+)\b", re.M | re.I)


def _cut(text: str, found: list[re.Match], kind: str, ref: Callable[[re.Match], str | None], lead: str) -> list[tuple[str, str | None, int, int]]:
    """Units that begin at marks; what stands before the first is a unit of its own."""
    out = []
    if found and text[: found[0].start()].strip():
        out.append((lead, None, 0, found[0].start()))
    for i, m in enumerate(found):
        end = found[i + 1].start() if i + 1 < len(found) else len(text)
        if text[m.start() : end].strip():
            out.append((kind, ref(m), m.start(), end))
    return out


def units(text: str, normative: bool = True) -> list[tuple[str, str | None, int, int]]:
    """kind, ref, start, end of the units of a text: decisions, else articles and annexes, else súmulas, else themes, else the whole."""
    if found := list(_COURT.finditer(text)):
        name = lambda m: (re.search(r"^[ \t]*(?:PROCESSO|S[ÚU]MULA)[^:\n]*:[ \t]*(.+)$", text[m.start() : m.start() + 2000], re.M | re.I) or [None, None])[1]
        return _cut(text, found, "jurisprudencia", name, "generic")
    if normative:
        if arts := [(n.kind, n.ref, n.start, n.end) for n in parse(text) if n.kind in ("artigo", "anexo")]:
            return arts
        for kind, p in (("sumula", _SUMULA), ("tema", _THEME)):
            if found := list(p.finditer(text)):
                return _cut(text, found, kind, lambda m: " ".join(m[1].split()), "generic")
    return [("generic", None, 0, len(text))] if text.strip() else []


def sections(text: str) -> list[tuple[str, int, int]]:
    """Named parts of a decision; what stands before the first is ``metadados``."""
    found = list(_SECTION.finditer(text))
    if not found:
        return [("inteiro_teor", 0, len(text))]
    return [(k if r is None else X_fold(r), a, b) for k, r, a, b in _cut(text, found, "section", lambda m: m[1], "metadados")]


def X_fold(s: str) -> str:
    """A section's name as an identifier."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().replace(" ", "_")


CHUNKS = (
    "doc_id string, unit_id string, unit_kind string, unit_ref string, chunk_index int, start int, end int, text string, segment_kind string, segment_ref string, hierarchy_path array<string>, "
    "parent_caput string, page_content string, amendment boolean, amendment_operations array<string>, target_articles array<string>, chunking_method string"
)


def chunk(text: str, doc: str, normative: bool, most: int, overlap: int) -> Iterator[tuple]:
    """The chunks of a document: an article's head first, then what stands below it, each with its path and head."""
    nodes = parse(text, doc) if normative and not _COURT.search(text) else []
    by_start = {(n.kind, n.start): n for n in nodes if n.kind in ("artigo", "anexo")}
    seen: set[str] = set()
    running = 0
    for kind, ref, a, b in units(text, normative):
        unit = f"{kind}:{slug_ref(ref) if ref else '-'}"
        if unit in seen:
            unit = f"{unit}:{a}"
        seen.add(unit)
        node = by_start.get((kind, a))
        parts: list[tuple[str, str | None, int, int, list[str], str]] = []
        caput = ""
        change = amendment(text[a:b], ref) if kind == "artigo" else None
        if node and kind == "artigo":
            below = [n for n in nodes if n.kind in RANKS and a < n.start < b]
            first = below[0].start if below else b
            caput = text[a:first].strip()
            parts.append(("caput", None, a, first, node.path, ""))
            parts += [(n.kind, n.ref, n.start, n.end, n.path, caput) for n in below]
        elif kind == "jurisprudencia":
            parts += [("secao", s, a + x, a + y, [s], "") for s, x, y in sections(text[a:b])]
        else:
            parts.append((kind, ref, a, b, node.path if node else [], ""))
        index = running if kind == "jurisprudencia" else 0
        for seg, sref, x, y, path, head in parts:
            prefix = ""
            if head:
                prefix = short_caput(f"{' > '.join(path)}\n{head}", max(20, most // 2)) + "\n"
            room = max(1, most - len(prefix))
            for s, e in split_spans(text[x:y], room, min(overlap, room - 1)):
                body = text[x + s : x + e]
                yield (doc, unit, kind, ref, index, x + s, x + e, body, seg, sref, path, head or None, prefix + body, change is not None, change["operations"] if change else [], change["articles"] if change else [], "structure" if node else "split")
                index += 1
        if kind == "jurisprudencia":
            running = index


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", role: Column | None = None, most: int = 1000, overlap: int = 150) -> DataFrame:
    """Chunks of all documents. role: only norms (or documents of unknown role) are read as norms."""
    normative = F.lit(True) if role is None else F.coalesce(role, F.lit("")).isin("", "norma")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for d, t, n in zip(pdf["_key"], pdf["_text"], pdf["_norm"], strict=True) for r in chunk(t, str(d), bool(n), most, overlap)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), normative.alias("_norm")).mapInPandas(run, CHUNKS)


def headings_in_force(points: DataFrame, headings: DataFrame, key: str) -> DataFrame:
    """Adds heading: the last heading at or before each point of a document. points: key, at; headings: key, at, heading."""
    return as_of(points, headings, [key], "at", "heading")


def child_kind(mark: Column) -> Column:
    """Kind of a mark below an article."""
    m = F.trim(mark)
    return (
        F.when(m.rlike(r"(?i)^(§|par[aá]gr)"), "paragrafo")
        .when(m.rlike(rf"^(Inciso\s+)?({_ROMAN})(-[A-Z]{{1,3}})?\s*([).–—-]|$)"), "inciso")
        .when(m.rlike(r"(?i)^(al[ií]nea\s+)?\(?[a-z]{1,3}\)"), "alinea")
        .when(m.rlike(r"^\(?\d{1,3}\s*[).–—-]"), "item")
    )


def reference_slug(c: Column) -> Column:
    """A reference as part of an id, as a column."""
    return X.slug(F.regexp_replace(c, r"(?i)^(art(igo)?\.?|§|par[aá]grafo)\s*|[ºª°]", ""))
