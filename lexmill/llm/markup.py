"""Leftover HTML, Markdown, wiki and LaTeX notation turned into clean text.

HTML is read into a tree. Paragraphs pass points for their length and commas to their ancestors, discounted by the share
of their text that is in links; the container with most points is kept together with its siblings of some worth and with
headings, lists, tables and code beside it. The other notations are rewritten by their own rules. What the notation
meant stays readable: a heading stands on its own line, list items start with a bullet, table cells are parted by tabs,
code is indented by four spaces, formulas are written in a line.

Defined results: null gives null; a text without notation is returned as it is and counts no notation; ordinary signs
(R$, §, <, >, *, (*), #7, file_names, blank lines to fill in, [...]) are no notation; an unclosed tag at the end of a
text or line is notation; a value counts as a case only where cleaning rewrote it; cleaned text cleans to itself.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = (
    "html head body title meta link base p br hr div span section article main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption colgroup col "
    "a b i u s em strong small big sub sup font center strike del ins mark abbr cite q blockquote pre code tt kbd samp var img figure figcaption picture source video audio iframe object embed param "
    "form input button select option textarea label fieldset legend script style noscript template svg path ref references nowiki gallery math o:p st1:personname time address details summary wbr"
).split()
_TAG_NAMES = "|".join(sorted(map(re.escape, TAGS), key=len, reverse=True))
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!doctype[^>]*>|<\?[^>]*\?>|<\s*(/?)\s*({_TAG_NAMES})\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(/?)>", re.I | re.S)
_OPEN_TAG = re.compile(rf"<\s*/?\s*(?:{_TAG_NAMES})(?:\s[^<>]*)?$|<!--(?!.*-->)", re.I | re.M)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ESCAPED_TAG = re.compile(rf"&lt;\s*/?\s*(?:{_TAG_NAMES})\b[^<>]*?/?&gt;", re.I)
_DOUBLE = re.compile(r"&amp;(?=(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31});)")


def _known_entity(e: str) -> bool:
    return e[1] == "#" or e[1:] in html5


_MARKDOWN = [
    ("heading", re.compile(r"^ {0,3}#{1,6}[ \t]+(?=\S)", re.M)),
    ("fence", re.compile(r"^[ \t]*```", re.M)),
    ("code", re.compile(r"(?<!`)`[^`\n]+`(?!`)")),
    ("strong", re.compile(r"\*\*(?=[^\s*])|(?<=[^\s*])\*\*")),
    ("strong", re.compile(r"(?<![\w_])__(?=[^\s_])(?:[^\n_]|_(?!_))+?(?<=[^\s_])__(?![\w_])")),
    ("emphasis", re.compile(r"(?<![\w*(])\*(?=[^\s*)\d])[^*\n]+?(?<=[^\s*(])\*(?![\w*])")),
    ("emphasis", re.compile(r"(?<![\w_/.])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_])")),
    ("strike", re.compile(r"~~(?=\S)[^~\n]+~~")),
    ("link", re.compile(r"!?\[[^\[\]\n]*\]\((?:https?://|/|#|mailto:|www\.)[^)\s]*\)")),
    ("table", re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+(?:[ \t]*:?-{2,}:?[ \t]*)?$", re.M)),
    ("quote", re.compile(r"^>[ \t]+(?!R\$|[\d<>=])(?=\S)", re.M)),
    ("bullet", re.compile(r"^[*+][ \t]+(?=[^\W\d_]|\*\*)", re.M)),
    ("rule", re.compile(r"^(?:\*[ \t]*){3,}$", re.M)),
]
_WIKI = [
    ("heading", re.compile(r"^(={2,6})[ \t]*[^=\n]+?[ \t]*\1[ \t]*$", re.M)),
    ("emphasis", re.compile(r"''+(?=\S)")),
    ("link", re.compile(r"\[\[[^\[\]\n]*\]\]")),
    ("link", re.compile(r"\[https?://[^\s\]]+(?: [^\]\n]*)?\]")),
    ("template", re.compile(r"\{\{[^\s{}|\d][^{}|\n]*(?=\||\}\})")),
    ("table", re.compile(r"^\{\|.*$|^\|\}|^\|-(?!-).*$", re.M)),
]
_COMMAND = re.compile(r"\\(?:[A-Za-z]{2,}\*?(?=[\s{\[\\_^$)\]]|$)|[A-Za-z](?=[\s\\{_^$,.])|[\[\]()%$&#_{},;!~])")
_MATH = re.compile(r"(?<![A-Z$\\\w])\$(?=[^\s$\d])[^$\n]+?(?<=\S)\$(?![\d$])")
_TIE = re.compile(r"(?<=[\w.])~(?=[\d§\\A-Za-z])")


def notations(text: str) -> dict[str, int]:
    """How many marks of each notation a text holds; empty: none."""
    out: dict[str, int] = {}
    n = 0
    if "<" in text:
        n = len(_TAG.findall(text)) + len(_OPEN_TAG.findall(text))
    if "&" in text:
        n += sum(_known_entity(e) for e in _ENTITY.findall(text))
    if n:
        out["html"] = n
    for kind, rules in (("markdown", _MARKDOWN), ("wiki", _WIKI)):
        if n := sum(len(r.findall(text)) for _, r in rules):
            out[kind] = n
    n = 0
    if "\\" in text:
        n = len(_COMMAND.findall(text))
    if "$" in text:
        n += len(_MATH.findall(text))
    if n or ("\\" in text and "~" in text):
        n += len(_TIE.findall(text))
    elif "~" in text and re.search(r"\b[Aa]rts?\.~\d", text):
        n = 1
    if n:
        out["latex"] = n
    return out


# --- HTML -------------------------------------------------------------------------------------------------------------


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("tag", "children", "parent", "points", "hidden", "depth")

    def __init__(self, tag: str, parent: Node | None = None, hidden: bool = False) -> None:
        self.tag, self.parent, self.children, self.points, self.hidden = tag, parent, [], 0.0, hidden
        self.depth = parent.depth + 1 if parent else 0


#: Elements nested deeper stand beside one another.
MAX_DEPTH = 120
_VOID = frozenset("br hr img input meta link base col source embed param wbr".split())
_DROPPED = frozenset("script style noscript template head title iframe object svg form button select textarea nav aside footer".split())
_RAW = frozenset("script style".split())
_BLOCK = frozenset("html body p div section article main header h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption center address details summary hr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 caption".split())
_KEPT = _HEADING | frozenset("ul ol dl table pre code blockquote".split())
#: A tag that begins closes open elements of these tags, up to the given borders.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_CLOSE_P = _BLOCK - {"html", "body"}


def parse(text: str) -> Node:
    """The tree of a text with tags; what is never closed ends with its parent."""
    root = Node("root")
    at, here, raw = 0, root, None
    for m in _TAG.finditer(text):
        if raw and not (m[1] and (m[2] or "").lower() == raw):
            continue
        if m.start() > at and not raw:
            here.children.append(html.unescape(text[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            raw = None
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        if tag in _CLOSE_P and here.tag == "p":
            here = here.parent
        if tag in _CLOSES:
            closed, border = _CLOSES[tag]
            up = here
            while up is not root and up.tag not in border and up.tag not in closed:
                up = up.parent
            if up.tag in closed:
                here = up.parent
        node = Node(tag, here, hidden=bool(re.search(r"display\s*:\s*none|\bhidden\b", m[3] or "", re.I)))
        here.children.append(node)
        if tag not in _VOID and not m[4] and node.depth < MAX_DEPTH:
            here = node
            if tag in _RAW:
                raw = tag
    if not raw:
        here.children.append(html.unescape(_OPEN_TAG.sub("", text[at:])))
    return root


def _text(node: Node) -> str:
    return "".join(c if isinstance(c, str) else _text(c) for c in node.children if isinstance(c, str) or c.tag not in _RAW)


def _link_share(node: Node) -> float:
    """Share of a node's text that is in links."""

    def linked(n: Node) -> int:
        return sum(len(_text(c)) if c.tag == "a" else linked(c) for c in n.children if not isinstance(c, str))

    return linked(node) / max(1, len(_text(node)))


def score(root: Node) -> Node:
    """Give points to the containers; the best one."""
    best, stack = root, [root]
    while stack:
        node = stack.pop()
        kids = [c for c in node.children if not isinstance(c, str)]
        stack += kids
        loose = "".join(c for c in node.children if isinstance(c, str)).strip()
        if node.tag in ("p", "td", "pre", "blockquote", "li") or loose:
            own = _text(node).strip() if node.tag in ("p", "td", "pre", "blockquote", "li") else loose
            points = (1 + own.count(",") + min(len(own) / 100, 3)) * (1 - _link_share(node))
            up = node if node.tag not in ("p", "td", "pre", "blockquote", "li") else node.parent
            if len(own) >= 25 and up is not None:
                up.points += points
                if up.parent is not None:
                    up.parent.points += points / 2
                if up.points > best.points:
                    best = up
    while best.parent is not None and best.tag not in ("div", "section", "article", "main", "body", "html", "center"):
        best = best.parent
    return best


def _worthless(root: Node) -> set[int]:
    """Ids of the nodes to leave out: on the way up from the best container, siblings of no worth."""
    best = score(root)
    out: set[int] = set()
    here = best
    while here.parent is not None:
        for c in here.parent.children:
            if isinstance(c, str) or c is here or c.tag in _KEPT:
                continue
            if c.points < 0.2 * best.points and _link_share(c) >= 0.5 and _text(c).strip():
                out.add(id(c))
        here = here.parent
    return out


def _flat(text: str) -> str:
    return re.sub(r"[ \t\r\f\v\xa0]*\n[ \t\r\f\v\xa0]*|[ \t\r\f\v\xa0]+", lambda m: "\n" if "\n" in m.group() else " ", text)


def _cells(row: Node) -> list[str]:
    return [" ".join(_write(c, frozenset()).split()) for c in row.children if not isinstance(c, str) and c.tag in ("td", "th")]


def _write(node: Node, out_of: frozenset[int] | set[int], depth: int = 0) -> str:
    out: list[str] = []
    for c in node.children:
        if isinstance(c, str):
            out.append(c if node.tag == "pre" else _flat(c))
            continue
        if c.tag in _DROPPED or c.hidden or id(c) in out_of:
            continue
        if c.tag == "br":
            out.append("\n")
        elif c.tag == "hr":
            out.append("\n\n")
        elif c.tag == "img":
            continue
        elif c.tag == "li":
            out.append("\n" + "  " * min(depth - 1, 6) * (depth > 1) + "• " + _write(c, out_of, depth).strip())
        elif c.tag in ("ul", "ol", "dl"):
            out.append("\n" + _write(c, out_of, depth + 1).strip("\n") + "\n")
        elif c.tag == "tr":
            out.append("\n" + "\t".join(_cells(c)))
        elif c.tag in ("pre", "code") and (c.tag == "pre" or "\n" in _text(c)):
            out.append("\n\n" + "\n".join("    " + x for x in _text(c).strip("\n").split("\n")) + "\n\n")
        elif c.tag == "sup" and _text(c).strip().isdigit() and out and out[-1][-1:].isalnum():
            out.append("^" + _text(c).strip() if out[-1][-1:].isdigit() else _text(c).strip())
        elif c.tag == "ref":
            out.append(f" ({_write(c, out_of, depth).strip()})" if _text(c).strip() else "")
        elif c.tag in _HEADING or c.tag in ("p", "div", "section", "article", "main", "blockquote", "table", "header", "figure", "center", "caption"):
            out.append("\n\n" + _write(c, out_of, depth).strip() + "\n\n")
        elif c.tag in _BLOCK:
            out.append("\n" + _write(c, out_of, depth).strip("\n") + "\n")
        else:
            out.append(_write(c, out_of, depth))
    return "".join(out)


def _from_html(text: str) -> str:
    while _ESCAPED_TAG.search(text) or _DOUBLE.search(text):  # each round takes one escape away
        text = html.unescape(text)
    if _TAG.search(text) or _OPEN_TAG.search(text):
        root = parse(_OPEN_TAG.sub("", text))
        text = _write(root, _worthless(root))
    elif "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()) if _known_entity(m.group()) else m.group(), text)
    return text.replace("\xa0", " ")


# --- other notations --------------------------------------------------------------------------------------------------


_RULED = re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+(?:[ \t]*:?-{2,}:?[ \t]*)?$\n?", re.M)


def _from_markdown(text: str) -> str:
    parts = re.split(r"^[ \t]*```[^\n]*$", text, flags=re.M)
    for i, p in enumerate(parts):
        if i % 2:
            parts[i] = "\n".join("    " + x if x.strip() else x for x in p.strip("\n").split("\n"))
            continue
        p = re.sub(r"^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*$", r"\1", p, flags=re.M)
        if _RULED.search(p):
            p = re.sub(r"^[ \t]*\|(.*)\|[ \t]*$", lambda m: "\t".join(x.strip() for x in m[1].split("|")), _RULED.sub("", p), flags=re.M)
        p = re.sub(r"!?\[([^\[\]\n]*)\]\((?:https?://|/|#|mailto:|www\.)[^)\s]*\)", r"\1", p)
        p = re.sub(r"^[*+-][ \t]+(?=\*\*)|^[*+][ \t]+(?=[^\W\d_])", "• ", p, flags=re.M)
        p = re.sub(r"^(?:\*[ \t]*){3,}$", "", p, flags=re.M)
        p = re.sub(r"\*{2,}(?=[^\s*])|(?<=[^\s*])\*{2,}", "", p)
        p = re.sub(r"(?<![\w_])__(?=[^\s_])((?:[^\n_]|_(?!_))+?)(?<=[^\s_])__(?![\w_])", r"\1", p)
        p = re.sub(r"(?<![\w*(])\*(?=[^\s*)\d])([^*\n]+?)(?<=[^\s*(])\*(?![\w*])", r"\1", p)
        p = re.sub(r"(?<![\w_/.])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])", r"\1", p)
        p = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", p)
        p = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", p)
        parts[i] = re.sub(r"^>[ \t]+(?!R\$|[\d<>=])(?=\S)", "", p, flags=re.M)
    return "\n".join(x for x in parts if x.strip() or len(parts) == 1) if len(parts) > 1 else parts[0]


def _until_same(rewrite: Callable[[str], str], text: str) -> str:
    """The rewriting repeated until it changes nothing; each of these rules makes a text shorter in its marks."""
    while (new := rewrite(text)) != text:
        text = new
    return text


def _from_wiki(text: str) -> str:
    text = re.sub(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", r"\2", text, flags=re.M)
    if "{|" in text:
        text = re.sub(r"^\{\|.*$\n?|^\|\}\s?|^\|-(?!-).*$\n?", "", text, flags=re.M)
        text = re.sub(r"^[!|][ \t]*(.*)$", lambda m: "\t".join(x.strip() for x in re.split(r"!!|\|\|", m[1])), text, flags=re.M)
    else:
        text = re.sub(r"^\|\}\s?|^\|-(?!-).*$\n?", "", text, flags=re.M)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://[^\s\]]+(?: ([^\]\n]*))?\]", lambda m: m[1] or "", text)
    text = _until_same(lambda t: re.sub(r"\{\{[^\s{}|\d][^{}|\n]*\|([^{}]*)\}\}", r"\1", t), text)
    text = re.sub(r"\{\{[^\s{}|\d][^{}|\n]*(?:\||\}\})", "", text)
    return re.sub(r"''+", "", text)


#: Commands that stand for a sign.
_SIGNS = {"times": "×", "cdot": "·", "leq": "≤", "geq": "≥", "le": "≤", "ge": "≥", "neq": "≠", "pm": "±", "sum": "∑", "S": "§", "ldots": "...", "dots": "...", "quad": " ", "textbackslash": "\\", "infty": "∞", "to": "→", "div": "÷"}


def _formula(text: str) -> str:
    return _until_same(lambda t: re.sub(r"\\sqrt\{([^{}]*)\}", r"√(\1)", re.sub(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", lambda m: f"({m[1]})/({m[2]})", t)), text)


def _from_latex(text: str) -> str:
    text = _formula(text)
    text = re.sub(r"\\(?:begin|end)\{[a-zA-Z*]+\}(?:\{[^{}]*\})?\n?", "", text)
    text = re.sub(r"^[ \t]*\\item\b[ \t]*|\\item\b[ \t]*", "• ", text, flags=re.M)
    def unwrapped(text: str) -> str:
        text = re.sub(r"\\(?:part|chapter|(?:sub)*section|paragraph)\*?\{([^{}]*)\}", r"\1", text)
        return re.sub(r"\\(?:text\w+|emph|underline|mathrm|mathbf|mbox|footnote|url|href|label|ref|cite|title)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)
    text = _until_same(unwrapped, text)
    text = re.sub(r"(?<![A-Z$\\\w])\$(?=[^\s$\d])([^$\n]+?)(?<=\S)\$(?![\d$])", r"\1", text)
    text = re.sub(r"\\[\[\]()][ \t]?", "", text)
    text = re.sub(r"\\([A-Za-z]+)\*?", lambda m: _SIGNS.get(m[1], ""), text)
    text = re.sub(r"\\[,;!]", " ", text)
    text = re.sub(r"\\([%$&#_{}~])", r"\1", text)
    text = _TIE.sub(" ", text)
    text = re.sub(r"(?<=\w)_\{?(\w+)\}?(?=[\s),=+*/×-]|$)", r"\1", text)
    return re.sub(r"(?<![{$]){([^{}\n]*)}", r"\1", text)


class Cleaned(NamedTuple):
    text: str | None
    marks: int
    notation: str | None


def clean(text: str | None) -> Cleaned:
    """The clean text, the number of marks and the notations found, joined by +."""
    if not text or not (found := notations(text)):
        return Cleaned(text, 0, None)
    out, kinds, marks = text, set(found), sum(found.values())
    seen = {text}
    while True:  # notations may hold one another
        had = found
        if "html" in had:
            out = _from_html(out)
        if "latex" in had:
            out = _from_latex(out)
        if "wiki" in had:
            out = _from_wiki(out)
        if "markdown" in had or "markdown" in notations(out):
            out = _from_markdown(out)
        found = notations(out)
        kinds |= set(found)
        if not found or out in seen:
            break
        seen.add(out)
    out = re.sub(r"[ \t]+$", "", out, flags=re.M)
    out = re.sub(r"(?<=\S) {2,}", " ", out)
    out = re.sub(r"\n{3,}", "\n\n", out).strip("\n ")
    if "".join(out.split()) == "".join(text.split()):  # nothing was rewritten: the signs are no notation
        return Cleaned(text, 0, None)
    return Cleaned(out, marks, "+".join(sorted(kinds)))


#: Signs without which a text holds no notation.
MAY_HOLD = r"""[<&\\`*_#~{|=]|(?m)^[+]|\[\[|\]\(|\[http|''|(?m)^>|(?<![A-Z])\$"""

CLEANED = T.StructType([T.StructField("text", T.StringType()), T.StructField("marks", T.IntegerType()), T.StructField("notation", T.StringType())])


@F.pandas_udf(CLEANED)
def _clean(v: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clean(x) for x in v], columns=["text", "marks", "notation"])


def cleaned(text: Column) -> Column:
    """Struct (text, marks, notation)."""
    return _clean(text)


def clean_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field_name, clean_text, marks, notation: a row for each value with any notation."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    long = df.select(F.col(key), F.explode(pairs).alias("p")).select(key, "p.field_name", "p.text").where(F.col("text").rlike(MAY_HOLD))
    got = long.select(key, "field_name", cleaned(F.col("text")).alias("c")).where(F.col("c.marks") > 0)
    return got.select(key, "field_name", F.col("c.text").alias("clean_text"), F.col("c.marks").alias("marks"), F.col("c.notation").alias("notation"))
