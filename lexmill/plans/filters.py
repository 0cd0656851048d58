"""Inline filters and time expressions of a question, made into predicates.

Strings are read on the driver, once per question; what comes out are Catalyst expressions that are pushed to the scan.
"""

from __future__ import annotations

import calendar
import re
import unicodedata
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X

#: Keys of filters, those of numbers, regimes of the past.
KEYS = frozenset(
    "jurisdicao esfera orgao tribunal tipo_documento source_role authority_level normative_rank status revogado ano norm_ano municipio modalidade tipo source_id regime_juridico".split()
)
NUMBERS = frozenset("ano norm_ano authority_level normative_rank".split())
PAST_REGIMES = ["lei_8666", "lei_10520", "lei_12462"]
#: Spellings of regimes.
REGIME_NAMES = {
    "lei 14.133/2021": "lei_14133", "lei 14.133": "lei_14133", "lei 8.666/1993": "lei_8666", "lei 8.666": "lei_8666",
    "lei 10.520/2002": "lei_10520", "lei 10.520": "lei_10520", "jurisprudencia": "jurisprudencia", "transicao legislativa": "transicao",
}
REGIME_MARKS = {
    "lei_14133": ["lei 14.133", "lei 14133", "14.133/2021"],
    "lei_8666": ["lei 8.666", "lei 8666", "8.666/1993"],
    "lei_10520": ["lei 10.520", "lei 10520", "10.520/2002"],
    "lei_12462": ["lei 12.462", "lei 12462", "12.462/2011"],
}
#: Words of comparison and of the past.
COMPARING = ["transicao", "regime anterior", "antes e depois", "diferenca entre", "diferencas entre", "comparar", "comparacao", "comparativo", "versus", " vs ", "em relacao", "o que mudou", "o que muda", "mudancas da nova lei", "mudancas entre"]
PAST = ["historico", "historica", "a epoca", "naquela epoca", "era aplicavel", "estava vigente", "estava em vigor", "quando era aplicavel", "antes de", "depois de"]
#: Words that name a court, and the court; regimes as they are written; what makes a sentence about two sources; sources by what names them.
TRIBUNALS = [
    ("tcesp", "tcesp"), ("tce-sp", "tcesp"), ("tribunal de contas do estado de sao paulo", "tcesp"), ("tcu", "tcu"), ("stj", "stj"), ("stf", "stf"),
    ("tjsp", "tjsp"), ("tribunal de justica de sao paulo", "tjsp"),
]
LABELS = {"lei_14133": "Lei 14.133/2021", "lei_8666": "Lei 8.666/1993", "lei_10520": "Lei 10.520/2002", "lei_12462": "Lei 12.462/2011"}
MANUAL, MANUAL_SOURCE = ["manual de licitacoes", "tcu"], "tcu-manual-licitacoes"
STATE_CONSTITUTION, STATE_SOURCE = ["constituicao do estado de sao paulo", "constituicao estadual de sao paulo", "constituicao paulista"], "sp-const"
CONSTITUTION, CONSTITUTION_SOURCE = ["constituicao federal", "segundo a constituicao"], "cf1988"
FEDERAL = ["uniao", "federal", "tcu", "stf", "stj", "agu"]
STATE = ["sao paulo", "tcesp", "tjsp", "tce-sp", "paulista"]
_MONTHS = "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro".split()
_MONTH = "(" + "|".join(_MONTHS) + ")"
_INLINE = re.compile(r"@(\w+)(>=|<=|=|>|<)([^\s@]+)")


def folded(text: str) -> str:
    """Lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


class FilterError(ValueError):
    """A filter that can't be used."""


def _value(key: str, raw: str) -> object:
    if key in NUMBERS:
        if not re.fullmatch(r"[+-]?\d+", raw.strip()):
            raise FilterError(f"@{key} must be a number")
        return int(raw)
    if key == "jurisdicao":
        if (v := raw.strip().casefold()) not in ("federal", "estadual_sp"):
            raise FilterError("@jurisdicao takes federal or estadual_sp")
        return v
    if key == "regime_juridico":
        return REGIME_NAMES.get(folded(raw), raw.strip())
    if key == "revogado":
        v = folded(raw.strip())
        if v not in ("1", "true", "sim", "yes", "0", "false", "nao", "no"):
            raise FilterError("@revogado must be sim or nao")
        return v in ("1", "true", "sim", "yes")
    return raw.strip()


@dataclass
class Filter:
    """What is asked of one key: any of some values, or bounds. A value given before bounds is kept with them and decides."""

    any_of: list = field(default_factory=list)
    bounds: dict[str, int] = field(default_factory=dict)

    def column(self, c: Column, is_array: bool = False) -> Column:
        """A row without a value doesn't match."""
        if self.any_of:
            if is_array:
                return F.arrays_overlap(c, F.array(*[F.lit(v) for v in self.any_of]))
            return c == F.lit(self.any_of[0]) if len(self.any_of) == 1 else c.isin(*self.any_of)
        ops = {">": c.__gt__, ">=": c.__ge__, "<": c.__lt__, "<=": c.__le__}
        return reduce(lambda a, b: a & b, [ops[o](F.lit(v)) for o, v in sorted(self.bounds.items())])


def parse_inline(raw: str) -> tuple[str, dict[str, Filter]]:
    """The question without its filters, and the filters. Equal keys add values; a value after bounds is an error."""
    found: dict[str, Filter] = {}
    if bad := sorted({m[1] for m in _INLINE.finditer(raw)} - KEYS):
        raise FilterError("unknown: " + ", ".join("@" + b for b in bad))
    for m in _INLINE.finditer(raw):
        key, op, text = m.groups()
        f = found.setdefault(key, Filter())
        if op == "=":
            values = [_value(key, v) for v in text.split(",") if v]
            if not values:
                raise FilterError(f"@{key} has no value")
            if f.bounds:
                raise FilterError(f"@{key} mixes value and bounds")
            f.any_of += values
        else:
            if key not in NUMBERS:
                raise FilterError(f"@{key} takes no {op}")
            f.bounds[op] = _value(key, text)
            if len(f.any_of) > 1:
                raise FilterError(f"@{key} mixes values and bounds")
    return _INLINE.sub("", raw).strip(), found


@dataclass(frozen=True)
class Window:
    """A day, or a span of days."""

    on: date | None = None
    start: date | None = None
    end: date | None = None


def _window(text: str) -> Window | None:
    try:
        if re.fullmatch(r"20\d\d-\d\d-\d\d", text):
            return Window(on=date.fromisoformat(text))
        if m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(20\d\d)", text):
            return Window(on=date(int(m[3]), int(m[2]), int(m[1])))
        if m := re.fullmatch(_MONTH + r"\s+de\s+(20\d\d)", text):
            y, n = int(m[2]), _MONTHS.index(m[1]) + 1
            return Window(start=date(y, n, 1), end=date(y, n, calendar.monthrange(y, n)[1]))
        if re.fullmatch(r"20\d\d", text):
            return Window(start=date(int(text), 1, 1), end=date(int(text), 12, 31))
    except ValueError:
        return None
    return None


_LITERAL = rf"20\d\d-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}/\d{{1,2}}/20\d\d|{_MONTH}\s+de\s+20\d\d|20\d\d"
_AROUND = re.compile(rf"\b(antes|depois)\s+de\s+({_LITERAL})\b")
_PLAIN = [re.compile(r"20\d\d-\d{1,2}-\d{1,2}"), re.compile(r"\b\d{1,2}/\d{1,2}/20\d\d\b"), re.compile(rf"\b(?:em|no|na|durante)\s+({_MONTH}\s+de\s+20\d\d)\b"), re.compile(r"\b(?:em|no|na|durante|ano\s+de)\s+(20\d\d)\b")]


def windows(question: str) -> list[Window]:
    """Days and spans a question names, in its order, each once. ``antes de`` gives the day before, ``depois de`` the day after."""
    low = folded(question)
    taken: list[tuple[int, int]] = []
    found: list[tuple[int, Window]] = []
    for m in _AROUND.finditer(low):
        if w := _window(m[2]):
            day = (w.on or w.start) - timedelta(1) if m[1] == "antes" else (w.on or w.end) + timedelta(1)
            found.append((m.start(2), Window(on=day)))
            taken.append(m.span())
    for p in _PLAIN:
        for m in p.finditer(low):
            k = 1 if p.groups else 0
            if not any(a < m.end(k) and m.start(k) < b for a, b in taken) and (w := _window(m[k])):
                found.append((m.start(k), w))
                taken.append(m.span(k))
    return list(dict.fromkeys(w for _, w in sorted(found, key=lambda x: x[0])))


def holds(question: str, marks: list[str]) -> bool:
    """Whether the folded question holds any mark."""
    low = folded(question)
    return any(m in low for m in marks)


def regimes(question: str) -> list[str]:
    """Regimes a question names."""
    return [k for k, marks in REGIME_MARKS.items() if holds(question, marks)]


def cross_source(question: str) -> bool:
    """Whether a question asks for the law of 2021 and for the manual of the federal court at once: neither may become a filter."""
    low = folded(question)
    return any(m in low for m in REGIME_MARKS["lei_14133"]) and all(m in low for m in MANUAL)


def transition_regimes(question: str) -> list[str]:
    """Regimes that a comparing question is about, the law of 2021 first where it is asked what changed."""
    low, found = folded(question), regimes(question)
    if not found:
        found = ["lei_14133", "lei_8666"]
    elif "lei_14133" not in found and any(m in low for m in ("mudou", "diferenca", "compar")):
        found.insert(0, "lei_14133")
    if holds(question, COMPARING):
        found += [r for mark, r in (("pregao", "lei_10520"), ("rdc", "lei_12462")) if mark in low]
    return list(dict.fromkeys(found))


def inferred(question: str) -> dict[str, object]:
    """Filters that a question's words ask for: jurisdicao, tribunal, source_id, authority_level, normative_rank."""
    low, out = folded(question), {}
    if j := jurisdiction(question):
        out["jurisdicao"] = j
    if not cross_source(question):
        if court := next((t for m, t in TRIBUNALS if m in low), None):
            out["tribunal"] = court
        if all(m in low for m in MANUAL):
            out["source_id"] = MANUAL_SOURCE
    if any(m in low for m in STATE_CONSTITUTION):
        out["source_id"] = STATE_SOURCE
    elif low == "constituicao" or any(m in low for m in CONSTITUTION):
        out["source_id"] = CONSTITUTION_SOURCE
    if out.get("source_id") in (STATE_SOURCE, CONSTITUTION_SOURCE):
        out |= {"authority_level": 1, "normative_rank": 1}
    return out


def inferred_columns(question: Column) -> Column:
    """Struct (comparative, historical, cross_source, tribunal, source_id, jurisdicao, regimes) of a column of questions: the same rules over the same lists."""

    def read(low: Column) -> Column:
        has = lambda m: F.contains(low, F.lit(m))
        some = lambda ms: reduce(lambda a, b: a | b, [has(m) for m in ms])
        manual = reduce(lambda a, b: a & b, [has(m) for m in MANUAL])
        cross = some(REGIME_MARKS["lei_14133"]) & manual
        words = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9-]+", " "), F.lit(" "))
        federal, state = (reduce(lambda a, b: a | b, [F.contains(words, F.lit(f" {w} ")) for w in ws]) for ws in (FEDERAL, STATE))
        named = F.filter(F.array(*[F.when(some(marks), k) for k, marks in REGIME_MARKS.items()]), lambda x: x.isNotNull())
        return F.struct(
            some(COMPARING).alias("comparative"),
            some(PAST).alias("historical"),
            cross.alias("cross_source"),
            F.when(~cross, F.coalesce(*[F.when(has(m), t) for m, t in TRIBUNALS])).alias("tribunal"),
            F.when(some(STATE_CONSTITUTION), STATE_SOURCE).when((low == "constituicao") | some(CONSTITUTION), CONSTITUTION_SOURCE).when(~cross & manual, MANUAL_SOURCE).alias("source_id"),
            F.when(federal & ~state, "federal").when(state & ~federal, "estadual_sp").alias("jurisdicao"),
            named.alias("regimes"),
        )

    return X.once(X.fold(F.coalesce(question, F.lit(""))), read)


def jurisdiction(question: str) -> str | None:
    """Federal or state where the question names words of one alone; whole words only."""
    low = " " + re.sub(r"[^a-z0-9-]+", " ", folded(question)) + " "
    f, s = (any(f" {w} " in low for w in ws) for ws in (FEDERAL, STATE))
    return "federal" if f and not s else "estadual_sp" if s and not f else None


@dataclass
class Plan:
    """What a question comes down to."""

    question: str
    search: str
    filters: dict[str, Filter]
    window: Window | None
    comparative: bool
    historical: bool
    regimes: list[str]
    exclude_past: bool

    def predicate(self, df: DataFrame) -> Column:
        """One expression over the columns that the table has."""
        kinds = {f.name: f.dataType.typeName() for f in df.schema}
        parts = [f.column(F.col(k), kinds[k] == "array") for k, f in sorted(self.filters.items()) if k in kinds]
        if self.window and {"effective_from_day", "effective_to_day"} <= set(kinds):
            parts.append(valid_on(self.window.on) if self.window.on else valid_in(self.window.start, self.window.end))
        if self.exclude_past and "regime_juridico" in kinds:
            parts.append(none_of(F.col("regime_juridico"), PAST_REGIMES))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def day_number(d: date) -> int:
    """yyyyMMdd."""
    return d.year * 10000 + d.month * 100 + d.day


def valid_on(d: date) -> Column:
    """In force on a day; unknown intervals are not."""
    return (F.col("effective_from_day") <= day_number(d)) & (F.col("effective_to_day") >= day_number(d))


def valid_in(a: date, b: date) -> Column:
    """In force on some day of a span."""
    return (F.col("effective_from_day") <= day_number(b)) & (F.col("effective_to_day") >= day_number(a))


def none_of(c: Column, values: list) -> Column:
    """Exclusion that keeps rows without a value."""
    return ~F.coalesce(c.isin(*values), F.lit(False))


def any_of(*conditions: Column) -> Column:
    """At least one; unknown counts as no."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def plan(raw: str, given: dict[str, Filter] | None = None) -> Plan:
    """The plan of a question. Filters given by the caller come before inline ones, these before inferred ones."""
    question, inline = parse_inline(raw)
    comparative, found = holds(question, COMPARING), windows(question)
    historical = holds(question, PAST) or bool(found)
    named = regimes(question)
    window = None if comparative and len(found) > 1 else found[0] if found else None
    filters = {**inline, **(given or {})}
    for k, v in inferred(question).items():
        filters.setdefault(k, Filter([v]))
    explicit = "regime_juridico" in filters
    by_regime = named and not cross_source(question)
    if not explicit and not comparative and by_regime:
        filters["regime_juridico"] = Filter(list(named))
    exclude = not explicit and not by_regime and not (comparative or historical or window)
    search = f"{question} [FOCO TEMPORAL: comparar os regimes {'; '.join(LABELS[r] for r in transition_regimes(question))}]" if comparative else question
    return Plan(question, search, filters, window, comparative, historical, named, exclude)
