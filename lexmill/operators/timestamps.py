"""Mixed timestamp notations to one unambiguous day or UTC instant.

Every value is reduced to a shape mask (digits to 9, month names to ``m99``, weekday names to ``w``). Each distinct
mask is mapped to a parser once per worker; a parser is a list of character positions, so that all values of a mask are
cut and converted as whole vectors. Times without a zone are converted through a table of the zone's transitions, read
from the session's time zone database together with its version.

Defined results: null, blank, a dash and words for "not known" are ``missing``; what has no known shape or is no
possible date or time is ``unreadable``; times that occur twice are read as the first, times skipped by the clock are
moved on by the skip. Days stand before months except in year-first forms; two-digit years are 20yy.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTHS = {
    name: i + 1
    for names in (
        "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
        "jan fev mar abr mai jun jul ago set out nov dez",
        "january february march april may june july august september october november december",
        "jan feb mar apr may jun jul aug sep oct nov dec",
    )
    for i, name in enumerate(names.split())
} | {"marco": 3, "sept": 9}
WEEKDAYS = frozenset(
    "segunda terça terca quarta quinta sexta sábado sabado domingo seg ter qua qui sex sáb sab dom "
    "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun".split()
)
#: Offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "brt": -180, "brst": -120, "amt": -240, "amst": -180, "act": -300, "fnt": -120}
FILLERS = frozenset(
    ["", "-", "--", "---", "–", "—", "não informado", "nao informado", "não informada", "nao informada", "n/d", "nd", "n/a", "s/d", "s/n", "s/i", "a publicar", "não publicado", "não consta", "nao consta",
     "desconhecido", "desconhecida", "ignorado", "ignorada", "sem data", "sem informação", "sem informacao", "não disponível", "nao disponivel", "indisponível", "a definir", "null", "none", "?"]
)
LOCAL_ZONE = "America/Sao_Paulo"
#: Masks longer than this are parsed like all others, but not remembered.
CACHED_MASK = 200
#: Seconds of the Gregorian cycle of 400 years, after which rules repeat.
CYCLE = 146_097 * 86_400

_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")
_DIGIT = str.maketrans("0123456789", "9999999999")

_CLOCK = r"(?P<H>99?)(?:[:h](?P<M>99)(?:[:m](?P<S>99)s?(?:[.,](?P<f>9{1,9}))?)?(?:min)?|h)"
_ZONE = r"(?P<z> ?z|(?: ?(?:utc|gmt))? ?[+-]99?(?::?99)?| ?[a-z]{3,4})?(?: ?\[[a-z/_]+\])?"
_LOCAL = r"(?: ?\((?:horário|horario) (?:de|oficial de) (?:brasília|brasilia)\))?"
_TIME = rf"(?:(?:,| -|t|)(?: ?às| ?as)? ?{_CLOCK} ?(?P<p>[ap]\.?m\.?)?{_ZONE}{_LOCAL})?"
#: Shapes of masks. Group names: Y, m, d, H, M, S, f (fraction), p (am, pm), z (offset or abbreviation), e (epoch count).
SHAPES = [
    re.compile(p)
    for p in (
        rf"^(?P<Y>9999)(?P<s>[-./])(?P<m>m?99?)(?P=s)(?P<d>99?){_TIME}$",
        r"^/(?P<Y>9999)[-/](?P<m>m?99?)[-/](?P<d>99?)/$",
        rf"^(?P<Y>9999)(?P<m>99)(?P<d>99)(?:t(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9{{1,9}}))?)?{_ZONE})?$",
        rf"^(?:w(?:-feira)?,? )?(?P<d>99?)(?P<s>[-./ ])(?P<m>m?99?)(?P=s)(?P<Y>9999|99){_TIME}$",
        rf"^(?:w(?:-feira)?,? )?(?P<d>99?)[ºo°]? de (?P<m>m99) de (?P<Y>9999){_TIME}$",
        r"^(?P<e>9{10}|9{13})$",
    )
]


def _normal(value: str) -> str:
    """Lower case, single spaces, month names as m01 to m12 and weekday names as w: same mask, same positions."""

    def word(m: re.Match) -> str:
        w = m.group()
        return f"m{MONTHS[w]:02d}" if w in MONTHS else "w" if w in WEEKDAYS else w

    return _WORD.sub(word, _SPACE.sub(" ", value.strip().lower()))


def mask_of(value: str) -> str:
    """The shape mask of a value."""
    return _normal(value).translate(_DIGIT)


@lru_cache(maxsize=4096)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Positions of the fields in values of this mask; None: no known shape."""
    for shape in SHAPES:
        if m := shape.match(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None and k != "s"}
    return None


class ZoneTable(NamedTuple):
    """Transitions of a zone: from ``local[i]`` (local seconds) on, ``offset[i + 1]`` seconds hold."""

    zone: str
    version: str
    local: list[int]
    offset: list[int]


def zone_table(spark: SparkSession, zone: str = LOCAL_ZONE, last_year: int = 2400) -> ZoneTable:
    """The transition table of the session's time zone database, with its version. At most some hundred rows.

    Rules for the future are written out up to ``last_year``; what lies beyond is read a cycle of 400 years earlier.
    """
    jvm = spark._jvm
    rules = jvm.java.time.ZoneId.of(zone).getRules()
    rows = [(t.toEpochSecond(), t.getOffsetBefore().getTotalSeconds(), t.getOffsetAfter().getTotalSeconds()) for t in rules.getTransitions()]
    for rule in rules.getTransitionRules():
        for year in range(2000, last_year):
            t = rule.createTransition(year)
            if not rows or t.toEpochSecond() > rows[-1][0]:
                rows.append((t.toEpochSecond(), t.getOffsetBefore().getTotalSeconds(), t.getOffsetAfter().getTotalSeconds()))
    rows.sort()
    first = rows[0][1] if rows else rules.getOffset(jvm.java.time.Instant.EPOCH).getTotalSeconds()
    version = str(jvm.java.time.zone.ZoneRulesProvider.getVersions(zone).lastKey())
    return ZoneTable(zone, version, [e + max(b, a) for e, b, a in rows], [first, *(a for _, _, a in rows)])


_MONTH_DAYS = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of proleptic Gregorian dates, vectorised."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _offsets(zone: str, n: int) -> np.ndarray | None:
    """Offset in seconds of a written zone; None: unknown."""
    zone = zone.strip()
    if zone in ABBREVIATIONS:
        return np.full(n, ABBREVIATIONS[zone] * 60)
    m = re.match(r"^(?:utc|gmt)? ?([+-])(\d\d?):?(\d\d)?$", zone)
    if not m or int(m[2]) > 18 or int(m[3] or 0) > 59:
        return None
    return np.full(n, (1 if m[1] == "+" else -1) * (int(m[2]) * 3600 + int(m[3] or 0) * 60))


def _within_table(local: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Local seconds beyond a table that is written out that far, moved back by whole cycles."""
    if not len(at) or at[-1] < CYCLE:
        return local
    return np.where(local > at[-1], at[-1] - CYCLE + (local - at[-1]) % CYCLE, local)


def parse_values(values: pd.Series, zone: ZoneTable) -> pd.DataFrame:
    """kind, mask, day (as written, days since 1970), instant (microseconds since 1970 in UTC) of each value."""
    n = len(values)
    kind, masks = np.full(n, "unreadable", dtype=object), np.full(n, None, dtype=object)
    day, instant = np.full(n, np.nan, dtype=object), np.full(n, np.nan, dtype=object)
    day[:] = None
    instant[:] = None
    groups: dict[str, list[int]] = {}
    normal: list[str] = [""] * n
    for i, v in enumerate(values):
        if v is None or v != v or (low := _SPACE.sub(" ", v.strip().lower())) in FILLERS:
            kind[i] = "missing"
            continue
        normal[i] = low = _normal(v)
        masks[i] = low.translate(_DIGIT)
        groups.setdefault(masks[i], []).append(i)
    local_at, offsets = np.array(zone.local, dtype=np.int64), np.array(zone.offset, dtype=np.int64)
    for mask, rows in groups.items():
        if not (p := parser_of(mask) if len(mask) <= CACHED_MASK else parser_of.__wrapped__(mask)):
            continue
        at = np.array(rows)
        texts = [normal[i] for i in rows]

        def num(k: str, default: int = 0, texts: list[str] = texts, p: dict = p) -> np.ndarray:
            if k not in p:
                return np.full(len(texts), default, dtype=np.int64)
            a, b = p[k]
            return np.array([int(t[a:b].lstrip("m")) for t in texts], dtype=np.int64)

        if "e" in p:
            e = num("e")
            us = e * (1_000 if p["e"][1] == 13 else 1_000_000)
            kind[at], instant[at], day[at] = "epoch", us, us // 86_400_000_000
            continue
        y, m, d = num("Y"), num("m"), num("d")
        if p["Y"][1] - p["Y"][0] == 2:
            y = y + 2000
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        real = (m >= 1) & (m <= 12) & (y >= 1)
        real &= (d >= 1) & (d <= _MONTH_DAYS[np.clip(m, 1, 12) - 1] + ((m == 2) & leap))
        days = _days(y, np.clip(m, 1, 12), d)
        if "H" not in p:
            kind[at[real]], day[at[real]] = "day", days[real]
            continue
        hour, minute, second = num("H"), num("M"), num("S")
        if "p" in p:
            pm = np.array([t[p["p"][0]] == "p" for t in texts])
            real &= (hour >= 1) & (hour <= 12)
            hour = hour % 12 + 12 * pm
        real &= (hour <= 23) & (minute <= 59) & (second <= 59)
        width = p["f"][1] - p["f"][0] if "f" in p else 0
        micros = num("f") * 10**6 // 10**width if width else num("f")
        local = days * 86_400 + hour * 3_600 + minute * 60 + second
        if "z" in p:
            a, b = p["z"]
            off = np.zeros(len(texts), dtype=np.int64)
            written = np.array([t[a:b] for t in texts], dtype=object)
            for z in set(written):
                if (o := _offsets(z, 1)) is None:
                    real &= written != z
                else:
                    off[written == z] = o[0]
        else:
            off = offsets[np.searchsorted(local_at, _within_table(local, local_at), side="right")]
        us = (local - off) * 1_000_000 + micros
        kind[at[real]], day[at[real]], instant[at[real]] = "instant", days[real], us[real]
    return pd.DataFrame({"kind": kind, "mask": masks, "day": pd.array(day, dtype="Int64"), "instant": pd.array(instant, dtype="Int64")})


PARSED = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("mask", T.StringType()), T.StructField("day", T.LongType()), T.StructField("instant", T.LongType())]
)


def parsed(value: Column, zone: ZoneTable) -> Column:
    """Struct column (kind, mask, day, instant) of a text column."""

    @F.pandas_udf(PARSED)
    def parse(v: pd.Series) -> pd.DataFrame:
        return parse_values(v, zone)

    return parse(value)


def normalise_timestamps(df: DataFrame, key: str, fields: list[str], zone: str = LOCAL_ZONE) -> DataFrame:
    """One row for each row and field: key, field_name, written, kind, shape, day, instant_utc, day_utc, zone_version.

    kind is day, instant, epoch, unreadable or missing. An instant keeps the day as written in ``day``; a count since
    1970 has no written day. Other columns of ``df`` are left out, so their names can't clash.
    """
    table = zone_table(df.sparkSession, zone)
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("written")) for f in fields])
    long = df.select(F.col(key), F.explode(pairs).alias("_p")).select(key, "_p.field_name", "_p.written")
    out = long.withColumn("_t", parsed(F.col("written"), table))
    day = lambda c: F.date_from_unix_date(c.cast("int"))
    return out.select(
        key,
        "field_name",
        "written",
        F.col("_t.kind").alias("kind"),
        F.col("_t.mask").alias("shape"),
        F.when(F.col("_t.kind") != "epoch", day(F.col("_t.day"))).alias("day"),
        F.timestamp_micros("_t.instant").alias("instant_utc"),
        F.coalesce(F.timestamp_micros("_t.instant").cast("date"), day(F.col("_t.day"))).alias("day_utc"),
        F.lit(f"{table.zone}@{table.version}").alias("zone_version"),
    )
