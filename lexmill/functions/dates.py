"""Date expressions: keys, literals of the web, validity intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import text as X

OPEN_FROM, OPEN_TO = 0, 99991231
#: Months as their first three letters.
MONTHS = "jan fev mar abr mai jun jul ago set out nov dez".split()


def date_key(c: Column) -> Column:
    """yyyyMMdd as a number; null for what is no ISO date."""
    day = F.substring(c, 1, 10)
    d = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def _month(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(X.fold(c), 1, 3)).cast("int")


def _made(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def web_date(c: Column) -> Column:
    """First date written in a text: ISO, y/m/d, d/m/y, 5 de abril de 2024, 18.set.2026, /2024-dez-06/; else null."""
    g = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    iso, dmy = r"(?:^|[^0-9])(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[^0-9]|$)", r"(?:^|[^0-9])(\d{1,2})/(\d{1,2})/(\d{4})(?:[^0-9]|$)"
    long, dotted, named = r"(?i)(\d{1,2})º?\s+de\s+([a-zç]{3,9})\s+de\s+(\d{4})", r"(?i)(\d{1,2})\.([a-zç]{3})[a-zç]*\.(\d{4})", r"(?i)(\d{4})-([a-zç]{3})-(\d{1,2})"
    return F.coalesce(
        _made(g(iso, 1), g(iso, 2), g(iso, 3)),
        _made(g(dmy, 3), g(dmy, 2), g(dmy, 1)),
        _made(g(long, 3), _month(g(long, 2)), g(long, 1)),
        _made(g(dotted, 3), _month(g(dotted, 2)), g(dotted, 1)),
        _made(g(named, 1), _month(g(named, 2)), g(named, 3)),
    )


def validity(start: Column, end: Column, status: Column) -> Column:
    """Struct (from_day, to_day, status, error) of a validity interval.

    Without a declared status an interval with both ends is closed, any other unknown. A missing end takes a sentinel
    only where the status declares it open; so unknown intervals satisfy no temporal filter.
    """
    filled = lambda c: c.isNotNull() & (F.length(F.trim(c)) > 0)

    def made(x: Column) -> Column:
        a, b = x["a"], x["b"]
        kind = F.coalesce(x["s"], F.when(a.isNotNull() & b.isNotNull(), "closed").otherwise("unknown"))
        error = (
            F.when(~kind.isin("closed", "open_start", "open_end", "unknown"), "status")
            .when(x["has_a"] & a.isNull(), "from")
            .when(x["has_b"] & b.isNull(), "to")
            .when((kind == "closed") & (a.isNull() | b.isNull()), "closed needs both")
            .when((kind == "open_start") & (a.isNotNull() | b.isNull()), "open_start needs only to")
            .when((kind == "open_end") & (b.isNotNull() | a.isNull()), "open_end needs only from")
            .when(a > b, "order")
        )
        low = F.when(kind == "open_start", OPEN_FROM).otherwise(a)
        high = F.when(kind == "open_end", OPEN_TO).otherwise(b)
        return F.struct(F.when(error.isNull(), low).alias("from_day"), F.when(error.isNull(), high).alias("to_day"), kind.alias("status"), error.alias("error"))

    read = F.struct(date_key(start).alias("a"), date_key(end).alias("b"), F.coalesce(filled(start), F.lit(False)).alias("has_a"), F.coalesce(filled(end), F.lit(False)).alias("has_b"), X.blank_to_null(status).alias("s"))
    return X.once(read, made)


def pdf_date(c: Column) -> Column:
    """Day of a PDF's D:yyyymmdd mark."""
    return F.try_to_date(F.nullif(F.regexp_extract(c, r"^D:(\d{8})", 1), F.lit("")), "yyyyMMdd")
