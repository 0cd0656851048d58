"""Whether a fetched document is one: size, substance, shells of portals, marks of norms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import text as X

#: Signs of a portal's empty shell.
SHELL = ["carregando", "javascript", "menu principal", "buscar", "acessibilidade", "mapa do site"]


def substantive_lines(c: Column, least: int = 40) -> Column:
    """Number of lines of at least ``least`` characters."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.length(F.trim(x)) >= least))


def looks_like_shell(c: Column) -> Column:
    """Two or more signs of a shell and hardly any substance."""
    return (X.count_held(c, SHELL) >= 2) & (substantive_lines(c) <= 8)


def density(c: Column) -> Column:
    """Share of characters that are no white space."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")), n), F.lit(0.0))


def reject_reason(c: Column, norm: Column, least_chars: int = 800, least_lines: int = 6) -> Column:
    """Why a document is rejected; null for accepted. norm: whether it must be a norm (header and an article)."""
    text = F.coalesce(c, F.lit(""))
    header = F.regexp_like(text, F.lit(r"(?imu)^\s*(lei|decreto|portaria|resolução|instrução normativa|emenda)\b"))
    article = F.regexp_like(text, F.lit(r"(?i)\bart(igo)?\.?\s*\d"))
    return (
        F.when(F.length(X.squeeze(text)) < least_chars, "short")
        .when(substantive_lines(text) < least_lines, "few lines")
        .when(looks_like_shell(text), "shell")
        .when(norm & ~header, "no header")
        .when(norm & ~article, "no article")
    )


def topic_match(title: Column, body: Column, wanted: list[str], excluded: list[str]) -> Column:
    """A wanted word in the title, or two in the body and none excluded."""
    return X.holds_any(title, wanted) | ((X.count_held(body, wanted) >= 2) & ~X.holds_any(body, excluded))
