"""Evidence gate: whether an answer says only what its cited sources hold.

Answers and sources are columns; the verdict of an answer is the reason of its first failing line, null when it is
accepted. Sources belong to their answer's row (at most the final k of retrieval), so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.settings import Settings

#: Fixed value: how a source is cited.
CITATION = r"(?i)(?:\[|【|\()\s*F(\d+)\s*(?:\]|】|\))"
#: Words that alone need no source.
FREE = "resposta segue conforme abaixo observacao observação".split()
#: Words that compare or rank.
COMPARATIVE = ["mesma norma", "mesma regra", "equivalente", "igual", "indistinta", "prevalece", "sempre", "igualdade", "abrange", "precede", "aplica-se", "aplica se", "sempre prevalece"]
#: Patterns of legal identifiers (laws, articles, numbers with bars or hyphens).
IDENTIFIERS = [
    r"(?i)\blei\s+(?:n[ºo.]*\s*)?\d+[.]?\d*(?:/\d{4})?",
    r"(?i)\bart(?:igo)?[.]?\s*\d+[A-Za-z-]*(?:\s*,?\s*§\s*\d+[ºo]?)?",
    r"\b\d{1,7}[/-]\d{1,7}(?:[/-]\d{2,4})?\b",
]


def normal_answer(c: Column) -> Column:
    """Citations as [F1]; blank lines dropped; lines of citations alone joined to the line before."""
    out = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), CITATION, "[F$1]")
    out = F.regexp_replace(out, r"[ \t\r]*\n\s*", "\n")
    return F.regexp_replace(out, r"(?<=\S)\n((?:[ \t]*\[F\d+\])+[ \t]*)(?=\n|$)", " $1")


def citations(c: Column) -> Column:
    """Distinct numbers cited."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int")))


def is_form(line: Column) -> Column:
    """Headings, lines in bold alone and rules state nothing."""
    return line.rlike(r"^\s*(#{1,6}\s.*|\*\*[^*]+\*\*:?|__[^_]+__:?|[-*_=]{3,})\s*$")


def factual(line: Column) -> Column:
    """A line without its citations."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, CITATION, ""), r"^[ .,:;-]+|[ .,:;-]+$", ""))


def identifier_key(c: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(X.fold(c), "[^a-z0-9]+", "")


def identifiers(c: Column) -> Column:
    """All legal identifiers in a text, as keys."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(f"({p})"), F.lit(1)) for p in IDENTIFIERS])
    return F.array_distinct(F.transform(found, identifier_key))


def overlap(claim: Column, cited: Column) -> Column:
    """Struct (direct, stems, shared): shares of the claim's tokens and stems found in the cited text; 1, 0, 0 for a claim of no tokens."""
    def made(x: Column) -> Column:
        n = F.size(x["a"])
        shared = F.size(F.array_intersect(x["sa"], x["sb"]))
        return F.struct(
            F.when(n == 0, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(x["a"], x["b"])), n)).alias("direct"),
            F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(shared, F.size(x["sa"]))).alias("stems"),
            F.when(n == 0, F.lit(0)).otherwise(shared).alias("shared"),
        )

    def stemmed(x: Column) -> Column:
        stems = lambda t: F.array_distinct(F.transform(t, X.stem))
        return X.once(F.struct(x["a"].alias("a"), x["b"].alias("b"), stems(x["a"]).alias("sa"), stems(x["b"]).alias("sb")), made)

    return X.once(F.struct(X.evidence_tokens(claim).alias("a"), X.evidence_tokens(cited).alias("b")), stemmed)


def line_fault(line: Column, sources: Column, settings: Settings = Settings()) -> Column:
    """Why a line fails; null where it passes. sources: array of texts, the first is F1."""
    free = F.array(*[F.lit(w) for w in FREE])

    def judged(x: Column) -> Column:
        claim, nos, words = x["claim"], x["nos"], x["words"]
        cited = F.concat_ws(" ", F.transform(F.array_sort(nos), lambda i: F.coalesce(F.try_element_at(sources, i), F.lit(""))))

        def against(c: Column) -> Column:
            compares = X.holds_any(claim, COMPARATIVE) & ~X.holds_any(c, COMPARATIVE)
            unknown = X.once(identifier_key(c), lambda key: F.exists(identifiers(claim), lambda i: ~F.contains(key, i)))
            weak = X.once(overlap(claim, c), lambda got: (F.size(words) >= 3) & (got["direct"] < settings.evidence_overlap) & ~((got["shared"] >= settings.min_shared_stems) & (got["stems"] >= settings.stem_overlap)))
            return F.when(compares, "comparison").when(unknown, "identifier").when(weak, "overlap")

        return (
            F.when((F.size(nos) == 0) & (F.size(F.array_except(words, free)) > 0), "uncited")
            .when(F.size(nos) == 0, F.lit(None))
            .otherwise(X.once(cited, against))
        )

    parts = F.struct(factual(line).alias("claim"), citations(line).alias("nos"), X.evidence_tokens(factual(line)).alias("words"))
    return F.when(is_form(line), F.lit(None)).otherwise(X.once(parts, judged))


def verdict(answer: Column, sources: Column, settings: Settings = Settings()) -> Column:
    """Reason of rejection, null when accepted; rules in order: empty, no citation, citation out of range, then line by line."""
    text = normal_answer(answer)
    nos = citations(text)
    lines = F.filter(F.split(text, r"\n+"), lambda x: F.length(F.trim(x)) > 0)
    faults = F.filter(F.transform(lines, lambda x: line_fault(x, sources, settings)), lambda x: x.isNotNull())
    return (
        F.when(F.length(text) == 0, "empty")
        .when((F.size(nos) == 0) & (F.size(X.evidence_tokens(text)) > 0), "no citation")
        .when(F.size(nos) == 0, F.lit(None))
        .when(F.exists(nos, lambda i: (i < 1) | (i > F.size(sources))), "out of range")
        .otherwise(F.try_element_at(faults, F.lit(1)))
    )
