"""Text expressions: folding, tokens, terms, stems; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain forms, pairwise.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝºª"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNYoa"


def unmark(c: Column) -> Column:
    """Letters without their marks, º and ª as o and a."""
    return F.translate(c, MARKED, PLAIN)


def fold(c: Column) -> Column:
    """Lower case without marks."""
    return F.lower(unmark(c))


def alnum_key(c: Column) -> Column:
    """Upper-case letters and digits only: equal for all spellings of a number; null stays null."""
    return F.regexp_replace(F.upper(unmark(c)), "[^A-Z0-9]", "")


def blank_to_null(c: Column) -> Column:
    """Null for null, empty and white space; else the trimmed text."""
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


# --- tokens, terms, stems ---------------------------------------------------------------------------------------------

#: Words that carry no evidence.
EVIDENCE_STOPWORDS = (
    "para como essa esse isso esta este sao são uma uns das dos com sem por que não nao sobre entre pelos pelas quando onde tambem também deve podera poderá ser nos nas aos ainda"
).split()
#: Endings cut from a word, the first that leaves four letters or more.
STEM_SUFFIXES = (
    "amentos imentos adores adoras idades amento imento ador adora idade acoes icoes ucoes acao icao ucao mente ando endo indo ar er ir os as es s"
).split()
#: Words left out of the terms of a question.
TERM_STOPWORDS = "a ao aos as com da das de do dos e em na nas no nos o os ou para pela pelas pelo pelos por que se sem um uma".split()

TOKEN = "[a-z]{3,}|[0-9]{2,}"
TERM = r"[0-9]+(?:\.[0-9]+)*/[0-9]{2,4}|[a-z0-9]+"


def tokens(c: Column) -> Column:
    """Folded words of three letters and numbers of two digits, in order, repeated as they occur."""
    return F.regexp_extract_all(fold(c), F.lit(f"({TOKEN})"), F.lit(1))


def evidence_tokens(c: Column) -> Column:
    """The distinct tokens that carry evidence."""
    return F.array_except(F.array_distinct(tokens(c)), F.array(*[F.lit(w) for w in EVIDENCE_STOPWORDS]))


def stem(c: Column) -> Column:
    """A folded word without its first matching ending."""
    out = None
    for s in STEM_SUFFIXES:
        fits = c.endswith(s) & (F.length(c) >= len(s) + 4)
        cut = F.substring(c, 1, F.length(c) - len(s))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(c)


def evidence_stems(c: Column) -> Column:
    """The distinct stems of the tokens that carry evidence."""
    return F.array_distinct(F.transform(evidence_tokens(c), stem))


def query_terms(c: Column) -> Column:
    """Distinct terms of a question in order: no stopwords, no bare numbers under four digits."""
    found = F.array_distinct(F.regexp_extract_all(fold(c), F.lit(f"({TERM})"), F.lit(1)))
    keep = lambda t: ~t.isin(*TERM_STOPWORDS) & (~t.rlike("^[0-9]{1,3}$")) & (F.length(t) > 1)
    return F.filter(found, keep)


def once(c: Column, use) -> Column:
    """``use(c)`` with c evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def term_hits(terms: Column, text: Column) -> Column:
    """How many of the terms begin a word of the text."""
    words = F.concat(F.lit(" "), F.regexp_replace(fold(text), r"[^a-z0-9./]+", " "))
    return once(words, lambda w: F.size(F.filter(terms, lambda t: F.contains(w, F.concat(F.lit(" "), t)))))


def terms_match(terms: Column, hits: Column) -> Column:
    """All of up to two terms, else half of them and at least two; no terms match anything."""
    n = F.size(terms)
    return F.when(n == 0, True).when(n <= 2, hits == n).otherwise(hits >= F.greatest(F.lit(2), F.ceil(n / 2)))


def process_match(question: Column, number: Column, text: Column) -> Column:
    """Whether the question's digits, six or more, stand in the process number, written with or without signs; else whether any of its terms begins a word of the text."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    named = (F.length(digits(question)) >= 6) & F.contains(digits(number), digits(question))
    return F.coalesce(named, F.lit(False)) | F.coalesce(term_hits(query_terms(question), text) > 0, F.lit(False))


def query_variants(c: Column) -> Column:
    """The question, its first two terms, then each term; distinct."""
    t = query_terms(c)
    return F.array_distinct(F.filter(F.concat(F.array(F.trim(c)), F.array(F.concat_ws(" ", F.slice(t, 1, 2))), t), lambda x: F.length(x) > 0))


def holds_any(c: Column, markers: list[str]) -> Column:
    """Whether the folded text holds any of the markers."""
    marks = F.array(*[F.lit(m) for m in markers])
    return F.coalesce(once(fold(c), lambda low: F.exists(marks, lambda m: F.contains(low, m))), F.lit(False))


def count_held(c: Column, markers: list[str]) -> Column:
    """How many of the markers the folded text holds."""
    marks = F.array(*[F.lit(m) for m in markers])
    return F.coalesce(once(fold(c), lambda low: F.size(F.filter(marks, lambda m: F.contains(low, m)))), F.lit(0))


# --- cleaning ---------------------------------------------------------------------------------------------------------


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_session(url: Column) -> Column:
    """A URL without its session mark."""
    return F.regexp_replace(url, r"(?i);jsessionid=[^?#]*", "")


def split_list(c: Column) -> Column:
    """Parts between semicolons, line ends and bars; trimmed, none empty."""
    return F.filter(F.transform(F.split(c, r"[;\n|]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def slug(c: Column) -> Column:
    """Folded letters and digits joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def decision_status(c: Column) -> Column:
    """Status named in a text, VIGENTE where none is."""
    found = F.upper(unmark(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)\b(cancelad[ao]|revogad[ao]|superad[ao]|suspens[ao])\b", 1)))
    return F.when(F.length(found) > 0, found).otherwise("VIGENTE")


def host(url: Column) -> Column:
    """Host of a URL without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:;?#]+)", 1)), r"^www\.", "")
