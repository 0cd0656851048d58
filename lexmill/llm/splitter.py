"""Oversized texts cut into ordered pieces within a limit, at natural boundaries, with overlap.

One regular expression with bounded quantifiers consumes a text from left to right: the alternatives are ordered by the
strength of the boundary (end of text, paragraph, line, sentence, clause, word) and fall back to bare characters. A
piece is what one match consumed, preceded by ``overlap`` characters looked back from where it starts. SQL array
functions do it all; no text leaves the JVM.

Defined results: a null text, a text within its limit and a kind without limit give no piece; rows repeated whole count
once; an overlap of the limit or more is lowered to one less than the limit; a limit under 1 counts as no limit; clashing
column names can't occur as only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pattern(room: Column) -> Column:
    """The expression for pieces of at most ``room`` characters; room is at least 1.

    A strong boundary must leave a piece of half the room at least; a word end any piece.
    """
    n = lambda less: F.greatest(room - less, F.lit(1)).cast("string")
    half = F.greatest(F.floor(room / 2), F.lit(1))
    low = lambda less: F.least(half, F.greatest(room - less, F.lit(1))).cast("string")
    sentence = r"(?<!\b[Aa]rts?)(?<!\b[Ii]nc)(?<!\bfls?)(?<!\bn)[.!?…]\s(?=[\p{Lu}\p{Ps}\"“§0-9•–-])"
    return F.when(room < 8, F.concat(F.lit("(?s).{1,"), room.cast("string"), F.lit("}"))).otherwise(
        F.concat(
            F.lit("(?s).{1,"), room.cast("string"), F.lit(r"}\z|.{"),
            low(2), F.lit(","), n(2), F.lit(r"}\n\n|.{"),
            low(1), F.lit(","), n(1), F.lit(r"}\n|.{"),
            low(2), F.lit(","), n(2), F.lit("}" + sentence + "|.{"),
            low(2), F.lit(","), n(2), F.lit(r"}[;:,]\s|.{1,"),
            n(1), F.lit(r"}\s|.{1,"), room.cast("string"), F.lit("}"),
        )
    )


def split_oversized(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """texts: table_name, row_key, kind, text. limits: table_name, kind, max_chars, overlap_chars (one row a kind, few).

    Result: table_name, row_key, piece_no, start_char (of the piece with its overlap), overlap (characters shared with
    the piece before), piece_text. Without the first ``overlap`` characters of each, the pieces joined are the text.
    """
    texts = texts.select("table_name", "row_key", "kind", "text")
    bounds = limits.where(F.col("max_chars") >= 1).groupBy("table_name", "kind").agg(F.min("max_chars").alias("_max"), F.max(F.coalesce("overlap_chars", F.lit(0))).alias("_over"))
    bounds = bounds.withColumn("_over", F.greatest(F.lit(0), F.least("_over", F.col("_max") - 1)))
    long = texts.join(bounds, ["table_name", "kind"]).where(F.length("text") > F.col("_max")).dropDuplicates(["table_name", "row_key", "kind", "text"])
    room = F.col("_max") - F.col("_over")
    cut = long.withColumn("_p", F.regexp_extract_all("text", _pattern(room), F.lit(0)))
    # each piece is what was consumed before it, as far back as the overlap, and its own part: no piece looks at the whole text
    def grow(acc: Column, p: Column) -> Column:
        tail = F.length(acc["tail"])
        piece = F.struct((acc["at"] - tail).alias("start_char"), tail.alias("overlap"), F.concat(acc["tail"], p).alias("piece_text"))
        return F.struct((acc["at"] + F.length(p)).alias("at"), F.right(F.concat(acc["tail"], p), F.col("_over")).alias("tail"), F.concat(acc["all"], F.array(piece)).alias("all"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<start_char: int, overlap: int, piece_text: string>>").alias("all"))
    pieces = F.aggregate("_p", zero, grow, lambda acc: acc["all"])
    rows = cut.select("table_name", "row_key", F.posexplode(pieces).alias("i", "z"))
    return rows.select("table_name", "row_key", (F.col("i") + 1).alias("piece_no"), "z.start_char", "z.overlap", "z.piece_text")
