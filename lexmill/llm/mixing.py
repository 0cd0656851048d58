"""A mix of sources with target shares of all tokens, small sources repeated up to a cap.

Poisson replication. A text of a source appears k times, k drawn by inverting the distribution function of a Poisson
variable at a number in (0, 1) that is a hash of seed, source and text; k is cut at the cap, and the rate is solved for
the mean the source needs after the cut. The total size of the mix is the largest at which no source needs a mean above
its cap, so the source that binds is repeated exactly as often as it may be. Texts repeated under other ids of a source are
one text: the cap holds for the text.

Copies are drawn where the texts lie, as the draw needs nothing but seed, source and the text's hash; only chosen copies
move, once, to the partition that the hash of text and copy names, repeated texts made one on the way (partial aggregation, so
a text that a third of all rows repeat reaches the shuffle once a task). Within a partition they are ordered by a last hash: each partition
is a random part of the mix in random order, which is a global shuffle.

The vocabulary's file is read where the plan is made and brought to the workers; they need no file.

Defined results: null texts and sources without target are left out; a target without texts is reported with no tokens
and its share is spread over the others in proportion; a text of no tokens takes part with size 0; ties in the order
of the shuffle go by id and copy; texts are counted whole at any length; an empty table gives an empty mix.
"""

from __future__ import annotations

import base64
import math
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import worker
from lexmill.session import cut

#: byte_bpe_multi_50k, a byte-level BPE of 50,256 ids for many languages; the path is a parameter of every operator.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The usual split of byte-level BPE vocabularies of this family; fixed, as the vocabulary was made with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 20240501


def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, spark: SparkSession, path: str = TOKENIZER) -> Column:
    """Tokens of a text; null for null."""
    held, call = spark.sparkContext.broadcast(Path(path).read_bytes()), worker.token()

    @F.pandas_udf(T.LongType())
    def count(v: pd.Series) -> pd.Series:
        enc = worker.once(call, lambda: _encoding(held.value))
        return pd.Series([None if x is None else len(enc.encode_ordinary(x)) for x in v], dtype="Int64")

    return count(text)


def capped_mean(rate: float, cap: int) -> float:
    """Mean of a Poisson variable of this rate cut at cap."""
    return sum(1 - c for c in poisson_cdf(rate, cap))


def poisson_cdf(rate: float, n: int) -> list[float]:
    """P(k <= 0), ..., P(k <= n - 1)."""
    p, total, out = math.exp(-rate), 0.0, []
    for k in range(n):
        total += p
        out.append(min(total, 1.0))
        p *= rate / (k + 1)
    return out


def thresholds(mean: float, cap: int) -> list[float]:
    """Numbers below which a uniform draw gives at most 0, 1, ... copies; the draw is the count of those it reaches."""
    if mean >= cap - 1e-12:
        return [0.0] * cap
    if mean <= 0:
        return [2.0] * cap
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < mean and high < 600:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < mean else (low, mid)
    return poisson_cdf(high, cap)


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, dict]:
    """For each source with tokens and a target: share, mean repetitions, cap, thresholds. targets: source, share, cap."""
    usable = [(s, w, c) for s, w, c in targets if sizes.get(s, 0) > 0 and w and w > 0 and c and c > 0]
    whole = sum(w for _, w, _ in usable)
    if not usable:
        return {}
    total = min(c * sizes[s] / (w / whole) for s, w, c in usable)
    out = {}
    for s, w, c in usable:
        mean = min(total * w / whole / sizes[s], c)
        out[s] = {"share": w / whole, "mean": mean, "cap": c, "at": thresholds(mean, c)}
    return out


def _texts(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, source, text_sha, text of the sources with a target."""
    return documents.where(F.col("text").isNotNull()).select("doc_id", "source", F.sha2("text", 256).alias("text_sha"), "text").join(targets.select("source").distinct(), "source", "left_semi")


def sized_texts(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, text_sha, n_tokens: each distinct text of a source once, under its smallest doc_id.

    Written out (checkpoint), as sizes are needed for the plan and again for the mix.
    """
    # copies of a text have equal sizes: counted where they lie, so no text is shuffled; the smallest id stands for them
    counted = _texts(documents, targets).select("doc_id", "source", "text_sha", token_count(F.col("text"), documents.sparkSession, path).alias("n_tokens"))
    return cut(counted.groupBy("source", "text_sha").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")))


def _planned(sized: DataFrame, targets: DataFrame) -> tuple[dict[str, dict], dict[str, int], list[tuple[str, float, int]]]:
    """The plan; gathers one row for each target."""
    goals = [(r["source"], r["share"], r["cap"]) for r in targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")).collect()]
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    return plan(sizes, sorted(goals)), sizes, goals


def _copies(goals: dict[str, dict], seed: int) -> Column:
    """How often a text appears, from source and text_sha alone."""
    at = F.element_at(F.create_map(*[x for s, g in sorted(goals.items()) for x in (F.lit(s), F.array(*[F.lit(float(v)) for v in g["at"]]))]), F.col("source"))
    uniform = (F.xxhash64(F.lit(seed), "source", "text_sha").bitwiseAND(F.lit(2**52 - 1)).cast("double") + 0.5) / float(2**52)
    # a sum of comparisons, one for each repeat allowed: filters on it can be passed through joins, those on array functions can't
    reached = [F.coalesce(F.get(at, F.lit(k)) <= uniform, F.lit(False)).cast("int") for k in range(max(len(g["at"]) for g in goals.values()))]
    return reduce(lambda a, b: a + b, reached)


def drawn(sized: DataFrame, goals: dict[str, dict], seed: int = SEED) -> DataFrame:
    """doc_id, source, text_sha, n_tokens, copies (0 or more)."""
    if not goals:
        return sized.select("doc_id", "source", "text_sha", "n_tokens", F.lit(0).alias("copies")).limit(0)
    return sized.where(F.col("source").isin(*goals)).select("doc_id", "source", "text_sha", "n_tokens", _copies(goals, seed).alias("copies"))


def mix(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """doc_id, source, copy_no, n_tokens, shuffle_key, text: partitions by hash, each in the order of shuffle_key."""
    sized = sized_texts(documents, targets, path)
    goals, _, _ = _planned(sized, targets)
    copy_no = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no")
    chosen = drawn(sized, goals, seed).where(F.col("copies") > 0).select("source", "text_sha", copy_no, "doc_id", "n_tokens")
    texts = _texts(documents, targets)
    texts = texts.where(F.col("source").isin(*goals)).withColumn("copies", _copies(goals, seed)) if goals else texts.withColumn("copies", F.lit(0)).limit(0)
    moved = texts.where(F.col("copies") > 0).select("source", "text_sha", copy_no, "text").groupBy("source", "text_sha", "copy_no").agg(F.first("text").alias("text"))
    # both sides come by the same hash, so the texts move once
    full = moved.join(chosen.hint("shuffle_hash"), ["source", "text_sha", "copy_no"])
    keyed = full.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no"))
    return keyed.select("doc_id", "source", "copy_no", "n_tokens", "shuffle_key", "text").sortWithinPartitions("shuffle_key", "doc_id", "copy_no")


def shares(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """For each target: its share, the share aimed at, what was there and what the mix reached."""
    spark = documents.sparkSession
    sized = sized_texts(documents, targets, path)
    goals, sizes, wanted = _planned(sized, targets)
    got = drawn(sized, goals, seed).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_repeats"), F.sum("copies").alias("mix_rows")
    )
    schema = "source string, target_share double, aimed_share double, max_repeats int, source_tokens long, mean_repeats double"
    rows = [(s, w, (goals.get(s) or {}).get("share", 0.0), c, sizes.get(s, 0), (goals.get(s) or {}).get("mean", 0.0)) for s, w, c in wanted]
    known = spark.createDataFrame(rows, schema).join(got, "source", "left").fillna(0, ["mix_tokens", "most_repeats", "mix_rows"])
    whole = F.sum("mix_tokens").over(Window.partitionBy(F.lit(1)))  # a row for each target, no more
    return known.withColumn("reached_share", F.coalesce(F.try_divide("mix_tokens", whole), F.lit(0.0)))
