"""Metrics of rankings against expected sources, and of the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Optional columns of cases: what they expect besides sources. effective_*: the day or window asked for.
ASKED = {
    "expected_jurisdicao": "array<string>", "effective_on": "date", "effective_from": "date", "effective_to": "date", "rejection_test": "boolean", "expected_rejection": "boolean",
    "temporal_rejection_test": "boolean", "expected_temporal_rejection": "boolean",
}
#: Optional columns of rankings: what is known of a source.
KNOWN = {"jurisdicao": "string", "effective_from": "date", "effective_to": "date"}


def _optional(df: DataFrame, kinds: dict[str, str], prefix: str) -> list[Column]:
    """Optional columns under a prefix, null where the table has none; one jurisdiction is a list of one."""
    have = dict(df.dtypes)
    value = lambda c, kind: F.lit(None) if c not in have else F.filter(F.array(c), lambda x: x.isNotNull()) if kind.startswith("array") and have[c] == "string" else F.nullif(F.col(c), F.lit("")) if have[c] == "string" else F.col(c)
    return [value(c, kind).cast(kind).alias(prefix + c) for c, kind in kinds.items()]


def _compatible(hit: Column) -> Column:
    """Whether a ranked source is expected and valid when the case asks for; open ends hold, null where no time is asked for."""
    on, start, end, low, high = (F.col(c) for c in ("_effective_on", "_effective_from", "_effective_to", "of_effective_from", "of_effective_to"))
    yes = F.lit(True)
    day = F.coalesce(low <= on, yes) & F.coalesce(high >= on, yes)
    window = F.coalesce(low <= end, yes) & F.coalesce(high >= start, yes)
    return F.when(on.isNotNull() | start.isNotNull() | end.isNotNull(), hit & F.when(on.isNotNull(), day).otherwise(window))


def case_metrics(rankings: DataFrame, cases: DataFrame, ks: list[int]) -> DataFrame:
    """case_id with recall, nDCG (raw and by distinct source), false-positive rate and temporal rejection at each k, reciprocal rank, and what is right of the first place.

    rankings: case_id, rank (from 1), source, and those of KNOWN there are. cases: case_id, expected array<string>, and
    those of ASKED there are. Null where nothing is expected; a case_id that stands twice is an error. Without points a case
    is rejected. The raw nDCG counts every point of an expected source, so it can exceed 1. A point without a source is no false positive, but counts among the points.
    """
    asked = [f"_{c}" for c in ASKED]
    single = cases.select("case_id", "expected", *_optional(cases, ASKED, "_")).groupBy("case_id").agg(F.count("*").alias("_times"), *[F.first(c).alias(c) for c in ("expected", *asked)])
    twice = F.raise_error(F.concat(F.lit("case_id stands twice: "), F.col("case_id").cast("string")))
    single = single.withColumn("expected", F.when(F.col("_times") > 1, twice).otherwise(F.col("expected")))
    joined = single.join(rankings.select("case_id", "rank", "source", *_optional(rankings, KNOWN, "of_")), "case_id", "left")
    hit = F.array_contains("expected", F.col("source"))
    rows = joined.withColumn("hit", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumn("fits", _compatible(F.col("hit")))
    # the first place of each expected source
    firsts = rows.where("hit").groupBy("case_id", "source").agg(F.min("rank").alias("rank")).select("case_id", "rank", F.lit(True).alias("first"))
    rows = rows.join(firsts, ["case_id", "rank"], "left")
    n = F.size(F.array_distinct("expected")).cast("double")
    gain = 1 / F.log2(F.col("rank") + 1.0)
    aggs = [F.first("expected").alias("expected"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("_first"), F.count("rank").alias("_points"), F.min_by(F.struct("hit", "of_jurisdicao", "fits"), "rank").alias("_top")]
    aggs += [F.first(c).alias(c) for c in asked]
    for k in ks:
        top = F.col("rank") <= k
        aggs += [
            F.count_distinct(F.when(top & F.col("hit"), F.col("source"))).cast("double").alias(f"_found_{k}"),
            F.sum(F.when(top & F.col("hit"), gain).otherwise(0.0)).alias(f"_dcg_{k}"),
            F.sum(F.when(top & F.col("first"), gain).otherwise(0.0)).alias(f"_dcg1_{k}"),
            F.coalesce(F.avg(F.when(top, (~F.col("hit") & (F.length(F.coalesce("source", F.lit(""))) > 0)).cast("double"))), F.lit(0.0)).alias(f"fp_rate_{k}"),
            F.coalesce(F.max(top & F.col("fits")), F.lit(False)).alias(f"_fits_{k}"),
        ]
    got = rows.groupBy("case_id").agg(*aggs)
    some, no = n > 0, F.lit(False)
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(float(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rejected = F.col("_points") == 0
    out = [
        F.col("case_id"), F.when(some, F.coalesce(1.0 / F.col("_first"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(some, F.coalesce("_top.hit", no)).alias("regime_correct"),
        F.when(F.size("_expected_jurisdicao") > 0, F.coalesce(F.array_contains("_expected_jurisdicao", F.col("_top.of_jurisdicao")), no)).alias("jurisdiction_correct"),
        F.col("_top.fits").alias("temporal_correct"), rejected.alias("retrieval_rejected"),
        F.when(F.col("_rejection_test"), F.coalesce("_expected_rejection", no) == rejected).alias("rejection_correct"),
    ]
    for k in ks:
        out += [
            F.when(some, F.col(f"_found_{k}") / n).alias(f"recall_{k}"),
            F.when(some, F.col(f"_dcg_{k}") / ideal(k)).alias(f"ndcg_raw_{k}"),
            F.when(some, F.col(f"_dcg1_{k}") / ideal(k)).alias(f"ndcg_{k}"),
            F.when(some, F.col(f"fp_rate_{k}")).alias(f"fp_rate_{k}"),
            F.when(F.col("_temporal_rejection_test"), ~F.col(f"_fits_{k}") == F.coalesce("_expected_temporal_rejection", F.lit(True))).alias(f"temporal_rejection_correct_{k}"),
        ]
    return got.select(*out)


def _with_faults(cases: DataFrame, required: list[str], key: str, checks: dict[str, Column]) -> DataFrame:
    """Cases with an array of what is wrong with them: required fields that are missing, ids that stand twice, and more."""
    have = set(cases.columns)
    marks = [F.when(F.col(c).isNull() if c in have else F.lit(True), c) for c in required] + [F.when(bad, name) for name, bad in checks.items()]
    if key in have:
        times = cases.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("_id")).agg((F.count("*") > 1).alias("_twice"))
        cases = cases.join(times, F.col(key).cast("string") == F.col("_id"), "left")
        marks.append(F.when(F.col("_twice"), "duplicate"))
    return cases.withColumn("faults", F.filter(F.array(*marks), lambda x: x.isNotNull())).drop("_id", "_twice")


def case_faults(cases: DataFrame, key: str = "case_id", expected: str = "expected") -> DataFrame:
    """Cases with what is wrong with them: fields missing, ids that stand twice, nothing expected without a rejection test, values of another type."""
    kinds = dict(cases.dtypes)
    checks = {}
    if kinds.get(expected, "array").startswith("array"):
        if expected in kinds:
            rejects = F.coalesce("rejection_test", F.lit(False)) if kinds.get("rejection_test") == "boolean" else F.lit(False)
            checks["no source expected"] = (F.size(expected) == 0) & ~rejects
    else:
        checks[f"{expected}: type"] = F.col(expected).isNotNull()
    for c in ("rejection_test", "expected_rejection", "temporal_rejection_test", "expected_temporal_rejection"):
        if kinds.get(c, "boolean") not in ("boolean", "void"):
            checks[f"{c}: type"] = F.col(c).isNotNull()
    for c in ("expected_jurisdicao", "expected_article_refs", "expected_device_ids", "expected_unit_ids"):
        if kinds.get(c) == "array<string>":
            checks[f"{c}: type"] = F.exists(c, lambda x: x.isNull())
        elif c in kinds and kinds[c] != "void" and not (c == "expected_jurisdicao" and kinds[c] == "string"):
            checks[f"{c}: type"] = F.col(c).isNotNull()
    for c in ("effective_on", "effective_from", "effective_to"):
        if kinds.get(c) == "string":
            checks[f"{c}: date"] = (F.length(c) > 0) & F.try_to_date(c, "yyyy-MM-dd").isNull()
        elif kinds.get(c, "date") not in ("date", "void"):
            checks[f"{c}: date"] = F.col(c).isNotNull()
    return _with_faults(cases, [key, "query", expected], key, checks)


def gate_case_faults(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases of the gate with what is wrong with them: fields missing, ids that stand twice, no sources or some without text, values of another type."""
    kinds = dict(cases.dtypes)
    checks = {}
    if "sources" in kinds:
        kind = kinds["sources"]
        if kind == "array<string>":
            empty = F.exists("sources", lambda x: F.length(F.coalesce(x, F.lit(""))) == 0)
        elif kind.startswith("array<struct"):
            parts = [f.name for f in cases.schema["sources"].dataType.elementType if f.name in ("text", "page_content")]
            empty = F.exists("sources", lambda x: F.length(F.concat(F.lit(""), *[F.coalesce(x[p].cast("string"), F.lit("")) for p in parts])) == 0)
        else:
            empty = F.col("sources").isNotNull()
        checks |= {"no sources": F.size("sources") == 0 if kind.startswith("array") else F.lit(False), "source without text": empty}
    if kinds.get("expected_accept", "boolean") != "boolean":
        checks["expected_accept: type"] = F.col("expected_accept").isNotNull()
    return _with_faults(cases, [key, "answer", "expected_accept", "sources"], key, checks)


def summary(metrics: DataFrame) -> DataFrame:
    """Means over the cases, nulls left out; of what is right or wrong, its share."""
    return metrics.agg(F.count("*").alias("cases"), *[F.avg(F.col(c).cast("double")).alias(c) for c in metrics.columns if c != "case_id"])


def device_key(device_id: Column, unit_id: Column) -> Column:
    """What a device is known by: its own id, else that of its unit; blank counts as none."""
    return F.coalesce(F.nullif(F.trim(device_id), F.lit("")), F.nullif(F.trim(unit_id), F.lit("")))


def reference_metrics(rankings: DataFrame, cases: DataFrame, ks: list[int]) -> DataFrame:
    """case_id, recall_k and fp_rate_k of references (articles, or devices by ``device_key``), each expected one once.

    rankings: case_id, rank (from 1), ref (null or blank: none). cases: case_id, expected array<string>; blank entries don't count.
    Recall is of distinct references; the rate is of all points, so one without reference is no false one but counts. Null where nothing is expected.
    """
    clean = F.array_distinct(F.filter(F.transform("expected", lambda x: F.trim(x)), lambda x: F.length(x) > 0))
    wanted = cases.select("case_id", F.coalesce(clean, F.array().cast("array<string>")).alias("_e"))
    rows = wanted.join(rankings.select("case_id", "rank", F.trim("ref").alias("_r")), "case_id", "left")
    filled = F.length(F.coalesce("_r", F.lit(""))) > 0
    hit = filled & F.array_contains("_e", F.col("_r"))
    some = F.size(F.first("_e")) > 0
    out = []
    for k in ks:
        top = F.col("rank") <= k
        out += [
            F.when(some, F.count_distinct(F.when(top & hit, F.col("_r"))) / F.size(F.first("_e"))).alias(f"recall_{k}"),
            F.when(some, F.coalesce(F.avg(F.when(top, (filled & ~F.array_contains("_e", F.col("_r"))).cast("double"))), F.lit(0.0))).alias(f"fp_rate_{k}"),
        ]
    return rows.groupBy("case_id").agg(*out)


def temporal_match(on: Column, start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether a validity interval [low, high] holds a day, or meets a window [start, end]; null where nothing is asked or known."""
    asked = on.isNotNull() | start.isNotNull() | end.isNotNull()
    known = low.isNotNull() & high.isNotNull()
    day = (low <= on) & (high >= on)
    window = (F.coalesce(low <= end, F.lit(True))) & (F.coalesce(high >= start, F.lit(True)))
    return F.when(asked & known, F.when(on.isNotNull(), day).otherwise(window))


def gate_rates(verdicts: DataFrame) -> DataFrame:
    """Rates of the gate. verdicts: expected_accept, accepted (boolean)."""
    right = (F.col("expected_accept") == F.col("accepted")).cast("double")
    bad, good = ~F.col("expected_accept"), F.col("expected_accept")
    took = F.col("accepted").cast("double")
    return verdicts.agg(
        F.count("*").alias("cases"),
        F.avg(right).alias("accuracy"),
        F.avg(F.when(bad, 1 - took)).alias("correct_rejection"),
        F.avg(F.when(bad, took)).alias("false_accept"),
        F.avg(F.when(good, took)).alias("correct_acceptance"),
        F.avg(1 - took).alias("observed_rejection"),
    )


def below(summary_row: dict, least: dict[str, float]) -> list[str]:
    """Metrics under their least value, for a strict run."""
    return [f"{k}: {summary_row.get(k)} < {v}" for k, v in least.items() if (summary_row.get(k) or 0.0) < v]
