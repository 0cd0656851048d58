"""One surviving record per group of duplicates, field by field.

Skyline selection. A row is described by which fields it fills, by the trust of its origin and by how recent it is. Per
group, rows are first reduced to cells (filled fields, trust): the most recent row of a cell stands for it, an ordinary
partial aggregation, so that a group of any size comes down to at most 32 x levels cells before anything is gathered.
A cell is dominated by one that fills at least the same fields with at least the same trust and is as recent or more so.
From the undominated cells the lexicographic policy (trust, then recency, then smallest id) resolves each field among
those that fill it; a field none of them fills is taken from the next layer of dominance, by the same policy.

Why one layer is enough where ids are unique: a row that dominates a field's best row also fills the field and comes
before it in the policy. The layers are kept for other policies and cost nothing when they are not needed.

Defined results: rows without a court, or without the numbers that name a decision, stand alone; null origin or one not
in the catalogue has the least trust; a null time is the oldest; ties go to the smallest id; rows repeated whole count
as rows of the group; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import timestamps

FIELDS = ["data", "data_publicacao", "relator", "orgao_julgador", "situacao"]
DATES = ["data", "data_publicacao"]
#: Folded names of the courts.
COURTS = {
    "TCU": "TCU", "TRIBUNALDECONTASDAUNIAO": "TCU",
    "TCESP": "TCESP", "TRIBUNALDECONTASDOESTADODESAOPAULO": "TCESP", "TRIBUNALDECONTASDESAOPAULO": "TCESP",
    "STJ": "STJ", "SUPERIORTRIBUNALDEJUSTICA": "STJ",
    "STF": "STF", "SUPREMOTRIBUNALFEDERAL": "STF",
    "TJSP": "TJSP", "TRIBUNALDEJUSTICADESAOPAULO": "TJSP", "TRIBUNALDEJUSTICADOESTADODESAOPAULO": "TJSP",
}
NO_TRUST = 1_000_000


def court(c: Column) -> Column:
    """The court's short name whatever its spelling; null where there is none."""
    key = F.nullif(X.alnum_key(c), F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COURTS.items() for x in kv]), key), key)


def decision_key(df: DataFrame) -> Column:
    """The group of a row; null where it names no decision."""
    process, decision, sumula = (F.nullif(X.alnum_key(F.col(c)), F.lit("")) for c in ("numero_processo", "numero_decisao", "numero_sumula"))
    is_sumula = F.coalesce(X.alnum_key(F.col("tipo_documento")) == "SUMULA", F.lit(False)) | (process.isNull() & decision.isNull() & sumula.isNotNull())
    return F.when(is_sumula, F.concat_ws("|", F.lit("S"), court(F.col("tribunal")), F.when(court(F.col("tribunal")).isNotNull(), sumula))).otherwise(
        F.when(court(F.col("tribunal")).isNotNull() & process.isNotNull() & decision.isNotNull(), F.concat_ws("|", F.lit("D"), court(F.col("tribunal")), process, decision))
    )


def says_something(c: Column) -> Column:
    """Not null, blank, a dash or words for not known."""
    low = F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    return F.coalesce(~low.isin(*sorted(timestamps.FILLERS)) & low.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def described(decisions: DataFrame, catalogue: DataFrame, whole: bool = False) -> DataFrame:
    """record_id, group_key, mask (bit i: field i is filled), trust, seen (microseconds); whole: also _version and, for each of OTHERS, whether it says something."""
    more = {"_version": content_version(decisions)} | {f"_f_{c}": says_something(F.col(c)) for c in OTHERS} if whole else {}
    trust = catalogue.groupBy(F.col("title").alias("_title")).agg(F.min("authority_level").alias("_level"))
    zone = timestamps.zone_table(decisions.sparkSession)
    key = decision_key(decisions)
    rows = decisions.select("record_id", "origem", *FIELDS, F.when(key.rlike(r"^[SD]\|.+\|.+"), key).alias("group_key"), F.col("retrieved_at").alias("_at"), *[c.alias(k) for k, c in more.items()])
    # both dates in one call: one pass through Python
    both = rows.withColumns({f"_p_{c}": timestamps.parsed(F.col(c).cast("string"), zone) for c in DATES})
    filled = lambda c: F.coalesce(F.col(f"_p_{c}.kind").isin("day", "instant", "epoch"), F.lit(False)) if c in DATES else says_something(F.col(c))
    mask = reduce(lambda a, b: a + b, [F.when(filled(c), F.lit(1 << i)).otherwise(0) for i, c in enumerate(FIELDS)])
    seen = F.coalesce(F.unix_micros("_at"), F.lit(-(2**62)))
    return both.join(trust, both["origem"] == trust["_title"], "left").select(
        "record_id", "group_key", mask.cast("int").alias("mask"), F.coalesce("_level", F.lit(NO_TRUST)).cast("int").alias("trust"), seen.alias("seen"), *more
    )


def _dominates(d: Column, c: Column) -> Column:
    """d fills what c fills, is trusted and recent at least as much; ids make recency strict, so never both ways."""
    newer = (d["seen"] > c["seen"]) | ((d["seen"] == c["seen"]) & (d["record_id"] < c["record_id"]))
    return (d["mask"].bitwiseAND(c["mask"]) == c["mask"]) & (d["trust"] <= c["trust"]) & newer


def skyline_sources(rows: DataFrame) -> DataFrame:
    """group_key, n_rows, n_skyline, and for each field the record_id that supplies it (null: filled nowhere)."""
    best = F.max(F.struct("seen", (-F.col("record_id")).alias("neg"))).alias("best")
    cells = rows.where(F.col("group_key").isNotNull()).groupBy("group_key", "mask", "trust").agg(best, F.count("*").alias("n"))
    cell = F.struct(F.col("mask"), F.col("trust"), F.col("best.seen").alias("seen"), (-F.col("best.neg")).alias("record_id"))
    groups = cells.groupBy("group_key").agg(F.sum("n").alias("n_rows"), F.collect_list(cell).alias("cells"))
    undominated = lambda cs: F.filter(cs, lambda c: ~F.exists(cs, lambda d: _dominates(d, c)))
    groups = groups.withColumn("first", undominated(F.col("cells")))
    groups = groups.withColumn("rest", F.array_except("cells", "first"))

    def winner(cs: Column, bit: int) -> Column:
        able = F.filter(cs, lambda c: c["mask"].bitwiseAND(F.lit(1 << bit)) != 0)
        return F.array_min(F.transform(able, lambda c: F.struct(c["trust"].alias("trust"), (-c["seen"]).alias("old"), c["record_id"].alias("record_id"))))["record_id"]

    picks = [F.coalesce(winner(F.col("first"), i), winner(F.col("rest"), i)).alias(f) for i, f in enumerate(FIELDS)]
    return groups.select("group_key", "n_rows", F.size("first").alias("n_skyline"), *picks)


def field_sources(decisions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """record_id, field_name: the rows that supply the fields of groups of two or more."""
    got = skyline_sources(described(decisions, catalogue)).where(F.col("n_rows") >= 2)
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("record_id")) for f in FIELDS])
    return got.select(F.explode(pairs).alias("p")).select("p.record_id", "p.field_name").where(F.col("record_id").isNotNull()).distinct()


#: Fields beside FIELDS that a surviving record takes, by the same policy, from the best row that fills them.
OTHERS = ["tribunal", "tipo_documento", "numero_processo", "numero_decisao", "numero_sumula", "ementa", "tese", "decisao", "inteiro_teor", "url_oficial", "tipo_decisao", "data_autuacao", "origem"]


def content_version(df: DataFrame) -> Column:
    """version_sha256, or where it is missing a hash of the content's own columns, marked as such."""
    own = F.sha2(F.to_json(F.struct(*[F.col(c) for c in ("ementa", "tese", "decisao", "inteiro_teor")]), {"ignoreNullFields": "false"}), 256)
    return F.coalesce(X.blank_to_null(F.col("version_sha256")), F.concat(F.lit("own:"), own))


def survivors(decisions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One record for each decision: the fields' values with the rows they come from, rows and versions counted.

    A row that names no decision is its own group. Values are fetched by a join on the unique record_id, so that no
    group's texts are gathered in one place.
    """
    rows = described(decisions, catalogue, True).withColumn("group_key", F.coalesce("group_key", F.concat(F.lit("R|"), F.col("record_id").cast("string"))))
    picks = skyline_sources(rows)
    order = F.struct("trust", (-F.col("seen")).alias("old"), "record_id")
    versions = rows.groupBy("group_key", "_version").agg(*[F.min(F.when(F.col(f"_f_{c}"), order)).alias(c) for c in OTHERS])
    rest = versions.groupBy("group_key").agg(F.count("*").alias("n_versions"), *[F.min(c)["record_id"].alias(c) for c in OTHERS])
    every = picks.join(rest, "group_key")
    names = [*FIELDS, *OTHERS]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("record_id")) for f in names])).alias("p")
    wanted = every.select("group_key", pairs).select("group_key", "p.field", "p.record_id").where(F.col("record_id").isNotNull())
    per_row = wanted.groupBy("group_key", "record_id").agg(F.collect_set("field").alias("fields"))  # at most one entry a field
    values = per_row.join(decisions.select("record_id", *names), "record_id")
    built = values.groupBy("group_key").agg(*[F.max(F.when(F.array_contains("fields", f), F.col(f).cast("string"))).alias(f) for f in names])
    sources = every.select("group_key", "n_rows", "n_versions", "n_skyline", F.struct(*[F.col(f) for f in names]).alias("taken_from"))
    return sources.join(built, "group_key")
