"""Court records: keys, versions, checks, deduplication, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.ordering import numbered

COURTS = ["TCU", "TCESP", "STJ", "STF", "TJSP"]
VOLATILE = ["retrieved_at", "loaded_at", "version_sha256", "sha256"]
#: Names of courts as they are written, folded and in upper case.
COURT_NAMES = {
    "TCE-SP": "TCESP", "TCE SP": "TCESP", "TJ-SP": "TJSP", "TRIBUNAL DE CONTAS DA UNIAO": "TCU", "TRIBUNAL DE CONTAS DO ESTADO DE SAO PAULO": "TCESP", "SUPERIOR TRIBUNAL DE JUSTICA": "STJ", "SUPREMO TRIBUNAL FEDERAL": "STF",
    "TRIBUNAL DE JUSTICA DE SAO PAULO": "TJSP",
}
#: Fields of a record and the names they go by in the courts' answers, in the order in which they are tried.
ALIASES = {
    "tribunal": ["TRIBUNAL", "siglaTribunal", "tribunal_sigla", "orgaoTribunal"],
    "tipo_documento": ["TIPO_DOCUMENTO", "tipoDocumento", "document_type"],
    "numero_processo": ["NUMPROCESSO", "NUMPROCESSO_FORMATADO", "numeroProcesso", "processo", "processo_numero", "numeroProcessoFormatado", "KEY", "key", "id"],
    "numero_sumula": ["NUMSUMULA", "numeroSumula", "sumula_numero"],
    "numero_decisao": ["NUMACORDAO", "numeroAcordao", "NUMACORDAOINT", "numeroDecisao", "acordao_numero"],
    "orgao_julgador": ["COLEGIADO", "colegiado", "CODCOLEGIADO", "orgaoJulgador", "nomeOrgaoJulgador"],
    "relator": ["RELATOR", "relator_nome", "ministroRelator", "relator_processo_nome", "relator_acordao_nome"],
    "data": ["DATASESSAO", "DTSESSAO", "dataSessao", "dataSessaoFormatada", "dataJulgamento", "julgamento_data"],
    "data_publicacao": ["DATAPUBLICACAO", "dataPublicacao", "publicacao_data"],
    "data_autuacao": ["dataAutuacao", "DATAAUTUACAO"],
    "ementa": ["SUMARIO", "sumario", "EMENTA", "titulo", "TITULO", "ementa_texto"],
    "tese": ["TESE", "teseJuridica", "documental_tese_texto"],
    "decisao": ["ACORDAO", "acordao", "decisao_texto"],
    "inteiro_teor": ["inteiroTeor", "inteiro_teor_texto"],
    "url_oficial": ["URLACORDAO", "urlAcordao", "URL", "url", "inteiro_teor_url"],
    "tipo_decisao": ["TIPO", "tipo", "tipoDeDecisao"],
    "assunto": ["AREA", "area", "TEMA", "tema", "SUBTEMA", "subtema", "assuntos"],
    "partes": ["PARTES", "partes_lista_texto", "partesLista"],
}
LISTS = ["assunto", "partes"]


def court(c: Column) -> Column:
    """Short name of a court from any of its spellings; a name that isn't known in upper case, null stays null."""
    bare = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    names = F.create_map(*[F.lit(x) for pair in COURT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.upper(X.unmark(F.regexp_replace(bare, r"\p{Mn}", "")))), F.upper(bare))


def normalized(df: DataFrame) -> DataFrame:
    """Records with their fields' own names, each the first filled of those the table has, short names of courts, and lists as lists.

    Goes before checks, keys and limits. Columns that are no field are kept.
    """
    kinds, made = dict(df.dtypes), {}

    def as_list(n: str) -> Column:
        c = F.col(n)
        if kinds[n].startswith("array"):
            return F.filter(F.transform(c, lambda x: F.trim(x.cast("string"))), lambda x: F.length(x) > 0)
        return X.split_list(F.nullif(c.cast("string"), F.lit("")))

    for field, others in ALIASES.items():
        names = [n for n in (field, *others) if n in kinds]
        if names and field in LISTS:
            made[field] = F.coalesce(*[as_list(n) for n in names], F.array().cast("array<string>"))
        elif len(names) > 1 or names and names != [field]:
            made[field] = F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names], F.col(names[0]).cast("string"))
        if names and field == "tribunal":
            made[field] = court(made.get(field, F.col(field)))
    taken = {c.lower() for c in made}  # names of columns are the same in either case
    kept = [made[c].alias(c) if c in made else F.col(c) for c in df.columns if c in made or c.lower() not in taken]
    return df.select(*kept, *[x.alias(c) for c, x in made.items() if c not in kinds])


def document_key(df: DataFrame) -> Column:
    """Twenty hex digits that name a document: its court, type and numbers; its text or address where those are missing."""
    part = lambda c: F.coalesce(X.squeeze(F.col(c)), F.lit(""))
    none = lambda c: F.length(part(c)) == 0
    parts = [part(c) for c in ("tribunal", "tipo_documento", "numero_processo", "numero_sumula", "numero_decisao", "tipo_decisao")]
    joined = F.concat_ws("|", *parts, F.when(none("numero_decisao"), F.substring(part("ementa"), 1, 800)), F.when(none("numero_processo"), X.without_session(part("url_oficial"))))
    return F.substring(F.sha2(joined, 256), 1, 20)


def version_hash(df: DataFrame, columns: list[str]) -> Column:
    """Hash of the content: columns in the order of their names as compact JSON, nulls kept, addresses without session."""
    cols = [(X.without_session(F.col(c)) if c.startswith("url") else F.col(c)).alias(c) for c in sorted(set(columns) - set(VOLATILE))]
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def faults(df: DataFrame) -> Column:
    """Everything wrong with a record, as an array of reasons; empty where it is good."""
    sumula = F.coalesce(F.col("tipo_documento") == "sumula", F.lit(False))
    filled = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    checks = [
        F.when(~F.coalesce(F.upper(F.trim("tribunal")).isin(*COURTS), F.lit(False)), "tribunal"),
        F.when(~sumula & ~filled("numero_processo"), "numero_processo"),
        F.when(sumula & ~F.coalesce(F.col("numero_sumula").rlike(r"^\d+$"), F.lit(False)), "numero_sumula"),
        F.when(filled("url_oficial") & ~F.col("url_oficial").rlike(r"^https?://"), "url_oficial"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def split_good_bad(df: DataFrame, stage: str = "validate") -> tuple[DataFrame, DataFrame]:
    """Good records, and the bad with stage and reasons for the dead-letter table; both normalised."""
    df = normalized(df)
    marked = df.withColumn("error", faults(df))
    return marked.where(F.size("error") == 0).drop("error"), marked.where(F.size("error") > 0).withColumn("stage", F.lit(stage))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in this order. The order must be strict."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def keep_best(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each group with the least order struct; an aggregation, for groups of any size."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(order.alias("_o"), F.struct(*others).alias("_r"))).alias("_m")).select(*keys, *[F.col(f"_m._r.{c}").alias(c) for c in others])


def index_text(df: DataFrame) -> Column:
    """A record as labelled lines; the long parts stand apart."""
    line = lambda name, c: F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0, F.concat(F.lit(f"{name}: "), F.trim(F.col(c))))
    part = lambda name, c: F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0, F.concat(F.lit(f"\n{name}:\n"), F.trim(F.col(c))))
    heads = [line(n, c) for n, c in (("TRIBUNAL", "tribunal"), ("PROCESSO", "numero_processo"), ("SÚMULA", "numero_sumula"), ("DECISÃO Nº", "numero_decisao"), ("RELATOR", "relator"), ("ÓRGÃO", "orgao_julgador"), ("SITUAÇÃO", "situacao"))]
    return F.concat_ws("\n", *heads, *[part(n, c) for n, c in (("EMENTA", "ementa"), ("TESE", "tese"), ("DECISÃO", "decisao"), ("INTEIRO TEOR", "inteiro_teor"))])


def article_text(df: DataFrame) -> Column:
    """An article as labelled lines, then its text; author, section and keywords only where there are any."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))
    some = lambda name, c: F.when(F.length(F.col(c)) > 0, line(name, c))
    heads = [line("FONTE", "orgao"), line("TÍTULO", "title"), line("DATA_PUBLICACAO", "date_publicacao"), some("AUTOR", "autor"), some("SECAO", "secao"), some("PALAVRAS_CHAVE", "palavras_chave"), line("URL", "url")]
    return F.regexp_replace(F.concat_ws("\n", *heads, F.lit(""), F.coalesce("texto", F.lit(""))), r"^\s+|\s+$", "")


def group_cap(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows of each group, a limit that is asked for: the first in this order, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)


def interleave(df: DataFrame, arm: str, order: list[Column]) -> DataFrame:
    """Places rows of several arms in turn: turn (of the arm), then arm. An arm of any size is numbered in many tasks."""
    return numbered(df, [arm], order, "turn")


def too_few(df: DataFrame, group: str, least: int) -> DataFrame:
    """Groups with fewer rows than asked for."""
    return df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < least)


def alias_values(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Canonical columns, each the first filled of its aliases that the table has."""
    have = set(df.columns)
    return df.select(*[X.first_filled(*[F.col(a).cast("string") for a in names if a in have]).alias(c) if set(names) & have else F.lit(None).cast("string").alias(c) for c, names in groups.items()])


def sumula_number(c: Column) -> Column:
    """247.0 as 247; null for what is no number."""
    return F.try_to_number(F.regexp_extract(F.trim(c), r"^(\d+)(?:\.0+)?$", 1), F.lit("999999999")).cast("int")
