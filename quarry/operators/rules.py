"""What the fields of a document give by rule, before any model is asked (P10): for each document type a list of Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import scalars as S

#: Separators of lists of names and of key words.
SEPARATORS = "[;，,]"
#: Fixed pattern: the first number of an amount, thousands separators taken out.
AMOUNT = r"(\d+(?:\.\d+)?)"


def field(df: DataFrame, name: str) -> Column:
    """A field as text, null where the table has no such column or the text is empty."""
    text = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    return F.when(text != "", text)


def date(name: str) -> Callable[[DataFrame], Column]:
    return lambda df: S.normalize_date(field(df, name))


def amount(name: str) -> Callable[[DataFrame], Column]:
    def of(df: DataFrame) -> Column:
        found = F.regexp_extract(F.replace(field(df, name), F.lit(",")), AMOUNT, 1)
        return F.when(found != "", found).cast("double")

    return of


def names(name: str) -> Callable[[DataFrame], Column]:
    """A list as it is, without empty entries; a text split at the separators."""

    def of(df: DataFrame) -> Column:
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
            return F.transform(F.filter(F.col(name).cast("array<string>"), lambda x: x != ""), S.strip)
        text = field(df, name)
        return F.when(text.isNotNull(), S.split_list(text, SEPARATORS))

    return of


def first_of(*found: Column) -> Column:
    return F.coalesce(*found)


def patent_number(kind: str) -> Callable[[DataFrame], Column]:
    """The number in the first field that has a Chinese or an international one; a Chinese number goes first within a field."""

    def of(df: DataFrame) -> Column:
        fields = [field(df, c) for c in ("raw_AN", "application_number", "title")]
        domestic = [S.identifier(c, "cn_patent") for c in fields]
        foreign = [S.identifier(c, "wo_patent") for c in fields]
        picked = F.coalesce(*[F.when(a.isNotNull() | b.isNotNull(), F.struct(a.alias("cn_patent"), F.when(a.isNull(), b).alias("wo_patent"))) for a, b in zip(domestic, foreign, strict=True)])
        return F.upper(picked[kind])

    return of


def ipc_codes(df: DataFrame) -> Column:
    """A list of codes as it is, else all codes in the text of the field or of its raw form."""
    raw = F.regexp_extract_all(field(df, "raw_IPC"), F.lit(S.IDENTIFIERS["ipc"]), F.lit(1))
    if "ipc_codes" in df.columns and isinstance(df.schema["ipc_codes"].dataType, T.ArrayType):
        return F.coalesce(F.when(F.size("ipc_codes") > 0, F.col("ipc_codes").cast("array<string>")), raw)
    return F.coalesce(F.regexp_extract_all(field(df, "ipc_codes"), F.lit(S.IDENTIFIERS["ipc"]), F.lit(1)), raw)


#: The fields that each document type gives by rule.
RULES: dict[str, dict[str, Callable[[DataFrame], Column]]] = {
    "patent": {
        "application_number": lambda df: S.strip(field(df, "application_number")),
        "cn_patent_number": patent_number("cn_patent"),
        "wo_patent_number": patent_number("wo_patent"),
        "ipc_codes": ipc_codes,
        "application_date": date("application_date"),
        "publication_date": date("publication_date"),
    },
    "paper": {
        "doi": lambda df: first_of(S.identifier(field(df, "doi"), "doi"), S.identifier(field(df, "raw_doi"), "doi")),
        "authors": names("authors"),
        "keywords": names("keywords"),
        "publish_date": date("publish_date"),
    },
    "project": {
        "project_number": lambda df: first_of(S.strip(field(df, "project_number")), S.identifier(field(df, "title"), "grant_no"), S.identifier(field(df, "raw_pjNo"), "grant_no")),
        "start_date": date("start_year"),
        "end_date": date("end_year"),
    },
    "enterprise": {"establish_date": date("establish_date"), "reg_capital_amount": amount("reg_capital")},
    "policy": {"publish_date": date("publish_date")},
    "tender": {"publish_date": date("publish_date"), "budget_amount": amount("budget_amount")},
}


def extract(df: DataFrame, doc_type: str, keep: list[str]) -> DataFrame:
    """keep and all that rules give for a document type, null where they find nothing; an unknown type gives keep alone (P10).

    Fields that the table lacks, that are null or empty, and dates or amounts that cannot be read are null."""
    return df.select(*keep, *[rule(df).alias(name) for name, rule in RULES.get(doc_type, {}).items()])
