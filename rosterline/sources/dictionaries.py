"""Dictionaries as DataFrames, and the reader of a user's own specialty dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocab import business, headers, specialties


def read_specialty_dictionary(path: str) -> dict[str, list[str]]:
    """Ordered ``{canonical: [synonym, ...]}`` from a YAML file; the built-in fallback when unreadable.

    A dictionary is configuration: a few hundred entries, read on the driver.
    """
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            config = yaml.safe_load(f)
        found = {n: list(c["synonyms"]) for n, c in config["specialties"].items()}
    except (ImportError, OSError, KeyError, TypeError, ValueError):
        return dict(specialties.FALLBACK_SPECIALTIES)
    return found or dict(specialties.FALLBACK_SPECIALTIES)


def synonym_table(rows: DataFrame, synonym: str = "synonym", canonical: str = "canonical", order: str = "ord") -> DataFrame:
    """``ord``, ``synonym`` (lower case), ``canonical`` of a dictionary in rows, of any size.

    A synonym keeps its first place and belongs to its last owner, as in
    :func:`rosterline.vocab.specialties.reverse_map`; ties of ``order`` go to
    the greater canonical name.  Null and empty synonyms and null names are left out.
    """
    given = rows.select(F.lower(F.col(synonym).cast("string")).alias("synonym"), F.col(canonical).cast("string").alias("canonical"), F.col(order).cast("long").alias("ord"))
    return given.filter("synonym <> '' AND canonical IS NOT NULL").groupBy("synonym").agg(
        F.min("ord").alias("ord"), F.max(F.struct("ord", "canonical"))["canonical"].alias("canonical")).select("ord", "synonym", "canonical")


def read_synonyms(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """:func:`synonym_table` of files with the columns ``ord``, ``synonym`` and ``canonical`` (CSV with a heading, JSON lines or Parquet)."""
    reader = spark.read.options(header=True, escape='"', multiLine=True) if fmt == "csv" else spark.read
    return synonym_table(reader.format(fmt).load(path))


def specialty_synonyms(spark: SparkSession, table: dict | None = None) -> DataFrame:
    return spark.createDataFrame(specialties.synonym_rows(table), "ord int, synonym string, canonical string")


def taxonomy_codes(spark: SparkSession, table: dict | None = None) -> DataFrame:
    return spark.createDataFrame(list(specialties.taxonomy_map(table).items()), "code string, canonical string")


def lob_synonyms(spark: SparkSession) -> DataFrame:
    rows = [(lob, s) for lob, synonyms in business.LOB_SYNONYMS.items() for s in synonyms]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, lob string, synonym string")


def organization_types(spark: SparkSession) -> DataFrame:
    rows = [(t, s) for t, synonyms in business.ORGANIZATION_TYPES.items() for s in synonyms]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, type string, synonym string")


def header_variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(headers.header_rows(), "field string, field_ord int, variant string, variant_ord int")


def attachment_headers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(headers.attachment_rows(), "field string, field_ord int, variant string, variant_ord int")
