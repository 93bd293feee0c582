"""Landed text files to DataFrames of strings. Nothing is inferred; casts come later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tidy(df: DataFrame, case: str = "lower") -> DataFrame:
    """Headers stripped and put in one case, values stripped."""
    fix = (lambda n: n.strip().lower()) if case == "lower" else (lambda n: n.strip().upper())
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(fix(c.lstrip("﻿"))) for c in df.columns])


def read_delimited(spark: SparkSession, path, sep: str = ",", encoding: str = "UTF-8", case: str = "lower") -> DataFrame:
    raw = spark.read.csv(
        path, header=True, sep=sep, encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    return tidy(raw, case)


def read_gazetteer(spark: SparkSession, path) -> DataFrame:
    """Tab-separated gazetteer; padded headers and values are stripped."""
    return read_delimited(spark, path, sep="\t")


def read_json_rows(spark: SparkSession, path) -> DataFrame:
    """A file holding one JSON array of objects."""
    return spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)


def json_matrix(texts: DataFrame) -> DataFrame:
    """A column `value` of JSON matrices to (row_no, fields map): the first row is the header."""
    m = texts.select(F.from_json("value", "array<array<string>>").alias("m"))
    return m.select(F.posexplode("m").alias("row_no", "r"), F.col("m")[0].alias("h")).where("row_no > 0").select(
        "row_no", F.map_from_arrays("h", "r").alias("fields")
    )


def read_json_matrix(spark: SparkSession, path) -> DataFrame:
    return json_matrix(spark.read.text(path, wholetext=True))


def coalesce_columns(df: DataFrame, names) -> F.Column:
    """First non-blank of the alias columns that the file actually has."""
    have = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def sniff_separator(spark: SparkSession, path) -> str:
    """Tab when the header line has one, else comma. Reads one line."""
    first = spark.read.text(path).limit(1).first()
    return "\t" if first and "\t" in first["value"] else ","


def crosswalk_rows(raw: DataFrame) -> DataFrame:
    """Crosswalk columns under any of their published names; rows without both keys drop out."""
    return (
        raw.select(
            F.lpad(coalesce_columns(raw, ("place_geoid", "geoid_place", "placefp")), 7, "0").alias("place_geoid"),
            F.lpad(coalesce_columns(raw, ("county_geoid", "geoid_county", "countyfp")), 5, "0").alias("county_geoid"),
            F.coalesce(coalesce_columns(raw, ("weight", "pop_share")).try_cast("double"), F.lit(1.0)).alias("weight"),
        )
        .where(F.col("place_geoid").isNotNull() & F.col("county_geoid").isNotNull())
    )


def read_delimited_crosswalk(spark: SparkSession, path) -> DataFrame:
    return crosswalk_rows(read_delimited(spark, path, sep=sniff_separator(spark, path)))


def rows_below_header(lines: DataFrame, starts_with: str, sep: str = ",") -> DataFrame:
    """Lines after the header found by content, split into cells, with the header's names.

    lines: line_no, value. The header is the first line with a cell that starts with the text.
    Returns line_no, fields map (upper-cased names).
    """
    parts = lines.select(
        "line_no",
        F.transform(
            F.split("value", sep + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', ""))
        ).alias("cells"),
    )
    is_header = F.exists("cells", lambda c: F.upper(c).startswith(starts_with.upper()))
    header = parts.where(is_header).agg(
        F.min(F.struct("line_no", F.transform("cells", lambda c: F.upper(c)).alias("names"))).alias("h")
    ).select(F.col("h.line_no").alias("header_no"), F.col("h.names").alias("names"), F.lit(1).alias("__k"))
    return (
        parts.withColumn("__k", F.lit(1)).join(header, "__k")
        .where(F.col("line_no") > F.col("header_no"))
        .where(F.size("cells") == F.size("names"))
        .select("line_no", F.map_from_arrays("names", "cells").alias("fields"))
    )


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of a text file in order of appearance (ids rise but have gaps)."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def population_centroids(raw: DataFrame) -> DataFrame:
    """County key to its population-weighted centre; unusable rows drop out."""
    from geofit.functions.keys import county_key

    return raw.select(
        county_key("statefp", "countyfp").alias("geo_id"),
        F.col("latitude").try_cast("double").alias("lat"),
        F.col("longitude").try_cast("double").alias("lon"),
    ).dropna()


def metro_crosswalk(lines: DataFrame) -> DataFrame:
    """County key to (metro code, title) from the delineation list exported as CSV."""
    from geofit.functions.keys import county_key, in_scope

    f = F.col("fields")
    rows = rows_below_header(lines, "CBSA CODE")
    return (
        rows.select(
            county_key(f["FIPS STATE CODE"], f["FIPS COUNTY CODE"]).alias("geo_id"),
            f["CBSA CODE"].alias("metro"), f["CBSA TITLE"].alias("title"),
        )
        .where(in_scope("geo_id"))
    )


# ------------------------------------------------------------------------- provenance


def file_manifest(spark: SparkSession, path, synthetic: bool = False) -> DataFrame:
    """path, sha256, bytes, synthetic for every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return manifest_rows(files, synthetic)


def manifest_rows(files: DataFrame, synthetic: bool = False) -> DataFrame:
    return files.select(
        "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"),
        F.lit(synthetic).alias("synthetic"),
    )


def verify_manifest(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded paths that are missing or whose checksum changed; files nobody recorded."""
    r, a = recorded.alias("r"), actual.alias("a")
    return (
        r.join(a, "path", "full_outer")
        .select(
            "path",
            F.when(F.col("a.sha256").isNull(), "missing")
            .when(F.col("r.sha256").isNull(), "unrecorded")
            .when(F.col("r.sha256") != F.col("a.sha256"), "altered")
            .alias("problem"),
        )
        .where(F.col("problem").isNotNull())
    )
