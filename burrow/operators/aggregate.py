"""Group counts and groupings for summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extension_distribution(files: DataFrame) -> DataFrame:
    """Files per extension, most first; files without an extension are left out."""
    return files.where("extension <> ''").groupBy("extension").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "extension")


def kind_histogram(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("package", "kind").agg(F.count("*").alias("count"))


def packages_by_kind(packages: DataFrame, shown: int | None = None) -> DataFrame:
    """Packages per kind, with the first names in order. With ``shown`` only so many names are kept per group."""
    names = F.sort_array(F.collect_list("name"))
    return packages.groupBy("kind").agg(F.count("*").alias("count"), (names if shown is None else F.slice(names, 1, shown)).alias("names")).orderBy("kind")


def counts(packages: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("key"), F.col("value"))
    return one(packages, "package_count").unionByName(one(symbols, "symbol_count")).unionByName(one(files, "file_count"))
