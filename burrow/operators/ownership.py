"""Ownership of paths: the package with the longest path that contains a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """The path, its parents, and the root ''."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def assign_owner(files: DataFrame, packages: DataFrame) -> DataFrame:
    """``path, package, extension, size_bytes``; package is NULL for files in no package.

    An equality join on ancestor directories in place of a prefix comparison of all files with all packages: files
    shrink to their distinct directories first, so that a directory's parents are listed once however many files it has.
    """
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    placed = files.withColumn("dir_", directory)
    listed = placed.select("dir_").union(files.select("path")).distinct().select("dir_", F.explode(ancestors(F.col("dir_"))).alias("at"))
    owners = listed.join(packages.select(F.col("path").alias("at"), F.col("name").alias("owner")), "at").groupBy("dir_").agg(F.max_by("owner", F.length("at")).alias("owner"), F.max(F.length("at")).alias("depth"))
    exact = packages.select(F.col("path").alias("path"), F.col("name").alias("own"))
    found = placed.join(owners.select("dir_", "owner"), "dir_", "left").join(exact, "path", "left")
    return found.select("path", F.coalesce("own", "owner").alias("package"), "extension", "size_bytes")


def all_owners(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Every package whose directory contains a file (a nested package's files belong to the outer ones as well)."""
    listed = files.withColumn("at", F.explode(ancestors(F.col("path"))))
    return listed.join(packages.select(F.col("path").alias("at"), F.col("name").alias("owner")), "at").drop("at")
