"""Incremental maintenance of the index tables: differences, upserts, cascades, derived flags, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(walked: DataFrame, stored: DataFrame) -> DataFrame:
    """``path, content_hash, state`` of manifests, state being new, changed, unchanged or removed."""
    both = walked.select("path", F.col("content_hash").alias("now")).join(stored.select("path", F.col("content_hash").alias("was")), "path", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed").otherwise("unchanged")
    return both.select("path", F.coalesce("now", "was").alias("content_hash"), state.alias("state"))


def keep_last(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the last by ``order``."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("rank_", F.row_number().over(last)).where("rank_ = 1").drop("rank_")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` that share none of the keys with it, each key on its own."""
    kept = old
    for k in keys:
        kept = kept.join(new.select(k).distinct(), k, "left_anti")
    return kept.select(*new.columns).unionByName(new)


def mark_internal(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    """``is_internal``: the dependency is the name of a package, or the module path (description) of a go package."""
    known = packages.select(F.col("name").alias("dependency")).union(packages.where("kind = 'go' and description is not null").select("description")).distinct().withColumn("known_", F.lit(True))
    return dependencies.drop("is_internal").join(known, "dependency", "left").select(*[c for c in dependencies.columns if c != "is_internal"], F.col("known_").isNotNull().alias("is_internal"))


def remove_paths(packages: DataFrame, dependents: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the packages at the paths of ``gone(path)``: packages themselves, and rows that name them."""
    doomed = packages.join(gone.select("path"), "path", "left_semi").select(F.col("name").alias("package"))
    out = {"packages": packages.join(gone.select("path"), "path", "left_anti").select(*packages.columns)}
    for name, rows in dependents.items():
        out[name] = rows.join(doomed, "package", "left_anti").select(*rows.columns)
    return out


def orphans(rows: DataFrame, packages: DataFrame) -> DataFrame:
    """Rows whose package does not exist."""
    return rows.where("package is not null").join(packages.select(F.col("name").alias("package")), "package", "left_anti").select(*rows.columns)


def repair(packages: DataFrame, symbols: DataFrame, dependencies: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols and dependencies without their orphans, and files whose unknown packages are NULL."""
    names = packages.select(F.col("name").alias("package"))
    known = names.withColumn("known_", F.lit(True))
    fixed = files.join(known, "package", "left").withColumn("package", F.when(F.col("known_"), F.col("package"))).select(*files.columns)
    return symbols.join(names, "package", "left_semi").select(*symbols.columns), dependencies.join(names, "package", "left_semi").select(*dependencies.columns), fixed


def override_descriptions(packages: DataFrame, overrides: DataFrame) -> DataFrame:
    """Descriptions replaced by those of ``overrides(name, description)``."""
    new = overrides.select("name", F.col("description").alias("new_"))
    return packages.join(new, "name", "left").withColumn("description", F.coalesce("new_", "description")).select(*packages.columns)


def unknown_overrides(packages: DataFrame, overrides: DataFrame) -> DataFrame:
    return overrides.join(packages.select("name"), "name", "left_anti")
