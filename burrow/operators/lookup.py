"""Exact lookups and listings over the index tables (projections and filters; all push down to the scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX_LIMIT = 50
#: ASCII letters only, as SQLite's LIKE folds them.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def get_package(packages: DataFrame, name: str) -> DataFrame:
    return packages.where(F.col("name") == name)


def list_packages(packages: DataFrame, kind: str | None = None) -> DataFrame:
    found = packages if kind is None else packages.where(F.col("kind") == kind)
    return found.orderBy("name")


def package_dependencies(dependencies: DataFrame, name: str, internal_only: bool = False) -> DataFrame:
    found = dependencies.where(F.col("package") == name)
    return found.where("is_internal") if internal_only else found


def package_dependents(dependencies: DataFrame, name: str) -> DataFrame:
    return dependencies.where(F.col("dependency") == name)


def package_symbols(symbols: DataFrame, package: str, kind: str | None = None) -> DataFrame:
    found = symbols.where(F.col("package") == package)
    return (found if kind is None else found.where(F.col("kind") == kind)).orderBy("file_path", "line")


def file_symbols(symbols: DataFrame, file_path: str, kind: str | None = None) -> DataFrame:
    found = symbols.where(F.col("file_path") == file_path)
    return (found if kind is None else found.where(F.col("kind") == kind)).orderBy("line")


def get_symbol(symbols: DataFrame, name: str, package: str | None = None) -> DataFrame:
    found = symbols.where(F.col("name") == name)
    return found if package is None else found.where(F.col("package") == package)


def package_files(files: DataFrame, package: str, extension: str | None = None) -> DataFrame:
    found = files.where(F.col("package") == package)
    return (found if extension is None else found.where(F.col("extension") == extension)).orderBy("path")


def packages_by_path_prefix(packages: DataFrame, prefix: str) -> DataFrame:
    """Packages whose path begins with ``prefix``, ASCII letters alike in either case; wildcards have no meaning."""
    folded = prefix.translate(str.maketrans(_UPPER, _LOWER))
    return packages.where(F.translate("path", _UPPER, _LOWER).startswith(folded)).orderBy("path").limit(PREFIX_LIMIT)


STATUS_KEYS = ("indexed_at", "git_commit", "package_count", "symbol_count", "file_count", "total_duration_ms")


def index_status(meta: DataFrame) -> DataFrame:
    """One row of the six status values; NULL for those that are missing."""
    return meta.agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in STATUS_KEYS))
