"""Content hashes of sources and file trees, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_hash(files: DataFrame, by: str = "package") -> DataFrame:
    """``by, content_hash``: SHA-256 of the files' hex hashes, joined in path order, from ``files(by, path, hash)``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "hash"))), lambda x: x["hash"])
    return files.groupBy(by).agg(F.sha2(F.array_join(ordered, ""), 256).alias("content_hash"))


EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def little_endian(column: str) -> Column:
    """A long as the hex digits of its eight bytes, least first."""
    digits = F.lpad(F.hex(F.col(column).cast("long")), 16, "0")
    return F.concat(*(F.substring(digits, i * 2 + 1, 2) for i in range(7, -1, -1)))


def tree_hash(files: DataFrame) -> DataFrame:
    """``tree_hash``: SHA-256 over path bytes and eight size bytes of all files, in path order."""
    one = F.struct("path", F.concat(F.hex(F.encode("path", "utf-8")), little_endian("size_bytes")).alias("h"))
    return files.agg(F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["h"]), "")), 256).alias("tree_hash"))


def newer(files: DataFrame, hashed: DataFrame) -> DataFrame:
    """``package, is_newer``: whether a file changed after the package was hashed; files(package, mtime), hashed(package, hashed_at)."""
    last = files.groupBy("package").agg(F.max("mtime").alias("last"))
    return hashed.join(last, "package", "left").select("package", F.coalesce(F.col("last") > F.col("hashed_at"), F.lit(False)).alias("is_newer"))
