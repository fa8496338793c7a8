"""Phrase search: a query is one phrase of whole words, found within one column."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latin letters with one diacritic, and the letters without it: from the Unicode decompositions.
_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii() and unicodedata.combining(d[1])]
MARKED = "".join(_MARKED)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)
LIMITS = {"packages": 20, "symbols": 50, "files": 50}


def normal(column: Column | str) -> Column:
    """Words of a column in lower case without diacritics, each between single spaces."""
    column = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.translate(column, MARKED, PLAIN)), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def phrase(query: str) -> str | None:
    """The query in the same form; None if it has no word."""
    words = re.findall(r"[^\W_]+", query.translate(str.maketrans(MARKED, PLAIN)).lower())
    return f" {' '.join(words)} " if words else None


def matches(columns: list[str], query: str) -> Column:
    wanted = phrase(query)
    if wanted is None:
        return F.lit(False)
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(normal(c), F.lit(wanted)), F.lit(False))
    return found


def search_packages(packages: DataFrame, query: str) -> DataFrame:
    return packages.where(matches(["name", "description", "path"], query)).orderBy("name").limit(LIMITS["packages"])


SYMBOL_KEY, SYMBOL_COLUMNS = ["file_path", "line", "name"], ["name", "kind", "signature", "file_path"]


def stored_postings(symbols: DataFrame) -> DataFrame:
    """Distinct words of each symbol, ordered by word, so that a search for a word reads few row groups."""
    found = postings(symbols, SYMBOL_KEY, SYMBOL_COLUMNS).select("token", *SYMBOL_KEY).distinct()
    return found.repartitionByRange("token", *SYMBOL_KEY).sortWithinPartitions("token")


def search_symbols(symbols: DataFrame, query: str, package: str | None = None, kind: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Symbols with the phrase. ``index``: their stored postings; only symbols with all its words are then looked at."""
    if index is not None and phrase(query) is not None:
        symbols = symbols.join(postings_candidates(index, SYMBOL_KEY, query), SYMBOL_KEY, "left_semi")
    if package is not None:
        symbols = symbols.where(F.col("package") == package)
    if kind is not None:
        symbols = symbols.where(F.col("kind") == kind)
    return symbols.where(matches(SYMBOL_COLUMNS, query)).orderBy("file_path", "line", "name").limit(LIMITS["symbols"])


def search_files(files: DataFrame, query: str, package: str | None = None, extension: str | None = None) -> DataFrame:
    if package is not None:
        files = files.where(F.col("package") == package)
    if extension is not None:
        files = files.where(F.col("extension") == extension)
    return files.where(matches(["path"], query)).orderBy("path").limit(LIMITS["files"])


def postings(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``token, key..., field, pos``: one row per word, for indexes that are searched often."""
    out = None
    for c in columns:
        part = rows.select(*key, F.lit(c).alias("field"), F.posexplode(F.split(F.trim(normal(c)), " ")).alias("pos", "token")).where("token <> ''")
        out = part if out is None else out.unionByName(part)
    return out.select("token", *key, "field", "pos")


def postings_candidates(index: DataFrame, key: list[str], query: str) -> DataFrame:
    """Keys of rows in which every word of the query occurs; the phrase itself is checked on these."""
    words = sorted(set((phrase(query) or "").split()))
    return index.where(F.col("token").isin(words)).groupBy(*key).agg(F.countDistinct("token").alias("n")).where(F.col("n") == len(words)).drop("n")
