"""The query interface: thirteen tools that return JSON text, and their errors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from burrow.operators import graph, lookup, search
from burrow.plans.store import Store

EMPTY = "Search query must not be empty"


class NotFound(LookupError):
    pass


class Engine:
    """Lazy DataFrames over one version of an index."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)
        if not self.store.exists():
            raise FileNotFoundError(f"no index at {path}; run build first")

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("packages", "dependencies", "symbols", "symbol_postings", "files", "meta", "failures", "source_hashes", "manifest_hashes"):
            return self.store.table(name)
        raise AttributeError(name)


def _json(df: DataFrame) -> str:
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], indent=2, ensure_ascii=False, default=str)


class Tools:
    def __init__(self, engine: Engine):
        self.e = engine

    def search_packages(self, query: str) -> str:
        return _json(search.search_packages(self.e.packages, query)) if query.strip() else EMPTY

    def search_symbols(self, query: str, package: str | None = None, kind: str | None = None) -> str:
        return _json(search.search_symbols(self.e.symbols, query, package, kind, self.e.symbol_postings)) if query.strip() else EMPTY

    def search_files(self, query: str, package: str | None = None, extension: str | None = None) -> str:
        return _json(search.search_files(self.e.files, query, package, extension)) if query.strip() else EMPTY

    def get_package(self, name: str) -> str:
        found = lookup.get_package(self.e.packages, name).limit(1).collect()
        return json.dumps(found[0].asDict(), indent=2, ensure_ascii=False) if found else f"Package '{name}' not found"

    def list_packages(self, kind: str | None = None) -> str:
        return _json(lookup.list_packages(self.e.packages, kind))

    def package_dependencies(self, name: str, internal_only: bool = False) -> str:
        return _json(lookup.package_dependencies(self.e.dependencies, name, internal_only))

    def package_dependents(self, name: str) -> str:
        return _json(lookup.package_dependents(self.e.dependencies, name))

    def dependency_graph(self, name: str, depth: int = graph.DEPTH, internal_only: bool = False) -> str:
        return _json(graph.ordered(graph.dependency_graph(self.e.dependencies, name, min(depth, graph.MOST_DEPTH), internal_only)).drop("depth"))

    def get_package_symbols(self, package: str, kind: str | None = None) -> str:
        return _json(lookup.package_symbols(self.e.symbols, package, kind))

    def get_symbol(self, name: str, package: str | None = None) -> str:
        return _json(lookup.get_symbol(self.e.symbols, name, package))

    def get_file_symbols(self, file_path: str, kind: str | None = None) -> str:
        return _json(lookup.file_symbols(self.e.symbols, file_path, kind))

    def list_package_files(self, package: str, extension: str | None = None) -> str:
        return _json(lookup.package_files(self.e.files, package, extension))

    def index_status(self) -> str:
        return json.dumps(lookup.index_status(self.e.meta).first().asDict(), indent=2)


TOOLS = tuple(n for n in vars(Tools) if not n.startswith("_"))


def call(engine: Engine, name: str, arguments: dict) -> str:
    if name not in TOOLS:
        raise NotFound(f"unknown tool '{name}'")
    return getattr(Tools(engine), name)(**arguments)
