"""Table functions over files: ``parse_manifest`` and ``extract_symbols``, for lateral joins and for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from burrow.functions import extractors, manifests
from burrow.schema import PARAMETERS


@udtf(returnType="name string, kind string, version string, description string, metadata string, dependency string, version_req string, dep_kind string, error string")
class ParseManifest:
    """Rows of one manifest ``(path, content)``: one per dependency, one for a package without any, one for an error."""

    def eval(self, path: str, content: str):
        directory, _, filename = (path or "").rpartition("/")
        if filename not in manifests.PARSERS:
            return
        got = manifests.parse(filename, content or "", directory)
        if got["error"]:
            yield None, None, None, None, None, None, None, None, got["error"]
            return
        for d, v, k in got["dependencies"] or [(None, None, None)]:
            yield got["name"], got["kind"], got["version"], got["description"], got["metadata"], d, v, k, None


@udtf(returnType=f"name string, kind string, signature string, line bigint, visibility string, parent_symbol string, return_type string, parameters {PARAMETERS}")
class ExtractSymbols:
    """Public symbols of one source file ``(path, content)``."""

    def eval(self, path: str, content: str):
        for s in extractors.extract((path or "").rpartition(".")[2], content or ""):
            yield s["name"], s["kind"], s["signature"], s["line"], s["visibility"], s["parent_symbol"], s["return_type"], s["parameters"] and [(p["name"], p["type"]) for p in s["parameters"]] if s["parameters"] is not None else None


def register(spark: SparkSession) -> None:
    """Makes both available in SQL under the names ``parse_manifest`` and ``extract_symbols``."""
    spark.udtf.register("parse_manifest", ParseManifest)
    spark.udtf.register("extract_symbols", ExtractSymbols)
