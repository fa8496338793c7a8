"""Building and refreshing an index: scan, parse, discover, extract, own, commit."""

from __future__ import annotations

import json
import re
import subprocess
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow import config as configuration
from burrow.functions import extractors, hashing, manifests
from burrow.operators import discovery, maintain, ownership, search
from burrow.plans.store import Store, default_path
from burrow.schema import PARAMETERS
from burrow.sources.tree import read_tree

_PARSED = "path string, dir string, filename string, content_hash string, name string, kind string, version string, description string, metadata string, dependencies array<struct<dependency:string,version_req:string,dep_kind:string>>, error string"
_SYMBOL = f"package string, name string, kind string, signature string, file_path string, line bigint, visibility string, parent_symbol string, return_type string, parameters {PARAMETERS}"


@dataclass
class Report:
    packages: int = 0
    symbols: int = 0
    files: int = 0
    states: dict[str, int] = field(default_factory=dict)
    failures: list[tuple[str, str]] = field(default_factory=list)
    refreshed: int = 0
    unknown_overrides: list[str] = field(default_factory=list)
    timings: dict[str, int] = field(default_factory=dict)

    whole: bool = True

    def summary(self, db: str) -> str:
        """One line: totals, and of a build that took over an earlier one also what changed."""
        n = lambda state: self.states.get(state, 0)
        changes = "" if self.whole else f" ({n('new')} added, {n('changed')} updated, {n('removed')} removed, {n('unchanged')} skipped{f', {self.refreshed} source-updated' if self.refreshed else ''})"
        return f"Indexed {self.packages} packages{changes}, {self.symbols} symbols, {self.files} files into {db}"

    def notes(self) -> str:
        """Failures and the time of each phase, a line each."""
        failed = [f"{len(self.failures)} manifest(s) failed to parse:", *(f"  {path}: {error}" for path, error in self.failures)] if self.failures else []
        return "\n".join([*failed, *(f"override for unknown package: {name}" for name in self.unknown_overrides), "Build timing:", *(f"  {k:<20} {v}ms" for k, v in self.timings.items())])


#: The phase that the writing of a table belongs to.
PHASES = {"packages": "remove-deleted", "dependencies": "recompute-internals", "symbols": "extract-symbols", "symbol_postings": "extract-symbols", "files": "index-files", "manifest_hashes": "update-hashes", "source_hashes": "update-hashes"}


def parse_manifests(found: DataFrame, context: manifests.Context) -> DataFrame:
    """Package rows of ``found(path, dir, filename, content, content_hash)``; files that fail have an error only."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples():
                got = manifests.parse(r.filename, bytes(r.content).decode("utf-8", "replace"), r.dir, context)
                deps = [{"dependency": d, "version_req": v, "dep_kind": k} for d, v, k in got.get("dependencies", ())]
                out.append((r.path, r.dir, r.filename, r.content_hash, got.get("name"), got.get("kind"), got.get("version"), got.get("description"), got.get("metadata"), deps, got["error"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PARSED.replace("struct<dependency:string,version_req:string,dep_kind:string>", "x").split(", ")])

    return found.where(F.col("filename").isin(list(manifests.PARSERS))).select("path", "dir", "filename", "content", "content_hash").mapInPandas(run, _PARSED)


def read_context(found: DataFrame) -> manifests.Context:
    """What all manifests say about workspaces. Files are parsed where they are; the driver gets what workspace roots tell."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples():
                own = manifests.collect_context([(r.dir, r.filename, bytes(r.content).decode("utf-8", "replace"))])
                if own != manifests.Context():
                    out.append((r.dir, r.filename, json.dumps({k: sorted(v) if isinstance(v, set) else v for k, v in vars(own).items()})))
            yield pd.DataFrame(out, columns=["dir", "filename", "told"])

    wanted = found.where(F.col("filename").isin("Cargo.toml", "pom.xml", *manifests.CONTEXT_FILES)).select("dir", "filename", "content")
    whole = manifests.Context()
    for r in wanted.mapInPandas(run, "dir string, filename string, told string").orderBy("dir", "filename").collect():
        for k, v in json.loads(r["told"]).items():
            getattr(whole, k).update(v)
    return whole


def wanted_content(own: configuration.Config) -> str:
    """Pattern of the names of files whose content a build reads."""
    names = "|".join(re.escape(m) for m in own.manifests)
    return rf"(?:{names}|.*\.(?:{'|'.join(extractors.EXTRACTORS)}))"


def in_rule(owned: DataFrame, packages: DataFrame, rules: list) -> DataFrame:
    """``owned(package, path, ...)`` without files whose extension the rule that found the package doesn't name."""
    told = {r.name: [e.lstrip(".") for e in r.extensions] for r in rules if r.extensions}
    if not told:
        return owned
    rule = F.get_json_object("metadata", "$.custom_rule")
    limits = F.create_map(*(x for k, v in told.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    named = packages.where(rule.isin(list(told))).select(F.col("name").alias("package"), limits[rule].alias("extensions_"))
    extension = F.regexp_extract("path", r"\.([^./]*)$", 1)
    return owned.join(named, "package", "left").where(F.col("extensions_").isNull() | F.array_contains("extensions_", extension)).drop("extensions_")


def is_source(exclude_extensions: tuple[str, ...]):
    """Files that symbols are taken from."""
    wanted = [e for e in extractors.EXTRACTORS if f".{e}" not in exclude_extensions and e not in exclude_extensions]
    extension = F.regexp_extract("filename", r"\.([^.]*)$", 1)
    plain = extension.isin(wanted) & ~F.col("filename").isin(*extractors.SKIPPED_FILES)
    for suffix in extractors.SKIPPED_SUFFIXES:
        plain = plain & ~F.endswith("filename", F.lit(suffix))
    return plain & ~F.exists(F.split("dir", "/"), lambda p: p.isin(*extractors.SKIPPED_DIRECTORIES) | p.startswith("."))


def extract_symbols(sources: DataFrame) -> DataFrame:
    """Symbols of ``sources(package, path, extension, content)``."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for r in frame.itertuples():
                for s in extractors.extract(r.extension, bytes(r.content)):
                    rows.append((r.package, s["name"], s["kind"], s["signature"], r.path, s["line"], s["visibility"], s["parent_symbol"], s["return_type"], s["parameters"]))
            yield pd.DataFrame(rows, columns=["package", "name", "kind", "signature", "file_path", "line", "visibility", "parent_symbol", "return_type", "parameters"])

    return sources.select("package", "path", F.regexp_extract("path", r"\.([^./]*)$", 1).alias("extension"), "content").mapInPandas(run, _SYMBOL)


def git_commit(root: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def build(spark: SparkSession, root: str, db: str | None = None, force: bool = False) -> Report:
    """Brings the index of a tree up to date. What did not change by content hash is taken over from the last version."""
    report, began = Report(), time.monotonic()
    mark = [began]

    def timed(phase: str) -> None:
        now = time.monotonic()
        report.timings[phase] = report.timings.get(phase, 0) + int((now - mark[0]) * 1000)
        mark[0] = now

    own = configuration.load(root)
    store = Store(spark, db or own.db_path or default_path(root))
    old = (lambda name: store.table(name).limit(0)) if force else store.table
    report.whole = force or not store.exists()
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    tree = hold(read_tree(spark, root, own.exclude, wanted_content(own)))
    try:
        report.files = tree.count()
        timed("walk")
        wanted = [m for m in own.manifests if m in manifests.PARSERS or m in manifests.CONTEXT_FILES]
        walked = tree.where(F.col("filename").isin(wanted)).withColumn("content_hash", F.sha2("content", 256))
        state = maintain.diff(walked, old("manifest_hashes"))
        report.states = {r["state"]: r["n"] for r in state.groupBy("state").agg(F.count("*").alias("n")).collect()}
        timed("diff")
        context = read_context(walked)
        timed("workspace-context")
        parsed = hold(parse_manifests(walked, context))
        failures = parsed.where("error is not null").select("path", "error")
        order = F.array_position(F.array(*(F.lit(m) for m in own.manifests)), F.col("filename"))
        good = maintain.keep_last(parsed.where("error is null").withColumn("rank", -order), ["dir"], "rank")
        good = hold(maintain.keep_last(good, ["name"], "dir"))
        packages = good.select("name", F.col("dir").alias("path"), "kind", "version", "description", "metadata")
        if own.rules:
            dirs = tree.groupBy("dir").agg(F.collect_set("filename").alias("filenames"))
            more = discovery.discover(dirs, own.rules, list(own.exclude), packages.select("path"))
            none = F.lit(None).cast("string")
            packages = packages.unionByName(more.select("name", "path", "kind", none.alias("version"), none.alias("description"), "metadata"))
            packages = maintain.keep_last(packages, ["name"], "path")
        if own.overrides:
            told = spark.createDataFrame(own.overrides, "name string, description string")
            report.unknown_overrides = [r["name"] for r in maintain.unknown_overrides(packages, told).collect()]
            packages = maintain.override_descriptions(packages, told)
        packages = hold(packages)
        edges = good.select(F.col("name").alias("package"), F.explode("dependencies").alias("d")).select("package", "d.dependency", "d.dep_kind", "d.version_req")
        edges = maintain.keep_last(edges.withColumn("n", F.monotonically_increasing_id()), ["package", "dependency", "dep_kind"], "n").drop("n")
        dependencies = maintain.mark_internal(edges, packages)
        report.packages, report.failures = packages.count(), [(r["path"], r["error"]) for r in failures.limit(1000).collect()]
        timed("parse")
        sources = tree.where(is_source(own.exclude_extensions)).select("path", F.sha2("content", 256).alias("hash"))
        owned = hold(in_rule(ownership.all_owners(sources, packages).withColumnRenamed("owner", "package"), packages, own.rules))
        hashes = hashing.source_hash(owned.select("package", "path", F.concat("path", F.lit("\n"), "hash").alias("hash")))
        hashes = hold(packages.select(F.col("name").alias("package")).join(hashes, "package", "left").select("package", F.coalesce("content_hash", F.lit(hashing.EMPTY_HASH)).alias("content_hash")))
        stale = hold(hashes.join(old("source_hashes").select("package", F.col("content_hash").alias("was")), "package", "left").where("was is null or was <> content_hash").select("package"))
        report.refreshed = stale.count()
        kept = old("symbols").join(hashes.select("package"), "package", "left_semi").join(stale, "package", "left_anti")
        fresh = owned.join(stale, "package", "left_semi").select("package", "path").join(tree.select("path", "content"), "path")
        symbols = kept.unionByName(extract_symbols(fresh))
        timed("update-hashes")
        files = ownership.assign_owner(tree.select("path", "extension", "size_bytes"), packages)
        now = datetime.now(timezone.utc)
        tables = {
            "packages": packages, "dependencies": dependencies, "files": files, "failures": failures, "manifest_hashes": walked.select("path", "content_hash"),
            "source_hashes": hashes.withColumn("hashed_at", F.lit(now).cast("timestamp")),
        }
        gone = old("source_hashes").join(hashes.select("package"), "package", "left_anti")
        if force or report.refreshed or not store.exists() or not gone.isEmpty():
            tables |= {"symbols": symbols, "symbol_postings": lambda written: search.stored_postings(written("symbols"))}
        meta = [("indexed_at", now.isoformat()), ("git_commit", git_commit(root)), ("package_count", str(report.packages)), ("file_count", str(report.files)), ("total_duration_ms", str(int((time.monotonic() - began) * 1000)))]
        counted = spark.createDataFrame([m for m in meta if m[1] is not None], "key string, value string")
        tables["meta"] = lambda written: counted.unionByName(written("symbols").agg(F.count("*").cast("string").alias("value")).select(F.lit("symbol_count").alias("key"), "value"))
        store.commit(tables, lambda name: timed(PHASES.get(name, "commit")))
        report.symbols = store.table("symbols").count()
        timed("commit")
        report.timings["total"] = int((time.monotonic() - began) * 1000)
        return report
    finally:
        for df in held:
            df.unpersist()
