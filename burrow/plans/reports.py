"""Six Markdown reports, composed of queries whose rows are collected once each."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from burrow.operators import graph, lookup, search
from burrow.plans.tools import Engine, NotFound


def _bullets(rows, form) -> str:
    return "\n".join(f"- {form(r)}" for r in rows) or "- none"


def explore(e: Engine, query: str) -> str:
    packages = search.search_packages(e.packages, query).collect()
    symbols = search.search_symbols(e.symbols, query).collect()
    files = search.search_files(e.files, query).collect()
    names = {p["name"] for p in packages}
    out = [f"# Explore: {query}", "", f"## Packages ({len(packages)})", ""]
    for p in packages:
        out += [f"### {p['name']} ({p['kind']})", f"Path: {p['path']}", p["description"] or "", _bullets([s for s in symbols if s["package"] == p["name"]], lambda s: f"`{s['signature'] or s['name']}` {s['file_path']}:{s['line']}"), ""]
    out += ["## Other symbols", "", _bullets([s for s in symbols if s["package"] not in names], lambda s: f"`{s['name']}` ({s['kind']}) in {s['package']}, {s['file_path']}:{s['line']}"), "", "## Other files", "", _bullets([f for f in files if f["package"] not in names], lambda f: f["path"])]
    return "\n".join(out)


def explore_package(e: Engine, name: str) -> str:
    p = lookup.get_package(e.packages, name).first()
    if p is None:
        raise NotFound(f"Package '{name}' not found")
    symbols = lookup.package_symbols(e.symbols, name).collect()
    out = [f"# {name}", "", f"Kind: {p['kind']}", f"Path: {p['path']}", f"Version: {p['version'] or 'unknown'}", "", p["description"] or "", "", "## Dependencies", "", _bullets(lookup.package_dependencies(e.dependencies, name).orderBy("dependency", "dep_kind").collect(), lambda d: f"{d['dependency']} ({d['dep_kind']}{', internal' if d['is_internal'] else ''})"), "", "## Dependents", "", _bullets(lookup.package_dependents(e.dependencies, name).orderBy("package", "dep_kind").collect(), lambda d: f"{d['package']} ({d['dep_kind']})"), ""]
    for kind in sorted({s["kind"] for s in symbols}):
        out += [f"## {kind}", "", _bullets([s for s in symbols if s["kind"] == kind], lambda s: f"`{s['signature'] or s['name']}` {s['file_path']}:{s['line']}"), ""]
    return "\n".join(out)


def explore_area(e: Engine, path: str) -> str:
    packages = lookup.packages_by_path_prefix(e.packages, path)
    found = packages.collect()
    if not found:
        raise NotFound(f"No packages under '{path}'")
    named = packages.select(F.col("name").alias("package"))
    counts = e.symbols.join(named, "package", "left_semi").groupBy("package", "kind").agg(F.count("*").alias("n")).orderBy("package", F.desc("n"), "kind").collect()
    deps = e.dependencies.where("is_internal").join(named, "package", "left_semi").orderBy("package", "dependency").collect()
    out = [f"# Area: {path}", ""]
    for p in found:
        histogram = ", ".join(f"{c['n']} {c['kind']}{'s' if c['n'] != 1 else ''}" for c in counts if c["package"] == p["name"])
        out += [f"## {p['name']} ({p['kind']})", f"Path: {p['path']}", f"Symbols: {histogram or 'none'}", _bullets([d for d in deps if d["package"] == p["name"]], lambda d: d["dependency"]), ""]
    return "\n".join(out)


def onboard(e: Engine) -> str:
    status = lookup.index_status(e.meta).first()
    by_kind = e.packages.groupBy("kind").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("names")).orderBy("kind").collect()
    extensions = e.files.where("extension <> ''").groupBy("extension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").collect()
    out = ["# Onboarding", "", f"{status['package_count']} packages, {status['symbol_count']} symbols, {status['file_count']} files, indexed at {status['indexed_at']}", ""]
    for k in by_kind:
        out += [f"## {k['kind']} ({k['n']})", "", _bullets(k["names"], str), ""]
    return "\n".join([*out, "## File types", "", _bullets(extensions, lambda x: f".{x['extension']}: {x['n']}")])


def impact_analysis(e: Engine, name: str) -> str:
    direct = lookup.package_dependents(e.dependencies, name).orderBy("package", "dep_kind").collect()
    edges = graph.ordered(graph.reverse_dependency_graph(e.dependencies, name, graph.REPORT_DEPTH)).collect()
    names, all_names = {d["package"] for d in direct}, {x["from"] for x in edges}
    return "\n".join([f"# Impact of {name}", "", f"{len(all_names)} packages affected, {len(names)} directly", "", "## Direct dependents", "", _bullets(direct, lambda d: f"{d['package']} ({d['dep_kind']})"), "", "## Transitive dependents", "", _bullets(sorted(all_names - names), str)])


def understand_dependency(e: Engine, start: str, goal: str) -> str:
    for name in (start, goal):
        if lookup.get_package(e.packages, name).isEmpty() and lookup.package_dependents(e.dependencies, name).isEmpty():
            raise NotFound(f"Package '{name}' not found")
    path = graph.path_between(e.dependencies, start, goal)
    edges = path.orderBy("from", "to", "dep_kind").collect()
    between = graph.intermediates(path, e.packages, start, goal).orderBy("name").collect()
    if not edges:
        return f"# {start} to {goal}\n\nNo dependency path found."
    return "\n".join([f"# {start} to {goal}", "", "## Edges", "", _bullets(edges, lambda x: f"{x['from']} -> {x['to']} ({x['dep_kind']})"), "", "## In between", "", _bullets(between, lambda p: f"{p['name']} ({p['kind'] or 'external'}) {p['description'] or ''}".rstrip())])


REPORTS = {"explore": (explore, ("query",)), "explore-package": (explore_package, ("name",)), "explore-area": (explore_area, ("path",)), "onboard": (onboard, ()), "impact-analysis": (impact_analysis, ("name",)), "understand-dependency": (understand_dependency, ("from", "to"))}


def report(e: Engine, name: str, arguments: dict) -> str:
    """Renders a report; arguments that aren't strings are taken as their JSON text."""
    if name not in REPORTS:
        raise NotFound(f"unknown report '{name}'")
    f, wanted = REPORTS[name]
    missing = [k for k in wanted if k not in arguments]
    if missing:
        raise ValueError(f"missing argument '{missing[0]}'")
    return f(e, *(arguments[k] if isinstance(arguments[k], str) else json.dumps(arguments[k]) for k in wanted))
