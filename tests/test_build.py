"""An index of a small tree: first build, incremental builds, search, traversal, watching."""

import json

import pytest

from burrow.plans import build, reports, tools
from burrow.plans.store import Store
from burrow.streaming import watch


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("tree")
    files = {
        "services/auth/package.json": json.dumps({"name": "auth", "version": "2.0.0", "description": "Auth service", "dependencies": {"types": "^1", "express": "^4"}}),
        "services/auth/src/auth.ts": "export function login(u: string): boolean {\n}\n",
        "services/auth/node_modules/leftpad/package.json": '{"name":"leftpad"}',
        "packages/types/package.json": '{"name":"types"}',
        "services/hybrid/package.json": '{"name":"hybrid"}', "services/hybrid/go.mod": "module x/hybrid\n",
        "generated/out.ts": "export const A = 1;\n", ".gitignore": "generated/\n", "README.md": "hi",
        "crates/bad/Cargo.toml": "[workspace]\n",
    }
    for path, text in files.items():
        (r / path).parent.mkdir(parents=True, exist_ok=True)
        (r / path).write_text(text)
    return r


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def test_first_build_then_edits(spark, root):
    db = str(root.parent / "index")
    first = build.build(spark, str(root), db)
    e = tools.Engine(spark, db)
    assert names(e.packages) == ["auth", "hybrid", "types"]
    assert names(e.symbols) == ["login"]
    assert "generated/out.ts" not in names(e.files, "path")
    assert {r["path"]: r["package"] for r in e.files.collect()}["README.md"] is None
    assert [f[0] for f in first.failures] == ["crates/bad/Cargo.toml"]
    t = tools.Tools(e)
    assert [x["to"] for x in json.loads(t.dependency_graph("auth", 3, True))] == ["types"]
    assert t.search_symbols(" ") == tools.EMPTY
    assert t.get_package("none") == "Package 'none' not found"
    assert "login" in reports.report(e, "explore-package", {"name": "auth"})
    (root / "services/auth/src/more.ts").write_text("export const MORE = 1;\n")
    (root / "services/hybrid/go.mod").unlink()
    second = build.build(spark, str(root), db)
    assert second.refreshed == 1 and names(tools.Engine(spark, db).symbols) == ["MORE", "login"]
    assert second.states["removed"] == 1
    whole = build.build(spark, str(root), str(root.parent / "other"))
    assert (whole.packages, whole.symbols) == (second.packages, second.symbols)
    for table in ("packages", "dependencies", "symbols", "symbol_postings", "manifest_hashes", "failures"):
        one, two = ({tuple(map(str, r)) for r in Store(spark, at).table(table).collect()} for at in (db, str(root.parent / "other")))
        assert one == two, table
    assert first.summary("x") == f"Indexed 3 packages, 1 symbols, {first.files} files into x" and first.files == 7
    assert second.summary("x").startswith("Indexed 3 packages (0 added, 0 updated, 1 removed, 4 skipped, 1 source-updated), 2 symbols")
    assert set(first.timings) >= {"walk", "workspace-context", "diff", "parse", "remove-deleted", "recompute-internals", "update-hashes", "extract-symbols", "index-files", "total"}
    assert "1 manifest(s) failed to parse:\n  crates/bad/Cargo.toml" in first.notes()
    third = build.build(spark, str(root), db)
    assert third.refreshed == 0 and Store(spark, db).versions()[0]["symbols"] == Store(spark, db).versions()[1]["symbols"]
    t = tools.Tools(tools.Engine(spark, db))
    assert [x["name"] for x in json.loads(t.search_symbols("export const more"))] == [] and [x["name"] for x in json.loads(t.search_symbols("const more"))] == ["MORE"]


def test_watch_coalesces(spark, root):
    import os

    os.makedirs(watch.inbox(str(root)), exist_ok=True)
    watch.send(str(root), [str(root / "services/auth/src/auth.ts")])
    watch.send(str(root), [str(root / "notes.md")])
    calls = []
    query = watch.watch(spark, str(root), once=True, rebuild=lambda *a: calls.append(a))
    query.awaitTermination(60)
    query.stop()
    assert len(calls) == 1
    with open(os.path.join(watch.inbox(str(root)), "bad.json"), "w") as f:
        f.write("not json\n")
    query = watch.watch(spark, str(root), once=True, rebuild=lambda *a: calls.append(a))
    query.awaitTermination(60)
    assert len(calls) == 1
    assert watch.hook('{"tool_name":"Bash","tool_input":{"command":"ls"}}') == (False, [])
    assert watch.hook("not json") == (True, [])


def test_watcher_state(tmp_path):
    import os
    import signal

    root = str(tmp_path)
    assert watch.running(root) is None
    with watch.registered(root) as ended:
        assert watch.running(root) == os.getpid()
        os.kill(os.getpid(), signal.SIGTERM)
        assert ended.wait(5)
    assert watch.running(root) is None
    (tmp_path / ".burrow" / "watch.pid").write_text("999999999")
    assert watch.running(root) is None and not (tmp_path / ".burrow" / "watch.pid").exists()


def test_onboard_lists_all_extensions(spark):
    from types import SimpleNamespace

    from burrow.plans import reports

    meta = spark.createDataFrame([(k, "1") for k in ("package_count", "symbol_count", "file_count", "indexed_at", "git_commit", "total_duration_ms")], "key string, value string")
    files = spark.createDataFrame([(f"x{k}",) for k in range(25)], "extension string")
    text = reports.onboard(SimpleNamespace(meta=meta, files=files, packages=spark.createDataFrame([("p", "go")], "name string, kind string")))
    assert all(f".x{k}: 1" in text for k in range(25))


def test_rule_extensions_and_unknown_overrides(spark, tmp_path):
    for path, text in {"svc/a/owner.yml": "", "svc/a/main.go": "package a\nfunc Run() {}\n", "svc/a/tool.py": "def run(): pass\n", "svc/a/logo.bin": "\x00"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "burrow.toml").write_text('[[discovery.custom]]\nname = "svc"\nkind = "service"\nrequires = ["owner.yml"]\nextensions = ["go"]\n[[packages]]\nname = "svc/a"\ndescription = "Own"\n[[packages]]\nname = "lost"\ndescription = "x"\n')
    report = build.build(spark, str(tmp_path), str(tmp_path.parent / f"{tmp_path.name}-index"))
    e = tools.Engine(spark, str(tmp_path.parent / f"{tmp_path.name}-index"))
    assert names(e.symbols) == ["Run"] and [r["description"] for r in e.packages.collect()] == ["Own"] and report.unknown_overrides == ["lost"]
