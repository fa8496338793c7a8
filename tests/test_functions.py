"""Parsers, extractors and the command classifier on small inputs."""

import pytest

from burrow.functions import classify, extractors, manifests


def deps(found):
    return found["dependencies"]


def test_npm():
    p = manifests.parse("package.json", '{"name":"@s/a","version":"1","dependencies":{"x":"workspace:^","y":1},"devDependencies":{"j":"2"},"peerDependencies":{"p":"3"}}', "d")
    assert p["name"] == "@s/a" and deps(p) == [("x", "^", "runtime"), ("y", None, "runtime"), ("j", "2", "dev"), ("p", "3", "peer")]
    assert manifests.parse("package.json", "{}", "packages/unnamed")["name"] == "packages-unnamed"
    assert manifests.parse("package.json", "{", "d")["error"]


def test_go():
    c = manifests.collect_context([("", "go.work", "use (\n ./svc // x\n)\n")])
    p = manifests.parse("go.mod", "module github.com/c/gw\ngo 1.21\nrequire (\n a v1 // indirect\n // b v2\n)\nrequire c v3\n", "svc", c)
    assert (p["name"], p["version"], p["description"], p["metadata"]) == ("gw", "1.21", "github.com/c/gw", '{"go_workspace":true}')
    assert deps(p) == [("a", "v1", "runtime"), ("c", "v3", "runtime")]


def test_cargo():
    c = manifests.collect_context([("", "Cargo.toml", '[workspace.dependencies]\nserde = "1"\n')])
    p = manifests.parse("Cargo.toml", '[package]\nname="k"\nversion.workspace=true\n[dependencies]\nserde={workspace=true}\nz={workspace=true}\n[build-dependencies]\nb={version="2"}\n', "k", c)
    assert p["version"] is None and deps(p) == [("serde", "1", "runtime"), ("z", None, "runtime"), ("b", "2", "build")]
    assert "[package]" in manifests.parse("Cargo.toml", "[workspace]\n", "")["error"]


@pytest.mark.parametrize("text, want", [("plot[extra]>=1.1", ("plot", ">=1.1")), ('typed>=4.0; python_version<"3.12"', ("typed", ">=4.0")), ("frames", ("frames", None))])
def test_requirement(text, want):
    assert manifests.requirement(text) == want


def test_maven():
    parent = "<project><groupId>g</groupId><artifactId>p</artifactId><version>7</version><modules><module>m</module></modules><dependencyManagement><dependencies><dependency><groupId>q</groupId><artifactId>w</artifactId><version>5</version></dependency></dependencies></dependencyManagement></project>"
    c = manifests.collect_context([("", "pom.xml", parent)])
    p = manifests.parse("pom.xml", "<project><parent><groupId>g</groupId><artifactId>p</artifactId></parent><artifactId>a</artifactId><dependencies><dependency><groupId>q</groupId><artifactId>w</artifactId><scope>provided</scope></dependency></dependencies></project>", "m", c)
    assert (p["name"], p["version"]) == ("g:a", "7") and deps(p) == [("q:w", "5", "peer")]
    assert manifests.parse("pom.xml", "<project></project>", "m")["error"]


def test_gradle():
    assert manifests.gradle_settings("rootProject.name = 'my'\ninclude ':app', ':lib:core'\n") == (["app", "lib/core"], "my")
    p = manifests.parse("build.gradle.kts", 'group = "com.x"\ndependencies {\n  implementation("a:b:1")\n  testRuntimeOnly("c:d:2")\n  compileOnly(project(":shared:utils"))\n}\n', "svc/app")
    assert p["name"] == "com.x:app" and deps(p) == [("a:b", "1", "runtime"), ("c:d", "2", "dev"), (":shared:utils", None, "peer")]


def test_perl_and_ruby_manifests():
    assert deps(manifests.parse("cpanfile", "requires 'A', '1';\non 'test' => sub {\n requires 'T';\n};\nrequires 'B';\n", "p")) == [("A", "1", "runtime"), ("T", None, "dev"), ("B", None, "runtime")]
    assert deps(manifests.parse("Gemfile", "gem 'r', '~> 7'\ngroup :test do\n gem 's'\nend\ngem 'pg'\n", "x")) == [("r", "~> 7", "runtime"), ("s", None, "dev"), ("pg", None, "runtime")]


def named(rows):
    return [(r["name"], r["kind"], r["parent_symbol"]) for r in rows]


def test_typescript():
    s = extractors.typescript("export async function pay(a: number, c: string): Promise<R> {\n}\nexport class A {\n  private x(): void {}\n  run(t: string): Promise<boolean> {}\n}\nfunction hidden() {}\nexport const C = 1;\n")
    assert named(s) == [("pay", "function", None), ("A", "class", None), ("run", "method", "A"), ("C", "constant", None)]
    assert s[0]["return_type"] == "Promise<R>" and s[0]["parameters"] == [{"name": "a", "type": "number"}, {"name": "c", "type": "string"}] and s[1]["parameters"] is None


def test_other_languages():
    assert named(extractors.go("package p\nfunc (r *R) Do(a, b int) error {\n}\ntype T struct {\n}\nfunc x() {}\n")) == [("Do", "method", "R"), ("T", "struct", None)]
    assert named(extractors.rust("pub(crate) fn f() {}\nimpl S {\n pub fn n(&self) {}\n fn p() {}\n}\npub trait T {}\n")) == [("f", "function", None), ("n", "method", "S"), ("T", "trait", None)]
    assert named(extractors.python("@d\ndef g(): pass\nclass C:\n    def __init__(self): pass\n    def _h(self): pass\ndef f(a: int) -> str: pass\n")) == [("C", "class", None), ("__init__", "method", "C"), ("f", "function", None)]
    assert named(extractors.proto("message O {\n message I {}\n}\nservice S {\n rpc F(stream A) returns (B);\n}\n")) == [("O", "struct", None), ("I", "struct", "O"), ("S", "interface", None), ("F", "method", "S")]
    assert named(extractors.java("public class A {\n public static final int X = 1;\n protected static void go() {}\n void p() {}\n}\n")) == [("A", "class", None), ("X", "constant", "A"), ("go", "function", "A")]
    assert named(extractors.kotlin("object O\nclass A {\n  fun r(): Int { }\n  private fun p() {}\n}\n")) == [("O", "class", None), ("A", "class", None), ("r", "method", "A")]
    assert named(extractors.perl("package P;\nsub n {}\nsub _x {}\n")) == [("P", "class", None), ("n", "method", "P")]
    assert named(extractors.ruby("class A < B\n def self.l(x)\n end\nend\n")) == [("A", "class", None), ("l", "function", "A")]


@pytest.mark.parametrize("language", sorted(extractors.EXTRACTORS))
@pytest.mark.parametrize("text", ["", "{{{((", "export class", "pub fn", "func (", "message X {", "'unclosed", "/* open", "\x00"])
def test_broken_sources_give_partial_results(language, text):
    assert isinstance(extractors.extract(language, text), list)


@pytest.mark.parametrize("command, want", [("ls docs", False), ("cat notes | grep todo", False), ("mv one two", True), ("echo done && rm one", True), ("cat notes | ./run.sh", True), (None, True), ("ninja all", True)])
def test_commands(command, want):
    assert classify.should_rebuild_text("Bash", command) is want
    assert classify.should_rebuild_text("Edit", command) is True
