"""Queries over inline files, one per manifest parser and symbol extractor, against rows written out as SQL values.

The expected rows were printed from the functions themselves and then read against the rules of each format, line by
line; they pin that reading down and are no second implementation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.functions import manifests, udtfs
from burrow.plans import build

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Sources by query: a path and a text.
SOURCES = {
    "symbols_typescript": ("src/pay.ts", """import { x } from "y";
export async function charge(
  sum: number, { a, b }: Options = {}, ...tags: string[]
): Promise<Bill> {
}
export class Ledger extends Base<Row> {
  private total(): number { return 0 }
  static open(): Ledger { return new Ledger(); } close(force?: boolean): void { if (force) { x() } }
  #hidden() {}
  label: string = "l";
  constructor(private readonly db: Db) { super() }
}
export interface Options { a: string }
export enum Mode { On, Off }
export type Id = string | number;
export const LIMIT = 3, FLOOR: number = f(1, 2);
export default function main(x) { }
function local() {}
"""),
    "symbols_javascript": ("web/view.jsx", """export class View {
  size = 1;
  draw(canvas, depth = 2) { } get width() { return 1 }
}
export function mount(node, { deep }, last) { }
const inner = 1;
export const ROOT = "r";
"""),
    "symbols_go": ("cmd/main.go", """package main

type Router struct {
\troutes map[string]string
}

type Handler interface {
\tServe() error
}

func NewRouter(prefix string, size int) (*Router, error) {
\treturn nil, nil
}

func (r *Router) Handle(path string, a, b int) error {
\treturn nil
}

func hidden() {}
"""),
    "symbols_rust": ("core/src/lib.rs", """pub(crate) struct Row<T> { a: T }
pub enum Side { Left, Right }
pub trait Walk {}
pub fn total(sum: f64, mut cur: &str) -> Result<Row> {
}
impl<T> Walk for Row<T> {
    pub async fn step(&self, by: Vec<(u8, u8)>) -> Option<u8> { None }
    fn own(&self) {}
}
fn local() {}
"""),
    "symbols_python": ("ml/train.py", """import os

@cache
def skipped(): pass

def fit(rows, rate: float=0.1, *marks: str, name='x', **more) -> "Model":
    return rows // 2

class Model(Base):
    def __init__(self, size: int = 3): pass
    async def run(self, /, step, *, deep=True) -> None: pass
    def _own(self): pass
"""),
    "symbols_python_broken": ("ml/broken.py", """def first(a): return 1

def bad(:
    x

class Later:
    def run(self): pass
"""),
    "symbols_proto": ("api/search.proto", """syntax = "proto3";
message Query {
  string text = 1;
  message Page { int32 at = 1; }
  enum Order { UP = 0; }
  oneof pick { string a = 2; }
}
service Search {
  rpc Find(Query) returns (Answer);
  rpc Watch(stream Query) returns (stream Answer);
}
enum State { ON = 0; }
"""),
    "symbols_java": ("src/Shop.java", """package shop;

@Service
public final class Shop<T> extends Base implements Open {
    public static final int LIMIT = 1, OTHER = 2;
    private static final int OWN = 1;
    record Pair(int a) {}
    public Shop(int size) {}
    @Override
    public <U> Map<String, U> sell(final String what, int[] counts, String... more) throws IOException { return null; }
    protected static void start() {}
    public abstract void stop();
    void local() {}
    public static class Inner { public void deep() {} }
}
"""),
    "symbols_java_types": ("src/Types.java", """public interface Open<T> { void open(); }
protected enum Day { MON; }
class Hidden {}
"""),
    "symbols_kotlin": ("src/Main.kt", """class Shop(val size: Int) { fun sell(x: Int = 3, vararg more: String): List<Int> = listOf(); private fun own() {} }
data class Row(val a: String)
interface Open { fun open() }
enum class Day { MON }
object Main { fun run() {} }
internal class Hidden
suspend fun <T> String.parse(a: Map<String, Int>): T? {
}
fun plain() {}
"""),
    "symbols_perl": ("lib/Shop.pm", """package Shop::Till;
sub new { }
sub _own { }
package Shop::Desk;
sub open { }
"""),
    "symbols_ruby": ("lib/shop.rb", """module Store
  class Shop < Base
    def self.load(path, *rest, **opts, &block)
    end
    def sell(what, count = 1)
    end
  end
end
def helper
end
"""),
}

# Manifests by query: paths and texts.
MANIFESTS = {
    "manifest_npm": [
        ("web/app/package.json", '{"name":"@shop/app","version":"2.0.0","description":"Shop window","dependencies":{"types":"workspace:^","view":"^4.1.0"},"devDependencies":{"try":"29"},"peerDependencies":{"dom":">=18"}}'),
        ("web/bare/package.json", '{}'),
    ],
    "manifest_go": [
        ("go.work", 'go 1.22\nuse (\n\t./svc/gate // inner\n)\nuse ./svc/other\n'),
        ("svc/gate/go.mod", 'module github.com/shop/gate\n\ngo 1.22\n\nrequire (\n\tgithub.com/x/web v1.9.1\n\tgithub.com/x/log v0.2.0 // indirect\n\t// github.com/x/no v1.0.0\n)\nrequire github.com/x/one v3.0.0\n'),
        ("tools/go.mod", 'go 1.20\n'),
    ],
    "manifest_cargo": [
        ("Cargo.toml", '[workspace]\nmembers = ["core"]\n[workspace.dependencies]\nserde = { version = "1.0" }\nrand = "0.8"\n'),
        ("core/Cargo.toml", '[package]\nname = "core"\nversion = "0.3.0"\ndescription = "Inner part"\n[dependencies]\nserde = { workspace = true }\nlost = { workspace = true }\nregex = "1.9"\n[dev-dependencies]\nrand = { workspace = true }\n[build-dependencies]\ncc = { version = "1" }\n'),
    ],
    "manifest_pyproject": [
        ("ml/pyproject.toml", '[project]\nname = "ml"\nversion = "0.3.0"\ndependencies = ["tensor>=2.0", "frames", "plot[extra]>=1.1", "typed>=4.0; python_version<\'3.11\'"]\n[project.optional-dependencies]\ntest = ["check>=7"]\n'),
        ("tools/gen/pyproject.toml", '[tool.x]\na = 1\n'),
    ],
    "manifest_maven": [
        ("pom.xml", '<project><groupId>org.shop</groupId><artifactId>parent</artifactId><version>7</version><packaging>pom</packaging><modules><module>till</module></modules><dependencyManagement><dependencies><dependency><groupId>org.w</groupId><artifactId>web</artifactId><version>5</version></dependency></dependencies></dependencyManagement></project>'),
        ("till/pom.xml", '<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>org.shop</groupId><artifactId>parent</artifactId></parent><artifactId>till</artifactId><description>Cash</description><dependencies><dependency><groupId>org.w</groupId><artifactId>web</artifactId></dependency><dependency><groupId>org.t</groupId><artifactId>check</artifactId><version>4</version><scope>test</scope></dependency><dependency><groupId>org.s</groupId><artifactId>api</artifactId><version>3</version><scope>provided</scope></dependency></dependencies></project>'),
        ("lost/pom.xml", '<project></project>'),
    ],
    "manifest_gradle": [
        ("settings.gradle", "rootProject.name = 'shop'\ninclude ':app', ':lib:core'\n"),
        ("build.gradle", "group = 'com.shop'\nversion = '1.2'\n"),
        ("app/build.gradle.kts", 'group = "com.shop"\ndependencies {\n    implementation("a.b:web:1.0")\n    api("a.b:api:2.0")\n    runtimeOnly("a.b:run:3.0")\n    testImplementation("a.b:check:4.0")\n    testRuntimeOnly("a.b:try:5.0")\n    compileOnly(project(":lib:core"))\n}\n'),
        ("lib/core/build.gradle", "dependencies {\n    implementation 'a.b:web:1.0'\n}\n"),
    ],
    "manifest_cpanfile": [
        ("till/cpanfile", "requires 'Web', '1.0';\nrequires 'Log';\non 'test' => sub {\n    requires 'Try', '0.9';\n};\nrequires 'Last';\n"),
    ],
    "manifest_gemfile": [
        ("site/Gemfile", "source 'https://gems.example'\nruby '3.2'\ngem 'web', '~> 7.0'\ngroup :development, :test do\n  gem 'try'\nend\ngem 'db', '>= 1'\n"),
    ],
    "manifest_errors": [
        ("a/package.json", '{'),
        ("b/Cargo.toml", '[workspace]\n'),
        ("c/pom.xml", '<project><artifactId>x</artifactId><packaging>pom</packaging><modules><module>y</module></modules></project>'),
        ("d/pom.xml", '<project></project>'),
    ],
}

# What is expected: name, kind, signature, line, visibility, parent, return type, parameters.
SYMBOLS = {
    "symbols_typescript": [
        ('charge', 'function', 'async function charge(   sum: number, { a, b }: Options = {}, ...tags: string[] ): Promise<Bill>', 2, 'public', None, 'Promise<Bill>', 'sum: number, { a, b }: Options, ...tags: string[]'),
        ('Ledger', 'class', 'class Ledger', 6, 'public', None, None, None),
        ('open', 'method', 'open(): Ledger', 8, 'public', 'Ledger', 'Ledger', ''),
        ('close', 'method', 'close(force?: boolean): void', 8, 'public', 'Ledger', 'void', 'force: boolean'),
        ('label', 'method', 'label()', 10, 'public', 'Ledger', None, ''),
        ('constructor', 'method', 'constructor(private readonly db: Db)', 11, 'public', 'Ledger', None, 'db: Db'),
        ('Options', 'interface', 'interface Options', 13, 'public', None, None, None),
        ('Mode', 'enum', 'enum Mode', 14, 'public', None, None, None),
        ('Id', 'type', 'type Id = string | number;', 15, 'public', None, None, None),
        ('LIMIT', 'constant', 'const LIMIT = 3, FLOOR: number = f(1, 2);', 16, 'public', None, None, None),
        ('FLOOR', 'constant', 'const LIMIT = 3, FLOOR: number = f(1, 2);', 16, 'public', None, None, None),
        ('main', 'function', 'function main(x)', 17, 'public', None, None, 'x'),
    ],
    "symbols_javascript": [
        ('View', 'class', 'class View', 1, 'public', None, None, None),
        ('draw', 'method', 'draw(canvas, depth = 2)', 3, 'public', 'View', None, 'canvas'),
        ('width', 'method', 'width()', 3, 'public', 'View', None, ''),
        ('mount', 'function', 'function mount(node, { deep }, last)', 5, 'public', None, None, 'node, last'),
        ('ROOT', 'constant', 'const ROOT = "r";', 7, 'public', None, None, None),
    ],
    "symbols_go": [
        ('Router', 'struct', 'type Router struct', 3, 'public', None, None, None),
        ('Handler', 'interface', 'type Handler interface', 7, 'public', None, None, None),
        ('NewRouter', 'function', 'func NewRouter(prefix string, size int) (*Router, error)', 11, 'public', None, '(*Router, error)', 'prefix: string, size: int'),
        ('Handle', 'method', 'func (r *Router) Handle(path string, a, b int) error', 15, 'public', 'Router', 'error', 'path: string, a: int'),
    ],
    "symbols_rust": [
        ('Row', 'struct', 'pub struct Row', 1, 'public', None, None, None),
        ('Side', 'enum', 'pub enum Side', 2, 'public', None, None, None),
        ('Walk', 'trait', 'pub trait Walk', 3, 'public', None, None, None),
        ('total', 'function', 'pub fn total(sum: f64, mut cur: &str) -> Result<Row>', 4, 'public', None, 'Result<Row>', 'sum: f64, cur: &str'),
        ('step', 'method', 'pub async fn step(&self, by: Vec<(u8, u8)>) -> Option<u8>', 7, 'public', 'Row<T>', 'Option<u8>', 'by: Vec<(u8, u8)>'),
    ],
    "symbols_python": [
        ('fit', 'function', 'def fit(rows, rate: float=0.1, *marks: str, name=\'x\', **more) -> "Model"', 6, 'public', None, '"Model"', 'rows, rate: float, *marks: str, name'),
        ('Model', 'class', 'class Model', 9, 'public', None, None, None),
        ('__init__', 'method', 'def __init__(self, size: int = 3)', 10, 'public', 'Model', None, 'size: int'),
        ('run', 'method', 'def run(self, /, step, *, deep=True) -> None', 11, 'public', 'Model', 'None', 'step, deep'),
    ],
    "symbols_python_broken": [
        ('first', 'function', 'def first(a)', 1, 'public', None, None, 'a'),
        ('Later', 'class', 'class Later', 6, 'public', None, None, None),
        ('run', 'method', 'def run(self)', 7, 'public', 'Later', None, ''),
    ],
    "symbols_proto": [
        ('Query', 'struct', 'message Query', 2, 'public', None, None, None),
        ('Page', 'struct', 'message Query.Page', 4, 'public', 'Query', None, None),
        ('Order', 'enum', 'enum Query.Order', 5, 'public', 'Query', None, None),
        ('pick', 'type', 'oneof Query.pick', 6, 'public', 'Query', None, None),
        ('Search', 'interface', 'service Search', 8, 'public', None, None, None),
        ('Find', 'method', 'rpc Find(Query) returns (Answer)', 9, 'public', 'Search', 'Answer', 'request: Query'),
        ('Watch', 'method', 'rpc Watch(stream Query) returns (stream Answer)', 10, 'public', 'Search', 'stream Answer', 'request: stream Query'),
        ('State', 'enum', 'enum State', 12, 'public', None, None, None),
    ],
    "symbols_java": [
        ('Shop', 'class', '@Service\npublic final class Shop<T> extends Base implements Open', 3, 'public', None, None, None),
        ('LIMIT', 'constant', 'public static final int LIMIT', 5, 'public', 'Shop', None, None),
        ('sell', 'method', '@Override\n    public <U> Map<String, U> sell(final String what, int[] counts, String... more) throws IOException', 9, 'public', 'Shop', 'Map<String, U>', 'what: String, counts: int[]'),
        ('start', 'function', 'protected static void start()', 11, 'protected', 'Shop', 'void', ''),
        ('stop', 'method', 'public abstract void stop();', 12, 'public', 'Shop', 'void', ''),
    ],
    "symbols_java_types": [
        ('Open', 'interface', 'public interface Open<T>', 1, 'public', None, None, None),
        ('Day', 'enum', 'protected enum Day', 2, 'protected', None, None, None),
    ],
    "symbols_kotlin": [
        ('Shop', 'class', 'class Shop', 1, 'public', None, None, None),
        ('sell', 'method', 'fun sell(x: Int = 3, vararg more: String): List<Int>', 1, 'public', 'Shop', 'List<Int>', 'x: Int, more: String'),
        ('Row', 'class', 'class Row', 2, 'public', None, None, None),
        ('Open', 'interface', 'interface Open', 3, 'public', None, None, None),
        ('open', 'method', 'fun open()', 3, 'public', 'Open', None, ''),
        ('Day', 'enum', 'enum class Day', 4, 'public', None, None, None),
        ('Main', 'class', 'object Main', 5, 'public', None, None, None),
        ('run', 'method', 'fun run()', 5, 'public', 'Main', None, ''),
        ('parse', 'function', 'suspend fun <T> String.parse(a: Map<String, Int>): T?', 7, 'public', None, 'T?', 'a: Map<String, Int>'),
        ('plain', 'function', 'fun plain()', 9, 'public', None, None, ''),
    ],
    "symbols_perl": [
        ('Shop::Till', 'class', 'package Shop::Till', 1, 'public', None, None, None),
        ('new', 'method', 'sub Shop::Till::new', 2, 'public', 'Shop::Till', None, None),
        ('Shop::Desk', 'class', 'package Shop::Desk', 4, 'public', None, None, None),
        ('open', 'method', 'sub Shop::Desk::open', 5, 'public', 'Shop::Desk', None, None),
    ],
    "symbols_ruby": [
        ('Store', 'class', 'module Store', 1, 'public', None, None, None),
        ('Shop', 'class', 'class Shop < Base', 2, 'public', 'Store', None, None),
        ('load', 'function', 'def self.load(path, *rest, **opts, &block)', 3, 'public', 'Shop', None, 'path, rest: *, opts: **, block: &'),
        ('sell', 'method', 'def sell(what, count = 1)', 5, 'public', 'Shop', None, 'what, count'),
        ('helper', 'function', 'def helper', 9, 'public', None, None, ''),
    ],
}

# What is expected: path, name, kind, version, description, metadata, dependency, version_req, dep_kind, failed.
PACKAGES = {
    "manifest_npm": [
        ('web/app/package.json', '@shop/app', 'npm', '2.0.0', 'Shop window', None, 'types', '^', 'runtime', False),
        ('web/app/package.json', '@shop/app', 'npm', '2.0.0', 'Shop window', None, 'view', '^4.1.0', 'runtime', False),
        ('web/app/package.json', '@shop/app', 'npm', '2.0.0', 'Shop window', None, 'try', '29', 'dev', False),
        ('web/app/package.json', '@shop/app', 'npm', '2.0.0', 'Shop window', None, 'dom', '>=18', 'peer', False),
        ('web/bare/package.json', 'web-bare', 'npm', None, None, None, None, None, None, False),
    ],
    "manifest_go": [
        ('svc/gate/go.mod', 'gate', 'go', '1.22', 'github.com/shop/gate', '{"go_workspace":true}', 'github.com/x/web', 'v1.9.1', 'runtime', False),
        ('svc/gate/go.mod', 'gate', 'go', '1.22', 'github.com/shop/gate', '{"go_workspace":true}', 'github.com/x/log', 'v0.2.0', 'runtime', False),
        ('svc/gate/go.mod', 'gate', 'go', '1.22', 'github.com/shop/gate', '{"go_workspace":true}', 'github.com/x/one', 'v3.0.0', 'runtime', False),
        ('tools/go.mod', 'tools', 'go', '1.20', None, None, None, None, None, False),
    ],
    "manifest_cargo": [
        ('Cargo.toml', None, None, None, None, None, None, None, None, True),
        ('core/Cargo.toml', 'core', 'cargo', '0.3.0', 'Inner part', None, 'serde', '1.0', 'runtime', False),
        ('core/Cargo.toml', 'core', 'cargo', '0.3.0', 'Inner part', None, 'lost', None, 'runtime', False),
        ('core/Cargo.toml', 'core', 'cargo', '0.3.0', 'Inner part', None, 'regex', '1.9', 'runtime', False),
        ('core/Cargo.toml', 'core', 'cargo', '0.3.0', 'Inner part', None, 'rand', '0.8', 'dev', False),
        ('core/Cargo.toml', 'core', 'cargo', '0.3.0', 'Inner part', None, 'cc', '1', 'build', False),
    ],
    "manifest_pyproject": [
        ('ml/pyproject.toml', 'ml', 'python', '0.3.0', None, None, 'tensor', '>=2.0', 'runtime', False),
        ('ml/pyproject.toml', 'ml', 'python', '0.3.0', None, None, 'frames', None, 'runtime', False),
        ('ml/pyproject.toml', 'ml', 'python', '0.3.0', None, None, 'plot', '>=1.1', 'runtime', False),
        ('ml/pyproject.toml', 'ml', 'python', '0.3.0', None, None, 'typed', '>=4.0', 'runtime', False),
        ('ml/pyproject.toml', 'ml', 'python', '0.3.0', None, None, 'check', '>=7', 'dev', False),
        ('tools/gen/pyproject.toml', 'tools-gen', 'python', None, None, None, None, None, None, False),
    ],
    "manifest_maven": [
        ('pom.xml', None, None, None, None, None, None, None, None, True),
        ('till/pom.xml', 'org.shop:till', 'maven', '7', 'Cash', None, 'org.w:web', '5', 'runtime', False),
        ('till/pom.xml', 'org.shop:till', 'maven', '7', 'Cash', None, 'org.t:check', '4', 'dev', False),
        ('till/pom.xml', 'org.shop:till', 'maven', '7', 'Cash', None, 'org.s:api', '3', 'peer', False),
        ('lost/pom.xml', None, None, None, None, None, None, None, None, True),
    ],
    "manifest_gradle": [
        ('build.gradle', 'com.shop:shop', 'gradle', '1.2', None, None, None, None, None, False),
        ('app/build.gradle.kts', 'com.shop:app', 'gradle', None, None, '{"gradle_workspace":true}', 'a.b:web', '1.0', 'runtime', False),
        ('app/build.gradle.kts', 'com.shop:app', 'gradle', None, None, '{"gradle_workspace":true}', 'a.b:api', '2.0', 'runtime', False),
        ('app/build.gradle.kts', 'com.shop:app', 'gradle', None, None, '{"gradle_workspace":true}', 'a.b:run', '3.0', 'runtime', False),
        ('app/build.gradle.kts', 'com.shop:app', 'gradle', None, None, '{"gradle_workspace":true}', 'a.b:check', '4.0', 'dev', False),
        ('app/build.gradle.kts', 'com.shop:app', 'gradle', None, None, '{"gradle_workspace":true}', 'a.b:try', '5.0', 'dev', False),
        ('app/build.gradle.kts', 'com.shop:app', 'gradle', None, None, '{"gradle_workspace":true}', ':lib:core', None, 'peer', False),
        ('lib/core/build.gradle', 'lib-core', 'gradle', None, None, '{"gradle_workspace":true}', 'a.b:web', '1.0', 'runtime', False),
    ],
    "manifest_cpanfile": [
        ('till/cpanfile', 'till', 'perl', None, None, None, 'Web', '1.0', 'runtime', False),
        ('till/cpanfile', 'till', 'perl', None, None, None, 'Log', None, 'runtime', False),
        ('till/cpanfile', 'till', 'perl', None, None, None, 'Try', '0.9', 'dev', False),
        ('till/cpanfile', 'till', 'perl', None, None, None, 'Last', None, 'runtime', False),
    ],
    "manifest_gemfile": [
        ('site/Gemfile', 'site', 'ruby', None, None, None, 'web', '~> 7.0', 'runtime', False),
        ('site/Gemfile', 'site', 'ruby', None, None, None, 'try', None, 'dev', False),
        ('site/Gemfile', 'site', 'ruby', None, None, None, 'db', '>= 1', 'runtime', False),
    ],
    "manifest_errors": [
        ('a/package.json', None, None, None, None, None, None, None, None, True),
        ('b/Cargo.toml', None, None, None, None, None, None, None, None, True),
        ('c/pom.xml', None, None, None, None, None, None, None, None, True),
        ('d/pom.xml', None, None, None, None, None, None, None, None, True),
    ],
}


def values(rows: list[tuple], columns: str) -> str:
    """Rows as SQL."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool | int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


def written(parameters):
    """Parameters as one text."""
    return F.when(F.col(parameters).isNotNull(), F.array_join(F.transform(parameters, lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit("")))), ", "))


def symbols(spark: SparkSession, path: str, text: str) -> DataFrame:
    files = spark.createDataFrame([("p", path, bytearray(text.encode()))], "package string, path string, content binary")
    return build.extract_symbols(files).select("name", "kind", "signature", "line", "visibility", "parent_symbol", "return_type", written("parameters").alias("parameters"))


def packages(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    split = [(path, *((path.rpartition("/"))[::2]), text) for path, text in files]
    context = manifests.collect_context([(d, f, text) for _, d, f, text in split])
    found = spark.createDataFrame([(p, d, f, bytearray(text.encode()), "") for p, d, f, text in split], "path string, dir string, filename string, content binary, content_hash string")
    rows = build.parse_manifests(found, context).select("path", "name", "kind", "version", "description", "metadata", F.explode_outer("dependencies").alias("d"), F.col("error").isNotNull().alias("failed"))
    return rows.select("path", "name", "kind", "version", "description", "metadata", "d.dependency", "d.version_req", "d.dep_kind", "failed")


def udtf_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extractors as a table function in a lateral join, over all sources."""
    files = spark.createDataFrame(list(SOURCES.values()), "path string, content string")
    return files.lateralJoin(udtfs.ExtractSymbols(F.col("path").outer(), F.col("content").outer())).select("path", "name", "kind", "signature", "line", "visibility", "parent_symbol", "return_type", written("parameters").alias("parameters"))


def udtf_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsers as a table function in SQL, over manifests that need no context."""
    udtfs.register(spark)
    files = spark.createDataFrame([f for q in ("manifest_npm", "manifest_pyproject", "manifest_cpanfile", "manifest_gemfile", "manifest_errors") for f in MANIFESTS[q]], "path string, content string")
    return spark.sql("SELECT path, name, kind, version, description, metadata, dependency, version_req, dep_kind, error IS NOT NULL AS failed FROM {files}, LATERAL parse_manifest(path, content)", files=files)


_SYMBOL = "name, kind, signature, line, visibility, parent_symbol, return_type, parameters"
_PACKAGE = "path, name, kind, version, description, metadata, dependency, version_req, dep_kind, failed"
for _name, _file in SOURCES.items():
    QUERIES[_name] = lambda spark, sf_dir, file=_file: symbols(spark, *file)
    ORACLE_SQL[_name] = values(SYMBOLS[_name], _SYMBOL)
for _name, _files in MANIFESTS.items():
    QUERIES[_name] = lambda spark, sf_dir, files=_files: packages(spark, files)
    ORACLE_SQL[_name] = values(PACKAGES[_name], _PACKAGE)
QUERIES |= {"udtf_symbols": udtf_symbols, "udtf_manifests": udtf_manifests}
ORACLE_SQL |= {
    "udtf_symbols": values([(SOURCES[q][0], *r) for q, rows in SYMBOLS.items() for r in rows], "path, " + _SYMBOL),
    "udtf_manifests": values([r for q in ("manifest_npm", "manifest_pyproject", "manifest_cpanfile", "manifest_gemfile", "manifest_errors") for r in PACKAGES[q]], _PACKAGE),
}
