"""One registered query per operator over the synthetic corpus, with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.functions import classify, hashing
from burrow.operators import aggregate, discovery, graph, lookup, maintain, ownership, search
from burrow.plans.corpus import SQL, Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ROOT = "part-0"
SITE = "blog.tionsh.example.net"


def query(sql: str):
    """Registers a function of a corpus under its own name, with SQL that continues the corpus' WITH clause."""

    def add(f: Callable[[Corpus], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {SQL.strip()}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}"
        return f

    return add


def norm(column: str) -> str:
    return rf"(' ' || trim(regexp_replace(lower(translate({column}, '{search.MARKED}', '{search.PLAIN}')), '[^\pL\pN]+', ' ', 'g')) || ' ')"


def hits(columns: list[str], text: str) -> str:
    return "(" + " OR ".join(f"coalesce(contains({norm(c)}, '{search.phrase(text)}'), false)" for c in columns) + ")"


@query("SELECT * FROM packages WHERE name='part-0'")
def get_package(c):
    return lookup.get_package(c.packages(), ROOT)


@query("SELECT * FROM packages ORDER BY name")
def list_packages(c):
    return lookup.list_packages(c.packages())


@query("SELECT * FROM packages WHERE kind='site' ORDER BY name")
def list_packages_by_kind(c):
    return lookup.list_packages(c.packages(), "site")


@query("SELECT package, dependency, dep_kind, version_req, is_internal FROM dependencies WHERE package='part-0'")
def package_dependencies(c):
    return lookup.package_dependencies(c.dependencies(), ROOT)


@query("SELECT package, dependency, dep_kind, version_req, is_internal FROM dependencies WHERE package='part-0' AND is_internal")
def package_dependencies_internal(c):
    return lookup.package_dependencies(c.dependencies(), ROOT, True)


@query("SELECT package, dependency, dep_kind, version_req, is_internal FROM dependencies WHERE dependency='part-0'")
def package_dependents(c):
    return lookup.package_dependents(c.dependencies(), ROOT)


@query("SELECT * FROM symbols WHERE package='src3' ORDER BY file_path, line")
def package_symbols(c):
    return lookup.package_symbols(c.symbols(), "src3")


@query("SELECT * FROM symbols WHERE package='src3' AND kind='fr' ORDER BY file_path, line")
def package_symbols_kind(c):
    return lookup.package_symbols(c.symbols(), "src3", "fr")


@query("SELECT * FROM symbols WHERE file_path='docs/src6/6.txt' ORDER BY line")
def file_symbols(c):
    return lookup.file_symbols(c.symbols(), "docs/src6/6.txt")


@query("SELECT * FROM symbols WHERE name='The'")
def get_symbol(c):
    return lookup.get_symbol(c.symbols(), "The")


@query("SELECT * FROM symbols WHERE name='The' AND package='src7'")
def get_symbol_scoped(c):
    return lookup.get_symbol(c.symbols(), "The", "src7")


@query(f"SELECT * FROM files WHERE package='{SITE}/en' ORDER BY path")
def package_files(c):
    return lookup.package_files(c.files(), f"{SITE}/en")


@query("SELECT * FROM files WHERE package LIKE 'blog.ththan.example.net%' AND extension='ts' ORDER BY path")
def package_files_ext(c):
    return c.files().where(F.col("package").startswith("blog.ththan.example.net") & (F.col("extension") == "ts")).orderBy("path")


@query(r"SELECT * FROM packages WHERE path ILIKE 'parts/S%' ESCAPE '\' ORDER BY path LIMIT 50")
def path_prefix(c):
    return lookup.packages_by_path_prefix(c.packages(), "parts/S")


@query("""SELECT CAST(NULL AS VARCHAR) AS indexed_at, CAST(NULL AS VARCHAR) AS git_commit, (SELECT CAST(count(*) AS VARCHAR) FROM packages) AS package_count,
  (SELECT CAST(count(*) AS VARCHAR) FROM symbols) AS symbol_count, (SELECT CAST(count(*) AS VARCHAR) FROM files) AS file_count, CAST(NULL AS VARCHAR) AS total_duration_ms""")
def index_status(c):
    return lookup.index_status(aggregate.counts(c.packages(), c.symbols(), c.files_raw()).withColumn("value", F.col("value").cast("string")))


@query(f"SELECT * FROM packages WHERE {hits(['name', 'description', 'path'], 'part 1')} ORDER BY name LIMIT 20")
def search_packages(c):
    return search.search_packages(c.packages(), "part 1")


@query(f"SELECT * FROM symbols WHERE {hits(['name', 'kind', 'signature', 'file_path'], 'of the')} ORDER BY file_path, line, name LIMIT 50")
def search_symbols(c):
    return search.search_symbols(c.symbols(), "of the")


@query(f"SELECT * FROM symbols WHERE package='src2' AND kind='en' AND {hits(['name', 'kind', 'signature', 'file_path'], 'the')} ORDER BY file_path, line, name LIMIT 50")
def search_symbols_pkg_kind(c):
    return search.search_symbols(c.symbols(), "the", "src2", "en")


@query(f"SELECT * FROM files WHERE {hits(['path'], 'example.com')} ORDER BY path LIMIT 50")
def search_files(c):
    return search.search_files(c.files(), "example.com")


@query(f"SELECT * FROM files WHERE extension='html' AND {hits(['path'], 'example net')} ORDER BY path LIMIT 50")
def search_files_filtered(c):
    return search.search_files(c.files(), "example net", extension="html")


@query(f"SELECT file_path, line FROM symbols WHERE {hits(['signature'], 'to be')}")
def search_postings(c):
    """Phrase search through the postings index: rows with every word, then the phrase itself."""
    s, key = c.symbols().select("file_path", "line", "signature"), ["file_path", "line"]
    near = search.postings_candidates(search.postings(s, key, ["signature"]), key, "to be")
    return s.join(near, key, "left_semi").where(search.matches(["signature"], "to be")).select(*key)


@query(f"SELECT file_path, line, name FROM symbols WHERE {hits(['name', 'kind', 'signature', 'file_path'], 'as the')} ORDER BY file_path, line, name LIMIT 50")
def search_symbols_indexed(c):
    """The search as an index answers it, through stored postings."""
    s = c.symbols()
    return search.search_symbols(s, "as the", index=search.stored_postings(s)).select("file_path", "line", "name")


@query("SELECT extension, count(*) AS count FROM files_raw WHERE extension<>'' GROUP BY extension ORDER BY count DESC, extension")
def extension_distribution(c):
    return aggregate.extension_distribution(c.files_raw())


@query("SELECT package, kind, count(*) AS count FROM symbols GROUP BY package, kind")
def kind_histogram(c):
    return aggregate.kind_histogram(c.symbols())


@query("SELECT kind, count(*) AS count, array_to_string(list(name ORDER BY name), ',') AS names FROM packages GROUP BY kind ORDER BY kind")
def packages_by_kind(c):
    return aggregate.packages_by_kind(c.packages()).withColumn("names", F.array_join("names", ","))


@query("SELECT package, dependency, dep_kind, version_req, is_internal FROM dependencies")
def recompute_internal(c):
    return c.dependencies()


@query("SELECT * FROM files")
def file_ownership(c):
    return c.files()


@query("SELECT f.path, p.name AS owner FROM files_raw f JOIN packages p ON f.path = p.path OR starts_with(f.path, p.path || '/')")
def all_owners(c):
    return ownership.all_owners(c.files_raw(), c.packages()).select("path", "owner")


@query("SELECT * FROM symbols WHERE package NOT IN (SELECT name FROM packages)")
def orphan_symbols(c):
    return maintain.orphans(c.symbols(), c.packages())


@query("SELECT package, dependency, dep_kind, version_req FROM edges WHERE package NOT IN (SELECT name FROM packages WHERE kind <> 'economy')")
def orphan_dependencies(c):
    return maintain.orphans(c.edges(), c.packages().where("kind <> 'economy'"))


@query("""+ walked AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, sha256(concat(o_orderstatus, '-', o_custkey)) AS h FROM orders WHERE o_orderkey%11<>0),
stored AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, sha256(concat(o_orderstatus, '-', CASE WHEN o_orderkey%7=0 THEN o_custkey+1 ELSE o_custkey END)) AS h FROM orders WHERE o_orderkey%5<>0)
SELECT coalesce(w.path, s.path) AS path, coalesce(w.h, s.h) AS content_hash, CASE WHEN s.h IS NULL THEN 'new' WHEN w.h IS NULL THEN 'removed' WHEN w.h<>s.h THEN 'changed' ELSE 'unchanged' END AS state
FROM walked w FULL OUTER JOIN stored s ON w.path=s.path""")
def manifest_diff(c):
    o = c.table("orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    digest = lambda k: F.sha2(F.concat_ws("-", "o_orderstatus", k), 256)
    path = F.col("o_orderkey").cast("string").alias("path")
    walked = o.where("o_orderkey % 11 <> 0").select(path, digest(F.col("o_custkey")).alias("content_hash"))
    stored = o.where("o_orderkey % 5 <> 0").select(path, digest(F.expr("if(o_orderkey % 7 = 0, o_custkey + 1, o_custkey)")).alias("content_hash"))
    return maintain.diff(walked, stored)


@query("""+ fresh AS (SELECT name, path, kind, '9.9' AS version, description FROM packages WHERE kind='small'
  UNION ALL SELECT 'renamed-' || name, path, kind, version, description FROM packages WHERE kind='site')
SELECT * FROM fresh UNION ALL SELECT * FROM packages WHERE name NOT IN (SELECT name FROM fresh) AND path NOT IN (SELECT path FROM fresh)""")
def upsert_packages(c):
    p = c.packages()
    fresh = p.where("kind = 'small'").withColumn("version", F.lit("9.9")).unionByName(p.where("kind = 'site'").withColumn("name", F.concat(F.lit("renamed-"), "name")))
    return maintain.upsert(p, fresh, ["name", "path"])


@query("SELECT package, dependency, arg_max(version_req, dep_kind) AS version_req, max(dep_kind) AS dep_kind FROM edges GROUP BY package, dependency")
def upsert_dedup(c):
    return maintain.keep_last(c.edges(), ["package", "dependency"], "dep_kind")


@query("""SELECT package, dependency, dep_kind, version_req FROM edges WHERE package NOT IN (SELECT name FROM packages WHERE path LIKE 'parts/promo%')""")
def remove_deleted(c):
    gone = c.packages().where(F.col("path").startswith("parts/promo")).select("path")
    return maintain.remove_paths(c.packages(), {"dependencies": c.edges()}, gone)["dependencies"]


@query("SELECT name, path, kind, version, CASE WHEN kind='site' THEN 'site ' || name ELSE description END AS description FROM packages")
def config_overrides(c):
    p = c.packages()
    return maintain.override_descriptions(p, p.where("kind = 'site'").select("name", F.concat(F.lit("site "), "name").alias("description")))


@query("SELECT path, CASE WHEN package IN (SELECT name FROM packages WHERE kind='site') THEN package END AS package, extension, size_bytes FROM files")
def repaired_files(c):
    """Files of packages that the index lost belong to none."""
    return maintain.repair(c.packages().where("kind = 'site'"), c.symbols(), c.edges(), c.files())[2]


@query("SELECT package, dependency, dep_kind, version_req FROM edges WHERE package IN (SELECT name FROM packages WHERE kind='small')")
def repaired_dependencies(c):
    return maintain.repair(c.packages().where("kind = 'small'"), c.symbols(), c.edges(), c.files())[1]


@query("SELECT 'x-' || name AS name, 'none' AS description FROM packages WHERE kind='site'")
def unknown_overrides(c):
    sites = c.packages().where("kind = 'site'").select("name", F.lit("none").alias("description"))
    return maintain.unknown_overrides(c.packages(), sites.unionByName(sites.withColumn("name", F.concat(F.lit("x-"), "name"))))


@query("SELECT source AS package, sha256(string_agg(sha256(text), '' ORDER BY concat('docs/', source, '/', doc_id, '.txt'))) AS content_hash FROM documents GROUP BY source")
def source_hash(c):
    d = c.table("documents").select(F.col("source").alias("package"), F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("hash"))
    return hashing.source_hash(d)


@query("""SELECT sha256(unhex(string_agg(hex(path) || array_to_string(list_transform(range(7,-1,-1), lambda i: substr(lpad(hex(size_bytes),16,'0'), CAST(i*2+1 AS BIGINT), 2)),''), '' ORDER BY path))) AS tree_hash FROM files_raw""")
def file_tree_hash(c):
    return hashing.tree_hash(c.files_raw())


@query("""SELECT CAST(user_id AS VARCHAR) AS package, coalesce(max(ts) FILTER (WHERE event_type <> 'view') > max(ts) FILTER (WHERE event_type = 'view'), false) AS is_newer
FROM events GROUP BY user_id HAVING max(ts) FILTER (WHERE event_type = 'view') IS NOT NULL""")
def newer_sources(c):
    e = c.events().select(F.col("user_id").cast("string").alias("package"), "ts", "event_type")
    return hashing.newer(e.where("event_type <> 'view'").select("package", F.col("ts").alias("mtime")), e.where("event_type = 'view'").groupBy("package").agg(F.max("ts").alias("hashed_at")))


def walk(depth: int, where: str = "true", start: str = ROOT, turned: bool = False) -> str:
    """SQL of a bounded traversal: nodes with their least depth, then the edges out of those nearer than ``depth``."""
    src, dst = ("dependency", "package") if turned else ("package", "dependency")
    edges = '"to" AS "from", "from" AS "to"' if turned else '"from", "to"'
    return f"""+ steps AS (SELECT '{start}' AS node, 0 AS d UNION SELECT x.{dst}, s.d+1 FROM steps s JOIN dependencies x ON x.{src}=s.node WHERE s.d+1<{depth} AND {where}),
near AS (SELECT node, min(d) AS depth FROM steps GROUP BY node),
found AS (SELECT x.{src} AS "from", x.{dst} AS "to", x.dep_kind, CAST(n.depth AS INTEGER) AS depth FROM dependencies x JOIN near n ON x.{src}=n.node WHERE {where}),
result AS (SELECT {edges}, dep_kind, depth FROM found)"""


@query(walk(1) + " SELECT * FROM result")
def dep_graph_d1(c):
    return graph.dependency_graph(graph.settled(c.dependencies()), ROOT, 1)


@query(walk(2) + " SELECT * FROM result")
def dep_graph_d2(c):
    return graph.dependency_graph(graph.settled(c.dependencies()), ROOT, 2)


@query(walk(3) + " SELECT * FROM result")
def dep_graph_d3(c):
    return graph.dependency_graph(graph.settled(c.dependencies()), ROOT, 3)


@query(walk(3, "is_internal") + " SELECT * FROM result")
def dep_graph_internal(c):
    return graph.dependency_graph(graph.settled(c.dependencies()), ROOT, 3, True)


@query(walk(3, "is_internal", turned=True) + " SELECT * FROM result")
def reverse_graph(c):
    return graph.reverse_dependency_graph(graph.settled(c.dependencies()), ROOT, 3)


@query(walk(10, "is_internal", turned=True) + """, direct AS (SELECT DISTINCT package FROM dependencies WHERE dependency='part-0'), reach AS (SELECT DISTINCT "from" AS package FROM result)
SELECT (SELECT count(*) FROM direct) AS direct, (SELECT count(*) FROM reach) AS total, (SELECT count(*) FROM reach WHERE package NOT IN (SELECT package FROM direct)) AS transitive_only""")
def impact_summary(c):
    return graph.impact(graph.settled(c.dependencies()), ROOT)


BETWEEN = walk(3) + """, goal AS (SELECT max("to") AS g FROM result), back AS (SELECT g AS node FROM goal UNION SELECT r."from" FROM back b JOIN result r ON r."to"=b.node),
path AS (SELECT "from", "to", dep_kind FROM result WHERE "from" IN (SELECT node FROM back) AND "to" IN (SELECT node FROM back))"""


def between(c):
    """The last package by name that ROOT reaches in three steps, and the edges on the way to it."""
    forward = graph.settled(graph.dependency_graph(graph.settled(c.dependencies()), ROOT, 3))
    end = forward.agg(F.max("to")).first()[0] or ROOT
    return end, graph.path_within(forward, end, 3)


@query(BETWEEN + " SELECT * FROM path")
def path_between(c):
    return between(c)[1]


@query(BETWEEN + """ SELECT n.name, p.path, p.kind, p.description FROM (SELECT "from" AS name FROM path UNION SELECT "to" FROM path) n LEFT JOIN packages p USING (name)
WHERE n.name <> 'part-0' AND n.name <> (SELECT g FROM goal)""")
def intermediates(c):
    end, path = between(c)
    return graph.intermediates(path, c.packages(), ROOT, end)


@query(f"""+ m AS (SELECT * FROM packages WHERE {hits(['name', 'description', 'path'], 'example')} ORDER BY name LIMIT 20)
SELECT m.name, m.path, count(f.path) AS files FROM m LEFT JOIN files f ON f.package=m.name GROUP BY m.name, m.path""")
def explore_matches(c):
    found = search.search_packages(c.packages(), "example")
    return found.join(c.files().groupBy(F.col("package").alias("name")).agg(F.count("*").alias("n")), "name", "left").select("name", "path", F.coalesce("n", F.lit(0)).alias("files"))


@query(f"""+ m AS (SELECT name FROM packages WHERE {hits(['name', 'description', 'path'], 'example')} ORDER BY name LIMIT 20)
SELECT * FROM files WHERE package IS NULL OR package NOT IN (SELECT name FROM m)""")
def explore_orphans(c):
    found = search.search_packages(c.packages(), "example").select(F.col("name").alias("package"))
    return c.files().join(found, "package", "left_anti")


@query("SELECT p.kind, count(DISTINCT p.name) AS packages, count(f.path) AS files, CAST(coalesce(sum(f.size_bytes), 0) AS BIGINT) AS bytes FROM packages p LEFT JOIN files f ON f.package=p.name WHERE p.kind IN ('site', 'section') GROUP BY p.kind")
def area_summary(c):
    per = c.files().groupBy(F.col("package").alias("name")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    return c.packages().where("kind in ('site', 'section')").join(per, "name", "left").groupBy("kind").agg(F.count("*").alias("packages"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))


#: Command lines made of the events' types.
COMMAND_SQL = "CASE event_id % 7 WHEN 0 THEN 'git status | grep ' || event_type WHEN 1 THEN 'mv ' || event_type || ' x' WHEN 2 THEN '(cat a && ls ' || event_type || ')' WHEN 3 THEN 'echo hi && rm ' || event_type WHEN 4 THEN event_type WHEN 5 THEN 'cargo test; go vet ./' || event_type ELSE NULL END"
PREFIXES = "[" + ", ".join(f"'{p}'" for p in classify.READ_ONLY) + "]"


@query(f"""+ cmd AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'Edit' ELSE 'Bash' END AS tool, {COMMAND_SQL} AS command FROM events),
parts AS (SELECT event_id, tool, command, list_filter(flatten(list_transform(regexp_split_to_array(command, '[|;]'), lambda s: list_transform(string_split(trim(ltrim(trim(s), '(')), '&&'), lambda t: trim(t)))), lambda s: s <> '') AS segs FROM cmd)
SELECT event_id, tool <> 'Bash' OR command IS NULL OR NOT coalesce(list_bool_and(list_transform(segs, lambda s: list_bool_or(list_transform({PREFIXES}, lambda p: starts_with(s, p))))), true) AS rebuild FROM parts""")
def readonly_classifier(c):
    e = c.events().select("event_id", F.expr("if(event_id % 11 = 0, 'Edit', 'Bash')").alias("tool"), F.expr(COMMAND_SQL).alias("command"))
    return e.select("event_id", classify.should_rebuild(F.col("tool"), F.col("command")).alias("rebuild"))


MANIFESTS, EXTENSIONS = ["package.json", "go.mod"], ["ts", "py", "rs"]
CHANGED_SQL = "CASE event_id % 6 WHEN 0 THEN '/repo/a/' || event_type || '.ts' WHEN 1 THEN '/repo/' || event_type || '.md' WHEN 2 THEN '/repo/x/package.json' WHEN 3 THEN '/other/a.ts' WHEN 4 THEN '/repo/burrow.toml' ELSE '/repo/.gitignore' END"


@query(f"""+ ch AS (SELECT user_id, {CHANGED_SQL} AS path FROM events)
SELECT user_id, bool_or(starts_with(path, '/repo/') AND (string_split(path,'/')[-1] IN ('burrow.toml','package.json','go.mod') OR regexp_extract(string_split(path,'/')[-1], '\\.([^.]*)$', 1) IN ('ts','py','rs'))) AS relevant FROM ch GROUP BY user_id""")
def relevance_filter(c):
    e = c.events().select("user_id", F.expr(CHANGED_SQL).alias("path"))
    return e.groupBy("user_id").agg(F.bool_or(classify.is_relevant(F.col("path"), "/repo", "burrow.toml", MANIFESTS, EXTENSIONS)).alias("relevant"))


@query("""+ d AS (SELECT concat(host,'/',sect) AS dir, bool_or(url LIKE '%.html%') AS a, bool_or(url LIKE '%?%' AND url NOT LIKE '%.html%') AS b FROM web GROUP BY host, sect)
SELECT 'site:' || dir AS name, dir AS path, 'pages' AS kind, '{"custom_rule":"pages"}' AS metadata FROM d WHERE a AND b AND dir NOT LIKE 'www%'""")
def custom_discovery(c):
    files = c.files_raw().select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.substring_index("path", "/", -1).alias("filename"))
    dirs = files.groupBy("dir").agg(F.collect_set("filename").alias("filenames"))
    known = dirs.where(F.col("dir").startswith("www")).select(F.col("dir").alias("path"))
    return discovery.discover(dirs, [discovery.Rule("pages", "pages", ("*.html", "*.ts"), name_prefix="site:")], [], known)
