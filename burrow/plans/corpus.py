"""A synthetic corpus over the driver's tables: packages, dependencies, files and symbols as the engine stores them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burrow.operators import maintain, ownership


class Corpus:
    """Relations derived from one directory of driver tables; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def web(self) -> DataFrame:
        return self.table("pages").select(
            "page_id", "url",
            F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"),
            F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1).alias("sect"),
            F.length("html").cast("long").alias("n"),
        )

    def packages(self) -> DataFrame:
        part, web = self.table("part"), self.web()
        none = F.lit(None).cast("string")
        parts = part.select(
            F.concat(F.lit("part-"), "p_partkey").alias("name"),
            F.concat(F.lit("parts/"), F.lower("p_type"), F.lit("/"), "p_partkey").alias("path"),
            F.lower("p_type").alias("kind"), F.concat("p_size", F.lit(".0")).alias("version"), F.col("p_name").alias("description"),
        )
        sites = web.groupBy("host").count().where("count >= 3").select(F.col("host").alias("name"), F.col("host").alias("path"), F.lit("site").alias("kind"), none.alias("version"), none.alias("description"))
        at = F.concat("host", F.lit("/"), "sect")
        sections = web.groupBy("host", "sect").count().where("count >= 2").select(at.alias("name"), at.alias("path"), F.lit("section").alias("kind"), none.alias("version"), none.alias("description"))
        return parts.unionByName(sites).unionByName(sections)

    def files_raw(self) -> DataFrame:
        ext = F.when(F.col("url").contains(".html"), "html").when(F.col("url").contains("?"), "ts").otherwise("")
        return self.web().select(
            F.concat("host", F.lit("/"), "sect", F.lit("/"), "page_id", F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))).alias("path"),
            ext.alias("extension"), F.col("n").alias("size_bytes"),
        )

    def files(self) -> DataFrame:
        return ownership.assign_owner(self.files_raw(), self.packages())

    def edges(self) -> DataFrame:
        """A part depends on the next part of its order, and on the supplier, a package outside; every line counts."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_shipdate")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_extendedprice", "l_shipdate").withColumn("nxt", F.lead("l_partkey").over(order))
        kind = F.when(F.col("l_returnflag") == "A", "dev").when(F.col("l_returnflag") == "R", "peer").otherwise("runtime")
        required = F.concat(F.lit("^"), F.max("l_linenumber")).alias("version_req")
        named = lambda prefix, c, to: F.concat(F.lit(prefix), c).alias(to)
        inner = lines.where("nxt is not null").groupBy("l_partkey", "nxt", kind.alias("dep_kind")).agg(required)
        outer = lines.groupBy("l_partkey", "l_suppkey").agg(required)
        inner = inner.select(named("part-", "l_partkey", "package"), named("part-", "nxt", "dependency"), "dep_kind", "version_req")
        return inner.unionByName(outer.select(named("part-", "l_partkey", "package"), named("ext-", "l_suppkey", "dependency"), F.lit("runtime").alias("dep_kind"), "version_req"))

    def dependencies(self) -> DataFrame:
        return maintain.mark_internal(self.edges(), self.packages())

    def symbols(self) -> DataFrame:
        lines = self.table("documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "ln")).where("ln <> ''")
        return lines.select(
            F.col("source").alias("package"), F.regexp_extract("ln", r"^([^ .,]+)", 1).alias("name"), F.col("lang").alias("kind"), F.col("ln").alias("signature"),
            F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"), (F.col("pos") + 1).cast("long").alias("line"),
        )

    def events(self) -> DataFrame:
        return self.table("events")


#: The same relations as DuckDB common table expressions.
SQL = r"""
web AS (SELECT page_id, url, regexp_extract(url,'^https?://([^/]+)',1) AS host, regexp_extract(url,'^https?://[^/]+/([^/?#]+)',1) AS sect,
  CAST(length(html) AS BIGINT) AS n FROM pages),
packages AS (
  SELECT concat('part-',p_partkey) AS name, concat('parts/',lower(p_type),'/',p_partkey) AS path, lower(p_type) AS kind, concat(p_size,'.0') AS version, p_name AS description FROM part
  UNION ALL SELECT host, host, 'site', NULL, NULL FROM web GROUP BY host HAVING count(*)>=3
  UNION ALL SELECT concat(host,'/',sect), concat(host,'/',sect), 'section', NULL, NULL FROM web GROUP BY host, sect HAVING count(*)>=2),
files_raw AS (SELECT concat(host,'/',sect,'/',page_id, CASE WHEN url LIKE '%.html%' THEN '.html' WHEN url LIKE '%?%' THEN '.ts' ELSE '' END) AS path,
  CASE WHEN url LIKE '%.html%' THEN 'html' WHEN url LIKE '%?%' THEN 'ts' ELSE '' END AS extension, n AS size_bytes FROM web),
files AS (SELECT f.path, (SELECT p.name FROM packages p WHERE p.kind IN ('site','section') AND (f.path = p.path OR starts_with(f.path, p.path || '/')) ORDER BY length(p.path) DESC LIMIT 1) AS package,
  f.extension, f.size_bytes FROM files_raw f),
l AS (SELECT l_orderkey,l_partkey,l_suppkey,l_returnflag,l_linenumber, lead(l_partkey) OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber,l_partkey,l_suppkey,l_returnflag,l_extendedprice,l_shipdate) AS nxt FROM lineitem),
e AS (SELECT concat('part-',l_partkey) AS package, concat('part-',nxt) AS dependency,
  CASE l_returnflag WHEN 'A' THEN 'dev' WHEN 'R' THEN 'peer' ELSE 'runtime' END AS dep_kind, l_linenumber AS v FROM l WHERE nxt IS NOT NULL
  UNION ALL SELECT concat('part-',l_partkey), concat('ext-',l_suppkey), 'runtime', l_linenumber FROM l),
edges AS (SELECT package,dependency,dep_kind,concat('^',max(v)) AS version_req FROM e GROUP BY package,dependency,dep_kind),
dependencies AS (SELECT edges.*, dependency IN (SELECT name FROM packages) OR dependency IN (SELECT description FROM packages WHERE kind='go' AND description IS NOT NULL) AS is_internal FROM edges),
symbols AS (SELECT source AS package, regexp_extract(ln,'^([^ .,]+)',1) AS name, lang AS kind, ln AS signature, concat('docs/',source,'/',doc_id,'.txt') AS file_path, CAST(pos AS BIGINT) AS line
  FROM (SELECT *, unnest(string_split(text,chr(10))) AS ln, generate_subscripts(string_split(text,chr(10)),1) AS pos FROM documents) WHERE ln<>'')
"""
