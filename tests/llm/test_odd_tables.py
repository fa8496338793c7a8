"""Every registered query over tables of nulls, repeated rows, extra columns with clashing names, and over empty tables."""

import os

import pytest
from pyspark.sql import functions as F

from burrow.llm import queries

#: Names that the operators use themselves.
EXTRA = ["score", "h1", "h2", "evidence_", "host_", "path_", "quality_keep", "toxic_score", "toxic_spans", "lang_pred", "cluster", "component", "component_id", "node", "rep", "part", "tile", "x", "y", "a", "b", "n", "site_n", "held_out", "kept", "label_", "cell", "unit"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG_TEXT = " ".join(WORDS * 3)
NAN = float("nan")

DOCUMENTS = [
    (0, LONG_TEXT, "en", "site", 10), (0, LONG_TEXT, "en", "site", 10), (1, LONG_TEXT, None, None, None), (2, None, None, None, None), (3, "", "en", "site", 0),
    (None, LONG_TEXT, "fr", "site", 1), (None, None, None, None, None), (50, " \t\n ", "xx", "", 4), (51, "word", "fr", None, 4), (52, "\U0001f600 " * 2000, "en", "site", 9),
    *((100 + k, " ".join(WORDS[k % 5 :] + [f"own{k}"] * 3), ("en", "fr")[k % 2], ("site", "other")[k % 3 > 0], 5) for k in range(40)),
    (200, "\x00 nul ퟿ end", "en", "site", 5), (201, "İstanbul İİ ZZZ", "en", "site", 5),
]
LABELS = [(None, 1, 1), (0, None, None), (1, 1, 0), (999, 0, 1), (2, 0, 1), (0, 1, 0), *((100 + k, k % 2, k % 2) for k in range(40))]
VECTORS = [
    (0, [1.0, 0.0, 0.0], 1), (0, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.01, 0.0], 1), (2, [1.0, 0.0, 0.0], None), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1),
    (6, [NAN, 1.0, 0.0], 1), (7, [float("inf"), 1.0, 0.0], 1), (8, [None, 1.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [3.0, 0.0, 0.0], 2), (None, [1.0, 0.0, 0.0], 1), (11, [1e-30, 0.0, 0.0], 1), (12, [3e38, 0.0, 0.0], 1),
]
PAGES = [(0, "https://a.org/1", "<article><p>one</p></article>"), (0, "https://a.org/1", "<article><p>one</p></article>"), (1, None, None), (2, "", ""), (None, None, "<p>x"), (3, "not a url", "<<<>>&#x110000;&bogus;</p></div><"), (4, "http://[", "plain")]
TURNS = [(0, 0, "user", "q"), (0, 0, "user", "q"), (1, 0, "user", "q"), (1, None, None, None), (None, 0, "user", "q"), (None, None, None, None), (2, 0, "", ""), (3, 0, None, None)]
BENCHMARK = [(0, " ".join(WORDS)), (0, " ".join(WORDS)), (1, None), (None, " ".join(WORDS[:9])), (2, ""), (3, "too short")]

TABLES = {
    "documents": (DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long"),
    "labels": (LABELS, "doc_id long, quality int, toxic int"),
    "embeddings": (VECTORS, "vec_id long, embedding array<float>, label int"),
    "pages": (PAGES, "page_id long, url string, html string"),
    "conversations": (TURNS, "conv_id long, turn long, role string, text string"),
    "benchmark": (BENCHMARK, "item_id long, text string"),
}
ROWS = {"op3_quality": "documents", "op4_jaccard": "documents", "op5_wrapper": "pages", "op6_language": "documents", "op7_bytebpe": "documents", "op8_toxicity": "documents", "op9_vectors": "embeddings", "op10_tokencount": "documents"}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("odd"))
    for name, (rows, schema) in TABLES.items():
        df = spark.createDataFrame(rows, schema)
        for c in EXTRA:
            df = df.selectExpr("*", f"cast(null as string) {c}") if c not in df.columns else df
        df.write.parquet(f"{home}/odd/{name}.parquet")
        df.limit(0).write.parquet(f"{home}/none/{name}.parquet")
        (df.limit(0) if name in ("labels", "benchmark") else df).write.parquet(f"{home}/unlabelled/{name}.parquet")
    return home


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
@pytest.mark.parametrize("kind", ["odd", "none", "unlabelled"])
def test_odd_tables(spark, odd, name, kind):
    df = queries.QUERIES[name](spark, os.path.join(odd, kind))
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ROWS:
        assert len(rows) == (0 if kind == "none" else len(TABLES[ROWS[name]][0]))
    if kind == "none":
        assert rows == []


def test_odd_vectors(spark, odd):
    rows = queries.op9_vectors(spark, f"{odd}/odd").collect()
    got = {r["vec_id"]: r for r in rows}
    for alone in (2, 3, 4, 5, 6, 7, 8, 9, 10):
        assert got[alone]["n_links"] == 0 and got[alone]["component_id"] == alone and got[alone]["kept"]
    assert all(got[k]["component_id"] == 0 for k in (0, 1, 11, 12))
    assert all(got[k]["n_links"] == 3 for k in (0, 1, 11, 12))


def test_odd_documents(spark, odd):
    rows = {r["doc_id"]: r for r in queries.op4_jaccard(spark, f"{odd}/odd").collect() if r["doc_id"] is not None}
    assert rows[1]["component_id"] == 0 and rows[2]["n_shingles"] == rows[3]["n_shingles"] == rows[50]["n_shingles"] == 0
    assert rows[2]["component_id"] == 2 and rows[3]["component_id"] == 3 and rows[51]["n_shingles"] == 1
    found = {(r["doc_id"], r["item_id"]) for r in queries.op2_tiling(spark, f"{odd}/odd").collect()}
    assert {(0, 0), (1, 0)} <= found and not {d for d, _ in found} & {2, 3, 50, 51, 52, 200, 201}
    spoken = {r["doc_id"]: r for r in queries.op6_language(spark, f"{odd}/odd").collect()}
    assert spoken[2]["lang_pred"] == spoken[3]["lang_pred"] == spoken[52]["lang_pred"] == "und"


def test_odd_stages(spark, odd):
    """Every stage but the last keeps the columns and their values, and one row of those that are alike."""
    import corpus_pipeline

    docs = queries.table(spark, f"{odd}/odd", "documents").withColumn("score", F.lit("own"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, f"{odd}/odd")
        assert got.columns == columns and all(r["score"] == "own" for r in got.collect()), name
    ids = [r["doc_id"] for r in corpus_pipeline.keep_distinct(spark, docs, f"{odd}/odd").collect()]
    assert ids.count(0) == 1 and 1 not in ids and {2, 3, 50, 51} <= set(ids) and ids.count(None) == 2


def test_one_id_two_texts(spark):
    """Two texts of one doc_id, near copies of different documents: each group keeps one row, and unique texts stay."""
    import corpus_pipeline
    from burrow.llm import jaccard

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a + " own"), (5, b + " own"), (3, a), (9, b), (7, c), (7, a + " end"), (8, b + " x"), (8, b + " y"), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(null as string) lang", "cast(null as string) source")
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_distinct(spark, docs, "").where("doc_id is not null").collect()) == [(3, a), (5, b + " own"), (7, c)]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in jaccard.jaccard_components(spark, docs).collect())
    assert got == [(-1, 7), (3, 3), (5, 3), (5, 5), (7, 3), (7, 7), (8, 5), (8, 5), (9, 5)]
