"""Very long and degenerate texts, odd letters, planted sites, and pipeline stages against brute force."""

import random
import time

import numpy as np
import pytest

from burrow.llm import bytebpe, jaccard, language, quality, queries, tiling, tokencount, toxicity
from tests.llm.test_operators import brute_components, frame, naive_tiles

DATA = "/root/testdata/sf0.001"


def test_toxic_spans_are_places_in_the_text(spark):
    rows = [(("fine calm " * 5 + ("awful rude " if y else "")) + f"word{k}", y) for y in (0, 1) for k in range(30)]
    model = toxicity.train(rows, turns=15)
    texts = ["İİİ awful rude end", "awful İ rude", "plain", None]
    for r in toxicity.score(frame(spark, texts), model).collect():
        found = [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["toxic_spans"]]
        assert found == (["awful", "rude"] if r["doc_id"] < 2 else [])


def test_bundles_do_not_depend_on_slices(monkeypatch):
    texts = ["the quick brown fox", "", "ein Satz über etwas", "中文 字 句 " * 50, "Straße İstanbul"]
    whole = language.bundles(texts)
    monkeypatch.setattr(language, "KINDS", 3)
    assert np.array_equal(language.bundles(texts), whole)
    assert np.array_equal(np.concatenate([language.bundles([t]) for t in texts]), whole)
    monkeypatch.setattr(language, "CUT", 20)
    assert np.array_equal(language.bundles(texts), whole)


def test_language_of_a_long_text_of_varied_letters():
    import tracemalloc

    r = random.Random(2)
    text = "".join(map(chr, r.choices(range(0x4E00, 0x9FFF), k=60_000)))
    tracemalloc.start()
    assert language.bundles([text, "a b"]).shape == (2, language.DIM)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_language_ties_take_the_first_name(spark):
    same = [float(x) for x in language.bundles(["abc abc"])[0]]
    got = language.identify(frame(spark, ["abc"]), {"aa": same, "bb": same}).collect()
    assert got[0]["lang_pred"] == "aa" and got[0]["score"] == pytest.approx(0.5)


def test_memos_are_bounded(monkeypatch):
    own = bytebpe.Codec(queries.vocabulary("byte_bpe_50k.json"))
    r = random.Random(7)
    texts = ["".join(map(chr, r.choices(range(0x4E00, 0x9FFF), k=500))) for _ in range(40)] + ["a word " * 10]
    for t in texts:
        assert own.decode(own.encode(t)).decode() == t
    own.learn([])
    assert all(len(x) <= bytebpe.LONGEST for x in own.memo)
    monkeypatch.setattr(bytebpe, "MEMO_BYTES", 0)
    own.learn(["new"])
    assert len(own.memo) == 1
    counter = tokencount.Counter(queries.vocabulary("word_bpe_49k.json"))
    assert counter.count(texts) == [len(counter.spans(t)) for t in texts] and all(len(x) <= tokencount.LONGEST for x in counter.memo)


def test_both_vocabulary_files_hold_the_same_ranks():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocabulary("byte_bpe_50k.tiktoken"), "rb"))}
    own = bytebpe.codec(queries.vocabulary("byte_bpe_50k.json"))
    assert {own.bytes[i]: i for i in ranks.values()} == ranks


def test_bad_sites_turn_decisions(spark):
    """A text whose own evidence is weak is kept on a good site and rejected on one that is nearly all junk."""
    r = random.Random(4)
    plain = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 8))) for _ in range(n)) + "."
    junk = lambda: " ".join(r.choices(["$$$", "###", "!!!", "BUY", "|"], k=40))
    rows = [(k, plain(40), "en", "good", 1) for k in range(150)] + [(1000 + k, junk(), "en", "bad", 0) for k in range(150)]
    rows += [(2000 + k, plain(40), "en", "mixed", 1) if k % 2 else (2000 + k, junk(), "en", "mixed", 0) for k in range(60)]
    mixed = [plain(30) + " " + " ".join(["!!!"] * n) for n in range(1, 40)]
    docs = [x[:4] for x in rows] + [(10_000 + k, t, "en", "good") for k, t in enumerate(mixed)] + [(20_000 + k, t, "en", "bad") for k, t in enumerate(mixed)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in quality.classify(spark, df, spark.createDataFrame([(x[0], x[4]) for x in rows], "doc_id long, quality int")).collect()}
    assert all(got[x[0]]["quality_keep"] == (x[4] == 1) for x in rows if x[3] != "bad" or x[4] == 0)
    assert got[0]["quality_site"] > 0.8 > 0.4 > got[1000]["quality_site"]
    turned = [k for k in range(len(mixed)) if got[10_000 + k]["quality_keep"] and not got[20_000 + k]["quality_keep"]]
    assert turned and not any(got[20_000 + k]["quality_keep"] and not got[10_000 + k]["quality_keep"] for k in range(len(mixed)))


def test_quality_on_labels_not_fitted_on(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = queries.table(spark, d, "documents", "doc_id", "text", "lang", "source")
    got = quality.classify(spark, docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert len(got) > 100 and np.mean([r["quality_keep"] == (r["quality"] == 1) for r in got]) > 0.97


def test_rows_without_doc_id_link(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(["a", *words])), (None, " ".join(["b", *words])), (2, " ".join([*words, "c"])), (None, " ".join(words[:20])), (None, None)]
    got = jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got if r["n_shingles"] > 20) == [(-1, 58, 1), (1, 58, 1), (2, 58, 1)]
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["n_shingles"] <= 20) == [(0, None), (17, None)]


@pytest.mark.parametrize("tile", [3])
def test_large_clusters_against_brute_force(spark, tile):
    """Clusters of several groups of near copies that a few sets between them join, above the size of a tile."""
    r = random.Random(tile)
    texts = []
    for _ in range(3):
        base = [f"t{r.randrange(99_999)}" for _ in range(60)]
        for k in range(16):
            own = list(base)
            for j in range(k):
                own[59 - j] = f"{base[0]}x{j}"
            texts.append(" ".join(own))
        texts += texts[-2:]
    got = sorted(map(tuple, jaccard.jaccard_components(spark, frame(spark, texts), tile=tile).collect()))
    assert got == brute_components(texts)


def test_stages_against_brute_force(spark):
    """Near duplicates and contaminated documents of the smallest table, by their definitions."""
    import corpus_pipeline

    docs = queries.table(spark, DATA, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(texts)
    groups = {ids[i]: ids[c] for i, _, c in brute_components([texts[d] for d in ids], 5, 80)}
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_distinct(spark, docs, DATA).collect()) == [d for d in ids if groups[d] == d]
    words = lambda t: tiling.WORD.findall(t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [w for r in queries.table(spark, DATA, "benchmark").collect() if len(w := words(r["text"] or "")) >= 5]
    bad = set()
    for d, t in texts.items():
        own = words(t)
        met = grams(own)
        for item in items:
            shared = grams(item) & met
            if 5 * len(shared) >= 0.8 * len(item) or shared and len(grams(item)) < len(item) - 4:
                covered = sum(x[2] for x in naive_tiles(own if len(own) < 400 else own[:0], item))
                fast = sum(x[2] for x in tiling.tiles(*(np.array([hash(w) & 0xFFFFFFFF for w in x], np.uint64) * 2 + 1 for x in (own, item))))
                assert len(own) >= 400 or covered == fast
                if fast >= 0.8 * len(item):
                    bad.add(d)
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_clean(spark, docs, DATA).collect()) == [d for d in ids if d not in bad]
    assert bad


def test_a_repeated_item_in_a_long_document_takes_seconds(spark):
    began = time.monotonic()
    docs = frame(spark, ["same " * 20_000, "same other " * 300, "a b c"])
    bench = spark.createDataFrame([(1, "same " * 400), (2, "a b c d e f")], "item_id long, text string")
    assert [tuple(r)[:2] for r in tiling.contaminated(docs, bench).collect()] == [(0, 1)]
    assert time.monotonic() - began < 60


def test_ranks_encode_long_white_space_and_agree_with_the_library():
    """Both vocabulary files give the same ids and spans, also around white space that overflows the expression's stack."""
    ranked, library = (bytebpe.codec(queries.vocabulary(f"byte_bpe_50k.{x}")) for x in ("tiktoken", "json"))
    r = random.Random(9)
    texts = ["", "a 中文 b", *("".join(r.choices([*"ab 1.,'\n\t\x1c\x85", "  ", "é", "中", "\U0001f600", " ", "　"], k=60)) for _ in range(200))]
    for blank in (" " * 600_000, " \n" * 300_000, "\n" * 600_000, "　" * 20_000, " " * bytebpe.RUN, "\n" * (bytebpe.RUN - 1)):
        texts += [blank, blank + "word", "a" + blank, "a" + blank + "'s 1" + blank + "\x1c", "é" + blank[:-1] + "\t!"]
    for t in texts:
        ids, spans = ranked.encode_with_offsets(t)
        assert ranked.decode(ids) == t.encode()
        if len(t) < 100_000:
            assert (ids, spans) == library.encode_with_offsets(t)
        else:
            assert ids == library.encode(t)


def test_copies_of_a_set_are_one_entry_of_a_list():
    """Two sets that 20 slices hold under one key are a pair to be checked, not a long list that links them unseen."""
    import numpy as np
    import pyarrow as pa

    def row(ids, mark=0):
        return {"keys": np.full(len(ids), 7, np.uint64).tobytes(), "ids": np.array(ids, np.uint64).tobytes(), "marks": np.array([mark] + [0] * (len(ids) - 1), np.uint8).tobytes(), "a": b"", "b": b""}

    assert jaccard._scan_lists(pa.Table.from_pylist([row([3, 5])] * 20)).to_pylist() == [{"a": 3, "b": 5, "sure": False}]
    assert jaccard._scan_lists(pa.Table.from_pylist([row([3, 5])] * 20 + [row([3], 1)])).to_pylist() == [{"a": 3, "b": 5, "sure": True}]
    many = jaccard._scan_lists(pa.Table.from_pylist([row([*range(1, 2 + jaccard.LONG)])])).to_pylist()
    assert many == [{"a": 1, "b": k, "sure": True} for k in range(2, 2 + jaccard.LONG)]


def test_thinned_rows_hold_all_wanted_and_few_others(spark):
    docs = spark.range(20_000).selectExpr("nullif(id, 0) doc_id", "concat('text ', id) text").withColumn("t", jaccard.text_key())
    wanted = docs.where("doc_id is null or doc_id % 50 = 7")
    got = [r["text"] for r in jaccard.thinned(docs, wanted.select(jaccard.row_key("doc_id", "t").alias("key")), wanted.count()).collect()]
    assert {r["text"] for r in wanted.collect()} <= set(got) and len(got) == len(set(got)) < 401 + 600


def test_components_of_few_and_of_many_edges_are_alike(spark):
    from burrow.llm.common import Scratch, components

    r = random.Random(3)
    edges = spark.createDataFrame([(r.randrange(3000) - 1500, r.randrange(3000) - 1500) for _ in range(1400)] + [(5000 + k, 5001 + k) for k in range(300)], "a long, b long")
    rows = [sorted(map(tuple, components(edges, Scratch(spark), "x", few=few).collect())) for few in (0, 10_000)]
    assert rows[0] == rows[1] and (5300, 5000) in rows[1]
    assert components(edges.where("a > 9000"), Scratch(spark), "x").collect() == []
