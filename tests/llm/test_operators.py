"""The training-data operators against brute force, exact round trips and held-out accuracy, on small inputs."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest

from burrow.llm import bytebpe, jaccard, language, preference, quality, queries, tiling, tokencount, toxicity, vectors, wrapper

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "a", "ab cd", "x " * 30_000, "été ÉTÉ", "a  b\n\n c \u2003d", "<|endoftext|> x"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_preference_cases(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (2, 0, "user", "z"), (4, 0, None, None), (5, 0, None, None), (6, 0, "user", "q"), (7, 0, "user", "q"), (7, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    got = {r["pair_id"]: r for r in preference.preference_pairs(df, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2))).collect()}
    assert got[0]["n_prefix"] == 1 and got[0]["prompt"] == "<|user|>\nq<|end|>\n" and got[0]["chosen"] == "<|assistant|>\na<|end|>\n"
    a, b = map(int, got[0]["chosen_mask"].split("-"))
    assert got[0]["chosen"][a:b] == "a<|end|>\n"
    assert got[1]["rejected_id"] is None and got[1]["n_prefix"] == 0 and got[1]["rejected"] == ""
    assert got[2]["n_prefix"] == 1 and got[2]["chosen"] == ""
    assert got[3]["chosen"] == "" and got[3]["n_prefix"] == 1 and got[3]["rejected_mask"]


def test_tiling_catches_reordered_passages(spark):
    item = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None)], "item_id long, text string")
    turned = " ".join([*item[15:], "noise", "noise", *item[:15]])
    got = tiling.contaminated(frame(spark, [turned, " ".join(item[:20]), ""]), bench).collect()
    assert [tuple(r) for r in got] == [(0, 1, 30, 30, 1.0, 2)]


def naive_tiles(doc, item, least=5):
    """Greedy string tiling by its definition."""
    doc, item, found = list(doc), list(item), []
    while True:
        best = []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and doc[i + n] is not None:
                    n += 1
                best.append((-n, i, j))
        best.sort()
        if not best or -best[0][0] < least:
            return found
        longest = best[0][0]
        for n, i, j in best:
            if n == longest and None not in doc[i : i - n] and None not in item[j : j - n]:
                found.append((i, j, -n))
                doc[i : i - n], item[j : j - n] = [None] * -n, [None] * -n


@pytest.mark.parametrize("seed", range(12))
def test_tiles_against_the_definition(seed, monkeypatch):
    r = random.Random(seed)
    kinds = (2, 3, 30)[seed % 3]
    item = [r.randrange(kinds) for _ in range(r.randrange(5, 40))]
    doc = [r.randrange(kinds) for _ in range(r.randrange(0, 60))]
    for _ in range(2):
        a = r.randrange(len(item))
        doc += item[a : a + r.randrange(1, 20)]
    arrays = [np.array(x, np.uint64) * 2 + 1 for x in (doc, item)]
    assert tiling.tiles(*arrays) == naive_tiles(doc, item)
    monkeypatch.setattr(tiling, "PAIRS", 0)
    assert tiling.tiles(*arrays) == naive_tiles(doc, item)


def test_contamination_against_brute_force(spark):
    r = random.Random(3)
    plain = [f"p{k}" for k in range(400)]
    items = [r.choices(plain, k=r.randrange(4, 40)) for _ in range(25)] + [["a"] * 12, ["a", "b"] * 8]
    docs = []
    for _ in range(60):
        text = r.choices(plain, k=r.randrange(60))
        for item in r.sample(items, 2):
            cut = r.randrange(len(item))
            text += r.choice([item, item[cut:] + ["x"] + item[:cut], item[: cut + 5], item[: int(len(item) * 0.9)]])
        docs.append(text + r.choices(["a", "b"], k=r.randrange(20)))
    want = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            found = naive_tiles(doc, item)
            covered = sum(x[2] for x in found)
            if len(item) >= 5 and covered >= 0.8 * len(item):
                want.add((d, i, len(item), covered, covered / len(item), len(found)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    table = frame(spark, [" ".join(x) for x in docs])
    for small in (200_000, 0):
        assert {tuple(x) for x in tiling.contaminated(table, bench, small=small).collect()} == want
        kept = {x["doc_id"] for x in tiling.decontaminate(table, bench, small=small).collect()}
        assert kept == set(range(len(docs))) - {x[0] for x in want}


def test_tiling_of_repeated_words_is_fast():
    import time

    began = time.monotonic()
    one = np.ones(20_000, np.uint64)
    assert tiling.tiles(one, one[:400]) == [(0, 0, 400)]
    assert sum(x[2] for x in tiling.tiles(np.tile(np.array([1, 3], np.uint64), 10_000), one[:400])) == 0
    assert time.monotonic() - began < 20


def test_tiling_frames(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = frame(spark, [*ODD, f"before {item.upper()} after", item])
    bench = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in tiling.contaminated(docs, bench).collect()) == [len(ODD), len(ODD) + 1]
    assert tiling.decontaminate(docs, bench).count() == len(ODD)
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0


def brute_components(texts, width=4, share=85):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return [(i, len(s), label[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_is_exact(spark, seed):
    r = random.Random(seed)
    texts = list(ODD)
    for size in (5, 8, 10, 11, 14, 17, 22, 40, 90):
        base = [f"t{r.randrange(10_000)}" for _ in range(size)]
        for _ in range(9):
            own = list(base)
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = f"n{r.randrange(10_000)}"
            texts.append(" ".join(own if r.random() < 0.7 else own[: -r.randrange(1, 3)]))
    got = jaccard.jaccard_components(spark, frame(spark, texts), tile=5).collect()
    assert sorted(map(tuple, got)) == brute_components(texts)


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(spark, frame(spark, ["x"]).limit(0)).count() == 0


def test_vectors_are_exact(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((40, 64))
    x = np.concatenate([base + r.standard_normal((40, 64)) * s for s in (0.0, 0.1, 0.15, 0.2)] + [base[:1] + r.standard_normal((60, 64)) * 0.02]).astype(np.float32)
    labels = [i % 40 % 3 for i in range(160)] + [0] * 60
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, labels))] + [(900, None, 1), (901, [0.0] * 64, 1), (902, x[0].tolist(), None), (903, [float("nan")] * 64, 1)]
    got = {g["vec_id"]: g for g in vectors.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tile=16).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)) & ~np.eye(len(x), dtype=bool)
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903))


def test_bytebpe_round_trip(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    alphabet = [*"ab 1.,'\n\t", "  ", "'s", "é", "中", "\U0001f600", "\u00a0", "\u2028", "\u0301"]
    texts = [*ODD, *("".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(500))]
    for row in bytebpe.digests(frame(spark, texts), queries.vocabulary("byte_bpe_50k.json")).collect():
        t = texts[row["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert tuple(row)[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    own = bytebpe.codec(queries.vocabulary("byte_bpe_50k.json"))
    ids, spans = own.encode_with_offsets("a 中文 b")
    assert ids == enc.encode_ordinary("a 中文 b") and spans[0] == (0, 1) and spans[-1][1] == 6
    assert "".join(own.decode_stream([[i] for i in ids])) == "a 中文 b"


def test_token_counts_splice(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(6)
    alphabet = ["a", "b", "é", "İ", "Σ", " ", "  ", "\n", "1", "'s", "...", "中", "<|endoftext|>", "\u0301"]
    texts = [*ODD, *("".join(r.choice(alphabet) for _ in range(r.randrange(900))) for _ in range(60)), "z" * 500]
    got = tokencount.token_counts(frame(spark, texts), path, chunk=64, overlap=4, limit=100).collect()
    for row in got:
        t = texts[row["doc_id"]] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert tuple(row)[1:] == (len(t.encode()), n, n > 100)


def test_language_held_out(spark):
    df = queries.op6_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in df]) > 0.97
    odd = language.identify(frame(spark, ODD), {}).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in odd)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = queries.op8_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.96
    assert all(r["toxic_score"] == 0 for r in toxicity.score(frame(spark, ODD), None).collect())


@pytest.mark.parametrize("size", [900, 1500])
def test_toxic_lexicon_of_rare_words(size):
    """Words in 2 % of toxic documents are found whatever the size; labels dealt by chance tell next to nothing."""
    r = random.Random(size)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    plain, bad = [word() for _ in range(2000)], [word() for _ in range(50)]
    rows = [(r.choices(plain, k=40) + ([bad[k % 50]] if y else []), y) for y in (0, 1) for k in range(size)]
    found = toxicity.lexicon(rows)
    assert {"=" + w for w in bad} <= found and sum(f[1:] in plain for f in found) <= 2
    assert len(toxicity.lexicon([(w, r.randrange(2)) for w, y in rows if not y])) <= 2
    assert np.isclose(np.exp(toxicity.by_chance(3, 1, 0.3)), 4 * 0.3**3 * 0.7 + 0.3**4)


def test_toxicity_learns_from_long_documents():
    r = random.Random(5)
    plain = [f"plain{k}" for k in range(300)]
    text = lambda bad: " ".join([*r.choices(plain, k=60), *(["vilest", "slur"] if bad else []), *r.choices(plain, k=60)])
    model = toxicity.train([(text(y), y) for y in (0, 1) for _ in range(40)], longest=50, turns=10)
    p, _ = model.probabilities([["plain1", "vilest", "slur", "plain2"]])
    assert p[1] > 0.5 > p[0] and p[2] > 0.5 > p[3]


def test_marginals_match_enumeration():
    score, moves = np.array([0.3, -1.0, 2.0]), [[1.4, 0.6], [0.7, 0.9]]
    total, each = 0.0, np.zeros(3)
    for a in range(8):
        y = [a >> k & 1 for k in range(3)]
        w = np.exp(sum(s for s, v in zip(score, y) if v)) * moves[y[0]][y[1]] * moves[y[1]][y[2]]
        total += w
        each += w * np.array(y)
    assert np.allclose(toxicity.marginals(score, np.array([3]), moves)[0], each / total)


def test_quality_keeps_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op3_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["quality_keep"] == (r["quality"] == 1) for r in rows]) > 0.97
    docs = frame(spark, ODD).selectExpr("*", "cast(null as string) lang", "cast(null as string) source")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(spark, docs, none).where("quality_keep").count() == len(ODD)


def test_wrapper_text(spark):
    page = "<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><h1>Head &amp; line</h1><p>one  <b>two</b><br>three<p>four<ul><li>a<li>b</ul><div class=comments><p>me too</p></div></article><footer>f</footer>"
    rows = [(0, "https://h.org/1", page), (1, "https://h.org/2", page.replace("<p>four", "")), (2, "https://h.org/3", None), (3, None, "<div>plain <p>text</p></div>")]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Head & line\none two three\nfour\na\nb" and got[1] == "Head & line\none two three\na\nb" and got[2] == "" and got[3] == "plain\ntext"


def test_wrapper_mixed_host(spark):
    """A page without article or main keeps its text, whatever the other pages of its host have."""
    a, b = "<body><article><p>in</p></article><div><p>out</p></div></body>", "<body><div><p>main text</p></div><nav>menu</nav></body>"
    c = "<body><aside><article>teaser</article></aside><article>&nbsp;</article><div><p>own</p></div></body>"
    rows = [(k, url and f"{url}{k}", page) for url, at in (("https://mixed.org/", 0), (None, 10), ("no host ", 20)) for k, page in ((at, a), (at + 1, b), (at + 2, c))]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in wrapper.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {at + k: (text, len(text)) for at in (0, 10, 20) for k, text in enumerate(("in", "main text", "own"))}


def test_pipeline_stages(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, DATA).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < 200
