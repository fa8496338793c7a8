"""Operator 2: benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences (letters and digits, lower-cased; a word stands for its 64-bit hash).
Windows of five words that both have, found by rolling hash, are the seeds that join documents with items. For each
pair that shares enough of them, the longest common run of words that no tile covers yet becomes a tile, again and
again, until none of five words is left; runs are made of windows with equal Karp-Rabin hashes. An item whose words are
covered by tiles to a share of 0.8 or more is contaminated, in whatever order the document has them.

Nothing of the benchmark but a bit table of its seeds (at most MOST_BITS, that is 32 MB) is held by every task. A scan
of the documents keeps the stretches whose windows are all in that table, with gaps between them; only these and the
seeds themselves meet in joins. A pair is tiled if the item's windows that the document has could cover its share:
a tile of n words has n - 4 windows, at least a fifth of n.

Items with fewer than five words match nothing. Null texts have no words. Equal rows, of documents and of items, are
treated alike, one by one; rows without a doc_id or item_id count like others. An empty benchmark contaminates nothing,
an empty table of documents gives an empty one. Extra columns are ignored, and kept by ``decontaminate``.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.llm.common import Scratch, free_prefix, frugal, worker_cache

WORD = re.compile(r"\w+")
SEED = 5
LEAST_BITS, MOST_BITS, BLOCK = 1 << 16, 1 << 28, 1 << 15
MEMO = 100_000
PAIRS = 2_000_000
GAP = 0


def words(text: str, memo: dict):
    """Hashes of a text's words; none is GAP. The memo keeps short words' hashes."""
    import numpy as np
    import xxhash

    found = WORD.findall(text.lower())
    if len(memo) > MEMO:
        memo.clear()
    out = []
    for w in found:
        h = memo.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) | 1
            if len(w) <= 32:
                memo[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def windows(ids, least: int = SEED):
    """Karp-Rabin hashes of all windows of ``least`` words."""
    import numpy as np

    n = max(0, len(ids) - least + 1)
    total = np.zeros(n, np.uint64)
    for k in range(least if n else 0):
        total = total * np.uint64(0x100000001B3) + (ids[k : n + k] ^ (ids[k : n + k] >> np.uint64(31)))
    return total ^ (total >> np.uint64(29))


def bits_of(hashes, bits: int):
    """Three places of each hash in a table of ``bits`` bits (a power of two)."""
    import numpy as np

    mask = np.uint64(bits - 1)
    return [(hashes * np.uint64(m) >> np.uint64(33)) & mask for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _diagonals(doc, item, least: int):
    """Longest matches ``(doc place, item place, length)`` along each diagonal, or None if windows pair too often."""
    import numpy as np

    d, t = windows(doc, least), windows(item, least)
    order = np.argsort(t, kind="stable")
    low, high = np.searchsorted(t[order], d, "left"), np.searchsorted(t[order], d, "right")
    count = high - low
    if count.sum() > PAIRS:
        return None
    i = np.repeat(np.arange(len(d)), count)
    j = order[np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())] if len(i) else i
    same = np.ones(len(i), bool)
    for k in range(least):
        same &= doc[i + k] == item[j + k]
    i, j = i[same], j[same]
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    start = np.ones(len(i), bool)
    start[1:] = (np.diff(i - j) != 0) | (np.diff(i) != 1)
    at = np.flatnonzero(start)
    return zip(i[at].tolist(), j[at].tolist(), (np.diff(np.r_[at, len(i)]) + least - 1).tolist(), strict=True)


def _longest(doc, item) -> tuple[int, list[tuple[int, int]]]:
    """Length and places of the longest common runs, in order, in memory of a few times the document."""
    import numpy as np

    run, best, ends = np.zeros(len(doc) + 1, np.int64), 0, []
    for j in range(len(item)):
        run[1:] = np.where(doc == item[j], run[:-1] + 1, 0)
        most = int(run.max())
        if most > best:
            best, ends = most, []
        if most == best and best:
            ends.append((j, np.flatnonzero(run == best)))
    return best, sorted((int(e) - best, j + 1 - best) for j, at in ends for e in at)


def tiles(doc, item, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles ``(doc place, item place, length)`` of two arrays of word hashes: longest first, of equally long ones that
    which comes first in the document, then in the item; none overlaps another on either side."""
    import numpy as np

    found, taken = [], (np.zeros(len(doc), bool), np.zeros(len(item), bool))

    def take(i, j, n):
        found.append((i, j, n))
        taken[0][i : i + n] = True
        taken[1][j : j + n] = True

    heap = _diagonals(doc, item, least)
    if heap is None:
        doc, item = doc.copy(), item.copy()
        while True:
            n, places = _longest(doc, item)
            if n < least:
                return found
            for i, j in places:
                if not taken[0][i : i + n].any() and not taken[1][j : j + n].any():
                    take(i, j, n)
            doc[taken[0]], item[taken[1]] = 2, 4
    heap = [(-n, i, j) for i, j, n in heap]
    heapq.heapify(heap)
    while heap:
        n, i, j = heapq.heappop(heap)
        held = taken[0][i : i - n] | taken[1][j : j - n]
        if not held.any():
            take(i, j, -n)
            continue
        free = np.flatnonzero(np.diff(np.r_[True, held, True].astype(np.int8)))
        for a, b in zip(free[::2].tolist(), free[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return found


def _items(batches):
    """Words of the items that have enough of them."""
    import pyarrow as pa

    memo = worker_cache("tiling").setdefault("words", {})
    for batch in batches:
        ids = [words(t or "", memo) for t in batch.column("text").to_pylist()]
        keep = [k for k, x in enumerate(ids) if len(x) >= SEED]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in ("row", "item_id")), pa.array([len(ids[k]) for k in keep], pa.int64()), pa.array([ids[k].tobytes() for k in keep], pa.binary())], names=["row", "item_id", "n_words", "words"])


def _seeds(batches):
    """A row per item and distinct window, with the number of such windows in the item."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for row, ids in zip(batch.column("row").to_pylist(), batch.column("words").to_pylist(), strict=True):
            h, n = np.unique(windows(np.frombuffer(ids, np.uint64)), return_counts=True)
            for a in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[a : a + 100_000]), row)), pa.array(h[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], names=["row", "seed", "times"])


def _blocks(bits: int):
    """The bit table of a task's seeds, by blocks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for at in bits_of(batch.column("seed").to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        size = min(BLOCK, len(table))
        whole = table.reshape(-1, size)
        met = np.flatnonzero(whole.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array([x.tobytes() for x in whole[met]], pa.binary())], names=["block", "bits"])

    return run


def _or_blocks(group):
    import numpy as np
    import pyarrow as pa

    total = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group.column("bits").to_pylist()])
    return pa.table({"block": group.column("block")[:1], "bits": pa.array([total.tobytes()], pa.binary())})


def bit_table(seeds: DataFrame, count: int) -> bytes:
    """A bit table of all seeds, 16 bits for each within LEAST_BITS and MOST_BITS."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length()))
    size = min(BLOCK, bits >> 3)
    shape = "block int, bits binary"
    made = seeds.select("seed").mapInArrow(frugal("tiling", _blocks(bits)), shape).withColumn("fold", F.floor(F.spark_partition_id() / 256))
    out = bytearray(bits >> 3)
    for r in made.groupBy("block", "fold").applyInArrow(_or_blocks, shape).groupBy("block").applyInArrow(_or_blocks, shape).toLocalIterator():
        out[r["block"] * size : (r["block"] + 1) * size] = r["bits"]
    return bytes(out)


def _stretches(told):
    """Of each text with windows in the bit table: the words of such windows, a GAP between stretches, and the windows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.frombuffer(told.value, np.uint8)
        memo = worker_cache("tiling").setdefault("words", {})
        for batch in batches:
            rows, kept, seeds = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = words(text or "", memo)
                h = windows(ids)
                hit = np.ones(len(h), bool)
                for at in bits_of(h, len(table) << 3):
                    hit &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                if not hit.any():
                    continue
                inside = np.zeros(len(ids), bool)
                for j in range(SEED):
                    inside[j : j + len(h)] |= hit
                ids[~inside] = GAP
                ids = ids[inside | np.r_[False, inside[:-1]]]
                rows.append(k)
                kept.append(ids.tobytes())
                seeds.append(np.unique(h[hit]).view(np.int64))
            at = pa.array(rows, pa.int64())
            offsets = np.r_[0, np.cumsum([len(x) for x in seeds])].astype(np.int32)
            flat = np.concatenate(seeds) if seeds else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_id", "t1", "t2")), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "t1", "t2", "words", "seeds"])

    return run


def _tile(share: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows, counts = [], []
            for k, (doc, item) in enumerate(zip(batch.column("doc_words").to_pylist(), batch.column("item_words").to_pylist(), strict=True)):
                found = tiles(np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64))
                covered = sum(x[2] for x in found)
                if covered * 8 >= share * len(item):
                    rows.append(k)
                    counts.append((covered, 8 * covered / len(item), len(found)))
            at = pa.array(rows, pa.int64())
            kinds = ((pa.int64(), "covered"), (pa.float64(), "coverage"), (pa.int64(), "n_tiles"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("t1", "t2", "item_id", "n_words")), *(pa.array([c[n] for c in counts], kind) for n, (kind, _) in enumerate(kinds))], names=["t1", "t2", "item_id", "n_words", *(name for _, name in kinds)])

    return run


def text_keys() -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), F.col("text")).alias("t2")]


def matches(docs: DataFrame, benchmark: DataFrame, share: float, small: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, t1, t2`` of documents that may match, and ``t1, t2, item_id, n_words, covered, coverage, n_tiles`` of texts
    that do. ``small``: up to so many rows of a side of a join are broadcast."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = benchmark.where("text is not null").select(F.monotonically_increasing_id().alias("row"), "item_id", "text")
    items = scratch.save(items.mapInArrow(frugal("tiling", _items), "row long, item_id long, n_words long, words binary"), "items")
    seeds = scratch.save(items.select("row", "words").mapInArrow(frugal("tiling", _seeds), "row long, seed long, times long"), "seeds")
    n = seeds.count()
    told = spark.sparkContext.broadcast(bit_table(seeds, n))
    chosen = docs.where("text is not null").select("doc_id", "text", *text_keys())
    stretches = scratch.save(chosen.mapInArrow(frugal("tiling", _stretches(told)), "doc_id long, t1 long, t2 long, words binary, seeds array<long>"), "stretches")
    texts = stretches.groupBy("t1", "t2").agg(F.first("words").alias("doc_words"), F.first("seeds").alias("seeds"))
    texts = scratch.save(texts, "texts")
    hits = texts.select("t1", "t2", F.explode("seeds").alias("seed")).join(F.broadcast(seeds) if n <= 10 * small else seeds, "seed")
    pairs = hits.groupBy("t1", "t2", "row").agg(F.sum("times").alias("windows"))
    known = items.select("row", "item_id", "n_words", F.col("words").alias("item_words"))
    size = items.agg(F.sum("n_words")).first()[0] or 0
    pairs = pairs.join(F.broadcast(known) if size <= 10 * small else known, "row").where(f"windows * {SEED} >= {share} * n_words")
    pairs = pairs.select("t1", "t2", "item_id", "n_words", "item_words").join(texts.select("t1", "t2", "doc_words"), ["t1", "t2"])
    found = pairs.mapInArrow(frugal("tiling", _tile(share)), "t1 long, t2 long, item_id long, n_words long, covered long, coverage double, n_tiles long")
    found = scratch.save(found, "found")
    scratch.keep_only("stretches", "found")
    return stretches.select("doc_id", "t1", "t2"), found


def contaminated(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.8, small: int = 200_000) -> DataFrame:
    """``doc_id, item_id, n_words, covered, coverage, n_tiles`` of each document and item that it covers."""
    near, found = matches(docs, benchmark, share, small)
    found = F.broadcast(found) if found.count() <= small else found
    return near.join(found, ["t1", "t2"]).select("doc_id", "item_id", "n_words", "covered", "coverage", "n_tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.8, small: int = 200_000) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item, with all their columns."""
    _, found = matches(docs, benchmark, share, small)
    free = free_prefix(docs.columns, "text_")
    texts = found.select(F.col("t1").alias(f"{free}1"), F.col("t2").alias(f"{free}2")).distinct()
    a, b = text_keys()
    return docs.join(F.broadcast(texts) if texts.count() <= small else texts, (a == F.col(f"{free}1")) & (b == F.col(f"{free}2")) & F.col("text").isNotNull(), "left_anti")
