"""Operator 9: near-duplicate embeddings by a subspace pigeonhole join, exact at the threshold.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. After a fixed random rotation the coordinates are
split into blocks; of two such vectors at least one block differs by no more than its proportional share of that
squared distance. Each block is range-joined: its first coordinates form a grid, every vector is at home in one cell
and also visits the cells within the block's radius, and a cell compares homes with visitors. How many coordinates
form the grid follows from the number of vectors of a label, by the cost of visits and comparisons.

A visit carries an id and the block's coordinates, not the vector. What lies within a block's budget there is a
candidate; candidates fetch both vectors and are verified by cosine in double precision, and a pair that several blocks
find counts in the first of them only. A cell (or pair of tiles of a large cell) with more than a few candidates for
each of its vectors emits no pairs; its vectors are fetched instead, and it returns sums and a spanning forest. So
pairs grow with the number of vectors, and a hot group costs comparisons but no rows.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null label or vec_id, link with
nothing and keep their own id. Rows that repeat a vec_id and its vector count once and all have its result; a vec_id
with several vectors has the links of all of them, but none with itself. An empty table gives an empty one; extra
columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.llm.common import Scratch, components, frugal, frugal_group

#: Candidates per vector up to which a cell emits them as pairs.
FEW = 8


@lru_cache(None)
def rotation(dim: int):
    """A fixed orthogonal matrix."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(20240607).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(unit):
    """Rotated rows. Sums run in a fixed order, so that a vector has the same bits in every task."""
    import numpy as np

    turn = rotation(unit.shape[1])
    out = np.zeros_like(unit)
    for k in range(unit.shape[1]):
        out += unit[:, k, None] * turn[k]
    return out


def layout(dim: int, block: int, cosine: float) -> tuple[list[tuple[int, int]], list[float]]:
    """Blocks of coordinates, and their squared-distance budgets (with a margin for rounding)."""
    cuts = [(a, min(dim, a + block)) for a in range(0, dim, block)]
    whole = 2 - 2 * cosine
    return cuts, [whole * (b - a) / dim + 1e-9 for a, b in cuts]


def units(raw):
    """Unit rows in double precision, with norms summed in a fixed order."""
    import numpy as np

    x = raw.astype(np.float64)
    norm = np.zeros(len(x))
    for k in range(x.shape[1]):
        norm += x[:, k] * x[:, k]
    return x / np.sqrt(norm)[:, None]


def stacked(bodies: list[bytes], dim: int):
    """Rows of vectors of one dimension, as they came."""
    import numpy as np

    raw = b"".join(bodies)
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(bodies) else np.float64).reshape(-1, dim)


def turned_of(raw):
    """Unit rows and rotated unit rows."""
    import numpy as np

    raw = raw.astype(np.float64)
    unit = units(raw / np.abs(raw).max(axis=1)[:, None])
    return unit, rotated(unit)


def _usable(batches):
    """Vectors that can link, as bytes of their own precision."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows, bodies, dims, by = batch.column("embedding"), {}, {}, {}
        for i, v in enumerate(rows.to_pylist()):
            if v and None not in v:
                by.setdefault(len(v), []).append(i)
        for dim, at in by.items():
            raw = np.asarray(rows.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
            good = np.isfinite(raw).all(axis=1) & (np.where(np.isfinite(raw), raw, 0) != 0).any(axis=1)
            for i, v in zip(np.array(at)[good].tolist(), raw[good], strict=True):
                bodies[i], dims[i] = v.tobytes(), dim
        at = sorted(bodies)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at, pa.int64())), batch.column("label").take(pa.array(at, pa.int64())), pa.array([dims[i] for i in at], pa.int32()), pa.array([bodies[i] for i in at], pa.binary())], names=["vec_id", "label", "dim", "body"])


def _visits(block: int, cosine: float, spread: float):
    """A row per vector, block and cell that it is at home in or visits."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from burrow.llm.textgrams import mix

        for batch in batches:
            dims, grids = batch.column("dim").to_numpy(), batch.column("grid").to_numpy()
            for dim, grid in np.unique(np.stack([dims, grids]), axis=1).T.tolist():
                at = np.flatnonzero((dims == dim) & (grids == grid))
                bodies, ids, labels = batch.column("body").take(pa.array(at)).to_pylist(), batch.column("uid").to_numpy()[at], batch.column("label").to_numpy()[at]
                turned = turned_of(stacked(bodies, dim))[1]
                cuts, budgets = layout(dim, block, cosine)
                for n, ((a, b), budget) in enumerate(zip(cuts, budgets, strict=True)):
                    radius = math.sqrt(budget) + 1e-9
                    lead, coords = turned[:, a : min(b, a + grid)], turned[:, a:b].astype(np.float32)
                    home, low, high = (np.floor((lead + d) / (spread * radius)).astype(np.int64) for d in (0, -radius, radius))
                    which = np.arange(len(lead))
                    cells = mix(labels.astype(np.int64).view(np.uint64) * np.uint64(1_000_003) + np.uint64(n * 100_000 + dim))
                    base = cells
                    for k in range(lead.shape[1]):
                        base = mix(base ^ (home[:, k] + 4096).view(np.uint64))
                        span = (high - low)[which, k] + 1
                        step = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
                        which, cells = np.repeat(which, span), np.repeat(cells, span)
                        cells = mix(cells ^ (low[which, k] + step + 4096).view(np.uint64))
                    for s in range(0, len(which), 8192):
                        w, c = which[s : s + 8192], cells[s : s + 8192]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c.view(np.int64)), pa.array(np.full(len(w), n, np.int32)), pa.array(c == base[w]), pa.array(ids[w], pa.int64()), pa.array([coords[k].tobytes() for k in w], pa.binary())],
                            names=["cell", "block", "home", "uid", "coords"],
                        )

    return run


def _stretches(group, names):
    """Rows of a group by equal values of the columns ``names``, ordered by ``uid``."""
    import numpy as np

    keys = [group.column(c).to_numpy() for c in names]
    order = np.lexsort((group.column("uid").to_numpy(), *keys[::-1]))
    change = np.zeros(len(order), bool)
    for k in keys:
        change[1:] |= np.diff(k[order]) != 0
    cuts = np.r_[0, np.flatnonzero(change), len(order)] if len(order) else np.zeros(0, np.int64)
    return [order[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


_FOUND = "hot boolean, cell long, block int, i int, j int, a long, b long"


def _candidates(block: int, cosine: float):
    """Pairs within a block's budget; of cells with many, the cell alone."""

    def run(group):
        import numpy as np
        import pyarrow as pa

        ids, home, tile, dims = (group.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "home", "tile", "dim"))
        places = [group.column(c).to_numpy() for c in ("cell", "block", "i", "j")]
        coords, out = group.column("coords"), {c.split()[0]: [] for c in _FOUND.split(", ")}
        for own in _stretches(group, ("cell", "block", "i", "j")):
            place = [int(p[own[0]]) for p in places]
            rows, cols = np.flatnonzero(home[own].astype(bool) & (tile[own] == place[2])), np.flatnonzero(tile[own] == place[3])
            if not len(rows) or len(own) < 2:
                continue
            x = np.frombuffer(b"".join(coords[int(k)].as_py() for k in own), np.float32).reshape(len(own), -1).astype(np.float64)
            budget = layout(int(dims[own[0]]), block, cosine)[1][place[1]] + 1e-6
            square, a, b, n = (x * x).sum(axis=1), [], [], 0
            for s in range(0, len(rows), 256):
                r = rows[s : s + 256]
                hit = square[r][:, None] + square[cols] - 2 * (x[r] @ x[cols].T) <= budget
                hit &= ids[own[r]][:, None] != ids[own[cols]]
                n += int(hit.sum())
                if n > FEW * len(own):
                    break
                p, q = np.nonzero(hit)
                a.append(ids[own[r[p]]])
                b.append(ids[own[cols[q]]])
            hot = n > FEW * len(own)
            a, b = (np.zeros(1, np.int64),) * 2 if hot else (np.concatenate(a), np.concatenate(b))
            for name, v in (("hot", np.full(len(a), hot)), *((c, np.full(len(a), v)) for c, v in zip(("cell", "block", "i", "j"), place, strict=True)), ("a", a), ("b", b)):
                out[name].append(v)
        kinds = {"hot": pa.bool_(), "block": pa.int32(), "i": pa.int32(), "j": pa.int32()}
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), kinds.get(c, pa.int64())) for c, v in out.items()})

    return run


def linked(unit, turned, p, q, number: int, cuts, budgets, cosine: float):
    """Which pairs of rows reach the cosine and lie within the budget of block ``number`` but of none before it."""
    import numpy as np

    dot, first = np.zeros(len(p)), np.ones(len(p), bool)
    for k in range(unit.shape[1]):
        dot += unit[p, k] * unit[q, k]
    for n in range(number + 1):
        gap = np.zeros(len(p))
        for k in range(*cuts[n]):
            gap += (turned[p, k] - turned[q, k]) ** 2
        first &= gap <= budgets[n] if n == number else gap > budgets[n]
    return first & (dot >= cosine)


def _verify(block: int, cosine: float):
    """Links among candidate pairs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            dims, numbers, keep = batch.column("dim").to_numpy(), batch.column("block").to_numpy(), np.zeros(batch.num_rows, bool)
            for dim in np.unique(dims).tolist():
                cuts, budgets = layout(dim, block, cosine)
                at = np.flatnonzero(dims == dim)
                pairs = [batch.column(c).take(pa.array(at)).to_pylist() for c in ("body_a", "body_b")]
                unit, turned = turned_of(stacked([*pairs[0], *pairs[1]], dim))
                for n in np.unique(numbers[at]).tolist():
                    own = np.flatnonzero(numbers[at] == n)
                    keep[at[own]] = linked(unit, turned, own, own + len(at), n, cuts, budgets, cosine)
            yield batch.select(["vec_id", "other"]).filter(pa.array(keep))

    return run


def _compare(block: int, cosine: float):
    """Links and a spanning forest of hot cells, whose vectors are at hand."""

    def run(group):
        import numpy as np
        import pyarrow as pa

        ids, home, tile, labels, dims = (group.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "home", "tile", "label", "dim"))
        places = [group.column(c).to_numpy() for c in ("block", "i", "j")]
        bodies, out = group.column("body"), {"vec_id": [], "links": [], "other": []}
        for own in _stretches(group, ("cell", "block", "i", "j")):
            own = own[(dims[own] == dims[own[0]]) & (labels[own] == labels[own[0]])]
            number, i, j = (int(p[own[0]]) for p in places)
            dim = int(dims[own[0]])
            cuts, budgets = layout(dim, block, cosine)
            unit, turned = turned_of(stacked([bodies[int(k)].as_py() for k in own], dim))
            rows, cols = np.flatnonzero(home[own].astype(bool) & (tile[own] == i)), np.flatnonzero(tile[own] == j)
            links, label = np.zeros(len(own), np.int64), np.arange(len(own))
            for s in range(0, len(rows), 256):
                r = rows[s : s + 256]
                hit_r, hit_c = np.nonzero(turned[r] @ turned[cols].T >= cosine - 1e-6)
                for t in range(0, len(hit_r), 1 << 16):
                    p, q = r[hit_r[t : t + (1 << 16)]], cols[hit_c[t : t + (1 << 16)]]
                    other = ids[own[p]] != ids[own[q]]
                    p, q = p[other], q[other]
                    keep = linked(unit, turned, p, q, number, cuts, budgets, cosine)
                    p, q = p[keep], q[keep]
                    np.add.at(links, p, 1)
                    while True:
                        low = np.minimum(label[p], label[q])
                        new = label.copy()
                        np.minimum.at(new, label[p], low)
                        np.minimum.at(new, label[q], low)
                        new = new[new]
                        new = new[label]
                        if np.array_equal(new, label):
                            break
                        label = new
            told = np.flatnonzero((links > 0) | (label != np.arange(len(own))))
            out["vec_id"].append(ids[own[told]])
            out["links"].append(links[told])
            out["other"].append(ids[own[label[told]]])
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in out.items()})

    return run


def grid_of(n, dim, block: int, cosine: float, spread: float, visit: int):
    """The number of grid coordinates of least cost for a label of ``n`` vectors. A cell is ``spread`` radii wide, and
    nearly all coordinates of unit vectors lie within four standard deviations."""
    wide = F.greatest(F.lit(1.0), 4 / F.sqrt(dim) / (spread * F.sqrt(F.lit(2 - 2 * cosine) * F.least(F.lit(block), dim) / dim)))
    cost = lambda g: (F.lit(1 + 2 / spread) ** g) * (visit + n / wide**g)
    return F.array_min(F.array(*(F.struct(cost(g).alias("cost"), F.lit(g).alias("grid")) for g in range(1, block + 1))))["grid"]


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, cosine: float = 0.98, block: int = 8, spread: float = 3.0, visit: int = 2000, tile: int = 2000, small: int = 20_000) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors(vec_id, embedding, label)``.

    ``block``: coordinates of a block. ``spread``: cell width in radii. ``visit``: comparisons in a block that cost as
    much as a visit. ``tile``: rows of a cell that one task compares with as many others. ``small``: up to so many rows
    of a side are broadcast.
    """
    scratch = Scratch(spark)
    vectors = vectors.select("vec_id", "embedding", "label")
    few = lambda df, n: F.broadcast(df) if n <= small else df
    usable = vectors.where("vec_id is not null and label is not null and embedding is not null").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    usable = usable.mapInArrow(frugal("vectors", _usable), "vec_id long, label long, dim int, body binary").distinct()
    usable = scratch.save(usable.withColumn("uid", F.monotonically_increasing_id()), "usable")
    grids = scratch.save(usable.groupBy("label", "dim").agg(grid_of(F.count("*"), F.col("dim"), block, cosine, spread, visit).cast("int").alias("grid")), "grids")
    own = usable.join(few(grids, grids.count()), ["label", "dim"])
    visits = own.select("uid", "label", "dim", "grid", "body").mapInArrow(frugal("vectors", _visits(block, cosine, spread)), "cell long, block int, home boolean, uid long, coords binary")
    sizes = scratch.save(visits.groupBy("cell").agg(F.count("*").alias("n")).groupBy((F.col("n") > tile).alias("large"), F.when(F.col("n") > tile, F.col("cell")).alias("cell")).agg(F.sum("n").alias("n")), "sizes")
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where("large").select("cell", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    placed = visits.join(few(large, large.count()), "cell", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"))
    pair = lambda i, j: F.struct(F.lit(i).alias("i") if isinstance(i, int) else i.alias("i"), F.lit(j).alias("j") if isinstance(j, int) else j.alias("j"))
    homes = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: pair(F.col("tile"), t))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    guests = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: pair(t, F.col("tile")))
    placed = placed.withColumn("at", F.explode(F.when(F.col("tiles") == 1, F.array(pair(0, 0))).otherwise(F.array_union(homes, guests))))
    placed = placed.select("cell", "block", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "home", "tile", "tiles", "uid", "coords")
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * 100 / (8 << 20)))
    dims = usable.select("dim").distinct()
    one = [r["dim"] for r in dims.limit(2).collect()]
    sized = placed.withColumn("dim", F.lit(one[0])) if len(one) == 1 else placed.join(usable.select("uid", "dim"), "uid")
    dealt = sized.withColumn("bin", F.when(F.col("tiles") == 1, F.pmod("cell", F.lit(bins))).otherwise(F.xxhash64("cell", "i", "j")))
    found = scratch.save(dealt.drop("tiles").groupBy("bin").applyInArrow(frugal_group("vectors", _candidates(block, cosine)), _FOUND), "found")
    side = lambda x, name: usable.select(F.col("uid").alias(x), F.col("vec_id").alias(name), F.col("label").alias(f"label_{x}"), F.col("dim").alias(f"dim_{x}"), F.col("body").alias(f"body_{x}"))
    n = usable.count()
    pairs = found.where("not hot").select("a", "b", "block").join(few(side("a", "vec_id"), n), "a").join(few(side("b", "other"), n), "b").where("label_a = label_b and dim_a = dim_b and vec_id <> other")
    cold = pairs.select("vec_id", "other", "block", F.col("dim_a").alias("dim"), "body_a", "body_b").mapInArrow(frugal("vectors", _verify(block, cosine)), "vec_id long, other long")
    hot = found.where("hot").select("cell", "block", "i", "j")
    met = placed.drop("coords", "tiles").join(few(hot, hot.count()), ["cell", "block", "i", "j"]).join(few(usable, n), "uid")
    warm = met.groupBy("cell", "i", "j").applyInArrow(frugal_group("vectors", _compare(block, cosine)), "vec_id long, links long, other long")
    links = scratch.save(cold.select("vec_id", F.lit(1).cast("long").alias("links"), "other").unionByName(warm), "links")
    labels = components(links.select(F.col("vec_id").alias("a"), F.col("other").alias("b")), scratch, "vector").withColumnRenamed("node", "vec_id")
    counts = links.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    told = scratch.save(counts.join(labels, "vec_id", "full_outer"), "told")
    scratch.keep_only("told")
    return vectors.select("vec_id").join(told, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"))
