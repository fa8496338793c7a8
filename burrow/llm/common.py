"""Shared pieces of the training-data operators: table reading, shared-folder scratch tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = 1000
BATCH_BYTES = 8 << 20
FEW_EDGES = 500_000
_kept: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What the tasks of one operator keep in a Python worker. Spark gives a worker to stage after stage, so the first
    task of another operator drops what the one before kept."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    return _kept[owner]


def give_back() -> None:
    """Returns freed memory of Arrow and of the C library to the system; else an idle worker holds it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(owner: str, run: Callable) -> Callable:
    """A function for mapInArrow that starts without other operators' caches and gives freed memory back at its end."""

    def whole(batches):
        worker_cache(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def frugal_group(owner: str, run: Callable) -> Callable:
    """The same for applyInArrow."""

    def whole(group):
        worker_cache(owner)
        try:
            return run(group)
        finally:
            give_back()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, pruned to ``columns`` so that only these reach the scan.

    Arrow batches are kept to BATCH rows and BATCH_BYTES, since a batch of whole texts is held by the JVM and by a
    worker at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Where that is unset there is none to guess on a
    cluster, and only a local session, whose one process is driver and executor, gets a folder of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="burrow-checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def free_prefix(columns: list[str], start: str) -> str:
    """``start``, with underscores added until no column begins with it (Spark's names ignore case)."""
    while any(c.lower().startswith(start) for c in columns):
        start += "_"
    return start


class Scratch:
    """Parquet tables in the shared folder. They cut lineage, survive lost executors and carry sizes for the optimizer."""

    def __init__(self, spark: SparkSession):
        self.spark, self.home = spark, f"{shared_folder(spark)}/burrow-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.home}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.home}/{name}")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}" if name else self.home)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def drop(self, name: str) -> None:
        system, path = self._path(name)
        system.delete(path, True)

    def keep_only(self, *names: str) -> None:
        """Removes all tables but those that a result still reads."""
        system, home = self._path("")
        for found in system.listStatus(home) if system.exists(home) else ():
            if found.getPath().getName() not in names:
                system.delete(found.getPath(), True)


def _labels(a, b):
    """The nodes of edges and the place of each one's least reachable node, by numpy label propagation."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return nodes, label
        label = new


def _forest(batches):
    """Spanning forest of one task's edges as stars, in bounded slices."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        nodes, label = _labels(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        keep = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[label[keep]])], names=["a", "b"])


def _whole(batches):
    """Every node and its component, of all edges at once."""
    import numpy as np
    import pyarrow as pa

    some = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if not some:
        return
    a, b = (np.concatenate(v) for v in zip(*some, strict=True))
    nodes, label = _labels(a, b)
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(nodes[label[i : i + 100_000]])], names=["node", "component"])


def components(edges: DataFrame, scratch: Scratch, tag: str, few: int = FEW_EDGES) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a long, b long)``; component is the smallest reachable node.

    Each task first reduces its edges to a spanning forest. Up to ``few`` edges (16 bytes each) that are left are then
    settled by one task: rounds over so little cost more than their work. For more of them, large-star and small-star rounds run until
    nothing changes. The smallest neighbour comes from a groupBy with map-side combine, and the join back is one
    that adaptive execution can split, so a node that meets a third of all edges does not land in one task.
    """
    def stars(df: DataFrame) -> DataFrame:
        return df.mapInArrow(frugal("components", _forest), "a long, b long")

    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = scratch.save(stars(edges.select("a", "b").where("a <> b")).distinct(), f"{tag}-0")
    before = state(now)
    if before[0] <= few:
        return scratch.save(now.coalesce(1).mapInArrow(frugal("components", _whole), "node long, component long"), f"{tag}-whole")
    for turn in range(1, 60):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct().select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        new = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.save(new, f"{tag}-{turn}")
        scratch.drop(f"{tag}-{turn - 1}")
        now, last, before = new, before, state(new)
        if before == last:
            break
    else:
        raise RuntimeError("components did not settle in 60 rounds")
    labels = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return labels.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
