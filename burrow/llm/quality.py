"""Operator 3: quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression over surface measures of a text gives each document its own evidence. Grouped sums of the
documents' probabilities give each host and each path within it a rate of good documents. Both are Beta posteriors
whose prior strength is estimated from the spread between sites (method of moments): a path shrinks toward its host,
a host toward the global rate, the more so the fewer documents it has. A document's probability combines its evidence
with its site's posterior, from which the document itself is left out.

Null texts count as empty. Null hosts or paths form a site of their own. With no labelled rows, or only one kind of
label, every document is kept with its site's rate at one half. Repeated rows each count. Columns of the documents are
kept, whatever their names, but for four named like the results, which are replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from burrow.llm.common import Scratch, free_prefix, frugal

_SYMBOL = re.compile(r"[^\w\s.,;:'\"()?\-]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"\d")


def measures(text: str) -> list[float]:
    """Surface measures of a text."""
    n = len(text)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    w = max(1, len(words))
    symbols, upper = len(_SYMBOL.findall(text)), len(_UPPER.findall(text))
    kinds = len(set(words))
    return [
        1.0,
        min(1.0, symbols / max(1, n) * 10),
        min(1.0, symbols / w),
        upper / max(1, n),
        len(_DIGIT.findall(text)) / max(1, n),
        text.count("|") / w,
        text.count("!") / w,
        kinds / w,
        min(1.0, kinds / w * math.sqrt(w) / 20),
        len(set(lines)) / max(1, len(lines)),
        math.log1p(n) / 10,
        sum(map(len, words)) / w / 10,
        sum(1 for x in words if len(x) <= 3) / w,
        1.0 if n == 0 else 0.0,
    ]


def fit(rows: list[tuple[str, int]], turns: int = 30, ridge: float = 1.0) -> list[float] | None:
    """Weights of the logistic regression by Newton's method; None with fewer than two kinds of label."""
    import numpy as np

    y = np.array([q for _, q in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([measures(t or "") for t, _ in rows])
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w / 10
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * ridge / 10, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> list[tuple[str, int]]:
    """Texts and labels of at most ``most`` labelled rows, those least by a hash of doc_id."""
    picked = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y").orderBy(F.xxhash64("text"), "y").collect()
    return [(r["text"], int(r["y"])) for r in rows]


def _evidence(weights: list[float] | None, kept: list[str], name: str = "evidence_"):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if weights is None:
                e = np.zeros(batch.num_rows)
            else:
                e = np.array([measures(t or "") for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, len(weights)) @ np.array(weights)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(e)], names=[*kept, name])

    return run


def _strength(sites: DataFrame, rate: str) -> float:
    """Prior strength: how many documents a site's prior counts for, from the spread of site rates round ``rate``."""
    row = sites.select(F.col("n").cast("double").alias("n"), (F.col("good") / F.col("n")).alias("r"), F.expr(rate).alias("m")).agg(
        F.sum("n").alias("n"), F.sum(F.expr("n * (r - m) * (r - m)")).alias("ss"), F.sum(F.expr("m * (1 - m)")).alias("noise"), F.sum(F.expr("n * m * (1 - m)")).alias("whole")
    ).first()
    if not row["n"]:
        return 1.0
    between, whole = (row["ss"] - row["noise"]) / row["n"], row["whole"] / row["n"]
    return min(1e6, max(1.0, whole / between - 1)) if between > 1e-9 else 1e6


def site_posteriors(evidence: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """Rates of good documents by ``host_, path_`` (with what a document's own site counts as), and the global rate."""
    p = 1 / (1 + F.exp(-F.col("evidence_")))
    paths = scratch.save(evidence.groupBy("host_", "path_").agg(F.count("*").alias("n"), F.sum(p).alias("good")), "paths")
    hosts = paths.groupBy("host_").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = min(1 - 1e-6, max(1e-6, (total["good"] or 0.0) / total["n"])) if total["n"] else 0.5
    a = _strength(hosts, f"{rate!r}D")
    hosts = hosts.select("host_", F.expr(f"(good + {a!r}D * {rate!r}D) / (n + {a!r}D)").alias("host_rate"))
    both = scratch.save(paths.join(hosts, "host_"), "sites")
    b = _strength(both, "host_rate")
    return both.select("host_", "path_", F.col("n").alias("site_n"), F.col("good").alias("site_good"), "host_rate", F.lit(b).alias("strength")), rate


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", most: int = 4000) -> DataFrame:
    """The rows of ``docs`` with ``quality_doc``, ``quality_site``, ``quality_score`` and ``quality_keep`` added.

    ``host`` and ``path``: columns that name a document's site. ``most``: labelled rows that the regression is fitted on.
    """
    scratch = Scratch(spark)
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("quality_doc", "quality_site", "quality_score", "quality_keep")))
    q = free_prefix(docs.columns, "q_")
    weights = fit(sample(docs, labels, "quality", most))
    site = [F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host_"), F.coalesce(F.col(path).cast("string"), F.lit("\0")).alias("path_")]
    narrow = docs.select(*site, "text").mapInArrow(frugal("quality", _evidence(weights, ["host_", "path_"])), "host_ string, path_ string, evidence_ double")
    sites, rate = site_posteriors(narrow, scratch)
    sites = sites.select(*(F.col(c).alias(q + c) for c in sites.columns))
    told = docs.select("*", *(c.alias(q + n) for c, n in zip(site, ("host_", "path_"), strict=True)))
    scored = told.mapInArrow(frugal("quality", _evidence(weights, told.columns, f"{q}evidence_")), StructType(list(told.schema)).add(f"{q}evidence_", DoubleType()))
    own = f"1 / (1 + exp(-{q}evidence_))"
    joined = scored.join(sites, [f"{q}host_", f"{q}path_"], "left")
    posterior = f"greatest(1e-6D, least(1 - 1e-6D, ({q}site_good - {own} + {q}strength * {q}host_rate) / ({q}site_n - 1 + {q}strength)))"
    shift = f"ln(quality_site / (1 - quality_site)) - {math.log(rate / (1 - rate))!r}D"
    return joined.withColumn("quality_doc", F.expr(own)).withColumn("quality_site", F.expr(posterior)).withColumn("quality_score", F.expr(f"1 / (1 + exp(-({q}evidence_ + {shift})))")).withColumn("quality_keep", F.expr("quality_score >= 0.5")).select(*docs.columns, "quality_doc", "quality_site", "quality_score", "quality_keep")
