"""Operator 8: toxicity by a linear-chain conditional random field over words.

Documents are labelled as wholes, so token labels are derived first: in toxic training documents a word counts as
toxic if it, or one of its beginnings, occurs in several toxic documents and hardly in clean ones; all other words are
clean. A two-state chain with features of the word, its beginnings and its ending is trained on these by gradient
ascent of the conditional likelihood. Forward-backward marginals of every word of a text give the offending spans and,
through a logistic curve fitted to the training documents, the document's score.

With two states both passes reduce to one ratio per word, and all texts of a slice advance together. Words are found in
the text as it is and lower-cased one by one, so spans are places in the text even where a lower case is longer. Null
and empty texts, and texts without words, have the score of a text in which no word is toxic. Without labelled rows of
both kinds every score is 0. Repeated rows, and rows without a doc_id, are scored one by one; an empty table gives an
empty one; extra columns are kept, but for two named like the results.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from burrow.llm.common import frugal

WORD = re.compile(r"\w+")
BITS = 18
MEMO = 500_000


def words_of(text: str) -> list[str]:
    """Words of a text in lower case, one for each match of WORD in the text itself."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def features(word: str) -> list[str]:
    """Names of a word's features."""
    return ["=" + word, *(f"{k}{word[:k]}" for k in (4, 5, 6) if len(word) > k), "$" + word[-3:]]


def slots(word: str) -> list[int]:
    """Weights of a word's features; slot 0 is the bias."""
    import xxhash

    return [0, *(1 + xxhash.xxh32_intdigest(f.encode()) % ((1 << BITS) - 1) for f in features(word))]


def by_chance(n: int, m: int, share: float) -> float:
    """Log probability that of ``n + m`` documents at least ``n`` are toxic, if each is with probability ``share``."""
    first = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1) + n * math.log(share) + (m * math.log1p(-share) if m else 0)
    total = term = 1.0
    for k in range(m):
        term *= (m - k) / (n + k + 1) * share / (1 - share)
        total += term
    return first + math.log(total)


def lexicon(rows: list[tuple[list[str], int]], clean: float = 0.002) -> set[str]:
    """Features that tell toxic documents: in more of them than chance explains, with less than one false feature
    expected among all, and in no more than a ``clean`` share of clean ones. Near copies count once: of documents with
    the same least shingle hash, the first."""
    from collections import Counter

    import xxhash

    seen, total, met = {0: Counter(), 1: Counter()}, Counter(), set()
    for words, y in rows:
        least = min((xxhash.xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))), default=0)
        if (least, y) in met:
            continue
        met.add((least, y))
        total[y] += 1
        seen[y].update({f for w in set(words) for f in features(w)[:-1]})
    share, most = total[1] / (total[0] + total[1]), -math.log(max(1, len(seen[1])))
    return {f for f, n in seen[1].items() if seen[0][f] <= clean * total[0] and by_chance(n, seen[0][f], share) < most}


def marginals(score, lengths, moves):
    """Probability of the toxic state for each word, and the ratios of both passes.

    ``score``: log odds of the words of all texts, one after another; ``lengths``: words per text, none of them 0;
    ``moves``: 2 x 2 transition weights (not logs). Texts are ordered by length and advance a word at a time.
    """
    import numpy as np

    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    lift = np.exp(np.clip(score, -30, 30))
    ahead, back = np.empty(len(score)), np.empty(len(score))
    (a00, a01), (a10, a11) = moves
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left") if len(sizes) else []
    r = np.ones(len(sizes))
    for t in range(len(active)):
        n = active[t]
        at = first[:n] + t
        r = lift[at] if t == 0 else lift[at] * (a01 + r[:n] * a11) / (a00 + r[:n] * a10)
        ahead[at] = r
    s = np.ones(len(sizes))
    last = first + sizes - 1
    for t in range(len(active)):
        n = active[t]
        at = last[:n] - t
        if t == 0:
            s = np.ones(n)
        else:
            v = lift[at + 1] * s[:n]
            s = (a10 + a11 * v) / (a00 + a01 * v)
        back[at] = s
    odds = ahead * back
    return odds / (1 + odds), ahead, back, lift


class Model:
    """Weights of the chain and of the curve that turns marginals into a document's score."""

    def __init__(self, weights, moves, curve):
        self.weights, self.moves, self.curve, self.memo = weights, moves, curve, {}

    def __getstate__(self):
        return {"weights": self.weights, "moves": self.moves, "curve": self.curve, "memo": {}}

    def emissions(self, words: list[str]) -> list[float]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in {x for x in words if x not in memo}:
            memo[w] = float(self.weights[slots(w)].sum())
        return [memo[w] for w in words]

    def probabilities(self, texts: list[list[str]]):
        """Marginals of the words of texts, one after another, and words per text."""
        import numpy as np

        lengths = np.array([len(x) for x in texts])
        some = lengths > 0
        score = np.array(self.emissions([w for x in texts for w in x]))
        return (marginals(score, lengths[some], self.moves)[0] if len(score) else score), lengths

    def document(self, p, lengths):
        """Scores of documents from the marginals of their words."""
        import numpy as np

        x = summary(p, lengths)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def summary(p, lengths):
    """What a document's score is made of: one, its most toxic word's probability, and the expected toxic words (log)."""
    import numpy as np

    top, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    some = np.flatnonzero(lengths > 0)
    if len(some):
        start = (np.cumsum(lengths) - lengths)[some]
        top[some], total[some] = np.maximum.reduceat(p, start), np.add.reduceat(p, start)
    return np.stack([np.ones(len(lengths)), top, np.log1p(total)], axis=1)


def train(rows: list[tuple[str, int]], most: int = 1000, turns: int = 25, longest: int = 1500) -> Model | None:
    """Trains on ``rows`` of text and label; the chain on the first ``most`` documents, half of them toxic, those of
    more than ``longest`` words in windows of so many, one after another."""
    import numpy as np

    told = [(words_of(t or ""), y) for t, y in rows]
    if len({y for _, y in told}) < 2:
        return None
    known = lexicon(told)
    toxic = {}

    def is_toxic(w):
        if w not in toxic:
            toxic[w] = any(f in known for f in features(w)[:-1])
        return toxic[w]

    used = [(x[i : i + longest], label) for y in (0, 1) for x, label in [x for x in told if x[1] == y and x[0]][: most // 2] for i in range(0, len(x), longest)]
    lengths = np.array([len(x) for x, _ in used])
    words = [w for x, _ in used for w in x]
    y = np.array([bool(label) and is_toxic(w) for x, label in used for w in x], float)
    kinds, kind = np.unique(words, return_inverse=True)
    ragged = [slots(str(w)) for w in kinds]
    flat, owner = np.concatenate([np.array(s) for s in ragged]), np.repeat(np.arange(len(kinds)), [len(s) for s in ragged])
    weights, step = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    logs, log_step = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    ends = np.cumsum(lengths) - 1
    inner = np.ones(len(words), bool)
    inner[ends] = False
    inner = np.flatnonzero(inner)
    want = np.array([[np.sum((y[inner] == i) * (y[inner + 1] == j)) for j in (0, 1)] for i in (0, 1)])
    for _ in range(turns):
        emit = np.bincount(owner, weights[flat], len(kinds))[kind]
        moves = np.exp(logs)
        p, ahead, back, lift = marginals(emit, lengths, moves)
        slope = np.bincount(flat, np.bincount(kind, (y - p), len(kinds))[owner], 1 << BITS) - 1e-3 * weights
        step += slope**2
        weights += 0.8 * slope / np.sqrt(step)
        v = lift[inner + 1] * back[inner + 1]
        joint = [[moves[0, 0] * np.ones(len(inner)), moves[0, 1] * v], [moves[1, 0] * ahead[inner], moves[1, 1] * ahead[inner] * v]]
        whole = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
        move_slope = want - np.array([[np.sum(joint[i][j] / whole) for j in (0, 1)] for i in (0, 1)]) - 1e-2 * logs
        log_step += move_slope**2
        logs += 0.2 * move_slope / np.sqrt(log_step)
    model = Model(weights, np.exp(logs), np.zeros(3))
    p, n = model.probabilities([x for x, _ in told])
    x, label = summary(p, n), np.array([v for _, v in told], float)
    curve = np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        curve += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(3) * 0.05, x.T @ (label - q) - 0.05 * curve)
    model.curve = curve
    return model


def sample(docs: DataFrame, labels: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most ``most`` labelled texts of each label, those least by a hash of doc_id."""
    rows = []
    for y in (0, 1):
        picked = labels.where((F.col("toxic") == y) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        rows += [(r["text"], y) for r in docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text").collect()]
    return rows


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with ``toxic_score`` and ``toxic_spans`` (start, end, probability of words at 0.5 or more)."""
    kept = [c for c in docs.columns if c.lower() not in ("toxic_score", "toxic_spans")]
    docs = docs.select(*kept)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores, spans, a = [], [], 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) < 3 << 20):
                    size += len(texts[b])
                    b += 1
                if model is None:
                    scores += [0.0] * (b - a)
                    spans += [[]] * (b - a)
                else:
                    words = [words_of(t) for t in texts[a:b]]
                    p, n = model.probabilities(words)
                    scores += model.document(p, n).tolist()
                    at = 0
                    for t, k in zip(texts[a:b], n.tolist(), strict=True):
                        own = p[at : at + k]
                        at += k
                        spans.append([{"start": m.start(), "end": m.end(), "p": float(q)} for m, q in zip(WORD.finditer(t), own, strict=True) if q >= 0.5] if k and own.max() >= 0.5 else [])
                a = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[*kept, "toxic_score", "toxic_spans"])

    span = StructType().add("start", IntegerType()).add("end", IntegerType()).add("p", DoubleType())
    return docs.mapInArrow(frugal("toxicity", run), StructType(list(docs.schema)).add("toxic_score", DoubleType()).add("toxic_spans", ArrayType(span)))
