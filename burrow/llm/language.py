"""Operator 6: language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds the vectors of its
letters, permuted by their place, by multiplication; a text's vector bundles those of its trigrams by addition. A
language's prototype is the bundle of all its training texts. Texts and prototypes are compared by cosine, both taken
relative to the prototypes' mean direction, which all languages share.

Letters are lower-cased; every run of other characters counts as one space. Texts that are null or have no letter are
``und`` with score 0. Where two languages come equally near, the first by name is taken. With no training rows, or
none with letters, every text is ``und``. Texts above CUT characters are bundled in pieces, cut at a space where there
is one; a longer run of letters counts as several words. Trigrams are bound and bundled KINDS at a time, so memory does
not grow with the variety of letters. Repeated rows each count and are each judged; an empty table gives an empty one;
extra columns are kept, but for two named like the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.llm.common import frugal

DIM = 1000
MEMO = 40_000
CUT, KINDS, ROWS = 1 << 19, 2048, 256
SHARPNESS = 12.0
_alpha = None
_vectors: dict = {}


def _letters(codes):
    """Which code points are letters."""
    import numpy as np

    global _alpha
    if _alpha is None:
        _alpha = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _alpha[codes]


def trigrams(texts: list[str]):
    """Text number and packed code points of each trigram of the lower-cased texts, word ends included."""
    import numpy as np

    parts = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    codes = np.concatenate(parts)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    letter = _letters(codes)
    codes = np.where(letter, codes, 32).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    keep[:1] = True
    codes, owner = codes[keep], owner[keep]
    if len(codes) < 3:
        return owner[:0], codes[:0]
    packed = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    inside = (owner[:-2] == owner[2:]) & (codes[1:-1] != 32)
    return owner[:-2][inside], packed[inside]


def letter_vector(code: int):
    import numpy as np

    if code not in _vectors:
        if len(_vectors) >= MEMO:
            _vectors.clear()
        _vectors[code] = np.random.default_rng(code).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
    return _vectors[code]


def trigram_vectors(packed):
    """Bound vectors of packed trigrams, one row each."""
    import numpy as np

    out = None
    for place, shift in enumerate((42, 21, 0)):
        codes, at = np.unique((packed >> shift) & 0x1FFFFF, return_inverse=True)
        table = np.roll(np.stack([letter_vector(c) for c in codes.tolist()]), 2 - place, axis=1)
        out = table[at] if out is None else out * table[at]
    return out.astype(np.float32)


def cut(text: str):
    """Pieces of a text of about CUT characters."""
    at = 0
    while len(text) - at > CUT:
        end = text.rfind(" ", at + 1, at + CUT)
        end = end if end > 0 else at + CUT
        yield text[at:end]
        at = end
    yield text[at:]


def bundles(texts: list[str], group=None, groups: int = 0):
    """Bundled vectors of the texts, or of groups of texts."""
    import numpy as np

    n = groups or len(texts)
    out = np.zeros((n, DIM))
    places = np.arange(n) if group is None else np.asarray(group)
    short = [k for k, t in enumerate(texts) if len(t) <= CUT]
    parts = [([texts[k] for k in short], places[short])] + [([piece], places[[k]]) for k, t in enumerate(texts) if len(t) > CUT for piece in cut(t)]
    for some, at in parts:
        owner, packed = trigrams(some) if some else (places[:0], places[:0])
        if not len(packed):
            continue
        kinds, kind = np.unique(packed, return_inverse=True)
        cell, count = np.unique(kind * n + at[owner], return_counts=True)
        edges = np.searchsorted(cell, np.arange(0, len(kinds) + KINDS, KINDS) * n)
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            own = kinds[k * KINDS : (k + 1) * KINDS]
            counts = np.zeros((n, len(own)), np.float32)
            counts[cell[a:b] % n, cell[a:b] // n - k * KINDS] = count[a:b]
            out += counts @ trigram_vectors(own)
    return out


def slices(texts: list, chars: int = 1 << 17):
    """Ranges of at most ROWS texts of about so many characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > chars or i + 1 - start == ROWS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _profiles(batches):
    import numpy as np
    import pyarrow as pa

    total: dict = {}
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for a, b in slices(texts):
            names, group = np.unique(langs[a:b], return_inverse=True)
            for name, v in zip(names.tolist(), bundles([t or "" for t in texts[a:b]], group, len(names)), strict=True):
                total[name] = total.get(name, 0) + np.rint(v).astype(np.int64)
    for name, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * DIM, pa.string()), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], names=["lang", "dim", "value"])


def learn(labelled: DataFrame) -> dict[str, list[float]]:
    """Prototype by language, from all rows of ``labelled(text, lang)`` that have both. One vector per language and
    task is shuffled, by language and dimension; what reaches the driver is a vector per language."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(frugal("language", _profiles), "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    found: dict = {}
    for r in rows:
        found.setdefault(r["lang"], [0.0] * DIM)[r["dim"]] = float(r["value"])
    return {k: v for k, v in sorted(found.items()) if any(v)}


def identify(docs: DataFrame, prototypes: dict[str, list[float]]) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score`` added (0 to 1); existing columns of these names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*kept)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = list(prototypes)
        if names:
            proto = np.array([prototypes[n] for n in names])
            proto /= np.linalg.norm(proto, axis=1, keepdims=True)
            centre = proto.mean(axis=0) if len(names) > 1 else np.zeros(DIM)
            proto = proto - centre
            proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)
        for batch in batches:
            texts, pred, score = [t or "" for t in batch.column("text").to_pylist()], [], []
            for a, b in slices(texts):
                v = bundles(texts[a:b])
                norm = np.linalg.norm(v, axis=1)
                some = norm > 0
                if not names or not some.any():
                    pred += ["und"] * (b - a)
                    score += [0.0] * (b - a)
                    continue
                v = v / np.maximum(norm, 1e-12)[:, None] - centre
                near = (v @ proto.T) / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
                odds = np.exp(SHARPNESS * (near - near.max(axis=1, keepdims=True)))
                best = near.argmax(axis=1)
                share = 1 / odds.sum(axis=1)
                lettered = [any(map(str.isalpha, t)) if not k else True for t, k in zip(texts[a:b], some, strict=True)]
                for k in range(b - a):
                    pred.append(names[best[k]] if some[k] or lettered[k] else "und")
                    score.append(float(share[k]) if some[k] or lettered[k] else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(list(docs.schema)).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(frugal("language", run), schema)
