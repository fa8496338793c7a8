"""Operator 10: token counts, huge documents by overlapping chunks that are spliced at stable boundaries.

A huge text is encoded in chunks that overlap. Both encodings of an overlap list the spans of its tokens; a place is
proven stable if both have a token ending before and one starting after the same white space character there, since
the tokenizer's words never hold white space and its normalizer joins no characters across it. The chunks are spliced
at the last such place. Where an overlap has none, it is widened, up to the whole rest of the text.

Other texts are encoded whole; their words between plain spaces and line feeds are encoded once per task and batch.
Special strings inside texts are handled as the library does by default. Null texts count as empty: 0 bytes, 0 tokens.
Repeated rows, and rows without a doc_id, are counted one by one; an empty table gives an empty one; extra columns are
ignored. Words above LONGEST characters aren't remembered. A huge text without white space in an overlap, however wide,
has no proven boundary there: its rest is encoded as a whole.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from burrow.llm.common import frugal, worker_cache

MEMO, LONGEST = 400_000, 64


class Counter:
    """Counts tokens as the tokenizers library does with the vocabulary file ``path``."""

    def __init__(self, path: str, chunk: int = 60_000, overlap: int = 512):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.memo: dict[str, int] = {}

    def spans(self, text: str) -> list[tuple[int, int]]:
        return self.library.encode(text, add_special_tokens=False).offsets

    def huge(self, text: str) -> int:
        """Tokens of a text that is encoded chunk by chunk."""
        total, start, skip = 0, 0, 0
        spans = self.spans(text[: self.chunk])
        end = min(self.chunk, len(text))
        while end < len(text):
            overlap = self.overlap
            while True:
                begin = max(start, end - overlap)
                stop = min(len(text), begin + self.chunk)
                later = self.spans(text[begin:stop])
                place = self.stable(text, [(start + a, start + b) for a, b in spans[skip:]], [(begin + a, begin + b) for a, b in later], begin, end)
                if place is not None:
                    break
                if begin == start:
                    later = self.spans(text[start:])
                    return total + len(later) - skip
                overlap *= 2
            kept, skip = place
            total += kept
            start, spans, end = begin, later, stop
        return total + len(spans) - skip

    @staticmethod
    def stable(text: str, left: list, right: list, begin: int, end: int) -> tuple[int, int] | None:
        """Tokens to keep of ``left`` and to skip of ``right`` at the last white space that both see alike in [begin, end)."""
        ends = {}
        for i, (_, b) in enumerate(left):
            ends[b] = i + 1
        for k in range(len(right) - 1, 0, -1):
            a, b = right[k - 1][1], right[k][0]
            if a < b and b < end and a > begin and text[a].isspace() and a in ends:
                kept = ends[a]
                if kept < len(left) and left[kept][0] == b and left[kept - 1] == right[k - 1]:
                    return kept, k
        return None

    def count(self, texts: list[str]) -> list[int]:
        cut = [t.replace("\n", " ").split(" ") if len(t) <= self.chunk else None for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new, passing = [*{x for c in cut if c for x in c if x not in memo}], []
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            for word, found in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                memo[word] = len(found.ids)
                if len(word) > LONGEST:
                    passing.append(word)
        counts = [self.huge(t) if c is None else sum([memo[x] for x in c]) for t, c in zip(texts, cut, strict=True)]
        for x in passing:
            del memo[x]
        return counts


def token_counts(docs: DataFrame, path: str, *, limit: int = 2048, chunk: int = 60_000, overlap: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs(doc_id, text)``.

    ``chunk``: characters of a chunk; longer texts are huge. ``overlap``: characters that chunks share at first.
    """

    def run(batches):
        import pyarrow as pa

        kept = worker_cache("tokencount")
        own = kept.get((path, chunk, overlap)) or Counter(path, chunk, overlap)
        kept[path, chunk, overlap] = own
        for batch in batches:
            texts, counts = [t or "" for t in batch.column("text").to_pylist()], []
            some, size = [], 0
            for t in [*texts, None]:
                if t is None or size > 1 << 20:
                    counts += own.count(some)
                    some, size = [], 0
                if t is not None:
                    some.append(t)
                    size += len(t)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(frugal("tokencount", run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
