"""Operator 7: byte-level BPE encoding and decoding over Arrow batches.

A file of ranks (.tiktoken) is read by the tiktoken library with the pattern of public_tokenizers, which encodes whole
texts. Its expression overflows its stack on white space that goes on for hundreds of thousands of characters, so a run
of RUN or more is cut out: all of it but its last character, or all of it at the end of a text, is one match of the
pattern, and what follows matches alike from there on. Spans of tokens come from their bytes.

A file of the tokenizers format (.json) is read by the tokenizers library. A text is then cut before every single space
that stands between two characters that are not white space. The pre-tokenizer always ends a match there, so each piece
is encoded alike alone and in place; a piece that a task has seen before is looked up, and the library encodes the
others of a batch in one call. Pieces above LONGEST characters aren't remembered, and those remembered take about
MEMO_BYTES at most. Offsets come from the library per piece, in characters, and shift by the piece's place.

Decoding maps each id to its bytes; characters whose bytes are split between tokens are whole again once the bytes are
joined, and a stream of ids is decoded incrementally without breaking them.

Null texts count as empty: no ids, and the digests of the empty string. Repeated rows, and rows without a doc_id, are
encoded one by one; an empty table gives an empty one; extra columns are ignored. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from burrow.llm.common import frugal, worker_cache

LONGEST, MEMO_BYTES, RUN = 64, 40 << 20, 10_000
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)
_ODD = re.compile(r"\s\s|\A\s|\s\Z")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_table() -> dict[str, int]:
    """Character to byte of the byte-level alphabet: printable bytes stand for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    spare = 0
    for b in range(256):
        if b not in plain:
            table[chr(0x100 + spare)] = b
            spare += 1
    return table


def pieces(text: str) -> list[str]:
    """The text, cut at places where a pre-token always ends."""
    if _ODD.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)] if text else []


class Codec:
    """Encoder and decoder of one vocabulary file in the tokenizers format."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        table = byte_table()
        special = {x["id"]: x["content"] for x in json.load(open(path, encoding="utf-8")).get("added_tokens", ())}
        vocab = self.library.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = special[i].encode() if i in special else bytes(table[c] for c in token)
        self.memo: dict[str, tuple] = {}
        self.held, self.passing = 0, []

    def learn(self, wanted: Iterable[str]) -> None:
        """Looks up the ids of pieces that the memo lacks. Long ones stay until the next call."""
        for x in self.passing:
            self.memo.pop(x, None)
        self.passing = []
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        new = [*{x for x in wanted if x not in self.memo}]
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            for piece, found in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.memo[piece] = tuple(found.ids)
                if len(piece) > LONGEST:
                    self.passing.append(piece)
                else:
                    self.held += 150 + 4 * len(piece) + 40 * len(found.ids)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        cut = [pieces(t) for t in texts]
        self.learn(x for c in cut for x in c)
        memo, out = self.memo, []
        for c in cut:
            ids: list[int] = []
            for x in c:
                ids += memo[x]
            out.append(ids)
        return out

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and their character spans in ``text``; tokens that share a split character have the same span end."""
        ids, spans, at = [], [], 0
        for piece in pieces(text):
            found = self.library.encode(piece, add_special_tokens=False)
            ids += found.ids
            spans += [(at + a, at + b) for a, b in found.offsets]
            at += len(piece)
        return ids, spans

    def decode(self, ids: Iterable[int]) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])

    def decode_stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of a stream of id chunks; a character split between chunks comes out with the later one."""
        held = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in chunks:
            yield held.decode(self.decode(ids))
        yield held.decode(b"", final=True)


class RankCodec(Codec):
    """Encoder and decoder of one file of ranks, as the tiktoken library encodes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.library = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [self.library.encode_ordinary(t) if len(t) < RUN else self._long(t) for t in texts]

    def _long(self, text: str) -> list[int]:
        ids, at = [], 0
        for run in _BLANK.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.library.encode_ordinary(text[at : run.start()])
            ids += self.library._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self.library.encode_ordinary(text[at:])

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        import numpy as np

        ids = self.encode(text)
        char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes[i]) for i in ids], dtype=np.int64)
        starts = np.r_[0, ends[:-1]]
        return ids, list(zip(char[starts].tolist(), (char[ends - 1] + 1).tolist(), strict=True)) if ids else []


def codec(path: str) -> Codec:
    kept = worker_cache("bytebpe")
    if path not in kept:
        kept[path] = (RankCodec if path.endswith(".tiktoken") else Codec)(path)
    return kept[path]


def _slices(texts: list, chars: int = 1 << 20):
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append((i, t or ""))
        size += len(t or "")
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _digests(path: str):
    def run(batches):
        import pyarrow as pa

        own = codec(path)
        decimal = [str(i) for i in range(len(own.bytes))]
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for some in _slices(batch.column("text").to_pylist()):
                for ids in own.encode_all([t for _, t in some]):
                    count.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str, *, offsets: bool = True) -> DataFrame:
    """``doc_id, ids array<int>`` and, with ``offsets``, ``starts`` and ``ends`` (characters) per row of ``docs(doc_id, text)``."""

    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for batch in batches:
            ids, starts, ends = [], [], []
            for t in batch.column("text").to_pylist():
                if offsets:
                    found, spans = own.encode_with_offsets(t or "")
                    starts.append([a for a, _ in spans])
                    ends.append([b for _, b in spans])
                else:
                    found = own.encode(t or "")
                ids.append(found)
            more = [pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))] if offsets else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), *more], names=["doc_id", "ids", *(["starts", "ends"] if offsets else [])])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else ""))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, bytes`` per row of ``encoded(doc_id, ids)``."""

    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row of ``docs(doc_id, text)``: encoded, then decoded from the ids."""
    return docs.select("doc_id", "text").mapInArrow(frugal("bytebpe", _digests(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
