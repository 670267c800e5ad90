"""Packing by power-of-two decomposition: no sequence holds two documents, and none is padded.

A document of L tokens (its ids, then the end id 0) is cut, in order, into L // 1024 pieces of 1024 and one piece for
each binary digit of the rest, longest first. Each piece is a sequence of its own; equal lengths form a bucket.
``sequence_id`` is log2(length) * 2**56 + task * 2**30 + a running number, so a bucket's sequences are one range of ids and no
shuffle numbers them. Tasks count the input's partitions; a task run again makes the same ids.

Defined cases: null text is empty and gives one piece, the end id; an empty table gives no piece; repeated rows
are packed each; other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts, tuned

SEQUENCE = 1024
END = (0).to_bytes(4, "little")


def _bytes_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


class Encoder:
    """Token ids, as little-endian unsigned 32-bit bytes, by a byte-level BPE file of ``tokenizers``.

    Pretokens are cut by the file's own pattern and remembered, up to ``LIMIT`` of at most ``LONGEST`` characters; those not yet seen are merged by the
    same vocabulary as ranks. A text that holds an added token's string is left to ``tokenizers`` itself.
    """

    LIMIT, LONGEST = 1 << 19, 64

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.whole = path, None
        self.added = [x["content"] for x in spec.get("added_tokens", ())]
        stand, skip = _bytes_of(), set(self.added)
        ranks = {bytes(stand[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in skip}
        self.merge = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        encode, limit, longest = self.merge.encode_ordinary, self.LIMIT, self.LONGEST

        class Seen(dict):
            def __missing__(self, piece: str) -> bytes:
                value = np.array(encode(piece), "<u4").tobytes()
                if len(piece) <= longest:
                    if len(self) >= limit:
                        self.clear()
                    self[piece] = value
                return value

        self.seen = Seen()

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.seen.__getitem__, self.cut(text)))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def piece_lengths(n: int, most: int = SEQUENCE) -> list[int]:
    rest = n % most
    return [most] * (n // most) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for.

    ``sequence`` is a power of two; ``path`` names a vocabulary file that every executor has.
    """
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    docs = tuned(docs.sparkSession) and docs.select("doc_id", "text")

    def run(batches):
        encode, part, made = encoder(path), TaskContext.get().partitionId(), [0] * 64
        for batch in batches:
            ids, rows, out = batch.column("doc_id"), [], []
            for i, text in enumerate(texts(batch)):
                tokens, start = memoryview(encode(text) + END), 0
                total = len(tokens) // 4
                for n in piece_lengths(total, sequence):
                    piece, level = tokens[4 * start : 4 * (start + n)], n.bit_length() - 1
                    rows.append((i, start, n, zlib.crc32(piece), total, (level << 56) + (part << 30) + made[level]))
                    made[level] += 1
                    out += [piece] * with_ids
                    start += n
            if rows:
                at, *columns = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                columns = [ids.take(pa.array(at)), *map(pa.array, columns), pa.array(np.zeros(len(at), np.int64))]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(columns[2].to_numpy())]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.mapInArrow(run, schema)


def bucket(pieces: DataFrame, length: int) -> DataFrame:
    """The sequences of one length, as a curriculum over lengths draws them."""
    return pieces.where(F.col("length") == length)
