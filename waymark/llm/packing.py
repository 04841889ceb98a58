"""Token sequences of fixed length, packed by best fit decreasing.

Documents become token ids; a document longer than a sequence is cut losslessly into full sequences and a rest. Pieces are
packed block by block, longest first, each into the open sequence with the least room that still takes it; a segment tree over
room sizes finds that in logarithmic time. A row of the result is one sequence: the ids as a little-endian uint32 matrix row, the
cumulative segment lengths, the positions that restart at every segment, and where each segment comes from.

A block is a run of documents of one input partition with a bounded number of tokens, so memory is bounded and nothing is shuffled;
only a block's last sequences may be left partly empty. Results depend on how the input is divided into files, but each
token of each document is in exactly one place, and reruns over the same files agree.

Defined results: null and empty texts have no tokens and no segments; documents without a doc_id are packed too, with a null
doc_id; repeated rows are packed one by one; pieces of equal length keep their order; an empty table gives no sequences; extra columns
play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQUENCE = 2048
#: A block ends with the document that brings it to so many tokens.
BLOCK_TOKENS = 1 << 20
PAD = 0

PACKED = T.StructType(
    [
        T.StructField("ids", T.BinaryType()),
        T.StructField("positions", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("n_tokens", T.IntegerType()),
    ]
)


class Rooms:
    """How many open sequences have each room size, as a segment tree of sums over 0 to ``size``."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and give the open sequence with the least room of at least ``need``."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until a subtree to the right has any
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        which = self.bins[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, which


def pack(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best fit decreasing: the pieces of each sequence; every length is from 1 to ``size``."""
    rooms, out = Rooms(size), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = rooms.take(need)
        if found is None:
            room, which = size, len(out)
            out.append([])
        else:
            room, which = found
        out[which].append(piece)
        if room > need:
            rooms.add(room - need, which)
    return out


def _block(docs: list[tuple[int | None, np.ndarray]], size: int) -> list[tuple]:
    pieces = [(doc, at, ids[at : at + size]) for doc, ids in docs for at in range(0, len(ids), size)]
    rows = []
    for chosen in pack(np.array([len(p[2]) for p in pieces], np.int64), size):
        parts = [pieces[i] for i in chosen]
        ends = np.cumsum([len(p[2]) for p in parts])
        ids, positions = np.full(size, PAD, np.uint32), np.zeros(size, np.uint32)
        ids[: ends[-1]] = np.concatenate([p[2] for p in parts])
        positions[: ends[-1]] = np.concatenate([np.arange(len(p[2])) for p in parts])
        rows.append((ids.tobytes(), positions.tobytes(), [0, *ends.tolist()], [p[0] for p in parts], [p[1] for p in parts], int(ends[-1])))
    return rows


def _encoding(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, size: int = SEQUENCE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Sequences of ``size`` tokens of all ``docs`` (doc_id, text), as PACKED; tokens by a file of byte-pair ranks."""
    with open(ranks_path, "rb") as file:  # a vocabulary of fixed size beside the driver
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(sent.value, pattern)
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = _block(held, size)
            held.clear()
            for start in range(0, len(rows), 256):
                columns = list(zip(*rows[start : start + 256]))
                kinds = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], PACKED.names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(encoding.encode_ordinary(text), np.uint32) if text else np.empty(0, np.uint32)
                held.append((doc, ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield from flush()
                    tokens = 0
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
